"""The five input tables, derived from the TPC-H-like test tables.

The SQL runs in Spark and in DuckDB. ``{name}`` stands for a table: Spark gets
a DataFrame for it, DuckDB the plain view name. ``$each_benefit`` stands for
the one expression that the two write differently: a row for each of 0 to 6.
Every row of the source tables appears; rows of some members are given to a
neighbour, so that members without rows remain.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from offerrank.sources.tables import normalize_timestamps

REFERENCE_TS = datetime(2001, 11, 5, 12, 0, 0)

MEMBERS_SQL = """
SELECT concat('MBR_', lpad(CAST(c_custkey AS STRING), 8, '0')) AS member_id,
       CAST(18 + (c_custkey * 37) % 67 AS INT) AS age,
       CASE WHEN c_custkey % 50 = 0 THEN 'O' WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
       r_name AS region,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'HMO' WHEN 'BUILDING' THEN 'PPO'
            WHEN 'FURNITURE' THEN 'EPO' WHEN 'HOUSEHOLD' THEN 'HDHP' ELSE 'POS' END AS plan_type,
       CAST(1 + (c_custkey * 53) % 240 AS INT) AS tenure_months,
       CASE WHEN c_acctbal < 1000 THEN '<30K' WHEN c_acctbal < 3000 THEN '30K-50K'
            WHEN c_acctbal < 5000 THEN '50K-75K' WHEN c_acctbal < 7000 THEN '75K-100K'
            WHEN c_acctbal < 9000 THEN '100K-150K' ELSE '>150K' END AS income_bracket,
       CAST(1 + c_custkey % 6 AS INT) AS family_size,
       CAST(DATE '2001-11-05' - CAST((c_custkey * 91) % 1095 AS INT) AS TIMESTAMP) AS enrollment_date,
       (c_acctbal + 1000) / 110 AS risk_score,
       CAST(CASE WHEN c_custkey % 10 < 6 THEN 0 ELSE c_custkey % 10 - 5 END AS INT) AS chronic_condition_count
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

CLAIMS_SQL = """
SELECT claim_id, member_id, claim_date, claim_type,
       CASE WHEN claim_type = 'preventive' THEN 'general_wellness' ELSE
         CASE dx WHEN 0 THEN 'general_wellness' WHEN 1 THEN 'cardiovascular' WHEN 2 THEN 'diabetes'
           WHEN 3 THEN 'respiratory' WHEN 4 THEN 'mental_health' WHEN 5 THEN 'musculoskeletal'
           WHEN 6 THEN 'gastrointestinal' WHEN 7 THEN 'dermatological' WHEN 8 THEN 'neurological'
           WHEN 9 THEN 'oncology' ELSE 'endocrine' END END AS diagnosis_category,
       claim_amount, allowed_amount, paid_amount, member_responsibility,
       CASE claim_type WHEN 'preventive' THEN 'primary_care' WHEN 'primary_care' THEN 'primary_care'
            WHEN 'specialist' THEN 'specialist' WHEN 'emergency' THEN 'emergency_room'
            WHEN 'inpatient' THEN 'hospital' WHEN 'outpatient' THEN 'ambulatory'
            WHEN 'lab' THEN 'laboratory' WHEN 'imaging' THEN 'imaging_center'
            ELSE 'ambulatory_surgical' END AS provider_type,
       in_network, status
FROM (
  SELECT concat('CLM_', CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING), '_',
                CAST(l_partkey AS STRING), '_', CAST(l_suppkey AS STRING)) AS claim_id,
         concat('MBR_', lpad(CAST(CASE WHEN o_custkey % 20 = 0 THEN o_custkey - 1 ELSE o_custkey END AS STRING), 8, '0'))
           AS member_id,
         CAST(l_shipdate AS TIMESTAMP) AS claim_date,
         CASE l_partkey % 9 WHEN 0 THEN 'preventive' WHEN 1 THEN 'primary_care' WHEN 2 THEN 'specialist'
              WHEN 3 THEN 'emergency' WHEN 4 THEN 'inpatient' WHEN 5 THEN 'outpatient'
              WHEN 6 THEN 'lab' WHEN 7 THEN 'imaging' ELSE 'procedure' END AS claim_type,
         (o_custkey * 7 + l_suppkey % (1 + o_custkey % 3)) % 11 AS dx,
         l_extendedprice AS claim_amount,
         l_extendedprice * (1 - l_discount / 2) AS allowed_amount,
         l_extendedprice * (1 - l_discount) AS paid_amount,
         l_extendedprice * l_tax AS member_responsibility,
         l_returnflag <> 'R' AS in_network,
         CASE WHEN l_linestatus = 'F' THEN 'paid' WHEN l_quantity < 25 THEN 'pending' ELSE 'denied' END AS status
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
) c
"""

BENEFITS_SQL = """
SELECT member_id, benefit_type, annual_max,
       annual_max * utilization_rate AS used_amount,
       annual_max * (1 - utilization_rate) AS remaining_balance,
       utilization_rate,
       CASE WHEN utilization_rate > CAST(0.1 AS DOUBLE)
            THEN CAST(DATE '2001-11-05' - CAST((ck * 13 + k * 29) % 365 AS INT) AS TIMESTAMP) END AS last_used_date,
       CAST((ck + k) % 20 AS INT) AS claims_count,
       2001 AS plan_year
FROM (
  SELECT concat('MBR_', lpad(CAST(CASE WHEN c_custkey % 17 = 0 THEN c_custkey - 1
                                       WHEN (c_custkey + k) % 13 = 0 AND c_custkey % 17 <> 1 THEN c_custkey - 1
                                       ELSE c_custkey END AS STRING), 8, '0')) AS member_id,
         c_custkey AS ck, k,
         CASE k WHEN 0 THEN 'medical' WHEN 1 THEN 'pharmacy' WHEN 2 THEN 'preventive' WHEN 3 THEN 'dental'
                WHEN 4 THEN 'vision' WHEN 5 THEN 'mental_health' ELSE 'telehealth' END AS benefit_type,
         CAST(CASE k WHEN 0 THEN 100000 WHEN 1 THEN 5000 WHEN 4 THEN 500 WHEN 5 THEN 5000 WHEN 6 THEN 1000
                     ELSE 2000 END AS DOUBLE)
           * CASE c_mktsegment WHEN 'AUTOMOBILE' THEN CAST(0.9 AS DOUBLE)
              WHEN 'BUILDING' THEN CAST(1.1 AS DOUBLE) WHEN 'HOUSEHOLD' THEN CAST(0.8 AS DOUBLE)
              ELSE CAST(1.0 AS DOUBLE) END AS annual_max,
         CAST((c_custkey * 31 + k * 17) % 1000 AS DOUBLE) / 1000 AS utilization_rate
  FROM (SELECT c_custkey, c_mktsegment, $each_benefit AS k FROM {customer}) s
) t
"""

ENGAGEMENT_SQL = """
SELECT concat('ENG_', CAST(event_id AS STRING)) AS engagement_id,
       concat('MBR_', lpad(CAST(user_id AS STRING), 8, '0')) AS member_id,
       CAST(CAST(DATE '2001-11-05' - CAST((event_id * 7) % 365 AS INT) AS TIMESTAMP)
            + (ts - date_trunc('day', ts)) AS TIMESTAMP) AS engagement_date,
       channel, engagement_type,
       event_type IN ('click', 'purchase') AS response_flag,
       CASE WHEN channel IN ('app', 'portal') THEN CAST(floor(value) AS INT) END AS session_duration_sec
FROM (
  SELECT event_id, user_id, ts, event_type, value,
         CASE CASE WHEN event_id % 10 < 6 THEN user_id % 6 ELSE event_id % 6 END
              WHEN 0 THEN 'email' WHEN 1 THEN 'app' WHEN 2 THEN 'phone' WHEN 3 THEN 'mail'
              WHEN 4 THEN 'portal' ELSE 'sms' END AS channel,
         CASE (event_id * 5 + user_id) % 7 WHEN 0 THEN 'offer_view' WHEN 1 THEN 'offer_click'
              WHEN 2 THEN 'appointment_schedule' WHEN 3 THEN 'content_view'
              WHEN 4 THEN 'survey_complete' WHEN 5 THEN 'portal_login' ELSE 'app_open' END AS engagement_type
  FROM {events}
) e
"""

FEEDBACK_SQL = """
SELECT o_orderkey AS feedback_id,
       concat('MBR_', lpad(CAST(CASE WHEN o_custkey < 5 THEN 5 ELSE o_custkey - o_custkey % 5 END AS STRING), 8, '0'))
         AS member_id,
       CASE o_orderkey % 16 WHEN 0 THEN 'PREV_001' WHEN 1 THEN 'PREV_002' WHEN 2 THEN 'CHRON_001'
         WHEN 3 THEN 'CHRON_002' WHEN 4 THEN 'CHRON_003' WHEN 5 THEN 'MH_001' WHEN 6 THEN 'MH_002'
         WHEN 7 THEN 'PHARM_001' WHEN 8 THEN 'PHARM_002' WHEN 9 THEN 'TELE_001' WHEN 10 THEN 'TELE_002'
         WHEN 11 THEN 'FIT_001' WHEN 12 THEN 'FIT_002' WHEN 13 THEN 'NAV_001' WHEN 14 THEN 'COST_001'
         ELSE 'COST_002' END AS offer_id,
       CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'rejected' ELSE 'comment' END AS feedback,
       CASE WHEN o_orderstatus = 'O' THEN concat('note ', CAST(o_orderkey AS STRING)) END AS feedback_text,
       CAST(o_orderdate AS TIMESTAMP) AS feedback_time
FROM {orders}
"""

VIEWS = {
    "members": (MEMBERS_SQL, ("customer", "nation", "region")),
    "claims": (CLAIMS_SQL, ("lineitem", "orders")),
    "benefits": (BENEFITS_SQL, ("customer",)),
    "engagement": (ENGAGEMENT_SQL, ("events",)),
    "feedback": (FEEDBACK_SQL, ("orders",)),
}


def fixture(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """One of the five input tables over the test tables in ``sf_dir``."""
    sql, tables = VIEWS[view]
    frames = {t: normalize_timestamps(spark.read.parquet(f"{sf_dir}/{t}.parquet"))
              for t in tables}
    return spark.sql(sql.replace("$each_benefit", "explode(sequence(0, 6))"), **frames)


def duckdb_view(view: str) -> str:
    """The same view as DuckDB SQL over the registered tables."""
    sql, tables = VIEWS[view]
    return sql.replace("$each_benefit", "unnest(range(0, 7))").format(**{t: t for t in tables})
