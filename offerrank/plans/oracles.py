"""DuckDB SQL with the meaning of each query, written apart from the operators.

Named parts (``PARTS``) are common table expressions; a query names the part it
reads and gets the parts that one needs in front.
"""

from __future__ import annotations

import re

from offerrank import fixed_values as fv
from offerrank.operators import features as fx
from offerrank.sources.fixtures import VIEWS, duckdb_view

REF = "TIMESTAMP '2001-11-05 12:00:00'"
FILLED = fx.FEATURES
LABELS = fx.LABEL_COLUMNS


def r(expression: str, name: str | None = None, digits: int = 6) -> str:
    return f"round(CAST({expression} AS DOUBLE) + CAST(2.5e-8 AS DOUBLE), {digits}) + 0.0 AS {name or expression}"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def days_since(column: str) -> str:
    return f"CAST(floor((epoch_us({REF}) - epoch_us({column})) / 86400000000.0) AS INT)"


def case_count(column: str, value: str, row_id: str) -> str:
    return f"CAST(count(CASE WHEN {column} = '{value}' THEN {row_id} END) AS BIGINT)"


DOUBLES = {
    "risk_score", "total_claims_amount", "avg_claim_amount", "std_claim_amount", "max_claim_amount",
    "total_paid_amount", "avg_paid_amount", "total_member_cost", "avg_member_cost", "in_network_rate",
    "claim_frequency_trend", "cost_per_claim", *[f"{t}_utilization_rate" for t in fv.BENEFIT_TYPES],
    "total_benefits_used", "total_remaining_balance", "total_annual_max", "avg_utilization_rate",
    "max_utilization_rate", "std_utilization_rate", "remaining_deductible_pct", "avg_response_rate",
    "avg_session_duration", *[f"{c}_engagement_rate" for c in fv.CHANNELS], "engagement_trend",
    "benefits_urgency"}


def shown(columns: list[str]) -> str:
    return ", ".join(r(c) if c in DOUBLES else c for c in columns)


PARTS: dict[str, str] = {view: duckdb_view(view) for view in VIEWS}

PARTS["claims_f"] = f"""
SELECT *, {days_since('last_claim')} AS days_since_last_claim,
  CAST(coalesce(claims_last_180d, 0) AS DOUBLE) / (coalesce(claims_last_365d, 1) + 1) AS claim_frequency_trend,
  total_claims_amount / (total_claims_count + 1) AS cost_per_claim,
  CAST(unique_diagnosis_count >= 3 AS INT) AS is_complex_patient
FROM (SELECT member_id, count(claim_id) AS total_claims_count, sum(claim_amount) AS total_claims_amount,
  avg(claim_amount) AS avg_claim_amount, stddev_samp(claim_amount) AS std_claim_amount,
  max(claim_amount) AS max_claim_amount, sum(paid_amount) AS total_paid_amount, avg(paid_amount) AS avg_paid_amount,
  sum(member_responsibility) AS total_member_cost, avg(member_responsibility) AS avg_member_cost,
  avg(CAST(in_network AS INT)) AS in_network_rate,
  {', '.join(f"CAST(sum(CASE WHEN claim_date >= {REF} - INTERVAL {d} DAY THEN 1 END) AS BIGINT) AS claims_last_{d}d"
             for d in (30, 90, 180, 365))},
  {', '.join(f"{case_count('claim_type', t, 'claim_id')} AS {t}_visit_count" for t in fv.CLAIM_TYPES)},
  max(claim_date) AS last_claim,
  {', '.join(f"max(CASE WHEN diagnosis_category = '{d}' THEN 1 ELSE 0 END) AS has_{d}" for d in fv.FLAGGED_DIAGNOSES)},
  count(DISTINCT diagnosis_category) AS unique_diagnosis_count
FROM claims GROUP BY member_id)"""

PARTS["benefits_f"] = f"""
SELECT *, total_remaining_balance / (total_annual_max + 1) AS remaining_deductible_pct,
  {days_since('last_used')} AS days_since_last_benefit_use
FROM (SELECT member_id,
  {', '.join(f"avg(utilization_rate) FILTER (benefit_type = '{t}') AS {t}_utilization_rate" for t in fv.BENEFIT_TYPES)},
  sum(used_amount) AS total_benefits_used, sum(remaining_balance) AS total_remaining_balance,
  sum(annual_max) AS total_annual_max, avg(utilization_rate) AS avg_utilization_rate,
  max(utilization_rate) AS max_utilization_rate, stddev_samp(utilization_rate) AS std_utilization_rate,
  CAST(sum(claims_count) AS BIGINT) AS total_benefit_claims, max(last_used_date) AS last_used
FROM benefits GROUP BY member_id)"""

# the code ranks the channels that some member prefers, so pick first, rank after
PARTS["preferred"] = """
SELECT *, CAST(dense_rank() OVER (ORDER BY preferred_channel) - 1 AS INT) AS preferred_channel_encoded
FROM (SELECT member_id, channel AS preferred_channel
      FROM (SELECT member_id, channel, count(*) AS n FROM engagement GROUP BY member_id, channel)
      QUALIFY row_number() OVER (PARTITION BY member_id ORDER BY n DESC, channel) = 1)"""

PARTS["engagement_f"] = f"""
SELECT e.*, preferred_channel, preferred_channel_encoded, {days_since('last_engagement')} AS days_since_last_engagement,
  CAST(coalesce(engagements_last_30d, 0) AS DOUBLE) / (total_engagements + 1) * 12 AS engagement_trend
FROM (SELECT member_id, count(engagement_id) AS total_engagements,
  avg(CAST(response_flag AS INT)) AS avg_response_rate, avg(session_duration_sec) AS avg_session_duration,
  {', '.join(f"CAST(sum(CASE WHEN engagement_date >= {REF} - INTERVAL {d} DAY THEN 1 END) AS BIGINT) AS engagements_last_{d}d"
             for d in (30, 90))},
  {', '.join(f"CAST(count(CASE WHEN channel = '{c}' THEN 1 END) AS DOUBLE) / (count(*) + 1) AS {c}_engagement_rate"
             for c in fv.CHANNELS)},
  {', '.join(f"{case_count('engagement_type', t, 'engagement_id')} AS {t}_count" for t in fv.ENGAGEMENT_TYPES)},
  max(engagement_date) AS last_engagement
FROM engagement GROUP BY member_id) e JOIN preferred USING (member_id)"""

AGE_GROUP = """CASE WHEN age > 0 AND age <= 26 THEN '18-25' WHEN age > 26 AND age <= 35 THEN '26-35'
  WHEN age > 35 AND age <= 50 THEN '36-50' WHEN age > 50 AND age <= 65 THEN '51-65'
  WHEN age > 65 AND age <= 100 THEN '65+' ELSE 'nan' END"""
TENURE_GROUP = """CASE WHEN tenure_months BETWEEN 1 AND 12 THEN '<1yr' WHEN tenure_months BETWEEN 13 AND 24 THEN '1-2yr'
  WHEN tenure_months BETWEEN 25 AND 60 THEN '2-5yr' WHEN tenure_months BETWEEN 61 AND 120 THEN '5-10yr'
  WHEN tenure_months BETWEEN 121 AND 300 THEN '10yr+' ELSE 'nan' END"""

TEMPORAL_VALUES = {
    "current_month": f"CAST(month({REF}) AS INT)", "current_quarter": f"CAST(quarter({REF}) AS INT)",
    "is_q4": f"CAST(quarter({REF}) = 4 AS INT)",
    "is_open_enrollment": f"CAST(month({REF}) IN (10, 11, 12) AS INT)",
    "is_flu_season": f"CAST(month({REF}) IN (10, 11, 12, 1, 2, 3) AS INT)",
    "is_allergy_season": f"CAST(month({REF}) IN (3, 4, 5, 9, 10) AS INT)",
    "days_until_year_end":
        f"CAST(floor((epoch_us(TIMESTAMP '2001-12-31 00:00:00') - epoch_us({REF})) / 86400000000.0) AS INT)",
    "benefits_urgency":
        f"1 - floor((epoch_us(TIMESTAMP '2001-12-31 00:00:00') - epoch_us({REF})) / 86400000000.0) / 365.0"}
TEMPORAL = ", ".join(f"{v} AS {k}" for k, v in TEMPORAL_VALUES.items())

PARTS["raw"] = f"""
SELECT m.*, {AGE_GROUP} AS age_group, {TENURE_GROUP} AS tenure_group,
  CAST(age >= 65 AS INT) AS is_senior, CAST(tenure_months <= 12 AS INT) AS is_new_member,
  CAST(chronic_condition_count > 0 AS INT) AS has_chronic_condition, CAST(risk_score > 70 AS INT) AS high_risk_flag,
  c.* EXCLUDE (member_id), b.* EXCLUDE (member_id), e.* EXCLUDE (member_id), {TEMPORAL}
FROM members m LEFT JOIN claims_f c USING (member_id) LEFT JOIN benefits_f b USING (member_id)
  LEFT JOIN engagement_f e USING (member_id)"""


def filled_value(column: str) -> str:
    if re.search("count|total", column):
        return f"coalesce({column}, 0)"
    if re.search("rate|pct", column):
        return f"coalesce({column}, (SELECT quantile_cont({column}, 0.5) FROM encoded))"
    return f"coalesce({column}, {365 if 'days_since' in column else 0})"


PARTS["encoded"] = f"""
SELECT *, {', '.join(f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INT) AS {c}_encoded" for c in LABELS)} FROM raw"""
PARTS["features"] = "SELECT member_id, " + ", ".join(
    f"{filled_value(c)} AS {c}" for c in FILLED) + " FROM encoded"

# score of each offer before clipping, in catalog order
OFFER_SCORES = {
    "PREV_001": "60 + 10 * (age >= 40)::INT + 15 * (days_since_last_claim >= 180)::INT + 10 * has_chronic_condition",
    "PREV_002": "55 + 20 * (age >= 50)::INT + 15 * high_risk_flag",
    "CHRON_001": "50 + 40 * has_diabetes + 10 * high_risk_flag",
    "CHRON_002": "50 + 40 * has_cardiovascular + 10 * (age >= 50)::INT + 10 * high_risk_flag",
    "CHRON_003": "50 + 40 * has_respiratory + 5 * is_allergy_season",
    "MH_001": "55 + 35 * has_mental_health + 10 * (age <= 45)::INT + 5 * (engagement_trend >= 0.5)::INT",
    "MH_002": "50 + 10 * (total_claims_count >= 10)::INT + 10 * (avg_response_rate >= 0.2)::INT",
    "PHARM_001": "45 + 20 * (pharmacy_utilization_rate >= 0.4)::INT + 15 * (total_member_cost >= 500)::INT",
    "PHARM_002": "45 + 15 * (pharmacy_utilization_rate >= 0.3)::INT + 10 * has_chronic_condition",
    "TELE_001": "50 + 15 * (app_engagement_rate >= 0.2)::INT + 10 * (primary_care_visit_count >= 2)::INT",
    "TELE_002": "45 + 20 * (specialist_visit_count >= 2)::INT + 15 * is_complex_patient",
    "FIT_001": "40 + 10 * (age <= 55)::INT + 10 * has_cardiovascular + 10 * has_diabetes",
    "FIT_002": "45 + 15 * has_diabetes + 10 * has_cardiovascular + 10 * high_risk_flag",
    "NAV_001": "40 + 30 * is_complex_patient + 15 * (total_claims_count >= 15)::INT"
               " + 10 * (chronic_condition_count >= 2)::INT",
    "COST_001": "45 + 15 * (remaining_deductible_pct >= 0.5)::INT + 20 * is_q4",
    "COST_002": "45 + 20 * (in_network_rate <= 0.8)::INT + 10 * (total_member_cost >= 500)::INT"}
CLIPPED = {o: f"CAST(greatest(0, least(100, {s})) AS DOUBLE)" for o, s in OFFER_SCORES.items()}

PARTS["offers"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({text(o[0])}, {text(o[1])}, {text(o[2])}, {text(o[4])})" for o in fv.OFFERS
) + ") AS o(offer_id, offer_name, category, description)"
PARTS["scores"] = " UNION ALL ".join(
    f"SELECT member_id, '{o}' AS offer_id, {i} AS ord, {s} AS score FROM features"
    for i, (o, s) in enumerate(CLIPPED.items()))
PARTS["ranked"] = """
SELECT member_id, offer_id, ord, round_even(score, 2) AS priority_score,
  row_number() OVER (PARTITION BY member_id ORDER BY score DESC, ord) AS place FROM scores"""


def recs(min_score: float, exclude: list[str] = ()) -> str:
    banned = "".join(f" AND category <> '{c}'" for c in exclude)
    return f"""
SELECT member_id, CAST(rank AS INT) AS rank, offer_id, offer_name, category, priority_score, description
FROM (SELECT *, row_number() OVER (PARTITION BY member_id ORDER BY place) AS rank
      FROM ranked JOIN offers USING (offer_id) WHERE place <= 10 AND priority_score >= {min_score}{banned})
WHERE rank <= 5"""


PARTS["recs"] = recs(25)
PARTS["decided"] = "SELECT * FROM feedback WHERE feedback IN ('approved', 'rejected')"
PARTS["adjusted"] = """
SELECT member_id, offer_id, ord, score, coalesce(list_reduce(list_prepend(score, steps),
    lambda s, d: CASE WHEN d > 0 THEN least(100.0, s + d) ELSE greatest(0.0, s + d) END), score) AS adjusted_score
FROM scores LEFT JOIN (
  SELECT member_id, offer_id, list(CASE feedback WHEN 'approved' THEN CAST(15 AS DOUBLE) ELSE CAST(-20 AS DOUBLE) END
    ORDER BY feedback_time DESC, feedback_id DESC) AS steps
  FROM decided GROUP BY member_id, offer_id) USING (member_id, offer_id)"""


def _boost(rule: tuple) -> str:
    offer, name, kind, threshold, boost = rule
    feature = name.removesuffix("_boost")
    value = (f"coalesce({feature}, 0) * {boost}" if kind == "scale" else
             f"CASE WHEN {feature} {'>=' if kind == 'min' else '<='} {threshold} THEN {boost} ELSE 0 END")
    return (f"SELECT member_id, '{offer}' AS offer_id, '{name}' AS rule, '{feature}' AS feature, "
            f"CAST({feature} AS DOUBLE) AS value, CAST({value} AS DOUBLE) AS boost FROM features")


# pharmacy_utilization is no feature, so that rule adds nothing
PARTS["boosts"] = " UNION ALL ".join(_boost(x) for x in fv.OFFER_RULES if x[1] != "pharmacy_utilization_boost")
PARTS["factors"] = """
SELECT member_id, offer_id, rank, offer_name, priority_score,
  CAST(row_number() OVER (PARTITION BY member_id, offer_id ORDER BY -abs(shap), feature) AS INT) AS factor_rank,
  feature, round_even(value, 2) + 0.0 AS value, round_even(shap, 3) + 0.0 AS shap_value,
  CASE WHEN shap > 0 THEN 'increases' ELSE 'decreases' END AS direction
FROM recs JOIN (SELECT *, boost - avg(boost) OVER (PARTITION BY offer_id, rule) AS shap FROM boosts)
USING (member_id, offer_id)"""
PARTS["factor_json"] = """
SELECT member_id, offer_id, '[' || string_agg('{"feature":"' || feature || '","value":' || CAST(value AS VARCHAR)
  || ',"shap_value":' || CAST(shap_value AS VARCHAR) || ',"direction":"' || direction || '"}', ','
  ORDER BY factor_rank) || ']' AS shap_factors
FROM factors GROUP BY member_id, offer_id"""
PARTS["consolidated"] = f"""
SELECT member_id, offer_id, offer_name, rank, {r('priority_score')}, '' AS llm_reasoning, shap_factors, age,
  {r('risk_score')}, chronic_condition_count, CAST(total_claims_count AS INT) AS total_claims,
  CAST(total_engagements AS INT) AS total_engagements, has_diabetes, has_cardiovascular, has_respiratory,
  has_mental_health, is_complex_patient, tenure_months, is_senior, high_risk_flag, {r('avg_utilization_rate')},
  {r('avg_response_rate')}, '2001-11-05T12:00:00' AS generated_at, 'demo' AS model_version
FROM recs JOIN factor_json USING (member_id, offer_id) JOIN features USING (member_id)"""
PARTS["segmented"] = """
SELECT *, CASE WHEN is_senior = 1 THEN 'Seniors' WHEN is_new_member = 1 THEN 'New Members'
  WHEN total_claims_count > (SELECT quantile_cont(total_claims_count, 0.9) FROM features) THEN 'High Utilizers'
  WHEN total_engagements > (SELECT quantile_cont(total_engagements, 0.75) FROM features)
    AND avg_response_rate > 0.3 THEN 'Active Engagers'
  WHEN chronic_condition_count >= 2 AND risk_score > 50 THEN 'High-Risk Chronic' ELSE 'Standard' END AS segment
FROM features"""
PARTS["sample"] = "SELECT member_id FROM members ORDER BY md5(member_id), member_id LIMIT 100"
PARTS["claim_summary"] = """
SELECT m.*, coalesce(claim_count, 0) AS claim_count, coalesce(total_claim_amount, 0) AS total_claim_amount
FROM members m LEFT JOIN (SELECT member_id, count(claim_id) AS claim_count, sum(claim_amount) AS total_claim_amount
  FROM claims GROUP BY member_id) USING (member_id)"""
PARTS["age_counts"] = """
SELECT b.age_group, count(r.member_id) AS n
FROM (VALUES ('<35', 0, 35), ('35-50', 35, 50), ('50-65', 50, 65), ('65+', 65, 100)) AS b(age_group, low, high)
LEFT JOIN (SELECT recs.member_id, age FROM recs LEFT JOIN members USING (member_id)) r ON r.age > low AND r.age <= high
GROUP BY b.age_group"""
PARTS["summary"] = f"""
SELECT count(*) AS total_recommendations, {r('avg(priority_score)', 'mean_score')},
  {r('stddev_samp(priority_score)', 'std_score')}, {r('min(priority_score)', 'min_score')},
  {r('max(priority_score)', 'max_score')}, count(DISTINCT member_id) AS unique_members,
  count(DISTINCT offer_id) AS unique_offers, {r('median(priority_score)', 'median_score')},
  {r('count(*)::DOUBLE / count(DISTINCT member_id)', 'avg_per_member')} FROM recs"""

# --- reader-facing text ---
PLAIN_NAME = "replace(replace(replace(feature, '_', ' '), 'has ', ''), ' flag', '')"
TITLE = "CASE " + " ".join(
    f"WHEN contains(lower({PLAIN_NAME}), {text(k)}) THEN {text(v)}" for k, v in fv.FACTOR_PHRASES
) + f""" ELSE array_to_string(list_transform(regexp_extract_all(lower({PLAIN_NAME}), '[a-z]+|[^a-z]+'),
  lambda w: upper(w[1]) || w[2:]), '') END"""
PARTS["cases"] = f"""
SELECT *, {TITLE} AS title, CASE
  WHEN regexp_matches(feature, 'engagement|response') THEN CASE WHEN regexp_matches(feature, 'phone|call') THEN 'phone'
    WHEN contains(feature, 'email') THEN 'email' WHEN regexp_matches(feature, 'app|portal') THEN 'digital'
    WHEN contains(feature, 'response') THEN 'response' ELSE 'program' END
  WHEN feature = 'age' THEN 'age'
  WHEN contains(feature, 'diabetes') THEN CASE WHEN has_diabetes = 1 THEN 'diabetes' ELSE 'no diabetes' END
  WHEN contains(feature, 'cardiovascular') THEN CASE WHEN has_cardiovascular = 1 THEN 'heart' ELSE 'no heart' END
  WHEN contains(feature, 'chronic_condition') THEN CASE
    WHEN chronic_condition_count > 2 AND direction = 'increases' THEN 'many chronic'
    WHEN chronic_condition_count > 0 THEN 'some chronic' ELSE 'no chronic' END
  WHEN contains(feature, 'claim') THEN CASE WHEN total_claims_count > 0 THEN 'claims' ELSE 'no claims' END
  ELSE 'other' END AS case_name,
  CASE WHEN feature = 'age' THEN age WHEN contains(feature, 'chronic') THEN chronic_condition_count
    ELSE total_claims_count END AS n
FROM factors JOIN features f USING (member_id)"""
SENTENCES = "(VALUES " + ", ".join(
    f"({text(k)}, {text('increases' if up else 'decreases')}, {text(v)})"
    for (k, up), v in fv.FACTOR_SENTENCES.items()) + ") AS s(case_name, direction, sentence)"


def line(label: str, value: str) -> str:
    return f"'- {label}: ' || {value}"


def fixed(value: str, digits: int) -> str:
    return f"printf('%.{digits}f', {value})"


def short(value: str) -> str:
    return f"regexp_replace(printf('%.2f', {value}), '0$', '')"


def yes(column: str) -> str:
    return f"CASE {column} WHEN 1 THEN 'True' ELSE 'False' END"


PROMPT = "concat_ws(chr(10), " + ", ".join([
    text(fv.PROMPT_HEAD), "''", "'MEMBER PROFILE:'", line("Age", "age"), line("Risk Score", fixed("risk_score", 1)),
    line("Chronic Conditions", "chronic_condition_count"), line("Total Claims", "total_claims_count"),
    line("Has Diabetes", yes("has_diabetes")), line("Has Cardiovascular Issues", yes("has_cardiovascular")),
    line("Has Respiratory Issues", yes("has_respiratory")),
    line("Has Mental Health History", yes("has_mental_health")),
    line("Is Complex Patient", yes("is_complex_patient")), "''", "'RECOMMENDED OFFER:'",
    line("Offer Name", "offer_name"), line("Priority Score", fixed("priority_score", 1)) + " || '/100'", "''",
    "'KEY FACTORS INFLUENCING THIS RECOMMENDATION:'", "lines", "''", text(fv.PROMPT_TAIL)]) + ")"
PARTS["prompt_lines"] = f"""
SELECT member_id, offer_id, offer_name, priority_score, string_agg('- ' || replace(feature, '_', ' ') || ': '
  || {short('value')} || ' (' || CASE direction WHEN 'increases' THEN 'positively' ELSE 'negatively' END
  || ' influences recommendation)', chr(10) ORDER BY factor_rank) AS lines
FROM factors GROUP BY ALL"""
PARTS["offer_blocks"] = f"""
SELECT member_id, rank, chr(10) || '[Rank ' || rank || '] ' || offer_name || chr(10) || '  Offer ID: ' || offer_id
  || chr(10) || '  Priority Score: ' || {fixed('priority_score', 1)} || '/100' || chr(10) || '  ' || chr(10)
  || '  Top Factors Influencing This Recommendation:' || chr(10)
  || string_agg('    ' || factor_rank || '. ' || feature || ': ' || {short('value')} || ' ('
     || CASE direction WHEN 'increases' THEN '↑' ELSE '↓' END || ' score by '
     || {fixed('abs(shap_value)', 2)} || ')', chr(10) ORDER BY factor_rank) AS block
FROM factors GROUP BY member_id, rank, offer_name, offer_id, priority_score"""
CONDITIONS = "concat_ws(', ', " + ", ".join(
    f"CASE WHEN {c} = 1 THEN '{label}' END" for c, label in (
        ("has_diabetes", "Diabetes"), ("has_cardiovascular", "Cardiovascular"), ("has_respiratory", "Respiratory"),
        ("has_mental_health", "Mental Health"))) + ")"
MEMBER_TEXT = f"""concat_ws(chr(10), '=== MEMBER PROFILE: ' || member_id || ' ===', chr(10) || 'Key Demographics:',
  '  - Age: ' || age, '  - Risk Score: ' || {fixed('risk_score', 1)},
  '  - Chronic Conditions: ' || chronic_condition_count, '  - Total Claims: ' || total_claims_count,
  '  - Total Engagements: ' || total_engagements,
  CASE WHEN {CONDITIONS} <> '' THEN '  - Conditions: ' || {CONDITIONS} END,
  chr(10) || '=== RECOMMENDED OFFERS ===', blocks, chr(10) || '{fv.MEMBER_TEXT_RULER}')"""


def json_bool(column: str) -> str:
    return f"""'"{column}":' || CASE {column} WHEN 1 THEN 'true' ELSE 'false' END"""


MEMBER_JSON = ("""'{"member_id":"' || member_id || '","profile":{"age":' || age || ',"risk_score":'
  || CAST(risk_score AS VARCHAR) || ',"chronic_condition_count":' || chronic_condition_count || ',"total_claims":'
  || total_claims_count || ',"total_engagements":' || total_engagements || ',' || """ + " || ',' || ".join(
    json_bool(c) for c in ("is_senior", "has_diabetes", "has_cardiovascular", "has_respiratory", "has_mental_health",
                           "is_complex_patient")) + """ || '},"recommendations":[' || recs_json || ']}'""")

# --- metrics of naive predictors ---
def metrics(by: str) -> str:
    return f"""
SELECT sqrt(sum(sse) / sum(n)) AS rmse, sum(sae) / sum(n) AS mae,
  avg(CASE WHEN sst > 0 THEN 1 - sse / sst WHEN sse = 0 THEN 1.0 ELSE 0.0 END) AS r2,
  avg(sqrt(sse / n)) AS avg_rmse_per_offer
FROM (SELECT offer_id, count(*) AS n, sum((y - p) * (y - p)) AS sse, sum(abs(y - p)) AS sae, var_pop(y) * count(*) AS sst
  FROM (SELECT offer_id, score AS y, avg(score) OVER (PARTITION BY offer_id{by}) AS p
        FROM scores JOIN features USING (member_id)) GROUP BY offer_id)"""


PARTS["versions"] = (f"SELECT 1 AS version, * FROM ({metrics('')}) UNION ALL "
                     f"SELECT 2 AS version, * FROM ({metrics(', is_senior, has_diabetes')})")


def per_feature(measures: dict[str, str], source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, " + ", ".join(f"{m.replace('?', c)} AS {n}" for n, m in measures.items())
        + f" FROM {source}" for c in columns)


STATS = {"count": "count(?)", "mean": "avg(?)", "std": "stddev_samp(?)", "min": "CAST(min(?) AS DOUBLE)",
         "max": "CAST(max(?) AS DOUBLE)", "missing_pct": "avg(CASE WHEN ? IS NULL THEN 1 ELSE 0 END) * 100"}
RAW_NUMERIC = [c for c in FILLED if not c.endswith("_encoded")]
RAW_ALL = (["member_id", "age", "tenure_months", "family_size", "risk_score", "chronic_condition_count"] + LABELS
           + ["is_senior", "is_new_member", "has_chronic_condition", "high_risk_flag"] + fx.CLAIMS + fx.DIAGNOSIS
           + fx.BENEFITS + ["preferred_channel"]
           + [c for c in fx.ENGAGEMENT if c != "preferred_channel_encoded"] + fx.TEMPORAL)
PARTS["raw_stats"] = per_feature(STATS, "raw", RAW_NUMERIC)
PARTS["monitor"] = per_feature({"mean": "avg(?)"}, "features", FILLED)
PARTS["monitor_40"] = per_feature({"mean": "avg(?)"}, "features WHERE age >= 40", FILLED)


def histogram(values: str, bins: int, by: str = "") -> str:
    """``values`` selects v and the grouping column."""
    comma = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""
SELECT {comma}bin, {r('low + bin * width', 'low')}, {r('low + (bin + 1) * width', 'high')}, count(*) AS n
FROM (SELECT {comma}low, width, CASE WHEN width = 0 THEN 0
        ELSE CAST(least({bins - 1}, floor((v - low) / width)) AS INT) END AS bin
      FROM (SELECT *, min(v) OVER ({part}) AS low, (max(v) OVER ({part}) - min(v) OVER ({part})) / {bins} AS width
            FROM ({values}) WHERE v IS NOT NULL))
GROUP BY {comma}bin, low, width"""


def time_text(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS {column}"


def correlation(source: str, columns: list[str]) -> str:
    cells = [f"SELECT '{a}' AS a, '{b}' AS b, " + (
        r(f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))", "r") if a != b else
        f"CASE WHEN stddev_pop({a}) > 0 THEN CAST(1 AS DOUBLE) END AS r") + f" FROM {source}"
        for a in columns for b in columns]
    return " UNION ALL ".join(cells)


RECS = f"member_id, rank, offer_id, offer_name, category, {r('priority_score')}, description"

QUERIES: dict[str, str] = {
    "scan_members": f"""SELECT member_id, age, gender, region, plan_type, tenure_months, income_bracket, family_size,
      {time_text('enrollment_date')}, {r('risk_score')}, chronic_condition_count FROM members""",
    "scan_claims": f"""SELECT claim_id, member_id, {time_text('claim_date')}, claim_type, diagnosis_category,
      {r('claim_amount')}, {r('allowed_amount')}, {r('paid_amount')}, {r('member_responsibility')}, provider_type,
      CAST(in_network AS INT) AS in_network, status FROM claims""",
    "scan_benefits": f"""SELECT member_id, benefit_type, {r('annual_max')}, {r('used_amount')},
      {r('remaining_balance')}, {r('utilization_rate')}, {time_text('last_used_date')}, claims_count, plan_year
      FROM benefits""",
    "scan_engagement": f"""SELECT engagement_id, member_id, {time_text('engagement_date')}, channel, engagement_type,
      CAST(response_flag AS INT) AS response_flag, session_duration_sec FROM engagement""",
    "feedback_load": f"""SELECT member_id, offer_id, feedback, feedback_text, {time_text('feedback_time')}
      FROM decided""",
    "feedback_append": f"""SELECT feedback_id, member_id, offer_id, feedback,
      coalesce(feedback_text, '') AS feedback_text, {time_text('feedback_time')} FROM feedback""",
    "export_json": """SELECT '{"member_id":"' || member_id || '","rank":' || rank || ',"offer_id":"' || offer_id
      || '","offer_name":"' || offer_name || '","category":"' || category || '","priority_score":'
      || CAST(priority_score AS VARCHAR) || ',"description":"' || description || '"}' AS value FROM recs""",
    "search_members": """SELECT DISTINCT member_id FROM recs WHERE member_id LIKE '%0001%'
      ORDER BY member_id LIMIT 20""",
    "list_members": "SELECT DISTINCT member_id FROM recs ORDER BY member_id LIMIT 500",
    "member_lookup": """SELECT member_id, offer_id, offer_name, rank, priority_score, llm_reasoning, shap_factors, age,
      risk_score, chronic_condition_count, has_diabetes, has_cardiovascular, has_respiratory, has_mental_health,
      is_complex_patient, tenure_months, total_claims, total_engagements, avg_utilization_rate, high_risk_flag
      FROM consolidated WHERE member_id = 'MBR_00000042' ORDER BY rank LIMIT 5""",
    "sample_members": "SELECT * FROM sample",
    "age_group": f"SELECT member_id, age, {AGE_GROUP} AS age_group FROM members",
    "tenure_group": f"SELECT member_id, tenure_months, {TENURE_GROUP} AS tenure_group FROM members",
    "safe_casts": """SELECT feedback_id,
      CASE feedback_id % 7 WHEN 4 THEN CAST(feedback_id AS DOUBLE) WHEN 5 THEN -(feedback_id + CAST(0.75 AS DOUBLE))
        WHEN 6 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS as_float,
      CASE feedback_id % 7 WHEN 4 THEN feedback_id WHEN 5 THEN -feedback_id WHEN 6 THEN 1 ELSE 0 END AS as_int,
      CASE WHEN feedback_id % 7 IN (1, 2, 6) OR (feedback_id % 7 = 4 AND feedback_id = 1) THEN 1 ELSE 0 END AS as_bool
      FROM feedback""",
    "features_demographic": f"SELECT member_id, {shown(fx.DEMOGRAPHIC)} FROM features",
    "features_claims": f"SELECT member_id, {shown(fx.CLAIMS)} FROM claims_f",
    "features_diagnosis": f"SELECT member_id, {shown(fx.DIAGNOSIS)} FROM claims_f",
    "features_benefits": f"SELECT member_id, {shown(fx.BENEFITS)} FROM benefits_f",
    "features_engagement": "SELECT member_id, " + shown(
        [c for c in fx.ENGAGEMENT if c != "preferred_channel_encoded"]) + " FROM engagement_f",
    "preferred_channel": "SELECT member_id, preferred_channel FROM preferred",
    "features_temporal": "SELECT member_id, " + ", ".join(
        r(v, k) if k in DOUBLES else f"{v} AS {k}" for k, v in TEMPORAL_VALUES.items()) + " FROM members",
    "member_features_raw": f"SELECT {shown(RAW_ALL)} FROM raw",
    "member_features": f"SELECT member_id, {shown(FILLED)} FROM features",
    "label_encode": " UNION ALL ".join(
        f"SELECT DISTINCT '{c}' AS \"column\", {c} AS value, {c}_encoded AS code FROM encoded" for c in LABELS)
    + " UNION ALL SELECT DISTINCT 'preferred_channel', preferred_channel, preferred_channel_encoded FROM preferred",
    "member_claim_summary": f"SELECT member_id, claim_count, {r('total_claim_amount')} FROM claim_summary",
    **{f"describe_{name}": f"""SELECT count({c}) AS count, {r(f'avg({c})', 'mean')}, {r(f'stddev_samp({c})', 'std')},
      {f'min({c}) AS min' if name == 'age' else r(f'min({c})', 'min')}, {r(f'quantile_cont({c}, 0.25)', 'p25')},
      {r(f'quantile_cont({c}, 0.5)', 'p50')}, {r(f'quantile_cont({c}, 0.75)', 'p75')},
      {f'max({c}) AS max' if name == 'age' else r(f'max({c})', 'max')} FROM {source}"""
       for name, c, source in (("age", "age", "members"), ("claim_amount", "claim_amount", "claims"))},
    "value_share": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n, "
        f"{r('count(*)::DOUBLE / sum(count(*)) OVER ()', 'share')} FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}"
        for t, c in (("members", "gender"), ("members", "region"), ("members", "plan_type"), ("claims", "claim_type"),
                     ("engagement", "channel"), ("engagement", "engagement_type"))),
    "claims_per_member": f"""SELECT min(n) AS min_claims, {r('avg(n)', 'mean_claims')},
      {r('median(n)', 'median_claims')}, max(n) AS max_claims
      FROM (SELECT count(*) AS n FROM claims GROUP BY member_id)""",
    "benefit_summary": f"""SELECT benefit_type, {r('avg(utilization_rate)', 'mean_utilization')},
      {r('stddev_samp(utilization_rate)', 'std_utilization')}, {r('sum(used_amount)', 'used_amount')},
      {r('sum(remaining_balance)', 'remaining_balance')} FROM benefits GROUP BY benefit_type""",
    "response_rate": f"SELECT {r('avg(CAST(response_flag AS INT))', 'response_rate')} FROM engagement",
    "claim_amount_hist": histogram("SELECT least(claim_amount, 5000.0::DOUBLE) AS v FROM claims", 50),
    "feature_histograms": histogram(" UNION ALL ".join(
        f"SELECT '{c}' AS feature, " + (f"CASE WHEN {c} > 0 THEN ln(1 + CAST({c} AS DOUBLE)) END"
                                        if c in fv.LOG_HISTOGRAM_FEATURES else f"CAST({c} AS DOUBLE)")
        + " AS v FROM features" for c in fv.HISTOGRAM_FEATURES), 50, "feature"),
    "corr_members_claims": correlation("claim_summary", fv.MEMBER_CORRELATION_COLUMNS),
    "corr_features": correlation("features", fv.FEATURE_CORRELATION_COLUMNS),
    "feature_stats": f"""SELECT feature, count, {', '.join(r(c) for c in ('mean', 'std', 'min', 'max', 'missing_pct'))}
      FROM ({per_feature(STATS, 'features', FILLED)})""",
    "feature_group_stats": " UNION ALL ".join(
        f"SELECT '{g}' AS feature_group, count(*) AS n_features, min(feature) AS first_feature, "
        f"{r('avg(missing_pct)', 'mean_missing_pct')} FROM raw_stats WHERE "
        + " OR ".join(f"contains(feature, '{w}')" for w in words) for g, words in fv.FEATURE_GROUPS.items()),
    "member_segments": "SELECT member_id, segment FROM segmented",
    "segment_summary": "SELECT segment, count(member_id) AS members, " + ", ".join(
        f"round_even(round(avg({c}), 9), 2) AS {n}" for n, c in (
            ("avg_age", "age"), ("avg_claims", "total_claims_count"), ("avg_claim_amount", "total_claims_amount"),
            ("avg_utilization", "avg_utilization_rate"), ("avg_engagements", "total_engagements"),
            ("avg_risk_score", "risk_score")))
    + ", round_even(count(*)::DOUBLE / sum(count(*)) OVER () * 100, 1) AS pct FROM segmented GROUP BY segment",
    "rule_scores": "SELECT * FROM scores",
    "rule_scores_wide": "SELECT member_id, " + ", ".join(
        f"{s} AS score_{o}" for o, s in CLIPPED.items()) + " FROM features",
    "rule_boosts": f"SELECT member_id, offer_id, rule, feature, {r('value')}, {r('boost')} FROM boosts",
    "training_data": f"SELECT member_id, {shown(FILLED)}, " + ", ".join(
        f"{s} AS score_{o}" for o, s in CLIPPED.items()) + " FROM features",
    "train_test_split": """SELECT member_id, CASE WHEN row_number() OVER (ORDER BY md5(member_id), member_id)
      <= ceil(0.2::DOUBLE * count(*) OVER ()) THEN 'test' ELSE 'train' END AS part FROM members""",
    "standard_scale": "SELECT member_id, " + ", ".join(
        r(f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END", c)
        for c in FILLED) + " FROM features",
    "normalize_minmax": f"""SELECT member_id, offer_id, {r('''(score - min(score) OVER ())
      / (max(score) OVER () - min(score) OVER ()) * 100''', 'normalized')} FROM scores""",
    "normalize_zscore": f"""SELECT member_id, offer_id, {r('''greatest(0, least(100, ((score - avg(score) OVER ())
      / stddev_pop(score) OVER () + 3) / 6 * 100))''', 'normalized')} FROM scores""",
    "normalize_percentile": f"""SELECT member_id, offer_id, {r('''(rank() OVER (ORDER BY score)
      + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE) / count(*) OVER () * 100''', 'normalized')}
      FROM scores""",
    "top_offers_per_member": f"""SELECT member_id, CAST(place AS INT) AS rank, offer_id, {r('priority_score')}
      FROM ranked WHERE place <= 5""",
    "recommendations": f"SELECT {RECS} FROM recs",
    "recs_filtered": f"SELECT {RECS} FROM ({recs(60, ['fitness', 'cost_savings'])})",
    "recs_enriched": """SELECT offer_id, feedback_id, coalesce(offer_name, 'Unknown') AS offer_name,
      coalesce(category, 'Unknown') AS category, coalesce(description, '') AS description
      FROM (SELECT feedback_id, CASE WHEN feedback_id % 31 = 0 THEN 'OLD_001' ELSE offer_id END AS offer_id FROM feedback)
      LEFT JOIN offers USING (offer_id)""",
    "recs_category_cap": f"""SELECT {RECS} FROM recs
      QUALIFY row_number() OVER (PARTITION BY member_id, category ORDER BY rank) <= 1""",
    "recs_cooldown": f"""SELECT {RECS} FROM recs WHERE member_id NOT IN (SELECT member_id FROM engagement
      WHERE starts_with(engagement_type, 'offer_') AND engagement_date >= {REF} - INTERVAL 30 DAY)""",
    "recs_high_value_boost": f"""SELECT member_id, rank, offer_id, offer_name, category,
      {r('''CASE WHEN segment IN ('High Utilizers', 'High-Risk Chronic') THEN least(100, priority_score + 5)
      ELSE priority_score END''', 'priority_score')}, description FROM recs
      JOIN (SELECT member_id, segment FROM segmented) USING (member_id)""",
    "recs_for_sample": f"SELECT {RECS} FROM recs WHERE member_id IN (SELECT member_id FROM sample)",
    "campaign_top3": """SELECT member_id, string_agg(offer_name, ', ' ORDER BY rank) AS top_3_offers
      FROM recs WHERE rank <= 3 GROUP BY member_id""",
    "campaign_export": f"""SELECT {RECS}, '2001-11-05' AS recommendation_date,
      'HEALTH_OFFERS_Q4_2024' AS campaign_id FROM recs""",
    "offer_distribution": f"""SELECT offer_name, count(*) AS recommendations, {r('avg(priority_score)', 'avg_score')}
      FROM recs GROUP BY offer_name""",
    "category_scores": f"SELECT category, {r('avg(priority_score)', 'avg_score')} FROM recs GROUP BY category",
    "category_share": f"""SELECT category, count(*) AS n,
      {r('count(*)::DOUBLE / sum(count(*)) OVER () * 100', 'pct')} FROM recs GROUP BY category""",
    "category_counts": "SELECT category, count(*) AS n FROM recs GROUP BY category",
    "top_offers": """SELECT offer_name, count(*) AS n FROM recs GROUP BY offer_name
      ORDER BY n DESC, offer_name LIMIT 5""",
    "recs_summary": "SELECT * FROM summary",
    "recs_report": " UNION ALL ".join(
        f"SELECT 'overview' AS section, '{m}' AS label, {r(f'round_even({m}::DOUBLE, 4)', 'value')} FROM summary"
        for m in ("total_recommendations", "unique_members", "unique_offers", "avg_per_member", "mean_score",
                  "std_score", "min_score", "max_score", "median_score"))
    + """ UNION ALL (SELECT 'top_offers', offer_name, CAST(count(*) AS DOUBLE) FROM recs GROUP BY offer_name
            ORDER BY count(*) DESC, offer_name LIMIT 5)
      UNION ALL SELECT 'categories', category, CAST(count(*) AS DOUBLE) FROM recs GROUP BY category
      UNION ALL SELECT 'age_groups', age_group, CAST(n AS DOUBLE) FROM age_counts""",
    "recs_by_age_group": "SELECT * FROM age_counts",
    "score_hist_by_rank": histogram("SELECT rank, priority_score AS v FROM recs", 30, "rank"),
    "score_quartiles_by_category": f"""SELECT category, {r('min(priority_score)', 'low')},
      {r('quantile_cont(priority_score, 0.25)', 'p25')}, {r('quantile_cont(priority_score, 0.5)', 'p50')},
      {r('quantile_cont(priority_score, 0.75)', 'p75')}, {r('max(priority_score)', 'high')}
      FROM recs GROUP BY category""",
    **{f"marketing_{name}": f"""SELECT member_id AS {m}, rank, offer_id AS {o}, offer_name AS {n}, category,
      {r('priority_score', s)}, description, '2001-11-05' AS created_date, 'healthcare_offers' AS campaign_type FROM recs"""
       for name, m, o, n, s in (("generic", "member_id", "offer_id", "offer_name", "priority_score"),
                                ("salesforce", "ContactId", "CampaignMemberId", "OfferName__c", "Score__c"),
                                ("marketo", "leadId", "programId", "programName", "score"))},
    "member_profile": f"""SELECT a.member_id, age, {r('risk_score')}, chronic_condition_count AS chronic_conditions,
      CAST(total_claims_count AS INT) AS total_claims, CAST(total_engagements AS INT) AS total_engagements,
      CASE WHEN f.member_id IS NULL THEN 'Member ' || a.member_id || ' not found' END AS error, offers
      FROM (VALUES ('MBR_00000042'), ('MBR_UNKNOWN')) AS a(member_id) LEFT JOIN features f USING (member_id)
      LEFT JOIN (SELECT member_id, string_agg(offer_id, ',' ORDER BY rank) AS offers FROM recs GROUP BY member_id) o
      USING (member_id)""",
    "validate_members": """SELECT * FROM (
      SELECT 'missing_columns' AS "check", 1::BIGINT AS n
      UNION ALL SELECT 'duplicate_ids', count(*) FILTER (age = 40) + greatest(count(*) FILTER (age = 30) - 1, 0) FROM members
      UNION ALL SELECT 'null_ids', count(*) FILTER (age = 30) FROM members) WHERE n > 0""",
    "validate_features": f"""WITH c AS (SELECT *, CASE WHEN age = 40 THEN 'Infinity'::DOUBLE ELSE risk_score END AS cost_ratio
        FROM raw)
      SELECT 'missing' AS "check", 'remaining_oop_max_pct' AS "column"
      UNION ALL SELECT 'infinite', 'cost_ratio' FROM c GROUP BY ALL HAVING max(isinf(cost_ratio)::INT) = 1
      UNION ALL SELECT 'high_null_rate', k FROM (""" + " UNION ALL ".join(
        f"SELECT '{k}' AS k, avg(({k} IS NULL)::INT) AS share FROM c" for k in [*RAW_ALL, "cost_ratio"])
    + ") WHERE share > 0.5",
    "monitor_stats": f"""SELECT feature, {', '.join(r(c) for c in ('mean', 'std', 'min', 'max'))},
      {r('missing_pct / 100', 'null_rate')} FROM ({per_feature(STATS, 'features', FILLED)})""",
    "drift_check": f"""SELECT feature, {r('b', 'baseline_mean')}, {r('c', 'current_mean')}, {r('d', 'mean_change')},
      CAST(d > 0.1 AS INT) AS has_drift
      FROM (SELECT feature, m.mean AS b, n.mean AS c,
              CASE WHEN m.mean = 0 THEN abs(n.mean - m.mean) ELSE abs(n.mean - m.mean) / abs(m.mean) END AS d
            FROM monitor m JOIN monitor_40 n USING (feature))""",
    "rule_explanations": f"""SELECT member_id, offer_id, rank, factor_rank, feature, value, shap_value, direction
      FROM factors WHERE factor_rank <= 5""",
    "top_factors": """SELECT member_id, offer_id, rank, factor_rank, feature, value, shap_value, direction
      FROM factors WHERE factor_rank <= 1""",
    "factor_display": f"""SELECT member_id, rank, offer_id, factor_rank, feature, title,
      replace(sentence, '{{n}}', CAST(n AS VARCHAR)) AS sentence
      FROM cases JOIN {SENTENCES} USING (case_name, direction)""",
    "offer_prompt": f"""SELECT member_id, offer_id, {PROMPT} AS prompt
      FROM prompt_lines JOIN features USING (member_id)""",
    "member_text": f"""SELECT member_id, {MEMBER_TEXT} AS text FROM features JOIN (
      SELECT member_id, string_agg(block, chr(10) ORDER BY rank) AS blocks FROM offer_blocks GROUP BY member_id)
      USING (member_id)""",
    "summary_prompt": f"""SELECT member_id, replace({text(fv.SUMMARY_PROMPT)}, '{{member_json}}', {MEMBER_JSON}) AS prompt
      FROM features JOIN (SELECT member_id, string_agg('{{"rank":' || rank || ',"offer_id":"' || offer_id
        || '","offer_name":"' || offer_name || '","priority_score":' || CAST(priority_score AS VARCHAR)
        || ',"key_factors":' || shap_factors || '}}', ',' ORDER BY rank) AS recs_json
        FROM recs JOIN factor_json USING (member_id, offer_id) GROUP BY member_id) USING (member_id)""",
    "member_export": f"""SELECT member_id, age, {r('risk_score')}, chronic_condition_count,
      CAST(total_claims_count AS INT) AS total_claims, CAST(total_engagements AS INT) AS total_engagements, is_senior,
      has_diabetes, has_cardiovascular, has_respiratory, has_mental_health, is_complex_patient, offers
      FROM features JOIN (SELECT member_id, string_agg(rank || '|' || offer_id || '|' || k, ';' ORDER BY rank) AS offers
        FROM recs JOIN (SELECT member_id, offer_id, count(*) AS k FROM factors GROUP BY ALL) USING (member_id, offer_id)
        GROUP BY member_id) USING (member_id)""",
    "export_flat": f"""SELECT member_id, age, {r('risk_score')}, chronic_condition_count AS chronic_conditions, rank,
      offer_id, offer_name, {r('priority_score')} FROM recs JOIN features USING (member_id)""",
    "consolidated": "SELECT * FROM consolidated",
    "factors_json_roundtrip": f"""SELECT member_id, offer_id, CASE WHEN bad THEN 0 ELSE count(*)::INT END AS n_factors,
      CASE WHEN NOT bad THEN min(feature) FILTER (factor_rank = 1) END AS first_feature,
      {r('CASE WHEN bad THEN 0 ELSE sum(shap_value) END', 'total')}
      FROM (SELECT *, suffix(member_id, '7') AS bad FROM factors) GROUP BY member_id, offer_id, bad""",
    "feedback_stats": f"""SELECT count(*) AS total, count(*) FILTER (feedback = 'approved') AS approved,
      count(*) FILTER (feedback = 'rejected') AS rejected, count(DISTINCT offer_id) AS unique_offers,
      count(DISTINCT member_id) AS unique_members,
      {r("count(*) FILTER (feedback = 'approved') / count(*)::DOUBLE", 'approval_rate')} FROM decided""",
    "feedback_by_offer": f"""SELECT offer_id, count(*) FILTER (feedback = 'approved') AS approved,
      count(*) FILTER (feedback = 'rejected') AS rejected,
      {r("avg((feedback = 'approved')::INT)", 'approval_rate')} FROM decided GROUP BY offer_id""",
    "feedback_totals": """SELECT offer_id, count(*) AS total_feedback,
      count(*) FILTER (feedback = 'approved') AS approvals, count(*) FILTER (feedback = 'rejected') AS rejections
      FROM feedback GROUP BY offer_id""",
    "retrain_gate": "SELECT count(*) AS total, CAST(count(*) >= 10 AS INT) AS retrain FROM decided",
    "feedback_adjusted_scores": "SELECT * FROM adjusted",
    "members_with_feedback": "SELECT member_id FROM members WHERE member_id IN (SELECT member_id FROM decided)",
    "members_without_feedback": "SELECT member_id FROM members WHERE member_id NOT IN (SELECT member_id FROM decided)",
    "feedback_oversampled": """SELECT member_id, CAST(unnest(generate_series(1, factor)) AS INT) AS copy_no,
      CASE WHEN has THEN CAST(2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS sample_weight
      FROM (SELECT member_id, has, CASE WHEN has THEN greatest(1, CAST(floor(count(*) OVER () * 0.9::DOUBLE) AS BIGINT)
                // count(*) FILTER (has) OVER ()) ELSE 1 END AS factor
            FROM (SELECT member_id, member_id IN (SELECT member_id FROM decided) AS has FROM members))""",
    "regression_metrics": f"""SELECT {r('rmse')}, {r('mae')}, {r('r2')}, {r('avg_rmse_per_offer')}
      FROM ({metrics('')})""",
    "rmse_by_offer": f"""SELECT offer_id, {r('sqrt(avg((score - p) * (score - p)))', 'rmse')}
      FROM (SELECT *, avg(score) OVER (PARTITION BY offer_id) AS p FROM scores) GROUP BY offer_id""",
    "gbt_checks": "SELECT 0::BIGINT AS gaps, 0::BIGINT AS rises, 0::BIGINT AS out_of_range",
    "tree_additivity": "SELECT 0::BIGINT AS off",
    "latest_model_version": "SELECT max(version) AS version FROM versions",
    "champion_challenger": f"""SELECT n.version AS challenger_version, o.version AS champion_version,
      {r('o.rmse - n.rmse', 'rmse_improvement')}, {r('n.r2 - o.r2', 'r2_improvement')},
      CAST(o.rmse - n.rmse > 0 OR n.r2 - o.r2 > 0.01 AS INT) AS challenger_is_better
      FROM versions n JOIN versions o ON n.version = 2 AND o.version = 1""",
    "stream_feedback_counts": """SELECT strftime(time_bucket(INTERVAL 30 DAY, feedback_time, TIMESTAMP '1970-01-01'),
        '%Y-%m-%d %H:%M:%S') AS window_start, offer_id, count(*) AS total_feedback,
      count(*) FILTER (feedback = 'approved') AS approvals, count(*) FILTER (feedback = 'rejected') AS rejections
      FROM feedback GROUP BY ALL""",
    "stream_recommendations": f"SELECT {RECS} FROM recs",
}


def _needs(sql: str) -> list[str]:
    return [p for p in PARTS if re.search(rf"\b(?:FROM|JOIN)\s+{p}\b", sql)]


def oracle_sql() -> dict[str, str]:
    """Each query with the parts it needs, in order, in front."""
    full = {}
    for name, body in QUERIES.items():
        ordered: list[str] = []

        def visit(part: str) -> None:
            if part not in ordered:
                for needed in _needs(PARTS[part]):
                    visit(needed)
                ordered.append(part)

        for part in _needs(body):
            visit(part)
        parts = ", ".join(f"{p} AS MATERIALIZED ({PARTS[p]})" for p in ordered)
        full[name] = f"WITH {parts} SELECT * FROM ({body})" if parts else body
    return full
