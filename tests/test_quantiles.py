import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerrank.operators.encode import LabelEncoder
from offerrank.operators.quantiles import average_ranks, exact_quantiles, first_by_hash, numbered_ranges


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_quantiles_match_sorting(spark, limit):
    rng = np.random.default_rng(1)
    data = {"uniform": rng.uniform(-5, 5, 999), "ties": rng.integers(0, 4, 999).astype(float),
            "heavy": np.exp(rng.normal(0, 6, 999)) * rng.choice([-1, 1], 999), "narrow": 60 + rng.uniform(0, 1e-6, 999)}
    rows = [tuple(float(v) for v in r) for r in zip(*data.values())] + [(None,) * 4, (float("nan"),) * 4]
    df = spark.createDataFrame(rows, ", ".join(f"{c} DOUBLE" for c in data)).repartition(7)
    probs = [0.0, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {(r["column"], r["prob"]): r["value"]
           for r in exact_quantiles(df, list(data), probs, rows_per_bucket=limit).collect()}
    for name, x in data.items():
        for p in probs:
            assert got[name, p] == pytest.approx(np.quantile(x, p), rel=1e-12, abs=1e-12)


def test_quantiles_by_group(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("a", 10), ("b", 7)], "g STRING, x INT")
    got = {r["g"]: r["value"] for r in exact_quantiles(df, ["x"], [0.75], ["g"]).collect()}
    assert got == {"a": 5.5, "b": 7.0}


def test_average_ranks(spark):
    x = [3.0, 1.0, 3.0, -2.0, 0.0, 3.0, None, float("inf"), float("-inf")]
    got = {r["x"]: r["average_rank"] for r in average_ranks(
        spark.createDataFrame([(v,) for v in x], "x DOUBLE"), "x").collect()}
    assert got == {float("-inf"): 1.0, -2.0: 2.0, 0.0: 3.0, 1.0: 4.0, 3.0: 6.0, float("inf"): 8.0}


def test_average_ranks_of_narrow_and_wide_values(spark):
    rng = np.random.default_rng(2)
    x = np.r_[60 + rng.uniform(0, 1e-7, 300), np.exp(rng.normal(0, 9, 300)) * rng.choice([-1, 1], 300)]
    df = spark.createDataFrame([(float(v),) for v in x], "x DOUBLE").repartition(5)
    got = {r["x"]: r["average_rank"] for r in average_ranks(df, "x").collect()}
    assert [got[v] for v in sorted(x)] == list(range(1, 601))


def test_a_million_values_next_to_an_outlier(spark):
    df = spark.range(1_000_000).select((60 + F.col("id") * 1e-9).alias("x")).union(spark.sql("SELECT 1e300D AS x"))
    plans = []
    ranks = average_ranks(df, "x")
    counted = df.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    plans.append(numbered_ranges(counted, ["x"], "n")._jdf.queryExecution().optimizedPlan().toString())
    assert "windowspecdefinition(_range" in plans[0]
    got = ranks.agg(F.count("*"), F.min("average_rank"), F.max("average_rank"), F.sum("average_rank"), F.count_if(F.col("total") != 1_000_001)).first()
    assert tuple(got) == (1_000_001, 1.0, 1_000_001.0, 1_000_001 * 1_000_002 / 2, 0)
    assert ranks.where("x = 1e300D").first().average_rank == 1_000_001
    late = ranks.where("x > 60.0005").agg(F.min("average_rank")).first()[0]
    assert late in (500_001.0, 500_002.0)


def test_a_million_labels(spark):
    df = spark.range(1_000_000).select(F.format_string("v%07d", (F.col("id") * 7) % 1_000_000).alias("many"), (F.col("id") % 3).cast("string").alias("few"))
    codes = LabelEncoder.fit(df, ["many", "few"]).codes
    assert codes.where("column = 'few'").orderBy("value").select("value", "code").collect() == [("0", 0), ("1", 1), ("2", 2)]
    wrong = codes.where("column = 'many' AND code <> CAST(substring(value, 2) AS INT)")
    assert wrong.isEmpty() and codes.where("column = 'many'").count() == 1_000_000


@pytest.mark.parametrize("n", [1, 5, 1000])
def test_hash_split_is_exact_and_independent_of_partitions(spark, n):
    ids = [f"M{i}" for i in range(n)]
    df = spark.createDataFrame([(i,) for i in ids], "member_id STRING")
    first = sorted(ids, key=lambda i: hashlib.md5(f"s{i}".encode()).hexdigest())[:math.ceil(0.2 * n)]
    for parts in (1, 9):
        marked = first_by_hash(df.repartition(parts), "member_id", 0.2, "s")
        assert {r["member_id"] for r in marked.where("is_first").collect()} == set(first)


@pytest.mark.parametrize("known,nulls,want", [(80, 20, 20), (90, 10, 20), (5, 95, 5), (0, 10, 0)])
def test_hash_split_puts_missing_keys_last(spark, known, nulls, want):
    df = spark.createDataFrame([(f"M{i}",) for i in range(known)] + [(None,)] * nulls, "member_id STRING")
    marked = first_by_hash(df, "member_id", 0.2, "s").where("is_first").collect()
    assert len(marked) == want and all(r.member_id is not None for r in marked)
    assert first_by_hash(df, "member_id", 1.0).where("is_first").count() == known + nulls


def test_hash_split_of_repeated_keys(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4000, "hot").otherwise(F.col("id").cast("string")).alias("member_id"))
    marked = first_by_hash(df, "member_id", 0.3).where("is_first")
    assert marked.count() in range(1500, 1500 + 4000) and marked.where("member_id = 'hot'").count() in (0, 4000)


def test_a_value_meets_its_bucket_once(spark):
    """However many quantiles are asked for: joined by bucket, and the quantiles only after values are counted."""
    df = spark.range(5000).select((F.col("id") % 3).cast("double").alias("few"), F.sqrt("id").alias("many"))
    wanted = exact_quantiles(df, ["few", "many"], [k / 64 for k in range(1, 64)])
    plan = wanted._jdf.queryExecution().optimizedPlan().toString()
    first = [line for line in plan.splitlines() if "Join Inner" in line][-1]
    assert "_bucket" in first and "prob" not in first.split("Join Inner")[0]
    assert "Aggregate" in plan and plan.count("Join Inner") == 2
    got = {(r["column"], r["prob"]): r["value"] for r in wanted.collect()}
    for k in range(1, 64):
        assert got["few", k / 64] == np.quantile(np.arange(5000) % 3, k / 64)
        assert got["many", k / 64] == pytest.approx(np.quantile(np.sqrt(np.arange(5000)), k / 64), rel=1e-12)
