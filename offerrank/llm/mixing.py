"""Mix sources to target weights by Pareto order sampling.

A source's target is its weight's share of all words, at most ``cap`` times
its own size; what lies above is shared again by weight among the others until
none is above. With target T and size A, each document of the source gets
floor(T / A) whole copies for certain. The rest R = T - floor(T / A) * A is a
sample without replacement with inclusion probabilities in proportion to size,
p = min(1, c * size), where c makes the expected words equal to R. Documents
are ranked by ``(u / (1 - u)) / (p / (1 - p))`` with u from a hash of the id
(Rosen's Pareto order) and taken while that brings the words nearer to R, so
the sample's size in words is fixed to within half a document.

Ranking does not move a source into one task: a histogram of ranks finds the
bucket where a source reaches R, and only that bucket is sorted.

Null texts have size 0 and take nothing. A null source is a source of its own,
last in order. Rows with equal ids (or null ids) share u; equal rows are
interchangeable. An empty table gives an empty result; only the named columns
are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offerrank.llm.common import WORD, Scratch, ordered_index, table

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
BUCKETS = 1 << 16


def uniform(id_col: Column, seed: str) -> Column:
    """A number in (0, 1) from the id: 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sources: DataFrame, cap: float, share: float) -> DataFrame:
    """``sources`` (``weight``, ``source_size``) with ``target``; each round is one aggregate over the sources."""
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, capped, room = 0.0, -1, F.col("source_size") * F.lit(cap)
    while total:
        above = F.lit(level) * F.col("weight") >= room
        n, taken, weight = sources.agg(F.count_if(above), F.sum(F.when(above, F.col("source_size")).otherwise(0)),
                                       F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
        if n == capped or not weight:
            break
        capped, level = n, (total - cap * taken) / weight
    return sources.withColumn("target", F.least(room.cast("double"), F.lit(float(level)) * F.col("weight")))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, share: float = 1.0, seed: str = SEED, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id``, ``source``, ``size``, ``source_size``, ``target``, ``copies``, ``taken`` per row of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    sized = scratch.write(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "mix-sizes")
    counts = scratch.write(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-counts")
    sources = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sources = ordered_index(sources, [F.col("source").asc_nulls_last()], scratch, "mix-sources")
    turn = F.array(*map(F.lit, weights))
    sources = targets(sources.withColumn("weight", F.element_at(turn, (F.col("idx") % len(weights) + 1).cast("int"))), cap, share)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    sources = scratch.write(sources.select(F.col("source").alias("s"), "source_size", "target", "whole", "rest"), "mix-targets")

    # c of each source, from its sizes: the largest size that is not certain
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    up = Window.partitionBy("source").orderBy("size")
    squares = F.col("size").cast("double") * F.col("size") * F.col("n")
    level = (counts.filter("size > 0")
             .withColumn("above", F.sum(F.col("size") * F.col("n")).over(down) - F.col("size") * F.col("n"))
             .withColumn("squares", F.sum(squares).over(up))
             .join(sources, F.col("source").eqNullSafe(F.col("s")))
             .withColumn("c", (F.col("rest") - F.col("above")) / F.col("squares"))
             .filter(F.col("c") * F.col("size") <= 1).groupBy("s").agg(F.max_by(F.struct("c", "above"), "size").alias("best")))
    sources = scratch.write(sources.alias("t").join(level.withColumnRenamed("s", "s2"), F.col("s").eqNullSafe(F.col("s2")), "left")
                            .select("t.*", F.coalesce("best.c", F.lit(0.0)).alias("c"),
                                    (F.col("rest") - F.coalesce("best.above", F.lit(0))).alias("ranked_rest")), "mix-levels")

    u, p = uniform(F.col("id"), seed), F.col("c") * F.col("size")
    ranked = (sized.join(sources, F.col("source").eqNullSafe(F.col("s"))).drop("s")
              .withColumn("q", F.when((p > 0) & (p < 1), (u / (1 - u)) / (p / (1 - p))))
              .withColumn("certain", (p >= 1).cast("long"))
              .withColumn("bucket", F.floor(F.col("q") / (1 + F.col("q")) * BUCKETS)))
    ranked = scratch.write(ranked, "mix-ranked")
    sums = (ranked.filter("q is not null").groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("ranked_rest").alias("ranked_rest"))
            .withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")))
    cut = scratch.write(sums.filter("before < ranked_rest and before + words > ranked_rest")
                        .select(F.col("source").alias("s"), F.col("bucket").alias("cut"), "before"), "mix-cuts")
    placed = (ranked.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
              .withColumn("chosen", F.when(F.col("q").isNull(), F.col("certain"))
                          .when(F.col("ranked_rest") <= 0, 0).when(F.col("cut").isNull() | (F.col("bucket") < F.col("cut")), 1)
                          .when(F.col("bucket") > F.col("cut"), 0).cast("long")))
    border = Window.partitionBy("source").orderBy("q", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    last = (placed.filter("chosen is null").withColumn("upto", F.col("before") + F.sum("size").over(border))
            .withColumn("chosen", (F.col("upto") - F.col("size") / 2 <= F.col("ranked_rest")).cast("long")).drop("upto"))
    copies = F.col("whole") + F.col("chosen")
    return placed.filter("chosen is not null").unionByName(last).select(
        "id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER)] AS weight
  FROM sized GROUP BY source),
steps AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS place, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
         coalesce(sum(source_size) OVER before, 0) AS capped, coalesce(sum(weight) OVER before, 0) AS capped_weight
  FROM sources WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT min_by((total - 3 * capped) / (all_weight - capped_weight), place) FILTER
           (WHERE (total - 3 * capped) / (all_weight - capped_weight) * weight < 3 * source_size) AS level
  FROM steps),
targets AS (
  SELECT source, source_size, coalesce(least(CAST(3 * source_size AS DOUBLE), level * weight), 0) AS target
  FROM sources, level),
rests AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole, target - whole * source_size AS rest
  FROM targets),
counts AS (SELECT source, size, count(*) AS n FROM sized WHERE size > 0 GROUP BY source, size),
levels AS (
  SELECT c.source AS source, c.size,
         sum(c.size * n) OVER (PARTITION BY c.source ORDER BY c.size DESC) - c.size * n AS above,
         (rest - above) / sum(CAST(c.size AS DOUBLE) * c.size * n) OVER (PARTITION BY c.source ORDER BY c.size) AS c
  FROM counts c JOIN rests r ON c.source IS NOT DISTINCT FROM r.source),
best AS (SELECT source, max_by(c, size) AS c, CAST(max_by(above, size) AS BIGINT) AS above FROM levels WHERE c * size <= 1 GROUP BY source),
odds AS (
  SELECT d.doc_id, d.source, d.size, source_size, target, whole, rest - coalesce(above, 0) AS rest, coalesce(c, 0) * size AS p,
         (CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN rests r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN best b ON d.source IS NOT DISTINCT FROM b.source),
ranked AS (
  SELECT *, CASE WHEN p > 0 AND p < 1 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM odds),
summed AS (
  SELECT *, sum(CASE WHEN q IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY q NULLS FIRST, doc_id, size
                                                               ROWS UNBOUNDED PRECEDING) AS upto FROM ranked),
chosen AS (
  SELECT *, CAST(whole + CASE WHEN q IS NULL THEN CAST(p >= 1 AS BIGINT) ELSE CAST(upto - size / 2 <= rest AS BIGINT) END AS BIGINT) AS copies
  FROM summed)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, CAST(copies * size AS BIGINT) AS taken, copies FROM chosen
"""
