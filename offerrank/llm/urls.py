"""URL filter with a weighted vocabulary and host rules.

An Aho-Corasick automaton finds all terms in the lower-cased URL in one pass,
overlapping ones included. A term counts only with boundaries: the characters
before and after it are no ASCII letters or digits. One strict term or
``min_soft`` different soft terms block the URL. A rule ``(action, host,
path)`` for the host or a parent domain and the beginning of the path decides
instead; the longest rule that fits wins, and of equally long ones the last in the list.

Null URLs and those without ``://`` have an empty host and path; a null one is
allowed. Repeated rows each come back. An empty table gives an empty result;
only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerrank.llm.common import in_batches, table

STRICT = ("porn", "xxx", "viagra", "cialis", "casino", "cheap-pills", "adult-x", "escorts", "hentai", "warez")
SOFT = ("adult", "ads", "bet", "bets", "bonus", "cheap", "click", "farm", "free", "jackpot", "loan", "loans", "pills", "poker",
        "sexy", "spam", "track", "win", "winner")
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MIN_SOFT = 2


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple) -> Column:
    """``(action, rule)`` of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<action:string,rule:string>")
    for action, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(domain + start).alias("rule"))).otherwise(found)
    return found


def bounded_hits(automaton, url: str) -> set[str]:
    def edge(k: int) -> bool:
        return not 0 <= k < len(url) or not (url[k].isascii() and url[k].isalnum())

    return {term for end, term in automaton.iter(url) if edge(end - len(term)) and edge(end + 1)}


def hit_batches(strict: tuple, soft: tuple):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton, strict_terms = ahocorasick.Automaton(), frozenset(strict)
        for term in {*strict, *soft}:
            automaton.add_word(term, term)
        automaton.make_automaton()
        for b in batches:
            hits = [bounded_hits(automaton, (u.as_py() or "").encode().lower().decode()) for u in b.column(1)]
            n_strict = [len(h & strict_terms) for h in hits]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n_strict, pa.int64()),
                 pa.array([len(h) - n for h, n in zip(hits, n_strict)], pa.int64())], ["id", "url", "strict_hits", "soft_hits"])
    return work


def judge(pages: DataFrame, strict: tuple = STRICT, soft: tuple = SOFT, rules: tuple = RULES, min_soft: int = MIN_SOFT,
          id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id``, ``host``, ``path``, ``rule``, ``verdict``, ``strict_hits``, ``soft_hits`` per row."""
    if not strict and not soft or set(strict) & set(soft):
        raise ValueError("the vocabulary needs terms, and a term is either strict or soft")
    counted = in_batches(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")), hit_batches(strict, soft),
                         "id long, url string, strict_hits long, soft_hits long")
    own = F.when((F.col("strict_hits") > 0) | (F.col("soft_hits") >= min_soft), "block").otherwise("allow")
    return (counted.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
            .withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
            .select("id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.action", own).alias("verdict"),
                    "strict_hits", "soft_hits"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def hits_sql(terms: tuple) -> str:
    return " + ".join(f"CAST(regexp_matches(lower(coalesce(url, '')), '(^|[^a-z0-9]){t}($|[^a-z0-9])') AS BIGINT)" for t in terms)


SQL = f"""
WITH cut AS (
  SELECT page_id, url, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1) AS raw_host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
         {hits_sql(STRICT)} AS strict_hits, {hits_sql(SOFT)} AS soft_hits
  FROM pages),
hosted AS (SELECT *, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM cut),
fitted AS (
  SELECT *, CASE WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
                 WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
                 WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
                 WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule
  FROM hosted)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN strict_hits > 0 OR soft_hits >= 2 THEN 'block' ELSE 'allow' END AS verdict, strict_hits, soft_hits
FROM fitted
"""
