"""Compare a Spark result with a DuckDB result: names, types and values."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def kind(dtype) -> str:
    return {"i": "int", "u": "int", "f": "float", "b": "bool"}.get(getattr(dtype, "kind", "O"), "text")


def difference(spark_df, sql: str, con) -> str | None:
    """None when equal, else what differs."""
    got = spark_df.toArrow().to_pandas(integer_object_nulls=True)
    relation = con.sql(sql)
    types = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    duck = dict(zip(relation.columns, (types.get(str(t), str(t)) for t in relation.types)))
    spark_types = dict(spark_df.dtypes)
    if set(duck) != set(spark_types):
        return f"columns {sorted(set(duck) ^ set(spark_types))}"
    wrong = {c: (spark_types[c], duck[c]) for c in duck if duck[c] != spark_types[c]}
    if wrong:
        return f"types (spark, duckdb) {dict(list(wrong.items())[:5])}"
    want = relation.arrow().read_all().to_pandas(integer_object_nulls=True)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    names = sorted(got.columns)
    rows = [sorted(map(tuple, df[names].astype(object).where(df[names].notna(), None).itertuples(index=False)),
                   key=lambda t: tuple((v is None, str(v)) for v in t)) for df in (got, want)]
    bad = [(a, b) for a, b in zip(*rows) if a != b]
    if not bad:
        return None
    a, b = bad[0]
    cells = [(n, x, y) for n, x, y in zip(names, a, b) if x != y]
    return f"{len(bad)} of {len(got)} rows, first {cells[:4]}"
