import random

from compare import connect, difference
from offerrank.llm import licences


def test_equals_sql(spark, sf):
    assert difference(licences.op2(spark, sf), licences.sql(), connect(sf)) is None


def scan(spark, texts):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id int, text string, digest string, notices int")
    return [(r.license_id, r.notices) for r in licences.scan(docs).orderBy("id").collect()]


def test_equivalent_texts(spark):
    mit = licences.MIT
    texts = ["MIT Licence\n\nCopyright (c) 2019 A. Person\nCOPYRIGHT 2020 B.\n© C\n" + mit.upper(), mit.replace("\n", "  \n\t "), mit.replace('"', "”").replace("sublicense", "sub-licence"),
             licences.BSD_HEAD + licences.BSD_NAMES.replace("holder", "owner") + licences.BSD_TAIL, licences.ZLIB, licences.ISC.replace(",", " ;"), mit + " Really.",
             "Some text.\n * Released under the MIT licence.\nMore\nLicensed under CC-BY-NC 4.0"]
    assert scan(spark, texts) == [("MIT", None), ("MIT", None), ("MIT", None), ("BSD-3-Clause", None), ("Zlib", None), ("ISC", None), (None, None),
                                  (None, "CC-BY-NC-4.0,MIT")]


def test_edges(spark):
    texts = [None, "", " .;\n", "Copyright (c) 2020 X", "w " * 200_000, "a\r\nb"]
    assert scan(spark, texts) == [(None, None)] * 6
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "A, B!")], "doc_id long, text string")
    got = licences.scan(docs).collect()
    assert len(got) == 3 and len({r.digest for r in got}) == 1
    assert licences.scan(docs.limit(0)).count() == 0


def test_long_licences_differ(spark):
    ids = {r.license_id for r in licences.known_digests(spark).collect()}
    assert {"0BSD", "ISC", "BSD-2-Clause", "BSD-3-Clause"} <= ids


def test_list_items_are_no_copyright_lines(spark):
    apache = next(t for n, t in licences.all_known() if n == "Apache-2.0" and "APPENDIX" in t)
    cut = "\n".join(line for line in apache.split("\n") if not line.strip().startswith("(c) You must retain"))
    filled = apache.replace("[yyyy] [name of copyright owner]", "2021 Some Person")
    assert apache != cut and apache != filled
    assert scan(spark, [apache, cut, filled, "(c) You must keep it.", "(c) 2020 X"]) == [("Apache-2.0", None), (None, None), ("Apache-2.0", None), (None, None), (None, None)]
    docs = spark.createDataFrame([(1, "(c) You must keep it."), (2, "(C) 2020 X\nAll Rights Reserved.")], "doc_id long, text string")
    assert [r.digest is None for r in licences.scan(docs).orderBy("id").collect()] == [False, True]


def test_licences_planted_among_documents(spark, sf, tmp_path):
    """Every known text, restyled, is found among the documents; altered by one word it is not. The SQL agrees."""
    rng, rows, want = random.Random(5), [], {}
    for k, (name, text) in enumerate(licences.all_known()):
        lines = text.split("\n")
        if len(lines) > 3:
            lines.insert(0, "Copyright (C) 2011-2020 Some Person")
        styled = "\n".join(rng.choice(["", "  ", " * ", "# "]) + line.replace('"', rng.choice(["“", '"'])) for line in lines)
        rows.append((10**6 + 2 * k, styled.upper() if k % 3 == 0 else styled))
        want[10**6 + 2 * k] = name
        at = text.rindex(" ")
        rows.append((10**6 + 2 * k + 1, text[:at] + " never" + text[at:]))
        want[10**6 + 2 * k + 1] = None
    path = str(tmp_path / "planted")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string")).coalesce(1).write.parquet(f"{path}/documents")
    table = spark.read.parquet(f"{path}/documents")
    got = licences.scan(table).withColumnRenamed("id", "doc_id")
    found = {r.doc_id: r.license_id for r in got.collect()}
    assert {i: found[i] for i in want} == want
    con = connect(sf)
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{path}/documents/*.parquet'")
    assert difference(got, licences.sql(), con) is None


def test_no_python(spark, sf):
    plan = licences.op2(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
