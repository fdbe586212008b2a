import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from offerrank.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = tokens.TokenCounter(*tokens.read_model(PATH))


def want(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(st.text() | st.text("ab 's\n\t!'1é 　ßЖ漢<|>", max_size=40))
def test_equals_library(text):
    assert COUNTER.count(text) == want(text)


@pytest.mark.parametrize("text", [None, "", " ", "x <|endoftext|> y<|endoftext|><|endoftext|>", "can't  stop\n\n now", "don'T'll"])
def test_special_and_empty(text):
    assert COUNTER.count(text) == want(text)


def test_portions(monkeypatch):
    monkeypatch.setattr(tokens, "PORTION", 7)
    text = "Some words, 12 of them; can't  be\ncut wrongly here " * 9
    assert COUNTER.count(text) == want(text)


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 5)
    counter = tokens.TokenCounter(*tokens.read_model(PATH))
    for k in range(40):
        assert counter.count(f"zqx{k} qqzv{k * 7}") == want(f"zqx{k} qqzv{k * 7}")
    assert len(counter.known) <= len(counter.whole) + 5 + 8


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        tokens.read_model(public_tokenizers.path("word_bpe_49k.json"))


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = tokens.op10(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), want(t), want(t) > 1024)


def test_edge_rows(spark):
    rows = [(1, None, 3), (2, "", 3), (3, "a" * 300_000, 3), (3, "a b", 4), (3, "a b", 4), (None, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(((r.id, r.n_bytes, r.n_tokens) for r in tokens.token_counts(docs, PATH).collect()), key=str)
    assert got == sorted(((i, len((t or "").encode()), want(t)) for i, t, _ in rows), key=str)
    assert tokens.token_counts(docs.limit(0), PATH).count() == 0
