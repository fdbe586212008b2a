"""Exact token counts with a whole-token shortcut.

Offline, once per vocabulary, every vocabulary string is encoded alone by the
library; those that come back as one token are proven whole. A byte-level BPE
never merges across pre-tokens, so a pre-token that is proven whole counts one
wherever it stands. Only the others are merged, each distinct one once.

Texts of Latin letters are cut into pre-tokens by a pattern here; texts with
other characters by the library, so that both follow its tables of letters.
A cut text never depends on the rest: very long texts are cut in portions at
a space between two letters, where a pre-token always begins.

Null texts count as empty (0 tokens), empty tables give empty results,
repeated rows each come back. Only the named columns are read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerrank.llm.common import in_batches, table

PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Up to U+024F the tables of letters, digits and spaces have not changed for decades.
LATIN = regex.compile("[\\x00-ɏ]*")
BETWEEN_WORDS = regex.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
PORTION = 1 << 20
CACHED = 1 << 18


def byte_letters() -> dict[str, int]:
    """The letters with which a byte-level vocabulary writes bytes: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_model(path: str) -> tuple[str, list[str]]:
    """The tokenizer's JSON and its special strings; refuses models that are not plain byte-level BPE."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    model = json.loads(text)
    cut = model.get("pre_tokenizer") or {}
    if model["model"]["type"] != "BPE" or model.get("normalizer") or cut.get("type") != "ByteLevel" \
            or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        raise ValueError(f"{path} is not a byte-level BPE without normaliser and prefix space")
    added = model.get("added_tokens", [])
    if any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word", "normalized")):
        raise ValueError(f"{path} has added tokens that take in what stands around them")
    return text, sorted((t["content"] for t in added), key=len, reverse=True)


class TokenCounter:
    """Counts tokens as the library does."""

    def __init__(self, model: str, special: list[str], whole: list[str] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.letters = byte_letters()
        self.whole = self.proven() if whole is None else whole
        self.known = dict.fromkeys(self.whole, 1)

    def proven(self) -> list[str]:
        """Vocabulary strings that the library encodes alone as one token."""
        strings = []
        for token in self.library.get_vocab(with_added_tokens=False):
            try:
                strings.append(self.plain(token))
            except (KeyError, UnicodeDecodeError):
                continue  # part of a character
        encoded = self.library.encode_batch(strings, add_special_tokens=False)
        return [s for s, e in zip(strings, encoded) if s and len(e.ids) == 1]

    def plain(self, piece: str) -> str:
        return bytes(self.letters[c] for c in piece).decode()

    def pretokens(self, text: str) -> Iterator[list[str]]:
        if not LATIN.fullmatch(text):
            yield [self.plain(p) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
            return
        at = 0
        while len(text) - at > PORTION and (m := BETWEEN_WORDS.search(text, at + PORTION)):
            yield PRETOKEN.findall(text[at:m.start()])
            at = m.start()
        yield PRETOKEN.findall(text[at:])

    def ordinary(self, text: str) -> int:
        n = 0
        for pieces in self.pretokens(text):
            new = [p for p in set(pieces) if p not in self.known]
            if new:
                if len(self.known) > len(self.whole) + CACHED:
                    self.known = dict.fromkeys(self.whole, 1)
                    new = [p for p in set(pieces) if p not in self.known]
                encoded = self.library.encode_batch(new, add_special_tokens=False)
                self.known.update((p, len(e.ids)) for p, e in zip(new, encoded))
            n += sum(map(self.known.__getitem__, pieces))
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self.ordinary(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.ordinary(p) for p in parts if p)


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_bytes``, ``n_tokens`` per row. The model's file is read by the driver and sent to the tasks once."""
    model, special = read_model(model_path)
    whole = TokenCounter(model, special).whole
    sent = docs.sparkSession.sparkContext.broadcast((model, special, whole))  # as large as the vocabulary

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(*sent.value)
        for b in batches:
            text = b.column(1)
            size = pc.fill_null(pc.cast(pc.binary_length(text), pa.int64()), 0)
            counts = pa.array([counter.count(t.as_py()) for t in text], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, counts], ["id", "n_bytes", "n_tokens"])

    return in_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), work,
                      "id long, n_bytes long, n_tokens long")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
