"""Toxicity by a convolutional text classifier, trained here in numpy.

Words (runs of letters, digits and whatever is beyond ASCII, in lower case)
and their first four and six characters are hashed to rows of an embedding
table, whose sum is the word's vector: inflected forms share their stem's row.
Filters of several widths slide over the word vectors, each keeps its largest
response over the whole text, and a logistic unit weighs them. One dimension of the table begins at the row's
smoothed log odds of standing in a toxic text, the rest near zero. Training is AdaGrad, one document at a time, in a
fixed order, ``UPDATES`` updates at any size, on at most ``max_rows`` labelled rows of each class (those with
the smallest hash of the id; of these, rows that fit a class's half of ``MAX_BYTES``). A class that is cut more than
the other would shift all scores, so the logit is set back by the classes' shares among all training labels. Max
pooling sends the gradient to one window per filter, so a long text costs a forward pass and a few rows.

Texts are scored whole, in portions of bounded size, however long they are.

Ids whose ``crc32 % 4`` is 2 are held out. Of the others, ``crc32 // 4 % 8``
of 0 serves for thresholds only. The threshold of a language is the one with the
best F1 on its rows; languages with few toxic rows, or none, take the one of
all rows. Neither labels nor language, source or id enter a score.

Null and empty texts have no words and get the score of an empty text. Rows
with a null id count as not held out. Repeated rows each come back; labels of
the same id count once (toxic if any is). An empty table gives an empty
result; without labels of both classes every score is the share of toxic rows.
Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offerrank.llm.common import Scratch, in_batches, table

ROWS_BITS = 15
DIM, FILTERS, WIDTHS = 12, 8, (1, 2, 3)
UPDATES = 40_000
ODDS = 0.3
RATE = 0.1
NOISE = 0.02
MAX_ROWS = 3000
MAX_BYTES = 512 << 20  # of word rows on the driver
CUT = 0.3
MIN_TOXIC = 10
CHUNK = 1 << 18
PORTION = 1 << 14
STEMS = (4, 6)
BASE = 0x9E3779B97F4A7C15 | 1

LETTERS = np.zeros(256, np.uint64)
LETTERS[128:] = np.arange(128, 256)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    LETTERS[_c] = _c


def powers(base: int) -> np.ndarray:
    out = np.full(CHUNK + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWERS, INVERSES = powers(BASE), powers(pow(BASE, -1, 1 << 64))


def word_rows(text: str | None) -> np.ndarray:
    """The embedding rows of each word: its own and those of its beginnings of ``STEMS`` characters."""
    data, found, at = np.frombuffer((text or "").lower().encode(), np.uint8), [], 0
    while at < len(data):
        part = LETTERS[data[at:at + CHUNK]]
        if at + CHUNK < len(data) and len(gaps := np.flatnonzero(part == 0)):
            part = part[:gaps[-1] + 1]
        first = data[at:at + len(part)] & 0xC0 != 0x80  # first bytes of characters
        at += len(part)
        edges = np.flatnonzero(np.diff(np.r_[False, part > 0, False]))
        start, end = edges[::2], edges[1::2]
        chars, place = np.r_[np.flatnonzero(first), len(part)], np.cumsum(first) - 1
        sums = np.r_[np.uint64(0), np.cumsum(part * POWERS[:len(part)])]
        rows = []
        for k, n in enumerate((None, *STEMS)):
            stop = end if n is None else np.minimum(end, chars[np.minimum(place[start] + n, len(chars) - 1)])
            h = (sums[stop] - sums[start]) * INVERSES[start] + np.uint64(k)
            h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ h >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
            rows.append((h >> np.uint64(64 - ROWS_BITS)).astype(np.int32) + 1)
        found.append(np.stack(rows, 1))
    return np.concatenate(found) if found else np.zeros((0, 1 + len(STEMS)), np.int32)


def padded(rows: np.ndarray) -> np.ndarray:
    """Row 0 after the last word, so that the widest filter begins at every word."""
    short = max(WIDTHS) - 1 + (len(rows) == 0)
    return np.r_[rows, np.zeros((short, rows.shape[1]), np.int32)]


def vectors(emb: np.ndarray, rows: np.ndarray) -> np.ndarray:
    x = emb[rows[:, 0]]
    for k in range(1, rows.shape[1]):
        x += emb[rows[:, k]]
    return x


def convolve(x: np.ndarray, filters: list[np.ndarray], k: int) -> np.ndarray:
    n = len(x) - len(filters) + 1
    conv = x[:n] @ filters[k][0]
    for j in range(1, k + 1):
        conv += x[j:n + j] @ filters[k][j]
    return conv


@dataclass
class Model:
    emb: np.ndarray
    filters: list[np.ndarray]  # of 1, 2, ... words: (word of the window, dimension, filter)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float

    def score(self, rows: np.ndarray) -> float:
        """Portions of bounded size overlap by one window, so the maxima are those of the whole text."""
        widest, rows = len(self.filters), padded(rows)
        best = np.full(self.bias.shape, -np.inf, np.float32)
        for at in range(0, len(rows) - widest + 1, PORTION):
            x = vectors(self.emb, rows[at:at + PORTION + widest - 1])
            for k in range(widest):
                best[k] = np.maximum(best[k], convolve(x, self.filters, k).max(0))
        z = float((np.maximum(best + self.bias, 0) * self.out).sum() + self.out_bias)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def log_odds(texts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Per row, the smoothed log odds of being in a toxic text, in standard errors."""
    hits = np.zeros((2, (1 << ROWS_BITS) + 1))
    for rows, mark in zip(texts, labels):
        hits[mark, np.unique(rows)] += 1
    n = np.bincount(labels, minlength=2)[:, None]
    odds = np.log((hits + 0.5) / (n - hits + 0.5))
    z = (odds[1] - odds[0]) / np.sqrt((1 / (hits + 0.5)).sum(0))
    z[hits.sum(0) == 0] = z[0] = 0
    return z.astype(np.float32)


def train(texts: list[np.ndarray], labels: list[int], epochs: int | None = None, seed: int = 7) -> Model:
    """Fit embeddings, filters and the logistic unit by AdaGrad, in ``UPDATES`` updates or in whole passes."""
    rng = np.random.default_rng(seed)
    widest = len(WIDTHS)
    emb = rng.normal(0, NOISE, ((1 << ROWS_BITS) + 1, DIM)).astype(np.float32)
    emb[0] = 0
    filters = [rng.normal(0, 0.3, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
    bias, out = np.zeros((widest, FILTERS), np.float32), rng.normal(0, 0.3, (widest, FILTERS)).astype(np.float32)
    share = min(max(sum(labels) / max(1, len(labels)), 1e-3), 1 - 1e-3)
    out_bias = np.float32(np.log(share / (1 - share)))
    if 0 < sum(labels) < len(labels):
        emb[:, 0] = ODDS * log_odds(texts, np.array(labels))
        filters[0][0, :, 0], out[0, 0] = np.eye(DIM)[0], 1
        left = epochs * len(texts) if epochs else UPDATES
        past = {"emb": np.full_like(emb, 1e-2), "bias": np.full_like(bias, 1e-2), "out": np.full_like(out, 1e-2), "out_bias": 1e-2}
        past_f = [np.full_like(f, 1e-2) for f in filters]
        rate = RATE
        while left > 0:
            turn = rng.permutation(len(texts))[:left]
            left -= len(turn)
            for d in turn:
                rows = padded(texts[d])
                x = vectors(emb, rows)
                pooled, where = np.empty_like(bias), []
                for k in range(widest):
                    conv = convolve(x, filters, k)
                    at = conv.argmax(0)
                    where.append(at)
                    pooled[k] = conv[at, np.arange(FILTERS)] + bias[k]
                hidden = np.maximum(pooled, 0)
                p = 1 / (1 + np.exp(-np.clip((hidden * out).sum() + out_bias, -30, 30)))
                g = np.float32(p - labels[d])
                if abs(g) < 1e-3:
                    continue
                g_out, g_hidden = g * hidden, g * out * (pooled > 0)
                for k, f in enumerate(filters):
                    for j in range(k + 1):
                        at = where[k] + j
                        g_rows = (g_hidden[k][:, None] * f[j].T)
                        g_f = x[at].T * g_hidden[k]
                        past_f[k][j] += g_f * g_f
                        f[j] -= rate * g_f / np.sqrt(past_f[k][j])
                        touched, g_rows = rows[at].ravel(), np.repeat(g_rows, rows.shape[1], axis=0)
                        np.add.at(past["emb"], touched, g_rows * g_rows)
                        np.add.at(emb, touched, -rate * g_rows / np.sqrt(past["emb"][touched]))
                emb[0] = 0
                past["bias"] += g_hidden * g_hidden
                bias -= rate * g_hidden / np.sqrt(past["bias"])
                past["out"] += g_out * g_out
                out -= rate * g_out / np.sqrt(past["out"])
                past["out_bias"] += g * g
                out_bias -= rate * g / np.sqrt(past["out_bias"])
    else:
        out[:] = 0
    return Model(emb, filters, bias, out, float(out_bias))


def row_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [word_rows(t.as_py()).tobytes() for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], ["id", "words"])


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def for_thresholds(id_col: Column) -> Column:
    """An eighth of the rows, apart from the division into held out or not."""
    return F.coalesce(F.floor(F.crc32(id_col.cast("string")) / 4) % 8 == 0, F.lit(False))


def fitting(sizes: list[tuple], most: int) -> list:
    """The ids, in the order given, of rows whose word rows fit ``most`` bytes together; rows that do not fit are passed over."""
    taken, out = 0, []
    for i, octets in sizes:
        need = 4 * (1 + len(STEMS)) * (octets // 2 + 1)  # a word and its gap have two bytes at least
        if taken + need <= most:
            taken += need
            out.append(i)
    return out


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", max_bytes: int = MAX_BYTES) -> Model:
    """Train on at most ``max_rows`` labelled ids of each class, chosen by hash, whose word rows fit ``max_bytes``; what comes to the driver is bounded by these.

    The ids are chosen before any text is moved, and as many as the bound are
    broadcast. Scores follow the share of toxic rows among all training labels.
    """
    known = (labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
             .filter(~held_out(F.col("id")) & ~for_thresholds(F.col("id"))).join(docs.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi"))
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    texts, marks = [], []
    for mark in (1, 0):
        some = F.broadcast(known.filter(F.col("toxic") == mark).orderBy(F.xxhash64("id"), "id").limit(max_rows))
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(some, "id").groupBy("id").agg(F.min("text").alias("text"))
        sizes = rows.select("id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("octets"), F.xxhash64("id").alias("h")).collect()
        sizes = [(r["id"], r["octets"]) for r in sorted(sizes, key=lambda r: (r["h"], r["id"]))]
        chosen = fitting(sizes, max_bytes // 2)
        if len(chosen) < len(sizes):
            rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in chosen], rows.select("id").schema)), "id")
        found = in_batches(rows, row_batches, "id long, words binary").collect()
        for r in sorted(found, key=lambda r: r["id"]):
            texts.append(np.frombuffer(bytes(r["words"]), np.int32).reshape(-1, 1 + len(STEMS)))
            marks.append(mark)
    model = train(texts, marks)
    if 0 < sum(marks) < len(marks):
        model.out_bias += float(np.log(total[1] / total[0]) - np.log(sum(marks) / (len(marks) - sum(marks))))
    return model


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id``, ``lang``, ``score`` per row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sent.value.score(word_rows(t.as_py())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.float64())], ["id", "lang", "score"])

    return in_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), work,
                      "id long, lang string, score double")


def thresholds(scored: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", min_toxic: int = MIN_TOXIC) -> DataFrame:
    """``lang``, ``threshold`` with the best F1 on rows not trained on; a null language stands for all rows."""
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    rows = scored.join(known.filter(~held_out(F.col("id")) & for_thresholds(F.col("id"))), "id")
    steps = rows.groupBy("lang", F.floor(F.col("score") * 1000).alias("step")).agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n"))
    steps = steps.filter("lang is not null").unionByName(
        steps.groupBy("step").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).withColumn("lang", F.lit(None).cast("string")))
    down = Window.partitionBy("lang").orderBy(F.desc("step"))
    hit, taken, total = F.sum("toxic").over(down), F.sum("n").over(down), F.sum("toxic").over(Window.partitionBy("lang"))
    f1 = steps.withColumn("total", total).withColumn("f1", 2.0 * hit / (taken + total)).filter("total > 0")
    return (f1.groupBy("lang").agg(F.max_by(F.col("step") / 1000, F.struct("f1", "step")).alias("threshold"), F.max("total").alias("total"))
            .filter((F.col("total") >= min_toxic) | F.col("lang").isNull()).select("lang", "threshold"))


def classify(docs: DataFrame, labels: DataFrame, model: Model | None = None, cut: float = CUT, id_col: str = "doc_id",
             text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> DataFrame:
    """``id``, ``held_out``, ``score``, ``predicted`` (by ``cut``), ``threshold``, ``flagged`` (by the language's threshold)."""
    scratch = Scratch(docs.sparkSession)
    model = model or fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)
    scored = scratch.write(scores(docs, model, id_col, text_col, lang_col), "toxicity-scores")
    cuts = scratch.write(thresholds(scored, labels, id_col, label_col), "toxicity-thresholds")
    common = (cuts.filter("lang is null").agg(F.first("threshold")).first() or [None])[0]
    own = cuts.filter("lang is not null").withColumnRenamed("lang", "of")
    threshold = F.coalesce("threshold", F.lit(common).cast("double"), F.lit(cut))
    return (scored.join(own, F.col("lang") == F.col("of"), "left").withColumn("threshold", threshold)
            .select("id", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"),
                    "threshold", (F.col("score") >= F.col("threshold")).alias("flagged")))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")
