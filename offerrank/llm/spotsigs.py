"""Document fingerprints from spot signatures.

Wherever a common word (an anchor) stands, the ``CHAIN`` next content words
within ``REACH`` words form a signature with it; words of the stop list are
skipped. The set of a text's signatures (hashed to 32 bits, sorted) is its
fingerprint.

Anchors are words of four languages, and texts in other languages, lists or
code hold few of them. So every text also gets the ``ALWAYS`` least hashes of
its chains of two neighbouring words; one with fewer than ``FEW`` anchored
signatures gets ``SPARE`` of them, and, if it also has fewer than ``SHORT``
words (or is written without spaces), as many of its chains of four characters.
Which chains are taken depends on their content alone, so they survive edits
elsewhere in the text. A text without any chain has one signature made of all
of it; equal texts have equal fingerprints and empty ones are alike. Words
repeated over and over are one chain: what they share with another text is
then one signature, or none.

``near_pairs`` compares whole collections: sets are classed by length so that
only neighbouring classes can reach the wanted Jaccard, only the rarest
signatures of a set are looked up (the prefix that two similar sets must
share), lengths are checked before the sets, and equal sets are one class.

Null texts count as empty. Rows with equal ids follow each other in the order
of their texts, null ids come last. Repeated rows each come back. An empty
table gives an empty result; only the two named columns are read. Everything
is built from column functions; no Python runs in tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offerrank.llm.common import Scratch, table

#: Common words that begin a signature.
ANCHORS = ("the", "is", "was", "that", "are", "with", "der", "die", "das", "ist", "mit", "den", "le", "les", "est", "une", "que", "dans",
           "el", "los", "es", "del", "una", "con")
#: Common words that no chain contains; anchors are among them.
STOP = ANCHORS + ("a", "an", "and", "as", "at", "be", "by", "for", "from", "had", "has", "have", "he", "his", "i", "in", "it", "not", "of", "on", "or",
                  "she", "this", "to", "which", "you", "auf", "ein", "eine", "für", "im", "in", "nicht", "sich", "und", "von", "zu", "à", "au", "avec",
                  "ce", "de", "des", "du", "en", "et", "il", "la", "ne", "pas", "pour", "qui", "sur", "un", "al", "como", "las", "lo", "no", "por",
                  "se", "su", "y")
CHAIN = 2
REACH = 8
FEW, ALWAYS, SPARE, SHORT = 8, 8, 32, 16
BLOCK, MOST_BLOCKS = 2_000, 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.trim(F.regexp_replace(low, r"[^a-z0-9\x{80}-\x{10FFFF}]+", " "))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is found once however often ``then`` names it, also where a filter is moved below the projection."""
    return F.transform(F.array(value), then)[0]


def anchored(words: Column) -> Column:
    """Sorted distinct hashes of the chains after anchors."""
    def at(word: Column, k: Column) -> Column:
        ahead = F.filter(F.slice(words, k + 2, REACH), lambda w: ~w.isin(*STOP))
        return F.when(word.isin(*ANCHORS) & (F.size(ahead) >= CHAIN), F.hash(word, F.slice(ahead, 1, CHAIN)))

    return F.array_sort(F.array_distinct(F.filter(F.transform(words, at), F.isnotnull)))


def least_chains(parts: Column, length: int, most: Column) -> Column:
    """The ``most`` least hashes of ``length`` neighbours in ``parts``."""
    starts = F.when(F.size(parts) >= length, F.sequence(F.lit(1), F.size(parts) - length + 1)).otherwise(F.array().cast("array<int>"))
    return F.slice(F.array_sort(F.array_distinct(F.transform(starts, lambda k: F.hash(F.slice(parts, k, length))))), F.lit(1), most)


def completed(found: Column, words: Column, text: Column) -> Column:
    """``found`` with the least chains of the text; ``text`` is the canonical text."""
    few = F.size(found) < FEW
    pairs = least_chains(words, 2, F.when(few, F.lit(SPARE)).otherwise(F.lit(ALWAYS)))
    chars = F.when(few & (F.size(words) < SHORT), least_chains(F.split(text, ""), 4, F.lit(SPARE))).otherwise(F.array().cast("array<int>"))
    return F.array_sort(F.array_distinct(F.concat(found, pairs, chars)))


def with_signatures(df: DataFrame, text: Column, name: str) -> DataFrame:
    """``df`` with the signature set of ``text``."""
    def filled(found: Column, words: Column, plain: Column) -> Column:
        return let(completed(found, words, plain), lambda sigs: F.when(F.size(sigs) > 0, sigs).otherwise(F.array(F.hash(words))))

    return df.withColumn(name, let(canonical(text), lambda plain: let(F.split(plain, " "), lambda words: let(
        anchored(words), lambda found: filled(found, words, plain)))))


def as_text(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda s: F.lower(F.right(F.concat(F.lit("0000000"), F.hex(s)), F.lit(8)))), "")


def jaccard(a: Column, b: Column) -> Column:
    return let(F.size(F.array_intersect(a, b)), lambda both: both / (F.size(a) + F.size(b) - both))


def near_pairs(docs: DataFrame, min_jaccard: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Pairs (``a``, ``b``, ``jaccard``) between classes of equal fingerprints, and the members (``id``, ``class_id``) of all classes.

    A class is named by its smallest id.
    """
    if not 0 < min_jaccard <= 1:
        raise ValueError("the least Jaccard lies in (0, 1]")
    scratch = Scratch(docs.sparkSession)
    sets = with_signatures(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), F.col("text"), "sigs")
    sets = scratch.write(sets.select("id", "sigs", F.sha2(as_text(F.col("sigs")), 256).alias("fp")), "spots")
    classes = sets.groupBy("fp").agg(F.min("id").alias("class_id"), F.first("sigs").alias("sigs"), F.size(F.first("sigs")).alias("n"))
    classes = scratch.write(classes, "spot-classes")
    spread = classes.select("fp", "n", F.explode("sigs").alias("sig"))
    counts = scratch.write(spread.groupBy("sig").agg(F.count("*").alias("df")), "spot-counts")
    ranked = spread.join(counts, "sig").groupBy("fp", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("rare"))
    prefix = F.col("n") - F.ceil(F.col("n") * min_jaccard - 1e-9).cast("int") + 1
    length_class = F.floor(F.log("n") / -F.log(F.lit(min_jaccard)) + 1e-9).cast("int") if min_jaccard < 1 else F.col("n")
    keys = ranked.select("fp", "n", length_class.alias("part"), F.explode(F.slice("rare", F.lit(1), prefix)).alias("r")).select("fp", "n", "part", "r.sig")
    keys = scratch.write(keys, "spot-keys")
    other = keys.select(F.col("fp").alias("fp2"), F.col("n").alias("n2"), "sig", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    pairs = (keys.join(other, ["sig", "part"]).filter("(n > n2 or n = n2 and fp < fp2) and n2 >= n * {} - 1e-9".format(min_jaccard))
             .select("fp", "fp2").distinct())
    one = classes.select("fp", F.col("class_id").alias("c1"), F.col("sigs").alias("s1"))
    two = classes.select(F.col("fp").alias("fp2"), F.col("class_id").alias("c2"), F.col("sigs").alias("s2"))
    close = pairs.join(one, "fp").join(two, "fp2").withColumn("jaccard", jaccard(F.col("s1"), F.col("s2"))).filter(F.col("jaccard") >= min_jaccard - 1e-9)
    return (close.select(F.least("c1", "c2").alias("a"), F.greatest("c1", "c2").alias("b"), "jaccard"),
            sets.select("id", "fp").join(classes.select("fp", "class_id"), "fp").select("id", "class_id"))


def with_next(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``docs`` (``id``, ``text``, ...) with ``next_<c>`` for each kept column: that of the next row by id, of the first after the last.

    Rows are moved once, to blocks of neighbouring ids; the first row of each
    block is also sent to the block before it. Blocks have ``BLOCK`` rows until
    there are ``MOST_BLOCKS``, then they grow. One id for each comes to the driver.
    """
    blocks = min(max(2, -(-docs.count() // BLOCK)), MOST_BLOCKS)
    edges = docs.agg(F.percentile_approx("id", [k / blocks for k in range(1, blocks)] or [0.5], 10 * blocks).alias("e")).first()["e"] or []
    edges = sorted(set(edges))
    bounds = F.lit(edges) if edges else F.array().cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in range(len(edges).bit_length() - 1, -1, -1)] or [F.lit(0)])
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= len(edges)) & (F.try_element_at(bounds, at + step) <= F.col("id")), at + step).otherwise(at))
    block = F.when(F.col("id").isNull(), F.lit(len(edges))).otherwise(below)
    firsts = docs.groupBy(block.alias("block")).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first")).collect()
    firsts = sorted((r["block"], r["first"]["id"]) for r in firsts)
    placed = docs.withColumn("block", block).withColumn("_extra", F.lit(False))
    if not firsts:
        return placed.select(*docs.columns, *[F.col(c).alias(f"next_{c}") for c in keep])
    numbers = [b for b, _ in firsts]
    before = F.map_from_arrays(F.lit(numbers), F.lit([numbers[-1], *numbers[:-1]]))
    ids = [i for _, i in firsts if i is not None]
    heads = placed.filter(F.col("id").isin(ids) | F.col("id").isNull() if None in dict(firsts).values() else F.col("id").isin(ids))
    rank = F.row_number().over(Window.partitionBy("block").orderBy(F.col("id").asc_nulls_last(), "text"))
    heads = heads.withColumn("_rank", rank).filter("_rank = 1").drop("_rank").withColumn("block", before[F.col("block")]).withColumn("_extra", F.lit(True))
    order = Window.partitionBy("block").orderBy("_extra", F.col("id").asc_nulls_last(), "text")
    both = placed.unionByName(heads)
    return both.select(*docs.columns, "_extra", *[F.lead(c).over(order).alias(f"next_{c}") for c in keep]).filter("not _extra").drop("_extra")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_chars``, the signature sets of the text, of its edited form and of the next text, and the edited form."""
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marked = with_next(with_signatures(plain, F.col("text"), "sigs"), ["text", "sigs"])
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    shown = marked.select("id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sigs", "next_sigs")
    return with_signatures(shown, F.col("edited"), "edited_sigs")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("sigs")).alias("fingerprint"),
        as_text(F.col("edited_sigs")).alias("edited_fingerprint"), jaccard(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        jaccard(F.col("sigs"), F.col("next_sigs")).alias("near_next"))
