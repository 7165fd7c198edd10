"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame expressions only.

A text's sketch keeps every hash of its five-word shingles below a fixed fraction of the hash range, so sketches of
very unequal documents can be merged and compared: |A and B| / |A| estimates how much of A stands in B. A text all of
whose hashes lie above the threshold keeps its smallest one as a stand-in, so that no text with words has an empty
sketch. Stand-ins make texts alike only if they are equal, never count for containment, and leave a sketch once it is
merged with one that has hashes below the threshold; so a merged sketch is the sketch of both texts' shingles together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kpiloom.llm.common import let, table, words

SHINGLE = 5

#: Hashes have 63 bits; one in FRACTION is kept.
FRACTION = 8


def shingle_hashes(text: Column, k: int = SHINGLE) -> Column:
    """Hash of each run of ``k`` words; of fewer words, one hash of all; of none, an empty array."""
    hashes = F.transform(words(text), lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        n = F.size(h)
        each = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(h, i + j) for j in range(k)]), 1))
        return F.when(n >= k, each).when(n > 0, F.array(F.shiftrightunsigned(F.xxhash64(h), 1))).otherwise(F.array().cast("array<bigint>"))

    return let(hashes, runs)


def sketch(text: Column, k: int = SHINGLE, fraction: int = FRACTION) -> Column:
    """Sorted distinct kept hashes of a text; null and blank texts have none."""

    def kept(h: Column) -> Column:
        return _held(F.array_sort(F.array_distinct(_below(h, fraction))), h)

    return let(shingle_hashes(text, k), kept)


def _below(h: Column, fraction: int) -> Column:
    return F.filter(h, lambda x: x < F.lit((1 << 63) // fraction))


def _held(below: Column, h: Column) -> Column:
    return let(below, lambda b: F.when((F.size(b) > 0) | (F.size(h) == 0), b).otherwise(F.array(F.array_min(h))))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two sketches: 0 to 1; of two empty ones, 1."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def containment(a: Column, b: Column, fraction: int = FRACTION) -> Column:
    """Estimated share of the first sketch's shingles that the second has; null if the first has none below the threshold."""
    return let(_below(a, fraction), lambda own: F.try_divide(F.size(F.array_intersect(own, b)).cast("double"), F.size(own).cast("double")))


def merge(a: Column, b: Column, fraction: int = FRACTION) -> Column:
    """Sketch of two documents' shingles together."""
    return let(F.array_sort(F.array_union(a, b)), lambda h: _held(_below(h, fraction), h))


def spelled(sk: Column) -> Column:
    return F.array_join(F.transform(sk, lambda h: F.hex(h)), " ")


def successors(keys: DataFrame, single: int = 65536, bits: int = 12) -> DataFrame:
    """(key, next_key) for distinct long ``key``s: the next larger one, and the smallest after the largest.

    Keys are windowed in groups of equal high bits, 2 ** ``bits`` at most in one; a group's last key gets the first of
    the next group, found the same way one level up, until so few groups are left (``single``) that one task holds them.
    """
    if keys.count() <= single:
        whole = Window.partitionBy(F.lit(0)).orderBy("key")
        first = F.min("key").over(Window.partitionBy(F.lit(0)))
        return keys.select("key", F.coalesce(F.lead("key").over(whole), first).alias("next_key"))
    grouped = keys.withColumn("g", F.shiftright("key", bits))
    inside = grouped.select("key", "g", F.lead("key").over(Window.partitionBy("g").orderBy("key")).alias("inner_next"))
    firsts = grouped.groupBy("g").agg(F.min("key").alias("first"))
    up = successors(firsts.select(F.col("g").alias("key")), single, bits)
    after = up.join(firsts.select(F.col("g").alias("next_key"), "first"), "next_key").select(F.col("key").alias("g"), "first")
    return inside.join(after, "g").select("key", F.coalesce("inner_next", "first").alias("next_key"))


def with_next(docs: DataFrame, carried: list[str], bits: int = 8) -> DataFrame:
    """``docs`` with ``next_<c>`` of the next row by ascending doc_id (null first), text; the last row gets the first's.

    Rows are windowed in groups of 2 ** ``bits`` neighbouring ids, so no task sorts all ids; only a group's last row
    needs another group's first. Repeated ids stand by their texts; a single row is its own next.
    """
    low = -(1 << 55) - 1  # below every group of a real id
    df = docs.withColumn("__g", F.coalesce(F.shiftright("doc_id", bits), F.lit(low)))
    w = Window.partitionBy("__g").orderBy(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    df = df.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carried], F.lead(F.lit(1)).over(w).isNull().alias("__last"), F.lag(F.lit(1)).over(w).isNull().alias("__head"))
    firsts = df.where("__head").select(F.col("__g").alias("__to"), *[F.col(c).alias(f"next_{c}") for c in carried])
    after = successors(docs.select(F.coalesce(F.shiftright("doc_id", bits), F.lit(low)).alias("key")).distinct()).select(F.col("key").alias("__g"), F.col("next_key").alias("__to"))
    lasts = df.where("__last").drop("__head", *[f"next_{c}" for c in carried]).join(after, "__g").join(firsts, "__to")
    return df.where("not __last").select(*docs.columns, *[f"next_{c}" for c in carried]).unionByName(lasts.select(*docs.columns, *[f"next_{c}" for c in carried]))


def fingerprints(docs: DataFrame, k: int = SHINGLE, fraction: int = FRACTION) -> DataFrame:
    """(doc_id, n_chars, sketch) of every whole text of ``docs`` (doc_id, text); null counts as empty.

    Other columns play no part; repeated rows stay; an empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.char_length(text).cast("long").alias("n_chars"), sketch(text, k, fraction).alias("sketch"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: fingerprints of all documents, of their edited texts, and likeness to those and to the next document's."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = with_next(docs.withColumn("sketch", sketch(F.col("text"))), ["text", "sketch"])
    n = F.char_length("text")
    df = df.withColumn("edited", F.concat(F.expr("substring(text, 1, int(char_length(text) - char_length(text) div 2))"), F.expr("substring(next_text, 1, int(char_length(text) div 2))")))
    df = df.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "sketch", sketch(F.col("edited")).alias("edited_sketch"), "next_sketch")
    return df.select(
        "doc_id", "n_chars", "edited_sha256", spelled(F.col("sketch")).alias("fingerprint"), spelled(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
