"""Conflict-constrained best-fit packing of documents into bins of ``capacity`` words.

Documents longer than a bin are cut: full pieces fill bins of their own, the rest is packed. Rows are dealt to shards of
about ``shard`` rows by a hash of the id; each shard is packed by itself, longest first. Its open bins stand in order
of what they have left; a successor search finds the tightest bin that can hold a piece and goes on to the next as long
as the bin's bitmaps conflict: the bit of the piece's duplicate cluster is set, or its source's bit in all ``copies``
planes (plane k: sources with k + 1 pieces in the bin). No search is cut short.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.llm.common import ascii_lower, table, words

SCHEMA = "doc_id long, piece int, first_word long, n_words long, bin string, bin_free long"


def pack_shard(items: list[tuple[int, int, int]], capacity: int, copies: int) -> list[int]:
    """Bin of each (size, source bit, cluster bit), taken in the order given; sizes are 0 to ``capacity``."""
    order: list[tuple[int, int]] = []  # (left, bin), ascending
    left: list[int] = []
    clusters: list[int] = []
    planes: list[list[int]] = []
    out = []
    for size, source, cluster in items:
        s, c = 1 << source, 1 << cluster
        k = bisect_left(order, (size, -1))
        while k < len(order):
            b = order[k][1]
            if not clusters[b] & c and not planes[b][-1] & s:
                break
            k += 1
        if k == len(order):
            b = len(left)
            left.append(capacity)
            clusters.append(0)
            planes.append([0] * copies)
        else:
            del order[k]
        left[b] -= size
        clusters[b] |= c
        for p in range(copies):
            if not planes[b][p] & s:
                planes[b][p] |= s
                break
        insort(order, (left[b], b))
        out.append(b)
    return out


def _packer(capacity: int, copies: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "cluster", "source"], ascending=[False, True, True, True], na_position="first", kind="stable")
        bit = {k: pd.factorize(pdf[k], use_na_sentinel=False)[0].tolist() for k in ("source", "cluster")}
        bit["cluster"] = [c if size else len(pdf) + i for i, (c, size) in enumerate(zip(bit["cluster"], pdf["size"], strict=True))]
        rows, bins = [], []
        tag, full = pdf["shard"].iloc[0], 0
        rests = []
        for doc, size, source, cluster in zip(pdf["doc_id"], pdf["size"], bit["source"], bit["cluster"], strict=True):
            pieces, rest = divmod(int(size), capacity)
            for p in range(pieces):
                rows.append((doc, p, p * capacity, capacity, f"{tag}:f{full}", 0))
                full += 1
            if rest or not pieces:
                rests.append((doc, pieces, rest, source, cluster))
        rests.sort(key=lambda r: -r[2])
        bins = pack_shard([(r[2], r[3], r[4]) for r in rests], capacity, copies)
        free: dict[int, int] = {}
        for r, b in zip(rests, bins, strict=True):
            free[b] = free.get(b, capacity) - r[2]
        rows += [(r[0], r[1], r[1] * capacity, r[2], f"{tag}:{b}", free[b]) for r, b in zip(rests, bins, strict=True)]
        return pd.DataFrame(rows, columns=["doc_id", "piece", "first_word", "n_words", "bin", "bin_free"]).assign(doc_id=lambda d: pd.array([None if pd.isna(x) else int(x) for x in d["doc_id"]], "Int64"))

    return run


def pack(docs: DataFrame, capacity: int = 2048, copies: int = 8, shard: int = 4096, cluster: Column | None = None) -> DataFrame:
    """(doc_id, piece, first_word, n_words, bin, bin_free) of all pieces of ``docs`` (doc_id, source, text).

    ``cluster`` is the duplicate cluster; without it, texts equal but for case and spaces are one. No bin holds two
    rests of one cluster or more than ``copies`` of one source (null is a source). Texts without words, and null ones,
    are pieces of 0 words that belong to no cluster; repeated rows are packed each. An empty table gives no bins. Other
    columns play no part. A shard's rows are ids and sizes, not texts; rows are dealt by id and place in the table, so
    that hot sources and clusters, repeated ids and rows without one are spread over all shards.
    """
    same = F.array_join(words(ascii_lower(F.col("text"))), " ")
    rows = docs.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("source").cast("string").alias("source"), F.size(words(F.col("text"))).cast("long").alias("size"),
        (F.xxhash64(same) if cluster is None else F.xxhash64(cluster)).alias("cluster"),
    )
    shards = max(1, -(-docs.select(F.lit(1)).count() // shard))
    place = F.monotonically_increasing_id()  # the same again when a lost task is run again
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", place, F.lit("shard")), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(_packer(capacity, copies), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: all documents packed."""
    return pack(table(spark, sf_dir, "documents"))
