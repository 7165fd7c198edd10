"""Language identification with language-bitmask n-gram filters.

One Bloom filter for each language, bit-sliced: slot s holds one bit for each language, so that the slots of a
trigram, and-ed, give all languages whose filter contains it. A text's trigrams are looked up at once, their bits
counted for each language, and each count is corrected for the false positives that the filter's fill predicts.

The filters are learned from labelled rows: trigram counts of each language over all of them (a distributed sum), then
the ``profile`` most frequent trigrams of each language that are at least half as frequent there as in any other (all
trigrams, should a language have none such), whatever their count, so every language with a letter is learned.
What reaches the driver is bounded by languages * profile.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from kpiloom.llm.common import table

#: Characters worked on at once; longer texts are cut into pieces that overlap by one character, losing no trigram.
PIECE = 1 << 20

UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _trigrams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code of each trigram around a letter, its text's number, numbers of texts with a letter), piece by piece."""
    held: list[str] = []
    owner: list[int] = []
    size = 0

    def flush():
        joined = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, held), np.int64, len(held))
        ends = np.cumsum(lengths)
        middle = np.ones(len(joined), bool)
        middle[ends - 1] = middle[ends - lengths] = False
        letter = _letters()[joined]
        c = np.where(letter, joined, np.uint32(32)).astype(np.uint64)
        at = np.flatnonzero(middle & letter)
        return (c[at - 1] << np.uint64(42)) | (c[at] << np.uint64(21)) | c[at + 1], np.repeat(np.asarray(owner), lengths)[at]

    for i, text in enumerate(texts):
        low = (text or "").lower()
        for s in range(0, len(low), PIECE):
            e = min(len(low), s + PIECE)
            held.append((low[s - 1] if s else " ") + low[s:e] + (low[e] if e < len(low) else " "))
            owner.append(i)
            size += e - s
            if size >= PIECE:
                yield flush()
                held, owner, size = [], [], 0
    if held:
        yield flush()


class Model:
    """Bit-sliced Bloom filters of ``languages`` over ``slots`` slots with ``hashes`` hash functions."""

    def __init__(self, profiles: dict[str, np.ndarray], prior: dict[str, int], slots_log2: int = 20, hashes: int = 3):
        self.languages = sorted(profiles)
        self.log2, self.hashes = slots_log2, hashes
        planes = max(1, -(-len(self.languages) // 64))
        self.slots = np.zeros((planes, 1 << slots_log2), np.uint64)
        for k, name in enumerate(self.languages):
            for h in self._places(profiles[name].astype(np.uint64)):
                self.slots[k // 64, h] |= np.uint64(1 << k % 64)
        fill = np.array([((self.slots[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(self.languages))])
        self.false = np.minimum(fill**hashes, 0.999)
        self.prior = np.array([prior.get(x, 0) for x in self.languages], float)

    def _places(self, codes: np.ndarray) -> list[np.ndarray]:
        h = codes * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        out, step = [], np.uint64(64 - self.log2)
        for _ in range(self.hashes):
            out.append((h >> step).astype(np.int64))
            h = h * np.uint64(0xFF51AFD7ED558CCD) + np.uint64(0x632BE59BD9B4E019)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        n, hits = np.zeros(len(texts)), np.zeros((len(self.languages), len(texts)))
        for codes, owner in _trigrams(texts):
            n += np.bincount(owner, minlength=len(texts))
            places = self._places(codes)
            for plane in range(len(self.slots)):
                bits = self.slots[plane][places[0]]
                for p in places[1:]:
                    bits &= self.slots[plane][p]
                for k in range(64 * plane, min(len(self.languages), 64 * plane + 64)):
                    has = (bits >> np.uint64(k % 64)) & np.uint64(1)
                    hits[k] += np.bincount(owner[has.astype(bool)], minlength=len(texts))
        right = np.maximum(0.0, (hits - n * self.false[:, None]) / (1 - self.false[:, None])) if self.languages else hits
        names, scores = [], []
        for i in range(len(texts)):
            if not n[i] or not self.languages:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            best = max(range(len(self.languages)), key=lambda k: (right[k, i], self.prior[k]))
            names.append(self.languages[best])
            scores.append(float(min(1.0, right[best, i] / n[i])))
        return names, scores


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, code, n) of each partition; sums are folded now and then so that they stay as small as their distinct codes."""
    sums: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def fold(parts):
        codes, back = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        return [(codes, np.bincount(back, np.concatenate([n for _, n in parts])).astype(np.int64))]

    for pdf in batches:
        for lang, own in pdf.groupby("lang", sort=False)["text"]:
            for codes, _ in _trigrams(own.tolist()):
                parts = sums.setdefault(lang, [])
                parts.append(np.unique(codes, return_counts=True))
                if len(parts) >= 16:
                    sums[lang] = fold(parts)
    for lang, parts in sums.items():
        (codes, n), = fold(parts)
        for s in range(0, len(codes), 100_000):
            yield pd.DataFrame({"lang": lang, "code": codes[s : s + 100_000].astype(np.int64), "n": n[s : s + 100_000]})


def fit(labelled: DataFrame, profile: int = 20_000) -> Model:
    """Model from all rows of ``labelled`` (lang, text); rows without lang or text are left out.

    ``profile`` bounds the trigrams of each language's filter. Ties go to smaller codes.
    """
    rows = labelled.where("lang is not null and text is not null").select("lang", "text")
    counts = rows.mapInPandas(_counted, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    by_lang = Window.partitionBy("lang").orderBy(F.desc("own"), F.desc("n"), "code")
    # the share of a language's trigrams: its counts over their sum
    totals = counts.groupBy("lang").agg(F.sum("n").alias("all"))
    rated = counts.join(totals, "lang").withColumn("rate", F.col("n") / F.col("all"))
    kept = rated.withColumn("own", F.col("rate") >= 0.5 * F.max("rate").over(Window.partitionBy("code")))
    kept = kept.withColumn("place", F.row_number().over(by_lang)).withColumn("any", F.max("own").over(Window.partitionBy("lang")))
    kept = kept.where(f"place <= {profile} and (own or not any)").select("lang", "code", "all")
    found = kept.toPandas()
    profiles = {k: v["code"].to_numpy() for k, v in found.groupby("lang")}
    return Model(profiles, {k: int(v["all"].iloc[0]) for k, v in found.groupby("lang")})


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score`` (share of trigrams in the language's filter, corrected).

    ``und``, with score 0, if the text is null or has no letter, or no language was learned. Equal counts, none at all
    among them, go to the language with more training trigrams, then to the first by name. Repeated rows are each predicted; columns named
    like the two new ones are replaced. Only the text is looked at.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.drop("lang_pred", "score")

    def run(batches):
        for batch in batches:
            names, scores = held.value.predict(batch.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    schema = StructType([*rest.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rest.mapInArrow(run, schema)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: languages of all documents, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
