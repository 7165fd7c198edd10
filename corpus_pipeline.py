"""The corpus pipeline: ``documents`` to packed bins in five stages, each calling one operator over all it is given.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``; all but the last return the columns that ``docs`` had, with the stage's decisions carried out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kpiloom.llm import langid, linededup, minhash, mixing, packing
from kpiloom.llm.common import table, written

#: Least share of a text's trigrams that the filter of its language must hold; less isn't prose of any language learned.
LEAST_LANGUAGE = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: texts without letters, and such as are in no learned language, go; ``lang`` becomes the prediction."""
    found = langid.identify(docs.withColumnsRenamed({c: f"__{c}" for c in ("lang_pred", "score") if c in docs.columns}), langid.fit(docs))
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)).withColumn("lang", F.col("lang_pred"))
    return kept.drop("lang_pred", "score").withColumnsRenamed({f"__{c}": c for c in ("lang_pred", "score") if c in docs.columns}).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: repeated chunks leave the texts; n_chars follows."""
    return linededup.dedup(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of each component, one row of the document whose id is smallest stays."""

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumns({"__id": F.coalesce("doc_id", F.lit(0)), "__none": F.col("doc_id").isNull()})

    kept = keyed(minhash.similar_sets(docs).where("kept").withColumnRenamed("text_hash", "__text")).select("__text", "__id", "__none")
    rows = keyed(docs.withColumn("__text", F.xxhash64("text"))).join(kept, ["__text", "__id", "__none"], "left_semi")
    return rows.dropDuplicates(["__text", "__id", "__none"]).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document as often as the mix takes it.

    Rows of equal id, source and size take the copies of theirs in order of their texts, so each row of the mix is
    carried out once, however many rows are alike.
    """
    key = F.xxhash64("doc_id", "source", "size").alias("__key")
    times = lambda n: F.count(F.when(F.col("copies") == n, 1)).alias(f"__{n}")
    taken = mixing.mix(docs).where("copies > 0").groupBy(key).agg(times(1), times(2))
    sized = docs.withColumn("__key", F.xxhash64("doc_id", "source", F.size(mixing.words(F.col("text"))).cast("long")))
    place = F.row_number().over(Window.partitionBy("__key").orderBy(F.xxhash64("text")))
    copies = F.when(F.col("__place") <= F.col("__2"), 2).when(F.col("__place") <= F.col("__2") + F.col("__1"), 1)
    rows = sized.withColumn("__place", place).join(taken, "__key").withColumn("__copies", copies).where("__copies is not null")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: bins of 2048 words."""
    return packing.pack(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near), ("source_mix", mix), ("best_fit_packing", pack)]

#: Models, hashes and greedy packing aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
