"""Packs as they arrive: facts to a table, and each touched series linked anew.

A year that arrives late between two linked ones splits their edge, so each batch links the touched (metric, entity)
series from the facts table as a whole; others stay as they are. The checkpoint makes each file count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kpiloom.operators import graph
from kpiloom.operators.melt import facts
from kpiloom.schemas import PACK


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Reads new JSON-line packs under ``source`` until none are left; writes ``target``/facts and ``target``/edges.

    Edges are versioned by batch: ``edges`` returns the newest of each series.
    """

    def batch(packs: DataFrame, number: int) -> None:
        new = facts(packs).withColumn("batch", F.lit(number))
        new.write.mode("overwrite").parquet(f"{target}/facts/part={number}")
        seen = spark.read.parquet(f"{target}/facts").where(F.col("batch") <= number)
        touched = spark.read.parquet(f"{target}/facts/part={number}").select("kpi_name", "key").distinct()
        on = seen["kpi_name"].eqNullSafe(touched["kpi_name"]) & seen["key"].eqNullSafe(touched["key"])
        nodes = graph.nodes(seen.join(touched, on, "left_semi"), ["batch", "evidence"])
        ids = nodes.select("id", "kpi_name", "key")
        out = graph.edges(nodes).join(ids.withColumnRenamed("id", "source"), "source")
        out.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/edges/part={number}")

    stream = spark.readStream.schema(PACK).json(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def edges(spark: SparkSession, target: str) -> DataFrame:
    """The edges of each series as its newest batch linked them."""
    every = spark.read.parquet(f"{target}/edges")
    newest = every.groupBy("kpi_name", "key").agg(F.max("batch").alias("batch"))
    on = every["kpi_name"].eqNullSafe(newest["kpi_name"]) & every["key"].eqNullSafe(newest["key"]) & (every["batch"] == newest["batch"])
    return every.join(newest, on, "left_semi").select("source", "target", "year_diff", "edge_type")
