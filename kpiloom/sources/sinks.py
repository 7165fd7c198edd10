"""Where results go: Parquet for tables, JSON for exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def graph(nodes: DataFrame, edges: DataFrame, metadata: DataFrame, path: str) -> None:
    """Nodes, edges and the one row of metadata as Parquet; metadata with the time of export."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    metadata.withColumn("export_timestamp", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/metadata")


def graph_json(nodes: DataFrame, edges: DataFrame, path: str, units: bool = True) -> None:
    """One JSON line for each node and edge, ``kind`` telling which; without units for a viewer."""
    n = nodes.select(F.lit("node").alias("kind"), "id", "kpi_name", "key", "value", "year", *(["units"] if units else []))
    e = edges.select(F.lit("edge").alias("kind"), "source", "target", F.coalesce("year_diff", F.lit(0)).alias("year_diff"), F.coalesce("edge_type", F.lit("temporal")).alias("edge_type"))
    n.unionByName(e, allowMissingColumns=True).write.mode("overwrite").json(path)


def by_year(packs: DataFrame, path: str) -> None:
    """Packs as JSON in one folder for each year of a strict table id, ``unknown`` for the rest."""
    from kpiloom.functions.scalars import table_year_strict

    y = F.coalesce(table_year_strict(F.col("table_id")).cast("string"), F.lit("unknown"))
    packs.withColumn("table_year", y).write.mode("overwrite").partitionBy("table_year").json(path)


def append_results(results: DataFrame, path: str, by: tuple[str, ...] = ("model", "year")) -> None:
    """Results appended by model and year, or model and input file; each append is whole or absent."""
    results.write.mode("append").partitionBy(*by).json(path)


def finalise(results: DataFrame, path: str, by: tuple[str, ...] = ("model", "year")) -> None:
    """The results of whole runs, with one row of metadata for each: only the runs that ``results`` holds are replaced."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).json(f"{path}/results")
    meta = results.groupBy(*by).agg(F.count("*").alias("total_tables_processed"), F.coalesce(F.sum(F.size("kpis")), F.lit(0)).alias("total_kpis_extracted"))
    meta = meta.select("*", F.current_timestamp().alias("completed"), F.lit(False).alias("checkpoint"), F.lit(True).alias("complete"))
    meta.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).json(f"{path}/metadata")


def reports(valid: DataFrame, invalid: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Both reports as JSON lines, in a folder for each of ``by``; one without rows has no part files with lines."""
    for name, df in (("valid", valid), ("invalid", invalid)):
        df.write.mode("overwrite").partitionBy(*by).json(f"{path}/{name}")


def debug_dump(quarantine: DataFrame, path: str) -> None:
    """Outputs that could not be read, appended with the time, in a folder for each model."""
    quarantine.withColumn("dumped", F.current_timestamp()).write.mode("append").partitionBy("model").json(path)


def chains(links: DataFrame, path: str) -> None:
    links.write.mode("overwrite").parquet(path)


def named(docs: DataFrame, path: str, by: str, pattern: str) -> None:
    """JSON lines with one file for each value of ``by``, which takes the place of ``{}`` in ``pattern`` as file name.

    Each value is one task and one file: it is meant for values that a single file is wanted of, such as a year.
    """
    spark = docs.sparkSession
    docs.repartition(by).write.mode("overwrite").partitionBy(by).json(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if not name.startswith(f"{by}="):
            continue
        for part in fs.listStatus(status.getPath()):
            if part.getPath().getName().startswith("part-"):
                fs.rename(part.getPath(), spark._jvm.org.apache.hadoop.fs.Path(root, pattern.format(name.removeprefix(f"{by}="))))
        fs.delete(status.getPath(), True)
