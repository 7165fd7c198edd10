"""What the operators share: reading tables, words, and cutting lineage with written tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: what separates words, as a Java regular expression.
SPACE = r"[\x20\x09-\x0D]+"

#: Whether shuffle files go with the query that wrote them; else they stay until the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null gives no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; all other characters stay as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only where that is unset, as in tests on one machine, a folder of our own is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="kpiloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lost executors lose nothing of it.

    Its shuffle files go at once, as nothing reads them again: the disk holds those of one query at a time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kpiloom-tables/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Removes a table of ``written`` that nothing will read again."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, with ``value`` computed once for each row and not once for each use in lambdas."""
    return F.transform(F.array(value), body)[0]


def split_join(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """``a`` joined to ``b``, which has one row for each ``on``; a hot key of ``a`` can be split over tasks.

    The hash beside the key keeps the join from resting on the partitioning of an aggregate, whose partitions can't be cut.
    """
    return a.withColumn("__on", F.xxhash64(on)).join(b.withColumn("__on", F.xxhash64(on)), ["__on", on]).drop("__on")
