"""Packs in a SQLite file, as a Python data source named ``sqlite_packs``.

    spark.dataSource.register(SqlitePacks)
    spark.read.format("sqlite_packs").load("packs.db")

Options: ``table`` (context_packs), ``partitions`` (1): ranges of rowid read side by side. The file must be where every
executor can open it.
"""

from __future__ import annotations

import json
import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

COLUMNS = ("table_id", "section_name", "title", "headers", "merged_headers", "rows", "stub_col")


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table, self.parts = options["path"], options.get("table", "context_packs"), int(options.get("partitions", 1))
        if not self.table.replace("_", "").isalnum():
            raise ValueError(f"not a table name: {self.table}")

    def partitions(self) -> list[_Range]:
        with sqlite3.connect(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
        if low is None:
            return []
        step = -(-(high - low + 1) // self.parts)
        return [_Range(a, min(high, a + step - 1)) for a in range(low, high + 1, step)]

    def read(self, partition: _Range):
        with sqlite3.connect(self.path) as db:
            for row in db.execute(f"SELECT rowid, {', '.join(COLUMNS)} FROM {self.table} WHERE rowid BETWEEN ? AND ? ORDER BY rowid", (partition.low, partition.high)):
                yield tuple(row)


class SqlitePacks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_packs"

    def schema(self) -> str:
        return "ord long, " + ", ".join(f"{c} string" for c in COLUMNS)

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def read(spark: SparkSession, path: str, year: int | None = None, limit: int | None = None, partitions: int = 1) -> DataFrame:
    """Packs of the file in order of rows, of one year or all, the first ``limit`` of them or all."""
    from kpiloom.functions.scalars import in_year_lax

    spark.dataSource.register(SqlitePacks)
    df = spark.read.format("sqlite_packs").option("partitions", partitions).load(path)
    nested, flat = "array<array<string>>", "array<string>"
    df = df.select(
        "ord", "table_id", F.lit(None).cast("string").alias("doc_id"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("bucket"),
        F.coalesce("section_name", F.lit("")).alias("section_name"), F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce(F.from_json("headers", nested), F.array().cast(nested)).alias("headers"), F.from_json("merged_headers", flat).alias("merged_headers"),
        F.coalesce(F.from_json("rows", nested), F.array().cast(nested)).alias("rows"), F.from_json("stub_col", flat).alias("stub_col"),
    )
    if year is not None:
        df = df.where(in_year_lax(F.col("table_id"), str(year)))
    return df if limit is None else df.orderBy("ord").limit(limit)


def write(path: str, packs: list[dict], table: str = "context_packs") -> None:
    """A file of packs, as fixtures need."""
    with sqlite3.connect(path) as db:
        db.execute(f"CREATE TABLE {table} ({', '.join(f'{c} TEXT' for c in COLUMNS)})")
        db.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(COLUMNS))})", [[p.get(c) if c in COLUMNS[:3] else (None if p.get(c) is None else json.dumps(p[c], ensure_ascii=False)) for c in COLUMNS] for p in packs])
