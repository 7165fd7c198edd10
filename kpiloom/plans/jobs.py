"""Whole runs: extraction from packs by models, and validation of extraction files against their tables.

    python -m kpiloom.plans.jobs --db packs.db --output-dir out --models rules
    python -m kpiloom.plans.jobs --input packs.jsonl --output-dir out --models rules mine=my_module:make

A model is ``rules``, the reading of the table itself, or a name with a function that builds the callable.
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kpiloom.functions import scalars as S
from kpiloom.operators import extract
from kpiloom.operators.validate import invalid_report, last_packs, statistics, valid_report, validate
from kpiloom.sources import packs as pack_source
from kpiloom.sources import sinks, sqlite

Make = Callable[[], Callable[[str], str]]


def _results(packs: DataFrame, model: str, make: Make | None, rounds: int, path: str) -> DataFrame:
    """(table_id, model, kpis, error, recovered) of each pack, KPIs corrected; tables without any included."""
    if make is None:
        of = extract.rule_kpis(packs, model).groupBy("table_id").agg(F.collect_list(F.struct(*extract.KPI_COLUMNS)).alias("kpis"))
        none = F.array().cast(of.schema["kpis"].dataType)
        found = packs.select("table_id").join(of, "table_id", "left").select("table_id", F.lit(model).alias("model"), F.coalesce("kpis", none).alias("kpis"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("recovered"))
    else:
        found = extract.extracted(packs, make, model, f"{path}/outputs")
    settled = extract.correct(found.select("table_id", F.inline("kpis")), last_packs(packs, ["table_id"]), rounds, f"{path}/rounds")
    kpis = settled.groupBy("table_id").agg(F.collect_list(F.struct(*extract.KPI_COLUMNS)).alias("settled"))
    return found.join(kpis, "table_id", "left").withColumn("kpis", F.coalesce("settled", "kpis")).drop("settled")


def process_packs(
    packs: DataFrame, models: dict[str, Make | None], out: str, by: str = "year", only: list | None = None, max_tables: int | None = None, order: str = "table_id", rounds: int = 3, resume: bool = True
) -> DataFrame:
    """Extracts from all packs with each model and writes results by model and ``by`` (year, or input_file).

    ``only`` keeps some values of ``by``, ``max_tables`` the first tables of each by ``order``. Each run appends to
    ``out``/checkpoint; with ``resume`` tables that stand there are not asked again (failed ones among them). When a
    model is through, ``out``/results and ``out``/metadata hold its whole runs and the checkpoint loses them. Returns
    tables, successes, failures and KPIs by model and ``by``.
    """
    spark = packs.sparkSession
    chosen = packs if only is None else packs.where(F.col(by).isin(only))
    if max_tables is not None:
        first = Window.partitionBy(by).orderBy(order)
        chosen = chosen.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= max_tables).drop("__n")
    totals = None
    for model, make in models.items():
        at = f"{out}/checkpoint/model={model}"
        earlier = _read(spark, at) if resume else None
        left = chosen if earlier is None else extract.remaining(chosen, earlier)
        done = _results(left, model, make, rounds, f"{out}/work/{model}").join(chosen.select("table_id", by).distinct(), "table_id")
        done.withColumn("processing_timestamp", F.current_timestamp().cast("string")).write.mode("append" if resume else "overwrite").parquet(at)
        whole = spark.read.parquet(at).join(chosen.select("table_id").distinct(), "table_id", "left_semi")
        sinks.finalise(whole, out, ("model", by))
        mine = extract.run_totals(whole, ("model", by))
        totals = mine if totals is None else totals.unionByName(mine)
    return totals


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def process_database(spark: SparkSession, db: str, models: dict[str, Make | None], out: str, year: int | None = None, max_tables: int | None = None, **options) -> DataFrame:
    """``process_packs`` over the packs of a SQLite file by year: that of the table id, 2015 to 2024 unless one is named."""
    packs = sqlite.read(spark, db).withColumn("year", S.table_year_medium(F.col("table_id"))).where("table_id is not null")
    return process_packs(packs, models, out, "year", [year] if year else list(range(2015, 2025)), max_tables, "ord", **options)


def process_jsonl_files(spark: SparkSession, path: str, models: dict[str, Make | None], out: str, max_tables: int | None = None, **options) -> DataFrame:
    """``process_packs`` over files of JSON lines, by input file."""
    packs = pack_source.jsonl(spark, path, strict=False).where("corrupt is null and table_id is not null").drop("corrupt")
    return process_packs(packs.withColumn("input_file", F.element_at(F.split("file", "/"), -1)), models, out, "input_file", None, max_tables, "line", **options)


def validate_files(spark: SparkSession, extractions: str, tables: str, out: str) -> tuple[DataFrame, DataFrame]:
    """Validates extraction files against the tables of their year; statistics by file, and over all files.

    The year stands in the names of both. Files without a year in the name, and years without a file of tables, are
    left out. A table id that repeats in a file stands for its last line. Reports go to ``out``, by extraction file.
    """
    year = F.nullif(F.regexp_extract("file", pack_source.YEAR_IN_NAME, 1), F.lit(""))
    in_year = lambda c: F.concat_ws("\x01", "file_year", c)
    source = pack_source.jsonl(spark, tables).withColumn("file_year", year).where("file_year is not null and table_id is not null and table_id <> ''")
    source = last_packs(source.withColumn("table_id", in_year("table_id")), ["file", "line"])
    kpis = pack_source.extractions(spark, extractions).where("file_year is not null").withColumn("file", F.element_at(F.split("file", "/"), -1))
    checked = validate(kpis.withColumn("table_id", in_year("table_id")), source).withColumn("table_id", F.element_at(F.split("table_id", "\x01"), -1))
    checked.write.mode("overwrite").partitionBy("file").parquet(f"{out}/checked")
    checked = spark.read.parquet(f"{out}/checked")
    sinks.reports(valid_report(checked, ["file", "file_year"]), invalid_report(checked, ["file", "file_year"]), out, ("file",))
    return statistics(checked, ["file", "file_year"]), statistics(checked)


def main(argv: list[str] | None = None) -> DataFrame:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("--db")
    source.add_argument("--input", help="a file or folder of JSON lines")
    p.add_argument("--output-dir", required=True)
    p.add_argument("--year", type=int)
    p.add_argument("--models", nargs="+", default=["rules"], help="rules, or name=module:function")
    p.add_argument("--max-tables", type=int)
    p.add_argument("--temperature", type=float, help="given to the functions that build models, if set")
    p.add_argument("--job-id", default="", help="a folder of its own under the output folder")
    p.add_argument("--debug", action="store_true", help="shows the totals of each run")
    p.add_argument("--max-correction-iterations", type=int, default=3)
    p.add_argument("--no-resume", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    models: dict[str, Make | None] = {}
    for m in a.models:
        name, _, where = m.partition("=")
        module, _, function = where.partition(":")
        make = getattr(importlib.import_module(module), function) if where else None
        models[name] = make if make is None or a.temperature is None else (lambda f=make: f(temperature=a.temperature))
    out = f"{a.output_dir}/{a.job_id}" if a.job_id else a.output_dir
    options = {"max_tables": a.max_tables, "rounds": a.max_correction_iterations, "resume": not a.no_resume}
    totals = process_database(spark, a.db, models, out, a.year, **options) if a.db else process_jsonl_files(spark, a.input, models, out, **options)
    if a.debug:
        totals.show(truncate=False)
    return totals


if __name__ == "__main__":
    main()
