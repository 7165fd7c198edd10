"""Table packs to KPI facts: layout classification, cell melt, and the four layouts' readings.

All layouts come from one melt: rows and cells are exploded by place, labels and headers are looked up by place in the
same row, and a layout's reading is a column expression. Nothing shuffles but the unit fold, a window inside one row of
one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.functions import scalars as S


def layout(h: Column) -> Column:
    """Layout of merged headers: type_1 to type_4, or unknown_format (also for none at all)."""
    first, second = F.get(h, F.lit(0)), F.get(h, F.lit(1))
    rest = F.filter(F.slice(h, 2, F.greatest(F.size(h), F.lit(1))), lambda x: F.coalesce(x, F.lit("")) != "")
    named = F.forall(rest, lambda x: S.metric_of(x).isNotNull() & S.year_of(x).isNotNull() & (F.size(F.split(S.strip(x), r"(?U)\s+")) > 1))
    word = ~S.is_number_text(first) & S.is_word_text(first)
    empty = S.blank(first) & S.blank(second)
    years = S.blank(first) & S.is_number_text(second)
    kind = (
        F.when(named & ~empty & ~word & ~years, "type_1").when(word & ~empty & ~named & ~years, "type_2")
        .when(empty & ~named & ~word & ~years, "type_3").when(years, "type_4").otherwise("unknown_format")
    )
    return F.when(F.coalesce(F.size(h), F.lit(0)) < 1, "unknown_format").when((F.size(h) == 1) & S.blank(first), "unknown_format").otherwise(kind)


def cells(packs: DataFrame) -> DataFrame:
    """One row for each cell: pack columns, ``layout``, row_idx, col_idx, text, label and header by place."""
    df = packs.withColumn("layout", layout(F.col("merged_headers")))
    df = df.select("*", F.posexplode("rows").alias("row_idx", "cells")).withColumn("label", F.get("stub_col", F.col("row_idx")))
    df = df.select("*", F.posexplode("cells").alias("col_idx", "text"))
    return df.withColumn("header", F.get("merged_headers", F.col("col_idx")))


def facts(packs: DataFrame) -> DataFrame:
    """KPI facts of all packs: layout, kpi_name, key, value, year, units, evidence, row_ord.

    Rows without label, cells without number and columns without year give none; ``%`` columns are left out but by the
    reading of type 1. Packs whose headers are null or empty give none. ``units_fixed`` is the unit by the metric's place
    among the row's metrics, where the fold of type 1 takes the wrong one for rows whose first metric is missing.
    """
    df = cells(packs).where((F.col("col_idx") > 0) & F.col("header").isNotNull() & ~S.blank(F.col("label")) & S.is_number_cell(F.col("text")))
    df = df.withColumn("year_", S.year_of(F.col("header"))).where("year_ is not null")
    one = F.col("layout").isin("type_1", "unknown_format")
    percent = (S.strip(F.col("header")) == "%") | F.contains(F.lower("header"), F.lit("percent"))
    df = df.where(one | ~percent)
    aside = F.get("cells", F.lit(1))
    # a second column of units, where it is words, stands between label and years
    has_units = ~S.is_number_cell(aside) & ~S.blank(aside) & ~S.strip(aside).isin("–", "-")
    df = df.where((F.col("layout") != "type_3") | (F.col("col_idx") > 1) | ~has_units)
    df = df.withColumn("metric", S.metric_of(F.col("header")))
    row = Window.partitionBy("table_id", "row_idx").orderBy("col_idx")
    df = df.withColumn("turn", (F.lag("year_").over(row).isNotNull() & (F.lag("year_").over(row) != F.col("year_")) & F.lag("metric").over(row).eqNullSafe(F.col("metric"))).cast("int"))
    df = df.withColumn("turns", F.coalesce(F.sum("turn").over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    units = S.header_units(F.col("merged_headers"))
    metrics = F.array_distinct(F.filter(F.transform(F.slice("merged_headers", 2, F.size("merged_headers")), S.metric_of), lambda m: m.isNotNull()))
    place = F.greatest(F.array_position(metrics, F.col("metric")).cast("int") - 1, F.lit(0))
    kind = F.col("layout")
    label = S.strip(F.col("label"))
    bracket = S.units_in(label)
    return df.select(
        "layout",
        F.when(one, F.col("metric")).when(kind == "type_2", S.title_metric(F.col("title"))).otherwise(S.key_metric(label)).alias("kpi_name"),
        F.when(kind == "type_4", S.title_context(F.col("title"))).otherwise(label).alias("key"),
        S.clean_number(F.col("text")).alias("value"),
        F.col("year_").alias("year"),
        F.when(one, S.units_at(units, F.when(F.col("turn") == 1, F.col("turns")).otherwise(F.col("col_idx") - 1)))
        .when(kind == "type_2", S.strip(F.get("merged_headers", F.lit(0))))
        .when(kind == "type_3", F.coalesce(bracket, F.when(has_units, S.strip(aside)), F.lit("N/A"))).otherwise(S.key_units(label)).alias("units"),
        F.when(one, S.units_at(units, place)).alias("units_fixed"),
        F.struct(
            F.coalesce("table_id", F.lit("")).alias("table_id"), F.coalesce("doc_id", F.lit("")).alias("doc_id"), F.coalesce("page", F.lit(0)).alias("page"),
            F.coalesce("section_name", F.lit("")).alias("section"), F.coalesce("title", F.lit("")).alias("title"), "row_idx", "col_idx",
        ).alias("evidence"),
    )
