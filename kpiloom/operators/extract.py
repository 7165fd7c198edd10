"""Extraction: text to KPIs through any callable, repair of its output, and bounded correction.

The callable gets a table as JSON and gives text; it runs in ``mapInPandas``, built once for each partition. Without one,
the deterministic reading of the table itself is used, and the validator's own hints correct what is wrong.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.functions import scalars as S
from kpiloom.operators.melt import cells
from kpiloom.operators.validate import validate

KPI_COLUMNS = ["name", "key", "units", "value", "year", "row_name", "row_idx", "col_name", "col_idx", "source_model"]


def rule_kpis(packs: DataFrame, model: str = "rules") -> DataFrame:
    """Every numeric cell below a header with a year as a KPI of table_id and KPI_COLUMNS.

    The name comes from the header, else from the title, else from the label; where a header says ``Units`` it is
    ``Production``. A key equal to the name gives way to the title's context.
    """
    df = cells(packs).where((F.col("col_idx") >= 1) & S.is_number_cell(F.col("text")) & S.year_of(F.col("header")).isNotNull() & ~S.blank(F.col("label")))
    units = F.exists("merged_headers", lambda h: S.strip(h) == "Units")
    metric = S.metric_of(F.col("header"))
    name = F.when(units, "Production").otherwise(F.coalesce(F.nullif(metric, F.lit("")), F.nullif(S.strip(F.coalesce("title", "section_name")), F.lit("")), S.strip(F.col("label"))))
    label = S.strip(F.col("label"))
    key = F.when(label == name, S.title_context(F.col("title"))).otherwise(label)
    return df.select(
        "table_id", name.alias("name"), key.alias("key"), F.get(S.header_units(F.col("merged_headers")), F.lit(0)).alias("units"),
        S.parse_number(F.col("text")).cast("string").alias("value"), S.year_of(F.col("header")).alias("year"), F.col("label").alias("row_name"), "row_idx", F.col("header").alias("col_name"), "col_idx", F.lit(model).alias("source_model"),
    )


def generate(packs: DataFrame, make: Callable[[], Callable[[str], str]], model: str | None = None) -> DataFrame:
    """(table_id, model, raw, error) of each pack: what the callable that ``make`` builds says of the row's JSON.

    Without ``model`` the rows name theirs. A callable with a ``close`` is closed when its partition is done.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        say = make()
        try:
            for pdf in batches:
                rows = []
                for table_id, of, prompt in zip(pdf["table_id"], pdf["model"], pdf["prompt"], strict=True):
                    try:
                        rows.append((table_id, of, say(prompt), None))
                    except Exception as e:  # noqa: BLE001  a model's failure is a row, not the job's
                        rows.append((table_id, of, None, str(e)))
                yield pd.DataFrame(rows, columns=["table_id", "model", "raw", "error"])
        finally:
            getattr(say, "close", lambda: None)()

    prompt = packs.select("table_id", (F.col("model") if model is None else F.lit(model)).alias("model"), F.to_json(F.struct(*packs.columns)).alias("prompt"))
    return prompt.mapInPandas(run, "table_id string, model string, raw string, error string")


def parse(generated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """KPIs of table_id and KPI_COLUMNS, and the quarantine: outputs that failed or hold no ``kpis`` list."""
    df = generated.withColumn("cleaned", S.model_json(F.col("raw"))).withColumn("kpis", S.parsed_kpis(F.col("cleaned")))
    bad = df.where("kpis is null").select("table_id", "model", "raw", "cleaned", F.coalesce("error", F.lit("no kpis list")).alias("error"))
    good = df.where("kpis is not null").select("table_id", "model", F.inline("kpis"))
    return good.withColumn("source_model", F.coalesce("source_model", "model")).select("table_id", *KPI_COLUMNS), bad


def recovered(bad: DataFrame, packs: DataFrame, make: Callable[[], Callable[[str], str]]) -> DataFrame:
    """A second call for outputs that hold no ``kpis`` list: (table_id, raw, error, model), as ``generate`` gives.

    The callable gets the table, its own first output and what was wrong with it. Calls that failed get no second one.
    """
    table = packs.select("table_id", F.struct(*packs.columns).alias("table"))
    asked = bad.where("raw is not null").join(table, "table_id").select("table_id", "model", "table", F.col("cleaned").alias("incomplete_output"), F.col("error").alias("parse_error"))
    return generate(asked, make)


def extracted(packs: DataFrame, make: Callable[[], Callable[[str], str]], model: str, path: str) -> DataFrame:
    """(table_id, model, kpis, error, recovered) of each pack, after one recovery of outputs that hold no KPIs.

    Outputs are written under ``path`` before they are read again, so the callable is asked once for each table.
    """
    spark = packs.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    def rows(said: DataFrame, again: bool) -> tuple[DataFrame, DataFrame]:
        good, bad = parse(said)
        full = good.groupBy("table_id").agg(F.collect_list(F.struct(*KPI_COLUMNS)).alias("kpis"))
        empty = said.select("table_id").join(bad.select("table_id"), "table_id", "left_anti").join(full, "table_id", "left")
        none = F.array().cast(full.schema["kpis"].dataType)
        return empty.select("table_id", F.lit(model).alias("model"), F.coalesce("kpis", none).alias("kpis"), F.lit(None).cast("string").alias("error"), F.lit(again).alias("recovered")), bad

    first, bad = rows(kept(generate(packs, make, model), "first"), False)
    second, lost = rows(kept(recovered(bad, packs, make), "second"), True)
    none = F.array().cast(first.schema["kpis"].dataType)
    failed = bad.join(second.select("table_id"), "table_id", "left_anti").join(lost.select("table_id", F.col("error").alias("later")), "table_id", "left")
    failed = failed.select("table_id", F.lit(model).alias("model"), none.alias("kpis"), F.coalesce(F.concat(F.lit("JSON recovery failed: "), F.col("later")), F.col("error")).alias("error"), F.lit(False).alias("recovered"))
    return first.unionByName(second).unionByName(failed)


def run_totals(results: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Tables, successes, failures and KPIs of each run."""
    ok = F.col("error").isNull()
    return results.groupBy(*by).agg(F.count("*").alias("tables"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"), F.coalesce(F.sum(F.when(ok, F.size("kpis"))), F.lit(0)).alias("kpis"))


def corrected(checked: DataFrame) -> DataFrame:
    """Invalid KPIs as the validator's hints would have them: row by label, place by neighbour, name from the key's table."""
    r = F.coalesce(F.col("hit.r"), F.col("label_at"), F.col("row_idx"))
    c = F.coalesce(F.col("hit.c"), F.col("col_idx"))
    name = F.when(F.col("outcome") == "same_name", F.lit("Production")).otherwise(F.col("name"))
    value = F.when(F.col("outcome").isin("moderate", "value_null", "not_number") & F.col("hit").isNull(), F.col("source_cell_value").cast("string")).otherwise(F.col("value"))
    moved = F.col("hit").isNotNull()
    cols = {"name": name, "row_idx": r, "col_idx": c, "value": value, "row_name": F.when(moved, F.lit(None)).otherwise(F.col("row_name")), "col_name": F.when(moved, F.lit(None)).otherwise(F.col("col_name"))}
    return checked.select("table_id", *[cols.get(k, F.col(k)).alias(k) for k in KPI_COLUMNS])


def correct(kpis: DataFrame, packs: DataFrame, rounds: int = 3, path: str | None = None) -> DataFrame:
    """Validation after at most ``rounds`` rounds; ``iteration`` tells in which a KPI was settled.

    Each round corrects only what is invalid. With ``path`` each round is written there before the next reads it;
    without, rounds are unrolled into one plan of narrow steps over ``rounds`` joins.
    """

    def kept(df: DataFrame, i: int) -> DataFrame:
        if path is None:
            return df
        df.write.mode("overwrite").parquet(f"{path}/round={i}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{path}/round={i}")

    checked = kept(validate(kpis, packs).withColumn("iteration", F.lit(1)), 1)
    done = None
    for i in range(2, rounds + 1):
        valid = checked.where("is_valid")
        done = valid if done is None else done.unionByName(valid)
        checked = kept(validate(corrected(checked.where("not is_valid")), packs).withColumn("iteration", F.lit(i)), i)
    return checked if done is None else done.unionByName(checked)


def remaining(packs: DataFrame, results: DataFrame) -> DataFrame:
    """Packs whose table id has no result yet; packs without id always remain."""
    return packs.join(results.select("table_id").where("table_id is not null").distinct(), "table_id", "left_anti")
