"""Validation of KPIs against their source cells: one join by table id, then a decision table in column expressions.

Each step of the table is one expression over the joined row; a step that ends the examination leaves the later ones
without effect. No UDF and no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.functions import scalars as S

#: Places around a cell: the four beside it, and all eight.
BESIDE = ((-1, 0), (1, 0), (0, -1), (0, 1))
AROUND = tuple((r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if (r, c) != (0, 0))


# What the validator says, ``{}`` standing for a value.
SAYS = {
    "same_name": "❌ key and name are identical: '{}' (they must be different when both are non-empty)",
    "no_row": "Missing row_idx in KPI",
    "no_col": "Missing col_idx in KPI",
    "no_rows": "No rows in table data",
    "row_bounds": "row_idx {} out of bounds (table has {} rows)",
    "col_bounds": "col_idx {} out of bounds (row has {} cols)",
    "row_equal": "✓ row_name verified: '{}'",
    "row_case": "⚠ row_name case mismatch: KPI='{}', expected='{}'",
    "row_differs": "❌ row_name MISMATCH: KPI='{}', stub_col[{}]='{}'",
    "row_missing": "⚠ row_name missing, using stub_col[{}]='{}'",
    "col_equal": "✓ col_name verified: '{}'",
    "col_case": "⚠ col_name case mismatch: KPI='{}', expected='{}'",
    "col_differs": "⚠ col_name MISMATCH: KPI='{}', merged_headers[{}]='{}'",
    "col_missing": "⚠ col_name missing, using merged_headers[{}]='{}'",
    "shift": "⚠ Auto-corrected: col_idx=0 (row label) → col_idx=1, found value={}",
    "both_null": "Both null (cell: '{}')",
    "value_null": "Extracted null but source={} (cell: '{}')",
    "source_null": "Source null but extracted={} (cell: '{}')",
    "not_number": "Type conversion error: extracted={} (type=str), source={} (type=float)",
    "small": "Small diff: {}",
    "moderate": "Moderate diff: extracted={}, source={}, diff={}",
    "beside": "⚠ Auto-corrected: col_idx={} → col_idx={}, value match improved ({} → {})",
    "beside_small": "Small diff after correction: {}",
    "large": "Large diff: extracted={}, source={}, diff={}",
    "fix_name": "FIX: key='{}' and name='{}' are identical. Look at table context:",
    "fix_title": "  - Table title: '{}'",
    "fix_section": "  - Section: '{}'",
    "fix_current": "  - Current row: '{}'",
    "fix_which": "SOLUTION: Determine which is the metric (name) vs entity (key):",
    "fix_vehicles": "  - If table measures production/sales of vehicles: name='Production' or 'Sales', key='{}'",
    "fix_company": "  - If table shows KPIs for a company/brand: name='{}', key='Company'/'Brand'",
    "fix_read": "  - Check title and section to determine the correct interpretation",
    "fix_row": "FIX: row_idx={} points to wrong row",
    "fix_row_is": "  - Current: row_name='{}' but stub_col[{}]='{}'",
    "fix_row_how": "SOLUTION: Search stub_col for the correct row_idx where value matches '{}':",
    "fix_row_at": "  → Found at row_idx={}, stub_col[{}]='{}'",
    "fix_row_to": "  → Update: row_idx: {} → {}, row_name: '{}' → '{}'",
    "fix_col": "WARNING: col_idx={} may point to wrong column",
    "fix_col_is": "  - Current: col_name='{}' but merged_headers[{}]='{}'",
    "fix_col_how": "SOLUTION: Search merged_headers for correct col_idx where value matches '{}':",
    "fix_col_at": "  → Found at col_idx={}, merged_headers[{}]='{}'",
    "fix_col_to": "  → Consider updating: col_idx: {} → {}, col_name: '{}' → '{}'",
    "fix_moderate": "FIX: Value mismatch (5% error)",
    "fix_large": "FIX: Large value mismatch (>5% error)",
    "fix_extracted": "  - Extracted: {}",
    "fix_source": "  - Source at [{}][{}]: {} (text: '{}')",
    "fix_beside": "SOLUTION: Check if value appears in adjacent cells:",
    "fix_around": "SOLUTION: Search nearby cells for the extracted value {}:",
    "fix_found": "  → Found {} at [{}][{}]: rows[{}][{}]='{}'",
    "fix_found_near": "  → FOUND at [{}][{}]: {} (text: '{}')",
    "fix_row_name": "  → Update row_name: '{}' → '{}'",
    "fix_col_name": "  → Update col_name: '{}' → '{}'",
    "fix_place": "  → Update indices: row_idx: {} → {}, col_idx: {} → {}",
}


def say(what: str, *values: Column) -> Column:
    """A sentence of SAYS with its values, nulls spelled ``None``."""
    parts = [F.lit(p) for p in SAYS[what].split("{}")]
    said = [F.coalesce(v.cast("string"), F.lit("None")) for v in values]
    return F.concat(*[x for pair in zip(parts, said, strict=False) for x in pair], parts[-1])


def last_packs(packs: DataFrame, order: list[str | Column]) -> DataFrame:
    """Packs by table id, the last by ``order`` where ids repeat; packs without id are left out."""
    last = Window.partitionBy("table_id").orderBy(*[F.desc(c) if isinstance(c, str) else c for c in order])
    return packs.where("table_id is not null and table_id <> ''").withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def near_cells(rows: Column, r: Column, c: Column, places=BESIDE) -> Column:
    """(r, c, text) of the cells at ``places`` around one that exist, in that order."""
    at = F.array(*[F.struct((r + dr).alias("r"), (c + dc).alias("c"), F.get(F.get(rows, r + dr), c + dc).alias("text")) for dr, dc in places])
    return F.filter(at, lambda x: x["text"].isNotNull())


def find_label(labels: Column, name: Column) -> Column:
    """Place of the first label that equals the name, any case; null without one."""
    place = F.array_position(F.transform(labels, lambda x: F.lower(S.strip(x))), F.lower(S.strip(name))).cast("int")
    return F.nullif(place, F.lit(0)) - 1


def find_headers(headers: Column, name: Column) -> Column:
    """Places of all headers that equal the name, any case."""
    at = F.transform(headers, lambda h, i: F.struct(i.alias("i"), h.alias("h")))
    return F.transform(F.filter(at, lambda x: F.lower(S.strip(x["h"])) == F.lower(S.strip(name))), lambda x: x["i"])


def validate(kpis: DataFrame, packs: DataFrame) -> DataFrame:
    """Each KPI whose table exists with is_valid, confidence, errors, fix_instructions and the source cell.

    ``kpis`` has table_id, name, key, value (text or number), year, units, row_idx, col_idx, row_name, col_name.
    """
    src = packs.select("table_id", F.col("rows").alias("p_rows"), F.coalesce("stub_col", F.array().cast("array<string>")).alias("p_stub"), F.coalesce("merged_headers", F.array().cast("array<string>")).alias("p_head"), F.col("title").alias("p_title"), F.col("section_name").alias("p_section"))
    df = kpis.join(src, "table_id")
    none = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    r, c = F.col("row_idx"), F.col("col_idx")
    n_rows, n_cols = F.coalesce(F.size("p_rows"), F.lit(0)), F.coalesce(F.size(F.get("p_rows", r)), F.lit(0))
    stop = (
        F.when(~none("name") & ~none("key") & (S.strip(F.col("name")) == S.strip(F.col("key"))), "same_name")
        .when(r.isNull(), "no_row").when(c.isNull(), "no_col").when(n_rows == 0, "no_rows")
        .when((r < 0) | (r >= n_rows), "row_bounds").when((c < 0) | (c >= n_cols), "col_bounds")
    )
    df = df.withColumn("stop", stop)
    df = df.withColumn("stub", F.when(r < F.size("p_stub"), F.get("p_stub", r))).withColumn("head", F.when(c < F.size("p_head"), F.get("p_head", c)))

    def named(said: str, want: str, has: Column) -> Column:
        a, b = S.strip(F.col(said)), S.strip(F.coalesce(F.col(want), F.lit("None")))
        return F.when(~F.coalesce(has, F.lit(False)), "absent").when(none(said), "missing").when(a == b, "equal").when(F.lower(a) == F.lower(b), "case").otherwise("differs")

    df = df.withColumn("row_check", named("row_name", "stub", r < F.size("p_stub"))).withColumn("col_check", named("col_name", "head", c < F.size("p_head")))
    row = F.col("row_check")
    col = F.col("col_check")
    conf = F.when(row == "case", 0.98).when(row == "missing", 0.95).when(row == "differs", 0.5).otherwise(1.0)
    conf = conf * F.when(col == "case", 0.98).when(col == "missing", 0.95).when(col == "differs", 0.9).otherwise(1.0)
    df = df.withColumn("conf", conf)
    cell = F.get(F.get("p_rows", r), c)
    beside = F.get(F.get("p_rows", r), c + 1)
    df = df.withColumn("cell", cell).withColumn("found", S.parse_number(cell)).withColumn("beside", beside).withColumn("beside_found", S.parse_number(beside))
    # a label column cited for the value column beside it
    shift = F.col("found").isNull() & (c == 0) & F.col("beside_found").isNotNull() & ~none("col_name") & (S.strip(F.col("col_name")) == S.strip(F.get("p_head", F.lit(1))))
    df = df.withColumn("shift", F.coalesce(shift, F.lit(False)))
    df = df.withColumn("conf", F.when(F.col("shift"), F.col("conf") * 0.95).otherwise(F.col("conf")))
    df = df.withColumn("source", F.when(F.col("shift"), F.col("beside_found")).otherwise(F.col("found")))
    df = df.withColumn("number", S.to_double(S.strip(F.col("value").cast("string"))))
    gap = F.abs(F.col("source") - F.col("number"))
    rel = gap / F.greatest(F.abs("source"), F.lit(1e-9))
    gap2 = F.abs(F.col("beside_found") - F.col("number"))
    rel2 = gap2 / F.greatest(F.abs("beside_found"), F.lit(1e-9))
    df = df.withColumn("gap", gap).withColumn("rel", rel).withColumn("gap2", gap2).withColumn("rel2", rel2)
    better = (F.col("gap2") <= 1e-6) | ((F.col("rel2") < 0.01) & (F.col("rel2") < F.col("rel") * 0.5))
    outcome = (
        F.when(F.col("stop").isNotNull(), F.col("stop"))
        .when(F.col("value").isNull() & F.col("source").isNull(), "both_null").when(F.col("value").isNull(), "value_null").when(F.col("source").isNull(), "source_null")
        .when(F.col("number").isNull(), "not_number").when(F.col("gap") <= 1e-6, "exact").when(F.col("rel") < 0.01, "small").when(F.col("rel") < 0.05, "moderate")
        .when(F.coalesce(better, F.lit(False)), "beside").otherwise("large")
    )
    df = df.withColumn("outcome", outcome)
    o = F.col("outcome")
    early = o.isin("same_name", "no_row", "no_col", "no_rows", "row_bounds", "col_bounds")
    ok = F.when(o == "beside", True).when(o.isin("both_null", "exact", "small"), row != "differs").otherwise(False)
    near = F.when(F.col("gap2") <= 1e-6, 0.95).otherwise(0.95 * 0.98)
    confidence = (
        F.when(o == "same_name", 0.5).when(early | (o == "not_number"), 0.0).when(o.isin("value_null", "source_null"), 0.2).when(o == "moderate", 0.7).when(o == "large", 0.3)
        .when(o == "both_null", F.col("conf") * 0.95).when(o == "small", F.col("conf") * 0.98).when(o == "beside", F.col("conf") * near).otherwise(F.col("conf"))
    )
    go = ~early
    show = lambda x, d: F.format_string(f"%.{d}f", x)
    col_ = F.col
    gap_, gap2_ = col_("gap"), col_("gap2")
    errors = F.array_compact(F.array(
        F.when(o == "same_name", say("same_name", col_("key"))), F.when(o == "no_row", say("no_row")), F.when(o == "no_col", say("no_col")), F.when(o == "no_rows", say("no_rows")),
        F.when(o == "row_bounds", say("row_bounds", r, n_rows)), F.when(o == "col_bounds", say("col_bounds", c, n_cols)),
        F.when(go & (row == "equal"), say("row_equal", col_("row_name"))), F.when(go & (row == "case"), say("row_case", col_("row_name"), col_("stub"))),
        F.when(go & (row == "differs"), say("row_differs", col_("row_name"), r, col_("stub"))), F.when(go & (row == "missing"), say("row_missing", r, col_("stub"))),
        F.when(go & (col == "equal"), say("col_equal", col_("col_name"))), F.when(go & (col == "case"), say("col_case", col_("col_name"), col_("head"))),
        F.when(go & (col == "differs"), say("col_differs", col_("col_name"), c, col_("head"))), F.when(go & (col == "missing"), say("col_missing", c, col_("head"))),
        F.when(go & col_("shift"), say("shift", col_("beside_found"))), F.when(o == "both_null", say("both_null", col_("cell"))),
        F.when(o == "value_null", say("value_null", col_("source"), col_("cell"))), F.when(o == "source_null", say("source_null", col_("value"), col_("cell"))),
        F.when(o == "not_number", say("not_number", col_("value"), col_("source"))), F.when(o == "small", say("small", show(gap_, 6))),
        F.when(o == "moderate", say("moderate", col_("number"), col_("source"), show(gap_, 2))), F.when(o == "beside", say("beside", c, c + 1, col_("source"), col_("beside_found"))),
        F.when((o == "beside") & (gap2_ > 1e-6), say("beside_small", show(gap2_, 6))), F.when(o == "large", say("large", col_("number"), col_("source"), show(gap_, 2))),
    ))
    hits = F.when(o == "moderate", F.filter(near_cells(F.col("p_rows"), r, c, BESIDE), lambda x: S.parse_number(x["text"]) == F.col("number"))).when(
        o == "large", F.filter(near_cells(F.col("p_rows"), r, c, AROUND), lambda x: F.abs(S.parse_number(x["text"]) - F.col("number")) <= 1e-6)
    )
    df = df.withColumn("label_at", F.when(go & (row == "differs"), find_label(F.col("p_stub"), F.col("row_name")))).withColumn("headers_at", F.when(go & (col == "differs"), find_headers(F.col("p_head"), F.col("col_name")))).withColumn("hits", hits)
    nothing = F.array().cast("array<string>")
    fixes = F.concat(
        F.when(o == "same_name", F.array(say("fix_name", col_("key"), col_("name")), say("fix_title", F.coalesce("p_title", F.lit(""))), say("fix_section", F.coalesce("p_section", F.lit(""))), say("fix_current", F.coalesce("row_name", F.lit(""))),
            say("fix_which"), say("fix_vehicles", col_("key")), say("fix_company", col_("name")), say("fix_read"))).otherwise(nothing),
        F.when(go & (row == "differs"), F.array_compact(F.array(
            say("fix_row", r), say("fix_row_is", col_("row_name"), r, col_("stub")), say("fix_row_how", S.strip(col_("row_name"))),
            F.when(col_("label_at").isNotNull(), say("fix_row_at", col_("label_at"), col_("label_at"), F.get("p_stub", col_("label_at")))), F.when(col_("label_at").isNotNull(), say("fix_row_to", r, col_("label_at"), col_("stub"), F.get("p_stub", col_("label_at"))))))).otherwise(nothing),
        F.when(go & (col == "differs"), F.concat(
            F.array(say("fix_col", c), say("fix_col_is", col_("col_name"), c, col_("head")), say("fix_col_how", S.strip(col_("col_name")))),
            F.flatten(F.transform("headers_at", lambda i: F.array(say("fix_col_at", i, i, F.get("p_head", i)), say("fix_col_to", c, i, col_("head"), F.get("p_head", i))))),
        )).otherwise(nothing),
        F.when(o.isin("moderate", "large"), F.concat(
            F.array(F.when(o == "moderate", say("fix_moderate")).otherwise(say("fix_large")), say("fix_extracted", col_("number")), say("fix_source", r, c, col_("source"), col_("cell")),
                F.when(o == "moderate", say("fix_beside")).otherwise(say("fix_around", col_("number")))),
            F.flatten(F.transform("hits", lambda x: F.array_compact(F.array(
                F.when(o == "moderate", say("fix_found", col_("number"), x["r"], x["c"], x["r"], x["c"], x["text"])).otherwise(say("fix_found_near", x["r"], x["c"], S.parse_number(x["text"]), x["text"])),
                say("fix_place", r, x["r"], c, x["c"]),
                F.when((o == "large") & (x["r"] < F.size("p_stub")), say("fix_row_name", col_("row_name"), F.get("p_stub", x["r"]))),
                F.when((o == "large") & (x["c"] < F.size("p_head")), say("fix_col_name", col_("col_name"), F.get("p_head", x["c"]))),
            )))),
        )).otherwise(nothing),
    )
    moved = go & ((o == "beside") | F.col("shift"))
    at = F.when(o == "beside", c + 1).when(F.col("shift"), F.lit(1)).otherwise(c)
    placed = ~o.isin("same_name", "no_row", "no_col", "no_rows")
    return df.select(
        *kpis.columns, S.kept(F.col("outcome")).alias("outcome"), S.kept(F.coalesce(ok, F.lit(False))).alias("is_valid"), confidence.alias("confidence"), S.kept(errors).alias("errors"), S.kept(fixes).alias("fix_instructions"),
        F.when(go, F.when(o == "beside", F.col("beside_found")).otherwise(F.col("source"))).alias("source_cell_value"),
        F.when(go, F.when(moved, F.col("beside")).otherwise(F.col("cell"))).alias("source_cell_text"), F.col("value").alias("extracted_value"),
        F.when(placed, r).alias("checked_row_idx"), F.when(placed, at).alias("checked_col_idx"),
        F.when(go, F.col("stub")).alias("row_name_match"), F.when(go, F.when(moved, F.get("p_head", at)).otherwise(F.col("head"))).alias("col_name_match"),
        F.col("row_check"), F.col("col_check"), "label_at", F.get("hits", F.lit(0)).alias("hit"),
    )


def statistics(checked: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and accuracy (percent, 0.0 of none) for each group, or over all.

    ``*_compat`` counters are 0 throughout, as the texts that they look for are never written; those without the
    suffix count what they name.
    """
    go = ~F.col("outcome").isin("same_name", "no_row", "no_col", "no_rows", "row_bounds", "col_bounds")
    n, v = F.count("*"), F.count_if("is_valid")
    return (checked.groupBy(*by) if by else checked).agg(
        n.alias("total_kpis"), v.alias("valid_kpis"), F.count_if(~F.col("is_valid")).alias("invalid_kpis"), F.countDistinct("table_id").alias("tables_processed"),
        F.count_if(go & (F.col("row_check") == "equal")).alias("row_name_verified"), F.count_if(go & (F.col("col_check") == "equal")).alias("col_name_verified"),
        F.count_if(go & (F.col("row_check") == "differs")).alias("row_name_mismatches"), F.count_if(go & (F.col("col_check") == "differs")).alias("col_name_mismatches"),
        F.count_if(F.col("outcome") == "same_name").alias("name_mismatches"), F.lit(0).cast("long").alias("row_name_mismatches_compat"), F.lit(0).cast("long").alias("col_name_mismatches_compat"),
        F.when(n > 0, v / n * 100).otherwise(F.lit(0.0)).alias("accuracy"),
    )


def error_histogram(checked: DataFrame) -> DataFrame:
    """(error_type, n, mean_confidence): errors by their text before the first colon, and the confidence of their KPIs."""
    said = checked.select(F.explode("errors").alias("e"), "confidence")
    return said.groupBy(F.substring_index("e", ":", 1).alias("error_type")).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"))


def iteration_statistics(settled: DataFrame) -> DataFrame:
    """(table_id, iteration, total_kpis, valid_kpis, invalid_kpis, accuracy) of each round of ``extract.correct``.

    A table has rounds until all its KPIs are valid, or the last round.
    """
    of = settled.groupBy("table_id", "iteration").agg(F.count("*").alias("n"), F.count_if("is_valid").alias("v"))
    so_far = Window.partitionBy("table_id").orderBy("iteration")
    table = of.groupBy("table_id").agg(F.sum("n").alias("total_kpis"), F.max("iteration").alias("last"))
    rounds = table.select("table_id", "total_kpis", F.explode(F.sequence(F.lit(1), "last")).alias("iteration"))
    out = rounds.join(of.select("table_id", "iteration", "v"), ["table_id", "iteration"], "left").withColumn("valid_kpis", F.sum(F.coalesce("v", F.lit(0))).over(so_far))
    return out.select("table_id", "iteration", "total_kpis", "valid_kpis", (F.col("total_kpis") - F.col("valid_kpis")).alias("invalid_kpis"), (F.col("valid_kpis") / F.col("total_kpis") * 100).alias("accuracy"))


def valid_report(checked: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Valid KPIs with evidence, at the places that were given, not at corrected ones; columns ``carry`` go with them."""
    ev = F.struct("table_id", "row_idx", "col_idx", "row_name", "col_name")
    return checked.where("is_valid").select(*(carry or ()), "name", "key", "units", "value", "year", ev.alias("evidence"))


def invalid_report(checked: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Invalid KPIs, without value, with their validation; columns ``carry`` go with them."""
    kpi = F.struct("name", "key", "units", "year", "row_idx", "col_idx", "row_name", "col_name")
    v = F.struct("is_valid", "confidence", "errors", "fix_instructions", "source_cell_value", "source_cell_text", "extracted_value", F.col("checked_row_idx").alias("row_idx"), F.col("checked_col_idx").alias("col_idx"), "row_name_match", "col_name_match")
    return checked.where("not is_valid").select(*(carry or ()), "table_id", kpi.alias("kpi"), v.alias("validation"))


def plausibility(kpis: DataFrame) -> DataFrame:
    """KPIs with ``doubts``: missing fields, thousands that look like units, years against the table id, negative places."""
    v = S.to_double(F.col("value").cast("string"))
    doubts = F.array_compact(F.array(
        F.when(F.col("name").isNull() | F.col("year").isNull(), "missing_field"),
        F.when(F.lower("units").contains("thousand") & (F.abs(v) >= 1e6), "unit_magnitude"),
        F.when((S.table_year_medium(F.col("table_id")) != F.col("year")) & (F.abs(S.table_year_medium(F.col("table_id")) - F.col("year")) > 1), "year_mismatch"),
        F.when((F.col("row_idx") < 0) | (F.col("col_idx") < 1), "bad_place"),
    ))
    return kpis.withColumn("doubts", doubts)
