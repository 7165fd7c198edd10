"""The star-schema test tables as report packs and extracted KPIs, so every operator has whole tables to run over.

Facts are yearly order counts and revenues of nations. Each region and year is one pack, in the layout that the
region's key says; dates are moved ten years on, as headers name years 20xx.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LAYOUTS = ("type_1", "type_2", "type_3", "type_4", "unknown_format")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n_regionkey, r_name, n_name, year, oc, sr): orders and revenue, whole, by nation and year.

    Orders are summed by customer before they meet the small tables, so what is shuffled is sums.
    """
    o = table(spark, sf_dir, "orders").select("o_custkey", (F.year("o_orderdate") + 10).alias("year"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    by = o.groupBy("o_custkey", "year").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    joined = by.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_regionkey", "r_name", "n_name", "year").agg(F.sum("n").alias("oc"), F.expr("sum(cents) div 100").alias("sr"))


def packs(spark: SparkSession, sf_dir: str, layout: str | None = None) -> DataFrame:
    """Report packs; of one layout or all."""
    f = yearly(spark, sf_dir)
    if layout is not None:
        f = f.where(F.col("n_regionkey") == LAYOUTS.index(layout))
    by = Window.partitionBy("n_name").orderBy("year")
    near = F.lag("year").over(by) == F.col("year") - 1
    w = f.withColumn("ocp", F.when(near, F.lag("oc").over(by))).withColumn("srp", F.when(near, F.lag("sr").over(by)))
    k = F.col("n_regionkey") % 5
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("–"))
    noted = lambda c: F.when(F.col(c).isNotNull() & (F.col("year") % 3 == 0), F.concat(plain(c), F.lit(" ^1"))).otherwise(plain(c))
    parted = lambda c: F.coalesce(F.format_number(F.col(c), 0), F.lit("–"))
    label = F.when(k.isin(2, 3), F.concat("n_name", F.lit(" (units)"))).otherwise(F.col("n_name"))
    row = (
        F.when(k.isin(0, 4), F.array(label, noted("oc"), noted("ocp"), parted("sr"), parted("srp"))).when(k == 1, F.array(label, noted("oc"), noted("ocp")))
        .when(k == 2, F.array(label, F.lit("thousands"), noted("oc"), noted("ocp"), F.lit("1.5"))).otherwise(F.array(label, noted("oc"), noted("ocp"), F.lit("1.5")))
    )
    y, p = F.col("year").cast("string"), (F.col("year") - 1).cast("string")
    four = [F.concat(F.lit(m), t) for m in ("ORDER COUNT ", "SALES REVENUE ") for t in (y, p)]
    head = (
        F.when(k == 0, F.array(F.lit(""), *four)).when(k == 4, F.array(F.lit("Thousand vehicles/€ million"), *four)).when(k == 1, F.array(F.lit("Units"), y, p))
        .when(k == 2, F.array(F.lit(""), F.lit(""), y, p, F.lit("%"))).otherwise(F.array(F.lit(""), y, p, F.lit("%")))
    )
    title = F.when(k == 1, F.concat("r_name", F.lit(" PRODUCTION"))).when(k == 3, F.concat("r_name", F.lit(" TRADE – KEY FIGURES"))).otherwise(F.lit("Key Figures"))
    # one row for each nation of a region: a pack's rows are as many as that
    rows = F.array_sort(F.collect_list(F.struct(label.alias("l"), row.alias("r"))))
    df = w.groupBy("n_regionkey", "r_name", "year").agg(rows.alias("x"))
    return df.select(
        F.concat(F.lit("VW"), y, F.lit("_T"), F.col("n_regionkey").cast("string")).alias("table_id"), F.concat(F.lit("VW"), y).alias("doc_id"), "year", F.col("n_regionkey").alias("page"), F.lit(None).cast("string").alias("bucket"),
        F.col("r_name").alias("section_name"), title.alias("title"), F.array(head).alias("headers"), head.alias("merged_headers"), F.transform("x", lambda s: s["r"]).alias("rows"), F.transform("x", lambda s: s["l"]).alias("stub_col"),
    )


def raw_kpis(spark: SparkSession, sf_dir: str, layout: str | None = None) -> DataFrame:
    """KPIs as extracted from the packs of one layout or all, with faults by (3 * row + column + year) % 10."""
    from kpiloom.operators.melt import facts

    f = facts(packs(spark, sf_dir, layout)).select("kpi_name", "key", "units", "value", "year", "evidence.*")
    fault = (3 * F.col("row_idx") + F.col("col_idx") + F.col("year")) % 10
    value = F.when(fault == 0, None).when(fault == 1, F.col("value") * 1.03).when(fault == 2, F.col("value") * 1.4).otherwise(F.col("value"))
    return f.select(
        "table_id", F.when(fault == 4, F.col("key")).otherwise(F.col("kpi_name")).alias("name"), "key", "units", value.cast("string").alias("value"), "year",
        F.when(fault == 8, F.lower("key")).otherwise(F.col("key")).alias("row_name"), F.when(fault == 3, F.col("row_idx") + 1).otherwise(F.col("row_idx")).alias("row_idx"),
        F.when(fault == 7, F.lit("Total")).otherwise(F.col("year").cast("string")).alias("col_name"), F.when(fault == 5, F.lit(None).cast("int")).when(fault == 6, F.lit(99)).when(fault == 9, F.col("col_idx") - 1).otherwise(F.col("col_idx")).alias("col_idx"),
        F.lit("rules").alias("source_model"),
    )


#: DuckDB: yearly facts ``f``, pack rows ``w``, and the facts that reading the packs must give, ``facts``.
SQL = """
WITH f AS (SELECT n_regionkey, r_name, n_name, CAST(year(o_orderdate) AS INT) + 10 AS year, count(*) AS oc, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) // 100 AS BIGINT) AS sr
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
w AS (SELECT a.*, p.oc AS ocp, p.sr AS srp, CAST(row_number() OVER (PARTITION BY a.n_regionkey, a.year ORDER BY a.n_name) - 1 AS INT) AS row_idx, 'VW' || a.year || '_T' || a.n_regionkey AS table_id
  FROM f a LEFT JOIN f p ON a.n_name = p.n_name AND p.year = a.year - 1),
long AS (SELECT *, 1 AS c, 'order count' AS m, oc AS v, year AS y FROM w UNION ALL SELECT *, 2, 'order count', ocp, year - 1 FROM w
  UNION ALL SELECT *, 3, 'sales revenue', sr, year FROM w UNION ALL SELECT *, 4, 'sales revenue', srp, year - 1 FROM w),
facts AS (SELECT CASE n_regionkey % 5 WHEN 0 THEN 'type_1' WHEN 1 THEN 'type_2' WHEN 2 THEN 'type_3' WHEN 3 THEN 'type_4' ELSE 'unknown_format' END AS layout,
  CASE n_regionkey % 5 WHEN 0 THEN m WHEN 4 THEN m WHEN 1 THEN array_to_string(list_slice(string_split(lower(r_name) || ' production', ' '), 1, 2), '_') ELSE n_name END AS kpi_name,
  CASE n_regionkey % 5 WHEN 2 THEN n_name || ' (units)' WHEN 3 THEN lower(replace(r_name, ' ', '_')) || '_trade' ELSE n_name END AS key,
  CAST(v AS DOUBLE) AS value, CAST(y AS INT) AS year,
  CASE n_regionkey % 5 WHEN 0 THEN 'N/A' WHEN 4 THEN CASE WHEN c <= 2 THEN 'Thousand vehicles' ELSE '€ million' END WHEN 1 THEN 'Units' ELSE 'units' END AS units,
  table_id, row_idx, CAST(CASE n_regionkey % 5 WHEN 2 THEN c + 1 ELSE c END AS INT) AS col_idx
  FROM long WHERE v IS NOT NULL AND (n_regionkey % 5 IN (0, 4) OR c <= 2)),
nodes AS (SELECT * EXCLUDE (rn) FROM (SELECT replace(replace(kpi_name || '_' || key || '_' || year, ' ', '_'), '/', '_') AS id, *,
  row_number() OVER (PARTITION BY replace(replace(kpi_name || '_' || key || '_' || year, ' ', '_'), '/', '_') ORDER BY table_id DESC, row_idx DESC, col_idx DESC) AS rn FROM facts) WHERE rn = 1),
ny AS (SELECT kpi_name, key, year, lead(year) OVER (PARTITION BY kpi_name, key ORDER BY year) AS next_year FROM (SELECT DISTINCT kpi_name, key, year FROM nodes)),
edges AS (SELECT DISTINCT s.id AS source, t.id AS target, t.year - s.year AS year_diff, 'temporal' AS edge_type FROM nodes s JOIN ny ON s.kpi_name = ny.kpi_name AND s.key = ny.key AND s.year = ny.year
  JOIN nodes t ON t.kpi_name = ny.kpi_name AND t.key = ny.key AND t.year = ny.next_year),
kp AS (SELECT *, (3 * row_idx + col_idx + year) % 10 AS fault FROM facts),
raw AS (SELECT table_id, CASE WHEN fault = 4 THEN key ELSE kpi_name END AS name, key, units, CASE fault WHEN 0 THEN NULL WHEN 1 THEN value * 1.03 WHEN 2 THEN value * 1.4 ELSE value END AS value, year,
  CASE WHEN fault = 8 THEN lower(key) ELSE key END AS row_name, CASE WHEN fault = 3 THEN row_idx + 1 ELSE row_idx END AS row_idx,
  CASE WHEN fault = 7 THEN 'Total' ELSE CAST(year AS VARCHAR) END AS col_name, CASE fault WHEN 5 THEN NULL WHEN 6 THEN 99 WHEN 9 THEN col_idx - 1 ELSE col_idx END AS col_idx FROM kp),
stubs AS (SELECT table_id, n_regionkey, row_idx, n_name || CASE WHEN n_regionkey IN (2, 3) THEN ' (units)' ELSE '' END AS stub FROM w),
grid AS (SELECT table_id, row_idx, CASE n_regionkey WHEN 2 THEN c + 1 ELSE c END AS col_idx,
  CASE WHEN v IS NULL THEN '–' WHEN c > 2 THEN format('{:,}', v) WHEN year % 3 = 0 THEN v || ' ^1' ELSE CAST(v AS VARCHAR) END AS text, CASE WHEN c > 2 AND v BETWEEN 1000 AND 999999 THEN v / 1000 ELSE CAST(v AS DOUBLE) END AS num
  FROM long WHERE n_regionkey IN (0, 4) OR c <= 2
  UNION ALL SELECT table_id, row_idx, 0, stub, NULL FROM stubs UNION ALL SELECT table_id, row_idx, 1, 'thousands', NULL FROM stubs WHERE n_regionkey = 2
  UNION ALL SELECT table_id, row_idx, n_regionkey + CASE n_regionkey WHEN 2 THEN 2 ELSE 0 END, '1.5', 1.5 FROM stubs WHERE n_regionkey IN (2, 3)),
n AS (SELECT table_id, count(*) AS n_rows, CASE min(n_regionkey) WHEN 1 THEN ['Units', y, p] WHEN 2 THEN ['', '', y, p, '%'] WHEN 3 THEN ['', y, p, '%']
  ELSE [CASE min(n_regionkey) WHEN 4 THEN 'Thousand vehicles/€ million' ELSE '' END, 'ORDER COUNT ' || y, 'ORDER COUNT ' || p, 'SALES REVENUE ' || y, 'SALES REVENUE ' || p] END AS heads
  FROM (SELECT table_id, n_regionkey, CAST(year AS VARCHAR) AS y, CAST(year - 1 AS VARCHAR) AS p FROM w) GROUP BY table_id, y, p),
looked AS (SELECT raw.*, n_rows, len(heads) AS n_cols, stub, heads[raw.col_idx + 1] AS head, heads[2] AS head1, s.num AS found, b.num AS beside
  FROM raw JOIN n ON n.table_id = raw.table_id LEFT JOIN stubs sb ON sb.table_id = raw.table_id AND sb.row_idx = raw.row_idx
  LEFT JOIN grid s ON s.table_id = raw.table_id AND s.row_idx = raw.row_idx AND s.col_idx = raw.col_idx LEFT JOIN grid b ON b.table_id = raw.table_id AND b.row_idx = raw.row_idx AND b.col_idx = raw.col_idx + 1),
st AS (SELECT *, CASE WHEN name = key THEN 'same_name' WHEN col_idx IS NULL THEN 'no_col' WHEN row_idx >= n_rows THEN 'row_bounds' WHEN col_idx >= n_cols THEN 'col_bounds' END AS stop,
  CASE WHEN stub IS NULL THEN 'absent' WHEN row_name = stub THEN 'equal' WHEN lower(row_name) = lower(stub) THEN 'case' ELSE 'differs' END AS row_check,
  CASE WHEN head IS NULL THEN 'absent' WHEN col_name = head THEN 'equal' ELSE 'differs' END AS col_check, found IS NULL AND col_idx = 0 AND beside IS NOT NULL AND col_name = head1 AS shift FROM looked),
g AS (SELECT *, CASE WHEN shift THEN beside ELSE found END AS source, CASE row_check WHEN 'case' THEN 0.98::DOUBLE WHEN 'differs' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END * CASE col_check WHEN 'differs' THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN shift THEN 0.95::DOUBLE ELSE 1.0::DOUBLE END AS conf FROM st),
d AS (SELECT *, abs(source - value) AS gap, abs(source - value) / greatest(abs(source), 1e-9) AS rel, abs(beside - value) AS gap2, abs(beside - value) / greatest(abs(beside), 1e-9) AS rel2 FROM g),
o AS (SELECT *, CASE WHEN stop IS NOT NULL THEN stop WHEN value IS NULL AND source IS NULL THEN 'both_null' WHEN value IS NULL THEN 'value_null' WHEN source IS NULL THEN 'source_null' WHEN gap <= 1e-6 THEN 'exact'
  WHEN rel < 0.01 THEN 'small' WHEN rel < 0.05 THEN 'moderate' WHEN coalesce(gap2 <= 1e-6 OR (rel2 < 0.01 AND rel2 < rel * 0.5), false) THEN 'beside' ELSE 'large' END AS outcome FROM d),
checked AS (SELECT *, CASE WHEN outcome = 'beside' THEN true WHEN outcome IN ('both_null', 'exact', 'small') THEN row_check <> 'differs' ELSE false END AS is_valid,
  CASE WHEN outcome = 'same_name' THEN 0.5 WHEN stop IS NOT NULL THEN 0.0 WHEN outcome IN ('value_null', 'source_null') THEN 0.2 WHEN outcome = 'moderate' THEN 0.7 WHEN outcome = 'large' THEN 0.3 WHEN outcome = 'both_null' THEN conf * 0.95
  WHEN outcome = 'small' THEN conf * 0.98 WHEN outcome = 'beside' THEN conf * CASE WHEN gap2 <= 1e-6 THEN 0.95::DOUBLE ELSE 0.95::DOUBLE * 0.98::DOUBLE END ELSE conf END AS confidence FROM o),
lk AS (SELECT kpi_name AS name, key, year, CAST(CAST(value AS BIGINT) AS VARCHAR) || '.0' AS value, units, id AS ord FROM nodes),
linked AS (SELECT *, lead(kpi_id) OVER (PARTITION BY name, key ORDER BY year, ord) AS next_kpi_id, lag(kpi_id) OVER (PARTITION BY name, key ORDER BY year, ord) AS prev_kpi_id
  FROM (SELECT *, sha256(name || '|' || key || '|' || year || '|' || value) AS kpi_id FROM lk)),
ch AS (SELECT name, key, count(*) AS length, min(year) AS first_year, max(year) AS last_year FROM linked WHERE next_kpi_id IS NOT NULL OR prev_kpi_id IS NOT NULL GROUP BY name, key)
"""
