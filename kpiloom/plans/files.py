"""Queries over files: each sink writes whole tables to the shared folder, each source reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from kpiloom.functions import scalars as S
from kpiloom.operators import chains, extract, graph, validate
from kpiloom.plans import jobs
from kpiloom.plans.bridge import packs, raw_kpis, table
from kpiloom.plans.registry import ORACLES, QUERIES, _add, _checked, _links, _nodes
from kpiloom.schemas import KPI
from kpiloom.sources import packs as source
from kpiloom.sources import shared, sinks, sqlite

__all__ = ["ORACLES", "QUERIES"]

#: SQL: the year that a table id of the test packs names.
_YEAR = "substring(table_id, 3, 4)"


def _kpis(spark, d):
    """(table_id, kpis) as extracted, faults and all."""
    kpi = F.struct(*extract.KPI_COLUMNS).cast(KPI)
    return raw_kpis(spark, d).groupBy("table_id").agg(F.collect_list(kpi).alias("kpis"))


def _extractions(spark, d) -> str:
    """Extraction files, one for each year: envelopes of ``results`` in even years, of ``tables`` in odd ones."""
    path = shared.new(spark, "extractions")
    by = _kpis(spark, d).withColumn("file_year", F.expr(_YEAR)).groupBy("file_year")
    all_ = by.agg(F.collect_list(F.struct("table_id", "kpis")).alias("r"))
    even = F.col("file_year").cast("int") % 2 == 0
    tables = F.transform("r", lambda x: F.struct(x["table_id"].alias("table_id"), F.struct(x["kpis"].alias("kpis")).alias("extraction_result")))
    meta = F.struct(F.lit("rules").alias("model")).alias("metadata")
    sinks.named(all_.select("file_year", meta, F.when(even, F.col("r")).alias("results"), F.when(~even, tables).alias("tables")), path, "file_year", "kpis_linked_tables({}).json")
    return path


def _pack_files(spark, d) -> str:
    """Files of packs, one for each year, that name it."""
    path = shared.new(spark, "packs")
    sinks.named(packs(spark, d).withColumn("file_year", F.expr(_YEAR)), path, "file_year", "linked_tables({}).jsonl")
    return path


@_add("jsonl_scan", "SELECT 'linked_tables(' || year || ').jsonl' AS file, table_id, year, count(*) AS n_rows, min(row_idx) AS first_row, r_name AS section_name FROM w GROUP BY table_id, year, r_name")
def jsonl_scan(spark, d):
    df = source.jsonl(spark, _pack_files(spark, d)).select(F.element_at(F.split("file", "/"), -1).alias("file"), "table_id", "year", "section_name", F.posexplode("stub_col").alias("i", "label"))
    return df.groupBy("file", "table_id", "year", "section_name").agg(F.count("*").alias("n_rows"), F.min("i").alias("first_row"))


@_add("jsonl_tolerant_scan", """SELECT CASE o_orderkey % 4 WHEN 0 THEN 'T' || o_orderkey END AS table_id, CASE o_orderkey % 4 WHEN 0 THEN CAST(year(o_orderdate) AS INT) END AS year, CASE o_orderkey % 4 WHEN 1 THEN '{"table_id": ["T' || o_orderkey END AS corrupt FROM orders WHERE o_orderkey % 4 < 2""", base=False)
def jsonl_tolerant_scan(spark, d):
    key = F.col("o_orderkey").cast("string")
    whole = F.to_json(F.struct(F.concat(F.lit("T"), key).alias("table_id"), F.year("o_orderdate").alias("year")))
    kind = F.col("o_orderkey") % 4
    line = F.when(kind == 0, whole).when(kind == 1, F.concat(F.lit('{"table_id": ["T'), key)).when(kind == 2, F.concat(F.lit("  // "), whole)).otherwise(F.lit("  "))
    path = shared.new(spark, "lines")
    table(spark, d, "orders").select(line.alias("value")).write.text(path)
    return source.jsonl(spark, path, strict=False, glob="*.txt").select(F.when(F.col("corrupt").isNull(), F.col("table_id")).alias("table_id"), F.when(F.col("corrupt").isNull(), F.col("year")).alias("year"), "corrupt")


@_add("export_by_year", "SELECT CAST(year AS VARCHAR) AS table_year, table_id, count(*) AS n_rows FROM w GROUP BY year, table_id")
def export_by_year(spark, d):
    path = shared.new(spark, "by-year")
    sinks.by_year(packs(spark, d), path)
    df = source.jsonl(spark, path, glob="*.json").withColumn("table_year", F.regexp_extract("file", r"table_year=([^/]*)", 1))
    return df.select("table_year", "table_id", F.size("rows").cast("long").alias("n_rows"))


@_add("sqlite_scan", "SELECT table_id, count(*) AS n_rows, r_name AS section_name FROM w GROUP BY table_id, r_name")
def sqlite_scan(spark, d):
    return _sqlite(spark, d).select("table_id", F.size("rows").cast("long").alias("n_rows"), "section_name")


@_add("sqlite_scan_of_year", "SELECT DISTINCT table_id, CAST(row_number() OVER (ORDER BY table_id) AS INT) AS place FROM (SELECT DISTINCT table_id FROM w WHERE year = 2008) ORDER BY table_id LIMIT 3")
def sqlite_scan_of_year(spark, d):
    return _sqlite(spark, d, year=2008, limit=3).select("table_id", (F.substring("table_id", 9, 9).cast("int") + 1).alias("place"))


def _sqlite(spark, d, **options):
    """Packs through a SQLite file, which lies in the shared folder: as many rows as regions times years."""
    path = shared.new(spark, "sqlite").removeprefix("file:").replace("//", "/")
    if not path.startswith("/"):
        raise ValueError("SQLite reads files of a mounted folder only")
    from pathlib import Path

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    rows = [r.asDict(recursive=True) for r in packs(spark, d).orderBy("table_id").collect()]
    sqlite.write(path, rows)
    return sqlite.read(spark, path, partitions=2, **options)


@_add("extraction_scan", "SELECT substr(table_id, 3, 4) AS file_year, 'rules' AS model, table_id, count(*) AS n_kpis, count(value) AS n_values, count(col_idx) AS n_places FROM raw GROUP BY table_id")
def extraction_scan(spark, d):
    df = source.extractions(spark, _extractions(spark, d))
    return df.groupBy("file_year", "model", "table_id").agg(F.count("*").alias("n_kpis"), F.count("value").alias("n_values"), F.count("col_idx").alias("n_places"))


@_add("validate_files", """SELECT substr(table_id, 3, 4) AS file_year, count(*) AS total_kpis, count(*) FILTER (is_valid) AS valid_kpis, count(DISTINCT table_id) AS tables_processed, count(*) FILTER (stop IS NULL AND row_check = 'equal') AS row_name_verified,
  count(*) FILTER (stop IS NULL AND row_check = 'differs') AS row_name_mismatches, count(*) FILTER (stop IS NULL AND col_check = 'differs') AS col_name_mismatches, count(*) FILTER (outcome = 'same_name') AS name_mismatches FROM checked GROUP BY ALL""")
def validate_files(spark, d):
    by_file, _ = jobs.validate_files(spark, _extractions(spark, d), _pack_files(spark, d), shared.new(spark, "reports"))
    return by_file.select("file_year", "total_kpis", "valid_kpis", "tables_processed", "row_name_verified", "row_name_mismatches", "col_name_mismatches", "name_mismatches")


@_add("report_files", "SELECT is_valid, table_id, name, key, year FROM checked")
def report_files(spark, d):
    path = shared.new(spark, "reports")
    checked = shared.written(_checked(spark, d), "checked")
    sinks.reports(validate.valid_report(checked), validate.invalid_report(checked), path)
    kpi = "name string, key string, year int"
    valid = spark.read.schema(f"{kpi}, evidence struct<table_id:string>").json(f"{path}/valid").select(F.lit(True).alias("is_valid"), "evidence.table_id", "name", "key", "year")
    invalid = spark.read.schema("table_id string, kpi struct<name:string,key:string,year:int>").json(f"{path}/invalid")
    return valid.unionByName(invalid.select(F.lit(False).alias("is_valid"), "table_id", "kpi.name", "kpi.key", "kpi.year"))


@_add("valid_kpi_scan", "SELECT 'valid_' || year || '.json' AS file, name, key, year, table_id, row_idx, col_idx FROM checked WHERE is_valid")
def valid_kpi_scan(spark, d):
    path = shared.new(spark, "valid")
    of = validate.valid_report(_checked(spark, d)).groupBy(F.col("year").cast("string").alias("of")).agg(F.collect_list(F.struct("name", "key", "units", "value", "year", "evidence")).alias("valid_kpis"))
    sinks.named(of.withColumn("year", F.col("of")), path, "of", "valid_{}.json")
    return source.valid_kpis(spark, path).select("file", "name", "key", "year", "table_id", "row_idx", "col_idx")


@_add("latest_file", "SELECT 'valid_2.json' AS file")
def latest_file(spark, d):
    path = shared.new(spark, "latest")
    for folder, keys in (("first", "r_regionkey <> 2"), ("second", "r_regionkey = 2")):
        sinks.named(table(spark, d, "region").where(keys).select(F.col("r_regionkey").alias("of"), "r_name"), f"{path}/{folder}", "of", "valid_{}.json")
    return source.latest_file(spark, f"{path}/*", "valid_*.json").select(F.element_at(F.split("file", "/"), -1).alias("file"))


@_add("checkpoint_scan", "SELECT table_id, 'rules' AS model, count(*) AS n_kpis FROM raw GROUP BY table_id")
def checkpoint_scan(spark, d):
    path = shared.new(spark, "checkpoints")
    by = _kpis(spark, d).groupBy(F.expr(_YEAR).alias("of")).agg(F.to_json(F.collect_list(F.struct("table_id", F.lit("rules").alias("model"), "kpis"))).alias("listed"))
    envelope = F.when(F.col("of").cast("int") % 2 == 0, F.col("listed")).otherwise(F.concat(F.lit('{"results": '), F.col("listed"), F.lit("}")))
    lost = spark.range(1).select(F.lit("lost").alias("of"), F.lit('[{"table_id": "cut of').alias("value"))
    by.select("of", envelope.alias("value")).unionByName(lost).repartition("of").write.partitionBy("of").text(path)
    return source.checkpoints(spark, path).select("table_id", "model", F.size("kpis").cast("long").alias("n_kpis"))


@_add("resumed_results", "SELECT DISTINCT table_id FROM w WHERE year % 3 <> 0")
def resumed_results(spark, d):
    path = shared.new(spark, "results")
    p = packs(spark, d)
    sinks.append_results(p.where("year % 3 = 0").select("table_id", F.lit("rules").alias("model"), "year", F.lit("[]").alias("kpis")), path)
    return extract.remaining(p, source.results(spark, path)).select("table_id")


_READ = "FROM facts WHERE layout <> 'none'"


@_add("process_packs", f"SELECT 'rules' AS model, CAST(substr(table_id, 3, 4) AS INT) AS year, count(DISTINCT table_id) AS tables, count(DISTINCT table_id) AS successes, CAST(0 AS BIGINT) AS failures, count(*) AS kpis {_READ} GROUP BY ALL")
def process_packs(spark, d):
    return jobs.process_packs(packs(spark, d), {"rules": None}, shared.new(spark, "run"), rounds=1)


@_add("finalised_runs", f"SELECT CAST(substr(table_id, 3, 4) AS INT) AS year, count(DISTINCT table_id) AS tables, count(*) AS kpis, true AS complete {_READ} GROUP BY ALL")
def finalised_runs(spark, d):
    path = shared.new(spark, "run")
    jobs.process_packs(packs(spark, d), {"rules": None}, path, rounds=1)
    meta = spark.read.schema("model string, year int, total_tables_processed long, total_kpis_extracted long, complete boolean").json(f"{path}/metadata")
    return meta.select("year", F.col("total_tables_processed").alias("tables"), F.col("total_kpis_extracted").alias("kpis"), "complete")


@_add("debug_dumps", "SELECT DISTINCT table_id, 'echo' AS model, 'no kpis list' AS error FROM w WHERE year % 2 = 0")
def debug_dumps(spark, d):
    path = shared.new(spark, "debug")
    said = F.when(F.col("year") % 2 == 0, F.lit("I can't read that")).otherwise(F.lit('{"kpis": []}'))
    _, bad = extract.parse(packs(spark, d).select("table_id", F.lit("echo").alias("model"), said.alias("raw"), F.lit(None).cast("string").alias("error")))
    sinks.debug_dump(bad, path)
    return spark.read.schema("table_id string, model string, error string").json(path).select("table_id", "model", "error")


@_add("graph_export", "SELECT 'node' AS kind, id AS source, NULL AS target, year AS n FROM nodes UNION ALL SELECT 'edge', source, target, year_diff FROM edges UNION ALL SELECT 'metadata', NULL, NULL, CAST((SELECT count(*) FROM nodes) AS INT)")
def graph_export(spark, d):
    path = shared.new(spark, "graph")
    n = shared.written(_nodes(spark, d), "nodes")
    e = shared.written(graph.edges(n), "edges")
    sinks.graph(n, e, graph.metadata(n, e), path)
    none = F.lit(None).cast("string")
    nodes = spark.read.parquet(f"{path}/nodes").select(F.lit("node").alias("kind"), F.col("id").alias("source"), none.alias("target"), F.col("year").cast("int").alias("n"))
    edges = spark.read.parquet(f"{path}/edges").select(F.lit("edge"), "source", "target", F.col("year_diff").cast("int"))
    meta = spark.read.parquet(f"{path}/metadata").select(F.lit("metadata"), none, none, F.col("total_nodes").cast("int"))
    return nodes.union(edges).union(meta)


@_add("viewer_export", "SELECT 'node' AS kind, id, kpi_name, key, value, year, NULL AS source, NULL AS target FROM nodes UNION ALL SELECT 'edge', NULL, NULL, NULL, NULL, NULL, source, target FROM edges")
def viewer_export(spark, d):
    path = shared.new(spark, "viewer")
    n = shared.written(_nodes(spark, d), "nodes")
    sinks.graph_json(n, graph.edges(n), path, units=False)
    return spark.read.schema("kind string, id string, kpi_name string, key string, value double, year int, source string, target string").json(path)


@_add("links_scan", "SELECT kpi_id, name, key, year, value, next_kpi_id, prev_kpi_id FROM linked")
def links_scan(spark, d):
    path = shared.new(spark, "links")
    nodes = _links(spark, d).withColumn("of", F.pmod(F.xxhash64("name", "key"), F.lit(16))).groupBy("of").agg(F.collect_list(F.struct("kpi_id", "name", "value", "key", "year", "units", "next_kpi_id", "prev_kpi_id")).alias("nodes"))
    sinks.named(nodes.withColumn("total_nodes", F.size("nodes")), path, "of", "links_{}.json")
    return source.links(spark, path).select("kpi_id", "name", "key", "year", "value", "next_kpi_id", "prev_kpi_id")


@_add("chain_export", "SELECT kpi_id, name, key, year FROM linked")
def chain_export(spark, d):
    path = shared.new(spark, "chains")
    sinks.chains(_links(spark, d), path)
    return spark.read.parquet(path).select("kpi_id", "name", "key", "year")


@_add("header_search", "SELECT table_id, heads[CAST(i AS INT)] AS header, CAST(i - 1 AS INT) AS found FROM n, range(1, 6) t(i) WHERE i <= len(heads) AND heads[CAST(i AS INT)] <> ''")
def header_search(spark, d):
    p = packs(spark, d).select("table_id", "merged_headers", F.explode(F.array_distinct("merged_headers")).alias("header")).where("header <> ''")
    return p.select("table_id", "header", F.explode(validate.find_headers(F.col("merged_headers"), F.lower("header"))).alias("found"))


@_add("around_search", "SELECT a.table_id, a.row_idx, a.col_idx, count(*) AS n_around, count(*) FILTER (b.num IS NOT NULL) AS n_numbers FROM grid a JOIN grid b ON a.table_id = b.table_id AND greatest(abs(a.row_idx - b.row_idx), abs(a.col_idx - b.col_idx)) = 1 GROUP BY ALL")
def around_search(spark, d):
    from kpiloom.operators import melt

    c = melt.cells(packs(spark, d))
    around = validate.near_cells(F.col("rows"), F.col("row_idx"), F.col("col_idx"), validate.AROUND)
    return c.select("table_id", "row_idx", "col_idx", F.size(around).cast("long").alias("n_around"), F.size(F.filter(around, lambda x: S.parse_number(x["text"]).isNotNull())).cast("long").alias("n_numbers"))


@_add("top_coverage", "SELECT name, key, count(DISTINCT year) AS n_years, min(year) || '-' || max(year) AS year_range FROM lk GROUP BY name, key ORDER BY n_years DESC, name, key LIMIT 10")
def top_coverage(spark, d):
    return chains.top_coverage(_links(spark, d))
