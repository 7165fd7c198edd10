"""Every query of the KPI engine with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kpiloom.functions import scalars as S
from kpiloom.operators import chains, extract, graph, melt, validate
from kpiloom.plans.bridge import LAYOUTS, SQL, packs, raw_kpis, table
from kpiloom.sources import packs as pack_source
from kpiloom.sources import shared

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, sql: str | None = None, base: bool = True):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = (SQL if base else "") + sql
        return f

    return put


def _facts(spark: SparkSession, d: str, layout: str | None = None) -> DataFrame:
    return melt.facts(packs(spark, d, layout)).select("layout", "kpi_name", "key", "value", "year", "units", "evidence.table_id", "evidence.row_idx", "evidence.col_idx")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.nodes(_facts(spark, d), ["table_id", "row_idx", "col_idx"])


def _links(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d).select(F.col("kpi_name").alias("name"), "key", "year", F.concat(F.col("value").cast("long").cast("string"), F.lit(".0")).alias("value"), "units", F.col("id").alias("ord"))
    return chains.link(n)


def _checked(spark: SparkSession, d: str, layout: str | None = None) -> DataFrame:
    return validate.validate(raw_kpis(spark, d, layout), packs(spark, d, layout))


for _layout in LAYOUTS:
    _short = _layout.replace("type_", "type").replace("unknown_format", "unknown")

    def _of(spark: SparkSession, d: str, layout: str = _layout) -> DataFrame:
        return _facts(spark, d, layout)

    _add(f"kpi_nodes_{_short}", f"SELECT * FROM facts WHERE layout = '{_layout}'")(_of)


@_add("layout_classification", "SELECT DISTINCT table_id, CASE n_regionkey % 5 WHEN 0 THEN 'type_1' WHEN 1 THEN 'type_2' WHEN 2 THEN 'type_3' WHEN 3 THEN 'type_4' ELSE 'unknown_format' END AS layout FROM w")
def layout_classification(spark, d):
    return packs(spark, d).select("table_id", melt.layout(F.col("merged_headers")).alias("layout"))


#: Cells of eight spellings from whole quantities and keys.
_CELL = "CASE (l_orderkey + l_linenumber) % 8 WHEN 0 THEN {q} WHEN 1 THEN '1,' || lpad({q}, 3, '0') WHEN 2 THEN {q} || ' ^1' WHEN 3 THEN '–' || {q} WHEN 4 THEN '(' || {q} || ')' WHEN 5 THEN {q} || 'K' WHEN 6 THEN '€' || {q} ELSE 'N/A' END"
_SPARK_CELL = _CELL.format(q="cast(cast(l_quantity as int) as string)")
_DUCK_CELL = _CELL.format(q="CAST(CAST(l_quantity AS INT) AS VARCHAR)")
_KIND = "(l_orderkey + l_linenumber) % 8"


@_add("clean_number", f"SELECT l_orderkey, l_linenumber, {_DUCK_CELL} AS text, {_KIND} IN (0, 1, 2) AS is_number, CASE {_KIND} WHEN 0 THEN l_quantity WHEN 1 THEN 1000 + l_quantity WHEN 2 THEN l_quantity ELSE 0.0 END AS value FROM lineitem", base=False)
def clean_number(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_SPARK_CELL).alias("text"))
    return df.select("*", S.is_number_cell(F.col("text")).alias("is_number"), S.clean_number(F.col("text")).alias("value"))


@_add("parse_number", f"SELECT l_orderkey, l_linenumber, {_DUCK_CELL} AS text, CASE {_KIND} WHEN 0 THEN l_quantity WHEN 1 THEN 1 + l_quantity / 1000 WHEN 2 THEN l_quantity WHEN 3 THEN -l_quantity WHEN 4 THEN -l_quantity WHEN 5 THEN l_quantity * 1000 WHEN 6 THEN l_quantity END AS value FROM lineitem", base=False)
def parse_number(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_SPARK_CELL).alias("text"))
    return df.select("*", S.parse_number(F.col("text")).alias("value"))


@_add("word_and_number_tests", f"SELECT l_orderkey, l_linenumber, {_DUCK_CELL} AS text, {_KIND} IN (0, 1, 2) AS number_text, {_KIND} IN (5, 7) AS word_text FROM lineitem", base=False)
def word_and_number_tests(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_SPARK_CELL).alias("text"))
    return df.select("*", S.is_number_text(F.col("text")).alias("number_text"), S.is_word_text(F.col("text")).alias("word_text"))


@_add("title_functions", r"""
SELECT p_partkey, CASE WHEN len(ws) = 0 THEN 'general_metric' ELSE array_to_string(list_slice(ws, 1, 2), '_') END AS metric,
  coalesce(nullif(regexp_replace(replace(lower(trim(split_part(t, ' – ', 1))), ' ', '_'), '[^a-zA-Z0-9_]', '', 'g'), ''), 'general_metric') AS context, p_type AS key_metric, p_brand AS key_units
FROM (SELECT *, p_name || ' of ' || p_type || ' – ' || p_brand AS t, list_filter(string_split(replace(lower(p_name || ' of ' || p_type || ' – ' || p_brand), '–', ' '), ' '), lambda x: x NOT IN ('', 'the', 'a', 'an', 'of', 'by', 'in', 'for', 'with')) AS ws FROM part)
""", base=False)
def title_functions(spark, d):
    p = table(spark, d, "part")
    title = F.concat("p_name", F.lit(" of "), "p_type", F.lit(" – "), "p_brand")
    key = F.concat("p_type", F.lit(" ("), "p_brand", F.lit(")"))
    return p.select("p_partkey", S.title_metric(title).alias("metric"), S.title_context(title).alias("context"), S.key_metric(key).alias("key_metric"), S.key_units(key).alias("key_units"))


@_add("normalize_metric", """
SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'sales_revenue' WHEN 1 THEN 'vehicle_sales' WHEN 2 THEN 'production' WHEN 3 THEN 'deliveries' WHEN 4 THEN 'vehicle_sales' ELSE lower(c_mktsegment) END AS metric FROM customer""", base=False)
def normalize_metric(spark, d):
    said = F.expr("CASE c_custkey % 6 WHEN 0 THEN 'Turnover ' WHEN 1 THEN 'Unit Sales ' WHEN 2 THEN 'Cars produced ' WHEN 3 THEN 'Delivered ' WHEN 4 THEN 'Return on Sales ' ELSE '' END")
    return table(spark, d, "customer").select("c_custkey", S.normalize_metric(F.concat(said, "c_mktsegment")).alias("metric"))


_ID = "CASE o_orderkey % 5 WHEN 0 THEN 'VW' || {y} || '_T' || {k} WHEN 1 THEN 'VW' || {y} || '1_T' || {k} WHEN 2 THEN 'V1' || {y} || '_T' || {k} WHEN 3 THEN 'VW' || {y} ELSE 'T' || {k} END"


@_add("table_years", f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 3) THEN year(o_orderdate) END AS strict_year, CASE WHEN o_orderkey % 5 IN (0, 1, 3) THEN year(o_orderdate) END AS medium_year,
 (length(split_part({_ID.format(y='year(o_orderdate)', k='o_orderkey')}, '_', 1)) < 6 OR substr({_ID.format(y='year(o_orderdate)', k='o_orderkey')}, 3, 4) = '1998') AS lax_1998 FROM orders""", base=False)
def table_years(spark, d):
    tid = F.expr(_ID.format(y="cast(year(o_orderdate) as string)", k="cast(o_orderkey as string)"))
    return table(spark, d, "orders").select("o_orderkey", S.table_year_strict(tid).cast("long").alias("strict_year"), S.table_year_medium(tid).cast("long").alias("medium_year"), S.in_year_lax(tid, "1998").alias("lax_1998"))


@_add("tables_per_year", "SELECT year, count(DISTINCT table_id) AS n FROM w GROUP BY year")
def tables_per_year(spark, d):
    return pack_source.tables_per_year(packs(spark, d))


@_add("distinct_years", "SELECT DISTINCT year FROM w")
def distinct_years(spark, d):
    return pack_source.years(packs(spark, d))


@_add("packs_of_year", "SELECT count(DISTINCT table_id) AS n FROM w WHERE year = 2008")
def packs_of_year(spark, d):
    return pack_source.of_year(packs(spark, d), 2008).agg(F.count("*").alias("n"))


@_add("temporal_edges", "SELECT * FROM edges")
def temporal_edges(spark, d):
    return graph.edges(_nodes(spark, d))


@_add("temporal_edges_for_kpi", "SELECT * FROM edges WHERE source LIKE 'order_count_%'")
def temporal_edges_for_kpi(spark, d):
    return graph.edges(_nodes(spark, d), kpi="order count")


@_add("graph_nodes", "SELECT id, kpi_name, key, year, value, units FROM nodes")
def graph_nodes(spark, d):
    return _nodes(spark, d).select("id", "kpi_name", "key", "year", "value", "units")


@_add("graph_metadata", "SELECT (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(*) FROM edges) AS total_edges, count(DISTINCT kpi_name) AS unique_kpis, count(DISTINCT key) AS unique_entities, min(year) AS first_year, max(year) AS last_year FROM nodes")
def graph_metadata(spark, d):
    n = _nodes(spark, d)
    return graph.metadata(n, graph.edges(n))


@_add("kpi_timeline", "SELECT key AS entity, year, value, substr(key, 1, 20) AS label FROM nodes WHERE lower(kpi_name) = 'sales revenue'")
def kpi_timeline(spark, d):
    return graph.timeline(_nodes(spark, d), "Sales Revenue")


@_add("kpi_timeline_entities", "SELECT key AS entity, year, value, substr(key, 1, 20) AS label FROM nodes WHERE lower(kpi_name) = 'order count' AND key IN (SELECT n_name FROM nation WHERE n_nationkey IN (0, 4, 5))")
def kpi_timeline_entities(spark, d):
    keys = [r[0] for r in table(spark, d, "nation").where("n_nationkey in (0, 4, 5)").select("n_name").collect()]
    return graph.timeline(_nodes(spark, d), "Order Count", keys)


@_add("network_subgraph", "SELECT e.* FROM edges e WHERE source IN (SELECT id FROM nodes WHERE kpi_name LIKE '%revenue%' ORDER BY id LIMIT 50) AND target IN (SELECT id FROM nodes WHERE kpi_name LIKE '%revenue%' ORDER BY id LIMIT 50)")
def network_subgraph(spark, d):
    n = _nodes(spark, d)
    return graph.subgraph(n, graph.edges(n), "REVENUE", 50)[1]


@_add("kpi_distribution", "SELECT 'kpi' AS dimension, kpi_name AS item, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT 'entity', key, count(*) FROM nodes GROUP BY ALL UNION ALL SELECT 'year', CAST(year AS VARCHAR), count(*) FROM nodes GROUP BY ALL")
def kpi_distribution(spark, d):
    return graph.distribution(_nodes(spark, d))


@_add("top_entities", "SELECT key, count(*) AS n FROM nodes GROUP BY key ORDER BY n DESC, key LIMIT 15")
def top_entities(spark, d):
    return graph.top_entities(_nodes(spark, d))


@_add("sample_questions", """SELECT unnest(['Show the trend of ' || k[1] || ' for ' || e[1], 'Compare ' || k[1] || ' between ' || e[1] || ' and ' || e[2], 'Which entity has the highest ' || k[2] || '?',
  'How did ' || k[1] || ' change over the years?', 'List all metrics of ' || e[1]]) AS question FROM (SELECT list(DISTINCT kpi_name ORDER BY kpi_name) AS k, list(DISTINCT key ORDER BY key) AS e FROM nodes)""")
def sample_questions(spark, d):
    return graph.sample_questions(_nodes(spark, d))


_CHECKED = ["table_id", "key", "year", "outcome", "is_valid", "confidence", "row_check", "col_check"]


@_add("validate_kpis", "SELECT table_id, key, year, outcome, is_valid, round(confidence, 9) AS confidence, row_check, col_check FROM checked")
def validate_kpis(spark, d, layout=None):
    return _checked(spark, d, layout).select(*_CHECKED).withColumn("confidence", F.round("confidence", 9))


@_add("validation_stats", "SELECT year, count(*) AS total_kpis, count(*) FILTER (is_valid) AS valid_kpis, count(*) FILTER (NOT is_valid) AS invalid_kpis, count(DISTINCT table_id) AS tables_processed, round(100.0 * count(*) FILTER (is_valid) / count(*), 9) AS accuracy FROM checked GROUP BY year")
def validation_stats(spark, d, layout=None):
    return validate.statistics(_checked(spark, d, layout), ["year"]).select("year", "total_kpis", "valid_kpis", "invalid_kpis", "tables_processed", F.round("accuracy", 9).alias("accuracy"))


@_add("validation_overall", "SELECT count(*) AS total_kpis, count(*) FILTER (is_valid) AS valid_kpis, count(*) FILTER (outcome = 'same_name') AS name_mismatches, round(100.0 * count(*) FILTER (is_valid) / count(*), 9) AS accuracy FROM checked")
def validation_overall(spark, d, layout=None):
    return validate.statistics(_checked(spark, d, layout)).select("total_kpis", "valid_kpis", "name_mismatches", F.round("accuracy", 9).alias("accuracy"))


@_add("valid_report", "SELECT name, key, units, round(value, 6) AS value, year, table_id, row_idx, col_idx FROM checked WHERE is_valid")
def valid_report(spark, d, layout=None):
    return validate.valid_report(_checked(spark, d, layout)).select("name", "key", "units", F.round(F.col("value").cast("double"), 6).alias("value"), "year", "evidence.table_id", "evidence.row_idx", "evidence.col_idx")


@_add("invalid_report", "SELECT table_id, name, key, outcome IN ('moderate', 'large', 'same_name') OR (stop IS NULL AND (row_check = 'differs' OR col_check = 'differs')) AS has_fix FROM checked WHERE NOT is_valid")
def invalid_report(spark, d, layout=None):
    return validate.invalid_report(_checked(spark, d, layout)).select("table_id", "kpi.name", "kpi.key", (F.size("validation.fix_instructions") > 0).alias("has_fix"))


def _said(c: str) -> str:
    """SQL of a number as the validator's texts spell it."""
    t = f"CAST(CAST({c} AS DOUBLE) AS VARCHAR)"
    tail = f"coalesce(nullif(rtrim(substr(replace({t}, '.', ''), 2), '0'), ''), '0')"
    return f"CASE WHEN abs({c}) >= 1e7 THEN left({t}, 1) || '.' || {tail} || 'E' || (strpos({t}, '.') - 2) ELSE {t} END"


@_add("error_type_histogram", f"""
SELECT error_type, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM (SELECT confidence, unnest(list_filter(CASE WHEN stop IS NOT NULL THEN [CASE stop WHEN 'same_name' THEN '❌ key and name are identical' WHEN 'no_col' THEN 'Missing col_idx in KPI'
  WHEN 'row_bounds' THEN 'row_idx ' || row_idx || ' out of bounds (table has ' || n_rows || ' rows)' ELSE 'col_idx ' || col_idx || ' out of bounds (row has ' || n_cols || ' cols)' END]
  ELSE [CASE row_check WHEN 'equal' THEN '✓ row_name verified' WHEN 'case' THEN '⚠ row_name case mismatch' WHEN 'differs' THEN '❌ row_name MISMATCH' END, CASE col_check WHEN 'equal' THEN '✓ col_name verified' WHEN 'differs' THEN '⚠ col_name MISMATCH' END,
    CASE WHEN shift THEN '⚠ Auto-corrected' END, CASE outcome WHEN 'both_null' THEN 'Both null (cell' WHEN 'value_null' THEN 'Extracted null but source=' || {_said("source")} || ' (cell' WHEN 'source_null' THEN 'Source null but extracted=' || {_said("value")} || ' (cell'
    WHEN 'small' THEN 'Small diff' WHEN 'moderate' THEN 'Moderate diff' WHEN 'beside' THEN '⚠ Auto-corrected' WHEN 'large' THEN 'Large diff' END, CASE WHEN outcome = 'beside' AND gap2 > 1e-6 THEN 'Small diff after correction' END] END, lambda x: x IS NOT NULL)) AS error_type FROM checked) GROUP BY error_type""")
def error_type_histogram(spark, d, layout=None):
    return validate.error_histogram(_checked(spark, d, layout)).withColumn("mean_confidence", F.round("mean_confidence", 6))


@_add("node_labels", f"SELECT id, left(key, 10) || chr(10) || year || chr(10) || {_said('value')} AS label, array_to_string(list_transform(regexp_extract_all(lower(kpi_name), '[a-z]+|[^a-z]+'), lambda x: upper(x[1]) || x[2:]), '') AS titled FROM nodes")
def node_labels(spark, d):
    return _nodes(spark, d).select("id", S.node_label(F.col("key"), F.col("year"), F.col("value")).alias("label"), S.title_case(F.col("kpi_name")).alias("titled"))


@_add("neighbour_hints", """
SELECT a.table_id, a.row_idx, a.col_idx, count(*) AS n_near, count(*) FILTER (b.text <> a.text) AS n_other FROM grid a JOIN grid b ON a.table_id = b.table_id AND abs(a.row_idx - b.row_idx) + abs(a.col_idx - b.col_idx) = 1 GROUP BY ALL""")
def neighbour_hints(spark, d, layout=None):
    c = melt.cells(packs(spark, d, layout))
    near = validate.near_cells(F.col("rows"), F.col("row_idx"), F.col("col_idx"))
    return c.select("table_id", "row_idx", "col_idx", F.size(near).cast("long").alias("n_near"), F.size(F.filter(near, lambda x: x["text"] != F.col("text"))).cast("long").alias("n_other"))


@_add("label_search", "SELECT table_id, row_idx AS said, row_idx AS found, year FROM w")
def label_search(spark, d, layout=None):
    p = packs(spark, d, layout).select("table_id", "stub_col", "year", F.posexplode("stub_col").alias("said", "label"))
    return p.select("table_id", "said", validate.find_label(F.col("stub_col"), F.lower("label")).alias("found"), "year")


@_add("plausibility", "SELECT table_id, key, year, CASE WHEN col_idx < 1 THEN 1 ELSE 0 END + CASE WHEN contains(lower(units), 'thousand') AND abs(value) >= 1e6 THEN 1 ELSE 0 END AS doubts FROM raw")
def plausibility(spark, d, layout=None):
    return validate.plausibility(raw_kpis(spark, d, layout)).select("table_id", "key", "year", F.size("doubts").alias("doubts"))


@_add("link_chains", "SELECT kpi_id, name, key, year, value, units, next_kpi_id, prev_kpi_id FROM linked")
def link_chains(spark, d):
    return _links(spark, d).select("kpi_id", "name", "key", "year", "value", "units", "next_kpi_id", "prev_kpi_id")


@_add("link_statistics", "SELECT count(*) AS total_nodes, count(*) FILTER (next_kpi_id IS NOT NULL OR prev_kpi_id IS NOT NULL) AS linked_nodes, count(*) FILTER (next_kpi_id IS NOT NULL AND prev_kpi_id IS NULL) AS chains, count(*) FILTER (next_kpi_id IS NULL AND prev_kpi_id IS NULL) AS isolated_nodes FROM linked")
def link_statistics(spark, d):
    return chains.statistics(_links(spark, d))


@_add("chain_statistics", "SELECT avg(length) AS avg_length, max(length) AS max_length, min(length) AS min_length, (SELECT 100.0 * count(*) FILTER (next_kpi_id IS NOT NULL OR prev_kpi_id IS NOT NULL) / count(*) FROM linked) AS linked_percent, (SELECT 100.0 * count(*) FILTER (next_kpi_id IS NULL AND prev_kpi_id IS NULL) / count(*) FROM linked) AS isolated_percent FROM ch")
def chain_statistics(spark, d):
    return chains.chain_statistics(_links(spark, d))


@_add("chain_length_histogram", "SELECT length, count(*) AS n FROM ch GROUP BY length")
def chain_length_histogram(spark, d):
    return chains.length_histogram(_links(spark, d))


@_add("top_chains", "SELECT * FROM ch ORDER BY length DESC, name, key LIMIT 5")
def top_chains(spark, d):
    return chains.top_chains(_links(spark, d))


@_add("temporal_coverage", "SELECT name, key, count(DISTINCT year) AS n_years, min(year) || '-' || max(year) AS year_range FROM lk GROUP BY name, key")
def temporal_coverage(spark, d):
    return chains.coverage(_links(spark, d))


@_add("event_coverage", "SELECT event_type AS name, CAST(user_id AS VARCHAR) AS key, count(DISTINCT day(ts)) AS n_years, min(day(ts)) || '-' || max(day(ts)) AS year_range FROM events GROUP BY ALL", base=False)
def event_coverage(spark, d):
    return chains.coverage(table(spark, d, "events").select(F.col("event_type").alias("name"), F.col("user_id").cast("string").alias("key"), F.dayofmonth("ts").alias("year")))


_GROUPS = "SELECT CASE grouping_id(name, key, units) WHEN 3 THEN 'name' WHEN 1 THEN 'name_key' ELSE 'name_key_units' END AS strategy, name, key, units, count(*) AS size, count(DISTINCT year) AS n_years, min(year) AS first_year, max(year) AS last_year, count(DISTINCT k) AS n_keys, count(DISTINCT u) AS n_units FROM (SELECT *, key AS k, units AS u FROM lk) GROUP BY GROUPING SETS ((name), (name, key), (name, key, units))"


@_add("grouping_strategies", _GROUPS)
def grouping_strategies(spark, d):
    return chains.grouping(_links(spark, d))


@_add("grouping_summary", f"SELECT strategy, count(*) AS n_groups, count(*) FILTER (n_years >= 2) AS n_temporal, avg(size) AS avg_size FROM ({_GROUPS}) GROUP BY strategy")
def grouping_summary(spark, d):
    return chains.grouping_summary(chains.grouping(_links(spark, d)))


@_add("top_groups", f"SELECT strategy, name, key, units, size FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY size DESC, name NULLS FIRST, key NULLS FIRST, units NULLS FIRST) AS r FROM ({_GROUPS})) WHERE r <= 10")
def top_groups(spark, d):
    return chains.top_groups(chains.grouping(_links(spark, d))).select("strategy", "name", "key", "units", "size")


@_add("group_lists", """
SELECT name, count(*) AS size, string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR)) AS years, count(DISTINCT key) AS n_keys, array_to_string(list_slice(list(DISTINCT key ORDER BY key), 1, 3), ',') AS first_keys,
  array_to_string(list_slice(list(DISTINCT units ORDER BY units), 1, 3), ',') AS first_units FROM lk GROUP BY name""")
def group_lists(spark, d):
    out = chains.group_lists(_links(spark, d), ["name"])
    return out.select("name", "size", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("years", "first_keys", "first_units")], "n_keys")


@_add("chain_nodes", "SELECT kpi_id, next_kpi_id, prev_kpi_id, table_id, row_idx, col_idx FROM linked JOIN nodes ON id = ord")
def chain_nodes(spark, d):
    n = _nodes(spark, d).select(F.col("kpi_name").alias("name"), "key", "year", F.concat(F.col("value").cast("long").cast("string"), F.lit(".0")).alias("value"), "units", F.col("id").alias("ord"), "table_id", "row_idx", "col_idx")
    return chains.link(n).select("kpi_id", "next_kpi_id", "prev_kpi_id", "table_id", "row_idx", "col_idx")


@_add("value_progression", "SELECT name, key, string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR)) AS years, string_agg(CAST(CAST(CAST(value AS DOUBLE) AS BIGINT) AS VARCHAR), ',' ORDER BY year, ord) AS \"values\" FROM lk GROUP BY name, key")
def value_progression(spark, d):
    return chains.progression(_links(spark, d).withColumn("value", F.col("value").cast("double").cast("long").cast("string")))


@_add("clean_json_response", """SELECT conv_id, turn, '{"kpis":[{"name":"n","key":"k","value":"' || turn || '.0","year":2020}]}' AS cleaned FROM conversations""", base=False)
def clean_json_response(spark, d):
    said = F.concat(F.lit("<think>{ "), F.coalesce("text", F.lit("")), F.lit('</think> so: {"kpis":[{"name":"n","key":"k","value":"'), F.col("turn").cast("string"), F.lit('.0","year":2020}]} end'))
    return table(spark, d, "conversations").select("conv_id", "turn", S.model_json(said).alias("cleaned"))


@_add("parse_kpis_json", "SELECT conv_id, turn, 'n' AS name, turn || '.0' AS value, 2020 AS year FROM conversations", base=False)
def parse_kpis_json(spark, d):
    df = clean_json_response(spark, d)
    return df.select("conv_id", "turn", F.inline(S.parsed_kpis(F.col("cleaned")))).select("conv_id", "turn", "name", "value", "year")


@_add("resume_remaining", "SELECT DISTINCT table_id FROM w WHERE year % 2 = 1")
def resume_remaining(spark, d):
    p = packs(spark, d)
    return extract.remaining(p, p.where("year % 2 = 0").select("table_id")).select("table_id")


@_add("per_file_limit", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 3", base=False)
def per_file_limit(spark, d):
    return pack_source.first_per_file(table(spark, d, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("line")), 3).select(F.col("line").alias("o_orderkey"))


@_add("last_writer_wins", "SELECT CAST(o_custkey AS VARCHAR) AS table_id, max(o_orderkey) AS line FROM orders GROUP BY o_custkey", base=False)
def last_writer_wins(spark, d):
    return validate.last_packs(table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("table_id"), F.col("o_orderkey").alias("line")), ["line"])


@_add("rule_extraction", """SELECT table_id, CASE layout WHEN 'type_2' THEN 'Production' WHEN 'type_3' THEN 'Key Figures' WHEN 'type_4' THEN r_name || ' TRADE – KEY FIGURES' ELSE kpi_name END AS name,
  CASE WHEN layout IN ('type_3', 'type_4') THEN kpi_name || ' (units)' ELSE key END AS key, CASE WHEN layout IN ('type_1', 'unknown_format') AND col_idx > 2 AND value BETWEEN 1000 AND 999999 THEN value / 1000 ELSE value END AS value, year, row_idx, col_idx
  FROM facts JOIN region ON r_regionkey = CAST(right(table_id, 1) AS INT)""")
def rule_extraction(spark, d, layout=None):
    return extract.rule_kpis(packs(spark, d, layout)).select("table_id", "name", "key", F.col("value").cast("double").alias("value"), "year", "row_idx", "col_idx")


def _corrected(spark: SparkSession, d: str) -> DataFrame:
    return extract.correct(raw_kpis(spark, d), packs(spark, d), path=shared.new(spark, "rounds"))


@_add("extract_and_correct")
def extract_and_correct(spark, d):
    return _corrected(spark, d).select("table_id", "name", "key", "value", "year", "row_idx", "col_idx", "is_valid", "iteration")


@_add("correction_rounds")
def correction_rounds(spark, d):
    return validate.iteration_statistics(_corrected(spark, d))


@_add("model_extraction", "SELECT table_id, stub AS key, CAST(substr(table_id, 3, 4) AS INT) AS year, true AS is_valid, CAST(1 AS DOUBLE) AS confidence FROM stubs")
def model_extraction(spark, d, layout=None):
    def make():
        import json

        def say(prompt: str) -> str:
            t = json.loads(prompt)
            c = next(i for i, h in enumerate(t["merged_headers"]) if any(x.isdigit() for x in h))
            found = [{"name": "Production", "key": s, "value": r[c].split(" ")[0], "year": t["year"], "row_name": s, "row_idx": i, "col_name": t["merged_headers"][c], "col_idx": c} for i, (s, r) in enumerate(zip(t["stub_col"], t["rows"], strict=True))]
            return "<think>reading</think>" + json.dumps({"kpis": found})

        return say

    p = packs(spark, d, layout)
    good, _ = extract.parse(extract.generate(p, make, "echo"))
    return validate.validate(good, p).select("table_id", "key", "year", "is_valid", "confidence")


@_add("run_totals", "SELECT count(*) AS tables, count(*) FILTER (n > 0) AS with_kpis, sum(n) AS kpis FROM (SELECT table_id, count(*) AS n FROM facts GROUP BY table_id)")
def run_totals(spark, d):
    by = _facts(spark, d).groupBy("table_id").agg(F.count("*").alias("n"))
    return by.agg(F.count("*").alias("tables"), F.count_if(F.col("n") > 0).alias("with_kpis"), F.sum("n").alias("kpis"))


@_add("top_k_per_group", "SELECT n_regionkey, n_name, year, oc FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY oc DESC, n_name, year) AS r FROM f) WHERE r <= 5")
def top_k_per_group(spark, d):
    from kpiloom.plans.bridge import yearly

    w = Window.partitionBy("n_regionkey").orderBy(F.desc("oc"), "n_name", "year")
    return yearly(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 5").select("n_regionkey", "n_name", "year", "oc")
