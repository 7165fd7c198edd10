import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"
FILES = [
    "jsonl_scan", "jsonl_tolerant_scan", "export_by_year", "sqlite_scan", "sqlite_scan_of_year", "extraction_scan", "validate_files", "report_files", "valid_kpi_scan", "latest_file", "checkpoint_scan",
    "resumed_results", "process_packs", "finalised_runs", "debug_dumps", "graph_export", "viewer_export", "links_scan", "chain_export",
]


def test_oracles_have_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_works_without_the_training_data_operators(tmp_path):
    for name in ("__spark_entry__.py", "kpiloom"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "kpiloom/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'temporal_edges' in q and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_flagship_gives_edges(spark):
    from kpiloom.plans import registry

    df = registry.QUERIES["temporal_edges"](spark, DATA)
    assert df.columns == ["source", "target", "year_diff", "edge_type"] and df.where("year_diff > 0").count() == df.count() > 0


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize("name", ["kpi_nodes_unknown", "parse_number", "kpi_distribution", "grouping_summary", "validation_stats", "validate_kpis", "rule_extraction", "neighbour_hints", "plausibility", "error_type_histogram", "around_search", "header_search", "top_coverage", "sample_questions", "node_labels", "model_extraction", "group_lists", "chain_nodes", *FILES])
def test_queries_match_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from kpiloom.plans import files

    con = duckdb.connect()
    for t in "region nation customer orders lineitem".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = files.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    cur = con.execute(files.ORACLES[name])
    names = [c[0] for c in cur.description]
    plain = lambda x: round(x, 6) if isinstance(x, float) else x
    want = sorted(str([plain(r[names.index(c)]) for c in cols]) for r in cur.fetchall())
    assert sorted(str([plain(r[c]) for c in cols]) for r in df.collect()) == want


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_validation_and_extraction_run_over_all_layouts(spark):
    from kpiloom.plans import registry
    from kpiloom.plans.bridge import packs

    every = {r.table_id for r in packs(spark, DATA).select("table_id").collect()}
    assert len({t[-1] for t in every}) == 5
    for name in ("validate_kpis", "rule_extraction", "label_search"):
        assert {r.table_id for r in registry.QUERIES[name](spark, DATA).select("table_id").collect()} == every
    total = registry.QUERIES["validation_overall"](spark, DATA).first().total_kpis
    assert total == registry.QUERIES["run_totals"](spark, DATA).first().kpis


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_correction_rounds_hold_every_kpi(spark):
    from kpiloom.plans import registry

    rounds = registry.QUERIES["correction_rounds"](spark, DATA).collect()
    first = {r.table_id: r for r in registry.QUERIES["validate_kpis"](spark, DATA).groupBy("table_id").agg({"*": "count"}).collect()}
    assert {r.table_id: r.total_kpis for r in rounds} == {t: r["count(1)"] for t, r in first.items()}
    best: dict = {}
    for r in sorted(rounds, key=lambda r: r.iteration):
        assert r.valid_kpis >= best.get(r.table_id, 0) and r.valid_kpis + r.invalid_kpis == r.total_kpis
        best[r.table_id] = r.valid_kpis
