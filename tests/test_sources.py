import json

import pytest

from kpiloom.operators import melt
from kpiloom.plans import jobs
from kpiloom.sources import packs, sinks, sqlite
from kpiloom.streaming import ingest

PACK = {"table_id": "VW2022_T1", "doc_id": "d", "year": 2022, "page": 1, "section_name": "s", "title": "AUDI PRODUCTION", "headers": [["Units", "2022", "2021"]], "merged_headers": ["Units", "2022", "2021"], "rows": [["A4", "10", "20"]], "stub_col": ["A4"]}


def test_jsonl(spark, tmp_path):
    (tmp_path / "linked_tables(2022).jsonl").write_text("// note\n\n# note\n" + json.dumps(PACK) + "\n")
    assert [r.table_id for r in packs.jsonl(spark, str(tmp_path)).collect()] == ["VW2022_T1"]
    (tmp_path / "bad.jsonl").write_text("{oops\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|parse"):
        packs.jsonl(spark, str(tmp_path)).collect()
    loose = packs.jsonl(spark, str(tmp_path), strict=False)
    assert loose.where("corrupt is not null").count() == 1
    assert packs.first_per_file(loose, 1).count() == 2


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "packs.db")
    sqlite.write(path, [PACK, PACK | {"table_id": "VW2021_T1", "rows": [["A4", 2.0, None]], "merged_headers": None}])
    rows = sqlite.read(spark, path, partitions=2).orderBy("ord").collect()
    assert [r.table_id for r in rows] == ["VW2022_T1", "VW2021_T1"] and rows[1].rows == [["A4", "2.0", None]] and rows[1].merged_headers is None
    assert sqlite.read(spark, path, year=2021).count() == 1 and sqlite.read(spark, path, limit=1).count() == 1


def test_envelopes_and_reports(spark, tmp_path):
    kpi = {"name": "n", "key": "k", "value": "1.0", "year": 2022, "row_idx": 0, "col_idx": 1}
    (tmp_path / "m_linked_tables(2022).json").write_text(json.dumps({"metadata": {"model": "m"}, "tables": [{"table_id": "T", "extraction_result": {"kpis": [kpi]}}]}))
    (tmp_path / "db.json").write_text(json.dumps({"metadata": {"model": "m"}, "results": [{"table_id": "U", "kpis": [kpi, kpi]}, {"table_id": None, "kpis": [kpi]}]}))
    rows = packs.extractions(spark, str(tmp_path)).collect()
    assert sorted((r.table_id, r.file_year) for r in rows) == [("T", "2022"), ("U", None), ("U", None)]
    assert packs.results(spark, str(tmp_path / "nowhere")).count() == 0


def test_markdown(spark, tmp_path):
    (tmp_path / "a.md").write_text("{0}----\ntext\n\n| | 2022 | 2021 |\n|---|---|---|\n| A4 | 10 | 20 |\n\n{1}----\nend\n")
    r = packs.markdown_tables(spark, str(tmp_path)).collect()
    assert len(r) == 1 and r[0].page == 0 and r[0].merged_headers == ["", "2022", "2021"] and r[0].rows == [["A4", "10", "20"]]


def test_by_year_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps(PACK) + "\n")
    df = packs.jsonl(spark, str(tmp_path / "in/a.json"))
    sinks.by_year(df, str(tmp_path / "out"))
    assert (tmp_path / "out/table_year=2022").is_dir()
    go = lambda: ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    go()
    assert [(r.source, r.year_diff) for r in ingest.edges(spark, str(tmp_path / "t")).collect()] == [("audi_production_A4_2021", 1)]
    late = PACK | {"table_id": "VW2020_T1", "merged_headers": ["Units", "2019", "2018"]}
    (tmp_path / "in/b.json").write_text(json.dumps(late) + "\n")
    go()
    assert {(r.source[-4:], r.target[-4:]) for r in ingest.edges(spark, str(tmp_path / "t")).collect()} == {("2018", "2019"), ("2019", "2021"), ("2021", "2022")}
    assert melt.facts(df).count() == 2


def test_checkpoints_never_fail(spark, tmp_path):
    one = {"table_id": "T", "kpis": [{"name": "n"}]}
    for name, text in {"a": json.dumps([one, {"table_id": "U", "error": "e"}]), "b": json.dumps({"metadata": {}, "results": [one]}), "c": "{oops", "d": "7", "e": json.dumps({"other": 1})}.items():
        (tmp_path / f"{name}.json").write_text(text)
    rows = packs.checkpoints(spark, str(tmp_path)).collect()
    assert sorted((r.file[-6:-5], r.table_id, r.error) for r in rows if r.error is None) == [("a", "T", None), ("b", "T", None)] and len(rows) == 3
    assert packs.checkpoints(spark, str(tmp_path / "nowhere")).count() == 0


def test_other_files(spark, tmp_path):
    kpi = {"name": "n", "key": "k", "value": "1.0", "year": 2022, "evidence": {"table_id": "T", "row_idx": 0, "col_idx": 1}}
    (tmp_path / "valid_a.json").write_text(json.dumps({"source_file": "a", "valid_kpis": [kpi, kpi]}))
    (tmp_path / "links.json").write_text(json.dumps({"total_nodes": 1, "nodes": [{"kpi_id": "x", "next_kpi_id": "y"}]}))
    assert [(r.place, r.table_id) for r in packs.valid_kpis(spark, str(tmp_path)).collect()] == [(0, "T"), (1, "T")]
    assert packs.links(spark, str(tmp_path / "links.json")).first().next_kpi_id == "y"
    assert packs.latest_file(spark, str(tmp_path), "valid_*.json").first().file.endswith("valid_a.json")


def _two_models(spark, tmp_path):
    years = {"VW2020_T1": "2020", "VW2021_T1": "2021"}
    sqlite.write(str(tmp_path / "p.db"), [PACK | {"table_id": t, "merged_headers": ["Units", y, "2001"]} for t, y in years.items()])

    def make(calls={}):  # noqa: B006  shared by a worker's calls on purpose
        def say(prompt):
            t = json.loads(prompt)
            if "incomplete_output" in t:
                return json.dumps({"kpis": [{"name": "n", "key": "k", "value": "10", "row_idx": 0, "col_idx": 1}]})
            if "2020" in t["table_id"]:
                return "no json"
            return json.dumps({"kpis": [{"name": "n", "key": "k", "value": "20", "row_idx": 0, "col_idx": 1}]})

        return say

    return {"rules": None, "m": make}


def test_runs_over_a_database(spark, tmp_path):
    models, out = _two_models(spark, tmp_path), str(tmp_path / "out")
    got = {(r.model, r.year): (r.tables, r.successes, r.failures, r.kpis) for r in jobs.process_database(spark, str(tmp_path / "p.db"), models, out).collect()}
    assert got == {("rules", 2020): (1, 1, 0, 2), ("rules", 2021): (1, 1, 0, 2), ("m", 2020): (1, 1, 0, 1), ("m", 2021): (1, 1, 0, 1)}
    res = {(r.model, r.table_id): r for r in spark.read.json(f"{out}/results").collect()}
    assert res["m", "VW2020_T1"].recovered and not res["m", "VW2021_T1"].recovered
    assert spark.read.json(f"{out}/metadata").where("complete and total_tables_processed = 1").count() == 4
    again = jobs.process_database(spark, str(tmp_path / "p.db"), models, out, year=2021)
    assert again.agg({"tables": "sum"}).first()[0] == 2 and spark.read.parquet(f"{out}/checkpoint").count() == 4


def test_validation_of_files(spark, tmp_path):
    kpi = {"name": "Production", "key": "A4", "value": "10", "year": 2022, "row_idx": 0, "col_idx": 1, "row_name": "A4", "col_name": "2022"}
    (tmp_path / "e").mkdir()
    (tmp_path / "t").mkdir()
    for name in ("m_linked_tables(2022)", "m_linked_tables(2019)", "noyear"):
        (tmp_path / f"e/{name}.json").write_text(json.dumps({"metadata": {"model": "m"}, "tables": [{"table_id": "VW2022_T1", "extraction_result": {"kpis": [kpi, kpi | {"value": "30", "row_name": "B"}]}}]}))
    (tmp_path / "t/linked_tables(2022).jsonl").write_text(json.dumps(PACK | {"rows": [["A4", "99"]]}) + "\n" + json.dumps(PACK) + "\n")
    by, whole = jobs.validate_files(spark, str(tmp_path / "e"), str(tmp_path / "t"), str(tmp_path / "o"))
    assert [(r.file, r.total_kpis, r.valid_kpis) for r in by.collect()] == [("m_linked_tables(2022).json", 2, 1)] and whole.first().accuracy == 50.0
    assert spark.read.json(str(tmp_path / "o/valid")).count() == 1
    bad = spark.read.json(str(tmp_path / "o/invalid")).first().validation
    assert bad.fix_instructions == [
        "FIX: row_idx=0 points to wrong row", "  - Current: row_name='B' but stub_col[0]='A4'", "SOLUTION: Search stub_col for the correct row_idx where value matches 'B':",
        "FIX: Large value mismatch (>5% error)", "  - Extracted: 30.0", "  - Source at [0][1]: 10.0 (text: '10')", "SOLUTION: Search nearby cells for the extracted value 30.0:",
    ]


def test_sinks(spark, tmp_path):
    n = spark.createDataFrame([("a", "n", "k", 1.0, 2020, None)], "id string, kpi_name string, key string, value double, year int, units string")
    e = spark.createDataFrame([("a", "b", None, None)], "source string, target string, year_diff int, edge_type string")
    sinks.graph(n, e, n.select("id"), str(tmp_path / "g"))
    sinks.graph_json(n, e, str(tmp_path / "j"), units=False)
    assert spark.read.parquet(str(tmp_path / "g/metadata")).columns == ["id", "export_timestamp"]
    assert {r.kind: r.edge_type for r in spark.read.json(str(tmp_path / "j")).collect()} == {"node": None, "edge": "temporal"}
    sinks.debug_dump(spark.createDataFrame([("T", "m", "raw")], "table_id string, model string, raw string"), str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).first().raw == "raw"
    sinks.chains(n, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 1


def test_a_folder_without_json_lines_is_an_error(spark, tmp_path):
    (tmp_path / "other.txt").write_text("{}")
    with pytest.raises(FileNotFoundError):
        packs.jsonl(spark, str(tmp_path))
