from pyspark.sql import functions as F

from kpiloom.operators import chains, extract, graph, melt, validate
from kpiloom.schemas import PACK

HEADS = {
    "unknown_format": ["Thousand vehicles/€ million", "VEHICLE SALES 2022", "VEHICLE SALES 2021"], "type_1": ["", "VEHICLE SALES 2022", "VEHICLE SALES 2021"], "type_2": ["Units", "2023", "2022"],
    "type_3": ["", "", "2022", "2021", "%"], "type_4": ["", "2023", "2022", "%"],
}


def packs(spark, rows):
    return spark.createDataFrame([(t, "d", 2022, 1, None, "s", title, [h] if h else None, h, r, [x[0] for x in r]) for t, title, h, r in rows], PACK)


def test_layouts(spark):
    cases = [*HEADS.items(), ("type_2", ["Thousand vehicles/€ million", "VEHICLE SALES 2016", "2015"]), ("unknown_format", ["", "VEHICLE SALES 2016", "2015"]), ("unknown_format", ["", "", ""]), ("unknown_format", []), ("unknown_format", None)]
    df = spark.createDataFrame([(i, h) for i, (_, h) in enumerate(cases)], "i int, h array<string>")
    assert [r.l for r in df.select("i", melt.layout(F.col("h")).alias("l")).orderBy("i").collect()] == [c[0] for c in cases]


def test_unit_fold_and_null_metric(spark):
    h = ["Thousand vehicles/€ million", "VEHICLE SALES 2022", "VEHICLE SALES 2021", "SALES REVENUE 2022", "SALES REVENUE 2021"]
    df = packs(spark, [("A", "t", h, [["Volume", "4069", "4133", "113,762", "101,858"], ["CARIAD", "–", "–", "796", "518"]]), ("B", "t", ["", "VEHICLE SALES 2016", "2015"], [["x", "1", "2"]]), ("C", "t", None, [["x", "1"]])])
    rows = {(r.key, r.kpi_name, r.year): (r.value, r.units, r.units_fixed) for r in melt.facts(df).collect()}
    assert rows["Volume", "sales revenue", 2021] == (101858.0, "€ million", "€ million")
    assert rows["CARIAD", "sales revenue", 2021] == (518.0, "Thousand vehicles", "€ million")
    assert rows["x", None, 2015][0] == 2.0
    assert len(rows) == 8


def test_edges_skip_gaps_and_stay_out_of_years(spark):
    df = spark.createDataFrame([("k", "e", 2010, 1.0), ("k", "e", 2013, 2.0), (None, "e", 2010, 1.0), (None, "e", 2011, 1.0)], "kpi_name string, key string, year int, value double")
    n = graph.nodes(df, ["value"])
    assert {(r.source, r.target, r.year_diff) for r in graph.edges(n).collect()} == {("k_e_2010", "k_e_2013", 3), ("None_e_2010", "None_e_2011", 1)}
    assert graph.metadata(n, graph.edges(n)).first().unique_kpis == 2


KPI = "table_id string, name string, key string, units string, value string, year int, row_name string, row_idx int, col_name string, col_idx int, source_model string"


def test_decision_table(spark):
    p = packs(spark, [("T", "Audi Production", ["Units", "2023", "2022"], [["A4", "100", "200"], ["Q5", "102", "–"]])])
    base = {"name": "Production", "key": "A4", "value": "100", "row_name": "A4", "row_idx": 0, "col_name": "2023", "col_idx": 1}
    cases = [
        ({}, "exact", True, 1.0), ({"key": "Production"}, "same_name", False, 0.5), ({"row_idx": None}, "no_row", False, 0.0), ({"col_idx": None}, "no_col", False, 0.0), ({"row_idx": 9}, "row_bounds", False, 0.0), ({"col_idx": 9}, "col_bounds", False, 0.0),
        ({"row_name": "a4"}, "exact", True, 0.98), ({"row_name": "Z"}, "exact", False, 0.5), ({"row_name": None}, "exact", True, 0.95), ({"col_name": "Z"}, "exact", True, 0.9), ({"value": None}, "value_null", False, 0.2),
        ({"value": "100.5"}, "small", True, 0.98), ({"value": "102"}, "moderate", False, 0.7), ({"value": "abc"}, "not_number", False, 0.0), ({"value": "200"}, "beside", True, 0.95), ({"row_name": "Z", "value": "200"}, "beside", True, 0.475),
        ({"value": "777"}, "large", False, 0.3), ({"col_idx": 0}, "exact", True, 0.9 * 0.95), ({"row_idx": 1, "row_name": "Q5", "col_idx": 2, "col_name": "2022", "value": None}, "both_null", True, 0.95),
    ]
    rows = [("T", d["name"], d["key"], str(i), d["value"], 2023, d["row_name"], d["row_idx"], d["col_name"], d["col_idx"], "m") for i, (c, *_) in enumerate(cases) for d in [base | c]]
    got = {int(r.units): r for r in validate.validate(spark.createDataFrame(rows, KPI), p).collect()}
    for i, (change, outcome, ok, confidence) in enumerate(cases):
        assert (got[i].outcome, got[i].is_valid) == (outcome, ok), change
        assert abs(got[i].confidence - confidence) < 1e-9, change
    assert any("row_idx: 0 → 1" in x for x in got[12].fix_instructions)


def test_correction_settles_what_hints_say(spark):
    p = packs(spark, [("T", "Audi Production", ["Units", "2023", "2022"], [["A4", "100", "200"], ["Q5", "300", "400"]])])
    k = spark.createDataFrame([("T", "Production", "Q5", "u", "300", 2023, "Q5", 0, "2023", 1, "m"), ("T", "A4", "A4", "u", "100", 2023, "A4", 0, "2023", 1, "m")], KPI)
    assert {(r.is_valid, r.row_idx) for r in extract.correct(k, p).collect()} == {(True, 1), (True, 0)}


def test_chains(spark):
    rows = [("n", "k", 2020, "1", "u", 0), ("n", "k", 2022, "2", "u", 1), ("n", "k", 2020, "1", "u", 2), ("n", None, 2020, "1", "u", 3), ("n", "k", None, "9", "u", 4)]
    links = chains.link(spark.createDataFrame(rows, "name string, key string, year int, value string, units string, ord int"))
    s = chains.statistics(links).first()
    assert (s.total_nodes, s.linked_nodes, s.chains, s.isolated_nodes) == (4, 2, 1, 2)
    assert chains.statistics(links.limit(0)).first().total_nodes == 0
    assert chains.chain_statistics(links.limit(0)).first().linked_percent is None


def test_failing_model_is_a_row(spark):
    def make():
        def say(_):
            raise RuntimeError("down")

        return say

    p = packs(spark, [("T", "t", ["Units", "2023"], [["A4", "1"]])])
    good, bad = extract.parse(extract.generate(p, make, "m"))
    assert good.count() == 0 and bad.first().error == "down"
