import pytest
from pyspark.sql import functions as F

from kpiloom.functions import scalars as S

NUMBERS = [
    ("4069", True, 4069.0, 4069.0), ("1,234", True, 1234.0, 1.234), ("4,810,640", True, 4810640.0, 4810640.0), ("2102 ^6", True, 2102.0, 2102.0), ("-195", True, -195.0, -195.0),
    ("–195", False, 0.0, -195.0), ("1.234,56", True, 1.23456, 1234.56), ("(500)", False, 0.0, -500.0), ("5K", False, 0.0, 5000.0), ("€10", False, 0.0, 10.0),
    ("5%", False, 0.0, None), ("–", False, 0.0, None), ("x", False, 0.0, None), ("N/A", False, 0.0, None), ("", False, 0.0, None), ("nan", False, 0.0, None), ("1_000", False, 0.0, None),
    ("+8,7", True, 87.0, 87.0), ("113,762", True, 113762.0, 113.762), (None, False, 0.0, None),
]


def test_number_dialects(spark):
    df = spark.createDataFrame([(i, n[0]) for i, n in enumerate(NUMBERS)], "i int, t string")
    rows = df.select("i", S.is_number_cell(F.col("t")).alias("ok"), S.clean_number(F.col("t")).alias("c"), S.parse_number(F.col("t")).alias("p")).collect()
    for r in rows:
        text, ok, clean, parsed = NUMBERS[r.i]
        assert (r.ok, r.c) == (ok, clean), text
        assert r.p == (pytest.approx(parsed) if parsed is not None else None), text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("function", "text", "want"),
    [
        (S.metric_of, "VEHICLE SALES 2022", "vehicle sales"), (S.metric_of, "2022", None), (S.metric_of, "2017 ^1", "2017 ^1"), (S.metric_of, "FY2022", "fy"),
        (S.year_of, "SALES 2022", 2022), (S.year_of, "1999", None), (S.title_context, "ŠKODA – KEY FIGURES", "koda"), (S.title_context, "", "general_metric"),
        (S.title_metric, "Production of the Group", "production_group"), (S.key_metric, "Deliveries (thousand units)", "Deliveries"), (S.key_units, "Deliveries", "N/A"),
        (S.normalize_metric, "Return on sales", "vehicle_sales"), (S.table_year_strict, "VW20191_T1", None), (S.table_year_medium, "VW20191_T1", 2019), (S.table_year_strict, "VW2019_T1", 2019),
        (S.is_word_text, "Thousand vehicles/€ million", True), (S.is_word_text, "ŠKODA", False), (S.is_word_text, "€", False), (S.is_number_text, "5%", True), (S.is_number_text, "%", False),
        (S.title_case, "audi_production", "Audi_Production"), (S.model_json, "<think>{</think> a {\"k\":1} b", '{"k":1}'), (S.model_json, "none", "none"),
    ],
)
def test_text(spark, function, text, want):
    assert one(spark, function(F.lit(text))) == want


def test_ids_spell_null(spark):
    assert one(spark, S.node_id(F.lit(None).cast("string"), F.lit("a b/c"), F.lit(2020))) == "None_a_b_c_2020"
    import hashlib

    assert one(spark, S.kpi_id(F.lit("n"), F.lit(None), F.lit(2020), F.lit("1.0"))) == hashlib.sha256(b"n|None|2020|1.0").hexdigest()
