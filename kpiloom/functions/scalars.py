"""Scalar functions over report text, all built-in column expressions.

Two number dialects are kept apart: ``clean_number`` (a comma parts thousands) and ``parse_number`` (a comma may be the
decimal mark). Neither takes ``nan``, ``inf`` or ``1_000`` for a number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

# Cells that say that there is no number.
NO_DATA = ("–", "-", "N/A", "n/a", "x", "")
NO_DATA_WORDS = (*NO_DATA, "nan", "NaN", "null", "NULL")
NULL_MARKS = ("–", "—", "", "x", "X", "n/a", "N/A")

# Metric names by patterns; the first metric with a pattern in the text wins.
METRICS = {
    "sales_revenue": ["sales revenue", "revenue", "turnover"],
    "vehicle_sales": ["vehicle sales", "unit sales", "sales"],
    "operating_result": ["operating result", "operating profit", "profit"],
    "production": ["production", "produced", "manufactured", "units"],
    "deliveries": ["deliveries", "delivered", "thousand units"],
    "return_on_sales": ["return on sales", "operating return", "margin"],
    "key_figures": ["key figures", "key metrics"],
    "general_metric": ["metric", "figure", "data"],
    "vehicle_production": ["vehicle production", "car production", "auto production"],
    "brand_sales": ["brand sales", "model sales"],
    "financial_performance": ["financial performance", "financial results"],
}

# Words that titles are named without, and words that mark units.
SMALL_WORDS = ("the", "a", "an", "of", "by", "in", "for", "with")
UNIT_WORDS = r"(?i)unit|thousand|million|billion|€|\$|%"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, with ``value`` computed once and the expression not copied for each use."""
    return F.transform(F.array(value), body)[0]


def kept(c: Column) -> Column:
    """``c`` as it is, where later filters on it must not be rewritten in terms of what it is made from.

    Filters are else pushed below each step that made a column, its whole expression copied once for each use.
    """
    return F.when(F.monotonically_increasing_id() >= 0, c)


def strip(c: Column) -> Column:
    """Without white space at both ends, in the Unicode sense."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def to_double(c: Column) -> Column:
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def _bare(c: Column) -> Column:
    """Without footnote marks, commas and spaces."""
    return F.translate(F.regexp_replace(c, r"(?U)\s*\^\w*", ""), ", ", "")


def is_number_cell(c: Column) -> Column:
    """Is the cell a number, footnotes apart? (false for null)"""
    return F.coalesce(~strip(c).isin(*NO_DATA) & _bare(strip(c)).rlike(NUMBER), F.lit(False))


def clean_number(c: Column) -> Column:
    """The cell's number, commas parting thousands; 0.0 where there is none."""
    return F.coalesce(to_double(strip(_bare(c))), F.lit(0.0))


def is_number_text(c: Column) -> Column:
    """Is the text a number, one sign and one percent sign apart?"""
    bare = F.regexp_replace(F.regexp_replace(_bare(strip(c)), "%$", ""), r"^[+-]", "")
    return F.coalesce(~strip(c).isin(*NO_DATA_WORDS) & bare.rlike(NUMBER), F.lit(False))


def is_word_text(c: Column) -> Column:
    """Is the text words: no number, only plain characters, a letter at least?"""
    plain = r"""(?U)^[a-zA-Z0-9\s\-'&/(),.%€$£¥°²³]+$"""
    return F.coalesce(~blank(c) & ~is_number_text(c) & strip(c).rlike(plain) & strip(c).rlike("[A-Za-z]"), F.lit(False))


def parse_number(c: Column) -> Column:
    """The text's number in either dialect; null where there is none.

    Null marks, minus signs of all kinds, decimal commas of one to four digits, brackets for minus, currency signs,
    footnotes and the suffixes K, M, B and T are understood, in this order.
    """

    def decimal(t: Column) -> Column:
        tight = F.regexp_replace(t, r"\s", "")
        comma = t.rlike(r"^\s*-?[\d.\s]*,(\s*\d){1,4}\s*$")
        return F.when(comma, F.translate(tight, ",.", ".")).otherwise(F.replace(t, F.lit(","), F.lit("")))

    def minus(t: Column) -> Column:
        return F.when(t.rlike(r"^\(.*\)$"), F.concat(F.lit("-"), F.regexp_extract(t, r"^\((.*)\)$", 1))).otherwise(t)

    def scaled(t: Column) -> Column:
        last = F.upper(F.right(t, F.lit(1)))
        scale = F.when(last == "K", 1e3).when(last == "M", 1e6).when(last == "B", 1e9).when(last == "T", 1e12)
        return let(F.regexp_replace(F.regexp_replace(t, "[KMBTkmbt]$", ""), r"\s", ""), lambda x: to_double(x) * F.coalesce(scale, F.lit(1.0)))

    def number(t: Column) -> Column:
        bare = let(let(F.regexp_replace(t, "[–—−]", "-"), decimal), minus)
        return F.when(~t.isin(*NULL_MARKS), let(strip(F.regexp_replace(F.regexp_replace(bare, "[€$£¥]", ""), r"\^\d+\.?\d*", "")), scaled))

    return let(strip(c), number)


def year_of(c: Column) -> Column:
    """The first year 20xx that stands alone."""
    return F.nullif(F.regexp_extract(c, r"\b(20\d{2})\b", 1), F.lit("")).try_cast("int")


def metric_of(c: Column) -> Column:
    """A header without its year, lower-cased; null for a bare year."""
    return F.lower(strip(F.nullif(F.regexp_replace(c, r"\s*20\d{2}\s*$", ""), F.lit(""))))


def normalize_metric(c: Column) -> Column:
    """The first metric of METRICS one of whose patterns stands in the text; else the text, lower-cased."""
    low = F.lower(c)
    out = None
    for name, patterns in METRICS.items():
        hit = low.rlike("|".join(patterns))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(low)


def units_in(c: Column) -> Column:
    """What stands in the first brackets; null without any."""
    return F.when(c.rlike(r"\([^\n]*?\)"), strip(F.regexp_extract(c, r"\(([^\n]*?)\)", 1)))


def title_context(c: Column) -> Column:
    """A title's part before its first dash, as an ASCII name."""
    t = F.coalesce(c, F.lit(""))
    part = F.when(F.contains(t, F.lit("–")), F.substring_index(t, "–", 1)).otherwise(F.substring_index(t, "-", 1))
    name = F.regexp_replace(F.replace(F.lower(strip(part)), F.lit(" "), F.lit("_")), "[^a-zA-Z0-9_]", "")
    return F.when(name == "", "general_metric").otherwise(name)


def title_metric(c: Column) -> Column:
    """A title's first two words that say something, joined."""
    t = strip(F.translate(F.lower(F.coalesce(c, F.lit(""))), "–-", "  "))
    said = F.filter(F.split(t, r"(?U)\s+"), lambda w: ~w.isin("", *SMALL_WORDS))
    return F.when(F.size(said) > 0, F.array_join(F.slice(said, 1, 2), "_")).otherwise("general_metric")


def key_metric(c: Column) -> Column:
    """A row label without what stands in brackets."""
    return strip(F.regexp_replace(c, r"(?U)\s*\([^\n]*?\)\s*", ""))


def key_units(c: Column) -> Column:
    return F.coalesce(units_in(c), F.lit("N/A"))


def header_units(headers: Column) -> Column:
    """Units that the first header names, in order."""
    first = F.coalesce(F.get(headers, F.lit(0)), F.lit(""))
    said = F.coalesce(units_in(first), strip(first))
    parts = F.transform(F.split(said, "/", -1), strip)
    return F.when(F.contains(said, F.lit("/")), parts).when(said.rlike(UNIT_WORDS), F.array(said)).otherwise(F.array(F.lit("N/A")))


def units_at(units: Column, i: Column) -> Column:
    """Units by place, the last for all places beyond."""
    return F.get(units, F.least(i, F.size(units) - 1))


def table_year_strict(c: Column) -> Column:
    """Year of a table id of two letters and exactly four digits before the first underscore."""
    return F.nullif(F.regexp_extract(c, r"^\p{L}{2}(\d{4})(?=_|$)", 1), F.lit("")).try_cast("int")


def table_year_medium(c: Column) -> Column:
    """Year of a table id that begins with two letters and four digits."""
    return F.nullif(F.regexp_extract(c, r"^\p{L}{2}(\d{4})", 1), F.lit("")).try_cast("int")


def in_year_lax(c: Column, year: str) -> Column:
    """Does a table id belong to a year? Ids with a short prefix belong to every year."""
    prefix = F.substring_index(c, "_", 1)
    return (F.length(prefix) < 6) | (F.substring(prefix, 3, 4) == year)


def node_id(kpi: Column, key: Column, year: Column) -> Column:
    text = F.concat_ws("_", F.coalesce(kpi, F.lit("None")), F.coalesce(key, F.lit("None")), F.coalesce(year.cast("string"), F.lit("None")))
    return F.translate(text, " /", "__")


def kpi_id(name: Column, key: Column, year: Column, lexeme: Column) -> Column:
    """sha256 over name, key, year and the value's lexeme; nulls are spelled ``None``."""
    said = [F.coalesce(c.cast("string"), F.lit("None")) for c in (name, key, year, lexeme)]
    return F.sha2(F.concat_ws("|", *said), 256)


def cell_id(table_id: Column, row: Column, col: Column) -> Column:
    return F.concat(table_id, F.lit("_R"), row.cast("string"), F.lit("C"), col.cast("string"))


def title_case(c: Column) -> Column:
    """Each run of letters capitalised."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")


def node_label(key: Column, year: Column, value: Column) -> Column:
    return F.concat_ws("\n", F.substring(key, 1, 10), year.cast("string"), value.cast("string"))


def model_json(text: Column) -> Column:
    """From model text, after its last ``</think>``, the first ``{`` to the last ``}``; without both, the text itself."""
    tail = F.substring_index(text, "</think>", -1)
    found = F.regexp_extract(tail, r"(?s)\{.*\}", 0)
    return F.when(found == "", text).otherwise(found)


def parsed_kpis(text: Column) -> Column:
    """The ``kpis`` array of model JSON; null if it doesn't parse or has none."""
    from kpiloom.schemas import KPI

    return F.from_json(text, f"kpis array<{KPI}>", {"mode": "PERMISSIVE"})["kpis"]
