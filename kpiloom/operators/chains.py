"""Chains: the dated KPIs of one name and key, linked in order of years, and statistics over them.

A chain is exactly the dated nodes of one (name, key), so lengths and coverage are aggregations; no pointer is walked.
KPIs of equal id count once, the last in order standing for them, so no node links to itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.functions import scalars as S


def link(kpis: DataFrame, order: str = "ord") -> DataFrame:
    """KPIs (name, key, year, value lexeme, units, ``order``) with kpi_id, next_kpi_id and prev_kpi_id."""
    df = kpis.withColumn("kpi_id", S.kpi_id(F.col("name"), F.col("key"), F.col("year"), F.col("value")))
    last = Window.partitionBy("kpi_id").orderBy(F.desc(order))
    df = df.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    chain = Window.partitionBy("name", "key", F.col("year").isNull()).orderBy("year", order)
    dated = F.col("year").isNotNull()
    return df.withColumn("next_kpi_id", F.when(dated, F.lead("kpi_id").over(chain))).withColumn("prev_kpi_id", F.when(dated, F.lag("kpi_id").over(chain)))


def statistics(links: DataFrame) -> DataFrame:
    """One row: nodes, linked ones, chains of two or more, isolated ones."""
    nxt, prev = F.col("next_kpi_id").isNotNull(), F.col("prev_kpi_id").isNotNull()
    return links.agg(F.count("*").alias("total_nodes"), F.count_if(nxt | prev).alias("linked_nodes"), F.count_if(nxt & ~prev).alias("chains"), F.count_if(~nxt & ~prev).alias("isolated_nodes"))


def chains(links: DataFrame) -> DataFrame:
    """(name, key, length, first_year, last_year) of each chain of two or more."""
    dated = links.where("next_kpi_id is not null or prev_kpi_id is not null")
    return dated.groupBy("name", "key").agg(F.count("*").alias("length"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def chain_statistics(links: DataFrame) -> DataFrame:
    """One row: average, longest and shortest chain, and the shares of linked and isolated nodes in percent."""
    lengths = chains(links).agg(F.avg("length").alias("avg_length"), F.max("length").alias("max_length"), F.min("length").alias("min_length"))
    s = statistics(links).select(F.expr("try_divide(100.0D * linked_nodes, total_nodes)").alias("linked_percent"), F.expr("try_divide(100.0D * isolated_nodes, total_nodes)").alias("isolated_percent"))
    return lengths.join(F.broadcast(s), F.lit(True))


def length_histogram(links: DataFrame) -> DataFrame:
    return chains(links).groupBy("length").agg(F.count("*").alias("n"))


def top_chains(links: DataFrame, k: int = 5) -> DataFrame:
    return chains(links).orderBy(F.desc("length"), "name", "key").limit(k)


def coverage(kpis: DataFrame) -> DataFrame:
    """(name, key, n_years, year_range) over distinct years that aren't 0 or null."""
    dated = kpis.where("year <> 0")
    out = dated.groupBy("name", "key").agg(F.countDistinct("year").alias("n_years"), F.min("year").alias("a"), F.max("year").alias("b"))
    return out.select("name", "key", "n_years", F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")).alias("year_range"))


def top_coverage(kpis: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` chains of most distinct years."""
    return coverage(kpis).orderBy(F.desc("n_years"), "name", "key").limit(k)


def grouping(kpis: DataFrame) -> DataFrame:
    """Groups at three grains, by name, name and key, and name, key and units, in one pass.

    ``strategy`` tells the grain, since units may be null themselves; distinct counts take null for a value.
    """
    distinct = lambda c: F.countDistinct(c) + F.max(F.col(c).isNull().cast("int"))
    same = kpis.groupBy("name", "key", "units", "year").agg(F.count("*").alias("n"))  # before the grains multiply rows
    df = same.select("name", "key", "units", "year", "n", F.col("key").alias("k"), F.col("units").alias("u"))
    out = df.groupingSets([["name"], ["name", "key"], ["name", "key", "units"]], "name", "key", "units").agg(
        F.grouping_id().alias("g"), F.sum("n").alias("size"), F.countDistinct("year").alias("n_years"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), distinct("k").alias("n_keys"), distinct("u").alias("n_units")
    )
    strategy = F.when(F.col("g") == 3, "name").when(F.col("g") == 1, "name_key").otherwise("name_key_units")
    return out.select(strategy.alias("strategy"), *[c for c in out.columns if c != "g"])


def group_lists(kpis: DataFrame, by: list[str], k: int = 3) -> DataFrame:
    """(by, size, years, n_keys, first_keys, first_units): distinct years, and the first ``k`` keys and units of each group.

    No list but the years' is longer than ``k``, however large a group is.
    """

    def first(c: str) -> DataFrame:
        places = Window.partitionBy(*by).orderBy(c)
        few = kpis.where(F.col(c).isNotNull()).select(*by, c).distinct().withColumn("__n", F.row_number().over(places)).where(F.col("__n") <= k)
        return few.groupBy(*by).agg(F.array_sort(F.collect_list(c)).alias(f"first_{c}"))

    out = kpis.groupBy(*by).agg(F.count("*").alias("size"), F.array_sort(F.collect_set("year")).alias("years"), F.countDistinct("key").alias("n_keys"))
    for c in ("key", "units"):
        few = first(c).withColumnsRenamed({x: f"__{x}" for x in by})
        same = [F.col(x).eqNullSafe(F.col(f"__{x}")) for x in by]
        out = out.join(few, same, "left").drop(*[f"__{x}" for x in by])
    return out.withColumnRenamed("first_key", "first_keys")


def progression(kpis: DataFrame, order: str = "ord") -> DataFrame:
    """(name, key, years, values): distinct years, and values in order of years, first those without year."""
    steps = F.array_sort(F.collect_list(F.struct(F.coalesce("year", F.lit(0)).alias("y"), F.col(order).alias("o"), F.col("value").alias("v"))))
    out = kpis.groupBy("name", "key").agg(F.array_sort(F.collect_set("year")).alias("years"), steps.alias("s"))
    return out.select("name", "key", F.array_join(F.transform("years", lambda y: y.cast("string")), ",").alias("years"), F.array_join(F.transform("s", lambda x: x["v"].cast("string")), ",").alias("values"))


def grouping_summary(groups: DataFrame) -> DataFrame:
    """(strategy, n_groups, n_temporal, avg_size): groups, those of two years or more, and their mean size."""
    return groups.groupBy("strategy").agg(F.count("*").alias("n_groups"), F.count_if(F.col("n_years") >= 2).alias("n_temporal"), F.avg("size").alias("avg_size"))


def top_groups(groups: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` largest groups of each strategy."""
    w = Window.partitionBy("strategy").orderBy(F.desc("size"), F.asc_nulls_first("name"), F.asc_nulls_first("key"), F.asc_nulls_first("units"))
    return groups.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
