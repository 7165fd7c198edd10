"""The temporal graph: nodes by id, edges to the next year that the same metric of the same entity has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.functions import scalars as S


def nodes(facts: DataFrame, order: list[str | Column]) -> DataFrame:
    """Facts by node id; of equal ids the last by ``order`` gives the attributes."""
    df = facts.withColumn("id", S.node_id(F.col("kpi_name"), F.col("key"), F.col("year")))
    last = Window.partitionBy("id").orderBy(*[F.desc(c) if isinstance(c, str) else c for c in order])
    return df.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def edges(nodes: DataFrame, kpi: str | None = None, key: str | None = None) -> DataFrame:
    """(source, target, year_diff, edge_type) between all nodes of a year and all of the next year there is.

    Null metrics are a group like any other; ``kpi`` and ``key`` restrict to one of them, exactly. A pair stands once.
    """
    if kpi is not None:
        nodes = nodes.where(F.col("kpi_name") == kpi)
    if key is not None:
        nodes = nodes.where(F.col("key") == key)
    base = nodes.select("id", "kpi_name", "key", "year")
    years = base.select("kpi_name", "key", "year").distinct()
    nxt = years.withColumn("next_year", F.lead("year").over(Window.partitionBy("kpi_name", "key").orderBy("year"))).where("next_year is not null")
    same = lambda a, b: F.col(f"{a}.kpi_name").eqNullSafe(F.col(f"{b}.kpi_name")) & F.col(f"{a}.key").eqNullSafe(F.col(f"{b}.key"))
    step = base.alias("s").join(nxt.alias("n"), same("s", "n") & (F.col("s.year") == F.col("n.year")))
    out = step.join(base.alias("t"), same("n", "t") & (F.col("n.next_year") == F.col("t.year")))
    return out.select(
        F.col("s.id").alias("source"), F.col("t.id").alias("target"), (F.col("t.year") - F.col("s.year")).alias("year_diff"), F.lit("temporal").alias("edge_type")
    ).dropDuplicates(["source", "target"])


def metadata(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts, distinct metrics and entities, first and last year."""
    distinct = lambda c: F.countDistinct(c) + F.max(F.col(c).isNull().cast("int"))  # noqa: E731  null is a value here
    n = nodes.agg(F.count("*").alias("total_nodes"), F.coalesce(distinct("kpi_name"), F.lit(0)).alias("unique_kpis"), F.coalesce(distinct("key"), F.lit(0)).alias("unique_entities"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    e = edges.agg(F.count("*").alias("total_edges"))
    return n.join(F.broadcast(e), F.lit(True))


def subgraph(nodes: DataFrame, edges: DataFrame, kpi_filter: str | None = None, max_nodes: int | None = None, order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes whose metric holds ``kpi_filter`` (any case), the first ``max_nodes`` by ``order``, and the edges between them."""
    kept = nodes if kpi_filter is None else nodes.where(F.contains(F.lower("kpi_name"), F.lit(kpi_filter.lower())))
    if max_nodes is not None:
        kept = kept.orderBy(*(order or ["id"])).limit(max_nodes)
    ids = kept.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return kept, inside.select("source", "target", "year_diff", "edge_type")


def timeline(nodes: DataFrame, kpi: str, keys: list[str] | None = None) -> DataFrame:
    """(entity, year, value, label) of one metric (any case), of some entities or all."""
    df = nodes.where(F.lower("kpi_name") == kpi.lower())
    if keys is not None:
        df = df.where(F.col("key").isin(keys))
    return df.select(F.col("key").alias("entity"), "year", "value", F.substring("key", 1, 20).alias("label"))


def distribution(nodes: DataFrame) -> DataFrame:
    """(dimension, item, n): nodes by metric, by entity and by year, in one pass over grouping sets."""
    df = nodes.select(F.col("kpi_name"), F.col("key"), F.col("year").cast("string").alias("year"))
    out = df.groupingSets([["kpi_name"], ["key"], ["year"]], "kpi_name", "key", "year").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    kind = F.when(F.col("g") == 3, "kpi").when(F.col("g") == 5, "entity").otherwise("year")
    item = F.when(F.col("g") == 3, F.col("kpi_name")).when(F.col("g") == 5, F.col("key")).otherwise(F.col("year"))
    return out.select(kind.alias("dimension"), item.alias("item"), "n")


def top_entities(nodes: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` entities with the most nodes, names in order where counts are equal."""
    return nodes.groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(k)


def sample_questions(nodes: DataFrame) -> DataFrame:
    """Five questions that the graph can answer, over its first two metrics and entities by name."""
    first = lambda c: nodes.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).limit(2).agg(F.array_sort(F.collect_list(c)).alias(c))
    k = first("kpi_name").join(first("key"), F.lit(True)).select(F.col("kpi_name").alias("k"), F.col("key").alias("e"))
    k = k.where("size(k) >= 2 and size(e) >= 2").select(F.col("k")[0].alias("k1"), F.col("k")[1].alias("k2"), F.col("e")[0].alias("e1"), F.col("e")[1].alias("e2"))
    return k.select(F.explode(F.array(
        F.format_string("Show the trend of %s for %s", "k1", "e1"), F.format_string("Compare %s between %s and %s", "k1", "e1", "e2"),
        F.format_string("Which entity has the highest %s?", "k2"), F.format_string("How did %s change over the years?", "k1"), F.format_string("List all metrics of %s", "e1"),
    )).alias("question"))
