"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Blocks of ``block`` words go to sources by highest quotients votes / (2 k + 1), votes being the sources' targets, and
then, the same way, from each source to its shards, votes being the shards' sizes. Inside a shard the documents stand
in a seeded order and are cut into blocks; the shard's quota takes the first blocks, a second lap repeating documents
once all are taken. A document is taken with the block that holds its middle word, so a shard misses its quota by at
most half a document. No text is shuffled: only ids, sizes and sources are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kpiloom.llm.common import table, words, written

# Fixed values of the contract: weights by a source's place, share of all words, most copies of a source.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2


def apportion(parties: DataFrame, group: list[str], key: str, votes: str, seats: str) -> DataFrame:
    """``parties`` with ``quota``: the ``seats`` of each group dealt by highest quotients votes / (2 k + 1).

    Rounding votes * seats / all votes (as doubles, which can't overflow) leaves out at most half as many seats as there are parties; the highest (or
    lowest) quotients settle those. Ties go to the smaller key, null first. Groups without votes get nothing.
    """
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    first = F.coalesce(F.floor(F.expr(f"try_divide(CAST({votes} AS DOUBLE) * {seats}, __all)") + 0.5), F.lit(0)).cast("long")
    start = parties.withColumn("__all", F.sum(votes).over(whole)).withColumn("__first", first)
    start = start.withColumn("__left", F.when(F.col("__all") > 0, F.col(seats) - F.sum("__first").over(whole)).otherwise(F.lit(0)))
    more = start.where("__left <> 0").select(
        *group, key, votes, "__first", "__left", F.explode(F.sequence(F.lit(0).cast("long"), F.abs("__left") - 1)).alias("__k")
    )
    up = F.col("__left") > 0
    quotient = F.when(up, F.col(votes) / (2 * (F.col("__first") + F.col("__k")) + 1)).otherwise(-F.col(votes) / (2 * (F.col("__first") - F.col("__k")) - 1))
    by = Window.partitionBy(*(group or [F.lit(0)])).orderBy(F.desc("__q"), F.asc_nulls_first(key), "__k")
    settled = (
        more.where(up | (F.col("__first") > F.col("__k"))).withColumn("__q", quotient).withColumn("__rank", F.row_number().over(by))
        .where(F.col("__rank") <= F.abs("__left")).groupBy(*group, key).agg(F.sum(F.signum("__left")).cast("long").alias("__more"))
    )
    settled = settled.select(*[F.col(c).alias(f"__{c}") for c in [*group, key]], "__more")
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [*group, key]])
    return start.join(settled, on, "left").select(*parties.columns, (F.col("__first") + F.coalesce("__more", F.lit(0))).alias("quota"))


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) with ``target``: weighted shares of SHARE of all words, none above MOST times its size.

    A table of one row for each source; it is sorted by the level at which a source is full, so that the level where
    the rest shares by weight alone follows from running sums.
    """
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.get(F.array(*[F.lit(w) for w in WEIGHTS]), F.pmod(place, F.lit(len(WEIGHTS))))
    df = sources.withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size"))
    one = Window.partitionBy(F.lit(0))
    line = one.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = F.coalesce(F.sum("cap").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(line.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("level", (SHARE * F.sum("source_size").over(one) - before) / after)
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("full"), F.col("level").alias("level")))).over(one)["level"]
    return df.withColumn("at", level).select(
        "source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("at") * F.col("weight"), F.col("cap").cast("double"))).alias("target")
    )


def mix(docs: DataFrame, size: Column | None = None, block: int = 64, shard: int = 1 << 20, shards: int = 4096, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row of ``docs`` (doc_id, source, text).

    Null texts have size 0; size-0 documents are never taken. The null source counts as one, last. Repeated rows are
    documents of their own, so each may be taken; rows of equal id, source and size may swap places. An empty table
    gives an empty result. Columns other than those three play no part. ``copies`` is 0, 1 or 2.
    """
    size = F.size(words(F.col("text"))).cast("long") if size is None else size
    sizes = written(docs.select("doc_id", "source", size.alias("size")), "sizes")
    aim = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    blocks = F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block).cast("long")
    of = written(apportion(aim.withColumn("seats", blocks), [], "source", "target", "seats"), "targets")
    of = of.select(F.col("source").alias("of_source"), "source_size", "target", F.col("quota").alias("seats"))
    n = F.least(F.lit(shards).cast("long"), F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_size") / shard)))
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    dealt = (
        sizes.withColumn("draw", draw)
        .join(of, F.col("source").eqNullSafe(F.col("of_source")))
        .select("doc_id", "source", "size", "source_size", "target", "seats", "draw", F.pmod(F.conv(F.substring("draw", 1, 8), 16, 10).cast("long"), n).alias("shard"))
    )
    by_shard = apportion(dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("seats").alias("seats")), ["source"], "shard", "shard_size", "seats")
    line = Window.partitionBy("source", "shard").orderBy("draw", F.asc_nulls_first("doc_id"), "size")
    quotas = by_shard.select(F.col("source").alias("q_source"), F.col("shard").alias("q_shard"), "shard_size", (F.col("quota") * block).alias("words"))
    placed = dealt.withColumn("middle", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2)
    copies = (F.col("middle") < F.col("words")).cast("int") + (F.col("shard_size") + F.col("middle") < F.col("words")).cast("int")
    return (
        placed.join(quotas, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")))
        .withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(0)))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all documents mixed to their sources' targets."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT *, 2 * source_size AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM src),
f AS (SELECT *, cap / weight AS full_at FROM w),
l AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce((SELECT arg_min(level, full_at) FROM l WHERE level * weight <= cap) * weight, CAST(cap AS DOUBLE))) AS target FROM l),
n AS (SELECT *, CAST(round(sum(target) OVER () / 64) AS BIGINT) AS seats, sum(target) OVER () AS votes FROM t),
q AS (SELECT source, k FROM (SELECT source, k, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS FIRST, k) AS r, seats
      FROM (SELECT source, target, seats, unnest(range(CAST(target * seats / votes AS BIGINT) + 40)) AS k FROM n WHERE votes > 0)) WHERE r <= seats),
of AS (SELECT n.source, source_size, target, (SELECT count(*) FROM q WHERE q.source IS NOT DISTINCT FROM n.source) AS quota,
       least(4096, greatest(1, CAST(ceil(source_size / 1048576) AS BIGINT))) AS shards FROM n),
d AS (SELECT s.doc_id, s.source, s.size, of.source_size, of.target, of.quota, md5('mix:' || coalesce(CAST(s.doc_id AS VARCHAR), '')) AS draw, of.shards
      FROM s JOIN of ON s.source IS NOT DISTINCT FROM of.source),
e AS (SELECT *, CAST('0x' || substr(draw, 1, 8) AS BIGINT) % shards AS shard FROM d),
h AS (SELECT source, shard, sum(size) AS shard_size, any_value(quota) AS quota FROM e GROUP BY source, shard),
hq AS (SELECT source, shard FROM (SELECT source, shard, row_number() OVER (PARTITION BY source ORDER BY shard_size / (2 * k + 1) DESC, shard, k) AS r, quota
       FROM (SELECT source, shard, shard_size, quota, unnest(range(CAST(shard_size * quota / votes AS BIGINT) + 40)) AS k
             FROM (SELECT *, sum(shard_size) OVER (PARTITION BY source) AS votes FROM h) WHERE votes > 0)) WHERE r <= quota),
hn AS (SELECT source, shard, count(*) AS blocks FROM hq GROUP BY source, shard),
p AS (SELECT e.doc_id, e.size, e.source_size, e.target, h.shard_size, 64 * coalesce(hn.blocks, 0) AS words,
      sum(e.size) OVER (PARTITION BY e.source, e.shard ORDER BY e.draw, e.doc_id NULLS FIRST, e.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - e.size / 2 AS middle
      FROM e JOIN h ON e.source IS NOT DISTINCT FROM h.source AND e.shard = h.shard
      LEFT JOIN hn ON e.source IS NOT DISTINCT FROM hn.source AND e.shard = hn.shard)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size > 0 THEN size * (CAST(middle < words AS INT) + CAST(shard_size + middle < words AS INT)) ELSE 0 END AS BIGINT) AS taken FROM p
"""
