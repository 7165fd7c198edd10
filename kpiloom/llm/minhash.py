"""MinHash near-duplicates with tensored banding.

A text's set is its distinct five-word shingles (64-bit hashes). Instead of one collection of minhashes for each of
m * m tables of 2r rows, two collections of m half-keys of r minhashes each are computed, 2 m r minhashes in all, and table (i, j)
is keyed by the pair of half-key i of the first and half-key j of the second. Two sets of similarity s miss all
m * m tables with probability 1 - (1 - (1 - s**r)**m)**2: at s = 0.75, r = 3, m = 20 below 4 in 100,000.

Equal sets are one class from the start. Links are found in rounds, every link being confirmed on the full sets of both
texts: each class with the smallest class it shares a table key with, then each with the smallest of every key whose
classes are still apart. The tables (i, i) go first, so that a large group of near copies is one component before
the other tables are formed: for those, half-keys all of whose classes are of one component are dropped, as no table
key built from them can join two. Of each key the smallest class has then met all others; those that still share keys
across components are compared in full, in blocks of bounded size by size classes. Rows are emitted for links only,
never for the pairs of a group.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from kpiloom.llm.common import removed, split_join, table, written

SHINGLE, SIMILAR = 5, 75
HALVES, ROWS = 20, 3


def _odd(n: int, seed: str) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(f"{seed}:{i}".encode(), digest_size=8).digest(), "little") | 1 for i in range(n)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTES = _odd(256, "byte")
_STEP = int(_odd(1, "step")[0])
_PLACES = _odd(SHINGLE, "place")
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """step ** k and its inverse modulo 2 ** 64, for k below ``n``."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _STEP), ("down", pow(_STEP, -1, 1 << 64))):
            out = np.ones(size, np.uint64)
            filled = 1
            while filled < size:
                more = min(filled, size - filled)
                out[filled : filled + more] = out[:more] * np.uint64(pow(base, filled, 1 << 64))
                filled += more
            _POWERS[name] = out
    return _POWERS["up"][:n], _POWERS["down"]


def word_hashes(low: bytes) -> np.ndarray:
    """64-bit hash of each word, in order, of an A-Z lower-cased text."""
    b = np.frombuffer(low, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    word = ~_SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], word.view(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers(len(b))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[b] * up, dtype=np.uint64)))
    return _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; of fewer words than a shingle, one hash of all."""
    h = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(h):
        return h
    k = min(SHINGLE, len(h))
    total = h[: len(h) - k + 1] * _PLACES[0]
    for j in range(1, k):
        total = total + h[j : len(h) - k + 1 + j] * _PLACES[j]
    return np.unique(_mixed(total + np.uint64(k)))


_FLIPS = (_odd(2 * HALVES * ROWS, "flip") >> np.uint64(32)).astype(np.uint32)
_TIMES = (_odd(2 * HALVES * ROWS, "times") & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def half_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, 2 * HALVES) half-keys of non-empty sets, each of ROWS minhashes."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.cumsum(sizes) - sizes
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(sets), 2 * HALVES), np.uint64)
    for i in range(2 * HALVES * ROWS):
        least = np.minimum.reduceat((x ^ _FLIPS[i]) * _TIMES[i], starts)
        out[:, i // ROWS] = _mixed(out[:, i // ROWS] + least + np.uint64(i))
    return out


def _sketched(batches):
    for batch in batches:
        texts = batch.column(1).to_pylist()
        s = 0
        while s < len(texts):
            sets, held = [], 0
            while s + len(sets) < len(texts) and held < 1 << 20:
                sets.append(shingles(texts[s + len(sets)]))
                held += len(sets[-1])
            full = [i for i, x in enumerate(sets) if len(x)]
            digest = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
            keys: list = [None] * len(sets)
            for i, row in zip(full, half_keys([sets[i] for i in full]) if full else (), strict=True):
                keys[i] = row.view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(s, len(sets)), batch.column(2).slice(s, len(sets)), pa.array(map(len, sets), pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=[batch.schema.names[0], "text_hash", "n_shingles", "digest", "halves"],
            )
            s += len(sets)


def _confirmed(batches):
    """Pairs (a, b, text_a, text_b) whose sets are similar enough."""
    held: tuple[int, np.ndarray] | None = None
    for batch in batches:
        a, b, ta, tb = (batch.column(i).to_pylist() for i in range(4))
        keep = []
        for i in range(len(a)):
            if held is None or held[0] != b[i]:
                held = b[i], shingles(tb[i])
            x, y = shingles(ta[i]), held[1]
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= SIMILAR * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b): the smallest node reachable.

    Large-star and small-star steps; each round is written, so its plan stays short and lost executors lose nothing.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = split_join(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = split_join(large, low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = written(small.where("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
        mark = now


def _diagonal_keys(classes: DataFrame) -> DataFrame:
    """(key, cid) of the tables (i, i), as many as half-keys of a collection."""
    pair = lambda i: F.xxhash64(F.get("halves", i), F.get("halves", i + HALVES))
    return classes.select(F.explode(F.array(*[pair(F.lit(i)) for i in range(HALVES)])).alias("key"), "cid")


def _table_keys(classes: DataFrame) -> DataFrame:
    """(key, cid, label) of all table keys of which both half-keys are shared by classes of different labels."""
    halves = classes.select("cid", "label", F.posexplode("halves").alias("i", "h")).select("cid", "label", (F.col("i") < HALVES).alias("first"), "h")
    often = halves.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("h")
    side = lambda first: F.collect_list(F.when(F.col("first") == first, F.col("h")))
    kept = split_join(halves, often, "h").groupBy("cid", "label").agg(side(True).alias("x"), side(False).alias("y"))
    pairs = kept.select("cid", "label", F.explode("x").alias("x"), "y").select("cid", "label", "x", F.explode("y").alias("y"))
    return pairs.select(F.xxhash64("x", "y").alias("key"), "cid", "label")


def _told_apart(keys: DataFrame) -> DataFrame:
    """(key, rep) of the keys that classes of different labels share; of keys with the same classes the smallest only.

    Two texts that share x and y half-keys share x * y table keys, which say the same. Sets of classes are told apart
    by their smallest, their number and 128 bits.
    """
    bits = [F.bit_xor(F.xxhash64(F.lit(i), "cid")).alias(f"s{i}") for i in range(2)]
    sets = keys.groupBy("key").agg(F.min("cid").alias("rep"), F.count("*").alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi"), *bits).where("lo <> hi")
    return sets.groupBy("rep", "c", "s0", "s1").agg(F.min("key").alias("key")).select("key", "rep")


def _block_links(pair: pa.Table) -> pa.Table:
    """Links (a, b) between texts of different labels in one pair of blocks, one for each two labels."""
    cid, label = np.array(pair.column("cid").to_pylist()), np.array(pair.column("label").to_pylist())
    side = np.array(pair.column("side").to_pylist())
    sets = [shingles(t) for t in pair.column("text").to_pylist()]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(np.concatenate(sets), kind="stable")
    every = np.concatenate(sets)[order]
    owner = owner[order]
    new = np.concatenate(([True], every[1:] != every[:-1]))
    start = np.flatnonzero(new)
    length = np.diff(np.concatenate((start, [len(every)])))
    run = np.cumsum(new) - 1
    by_text = np.argsort(owner, kind="stable")
    first = np.cumsum(sizes) - sizes
    links: dict = {}
    for x in range(len(sets)):
        if side[x] == 1:  # pairs inside the second block belong to that block's own pair
            continue
        runs = run[by_text[first[x] : first[x] + sizes[x]]]
        runs = runs[length[runs] > 1]
        n = length[runs]
        at = np.repeat(start[runs] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        # both / (x + y - both) >= SIMILAR %
        near = (100 * both >= SIMILAR * (sizes[x] + sizes - both)) & (label != label[x])
        for y in np.flatnonzero(near):
            links.setdefault((min(label[x], label[y]), max(label[x], label[y])), (cid[x], cid[y]))
    a, b = zip(*links.values(), strict=True) if links else ((), ())
    kind = pair.schema.field("cid").type
    return pa.table([pa.array(list(a), kind), pa.array(list(b), kind)], names=["a", "b"])


def _linked_in_blocks(members: DataFrame, texts: DataFrame, pair: StructType, block: int = 256, held: int = 2_000_000) -> DataFrame:
    """Links between ``members`` (cid, n, label, g) of one group g and different labels.

    Sets as similar as SIMILAR % differ in size by a factor of 100 / SIMILAR at most, so a group is cut by size classes
    of that factor, these into blocks of about ``block`` texts and ``held`` shingles, and only blocks of equal or
    neighbouring classes meet, each two in a task of their own. What leaves a task is its links, not its pairs.
    """
    cut = members.withColumn("s", F.floor(F.log("n") / F.log(F.lit(100 / SIMILAR))))
    count = cut.groupBy("g", "s").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") / held)).alias("blocks"))
    placed = cut.join(count, ["g", "s"]).withColumn("k", F.pmod(F.xxhash64("cid"), F.col("blocks"))).select("cid", "label", "g", "s", "k")
    blocks = written(placed.groupBy("g", "s", "k").agg(F.count("*").alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi")), "blocks")
    x, y = (blocks.select("g", *[F.col(c).alias(f"{c}{i}") for c in ("s", "k", "c", "lo", "hi")]) for i in "12")
    meet = x.join(y, "g").where("(s1 = s2 and k1 <= k2) or s2 = s1 + 1").where("least(lo1, lo2) <> greatest(hi1, hi2)")
    meet = meet.withColumn("p", F.struct("g", "s1", "k1", "s2", "k2"))
    same = F.col("p.s1").eqNullSafe(F.col("p.s2")) & (F.col("p.k1") == F.col("p.k2"))
    sides = meet.select(F.explode(F.array_compact(F.array(
        F.struct("p", F.col("s1").alias("s"), F.col("k1").alias("k"), F.lit(0).alias("side")), F.when(~same, F.struct("p", F.col("s2").alias("s"), F.col("k2").alias("k"), F.lit(1).alias("side"))),
    ))).alias("e")).select("e.p", "e.p.g", "e.s", "e.k", "e.side")
    dealt = placed.join(texts, "cid").join(sides, ["g", "s", "k"]).select("p", "side", "cid", "label", "text")
    return written(dealt.groupBy("p").applyInArrow(_block_links, pair), "links")


def _classes(signed: DataFrame, id_col: str) -> DataFrame:
    """(cid, digest, id, text_hash, n, halves) of each distinct set; ``id`` and ``text_hash`` name one row that has it.

    Classes are numbered in order of their smallest id (null last), so the smallest number reachable has the smallest
    id reachable, and classes that share an id stay apart.
    """
    row = F.struct(F.col(id_col).isNull().alias("no"), F.col(id_col).alias("id"), F.col("text_hash"))
    alike = signed.where("digest is not null").groupBy("digest").agg(F.min(row).alias("r"), F.first("n_shingles").alias("n"), F.first("halves").alias("halves"))
    alike = written(alike.select("digest", "r.id", "r.text_hash", "n", "halves"), "alike")
    return written(alike.orderBy(F.asc_nulls_last("id"), "digest").withColumn("cid", F.monotonically_increasing_id()), "classes")


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept, text_hash) of every row: near-duplicate components.

    component_id is the smallest id among the documents reachable over links of similarity SIMILAR % or more, kept says
    that it is the row's own. Null, empty and blank texts have an empty set, link with nothing and are kept. Repeated
    rows are of one class and all have its result; rows of one id with different texts are documents of their own, told
    apart by text_hash, the xxhash64 of the text. Rows without id count in components, take the smallest id of theirs,
    and have a null one, and are kept, if no row of it has an id. An empty table gives an empty result; other columns
    play no part.
    """
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType)]).add("text_hash", "long").add("n_shingles", "long").add("digest", "binary").add("halves", ArrayType(LongType()))
    rows = docs.select(id_col, F.col(text_col).alias("__text"), F.xxhash64(text_col).alias("text_hash"))
    signed = written(rows.mapInArrow(_sketched, schema), "signatures")
    classes = _classes(signed, id_col)
    sizes = classes.select("cid", "n")
    pair = StructType().add("a", "long").add("b", "long")

    def texts_of(tables: DataFrame) -> DataFrame:
        """(cid, text) of the classes in ``tables``, one text for each."""
        asked = classes.join(tables.select("cid").distinct(), "cid", "left_semi").select("cid", F.col("id").alias("__id"), F.col("text_hash").alias("__hash"))
        found = rows.join(asked, (F.col("text_hash") == F.col("__hash")) & F.col(id_col).eqNullSafe(F.col("__id")))
        return written(found.groupBy("cid").agg(F.first("__text").alias("text")), "texts")

    def links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """Those of the distinct pairs (a, b) that are similar; sizes too different are told apart without texts."""
        of = lambda c: sizes.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"))
        full = lambda c: texts.select(F.col("cid").alias(c), F.col("text").alias(f"t{c}"))
        near = pairs.join(of("a"), "a").join(of("b"), "b").where(f"100 * least(na, nb) >= {SIMILAR} * greatest(na, nb)").select("a", "b").distinct()
        return written(near.join(full("a"), "a").join(full("b"), "b").select("a", "b", "ta", "tb").mapInArrow(_confirmed, pair), "links")

    def labelled(parts: DataFrame, of: DataFrame = sizes) -> DataFrame:
        """Classes with their component so far as label, their own number outside any."""
        return of.join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))

    def apart(tables: DataFrame, parts: DataFrame) -> DataFrame:
        """(key, rep, cid, n, label) of keys that still hold classes of more than one component; rep is the smallest of a key."""
        now = written(tables.select("key", "cid").join(labelled(parts), "cid"), "labelled")
        mixed = now.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("cid").alias("rep")).where("lo <> hi").select("key", "rep")
        out = written(split_join(now, mixed, "key"), "apart")
        removed(now)
        return out

    def stars(mixed: DataFrame, parts: DataFrame, texts: DataFrame) -> DataFrame:
        """Links of each class with the smallest of every key of ``mixed``, whose keys hold more than one component."""
        heads = labelled(parts).select(F.col("cid").alias("rep"), F.col("label").alias("rep_label"))
        rest = mixed.select("rep", "cid", "label").distinct()
        return links(rest.join(heads, "rep").where("label <> rep_label").select(F.col("cid").alias("a"), F.col("rep").alias("b")).distinct(), texts)

    # the diagonal of the tables first: what it joins needn't meet in the others
    keys = _diagonal_keys(classes)
    shared = keys.groupBy("key").agg(F.min("cid").alias("rep"), F.count("*").alias("c")).where("c > 1").select("key", "rep")
    tables = written(split_join(keys, shared, "key"), "diagonal")
    texts = texts_of(tables)
    found = links(tables.where("cid <> rep").groupBy("cid").agg(F.min("rep").alias("b")).withColumnRenamed("cid", "a"), texts)
    parts = components(found)
    found = found.unionByName(stars(apart(tables, parts), parts, texts))
    parts = components(found)

    keys = written(_table_keys(labelled(parts, classes.select("cid", "halves"))), "keys")
    tables = written(split_join(keys, _told_apart(keys), "key"), "tables")
    texts = texts_of(tables)
    found = found.unionByName(stars(tables, parts, texts))
    parts = components(found)
    # the smallest class of a key has met all others of it: only those have yet to meet each other
    rest = apart(tables.where("cid <> rep"), parts)
    groups = components(rest.where("cid <> rep").select(F.col("cid").alias("a"), F.col("rep").alias("b")))
    members = written(rest.select("cid", "n", "label").distinct().join(groups.select(F.col("node").alias("cid"), F.col("label").alias("g")), "cid"), "members")
    parts = components(found.unionByName(_linked_in_blocks(members, texts, pair)))

    least = classes.select(F.col("cid").alias("label"), F.col("id").alias("component_id"))
    label = labelled(parts, classes.select("cid", "digest")).join(least, "label").select("digest", "component_id", F.lit(True).alias("of_class"))
    out = signed.drop("halves").join(label, "digest", "left").withColumn("component_id", F.when(F.col("of_class"), F.col("component_id")).otherwise(F.col(id_col)))
    return out.select(id_col, "n_shingles", "component_id", F.col(id_col).eqNullSafe(F.col("component_id")).alias("kept"), "text_hash")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: near-duplicate components of all documents."""
    return similar_sets(table(spark, sf_dir, "documents")).drop("text_hash")


#: Links and components found in full; copies of one set stand for one, so only different sets are paired.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM d),
c AS (SELECT doc_id, count(*) AS n, md5(string_agg(sh, chr(10) ORDER BY sh)) AS g FROM s GROUP BY doc_id),
r AS (SELECT g, min(doc_id) AS cid, any_value(n) AS n FROM c GROUP BY g),
t AS (SELECT s.* FROM s JOIN r ON s.doc_id = r.cid),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM t a JOIN t b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN r a ON a.cid = x JOIN r b ON b.cid = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
reach AS (SELECT cid AS a, cid AS b FROM r UNION SELECT reach.a, e.y FROM reach JOIN e ON reach.b = e.x),
m AS (SELECT a AS cid, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id, coalesce(m.component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN r ON r.g = c.g LEFT JOIN m ON m.cid = r.cid
"""
