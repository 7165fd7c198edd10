"""Secret scan: fixed patterns, and two character Markov models compared by log-likelihood ratio.

Everything is a DataFrame expression. A pattern's matches come from ``regexp_extract_all``; their places from the
lengths of the pieces that ``split`` leaves between them. The models (random strings against ordinary identifiers)
are trained from labelled samples with DataFrame aggregations over character pairs; what reaches the driver is one
count for each label and pair of 7-bit characters, at most 2 * 128 * 128 rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.llm.common import let, table

# The base patterns, the group whose length counts, and its least length.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)

#: A cheap pattern for each kind that is found in every text that has a counting match of that kind.
HINT = {"assign": r"(?i)(?:passw|secret|token|api_?key)", "access": "AKIA", "hex": "[0-9a-f]{24}"}

#: Candidates of the Markov models: all whole runs of 16 or more such characters.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
ORDER = ("assign", "access", "hex", "markov")

#: Words of which the sample identifiers are made.
IDENTIFIER_WORDS = (
    "account action address amount array async author base batch block buffer build byte cache call channel chunk "
    "class client cluster code column commit config connection content context count counter create current data "
    "database date default delete device directory document driver edge element engine entry error event export "
    "factory field file filter flag format frame function graph group handle handler hash header host image import "
    "index init input instance item iterator job key label language layer length level library license limit line "
    "link list load local log loop manager map mask match matrix memory message method mode model module name "
    "network node number object offset option order output package page parameter parent parser partition path "
    "pattern plan point pool port prefix process profile project property protocol query queue range rate record "
    "reference region register report request response result return role root route row sample schema scope score "
    "script search section segment select sequence server service session setting shape shard size slice source "
    "space stage start state status step stop storage stream string structure style suffix system table tag target "
    "task template test text thread time title topic total trace train transaction tree trigger type unit update "
    "user value variable vector version view weight width window word worker write zone"
).split()


def samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """``n`` labelled strings of each label, made by rule: (token, random)."""
    ids = spark.range(n)
    digest = F.sha2(F.concat(F.lit("sample:"), F.col("id").cast("string")), 256)
    in64 = F.regexp_replace(F.base64(F.unhex(digest)), "=+$", "")
    random = ids.select(
        F.when(F.col("id") % 3 == 0, digest).when(F.col("id") % 3 == 1, in64).otherwise(F.upper(F.regexp_replace(in64, "[+/]", "7"))).alias("token"),
        F.lit(True).alias("random"),
    )
    pool = F.split(F.lit(" ".join(IDENTIFIER_WORDS)), " ")
    pick = lambda k: F.get(pool, F.pmod(F.xxhash64("id", F.lit(k)), F.size(pool)).cast("int"))
    number = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(100)).cast("string")
    ordinary = ids.select(
        F.when(F.col("id") % 4 == 0, F.concat_ws("_", pick(1), pick(2), pick(3), number))
        .when(F.col("id") % 4 == 1, F.concat(pick(1), F.initcap(pick(2)), F.initcap(pick(3)), number))
        .when(F.col("id") % 4 == 2, F.concat_ws("-", pick(1), pick(2), pick(3), F.concat(F.lit("v"), number)))
        .otherwise(F.concat_ws("/", pick(1), F.upper(pick(2)), F.concat(pick(3), pick(4)), F.concat(F.lit("20"), F.lpad(number, 2, "0"))))
        .alias("token"),
        F.lit(False).alias("random"),
    )
    return random.unionByName(ordinary)


def train(labelled: DataFrame) -> list[float]:
    """log2 of random's over ordinary's probability of the second character after the first, at 128 * first + second.

    Characters beyond 7 bits and tokens that are null or shorter than two take no part; each count starts at 1/2.
    """
    chars = F.transform(F.split("token", ""), lambda c: F.ascii(c))
    pairs = labelled.where(F.length("token") > 1).select(
        "random", F.explode(let(chars, lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.get(c, i - 1) * 128 + F.get(c, i)))).alias("pair")
    )
    counts = {(r["random"], r["pair"]): r["n"] for r in pairs.where("pair between 0 and 16383").groupBy("random", "pair").agg(F.count("*").alias("n")).collect()}
    used = [ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]
    out = [0.0] * 16384
    for a in used:
        of = {label: sum(counts.get((label, 128 * a + b), 0) + 0.5 for b in used) for label in (True, False)}
        for b in used:
            k = 128 * a + b
            out[k] = math.log2((counts.get((True, k), 0) + 0.5) / of[True]) - math.log2((counts.get((False, k), 0) + 0.5) / of[False])
    return out


def matches(text: Column, pattern: str, group: int) -> Column:
    """All matches in order: array of (start, end, token), code points, end exclusive; token is the group's text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    token = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), F.arrays_zip(found.alias("m"), token.alias("t")), lambda s, x: F.struct(F.char_length(s).alias("gap"), F.char_length(x["m"]).alias("n"), x["t"].alias("token")))

    def placed(ms: Column) -> Column:
        ends = let(F.transform(ms, lambda x: x["gap"] + x["n"]), lambda v: running(v))
        return F.zip_with(ms, ends, lambda x, e: F.struct((e - x["n"]).alias("start"), e.alias("end"), x["token"].alias("token")))

    return let(zipped, placed)


def running(values: Column, block: int = 64) -> Column:
    """Running sums of an array, by blocks: no array is grown element by element."""
    add = lambda some: F.aggregate(some, F.lit(0), lambda a, x: a + x)
    some = lambda n, body: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), body)).otherwise(F.array().cast("array<int>"))
    whole = some((F.size(values) / block).cast("int"), lambda b: add(F.slice(values, b * block + 1, F.lit(block))))
    before = let(whole, lambda w: F.transform(F.sequence(F.lit(0), F.size(w)), lambda b: add(F.slice(w, F.lit(1), b))))

    def at(b: Column) -> Column:
        inside = lambda i: add(F.slice(values, i - i % block + 1, i % block + 1))
        return F.transform(values, lambda _, i: F.get(b, (i / block).cast("int")) + inside(i))

    return let(before, at)


def base_spans(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Spans (start, kind, end) of the matches whose token has ``least`` characters or more."""
    long = F.filter(matches(text, pattern, group), lambda m: F.char_length(m["token"]) >= least)
    return F.transform(long, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def ratio(token: Column, model: Column) -> Column:
    """Mean log2 likelihood ratio for each pair of neighbouring characters."""
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c))
    total = lambda c: F.aggregate(F.sequence(F.lit(1), F.size(c) - 1), F.lit(0.0), lambda s, i: s + F.coalesce(F.get(model, F.get(c, i - 1) * 128 + F.get(c, i)), F.lit(0.0)))
    return let(codes, lambda c: total(c) / (F.size(c) - 1))


def scan(docs: DataFrame, threshold: float = 1.0, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every whole text: (id, spans array of (start, kind, end), base array of the same).

    ``kind`` is the place in ORDER. Base spans come from the fixed patterns. A candidate of the Markov models is
    added if its mean log-likelihood ratio reaches ``threshold`` and it overlaps no base span.
    Null and empty texts have no spans. Repeated rows are scanned each on its own; other columns play no part.
    """
    spark = docs.sparkSession
    weights = train(samples(spark) if labelled is None else labelled)
    model = F.split(F.lit(",".join(f"{x:.4g}" for x in weights)), ",").cast("array<double>")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    for k, (name, pattern, group, least) in enumerate(BASE):
        df = df.withColumn(name, F.when(F.col("t").rlike(HINT[name]), base_spans(F.col("t"), k, pattern, group, least)).otherwise(none))
    df = df.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    found = F.filter(matches(F.col("t"), CANDIDATE, 0), lambda m: (ratio(m["token"], model) >= threshold) & ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    extra = F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(3).alias("kind"), m["end"].alias("end")))
    df = df.withColumn("markov", F.when(F.col("t").rlike(CANDIDATE), extra).otherwise(none))
    return df.select(F.col("id").alias(id_col), "base", F.array_sort(F.concat("base", "markov")).alias("spans"))


def spelled(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(x) for x in ORDER])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: secrets of all documents."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"),
    )
