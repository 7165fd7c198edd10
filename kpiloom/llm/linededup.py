"""Line dedup over content-defined chunks of lines and sentences, in DataFrame expressions only.

A text is a run of units, cut after line ends and sentence ends wherever they stand. A hash rolls over each two
neighbouring unit hashes; the least of each ``SPREAD`` in a row marks a boundary, and so does each unit of ``LEAST``
characters. Boundaries rest on what stands there alone, so text put in or left out before shifts none, and a passage
of more than ``SPREAD`` units, or with one unit as long as that, has a boundary of its own wherever it stands.

Around boundaries that stand in more than one place the chunks are grown unit by unit as far as they agree: each two
units near by, and each unit of ``LONE`` characters alone, are grouped by a hash of their bytes (without spaces at their end).
The first place of a group, by (doc_id, place), keeps its units, and its bytes travel to all others: those with the same
bytes, byte for byte, are chunks that go if they hold ``LEAST`` characters together. A piece that shares a hash with
other bytes stays. So a passage goes from its first unit to its last. What
goes at a place stands at an earlier one, so one copy of each unit stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.llm.common import let, removed, split_join, table, written

LEAST, LONE, SPREAD = 60, 200, 4

#: What a unit ends with, and a mark that is set after it; texts that hold the mark are cut by a slower pattern.
ENDS, MARK = ("\n", ". ", "! ", "? "), "\x1e"

#: A piece of a chunk is one number: its first unit times this, and how many units it has (1 or 2).
_RUN = 4


def units(text: Column) -> Column:
    """Units of a text in order; joined they give the text, byte for byte. Blank lines belong to the unit before them."""
    marked = text
    for end in ENDS:
        marked = F.replace(marked, F.lit(end), F.lit(end + MARK))
    marked = F.replace(marked, F.lit(MARK + "\n"), F.lit("\n"))
    slower = F.split(text, r"(?<=\n|[.!?]\x20)(?!\n)", -1)
    return F.filter(F.when(F.contains(text, F.lit(MARK)), slower).otherwise(F.split(marked, MARK, -1)), lambda u: u != "")


def _bare(text: Column) -> Column:
    """Without spaces at its end: the last line of a text has no line end."""
    return F.rtrim(text, F.lit(" \t\r\n"))


def boundaries(us: Column, least: int = LEAST) -> Column:
    """Where a text's boundaries stand: array of (i, h), the first unit and the hash."""

    def marked(own: Column) -> Column:
        def least_of(r: Column) -> Column:
            two = F.transform(r, lambda x, i: F.least(x, F.get(r, i + 1)))
            return let(two, lambda t: F.transform(t, lambda x, i: F.least(x, F.get(t, i + 2))))

        def chosen(r: Column, low: Column) -> Column:
            told = F.transform(r, lambda x, i: F.when((x == F.get(low, i)) | (x == F.get(low, i - 1)) | (x == F.get(low, i - 2)) | (x == F.get(low, i - 3)), F.struct(i.alias("i"), x.alias("h"))))
            return F.filter(told, lambda e: e.isNotNull())

        rolled = lambda h: F.transform(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1)))
        long = F.filter(F.transform(own, lambda x, i: F.when(x["n"] >= least, F.struct(i.alias("i"), x["h"].alias("h")))), lambda e: e.isNotNull())
        return F.concat(let(own["h"], lambda h: let(rolled(h), lambda r: let(least_of(r), lambda low: chosen(r, low)))), long)

    return let(F.transform(us, lambda u: F.struct(F.xxhash64(_bare(u)).alias("h"), F.char_length(_bare(u)).alias("n"))), marked)


def around(places: Column, n: Column) -> Column:
    """The units that a passage with one of the boundaries ``places`` may hold beside it, of a text of ``n``."""
    near = F.transform(places, lambda i: F.sequence(F.greatest(i - SPREAD, F.lit(0)), F.least(i + SPREAD + 1, n - 1)))
    return F.array_distinct(F.flatten(near))


def digest(t: Column) -> Column:
    """Hash of a text's bytes; it says which pieces to compare, their bytes say which are equal."""
    return F.xxhash64(t)


def said(us: Column, piece: Column) -> Column:
    """The text of a piece of the units ``us``, as it is compared."""
    i = F.floor(piece / _RUN).cast("int")
    return _bare(F.when(piece % _RUN == 1, F.get(us, i)).otherwise(F.concat(F.get(us, i), F.get(us, i + 1))))


def pieces(text: Column, places: Column, lone: int = LONE) -> Column:
    """The pieces of chunks around the boundaries ``places`` of a text: array of (piece, hash)."""

    def found(us: Column, at: Column) -> Column:
        piece = lambda i, n, t: F.struct((i.cast("long") * _RUN + n).alias("i"), digest(_bare(t)).alias("s"))
        two = F.transform(at, lambda i: F.when(i + 1 < F.size(us), piece(i, 2, F.concat(F.get(us, i), F.get(us, i + 1)))))
        one = F.transform(at, lambda i: F.when(F.char_length(_bare(F.get(us, i))) >= lone, piece(i, 1, F.get(us, i))))
        return F.filter(F.concat(two, one), lambda e: e.isNotNull())

    return let(units(text), lambda us: let(around(places, F.size(us)), lambda at: found(us, at)))


def lost(us: Column, gone: Column, least: int = LEAST) -> Column:
    """The units of the pieces ``gone`` that stand in runs of ``least`` characters or more."""
    all_of = F.array_sort(F.array_distinct(F.flatten(F.transform(gone, lambda p: F.sequence((p / _RUN).cast("int"), (p / _RUN).cast("int") + (p % _RUN).cast("int") - 1)))))

    def long_ones(at: Column) -> Column:
        first = F.filter(at, lambda x, j: (j == 0) | (F.get(at, j - 1) < x - 1))
        last = F.filter(at, lambda x, j: (j == F.size(at) - 1) | (F.get(at, j + 1) > x + 1))
        chars = lambda some: F.aggregate(some, F.lit(0), lambda n, u: F.least(F.lit(least), n + F.char_length(_bare(u))))
        kept = F.zip_with(first, last, lambda a, b: F.when(chars(F.slice(us, a + 1, b - a + 1)) >= least, F.sequence(a, b)))
        return F.flatten(F.array_compact(kept))

    return let(all_of, long_ones)


def dedup(docs: DataFrame, least: int = LEAST, lone: int = LONE) -> DataFrame:
    """All columns of ``docs`` with repeated passages gone from ``text``, and n_removed (units), chars_removed.

    Rows are never dropped: a text all of whose units stand earlier becomes empty. Null texts stay null and empty
    ones empty. Rows of equal doc_id and text are one document: they keep or lose the same units. Null ids come
    first. Columns named like the two new ones are replaced; others pass unchanged. An empty table gives an empty result.
    """
    cols = [c for c in docs.columns if c not in ("n_removed", "chars_removed")]
    keyed = docs.select(*cols, F.coalesce("doc_id", F.lit(-(1 << 63))).alias("__k1"), F.xxhash64("doc_id", "text").alias("__k2"))
    rows = keyed.select("__k2", F.explode(boundaries(units(F.col("text")), least)).alias("c")).select("__k2", F.col("c.i").alias("__i"), F.col("c.h").alias("__h"))
    rows = written(rows, "boundaries")
    often = rows.groupBy("__h").agg(F.count("*").alias("__n")).where("__n > 1").select("__h")
    listed = written(split_join(rows, often, "__h").groupBy("__k2").agg(F.collect_set("__i").alias("__maybe")), "repeated")
    removed(rows)
    parts = keyed.select("__k1", "__k2", "text").join(listed, "__k2").select("__k1", "__k2", F.explode(pieces(F.col("text"), F.col("__maybe"), lone)).alias("c"))
    parts = written(parts.select("__k1", "__k2", F.col("c.i").alias("__i"), F.col("c.s").alias("__s")), "pieces")
    removed(listed)
    place = F.struct("__k1", "__k2", "__i")
    firsts = parts.groupBy("__s").agg(F.min(place).alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    asked = firsts.groupBy(F.col("__first.__k2").alias("__k2")).agg(F.collect_list(F.struct("__s", "__first")).alias("__asked"))
    given = lambda us: F.transform("__asked", lambda p: F.struct(p["__s"].alias("s"), p["__first"].alias("first"), said(us, p["__first"]["__i"]).alias("t")))
    firsts = keyed.select("__k2", "text").join(asked, "__k2").select(F.explode(let(units(F.col("text")), given)).alias("c"))
    firsts = written(firsts.select(F.col("c.s").alias("__s"), F.col("c.first").alias("__first"), F.col("c.t").alias("__t")).dropDuplicates(["__s"]), "firsts")
    gone = split_join(parts, firsts, "__s").where(place != F.col("__first")).groupBy("__k2").agg(F.collect_set(F.struct(F.col("__i").alias("i"), F.col("__t").alias("t"))).alias("__gone"))
    equal = lambda us: F.transform(F.filter("__gone", lambda p: said(us, p["i"]) == p["t"]), lambda p: p["i"])
    done = keyed.join(gone, "__k2", "left").withColumn("__lost", F.when(F.col("__gone").isNotNull(), let(units(F.col("text")), lambda us: lost(us, equal(us), least))))
    kept = lambda us: F.array_except(F.sequence(F.lit(0), F.size(us) - 1), "__lost")
    left = let(units(F.col("text")), lambda us: F.array_join(F.transform(kept(us), lambda i: F.get(us, i)), ""))
    done = done.withColumn("__left", F.when(F.size("__lost") > 0, left))
    return done.select(
        *[F.coalesce("__left", "text").alias("text") if c == "text" else F.col(c) for c in cols], F.coalesce(F.size("__lost"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.char_length("text") - F.char_length("__left"), F.lit(0)).cast("long").alias("chars_removed"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: line dedup of all documents."""
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
