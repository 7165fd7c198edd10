"""Language-model scores from a log-bilinear neural model trained by noise-contrastive estimation.

Corpus statistics cover all training text: the count of every token (a distributed sum, kept as a table), and the
counts of unit pairs. Units are the ``frequent`` most frequent words, the end of a text, and ``classes`` classes that
share all other words by their last two characters, so the pair counts, the model and its table of normalised
log-probabilities have a fixed bound of units squared, whatever the corpus.

The model scores unit w after unit u as a[u] . b[w] + bias[w]. It is trained on the driver, in numpy, on the pair
counts: noise-contrastive estimation with ``noise`` noise units for each pair, in expectation over the noise, so every
pair of the corpus counts and reruns agree. One batched matrix product then gives all scores, normalised over units.
A word of a class gets the class's probability times (c + 1) / (class tokens + class words + 1), so the probabilities
of all known words and of one unknown word of each class add up to one after every unit.

Scoring deals texts to blocks of about ``block`` tokens, and these to as many tasks, ``most_tasks`` at most; a task
holds one block at a time. Each block asks the table of counts for its distinct words once, so what is shuffled is the
text, and each block's vocabulary.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from kpiloom.llm.common import table, written

#: The end of a text; no word holds a line break.
END = "\n"


def tokens(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text, A-Z lower-cased, and the end."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), b"\n"]


def _counted(batches):
    held: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            held.update(tokens(text))
            if len(held) > 500_000:
                yield out()
                held = Counter()
    yield out()


class Units(dict):
    """word: unit. Words that aren't frequent are put in a class when first met."""

    def __init__(self, frequent: list[str], classes: int):
        super().__init__({w.encode(): i for i, w in enumerate(frequent)})
        self[b"\n"] = len(frequent)
        self.fixed, self.classes = len(self), classes
        self.size = self.fixed + classes

    def __missing__(self, word: bytes) -> int:
        tail = word.decode("utf-8", "surrogatepass")[-2:].encode("utf-8", "surrogatepass")
        unit = self.fixed + zlib.crc32(tail) % self.classes
        if len(self) < 1_000_000:
            self[word] = unit
        return unit


def class_of(word: Column, fixed: int, classes: int) -> Column:
    """As ``Units`` does for words that aren't frequent."""
    return F.crc32(F.encode(F.right(word, F.lit(2)), "utf-8")) % classes + fixed


def _paired(frequent: list[str], classes: int):
    def run(batches):
        units = Units(frequent, classes)
        n, end = units.size, units[b"\n"]
        sums, held, size = np.zeros(n * n, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = tokens(text)
                ids = np.fromiter(map(units.__getitem__, words), np.int64, len(words))
                held.append(np.concatenate(([end], ids[:-1])) * n + ids)
                size += len(ids)
                if size > 1 << 20:
                    sums += np.bincount(np.concatenate(held), minlength=n * n)
                    held, size = [], 0
        if held:
            sums += np.bincount(np.concatenate(held), minlength=n * n)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["pair", "n"])

    return run


def train(pairs: np.ndarray, width: int = 24, noise: int = 25, steps: int = 150, rate: float = 0.05, seed: int = 1) -> np.ndarray:
    """Normalised log10 probabilities (unit before, unit) from counts of the same shape."""
    n = len(pairs)
    total = pairs.sum()
    share = (pairs.sum(axis=0) + 0.5) / (total + 0.5 * n)
    rng = np.random.default_rng(seed)
    own = (pairs / max(total, 1)).astype(np.float32)
    before = own.sum(axis=1, keepdims=True)
    log_noise = np.log(noise * share).astype(np.float32)
    pull = before * (noise * share).astype(np.float32)
    params = [rng.normal(0, 0.1, (n, width)).astype(np.float32), rng.normal(0, 0.1, (n, width)).astype(np.float32), np.log(share).astype(np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = np.sqrt(before / before.mean() + 1e-3) if total else before  # rare contexts move as well
    for step in range(1, steps + 1 if total else 1):
        a, b, bias = params
        real = 1 / (1 + np.exp(-(a @ b.T + bias - log_noise)))
        slope = own * (1 - real) - pull * real
        for i, g in enumerate((slope @ b / weight, slope.T @ a, slope.sum(axis=0))):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            params[i] = params[i] + rate * (1 - step / (steps + 1)) * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-12)
    a, b, bias = (p.astype(np.float64) for p in params)
    score = a @ b.T + bias
    top = score.max(axis=1, keepdims=True)
    return (score - top - np.log(np.exp(score - top).sum(axis=1, keepdims=True))) / math.log(10)


def _vocabulary(block: pa.Table) -> pa.Table:
    found: set[bytes] = set()
    for text in block.column("text").to_pylist():
        found.update(tokens(text))
    found.discard(b"\n")
    return pa.table({"block": pa.array([block.column("block")[0].as_py()] * len(found), pa.int64()), "word": pa.array(list(found), pa.binary()).cast(pa.string())})


SCORES = (("n_tokens", LongType()), ("n_known", LongType()), ("train_tokens", LongType()), ("base_score", DoubleType()), ("score", DoubleType()))


def _scored(model, id_name: str):
    def run(_, docs: pa.Table, known: pa.Table) -> pa.Table:
        frequent, classes, logs, in_class, n, v, ends = model.value
        units = Units(frequent, classes)
        words = [*known.column("word").cast(pa.binary()).to_pylist(), b"\n"]
        at = {w: i for i, w in enumerate(words)}
        c = np.append(known.column("c").fill_null(0).to_numpy(), ends)
        unit = np.append(known.column("unit").to_numpy(), units[b"\n"])
        for w, u in units.items():
            if w in at:
                unit[at[w]] = u
        base = np.log10((c + 1) / (n + v + 1))
        extra = np.where(unit < units.fixed, 0.0, np.log10((c + 1) / in_class[unit]))
        end = units[b"\n"]
        rows = []
        for text in docs.column("text").to_pylist():
            ws = tokens(text)
            i = np.fromiter(map(at.__getitem__, ws), np.int64, len(ws))
            u = unit[i]
            rows.append((len(ws), int((c[i] > 0).sum()), n, float(base[i].sum()), float(logs[np.concatenate(([end], u[:-1])), u].sum() + extra[i].sum())))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = [pa.int64()] * 3 + [pa.float64()] * 2
        return pa.table([docs.column(id_name), docs.column("held_out"), *(pa.array(x, k) for x, k in zip(cols, kinds, strict=True))], names=[id_name, "held_out", *(x for x, _ in SCORES)])

    return run


def score(docs: DataFrame, held_out: Column, frequent: int = 640, classes: int = 383, block: int = 1_000_000, most_tasks: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Learns from rows that aren't held out. Null, empty and blank texts have one token, their end. Without training rows
    every base score is 0 and the units are equally likely. Repeated rows count, and are scored, each; other columns
    play no part; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    training = docs.where(~held_out).select(text.alias("text"))
    sums = training.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))
    counts = written(sums, "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    words = counts.where(F.col("word") != END)
    top = [r["word"] for r in words.orderBy(F.desc("c"), "word").limit(frequent).collect()]
    ends = next((r["c"] for r in counts.where(F.col("word") == END).collect()), 0)
    units = Units(top, classes)
    in_class = np.ones(units.size)
    rare = words.where(~F.col("word").isin(top)) if top else words
    for r in rare.groupBy(class_of(F.col("word"), units.fixed, classes).alias("unit")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        in_class[r["unit"]] = r["c"] + r["v"] + 1
    found = training.mapInArrow(_paired(top, classes), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    pairs = np.zeros(units.size**2)
    pairs[found["pair"].to_numpy(np.int64)] = found["n"].to_numpy(float)
    logs = train(pairs.reshape(units.size, units.size))
    model = docs.sparkSession.sparkContext.broadcast((top, classes, logs.astype(np.float32), in_class, int(n), int(v), int(ends)))
    blocks = max(1, -(-int(n) // block))
    # tasks grow with the blocks, so none reads more at greater sizes; both readers of the texts share one shuffle
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(blocks, most_tasks))
    dealt = docs.select(id_col, held_out.alias("held_out"), text.alias("text")).withColumn("block", F.pmod(F.xxhash64(id_col, "text"), F.lit(blocks))).repartition(tasks, "block")
    asked = dealt.groupBy("block").applyInArrow(_vocabulary, "block long, word string")
    told = asked.join(counts, "word", "left").select("block", "word", "c").repartition(tasks, "block")
    told = told.withColumn("unit", class_of(F.col("word"), units.fixed, classes))  # frequent words get theirs when scored
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField("held_out", BooleanType()), *(StructField(x, k) for x, k in SCORES)])
    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_scored(model, id_col), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: scores of all documents."""
    return score(table(spark, sf_dir, "documents"), F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False)))
