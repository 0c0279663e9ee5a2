"""Toxicity by class-conditional Kneser-Ney models.

Two models of the bytes of words, one of the toxic and one of the ordinary
training rows, are interpolated Kneser-Ney models of order six; a word stands
between two boundaries. The top order uses counts, a lower order counts distinct
left neighbours, and both classes share the pooled counts of the two lowest
orders, so that a rare expression is smoothed alike on either side. Most words
of a toxic text are ordinary ones, so its likelihood takes each word from the
toxic model with a chance of ``MIXED`` and else from the ordinary one. A text's
evidence is its toxic less its ordinary log-likelihood per word; a logistic
curve fitted on rows that took no part in the counts turns it into a score.

Spark counts the windows (the last six symbols) of all labelled training rows,
exact copies once, and makes the discounted shares and backoff weights of all
orders from them: the model is a table that grows with the corpus and is never
collected. Scoring gathers the distinct windows of the texts, joins each with
its suffixes in the model and so gets one number per window. These numbers are
broadcast if there are at most ``most`` of them, else joined with the words of
every distinct text. Only the curve's fit is bounded (``max_calibration``
rows, by a hash of the key).

Edge cases: a null or wordless text has evidence 0 and the score of the curve
there; if one class has no training row every score is 0 (no toxic row) or 1;
null keys are never training rows of a label; a key labelled more than once
counts as toxic if any of its labels does; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import CLEAN, cut, field_ddl, mixed, slices, small_batches, text_bytes, words_of

ORDER, SHARED, DISCOUNT = 6, 2, 0.75
MIXED, MOST = 0.02, 30.0
EDGE = 2
SMALL = 1 << 16  # keys of at most two symbols: a table of so many rows at most
FLUSH, SLICE = 1 << 20, 1 << 20
MASKS = np.array([(1 << 8 * k) - 1 for k in range(ORDER + 1)], np.int64)


def windows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The window of every symbol (a word's bytes and its end) as one number, last symbol lowest, and the symbol's text.

    A window ends with its symbol and goes back to the word's boundary, at most ``ORDER`` symbols in all.
    """
    buf, offs = text_bytes(pc.utf8_lower(column))
    size = np.diff(offs)
    data = np.full(int(size.sum()) + len(size) + 8, EDGE, np.uint8)
    clean = CLEAN[buf[offs[0] : offs[-1]]]
    data[np.arange(len(clean)) + np.repeat(np.arange(8, len(size) + 8), size)] = np.where(clean == 32, EDGE, clean)
    edge = data == EDGE
    at = np.arange(len(data), dtype=np.int32)
    before = np.maximum.accumulate(np.where(edge, at, 0))
    real = np.flatnonzero(~(edge[8:] & edge[7:-1])) + 8
    run = np.minimum(real - before[real - 1] + 1, ORDER)
    keys = np.ndarray((len(data) - 7,), ">u8", data.tobytes(), strides=(1,))[real - 7].astype(np.int64) & MASKS[run]
    return keys, np.repeat(np.arange(len(size), dtype=np.int32), size + 1)[real - 8]


def _distinct_words(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of all texts, the place of every word among them, and every word's text."""
    words, owner = words_of(column)
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), owner


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows and their counts per class, added up within a task as far as ``FLUSH`` windows go."""
    keys, sums = np.zeros(0, np.int64), np.zeros((2, 0), np.int64)

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums[0]), pa.array(sums[1])], ["gram", "n0", "n1"])

    for batch in slices(batches, "text", SLICE):
        words, ids, owner = _distinct_words(batch.column("text"))
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)[owner]
        times = np.bincount(ids * 2 + toxic, minlength=2 * len(words)).reshape(-1, 2)
        grams, word = windows_of(words)
        both, inverse = np.unique(np.concatenate([keys, grams]), return_inverse=True)
        sums = np.stack([np.bincount(inverse, np.concatenate([sums[j], times[word, j]]), len(both)).astype(np.int64) for j in (0, 1)])
        keys = both
        if len(keys) > FLUSH // 2:
            yield rows()
            keys, sums = keys[:0], sums[:, :0]
    yield rows()


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    for batch in slices(batches, "text", SLICE):
        held.append(np.unique(windows_of(_distinct_words(batch.column("text"))[0])[0]))
        if sum(map(len, held)) > FLUSH:
            held = [np.unique(np.concatenate(held))]
            if len(held[0]) > FLUSH // 2:
                yield pa.RecordBatch.from_arrays([pa.array(held.pop())], ["gram"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(held)))], ["gram"])


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(key, s0, s1, w0, w1) from windows and their counts ``n0``, ``n1`` per class.

    A key's discounted share after its context, and its weight as the context of a longer key (null: unseen in the class).
    """
    level = counts.where(F.col("gram") >= 1 << 8 * (ORDER - 1)).select("gram", "n0", "n1", (F.col("n0") + F.col("n1")).alias("n2"))
    levels = [level]
    for order in range(ORDER - 1, 0, -1):
        own = counts.where(F.col("gram").between(1 << 8 * (order - 1), (1 << 8 * order) - 1)).select("gram", "n0", "n1", (F.col("n0") + F.col("n1")).alias("n2"))
        left = level.select(F.col("gram").bitwiseAND(int(MASKS[order])).alias("gram"), *[(F.col(n) > 0).cast("long").alias(n) for n in ("n0", "n1", "n2")])
        level = own.unionByName(left).groupBy("gram").agg(*[F.sum(n).alias(n) for n in ("n0", "n1", "n2")])
        levels.append(level)
    rows = levels[0]
    for level in levels[1:]:
        rows = rows.unionByName(level)
    shared = F.col("gram") < 1 << 8 * SHARED
    rows = rows.select("gram", *[F.when(shared, F.col("n2")).otherwise(F.col(n)).cast("double").alias(n) for n in ("n0", "n1")])
    context = Window.partitionBy("context")  # at most 256 keys each
    rows = cut(
        rows.withColumn("context", F.shiftright("gram", 8))
        .withColumns({f"t{j}": F.sum(f"n{j}").over(context) for j in (0, 1)} | {f"k{j}": F.sum((F.col(f"n{j}") > 0).cast("double")).over(context) for j in (0, 1)})
        .select("gram", "context", *[(F.greatest(F.col(f"n{j}") - DISCOUNT, F.lit(0.0)) / F.nullif(F.col(f"t{j}"), F.lit(0.0))).alias(f"s{j}") for j in (0, 1)], *[(F.lit(DISCOUNT) * F.col(f"k{j}") / F.nullif(F.col(f"t{j}"), F.lit(0.0))).alias(f"w{j}") for j in (0, 1)]),
        "kneser-ney",
    )
    none = F.lit(None).cast("double")
    shares = rows.select(F.col("gram").alias("key"), "s0", "s1", none.alias("w0"), none.alias("w1"))
    weights = rows.select(F.col("context").alias("key"), none.alias("s0"), none.alias("s1"), "w0", "w1")
    return shares.unionByName(weights).groupBy("key").agg(*[F.max(c).alias(c) for c in ("s0", "s1", "w0", "w1")])


def probabilities(grams: DataFrame, model: DataFrame) -> DataFrame:
    """(gram, p0, p1): the interpolated probability of the last symbol of every window in ``grams`` under either class."""
    parts = [F.struct(F.lit(o).alias("order"), F.col("gram").bitwiseAND(int(MASKS[o])).alias("key"), F.lit(True).alias("own")) for o in range(1, ORDER + 1)]
    parts += [F.struct(F.lit(o).alias("order"), F.shiftright("gram", 8).bitwiseAND(int(MASKS[o - 1])).alias("key"), F.lit(False).alias("own")) for o in range(1, ORDER + 1)]
    longest = sum(((F.col("gram") >= 1 << 8 * k).cast("int") for k in range(1, ORDER)), F.lit(1))
    keys = grams.select("gram", longest.alias("longest"), F.explode(F.array(*parts)).alias("p")).where(F.col("p.order") <= F.col("longest")).select("gram", "p.*")
    values = ("s0", "s1", "w0", "w1")
    near = keys.where(F.col("key") < SMALL).join(F.broadcast(model.where(F.col("key") < SMALL)), "key")
    far = keys.where(F.col("key") >= SMALL).join(model.where(F.col("key") >= SMALL), "key")
    found = near.unionByName(far)
    one = [F.max(F.when((F.col("order") == o) & (F.col("own") == (v[0] == "s")), F.col(v))).alias(f"{v}_{o}") for o in range(1, ORDER + 1) for v in values]
    wide = found.groupBy("gram").agg(*one)
    p: dict[int, Column] = {}
    for j in (0, 1):
        p[j] = F.lit(1.0 / 256)
        for o in range(1, ORDER + 1):  # a context unseen in the class leaves the shorter one's probability
            p[j] = F.coalesce(F.col(f"s{j}_{o}"), F.lit(0.0)) + F.coalesce(F.col(f"w{j}_{o}"), F.lit(1.0)) * p[j]
    return wide.select("gram", p[0].alias("p0"), p[1].alias("p1"))


@dataclass
class KneserNeyPair:
    """The table of :func:`kneser_ney` and the curve; a constant score where one class has no rows."""

    table: DataFrame | None = None
    slope: float = 0.0
    offset: float = 0.0
    constant: float | None = None


class _Lookup:
    """Windows and their evidence by open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.float32)
        left, slot = np.arange(len(keys)), self._slots(keys)
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[left[free]]
            mine = self.keys[slot] == keys[left]
            self.values[slot[mine]] = values[left[mine]]
            left, slot = left[~mine], (slot[~mine] + 1) & self.last

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys.view(np.uint64)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slots(keys)
        wrong = np.flatnonzero(self.keys[slot] != keys)
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & self.last
            wrong = wrong[self.keys[slot[wrong]] != keys[wrong]]
        return self.values[slot]


def evidence_of(docs: DataFrame, model: KneserNeyPair, keep: tuple[str, ...], text: str = "text", name: str = "evidence", most: int = 4_000_000) -> DataFrame:
    """``keep`` columns and the log-likelihood difference per word of every text."""
    if model.table is None:
        return docs.select(*keep, F.lit(0.0).alias(name))
    rows = small_batches(docs).select(F.col(text).alias("text"))
    grams = rows.mapInArrow(_distinct, "gram bigint").distinct()
    table = cut(probabilities(grams, model.table).select("gram", F.log(F.col("p1") / F.col("p0")).cast("float").alias("e")), "evidence")
    if table.count() > most:
        return _joined(docs, table, keep, text, name)
    found = table.toArrow()
    handle = docs.sparkSession.sparkContext.broadcast((found["gram"].to_numpy(), found["e"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(*handle.value)
        for batch in slices(batches, text, SLICE):
            distinct, ids, owner = _distinct_words(batch.column(text))
            keys, _ = windows_of(distinct)
            ends = np.flatnonzero(keys & 255 == EDGE)  # one a word
            words = np.add.reduceat(lookup(keys).astype(np.float64), np.concatenate([[0], ends[:-1] + 1])) if len(ends) else np.zeros(0)
            share = np.log1p(MIXED * np.expm1(np.minimum(words, MOST)))
            n = np.bincount(owner, minlength=batch.num_rows)
            total = np.bincount(owner, share[ids], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(total / np.maximum(n, 1))], [*keep, name])

    return small_batches(docs).select(*dict.fromkeys((*keep, text))).mapInArrow(run, f"{field_ddl(docs, *keep)}, `{name}` double")


def _joined(docs: DataFrame, table: DataFrame, keep: tuple[str, ...], text: str, name: str) -> DataFrame:
    """The same by joins: the distinct words of every distinct text, their windows, and the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            keys, owner = windows_of(batch.column("text"))
            ends = np.flatnonzero(keys & 255 == EDGE)
            if not len(ends):
                continue
            starts = np.concatenate([[0], ends[:-1] + 1])
            size = ends + 1 - starts
            place = np.arange(len(keys)) - np.repeat(starts, size)
            word = np.add.reduceat(mixed(keys.view(np.uint64) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), starts).view(np.int64)
            order = np.lexsort((word, owner[ends]))
            fresh = np.flatnonzero(np.concatenate([[True], (np.diff(word[order]) != 0) | (np.diff(owner[ends][order]) != 0)]))
            n = np.diff(np.concatenate([fresh, [len(order)]]))
            first = order[fresh]
            grams = [keys[i : j + 1] for i, j in zip(starts[first], ends[first], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("digest").take(pa.array(owner[ends][first])), pa.array(word[first]), pa.array(n), pa.array(grams, pa.list_(pa.int64()))], ["digest", "word", "n", "grams"])

    digest = F.xxhash64(F.col(text))
    texts = small_batches(docs).select(digest.alias("digest"), F.col(text).alias("text")).dropDuplicates(["digest"])
    uses = cut(texts.mapInArrow(run, "digest bigint, word bigint, n bigint, grams array<bigint>"), "words")
    words = uses.dropDuplicates(["word"]).select("word", F.explode("grams").alias("gram")).join(table, "gram").groupBy("word").agg(F.sum(F.col("e").cast("double")).alias("e"))
    share = F.log1p(F.lit(MIXED) * F.expm1(F.least("e", F.lit(MOST))))
    sums = uses.select("digest", "word", "n").join(words, "word").groupBy("digest").agg((F.sum(share * F.col("n")) / F.sum("n")).alias("_mean")).withColumnRenamed("digest", "_digest")
    wide = docs.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)], digest.alias("_own"))
    return wide.join(sums, F.col("_own") == F.col("_digest"), "left").select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], F.coalesce("_mean", F.lit(0.0)).alias(name))


def train(docs: DataFrame, labels: DataFrame, is_training: Column, calibrate: Column, text: str = "text", key: str = "doc_id", label: str = "toxic", max_calibration: int = 20_000) -> KneserNeyPair:
    """``is_training`` rows with a label are learned from; those where ``calibrate`` holds fit the curve only."""
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg((F.max(F.col(label).cast("int")) > 0).alias("toxic"))
    texts = docs.where(is_training & F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("text"), calibrate.alias("calibrate"))
    # Copies count once, under their smallest key. Spark broadcasts the short sides only where they are small.
    first = texts.select("_key", F.xxhash64("text").alias("digest")).join(marks, "_key").groupBy("digest").agg(F.min("_key").alias("_key"), F.max("toxic").alias("toxic"))
    first = cut(first.groupBy("_key").agg(F.max("toxic").alias("toxic")), "labels")
    rows = small_batches(texts).join(first, "_key")
    counts = rows.where(~F.col("calibrate")).select("text", "toxic").mapInArrow(_counted, "gram bigint, n0 bigint, n1 bigint").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = cut(counts, "windows")
    seen = counts.agg(F.max("n0").alias("n0"), F.max("n1").alias("n1")).first()
    if not seen["n0"] or not seen["n1"]:
        return KneserNeyPair(constant=float(bool(seen["n1"])))
    model = KneserNeyPair(cut(kneser_ney(counts), "model"))
    held = rows.where("calibrate")
    share = min(1.0, max_calibration / max(1, held.select("_key").count()))
    held = held.where(F.pmod(F.xxhash64(F.col("_key").cast("string"), F.lit(5)), F.lit(1 << 20)) < int((1 << 20) * share))
    sample = evidence_of(held.select("_key", "toxic", "text"), model, ("_key", "toxic")).orderBy("_key").toArrow()
    model.slope, model.offset = _logistic(sample["evidence"].to_numpy(), sample["toxic"].to_numpy(zero_copy_only=False).astype(float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton steps on two parameters with a weak ridge; both classes weigh the same."""
    if not len(x) or y.min() == y.max():
        return 1.0, -1.0
    w = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
    scale = max(x.std(), 1e-9)
    design = np.stack([x / scale, np.ones(len(x))], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (w * (y - p)) - 1e-2 * beta
        hess = (design * (w * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])


def _score(model: KneserNeyPair, evidence: Column) -> Column:
    if model.constant is not None:
        return F.lit(float(model.constant))
    return 1 / (1 + F.exp(-(F.lit(model.slope) * evidence + F.lit(model.offset))))


def predict(docs: DataFrame, model: KneserNeyPair, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns plus ``score`` (0 to 1) and ``predicted`` (1 if score >= 0.5)."""
    rows = evidence_of(docs, model, keep, text, "_evidence").withColumn("score", _score(model, F.col("_evidence")))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).select(*keep, "score", "predicted")


def remove(docs: DataFrame, model: KneserNeyPair, text: str = "text") -> DataFrame:
    """All columns of the rows that score below one half, whatever the columns are called."""
    rows = evidence_of(docs, model, tuple(docs.columns), text, "_evidence of toxicity")
    return rows.where(_score(model, F.col("_evidence of toxicity")) < 0.5).select(*docs.columns)
