"""Target-distribution importance resampling: array-scored weights and parallel sorting by regular sampling.

Features are the runs of one to three consecutive words; a feature's bucket is
its crc32 modulo ``BUCKETS``. The crc32 of a run comes from those of its words
(checksums of concatenations are linear), so no run is ever spelled out. Bucket
counts of the corpus and of the target are vectors of fixed length, summed
within tasks and then in Spark; their gains are one array of ``BUCKETS``
integers, and a document's weight is the sum of the array over its features.

Gumbel noise drawn from the document's id turns weights into scores, and the
highest scores are the sample. They are ranked by regular sampling: every
partition is sorted locally and written as a run; equally spaced members of the
runs give regular splitters; rows go to the segment between two splitters; the
segments' counts, added up, tell each segment's first rank, so segments behind
the last drawn rank stay where they are; the others are exchanged and merged
locally. A row's key ends with its place in its run, so rows that are equal in
everything else still lie on both sides of a splitter.

Edge cases: a null text counts as empty and has weight 0; a null id is hashed
like the empty text and comes after other ids on ties; repeated rows each take
a place (which of two equal rows comes first is not defined); an empty corpus
or target has no features, gains stay finite; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import CLEAN, cut, field_ddl, slices, small_batches, text_bytes

BUCKETS = 10_000
BLOCK = 1 << 20  # words looked at together
LEAST_ROWS, MOST_SEGMENTS = 256, 4096  # of a segment; of all

# --- checksums ---------------------------------------------------------------


@lru_cache(1)
def one_byte() -> np.ndarray:
    """Table of 4 x 256: what a zero byte appended to a text does to each byte of its crc32."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    rest = [np.arange(256, dtype=np.uint32) << np.uint32(8 * (i - 1)) for i in (1, 2, 3)]
    return np.stack([step, *rest])


def shifted(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


@lru_cache(4096)
def many_bytes(n: int) -> np.ndarray:
    """The table of n appended bytes, by halving."""
    if n == 1:
        return one_byte()
    half = many_bytes(n // 2)
    table = np.stack([shifted(row, half) for row in half])
    return table if n % 2 == 0 else np.stack([shifted(row, one_byte()) for row in table])


def words_at(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word of the texts and the index of its text; ``buf`` holds cleaned bytes."""
    word = buf != 32
    edge = word.copy()
    edge[1:] = word[1:] & ~word[:-1]
    starts = offs[:-1][np.diff(offs) > 0]
    edge[starts] = word[starts]  # a text begins anew
    begin = np.flatnonzero(edge)
    stop = word.copy()
    stop[:-1] = word[:-1] & ~word[1:]
    stop[starts[1:] - 1] = word[starts[1:] - 1]
    return begin, np.flatnonzero(stop) + 1, np.searchsorted(offs, begin, "right") - 1


def word_crcs(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """crc32 of every word and of a space with the word behind it; each distinct word is looked at once."""
    offsets = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(buf[buf != 32])]).dictionary_encode()
    names = coded.dictionary.to_pylist()
    alone, spaced = (np.array([zlib.crc32(w, start) for w in names], np.uint32) for start in (0, SPACE))
    at = coded.indices.to_numpy()
    return alone[at], spaced[at]


SPACE = zlib.crc32(b" ")


def buckets(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of every feature of the texts, in blocks."""
    begin, end, text = words_at(buf, offs)
    alone, spaced = word_crcs(buf, begin, end)
    size = end - begin + 1  # with the space before it
    for a in range(0, len(begin), BLOCK):
        b = min(len(begin), a + BLOCK)
        run = alone[a:b]
        yield text[a:b], run % BUCKETS
        for more in (1, 2):
            n = min(b, len(begin) - more) - a  # runs that begin in the block
            if n <= 0:
                break
            last = slice(a + more, a + more + n)
            run = joined(run[:n], spaced[last], size[last])
            whole = text[a : a + n] == text[last]
            yield text[a : a + n][whole], run[whole] % BUCKETS


def joined(crc: np.ndarray, tail: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of texts with tails of the given sizes behind them."""
    out = np.empty(len(crc), np.uint32)
    order = np.argsort(size.astype(np.uint16) if size.max(initial=0) < 1 << 16 else size, kind="stable")
    sizes, starts = np.unique(size[order], return_index=True)
    for n, at in zip(sizes.tolist(), np.split(order, starts[1:]), strict=True):
        out[at] = shifted(crc[at], many_bytes(n)) ^ tail[at]
    return out


def _cleaned(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    buf, offs = text_bytes(batch.column("text"))
    return CLEAN[buf[offs[0] : offs[-1]]], offs - offs[0]


# --- weights -----------------------------------------------------------------


def bucket_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(bucket, n) over all features of all texts; a task sends one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for piece in slices(batches, "text"):
            for _, found in buckets(*_cleaned(piece)):
                total += np.bincount(found, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    return small_batches(texts).select(F.col(text).alias("text")).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of every bucket: an array of ``BUCKETS`` integers, whatever the corpus."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("bigint").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("bigint").alias("s"), F.col("n").alias("t")))
    rows = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).toArrow()
    s, t = np.zeros(BUCKETS), np.zeros(BUCKETS)
    s[rows["bucket"].to_numpy()], t[rows["bucket"].to_numpy()] = rows["s"].to_numpy(), rows["t"].to_numpy()
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``n_words``, ``n_features`` and ``weight`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            n = np.zeros((3, piece.num_rows), np.int64)
            buf, offs = _cleaned(piece)
            n[0] = np.bincount(words_at(buf, offs)[2], minlength=piece.num_rows)
            for owner, found in buckets(buf, offs):
                n[1] += np.bincount(owner, minlength=piece.num_rows)
                n[2] += np.bincount(owner, gain[found], piece.num_rows).astype(np.int64)  # integers below 2**53: exact
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), *map(pa.array, n)], [*keep, "n_words", "n_features", "weight"])

    return small_batches(docs).select(*keep, F.col(text).alias("text")).mapInArrow(run, f"{field_ddl(docs, *keep)}, n_words bigint, n_features bigint, weight bigint")


def noise(key: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first eight hex digits of sha256("seed:key")."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


# --- ranks by regular sampling -------------------------------------------------


def ranked(rows: DataFrame, score: str, tie: str, eligible: Column, percent: int = 5) -> DataFrame:
    """``rows`` with ``rank``: 1, 2, ... of the highest ``percent`` of the eligible rows, by ``score`` and then the smaller ``tie``; null for others."""
    fine = rows.withColumn("_in", F.coalesce(eligible, F.lit(False)))
    runs = cut(fine.sortWithinPartitions(F.desc("_in"), F.desc(score), F.asc_nulls_last(tie)).withColumn("_at", F.monotonically_increasing_id()), "runs")
    lengths = runs.where("_in").groupBy(F.shiftright("_at", 33).alias("run")).agg(F.count("*").alias("n")).agg(F.count("*").alias("runs"), F.sum("n").alias("n")).first()
    n, k = lengths["n"] or 0, (lengths["n"] or 0) * percent // 100
    if not k:
        return runs.drop("_in", "_at").withColumn("rank", F.lit(None).cast("bigint"))
    segments = int(np.clip(n // LEAST_ROWS, 1, MOST_SEGMENTS))
    step = max(1, min(n // (8 * segments), n // (4 * lengths["runs"])))  # at most 8 * MOST_SEGMENTS or 4 * runs samples
    place = F.col("_at").bitwiseAND((1 << 33) - 1)
    key = [F.col(score).alias("score"), F.col(tie).cast("bigint").alias("tie"), F.col("_at").alias("at")]
    picked = runs.where(F.col("_in") & (place % step == step // 2)).select(*key).toArrow()
    order = _order(picked)
    cuts = picked.take(pa.array(order[np.unique(np.arange(1, segments) * len(order) // segments)])) if segments > 1 and len(order) else picked.slice(0, 0)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The segment of every row: how many splitters lie before it."""
        for batch in batches:
            part = pa.table({"score": batch.column(score), "tie": batch.column(tie).cast(pa.int64()), "at": batch.column("_at")})
            at = _order(pa.concat_tables([part, cuts]))
            segment = np.empty(len(at), np.int64)
            segment[at] = np.cumsum(at >= batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment[: batch.num_rows], pa.int32())], [*batch.schema.names, "_segment"])

    placed = runs.where("_in").mapInArrow(dealt, f"{field_ddl(runs, *runs.columns)}, _segment int")
    counts = placed.groupBy("_segment").count().orderBy("_segment").toArrow().to_pydict()  # MOST_SEGMENTS rows at most
    first = dict(zip(counts["_segment"], np.cumsum([0, *counts["count"][:-1]]).tolist(), strict=True))
    drawn = [s for s, before in first.items() if before < k]
    before = rows.sparkSession.createDataFrame([(s, first[s]) for s in drawn], "_segment int, _before bigint")
    local = F.row_number().over(Window.partitionBy("_segment").orderBy(F.desc(score), F.asc_nulls_last(tie), "_at"))
    merged = placed.where(F.col("_segment") <= max(drawn)).withColumn("_local", local).join(F.broadcast(before), "_segment").withColumn("rank", F.col("_before") + F.col("_local"))
    merged = merged.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    columns = [*rows.columns, "rank"]
    rest = placed.where(F.col("_segment") > max(drawn)).drop("_segment").unionByName(runs.where("NOT _in")).withColumn("rank", F.lit(None).cast("bigint"))
    return merged.select(*columns).unionByName(rest.select(*columns))


def _order(t: pa.Table) -> np.ndarray:
    """Rows by score downwards, tie (nulls last), place."""
    tie = t["tie"].combine_chunks() if isinstance(t["tie"], pa.ChunkedArray) else t["tie"]
    return np.lexsort((t["at"].to_numpy(), tie.fill_null(0).to_numpy(zero_copy_only=False), tie.is_null().to_numpy(zero_copy_only=False), -t["score"].to_numpy()))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 42, percent: int = 5, least_words: int = 20) -> DataFrame:
    """Every document's ``key``, n_features, weight, score and its rank in the sample (null: not drawn)."""
    gain = gains(bucket_counts(docs, text), bucket_counts(target, text))
    scored = weigh(docs, gain, text, (key,)).withColumn("score", F.col("weight") + noise(F.col(key), seed))
    return ranked(scored, "score", key, F.col("n_words") >= least_words, percent=percent).select(key, "n_features", "weight", "score", "rank", "n_words")
