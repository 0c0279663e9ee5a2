"""Benchmark decontamination by spaced-seed hashing.

Words are lower-cased runs of letters, digits and non-ASCII characters. Fixed
masks select some of the next few words; the words under the other places may
differ, so a hit survives substitutions there. Hashes of all training positions
pass a bit map of the benchmark's hashes (its size is bounded whatever the
benchmark), the survivors are joined in Spark with the benchmark's own hashes,
and every hit is verified along its diagonal: an item counts as contained if
some ``window`` consecutive words of it (all of them in a shorter item) agree
in at least ``similarity`` of the places with the words at the same distance in
the document.

The masks leave no gap: whichever words of a window of seven to fifteen are
changed, as long as it is accepted, some mask lands on unchanged words. Items of
five or six words have shorter masks of their own, items of fewer words must
agree in all of them and are hashed whole; documents are hashed under those
masks only if the benchmark holds such items.

Edge cases: null and empty texts have no words, and items without words are
never found; repeated item or document ids are treated as one; one row per
(document, item) whatever the number of hits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mixed, slices, small_batches, word_hashes, words_of

MASKS = ("11111", "111011", "1101011", "1111001", "1111", "10111", "11011", "11101", "111", "11", "1")
LONG, MIDDLE = range(4), range(4, 8)  # masks of items from seven words on, and of five or six words
LONGEST = max(map(len, MASKS))
SPREAD = 64  # most positions that share one context


def _seeds(hashes: np.ndarray, owner: np.ndarray, mask: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose mask stays within one text, and their keys."""
    last = len(hashes) - len(mask)
    if last < 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    key = np.full(last + 1, number + 1, np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            key = (key ^ hashes[k : k + last + 1]) * np.uint64(0x9DDFEA08EB382D69)
    at = np.flatnonzero(owner[: last + 1] == owner[len(mask) - 1 :])
    return at, mixed(key[at])


def masks_of(words: int) -> Sequence[int]:
    """Numbers of the masks of an item of so many words."""
    return LONG if words >= 7 else MIDDLE if words >= 5 else [i for i, m in enumerate(MASKS) if m == "1" * words]


def _bench_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        words, owner = words_of(batch.column("text"))
        hashes = word_hashes(words)
        first = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        seeds: list[list] = [[] for _ in range(batch.num_rows)]
        size = np.diff(first)
        for number, mask in enumerate(MASKS):
            for at, key in zip(*_seeds(hashes, owner, mask, number), strict=True):
                if number not in masks_of(size[owner[at]]):
                    continue
                seeds[owner[at]].append({"key": int(key.view(np.int64)), "pos": int(at - first[owner[at]]), "mask": number})
        lists = [hashes[a:b].view(np.int64) for a, b in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(lists, pa.list_(pa.int64())), pa.array(seeds, pa.list_(pa.struct([("key", pa.int64()), ("pos", pa.int32()), ("mask", pa.int32())])))], ["item_id", "words", "seeds"])


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", window: int = 15, similarity: float = 0.8, map_bits: int = 25, broadcast_rows: int = 2_000_000) -> DataFrame:
    """One row per (document, item) that overlap: ``key``, ``item``, ``matched`` of ``compared`` words, ``first_word``.

    The benchmark's hashes are broadcast only if they are at most
    ``broadcast_rows``; beyond it the join shuffles both sides by the hash.
    """
    spark = docs.sparkSession
    ids, item_type = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    bench = cut(benchmark.select(F.col(item).alias("item_id"), F.col(text).alias("text")).mapInArrow(_bench_rows, f"item_id {item_type}, words array<bigint>, seeds array<struct<key:bigint,pos:int,mask:int>>").withColumn("uid", F.xxhash64("item_id", "words")), "bench")
    keys = bench.select("uid", F.explode("seeds").alias("s")).select("uid", F.col("s.key").alias("key"), F.col("s.pos").alias("item_pos"), F.col("s.mask").alias("mask"))
    masks = sorted(r["mask"] for r in keys.select("mask").distinct().collect())  # at most as many as there are masks
    keys = keys.drop("mask")
    items = bench.groupBy("uid").agg(F.first("item_id").alias("item_id"), F.first("words").alias("words"))
    count = keys.count()
    bits = min(map_bits, max(16, int(np.ceil(np.log2(16 * max(count, 1))))))
    slots = keys.select(F.shiftrightunsigned("key", 64 - bits).alias("slot")).distinct()
    marks = np.zeros(1 << bits, bool)
    if count:  # at most 2^map_bits distinct slots, in pieces
        for piece in slots.groupBy(F.shiftright("slot", 16)).agg(F.collect_set("slot").alias("slots")).select("slots").toLocalIterator():
            marks[np.array(piece["slots"], np.int64)] = True
    handle = spark.sparkContext.broadcast(np.packbits(marks))
    reach = window - 1

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(handle.value).astype(bool)
        for batch in slices(batches, "text", 4 << 20):
            words, owner = words_of(batch.column("text"))
            hashes = word_hashes(words)
            at, key_of = [], []
            for m in masks:
                p, k = _seeds(hashes, owner, MASKS[m], m)
                ok = known[(k >> np.uint64(64 - bits)).astype(np.int64)]
                at.append(p[ok]), key_of.append(k[ok])
            if not any(map(len, at)):
                continue
            at, key_of = np.concatenate(at), np.concatenate(key_of)
            order = np.argsort(at, kind="stable")
            at, key_of = at[order], key_of[order]
            first = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            # Neighbouring hits share one context; a new one begins in another text, after a gap, or after SPREAD words.
            begins, previous, start = [0], at[0], at[0]
            for i in range(1, len(at)):
                if owner[at[i]] != owner[previous] or at[i] - previous > reach or at[i] - start >= SPREAD:
                    begins.append(i)
                    start = at[i]
                previous = at[i]
            rows = {"row": [], "ctx_start": [], "ctx": [], "seeds": []}
            for a, b in zip(begins, [*begins[1:], len(at)], strict=True):
                doc = owner[at[a]]
                lo, hi = max(at[a] - reach, first[doc]), min(at[b - 1] + LONGEST + reach, first[doc + 1])
                rows["row"].append(doc)
                rows["ctx_start"].append(lo - first[doc])
                rows["ctx"].append(hashes[lo:hi].view(np.int64))
                rows["seeds"].append([{"key": int(k), "pos": int(p - lo)} for k, p in zip(key_of[a:b].view(np.int64), at[a:b], strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("_key").take(pa.array(rows["row"])), pa.array(rows["ctx_start"], pa.int32()), pa.array(rows["ctx"], pa.list_(pa.int64())), pa.array(rows["seeds"], pa.list_(pa.struct([("key", pa.int64()), ("pos", pa.int32())])))], ["_key", "ctx_start", "ctx", "seeds"])

    found = small_batches(docs).select(F.col(key).alias("_key"), F.col(text).alias("text")).mapInArrow(hits, f"_key {ids}, ctx_start int, ctx array<bigint>, seeds array<struct<key:bigint,pos:int>>")
    seeds = found.select("_key", "ctx_start", "ctx", F.explode("seeds").alias("s")).select("_key", "ctx_start", "ctx", F.col("s.key").alias("key"), F.col("s.pos").alias("pos"))
    joined = seeds.join(F.broadcast(keys) if count <= broadcast_rows else keys, "key")
    diagonals = joined.groupBy("_key", "uid", "ctx_start", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.first("ctx").alias("ctx")).join(items, "uid")
    length = F.least(F.lit(window), F.size("words"))
    lo, hi = F.greatest(F.lit(0), -F.col("shift")), F.least(F.size("words"), F.size("ctx") - F.col("shift"))
    same = F.transform(F.sequence("lo", F.col("hi") - 1), lambda t: (F.get("ctx", t + F.col("shift")) == F.get("words", t)).cast("int"))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("same") - F.col("compared") + 1), lambda s: F.aggregate(F.slice("same", s, F.col("compared")), F.lit(0), lambda a, x: a + x)))
    verified = (
        diagonals.withColumn("lo", lo).withColumn("hi", hi).withColumn("compared", length)
        .where(F.col("hi") - F.col("lo") >= F.col("compared"))
        .withColumn("same", same).withColumn("matched", best)
        .where(F.col("matched") >= F.lit(similarity) * F.col("compared"))
        .select("_key", "item_id", "matched", "compared", (F.col("ctx_start") + F.col("lo") + F.col("shift")).alias("first_word"))
    )
    return verified.groupBy("_key", "item_id").agg(F.max("matched").alias("matched"), F.max("compared").alias("compared"), F.min("first_word").alias("first_word")).withColumnsRenamed({"_key": key, "item_id": item})


def remove(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """Documents that overlap no benchmark item; a null key is compared as a value."""
    bad = find(docs, benchmark, key=key, **options).select(F.col(key).alias("_bad")).distinct()
    return docs.join(bad, F.col(key).eqNullSafe(F.col("_bad")), "left_anti")
