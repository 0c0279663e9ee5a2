"""Near-duplicate documents: MinHash bands, odd-sketch estimates, exact confirmation.

A document is the set of its distinct word shingles. Documents with equal sets
form a class at once, so a group of copies costs one representative. Every
class has ``bands * rows`` MinHash samples; classes that agree in all samples
of a band share a bucket. Folding the samples into a parity bit map (an odd
sketch) lets the population count of the XOR of two maps estimate high
similarities precisely; a candidate whose estimate is far below the threshold
is dropped there, the others are confirmed on their full sets.

A bucket never becomes all pairs. In each of ``rounds`` rounds one member of a
bucket (another one each round) is compared with the members outside its
component. What is still apart after the rounds is compared in full: members
outside the bucket's largest component with all members of other components.
So no link between different components is skipped, and members of one
component are never compared again.

Edge cases: a document with fewer words than a shingle is one shingle of its
whole word sequence; without words (or with a null text) the set is empty and
is linked with nothing; repeated rows and copies share a class; ties go to the
smallest id; a row with a null id keeps a null component and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, mixed, slices, small_batches, text_bytes, word_hashes

ROWS, BANDS = 6, 40
SKETCH_BITS = 512
MARGIN = 0.13  # about five standard deviations of the estimate at the threshold

_SPACE = np.arange(256, dtype=np.uint8)
_SPACE[65:91] += 32
_SPACE[9:14] = 32


def _shingles(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, concatenated, and the offsets of each text's part."""
    buf, offs = text_bytes(column)
    clean = pa.StringArray.from_buffers(len(offs) - 1, pa.py_buffer((offs - offs[0]).astype(np.int32)), pa.py_buffer(_SPACE[buf[offs[0] : offs[-1]]]))
    parts = pc.split_pattern(clean, " ")
    words, owner = parts.flatten(), pc.list_parent_indices(parts)
    real = pc.not_equal(words, "")
    words, owner = words.filter(real), owner.filter(real).to_numpy()
    hashes = word_hashes(words)
    size = np.bincount(owner, minlength=len(column))
    first = np.concatenate([[0], np.cumsum(size)])
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64)
    place = np.arange(len(hashes)) - first[owner]
    # A shingle starts wherever k words remain, or at a short text's first word.
    length = np.minimum(size[owner], k)
    starts = place + length <= size[owner]
    starts &= (size[owner] >= k) | (place == 0)
    at = np.flatnonzero(starts)
    key = length[at].astype(np.uint64)
    for j in range(k):
        inside = j < length[at]
        nxt = hashes[np.minimum(at + j, len(hashes) - 1)]
        key = np.where(inside, (key ^ nxt) * np.uint64(0x9DDFEA08EB382D69) + np.uint64(j), key)
    key = mixed(key)
    order = np.lexsort((key, owner[at]))
    key, who = key[order], owner[at][order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (who[1:] != who[:-1])
    key, who = key[fresh], who[fresh]
    return key, np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(column)))])


def _constants(n: int) -> np.ndarray:
    return mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(n, 2)


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        constants = _constants(ROWS * BANDS)
        for batch in slices(batches, "text", 2 << 20):
            sets, offs = _shingles(batch.column("text"), k)
            n = np.diff(offs)
            some = np.flatnonzero(n)
            starts = offs[:-1][some]
            bands = np.zeros((len(some), BANDS), np.uint64)
            sketch = np.zeros((len(some), SKETCH_BITS), bool)
            rows = np.arange(len(some))
            for i, (a, b) in enumerate(constants if len(some) else ()):
                least = np.minimum.reduceat((sets ^ b) * (a | np.uint64(1)), starts)
                band = i // ROWS
                bands[:, band] = mixed(bands[:, band] ^ least + np.uint64(i))
                bit = mixed(least + np.uint64(i * 0x51ED27)) >> np.uint64(64 - 9)
                sketch[rows, bit.astype(np.int64)] ^= True
            total = np.add.reduceat(sets, starts) if len(some) else np.zeros(0, np.uint64)
            other = np.bitwise_xor.reduceat(mixed(sets ^ np.uint64(0xA5A5)), starts) if len(some) else total
            full = lambda x, width: np.zeros((batch.num_rows, width), np.int64) if x is None else x
            keys = np.zeros((batch.num_rows, 2), np.int64)
            keys[some, 0], keys[some, 1] = total.view(np.int64), other.view(np.int64)
            band_rows, sketch_rows = full(None, BANDS), full(None, SKETCH_BITS // 64)
            band_rows[some] = bands.view(np.int64)
            sketch_rows[some] = np.packbits(sketch, axis=1).view(np.int64).reshape(len(some), -1)
            lists = lambda m: pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n.astype(np.int64)), pa.array(keys[:, 0]), pa.array(keys[:, 1]), lists(band_rows), lists(sketch_rows)], ["id", "n", "k1", "k2", "bands", "sketch"])

    return run


def _sets(k: int, known):
    """Shingle sets of the rows whose ``slot`` is set in the broadcast bit map ``known``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            at = batch.column("slot").to_numpy()
            batch = batch.filter(pa.array((known.value[at >> 6] >> (at & 63)) & 1 > 0))
            if not batch.num_rows:
                continue
            sets, offs = _shingles(batch.column("text"), k)
            some = np.flatnonzero(np.diff(offs))
            keys = np.zeros((batch.num_rows, 2), np.int64)
            if len(some):
                keys[some, 0] = np.add.reduceat(sets, offs[:-1][some]).view(np.int64)
                keys[some, 1] = np.bitwise_xor.reduceat(mixed(sets ^ np.uint64(0xA5A5)), offs[:-1][some]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(sets.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(offs)), pa.array(keys[:, 0]), pa.array(keys[:, 1]), lists], ["n", "k1", "k2", "set"])

    return run


def _class_id() -> Column:
    return F.xxhash64("k1", "k2", "n").alias("c")


def _block_links(percent: int):
    """Confirmed links between two blocks of a bucket: for every left member one per foreign component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
                (lc, lcomp, lset, lsize), (rc, rcomp, rset, rsize) = _unpack(left.values), _unpack(right.values)
                order = np.argsort(lset, kind="stable")
                keys, owners = lset[order], np.repeat(np.arange(len(lc)), lsize)[order]
                lo, hi = np.searchsorted(keys, rset, "left"), np.searchsorted(keys, rset, "right")
                many = hi - lo
                who = np.repeat(np.repeat(np.arange(len(rc)), rsize), many)
                at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
                inter = np.bincount(owners[at] * len(rc) + who, minlength=len(lc) * len(rc)).reshape(len(lc), len(rc))
                union = lsize[:, None] + rsize[None, :] - inter
                i, j = np.nonzero((100 * inter >= percent * union) & (lcomp[:, None] != rcomp[None, :]))
                if len(i):
                    _, one = np.unique(np.stack([i, rcomp[j]], 1), axis=0, return_index=True)
                    a.append(lc[i[one]]), b.append(rc[j[one]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def _unpack(block: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sets = block.field("set")
    return block.field("c").to_numpy(), block.field("comp").to_numpy(), sets.flatten().to_numpy(), pc.list_value_length(sets).to_numpy().astype(np.int64)


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(c, comp): every node of ``links`` (a, b) with the smallest node it is connected with.

    Large and small stars in turn (each a minimum per node and a join) until
    every edge points at a root, that is until no node has two targets and no
    target has an edge of its own.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    for _ in range(most):
        ends = edges.select(F.col("a").alias("c"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("b").alias("c"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        if ends.groupBy("c").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where((F.col("out") > 1) | (F.col("out") > 0) & (F.col("into") > 0)).isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = cut(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    return edges.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("comp")).unionByName(edges.select(F.col("b").alias("c"), F.col("b").alias("comp")).distinct())


def _slot(column: str, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(11)), 64 - bits)


def _bit_map(ids: DataFrame, bits: int = 26):
    """A broadcast bit map of fixed size (8 MB) of the slots of ``ids``.

    It keeps most other documents out of what follows; with more ids than the
    map can tell apart it lets more rows pass, never fewer.
    """
    slots = ids.select(_slot(ids.columns[0], bits).alias("slot"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return ids.sparkSession.sparkContext.broadcast(table)


def _estimate() -> Column:
    """Jaccard similarity from the XOR of two odd sketches of ``ROWS * BANDS`` samples."""
    odd = sum((F.bit_count(F.get("s1", F.lit(i)).bitwiseXOR(F.get("s2", F.lit(i)))) for i in range(SKETCH_BITS // 64)), F.lit(0))
    inside = F.greatest(1 - 2 * odd / SKETCH_BITS, F.lit(1e-6))
    return 1 + F.lit(SKETCH_BITS / (4.0 * ROWS * BANDS)) * F.log(inside)


def link(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = 3, percent: int = 85, rounds: int = 1, small: int = 8) -> DataFrame:
    """Per row: ``key``, ``n_shingles``, ``component_id`` (smallest key reachable) and ``kept`` (the key is that smallest)."""
    id_type = docs.schema[key].dataType.simpleString()
    rows = small_batches(docs).select(F.col(key).alias("id"), F.col(text).alias("text"))
    signed = cut(rows.mapInArrow(_signatures(k), f"id {id_type}, n bigint, k1 bigint, k2 bigint, bands array<bigint>, sketch array<bigint>").withColumn("c", _class_id()), "signatures")
    classes = cut(signed.where("n > 0").groupBy("c").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    buckets = classes.select("c", F.explode("bands").alias("key")).repartition("key")
    members = cut(buckets.join(buckets.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key"), "members")
    near = members.select("c").distinct()
    sketches = cut(classes.join(near, "c").select("c", "rep", "sketch"), "sketches")
    # Texts of representatives, told apart by the bit map; what else passes it is no candidate or a copy, and goes by its class.
    sets = rows.select("text", _slot("id", 26).alias("slot")).mapInArrow(_sets(k, _bit_map(sketches.select("rep"))), "n bigint, k1 bigint, k2 bigint, set array<bigint>").withColumn("c", _class_id())
    sets = cut(sets.join(near, "c", "left_semi").dropDuplicates(["c"]).select("c", "n", "set"), "sets")
    least = percent / 100 - MARGIN

    def estimated(pairs: DataFrame) -> DataFrame:
        one, two = sketches.select(F.col("c").alias("a"), F.col("sketch").alias("s1")), sketches.select(F.col("c").alias("b"), F.col("sketch").alias("s2"))
        return pairs.join(one, "a").join(two, "b").withColumn("est", _estimate()).where(F.col("est") >= least).drop("s1", "s2")

    def confirmed(pairs: DataFrame) -> DataFrame:
        one, two = sets.select(F.col("c").alias("a"), F.col("n").alias("n1"), F.col("set").alias("x")), sets.select(F.col("c").alias("b"), F.col("n").alias("n2"), F.col("set").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        return pairs.join(one, "a").join(two, "b").where(100 * both >= percent * (F.col("n1") + F.col("n2") - both)).select("a", "b")

    links: DataFrame | None = None
    comp = members.select("c").limit(0).withColumn("comp", F.col("c"))
    labelled = members.withColumn("comp", F.col("c"))
    for t in range(rounds):
        hub = labelled.groupBy("key").agg(F.min(F.struct(F.xxhash64(F.col("c"), F.lit(t)), "c", "comp")).alias("hub"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
        pairs = labelled.join(hub, "key").where("comp != hub.comp").select(F.col("c").alias("b"), F.col("hub.c").alias("a")).distinct()
        best = estimated(pairs).groupBy("b").agg(F.max_by("a", F.struct("est", "a")).alias("a"))
        found = cut(confirmed(best), "links")
        links = found if links is None else cut(links.unionByName(found), "links")
        comp = cut(components(links), "components")
        labelled = cut(members.join(comp, "c", "left").withColumn("comp", F.coalesce("comp", "c")), "labelled")
    # What is still apart: small buckets as distinct pairs, large ones in blocks against their largest component and each other.
    parts = labelled.groupBy("key", "comp").agg(F.count("*").alias("part"))
    split = parts.groupBy("key").agg(F.max(F.struct("part", "comp")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    active = labelled.join(split, "key")
    lesser = active.where((F.col("size") <= small) & (F.col("comp") != F.col("top.comp")))
    other = labelled.where(F.col("size") <= small).select("key", F.col("c").alias("a"), F.col("comp").alias("comp_a"))
    pairs = lesser.join(other, "key").where("comp != comp_a").select(F.greatest("a", "c").alias("a"), F.least("a", "c").alias("b")).distinct()
    tail = confirmed(estimated(pairs))
    large = active.where(F.col("size") > small).join(sets, "c")
    member = F.struct("c", "comp", "set")

    def blocks(df: DataFrame, n: Column, per: int, name: str) -> DataFrame:
        """Rows of about ``per`` of a bucket's ``n`` members each, dealt by a hash."""
        return df.groupBy("key", F.pmod(F.xxhash64("c", F.lit(7)), F.ceil(n / per)).alias("block")).agg(F.collect_list(member).alias(name)).drop("block")

    outside = blocks(large.where(F.col("comp") != F.col("top.comp")), F.col("size") - F.col("top.part"), 128, "left")
    faced = outside.join(blocks(large, F.col("size"), 64, "right"), "key").select("left", "right").mapInArrow(_block_links(percent), "a bigint, b bigint")
    links = cut(links.unionByName(tail).unionByName(faced), "links")
    comp = components(links)
    reps = classes.select("c", "rep").join(comp, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    named = reps.join(reps.groupBy("comp").agg(F.min("rep").alias("component_id")), "comp").select(F.col("c").alias("_c"), "component_id")
    out = signed.select("id", "n", "c").join(named, F.col("c") == F.col("_c"), "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))


def remove(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group: those whose key is the smallest of its component.

    Rows repeated under one key are told apart by nothing, so all rows of a kept key stay.
    """
    dropped = link(docs, text, key, k, percent).where(~F.col("kept")).select(F.col(key).alias("_gone")).distinct()
    return docs.join(dropped, F.col(key) == F.col("_gone"), "left_anti")
