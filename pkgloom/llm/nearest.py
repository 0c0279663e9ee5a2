"""Approximate nearest neighbours by adaptive dimension scan within probed lists.

Vectors are rotated by a fixed random orthogonal matrix and dealt to lists by
their nearest centroid (k-means on a bounded sample; every vector is indexed).
A list's vectors are packed in rows of at most ``PACK``, column blocks side by
side; packs are written once and dealt to as many shares as their list needs,
and queries go to these shares in blocks that leave their task one by one, so
neither grows with the tables. A query visits its ``probes`` nearest lists first, and then every other
list that may hold a vector as near as the ``k``-th found: a list's vectors lie
on their centroid's side of the plane halfway to the query's nearest centroid,
so the distance to that plane excludes lists without a loss. There, partial
distances over the first column blocks are scaled up; a candidate whose partial
distance already exceeds what a candidate at the current tenth-best distance
would show, by the margin of a hypothesis test, is abandoned. Survivors get the
exact distance on the original vectors. Only the test can miss a neighbour.

Edge cases: null, zero or non-finite vectors, vectors with null components and
those of another than the most frequent dimension take no part; ties go to the
smaller id; repeated ids appear once, at their smallest distance; with fewer
than ``k`` candidates all of them are returned.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, small_batches

PACK, QUERIES, STEP, SALT = 1024, 256, 16, 16
BATCH = 4 << 20  # bytes of blocks in a record batch
PACKED = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
EPSILON = 2.1  # margin of the hypothesis test


@dataclass
class Index:
    rotation: np.ndarray
    centroids: np.ndarray
    probes: int


def valid(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector takes part, all of one dimension."""
    v = F.col(vector)
    fine = vectors.where(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0))
    dims = fine.groupBy(F.size(v).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return fine.where(F.size(v) == (dims["d"] if dims else 0))


def fit(vectors: DataFrame, vector: str, key: str, sample: int = 20_000, lists: int | None = None, share: float = 0.25, rounds: int = 12) -> Index:
    """k-means centroids of at most about ``sample`` vectors, taken by a hash of the key."""
    n = vectors.count()
    chosen = vectors.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / max(1, n))) + 1).orderBy(key).select(F.col(vector).cast("array<double>").alias("v")).toArrow()
    x = _matrix(chosen["v"].combine_chunks() if chosen.num_rows else pa.array([[1.0]]), np.float64)
    rng = np.random.default_rng(7)
    rotation = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
    count = min(lists or int(np.clip(np.sqrt(n) / 3, 1, 4096)), len(x))
    centroids = x[rng.choice(len(x), count, replace=False)]
    for _ in range(rounds):
        own = _nearest(x, centroids, 1)[:, 0]
        sums = np.stack([np.bincount(own, x[:, j], minlength=count) for j in range(x.shape[1])], 1)
        size = np.bincount(own, minlength=count)
        centroids = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centroids)
    return Index(rotation, centroids, max(min(count, 8), int(np.ceil(count * share))))


def _nearest(x: np.ndarray, centroids: np.ndarray, k: int) -> np.ndarray:
    d = (centroids**2).sum(1)[None, :] - 2 * x @ centroids.T
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def _least(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """A distance that no vector of a list (columns) can fall below for a row of ``x``, less a slack for rounding."""
    norms = (centroids**2).sum(1)
    d = norms[None, :] - 2 * x @ centroids.T
    own = d.argmin(1)
    gap = np.stack([np.sqrt(((centroids - c) ** 2).sum(1)) for c in centroids[own]])
    slack = 1e-9 * ((x**2).sum(1)[:, None] + norms.max())
    return np.maximum(0.0, (d - d[np.arange(len(x)), own][:, None] - slack) / np.where(gap > 0, 2 * gap, np.inf))


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _binary(m: np.ndarray) -> bytes:
    return np.ascontiguousarray(m).tobytes()


def _blocks(visits: np.ndarray, shares: dict[int, list[int]], ids: np.ndarray, x: np.ndarray, limit: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Queries (rows of ``visits``) for every share of each list (columns) they visit, in record batches of about ``BATCH`` bytes."""
    batch = lambda out: pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(PACKED)], ["list", "salt", "qids", "q", "limits"])
    out, held = [], 0
    for c in np.flatnonzero(visits.any(0)):
        rows = np.flatnonzero(visits[:, c])
        for a in range(0, len(rows), QUERIES):
            p = rows[a : a + QUERIES]
            for s in shares.get(int(c), []):
                out.append((int(c), s, _binary(ids[p]), _binary(x[p]), _binary(limit[p])))
                held += sum(map(len, out[-1][2:]))
                if held >= BATCH:
                    yield batch(out)
                    out, held = [], 0
    yield batch(out)


def search(vectors: DataFrame, is_query: Column, k: int = 10, vector: str = "embedding", key: str = "vec_id", index: Index | None = None) -> DataFrame:
    """(query_id, rank, key, score): the ``k`` nearest found of every query row, by Euclidean distance."""
    fine = valid(small_batches(vectors).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("is_query")), "v")
    index = index or fit(fine, "v", "id")
    handle = vectors.sparkSession.sparkContext.broadcast(index)
    exact = np.float32 if vectors.schema[vector].dataType.elementType.simpleString() == "float" else np.float64  # as given, without a loss

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = handle.value
        for batch in batches:
            if batch.num_rows:
                own = _nearest(_matrix(batch.column("v"), np.float64), ix.centroids, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), batch.column("id"), batch.column("v")], ["list", "id", "v"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packs of vectors that come list by list; a list's last ones in a batch wait for more of it."""
        ix, rest = handle.value, None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if rest is None or not rest.num_rows:
                continue
            own, ids = rest["list"].to_numpy(), rest["id"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            spans = [(a, min(a + PACK, hi)) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) for a in range(lo, hi, PACK)]
            if batch is not None and spans[-1][1] - spans[-1][0] < PACK:
                spans.pop()
            for a, z in spans:
                x = _matrix(rest["v"].slice(a, z - a).combine_chunks(), np.float64)
                out = (int(own[a]), int(ids[a]) % SALT, _binary(ids[a:z]), _binary(x.astype(exact)), _binary((x @ ix.rotation).astype(np.float32)))
                yield pa.RecordBatch.from_arrays([pa.array([o], t) for o, t in zip(out, PACKED, strict=True)], ["list", "salt", "ids", "x", "turned"])
            rest = rest.slice(spans[-1][1] if spans else 0).combine_chunks()

    def probing(further: bool):
        """Queries of the lists they visit: the nearest ones, or ``further`` those of the others that ``limit`` does not exclude."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix = handle.value
            for batch in (b.slice(a, 1024) for b in batches for a in range(0, b.num_rows, 1024)):
                x, ids, limit = _matrix(batch.column("v"), np.float64), batch.column("id").to_numpy(), batch.column("limit").to_numpy()
                visits = np.zeros((len(ids), len(ix.centroids)), bool)
                np.put_along_axis(visits, _nearest(x, ix.centroids, ix.probes), True, 1)
                if further:
                    visits = ~visits & (_least(x, ix.centroids) <= limit[:, None] * (1 + 1e-6))
                yield from _blocks(visits, shares, ids, x, limit)

        return run

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, best = handle.value, {}

        def found() -> pa.RecordBatch:
            rows = [(q, *pair) for q, pairs in best.items() for pair in pairs]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64())], ["query_id", "id", "score"])

        for batch in batches:
            for ids, x, turned, qids, q, limits in zip(*(batch.column(c).to_pylist() for c in ("ids", "x", "turned", "qids", "q", "limits")), strict=True):
                ids, qids, limits = np.frombuffer(ids, np.int64), np.frombuffer(qids, np.int64), np.frombuffer(limits)
                x, turned, q = np.frombuffer(x, exact).reshape(len(ids), -1), np.frombuffer(turned, np.float32).reshape(len(ids), -1), np.frombuffer(q).reshape(len(qids), -1)
                for i, qid in enumerate(qids.tolist()):
                    best[qid] = _scan(best.get(qid, []), qid, q[i], ids, x, turned, ix.rotation, k, limits[i])
                if len(best) > 100_000:
                    yield found()
                    best.clear()
        if best:
            yield found()

    # a list is cut only where a partition ends, so its packs are full whatever the number of lists
    rows = fine.select("id", "v").mapInArrow(listed, f"list int, id bigint, v {fine.schema['v'].dataType.simpleString()}")
    ordered = rows.repartitionByRange("list", "id").sortWithinPartitions("list", "id")
    lists = cut(ordered.mapInArrow(packed, "list int, salt int, ids binary, x binary, turned binary"), "lists")
    shares = {x["list"]: sorted(x["salts"]) for x in lists.groupBy("list").agg(F.collect_set("salt").alias("salts")).toLocalIterator()}  # a row a list
    queries = fine.where("is_query").select("id", "v")

    def visited(queries: DataFrame, further: bool) -> DataFrame:
        blocks = queries.mapInArrow(probing(further), "list int, salt int, qids binary, q binary, limits binary")
        return lists.join(blocks, ["list", "salt"]).mapInArrow(scanned, "query_id bigint, id bigint, score double")

    def ranked(pairs: DataFrame) -> DataFrame:
        once = pairs.groupBy("query_id", "id").agg(F.min("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))).where(F.col("rank") <= k)

    first = cut(ranked(visited(queries.withColumn("limit", F.lit(float("inf"))), False)), "nearest")
    limits = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("limit"))
    rest = visited(queries.join(limits, "id", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf")))), True)
    return ranked(first.drop("rank").unionByName(rest)).select("query_id", "rank", F.col("id").alias(key), "score")


def _scan(best: list, qid: int, q: np.ndarray, ids: np.ndarray, x: np.ndarray, turned: np.ndarray, rotation: np.ndarray, k: int, limit: float) -> list:
    """Merge the pack's nearest, as far as ``limit``, into ``best``, a sorted list of at most k (distance, id)."""
    dims, spun = len(q), (q @ rotation).astype(np.float32)
    alive = np.flatnonzero(ids != qid)
    for a in range(0, len(alive), 256):  # in pieces, so that later ones see a tighter bound
        part = alive[a : a + 256]
        bound = min(limit, best[-1][0] if len(best) == k else np.inf) ** 2
        if bound < np.inf:
            partial = np.zeros(len(part), np.float32)
            for d in range(0, dims, STEP):
                block = turned[part, d : d + STEP] - spun[d : d + STEP]
                partial = partial + (block * block).sum(1)
                done = min(d + STEP, dims)
                ratio = 1.0 if done == dims else done / dims * (1 + EPSILON / np.sqrt(done)) ** 2
                stay = partial <= bound * ratio * (1 + 1e-4) + 1e-12
                part, partial = part[stay], partial[stay]
                if not len(part):
                    break
        if not len(part):
            continue
        exact = np.sqrt(((x[part].astype(np.float64) - q) ** 2).sum(1))
        merged = {}
        for s, i in [*best, *zip(exact.tolist(), ids[part].tolist(), strict=True)]:
            merged[i] = min(s, merged.get(i, s))
        best = sorted((s, i) for i, s in merged.items())[:k]
    return best
