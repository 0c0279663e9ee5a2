"""Exact top-k by integer inner product: best-first search of an M-tree.

Components become floor(scale * x). Every vector goes to its nearest top routing
object (real vectors, medoids of a bounded sample), and each top node's vectors
are dealt by a hash into subtrees of bounded bytes, so a hot top node becomes
many subtrees. A subtree is an M-tree bulk-loaded by one task: pages of entries
with a routing object (again a real vector), its distance to the parent's
routing object and its covering radius; leaf entries keep their distance to the
leaf's routing object.

For a ball of centre c and radius r the triangle inequality gives
<q, x> <= <q, c> + |q| r, so with d the stored distance of an entry to its
parent p, <q, p> + |q| (d + r) bounds the entry before <q, c> is computed: most
entries that cannot reach the k-th best found are left out unseen, and the
others wait in a queue by their bound. A query first searches the top nodes
that look best, then every other one whose bound reaches its k-th score.

Edge cases: vectors null, empty, with null or non-finite components and rows
without a key take no part; vectors meet those of their own dimension only;
ties go to the smaller id; repeated rows count once, and an id with several
vectors has the best of their scores; with fewer than ``k`` candidates all are
returned. Scores beyond 64 bits wrap.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

PAGE, FANOUT = 128, 16  # leaf entries and children of a page
GROUP_BYTES = 2 << 20  # vectors of a subtree
QUERIES = 1024  # a block of queries
MOST_TOPS = 1024
EXACT = 2.0**53  # products of integers below it are exact in doubles


@dataclass
class Tops:
    """The root page: per dimension the first number and the routing objects of its top nodes."""

    objects: dict[int, tuple[int, np.ndarray]]

    def of(self, dim: int) -> tuple[int, np.ndarray]:
        """A dimension that the sample missed has one top node around the origin."""
        return self.objects.get(dim) or (-dim, np.zeros((1, dim)))


def quantized(vectors: DataFrame, is_query: Column, vector: str, key: str, scale: int) -> DataFrame:
    """(id, v array<bigint>, is_query) of the rows that take part, repeated ones once."""
    v = F.col(vector)
    fine = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.col(key).isNotNull()
    rows = vectors.where(fine).select(F.col(key).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("bigint")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    return rows.groupBy("id", "v").agg(F.max("q").alias("is_query"))


def medoids(x: np.ndarray, count: int, rounds: int = 6) -> np.ndarray:
    """``count`` rows of ``x`` at most, near the means of their surroundings."""
    rng = np.random.default_rng(11)
    chosen = x[rng.choice(len(x), min(count, len(x)), replace=False)]
    for _ in range(rounds if len(chosen) > 1 else 0):
        own = ((chosen**2).sum(1)[None, :] - 2 * x @ chosen.T).argmin(1)
        means = np.stack([x[own == i].mean(0) if (own == i).any() else c for i, c in enumerate(chosen)])
        chosen = x[((x**2).sum(1)[:, None] - 2 * x @ means.T).argmin(0)]
    return np.unique(chosen, axis=0)


def fit(rows: DataFrame, sample: int = 20_000) -> Tops:
    """Top routing objects of at most about ``sample`` rows, taken by a hash; their number grows with the table up to ``MOST_TOPS``."""
    n = rows.count()
    share = min(1.0, sample / max(1, n))
    table = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * share) + 1).orderBy("id", "v").limit(2 * sample).select("v").toArrow()
    by_dim: dict[int, list] = {}
    for row in table["v"].to_pylist():
        by_dim.setdefault(len(row), []).append(row)
    objects, first = {}, 0
    for dim, part in sorted(by_dim.items(), key=lambda p: (-len(p[1]), p[0])):
        if first >= MOST_TOPS:
            break
        x = np.array(part, np.float64)
        per = max(1, GROUP_BYTES // (8 * dim))
        found = medoids(x, int(np.clip(n * len(x) / max(1, table.num_rows) / (2 * per), 1, MOST_TOPS - first)))
        objects[dim] = (first, found)
        first += len(found)
    return Tops(objects)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - c) ** 2).sum(1))


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = np.diff(batch.column("v").offsets.to_numpy())
    for dim in np.unique(sizes).tolist():
        yield dim, batch.filter(pa.array(sizes == dim))


# --- the tree of one group ---------------------------------------------------


def bisected(x: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``at`` in two halves by nearness to two far-apart members; equal vectors by id."""
    p = x[at[_distances(x[at], x[at[0]]).argmax()]]
    to_p = _distances(x[at], p)
    to_o = _distances(x[at], x[at[to_p.argmax()]])
    order = at[np.lexsort((ids[at], to_p - to_o))]
    return order[: len(order) // 2], order[len(order) // 2 :]


def bulk_load(x: np.ndarray, ids: np.ndarray, page: int = PAGE, fanout: int = FANOUT) -> dict[str, np.ndarray]:
    """The M-tree over rows of ``x``: nodes breadth-first (a page's entries stand together), objects in the order of their leaves."""
    nodes: list[dict] = [{"at": np.arange(len(x)), "parent": 0}]
    objects: list[np.ndarray] = []
    placed = 0
    for number, node in enumerate(nodes):  # grows meanwhile
        at = node["at"]
        mean = x[at].mean(0)
        node["center"] = x[at[((x[at] - mean) ** 2).sum(1).argmin()]]
        own = _distances(x[at], node["center"])
        node["radius"], node["least"] = own.max(), ids[at].min()
        node["up"] = np.sqrt(((node["center"] - nodes[node["parent"]]["center"]) ** 2).sum())
        node["leaf"] = len(at) <= page
        if node["leaf"]:
            objects.append(at)
            node["begin"], placed = placed, placed + len(at)
            node["end"], node["own"] = placed, own
        else:
            parts = [at]
            while len(parts) < fanout and max(map(len, parts)) > page:
                parts = [half for part in parts for half in (bisected(x, ids, part) if len(part) > page else (part,))]
            node["begin"], node["end"] = len(nodes), len(nodes) + len(parts)
            nodes.extend({"at": part, "parent": number} for part in parts)
    order = np.concatenate(objects)
    column = lambda name, kind: np.array([n[name] for n in nodes], kind)
    return {
        "ids": ids[order], "x": x[order].astype(np.int64), "own": np.concatenate([n["own"] for n in nodes if n["leaf"]]), "centers": column("center", np.int64), "up": column("up", np.float64), "radius": column("radius", np.float64),
        "least": column("least", np.int64), "begin": column("begin", np.int32), "end": column("end", np.int32), "leaf": column("leaf", np.bool_),
    }


FIELDS = {"ids": np.int64, "x": np.int64, "own": np.float64, "centers": np.int64, "up": np.float64, "radius": np.float64, "least": np.int64, "begin": np.int32, "end": np.int32, "leaf": np.bool_}


def unpacked(row: dict[str, bytes], dim: int) -> dict[str, np.ndarray]:
    tree = {name: np.frombuffer(row[name], kind) for name, kind in FIELDS.items()}
    for name in ("x", "centers"):
        tree[name] = tree[name].reshape(-1, dim)
    return tree | {"x_f": tree["x"].astype(np.float64), "centers_f": tree["centers"].astype(np.float64), "most": np.sqrt((tree["x"].astype(np.float64) ** 2).sum(1).max())}


def best_first(tree: dict[str, np.ndarray], q: np.ndarray, qid: int, best: list, k: int, limit: float, seen: list[int] | None = None) -> list:
    """Merge the subtree's best, scores of at least ``limit``, into ``best``: at most k (-score, id), sorted. ``seen`` counts vectors computed."""
    qf = q.astype(np.float64)
    norm = np.sqrt(qf @ qf)
    safe = norm * tree["most"] < EXACT
    slack = 0.0 if safe else 1e-9 * norm * tree["most"]
    reach = norm * (1 + 1e-9)  # distances are rounded
    worst = (-best[-1][0], best[-1][1]) if len(best) == k else (-np.inf, 0)
    floor, last = worst if worst[0] >= limit else (limit, np.inf)
    dot = float(tree["centers_f"][0] @ qf)
    queue = [(-(dot + reach * tree["radius"][0] + slack), 0, dot)]
    while queue:
        bound, node, dot = heapq.heappop(queue)
        bound = -bound
        if bound < floor:
            break
        if bound == floor and tree["least"][node] >= last:
            continue
        a, b = int(tree["begin"][node]), int(tree["end"][node])
        if tree["leaf"][node]:
            upper = dot + reach * tree["own"][a:b] + slack
            at = a + np.flatnonzero((upper > floor) | ((upper == floor) & (tree["ids"][a:b] < last)))
            scores = tree["x_f"][at] @ qf if safe else tree["x"][at] @ q
            if seen is not None:
                seen[0] += len(at)
            fit = (scores >= floor) & (tree["ids"][at] != qid)
            if fit.any():
                best = merged(best, scores[fit], tree["ids"][at][fit], k)
                if len(best) == k and -best[-1][0] >= floor:
                    floor, last = -best[-1][0], best[-1][1]
        else:
            before = dot + reach * (tree["up"][a:b] + tree["radius"][a:b]) + slack
            at = a + np.flatnonzero(before >= floor)
            dots = tree["centers_f"][at] @ qf
            bounds = dots + reach * tree["radius"][at] + slack
            for i in np.flatnonzero(bounds >= floor).tolist():
                heapq.heappush(queue, (-float(bounds[i]), int(at[i]), float(dots[i])))
    return best


def merged(best: list, scores: np.ndarray, ids: np.ndarray, k: int) -> list:
    """The k best of ``best`` and the new scores, an id once."""
    order = np.lexsort((ids, -scores))
    got: dict[int, int] = {}
    for i in order.tolist():
        got.setdefault(int(ids[i]), int(scores[i]))
        if len(got) == k:
            break
    for negative, i in best:
        got[i] = max(-negative, got.get(i, -negative))
    return sorted((-s, i) for i, s in got.items())[:k]


# --- the search in Spark -----------------------------------------------------


def search(vectors: DataFrame, is_query: Column, k: int = 5, vector: str = "embedding", key: str = "vec_id", scale: int = 256, probe: float = 0.05) -> DataFrame:
    """(query_id, rank, ``key``, score): the ``k`` highest integer inner products of every query row with all other rows."""
    spark = vectors.sparkSession
    rows = cut(quantized(vectors, is_query, vector, key, scale), "integers")
    tops = spark.sparkContext.broadcast(fit(rows))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_dim(batch):
                first, objects = tops.value.of(dim)
                x = _matrix(part.column("v"), dim).astype(np.float64)
                own = ((objects**2).sum(1)[None, :] - 2 * x @ objects.T).argmin(1)
                far = _distances(x, objects[own])
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), part.column("hash"), pa.array(first + own, pa.int32()), pa.array(far)], ["id", "v", "hash", "top", "far"])

    assigned = rows.select("id", "v", F.xxhash64("id", "v").alias("hash")).mapInArrow(dealt, "id bigint, v array<bigint>, hash bigint, top int, far double")
    # one row a top node: at most MOST_TOPS and one for each dimension that the sample missed
    sizes = assigned.groupBy("top").agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.first(F.size("v")).alias("dim")).withColumn("salts", F.ceil(F.col("n") * F.col("dim") * 8 / GROUP_BYTES).cast("int")).orderBy("top").toArrow().to_pydict()
    count = dict(zip(sizes["top"], sizes["salts"], strict=True))
    radius = dict(zip(sizes["top"], sizes["radius"], strict=True))

    def built(key: tuple, table: pa.Table) -> pa.Table:
        column = table.column("v").combine_chunks()
        dim = len(column[0])
        x = _matrix(column, dim).astype(np.float64)
        tree = bulk_load(x, table.column("id").to_numpy())
        return pa.table({"top": pa.array([key[0].as_py()], pa.int32()), "salt": pa.array([key[1].as_py()], pa.int32()), "dim": pa.array([dim], pa.int32()), **{name: pa.array([tree[name].astype(kind).tobytes()], pa.binary()) for name, kind in FIELDS.items()}})

    def salted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in dealt(batches):
            salts = np.array([count[t] for t in part.column("top").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), part.column("top"), pa.array(part.column("hash").to_numpy() % salts, pa.int32())], ["id", "v", "top", "salt"])

    members = rows.select("id", "v", F.xxhash64("id", "v").alias("hash")).mapInArrow(salted, "id bigint, v array<bigint>, top int, salt int")
    trees = cut(members.groupBy("top", "salt").applyInArrow(built, "top int, salt int, dim int, " + ", ".join(f"`{n}` binary" for n in FIELDS)), "mtree")

    def asking(further: bool):
        """Blocks of queries for the subtrees they visit: of the most promising top nodes, or of all others that ``limit`` does not exclude."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(a, QUERIES) for b in batches for a in range(0, b.num_rows, QUERIES)):
                for dim, part in _by_dim(batch):
                    first, objects = tops.value.of(dim)
                    numbers = [t for t in range(first, first + len(objects)) if t in count]
                    x, ids, limit = _matrix(part.column("v"), dim), part.column("id").to_numpy(), part.column("limit").to_numpy()
                    c = objects[np.array(numbers) - first]
                    xf = x.astype(np.float64)
                    norm = np.sqrt((xf**2).sum(1))[:, None]
                    bound = xf @ c.T + norm * np.array([radius[t] for t in numbers])[None, :]
                    slack = 1e-9 * (np.abs(bound) + norm * (np.sqrt((c**2).sum(1)) + np.array([radius[t] for t in numbers]))[None, :])
                    near = np.zeros(bound.shape, bool)
                    np.put_along_axis(near, np.argsort(-bound, axis=1, kind="stable")[:, : max(1, int(np.ceil(probe * len(numbers))))], True, 1)
                    visits = ~near & (bound + slack >= limit[:, None]) if further else near
                    out = []
                    for j in np.flatnonzero(visits.any(0)):
                        at = np.flatnonzero(visits[:, j])
                        block = (ids[at].tobytes(), x[at].tobytes(), limit[at].tobytes())
                        out += [(numbers[j], s, *block) for s in range(count[numbers[j]])]
                    yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["top", "salt", "qids", "q", "limits"])

        return run

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}

        def found() -> pa.RecordBatch:
            flat = [(q, i, -s) for q, pairs in best.items() for s, i in pairs]
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in flat], pa.int64()) for n in range(3)], ["query_id", "id", "score"])

        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                tree = unpacked(row, row["dim"])
                qids, limits = np.frombuffer(row["qids"], np.int64), np.frombuffer(row["limits"])
                for qid, q, limit in zip(qids.tolist(), np.frombuffer(row["q"], np.int64).reshape(len(qids), -1), limits.tolist(), strict=True):
                    best[qid] = best_first(tree, q, qid, best.get(qid, []), k, limit)
                if len(best) > 100_000:
                    yield found()
                    best.clear()
        if best:
            yield found()

    def visited(queries: DataFrame, further: bool) -> DataFrame:
        blocks = queries.mapInArrow(asking(further), "top int, salt int, qids binary, q binary, limits binary")
        return trees.join(blocks, ["top", "salt"]).mapInArrow(searched, "query_id bigint, id bigint, score bigint")

    def ranked(pairs: DataFrame) -> DataFrame:
        once = pairs.groupBy("query_id", "id").agg(F.max("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)

    queries = rows.where("is_query").select("id", "v")
    none = F.lit(float("-inf"))
    first = cut(ranked(visited(queries.withColumn("limit", none), False)), "best")
    limits = first.where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("limit"))
    rest = visited(queries.join(limits, F.col("id") == F.col("query_id"), "left").select("id", "v", F.coalesce("limit", none).alias("limit")), True)
    return ranked(first.drop("rank").unionByName(rest)).select("query_id", "rank", F.col("id").alias(key), "score")
