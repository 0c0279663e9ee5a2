"""The M-tree against all products."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pkgloom.llm import exact_search, queries


def brute(rows, is_query, k=5):
    """rows: (id, vector) that take part; vectors meet those of their dimension."""
    out = {}
    for q, v in rows:
        if is_query(q):
            got = out.setdefault(q, {})
            for i, w in rows:
                if i != q and len(w) == len(v):
                    s = int(np.floor(256 * np.array(v, float)).astype(int) @ np.floor(256 * np.array(w, float)).astype(int))
                    got[i] = max(s, got.get(i, s))
    return {q: sorted(((-s, i) for i, s in got.items()))[:k] for q, got in out.items()}


def found(df, key="vec_id"):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((-r.score, r[key]))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_query_equals_all_products(spark, data):
    e = pd.read_parquet(f"{data}/embeddings.parquet")
    want = brute([(int(i), v) for i, v in zip(e.vec_id, e.embedding, strict=True) if v is not None], lambda i: i % 50 == 0)
    assert found(queries.QUERIES["op13_exact_search"](spark, data)) == want


def test_unfit_vectors_ties_repeats_and_dimensions(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 5.0]), (2, [1.0, 5.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, [1.0, 2.0, 3.0]), (9, []), (None, [9.0, 9.0]), (50, [-0.001, 1.0]), (50, [2.0, 1.0]), (100, [1.0, 2.0, 3.0]), (150, [7.0]), (11, [1.0, 0.5]), (12, [1.0, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash")).withColumn("score", F.lit(1)).withColumn("id", F.lit(2))
    clean = [(i, v) for i, v in dict.fromkeys((i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v))]
    want = {q: w for q, w in brute(clean, lambda i: i % 50 == 0).items() if w}
    assert found(exact_search.search(df, F.col("vec_id") % 50 == 0)) == want
    assert want[0][0] == (-(512 * 256), 50) and [i for _, i in want[0][1:]] == [1, 2, 11, 12]
    assert exact_search.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("kind", ["clusters", "copies", "large"])
def test_many_subtrees(spark, kind, monkeypatch):
    rng = np.random.default_rng(4)
    n, d = 3000, 12
    x = rng.standard_normal((40, d))[rng.integers(0, 40, n)] * 3 + rng.standard_normal((n, d)) * 0.05
    if kind == "copies":
        x[::3] = x[0]  # a third of all rows
    if kind == "large":
        x *= 2.0**20
    monkeypatch.setattr(exact_search, "GROUP_BYTES", 16 << 10)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": x.tolist()}))
    want = brute_fast(x)
    assert found(exact_search.search(df, F.col("vec_id") % 50 == 0)) == want


def brute_fast(x, k=5):
    codes = np.floor(256 * x).astype(np.int64)
    out = {}
    for q in range(0, len(x), 50):
        scores = codes @ codes[q]
        order = [i for i in np.lexsort((np.arange(len(x)), -scores)).tolist() if i != q][:k]
        out[q] = [(-int(scores[i]), i) for i in order]
    return out


def test_bounds_spare_most_products():
    rng = np.random.default_rng(4)
    x = np.floor(rng.standard_normal((40, 8))[rng.integers(0, 40, 4000)] * 900 + rng.standard_normal((4000, 8)) * 9)
    ids = np.arange(4000)
    row = {name: value.tobytes() for name, value in exact_search.bulk_load(x, ids).items()}
    tree, seen = exact_search.unpacked(row, 8), [0]
    for q in range(0, 4000, 40):
        best = exact_search.best_first(tree, x[q].astype(np.int64), q, [], 5, -np.inf, seen)
        scores = x @ x[q]
        assert best == [(-int(scores[i]), i) for i in np.lexsort((ids, -scores)).tolist() if i != q][:5]
    assert seen[0] < 0.25 * 100 * 4000


def test_pages_cover_their_vectors():
    rng = np.random.default_rng(1)
    x = np.floor(rng.standard_normal((1000, 5)) * 100)
    x[:400] = 7  # equal vectors are dealt by id
    tree = exact_search.bulk_load(x, np.arange(1000)[::-1].copy(), page=16, fanout=4)
    assert sorted(tree["ids"].tolist()) == list(range(1000))
    below = {}
    for node in range(len(tree["leaf"]) - 1, -1, -1):
        a, b = tree["begin"][node], tree["end"][node]
        below[node] = list(range(a, b)) if tree["leaf"][node] else [o for child in range(a, b) for o in below[child]]
        far = np.sqrt(((tree["x"][below[node]] - tree["centers"][node]) ** 2).sum(1))
        assert far.max() <= tree["radius"][node] and tree["ids"][below[node]].min() == tree["least"][node]
        if tree["leaf"][node]:
            assert b - a <= 16 and np.allclose(far, tree["own"][a:b])
    assert sorted(below[0]) == list(range(1000))
