import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pkgloom.llm import nearest


def brute(x, ids, queries, k=10):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids.tolist().index(q)]) ** 2).sum(1))
        out[q] = [int(i) for _, i in sorted((s, i) for s, i in zip(d, ids, strict=True) if i != q)[:k]]
    return out


def test_recall_and_exact_scores(spark, data):
    e = pd.read_parquet(f"{data}/embeddings.parquet")
    x, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    rows = spark.read.parquet(f"{data}/embeddings.parquet")
    got = nearest.search(rows, F.col("vec_id") % 10 == 0).toPandas()
    want = brute(x, ids, [i for i in ids if i % 10 == 0])
    hits = sum(len(set(g.vec_id) & set(want[q])) for q, g in got.groupby("query_id"))
    assert hits / sum(map(len, want.values())) >= 0.9
    at = {i: n for n, i in enumerate(ids)}
    for r in got.itertuples():
        assert abs(r.score - np.sqrt(((x[at[r.query_id]] - x[at[r.vec_id]]) ** 2).sum())) < 1e-12
    for _, g in got.sort_values("rank").groupby("query_id"):
        assert g["rank"].tolist() == list(range(1, 11)) and list(zip(g.score, g.vec_id, strict=True)) == sorted(zip(g.score, g.vec_id, strict=True))


def test_unfit_vectors_ties_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, [1.0, 2.0, 3.0]), (100, [0.0, 1.0]), (200, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    got = nearest.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 100), (100, 1, 1), (100, 2, 2), (100, 3, 0)]
    assert nearest.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_recall_where_most_lists_are_not_probed(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 24)) * 30
    for x in (rng.standard_normal((3000, 64)), centres[rng.integers(0, 20, 3000)] + rng.standard_normal((3000, 24))):
        x, ids = x.astype(np.float32).astype(float), np.arange(3000)
        rows = spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": x.tolist()})).selectExpr("vec_id", "CAST(embedding AS array<float>) AS embedding")
        index = nearest.fit(nearest.valid(rows, "embedding"), "embedding", "vec_id", lists=40)
        assert index.probes == 10
        got = nearest.search(rows, F.col("vec_id") % 50 == 0, index=index).toPandas()
        want = brute(x, ids, range(0, 3000, 50))
        assert sum(len(set(g.vec_id) & set(want[q])) for q, g in got.groupby("query_id")) >= 0.97 * 600


def test_no_vector_of_a_list_is_nearer_than_its_bound():
    rng = np.random.default_rng(5)
    x, centroids = rng.standard_normal((2000, 3)) * 5, rng.standard_normal((30, 3)) * 5
    own, least = nearest._nearest(x, centroids, 1)[:, 0], nearest._least(x[:50], centroids)
    d = np.sqrt(((x[:50, None] - x[None]) ** 2).sum(2))
    assert (d >= least[:, own]).all() and (least > 5).mean() > 0.2


def test_double_vectors_keep_their_precision(spark):
    rows = [(i, [1.0 + i * 1e-9, 2.0]) for i in range(30)]
    got = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=3).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(1, 1), (2, 2), (3, 3)]
    assert [r.score for r in sorted(got, key=lambda r: r.rank)] == [abs(rows[i][1][0] - 1.0) for i in (1, 2, 3)]


def test_blocks_of_queries_leave_one_by_one():
    """1024 queries of every share of 200 lists: 1.7 GB in batches of a few MB, and only shares that hold vectors."""
    x, ids, limit = np.ones((1024, 64)), np.arange(1024), np.ones(1024)
    shares = {c: [c % 16] for c in range(199)} | {199: list(range(16))}
    seen, most = {}, 0
    for b in nearest._blocks(np.ones((1024, 200), bool), shares, ids, x, limit):
        most = max(most, b.nbytes)
        for c, s, q in zip(*(b.column(n).to_pylist() for n in ("list", "salt", "qids")), strict=True):
            seen.setdefault((c, s), []).extend(np.frombuffer(q, np.int64).tolist())
    assert most < 2 * nearest.BATCH and seen == {(c, s): ids.tolist() for c, held in shares.items() for s in held}


def test_packs_are_full_whatever_the_number_of_lists(spark, monkeypatch):
    """Packs as the batches of the input cut them held a vector or two of a list."""
    written, real = {}, nearest.cut
    monkeypatch.setattr(nearest, "cut", lambda df, name: written.setdefault(name, real(df, name)))
    monkeypatch.setattr(nearest, "PACK", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        x, ids = np.random.default_rng(4).standard_normal((3000, 8)).astype(np.float32).astype(float), np.arange(3000)
        rows = spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": x.tolist()})).selectExpr("vec_id", "CAST(embedding AS array<float>) AS embedding")
        index = nearest.fit(nearest.valid(rows, "embedding"), "embedding", "vec_id", lists=20)
        got = nearest.search(rows, F.col("vec_id") % 100 == 0, index=index).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute(x, ids, range(0, 3000, 100))
    assert sum(len(set(g.vec_id) & set(want[q])) for q, g in got.groupby("query_id")) >= 0.97 * 300
    packs = [np.frombuffer(r.ids, np.int64) for r in written["lists"].collect()]
    assert sorted(np.concatenate(packs)) == ids.tolist() and max(map(len, packs)) <= 64 and len(packs) <= 3000 / 64 + 20 + 4
