"""Weights, noise and ranks against plain sums and a plain sort."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pkgloom.llm import queries, resampling

HARD = [None, "", "   ", "a", "A b C", "É é naïve Ünï ÉA", "x" * 70_000 + " y " + "z" * 300, "one,two;three", "日本 語 " * 30, "\x7f\x00a\x80b 9", "w " * 19, "w " * 20, "the same words again " * 20_000]


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target, percent=5):
    """docs: (id, text)."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(bucket(f) for _, x in docs for f in features(x)[1]), Counter(bucket(f) for x in target for f in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in range(10_000)]
    out = []
    for i, x in docs:
        n, f = features(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(g)] for g in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for place, row in enumerate(fit[: percent * len(fit) // 100], 1):
        row[4] = place
    return out


def rows(found):
    return sorted(map(list, found), key=str)


def test_query_equals_plain_sums(spark, data):
    docs, target = pd.read_parquet(f"{data}/documents.parquet"), pd.read_parquet(f"{data}/benchmark.parquet")
    want = brute(list(zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True)), target.text.tolist())
    got = queries.QUERIES["op11_resampling"](spark, data)
    assert got.columns[:5] == ["doc_id", "n_features", "weight", "score", "rank"]
    assert rows(got.collect()) == rows(want) and sum(r[4] is not None for r in want) > 5


def test_hard_texts_ties_and_clashing_columns(spark):
    docs = [(i, t) for i, t in enumerate(HARD)] + [(None, "no id but words " * 9), (5, "a repeated row " * 8), (5, "a repeated row " * 8)]
    df = spark.createDataFrame(docs, "doc_id int, text string").selectExpr("*", "1 AS weight", "2 AS score", "3 AS _at", "4 AS bucket").repartition(3)
    target = spark.createDataFrame([("one two three",), (None,)], "text string")
    got = resampling.resample(df, target, percent=60).collect()
    assert rows(got) == rows(brute(docs, ["one two three", None], 60))
    assert resampling.resample(df.limit(0), target).count() == 0
    assert rows(resampling.resample(df, target.limit(0)).collect()) == rows(brute(docs, []))


@pytest.mark.parametrize("kind", ["even", "one value", "sorted", "few runs"])
def test_ranks_of_many_segments(spark, kind, monkeypatch):
    monkeypatch.setattr(resampling, "LEAST_ROWS", 16)
    rng, n = np.random.default_rng(2), 4000
    score = {"even": rng.integers(-500, 500, n), "one value": np.full(n, 7), "sorted": np.arange(n), "few runs": np.where(rng.random(n) < 0.3, 1, rng.integers(0, 9, n))}[kind]
    ids, fit = rng.permutation(n), rng.random(n) < 0.9
    df = spark.createDataFrame(pd.DataFrame({"id": ids, "s": score, "fit": fit})).repartition(1 if kind == "few runs" else 7)
    got = {r["id"]: r["rank"] for r in resampling.ranked(df, "s", "id", F.col("fit"), percent=30).collect()}
    order = [int(ids[i]) for i in np.lexsort((ids, -score)) if fit[i]]
    assert len(got) == n and {i: r for i, r in got.items() if r} == {i: p for p, i in enumerate(order[: len(order) * 30 // 100], 1)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abcXYZ ,.\n\té日9")), max_size=60), max_size=5))
def test_checksums_of_runs(texts):
    from pkgloom.llm.common import CLEAN, text_bytes
    import pyarrow as pa

    buf, offs = text_bytes(pa.array(texts, pa.string()))
    got = Counter((int(o), int(b)) for owner, found in resampling.buckets(CLEAN[buf], offs) for o, b in zip(owner, found, strict=True))
    assert got == Counter((i, zlib.crc32(f.encode()) % 10_000) for i, t in enumerate(texts) for f in features(t)[1])
