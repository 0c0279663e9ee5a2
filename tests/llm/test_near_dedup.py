"""Near-duplicate groups against a plain search over all pairs."""

import random
import re

import pytest

from pkgloom.llm import near_dedup


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.setdefault(i, {tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))} if w else set())
    ids, parent = sorted(sets), {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def family(rng, size, words, edits):
    base = [f"w{rng.randrange(4000)}" for _ in range(words)]
    out = []
    for _ in range(size):
        t = list(base)
        for _ in range(rng.randrange(edits + 1)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_groups(spark, k, percent):
    rng = random.Random(k)
    texts = [None, "", " \n", "a", "A", "a b", "a  b", "a b c", "A b\tc d", "b a"] + ["same text again and again"] * 40
    texts += family(rng, 60, 80, 6) + family(rng, 40, 120, 14) + [t for _ in range(30) for t in family(rng, 3, 60, 4)] + ["é ü " * 50, "É Ü " * 50]
    rng.shuffle(texts)
    rows = list(enumerate(texts, 1))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id").repartition(5)
    want = brute(rows, k, percent)
    got = {r.doc_id: r for r in near_dedup.link(df, k=k, percent=percent, small=4).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    kept = {r.doc_id for r in near_dedup.remove(df, k=k, percent=percent).collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_repeated_rows_null_keys_and_empty_tables(spark):
    rows = [(1, "one two three four"), (1, "one two three four"), (2, "one two three four"), (None, "alone in the world"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dedup.link(df).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    assert near_dedup.link(df.limit(0)).count() == 0


def test_components_of_few_links(spark):
    rng = random.Random(1)
    chain = rng.sample(range(100), 5)
    graphs = [[(3, 1), (3, 2)], [(1, 3), (2, 3), (4, 2)], list(zip(chain, chain[1:])), [(9, 8), (7, 8), (5, 4), (6, 5), (6, 3)], [(1, 1), (2, 1), (1, 2)]]
    for links in graphs:
        want = {}
        for a, b in links:
            group = {a, b}.union(*(g for g in want.values() if {a, b} & g))
            want.update(dict.fromkeys(group, group))
        got = near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()
        assert sorted((r.c, r.comp) for r in got) == sorted((c, min(g)) for c, g in want.items()), links
