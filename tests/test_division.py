"""Keyword division against a plain version of its rounds."""

import random

import pytest

from pkgloom.operators import text


def popular(sets, q, ignored):
    """The best splitting keyword of a list of [keywords, weight]."""
    if len(sets) < 25:
        return None
    counts = {}

    def vote(k, w):
        pop, total = counts.get(k, (0, 0))
        counts[k] = (pop + 1, total + w)

    for ks, w in sets:
        for k in ks:
            vote(k, w)
            rest = k[len(q) + 1 :] if k.startswith(q + "-") else k[: -len(q) - 1] if k.endswith("-" + q) else None
            if w > 0 and rest is not None and rest not in ks:
                vote(rest, 2 * w)
    for k in ("api", "cli", "rust"):
        if k in counts:
            counts[k] = (counts[k][0], int(counts[k][1] * 3 / 4))
    good, most = len(sets) // 3, len(sets) * 3 // 4
    fit = [(-(w * 2 if 10 <= pop <= good else w), k) for k, (pop, w) in counts.items() if 2 < pop <= most and k not in ignored]
    return min(fit)[1] if fit else None


def divide(results, q, own, limit, skipped):
    seen, sets = set(), []
    for pos, (ks, score) in enumerate(results, 1):
        if tuple(sorted(ks)) in seen:
            continue
        seen.add(tuple(sorted(ks)))
        rest = set(ks) - set(own)
        if not rest & set(skipped):
            sets.append([rest, (2048 if pos <= limit else 1024) + int(128 * score)])
    first = popular(sets, q, ("api", "cli"))
    word = first and popular(sets, q, (first,))
    out = []
    while word and word not in out and len(out) < 10:
        out.append(word)
        for s in sets:
            if word in s[0]:
                s[0].remove(word)
                if s[1] > 0:
                    s[1] = -(s[1] // 2)
        if sum(w > 0 for _, w in sets) < 25:
            break
        word = popular(sets, q, ("reserved", word))
    return out


@pytest.fixture(scope="module")
def world():
    rng = random.Random(3)
    vocabulary = ["api", "cli", "rust", "http", "http-client", "server-http", "client", "server", "reserved", "async", "json", "spam", *[f"k{i}" for i in range(25)]]
    queries = {i: ("http", ["http"]) for i in range(12)} | {12: ("async json", ["async", "json"]), 13: ("none", [])}
    results = {i: [(rng.sample(vocabulary[: 12 + i * 2], rng.randrange(0, 6)), round(rng.random(), 3)) for _ in range([140, 60, 24, 200][i % 4])] for i in queries if i != 13}
    return queries, results


def test_rounds(spark, world):
    queries, results = world
    flat = [(q, q * 1000 + n, n, s, ks) for q, found in results.items() for n, (ks, s) in enumerate(found, 1)]
    r = spark.createDataFrame([x[:4] for x in flat], "query_id int, doc_id int, pos int, score double")
    k = spark.createDataFrame([(d, w) for _, d, _, _, ks in flat for w in ks], "doc_id int, keyword string")
    qs = spark.createDataFrame([(i, t, own) for i, (t, own) in queries.items()], "query_id int, text string, query_keywords array<string>")
    got = {}
    for x in text.dividing_keywords(r, k, qs, 50, ("spam",)).orderBy("query_id", "pos").collect():
        got.setdefault(x.query_id, []).append(x.keyword)
        assert x.pos == len(got[x.query_id])
    want = {q: found for q, (t, own) in queries.items() if (found := divide(results.get(q, []), t.replace(" ", "-"), own, 50, ("spam",)))}
    assert got == want and max(map(len, want.values())) >= 5 and 2 not in want
    assert text.dividing_keywords(r.limit(0), k, qs, 50).count() == 0


def test_suggestions(spark):
    d = spark.createDataFrame([(1, f"k{i}", i) for i in range(1, 6)] + [(2, "a", 1), (2, "b", 2)] + [(3, w, i) for i, w in enumerate(["x-web", "web-y", "z", "v", "u", "w"], 1)] + [(4, f"m{i}", i) for i in range(1, 7)], "query_id int, keyword string, pos int")
    q = spark.createDataFrame([(1, " http "), (2, "http"), (3, "web"), (4, "two words")], "query_id int, text string")
    assert sorted((x.query_id, x.search) for x in text.search_also(d, q).collect() if x.pos == 1) == [(1, "http k1"), (3, "web x-web"), (4, "two words m1")]
    assert sorted((x.query_id, x.place, x.search) for x in text.did_you_mean(d, q).collect()) == [(1, 1, "http k1"), (1, 2, "http k2"), (1, 3, "http k3"), (3, 1, "web z"), (3, 2, "web v"), (3, 3, "web u")]


def test_promotion_keeps_scores_monotone(spark):
    r = spark.createDataFrame([(1, 10 + i, i, 1.0 - i / 10) for i in range(1, 8)] + [(2, 50, 1, 0.5), (2, 51, 2, 0.4)], "query_id int, doc_id int, pos int, score double")
    k = spark.createDataFrame([(16, "x"), (17, "x"), (15, "late"), (51, "x")], "doc_id int, keyword string")
    d = spark.createDataFrame([(1, "x", 1), (1, "late", 7), (2, "x", 1)], "query_id int, keyword string, pos int")
    got = [(x.query_id, x.doc_id, x.front, round(x.score, 3)) for x in text.promote_representatives(r, d, k).orderBy("query_id", "new_pos").collect()]
    assert got == [(1, 11, True, 0.9), (1, 12, True, 0.8), (1, 13, True, 0.7), (1, 16, True, 0.6), (1, 14, False, 0.6), (1, 15, False, 0.5), (1, 17, False, 0.3), (2, 51, True, 0.5), (2, 50, False, 0.5)]


@pytest.fixture
def written(monkeypatch):
    """The physical plans and columns of all frames that an operator of ``text`` settles."""
    out, settled = [], text.settled
    monkeypatch.setattr(text, "settled", lambda df: out.append((df.columns, df._jdf.queryExecution().executedPlan().toString())) or settled(df))
    return out


def test_results_are_hashed_by_the_number_of_their_set(spark, written):
    """No aggregate sorts the results, and no result is paired with its keywords; documents without keywords share one set."""
    n = 400
    r = spark.createDataFrame([(1, i, i + 1, 1.0 / (i + 1)) for i in range(n)], "query_id int, doc_id int, pos int, score double")
    k = spark.createDataFrame([(i, f"k{i % 7}") for i in range(0, n, 2)] + [(i, f"m{i % 60}") for i in range(0, n, 2)] + [(1, None)], "doc_id int, keyword string")
    q = spark.createDataFrame([(1, "web", ["web"])], "query_id int, text string, query_keywords array<string>")
    got = text.dividing_keywords(r, k, q, 50).orderBy("pos").collect()
    sets = [({f"k{i % 7}", f"m{i % 60}"}, 1.0 / (i + 1)) if i % 2 == 0 else (set(), 1.0 / (i + 1)) for i in range(n)]
    assert [x.keyword for x in got] == divide(sets, "web", ["web"], 50, ()) and len(got) > 1
    plan = next(p for c, p in written if c == ["query_id", "q", "keywords", "weight"])
    assert "SortAggregate" not in plan and "Generate" not in plan


def test_only_places_of_related_results_are_sorted(spark, written):
    """Keywords come back to the best results alone."""
    docs = [(i, w) for i in range(200) for w in {"web", f"a{i % 3}", f"b{i % 5}", *(["out"] if i % 10 == 0 else [])}]
    k, ranks = spark.createDataFrame(docs, "doc_id int, keyword string"), spark.createDataFrame([(i, float(i % 50)) for i in range(200)], "doc_id int, rank double")
    asked = spark.createDataFrame([("web", ["out"], ["web"], ["b4"]), ("a1", [], ["a1"], [])], "find string, without array<string>, words array<string>, bad array<string>")
    got = {(x.find, x.pos): x.keyword for x in text.related_keywords(k, ranks, asked, rounds=0, n=30).collect()}
    of = {i: {w for d, w in docs if d == i} for i in range(200)}

    def plain(find, without, words, bad):
        hits = sorted((i for i in of if find in of[i] and not of[i] & without), key=lambda i: (-(i % 50), i))[:30]
        sets = {frozenset(of[i] - words) for i in hits if not of[i] & bad}
        counts = {w: sum(w in s for s in sets) for s in sets for w in s}
        return min((-n, w) for w, n in counts.items())[1]

    assert got == {("web", 0): plain("web", {"out"}, {"web"}, {"b4"}), ("a1", 0): plain("a1", set(), {"a1"}, set())}
    assert any(c == ["find", "doc_id"] for c, _ in written)
