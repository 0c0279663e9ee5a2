"""Large groups of equal rows: the work must not grow with their pairs, and the results stay those of plain versions."""

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from pkgloom.operators import aggregates, clean, compat, graph, joins, people, text, timeseries, windows
from pkgloom.plans import QUERIES, views


def plain_related(keywords, packages, least, n):
    liked = {p for p, d in packages if d > 500}
    out = set()
    for p in {p for p, _, _ in keywords}:
        score = {}
        for a, k, w in keywords:
            for b, k2, w2 in keywords:
                if a == p and k == k2 and b != p and b in liked:
                    score[b] = score.get(b, 0) + w * w2
        best = sorted((-round(s, 6), b) for b, s in score.items() if round(s, 6) > least)[:n]
        out |= {(p, b, -s, i) for i, (s, b) in enumerate(best, 1)}
    return out


def test_related_by_keyword(spark):
    rng = random.Random(5)
    keywords = [(p, f"k{rng.randrange(4)}", float(rng.choice([1, 2, 3]))) for p in range(60) for _ in range(rng.choice([1, 2, 2, 3]))]
    packages = [(p, rng.choice([100, 900])) for p in range(60)]
    k, p = spark.createDataFrame(keywords, "package long, keyword string, weight double"), spark.createDataFrame(packages, "package long, downloads int")
    for n in (2, 15):
        got = {(x.package, x.related, x.score, x.pos) for x in joins.related_by_keyword(k, p, 500, 2.0, n).collect()}
        assert got == plain_related(keywords, packages, 2.0, n)


def test_related_by_keyword_of_many_copies(spark):
    """10^5 packages with one keyword are 10^10 pairs."""
    p = spark.range(100_000).select(F.col("id").alias("package"), F.lit(900).alias("downloads"))
    k = p.select("package", F.lit("web").alias("keyword"), F.lit(1.0).alias("weight"))
    got = joins.related_by_keyword(k, p, 500, 0.5, 3)
    assert got.count() == 300_000
    assert [x.related for x in got.where("package = 1").orderBy("pos").collect()] == [0, 2, 3]


def test_closure_of_many_roots_walks_as_few_rows(spark):
    """2000 packages over one chain of 60: 120,000 pairs of root and node, but some 60 states for each block of 64 roots."""
    chain, n = 60, 2000
    e = spark.range(n).select((F.col("id") + 1000).alias("src"), F.lit(0).cast("long").alias("dst")).unionByName(spark.range(chain - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    e = e.select("src", "dst", F.lit(0).alias("kind"), F.lit(False).alias("optional"))
    starts = e.select(F.col("src").alias("root"), F.lit(1).alias("level"), F.col("dst").alias("release"), F.lit("").alias("feature"), "kind")
    links = e.select(F.col("src").alias("release"), F.lit("").alias("feature"), F.col("dst").alias("to_release"), F.lit("").alias("to_feature"), F.lit(0).alias("edge_kind"), F.lit(1).alias("least_level"))
    states = graph._walk(starts, links, graph._blocks(starts))
    assert states.count() < 5000
    assert graph.dependency_closure(e.where("src >= 1000 OR src > 40")).count() == 2000 + 18 * 19 // 2


def test_same_project_candidates(spark):
    """Groups far larger than the list, against all pairs."""
    rng = random.Random(7)
    packages = [(i, rng.choice(["a", "b", "c", None]), rng.choice(["x", "y"])) for i in range(120)]
    owners = [(i, rng.randrange(6)) for i in range(120) for _ in range(rng.randrange(3))]
    held = {p: {o for q, o in owners if q == p} for p in range(120)}
    want = set()
    for a, repo, prefix in packages:
        weights = {b: (1.0 if repo and repo == r else 0) + (0.5 if prefix == x and held[a] & held[b] else 0) for b, r, x in packages if b != a}
        best = sorted((-w, b) for b, w in weights.items() if w)[:20]
        want |= {(a, b, -w, i) for i, (w, b) in enumerate(best, 1)}
    p, o = spark.createDataFrame(packages, "package long, repo string, prefix string"), spark.createDataFrame(owners, "package long, owner long")
    assert {tuple(x) for x in people.same_project_candidates(p, o).collect()} == want
    many = spark.range(100_000).selectExpr("id AS package", "'r' AS repo", "'x' AS prefix")
    assert people.same_project_candidates(many, many.selectExpr("package", "7 AS owner")).count() == 2_000_000


def test_expressions_of_a_repository_are_computed_once(spark):
    u = clean.repo_urls(clean.parse_repo(F.col("url")), F.col("dir"))
    d = spark.createDataFrame([("https://GitHub.com/Owner/Repo.git", "a"), ("https://gitlab.com/g/s/r/-/tree/main", None), ("https://example.org/a/b", None), (None, None)], "url string, dir string").select(u.alias("u")).select("u.*")
    assert d._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [x.git for x in d.collect()] == ["https://github.com/owner/repo.git", "https://gitlab.com/g/s/r.git", None, None]


def test_fill_over_several_batches(spark):
    m = [(p, r, c, "X" if (p * 7 + r * 3 + c) % 5 == 0 else "Y") for p in range(40) for r in range(3) for c in (10, 20)]
    df = spark.createDataFrame(m, "package int, release int, compiler int, verdict string")
    whole = {tuple(x) for x in compat.fill(df).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {tuple(x) for x in compat.fill(df).collect()} == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(whole) >= len(m) and compat.fill(df.limit(0)).count() == 0


def test_active_dependers_tell_owners_apart_only_in_crowded_buckets(spark):
    """Against the walk of each owner's balance: dependencies with many owners and with one owner of many dependers."""
    rng = random.Random(11)
    owners = {(p, o) for p in range(40) for o in ([7] if p % 4 == 0 else rng.sample(range(200), rng.randrange(0, 12)))}
    start = dt.date(2001, 1, 1)
    releases = [(p, p * 10 + i, dt.datetime(2001, 1, 1) + dt.timedelta(rng.randrange(300)), f"{i}.1.0") for p in range(40) for i in range(3)]
    uses = sorted({(p, r, rng.randrange(100, 104) if p % 3 else rng.randrange(12)) for p, r, _, _ in releases for _ in range(3)})
    r = spark.createDataFrame(releases, "package long, release long, created timestamp, version string")
    o = spark.createDataFrame(sorted(owners), "package long, owner long")
    u = spark.createDataFrame(uses, "package long, release long, dep long")
    as_of = dt.date(2001, 12, 1)
    got = {(x.dep, x.day): (x.added, x.removed, x.expired, x.users) for x in timeseries.active_dependers(r, u, o, F.lit(as_of)).collect()}
    of = {p: {x for q, x in owners if q == p} for p in range(110)}
    spans = {(x.package, x.release): x for x in windows.half_life_intervals(r, o.groupBy("package").agg(F.count("*").alias("n_owners"))).collect()}
    flows, deltas = {}, {}
    for p, dep in {(p, d) for p, _, d in uses if p != d}:
        held = [spans[p, q] for x, q, d in uses if (x, d) == (p, dep)]
        end, how = max((x.end, x.how) for x in held)
        for day, kind, sign in ((min(x.start for x in held), 0, 1), *([(end, 1 if how == "removed" else 2, -1)] if end <= as_of else [])):
            flows.setdefault((dep, day), [0, 0, 0])[kind] += 1
            for x in of[p] - of[dep]:
                deltas.setdefault(dep, []).append((day, x, sign / len(of[p])))
    want = {k: (*v, None) for k, v in flows.items()}
    for dep, changes in deltas.items():
        for day in {d for d, _, _ in changes}:
            balance = {}
            for d, x, delta in changes:
                balance[x] = balance.get(x, 0) + (delta if d <= day else 0)
            want[dep, day] = (*flows[dep, day], math.ceil(round(sum(min(round(b, 9), 1) for b in balance.values()), 6)))
    assert got == want and any(v[3] is None for v in got.values()) and start <= min(d for _, d in got)


def test_active_dependers_shuffle_no_row_for_each_owner(spark):
    """300 dependers with 300 owners each: 90,000 pairs of use and owner, of which no balance nears 1."""
    p = spark.range(300)
    o = p.select(F.col("id").alias("package"), F.explode(F.sequence(F.col("id") * 1000, F.col("id") * 1000 + 299)).alias("owner"))
    r = p.selectExpr("id AS package", "id AS release", "CAST('2001-01-01' AS timestamp) AS created", "'1.0.0' AS version")
    got = timeseries.active_dependers(r, p.selectExpr("id AS package", "id AS release", "1000 AS dep"), o, F.lit("2001-12-01").cast("date"))
    assert [tuple(x)[1:] for x in got.collect()] == [(dt.date(2001, 1, 1), 300, 0, 0, 300)]
    assert [x.dep for x in timeseries._crowded(p.selectExpr("id AS package", "id % 2 AS dep"), timeseries._groups(o)).collect()] == []


@pytest.mark.parametrize("name", ["a9_reload_ownership", "d23_author_keywords", "d25_top_result_keywords", "e2_running_active_users"])
def test_large_tables_are_dealt_to_more_tasks(spark, data, monkeypatch, name):
    """Tasks hold so many rows of a large table whatever its size, with the rows of the small one."""
    small = QUERIES[name](spark, data)
    assert "REPARTITION_BY_NUM" not in small._jdf.queryExecution().executedPlan().toString()
    want = sorted(map(tuple, small.collect()))
    monkeypatch.setattr(views, "ROWS", 500)
    large = QUERIES[name](spark, data)
    assert re.search(r"hashpartitioning\(l_partkey#\d+L?, 1[0-9]\), REPARTITION_BY_NUM", large._jdf.queryExecution().executedPlan().toString())
    assert sorted(map(tuple, large.collect())) == want


def test_importance_makes_its_edges_once(spark, monkeypatch):
    plans, settled = [], graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or settled(df))
    edges = [(1, 2), (1, 3), (2, 3), (2, 3), (4, 1)]
    e, start = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(i, float(i)) for i in range(1, 6)], "node long, score double")
    got = {x.node: x.score for x in graph.pagerank(e, start, rounds=3).collect()}
    out = {n: {b for a, b in edges if a == n} for n in range(1, 6)}
    share = {n: n / 15 for n in out}
    now = share
    for _ in range(3):
        pool = sum(0.85 * now[n] for n in out if not out[n])
        now = {n: 0.15 * now[n] + sum(0.85 * now[m] / len(out[m]) for m in out if n in out[m]) + pool * share[n] for n in out}
    assert got == pytest.approx(now)
    assert sum("Window" in p for p in plans) == 1


def test_popularity_searches_its_ranges_once(spark):
    """What is within, below and above a requirement comes from one written search."""
    r = spark.createDataFrame([(1, 7, "b", "d"), (2, 7, "a", "b")], "dep_id long, package long, low string, high string")
    v = spark.createDataFrame([(7, k, n, False, False) for k, n in (("a", 5), ("b", 3), ("c", 4), ("d", 9))], "package long, sort_key string, users long, is_pre boolean, yanked boolean")
    out = graph.version_popularity(r, v, spark.createDataFrame([], "package long"))
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    assert {x.dep_id: (round(x.popularity, 6), x.matches_latest) for x in out.collect()} == {1: (round((8 / 22 + 5 / 14) / 2, 6), False), 2: (round((6 / 22 + 6 / 15) / 2, 6), False)}


def plain_enabled(releases, features, deps, wanted):
    low = lambda x: None if x is None else x.lower()
    keep = []
    for release, dep, optional in deps:
        rows = [(low(f), e) for r, f, e in features if r == release and f is not None]
        reached, names = {low(f) for r, f in wanted if r == release and f is not None}, set()
        while True:
            more = {e.lower() for f, e in rows if f in reached and e is not None and "/" not in e and not e.startswith("dep:")} - reached
            if not more:
                break
            reached |= more
        names = {re.sub(r"^dep:|\?$", "", e.split("/", 1)[0]).lower() for f, e in rows if f in reached and e is not None} | (reached - {f for f, _ in rows})
        if release in releases and optional is not None and (not optional or low(dep) in names):
            keep.append((release, dep, optional))
    return sorted(keep, key=str)


def test_features_of_a_release_are_walked_in_its_row(spark, monkeypatch):
    """Random features with cycles, nulls and repeated rows, and a chain of 200: no round of the walk is a job of its own."""
    rng, rounds = random.Random(9), []
    monkeypatch.setattr(graph, "settled", lambda df: rounds.append(df) or df)
    feature = lambda: rng.choice(["a", "B", "b", "c", "d", None])
    enables = lambda: rng.choice(["a", "b", "C", "d", "dep:X", "dep:y", "x/std", "Y?/std", "dep:z/a", "z", "", None])
    release = lambda: rng.choice([None, *range(12)])
    features = [(release(), feature(), enables()) for _ in range(90)] + [(20, f"f{i}", f"F{i + 1}") for i in range(200)] + [(20, "f200", "f0"), (20, "f199", "dep:x")]
    deps = [(release(), rng.choice(["x", "Y", "z", "d", "", None]), rng.choice([True, True, True, False, None])) for _ in range(150)] + [(20, "x", True), (20, "y", True), (21, "y", False), (22, "y", True), (22, "y", True)]
    wanted = [(release(), feature()) for _ in range(20)] + [(20, "F0"), (22, "y")]
    releases = [None, *range(2, 12), 5, 20, 21, 22]
    got = graph.enabled_dependencies(
        spark.createDataFrame([(r,) for r in releases], "release int"), spark.createDataFrame(features, "release int, feature string, enables string"),
        spark.createDataFrame(deps, "release int, dep string, optional boolean"), spark.createDataFrame(wanted, "release int, feature string"),
    )
    want = plain_enabled(set(releases) - {None}, features, deps, wanted)
    assert len(want) > 30 and sorted((tuple(x) for x in got.collect()), key=str) == want
    assert not rounds and got._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1


def plain_keywords(docs, n):
    counted = {}
    for key, body in docs:
        if key is not None and body is not None:
            for p in re.split(r"[^a-z0-9\s-]+|\n", re.sub(rf"\b(?:{'|'.join(text.STOP_WORDS)})\b", "|", body.lower())):
                words = re.split(r"\s+", p.strip(" "))
                if len(words) <= 3 and len(words[0]) > 2:
                    of = counted.setdefault(key, {})
                    of[tuple(words)] = of.get(tuple(words), 0) + 1
    out = []
    for key, of in counted.items():
        ratio = lambda w: sum(m * len(p) * p.count(w) for p, m in of.items()) / sum(m * p.count(w) for p, m in of.items())  # noqa: E731, B023
        best = sorted((-m, -round(sum(ratio(w) for w in p), 6), " ".join(p)) for p, m in of.items())[:n]
        out += [(key, p, -s, -m, i) for i, (m, s, p) in enumerate(best, 1)]
    return sorted(out)


def test_keywords_are_counted_where_their_text_is(spark):
    """Texts of repeated and null keys, tabs at a phrase's ends, stop words at hyphens and separators: one exchange, of texts."""
    rng = random.Random(11)
    bits = ["fast", "parser", "table", "x-a", "a-b", "the", "of", "The", "and", "no", "log", "log", "\t", "\n", ",", ", ", ".", "  ", "-", "r2"]
    docs = [(rng.choice([None, 1, 2, 3, 4]), rng.choice(["", " "]).join(f"{rng.choice(bits)} " for _ in range(rng.randrange(200)))) for _ in range(20)]
    docs += [(5, "fast \t"), (5, "\tfast"), (6, "the, of; fast\t parser"), (7, None), (8, "")]
    got = text.auto_keywords(spark.createDataFrame(docs, "doc_id int, text string"), n=9)
    rows = sorted(tuple(x[c] for c in ("doc_id", "phrase", "score", "n", "pos")) for x in got.collect())
    assert len(rows) > 30 and rows == plain_keywords(docs, 9)
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange ") == 1


def test_a_pair_of_collaborators_is_summed_once(spark):
    """Random owners, repeated rows and nulls; a package of 40 owners sends each of them those behind it only, cut from one list."""
    rng = random.Random(13)
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, *range(30)])) for _ in range(200)] + [(50, i) for i in range(40)]
    ranks = {**{p: rng.randrange(9) / 4 for p in range(11)}, 3: None, 50: 0.25}
    o, p = spark.createDataFrame(rows, "package int, owner int"), spark.createDataFrame(list(ranks.items()), "package int, rank double")
    held, sums = {q: {y for x, y in rows if x == q and y is not None} for q in ranks}, {}
    for q, members in held.items():
        for a in members:
            for b in members - {a}:
                sums.setdefault((a, b), []).append(ranks[q])
    score = {k: (round(sum(r + 0.5 for r in v if r is not None), 6) if any(r is not None for r in v) else None) for k, v in sums.items()}
    want = set()
    for a in {a for a, _ in score}:
        best = sorted(((b, s) for (x, b), s in score.items() if x == a), key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))[:5]
        want |= {(a, b, s, i) for i, (b, s) in enumerate(best, 1)}
    got = aggregates.collaborators(o, p, 5)
    assert {tuple(x[c] for c in ("owner", "other", "score", "pos")) for x in got.collect()} == want
    assert "slice(others" in got._jdf.queryExecution().optimizedPlan().toString()
