"""Ranges of keys against plain loops, and one hot package."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pkgloom.operators import graph, joins, ranges

KEY = "lpad(CAST({} AS STRING), 8, '0')"


def key(n):
    return f"{n:08d}"


@pytest.fixture(scope="module")
def world():
    rng = random.Random(5)
    points = [(p, key(rng.randrange(40)), rng.randrange(9), i, rng.random() < 0.2, rng.random() < 0.3) for p, n in (("a", 70), ("b", 1), ("c", 12), ("e", 300)) for i in range(n)]
    asked = [(i, p, key(rng.randrange(42)), key(rng.randrange(42))) for i, p in enumerate(rng.choice("abcde") for _ in range(400))]
    return points, asked + [(400, "a", None, key(9)), (401, "a", key(3), None), (402, None, key(1), key(2)), (403, "a", key(0), key(41)), (404, "a", key(0), key(41))]


def frames(spark, world):
    points, asked = world
    p = spark.createDataFrame(points, "package string, sort_key string, users int, release int, yanked boolean, is_pre boolean").withColumns({"created": F.col("release") * 7 % 11, "version": F.concat(F.lit("1."), F.col("sort_key").cast("int").cast("string"), F.lit(".3"))})
    return p, spark.createDataFrame(asked, "dep_id int, package string, low string, high string")


def inside(points, p, low, high):
    return [x for x in points if x[0] == p and None not in (low, high) and low <= x[1] < high]


def test_pieces_cover_each_place_once(spark):
    for b in (1, 2, 5, 16, 17, 64, 65, 255, 256, 257, 4096, 4**9):
        spans = {a: b for a in (0, 1, 3, 4, 15, 16, 17, 63, 250) if a < b}
        got = covered_by(spark, spans)
        assert {a: sorted(x) for a, (x, _) in got.items()} == {a: list(range(a, b)) for a in spans}
        assert max(n for _, n in got.values()) <= 2 * (ranges.BASE - 1) * 10


def test_resolution_and_extremes(spark, world):
    points, asked = world
    r, deps = frames(spark, world)
    got = {x.dep_id: (x.release, x.matched) for x in joins.resolve_dependency(deps, r).collect()}
    ends = {x.dep_id: (x.highest, x.lowest) for x in joins.matching_extremes(deps, r).collect()}
    for i, p, low, high in asked:
        hit, own = inside(points, p, low, high), [x for x in points if x[0] == p]
        live = [(x[3] * 7 % 11, x[3]) for x in hit if not x[4]]
        rest = [(x[3] * 7 % 11, x[3]) for x in own]
        assert got[i] == (max(live)[1] if live else max(rest)[1] if rest else None, bool(live))
        want = (max((x[1], x[3]) for x in hit)[1], min((x[1], x[3]) for x in hit)[1]) if hit else None
        assert ends.get(i) == want


def test_upgrades(spark, world):
    points, asked = world
    r, deps = frames(spark, world)
    got = {x.dep_id: (x.target, x.target_version) for x in joins.upgrade_target(deps, r).collect()}
    for i, p, low, high in asked:
        own, hit = [x for x in points if x[0] == p], inside(points, p, low, high)
        if not own:
            assert i not in got
            continue
        above = [x for x in own if not hit or x[1] >= max(y[1] for y in hit)]
        best = max((not x[5], x[1], x[3]) for x in above)
        minor = int(best[1])
        assert got[i] == (best[2], f"1.{minor}.{0 if minor else 3}")


def test_popularity(spark, world):
    points, asked = world
    r, deps = frames(spark, world)
    got = {x.dep_id: (x.popularity, x.matches_latest) for x in graph.version_popularity(deps, r, spark.createDataFrame([("c",)], "package string")).collect()}
    for i, p, low, high in asked:
        own = [x for x in points if x[0] == p]
        if not own:
            assert i not in got
            continue
        if low is None or high is None or low >= high:
            continue
        hit, other = inside(points, p, low, high), [x for x in own if not low <= x[1] < high]
        matches, most, rest = sum(x[2] for x in hit) + 1, max([x[2] for x in hit], default=0) + 1, max([x[2] for x in other], default=0)
        want = 0.0 if p == "c" or not sum(x[2] for x in own) else (matches / (matches + sum(x[2] for x in other)) + most / (most + rest)) / 2
        assert abs(got[i][0] - want) < 1e-12
        latest = {max(own, key=lambda x: (not x[4] and not x[5], x[1]))[1], max(own, key=lambda x: (not x[4], x[1]))[1]}
        assert got[i][1] == (p != "c" and any(low <= k < high for k in latest))


def test_worst_advisory(spark, world):
    points, asked = world
    r, deps = frames(spark, world)
    adv = deps.selectExpr("package", "dep_id AS advisory", "IF(dep_id % 6 = 0, NULL, dep_id % 4) AS severity", "low", "high", "dep_id % 7 = 0 AS withdrawn")
    got = {(x.package, x.release): (x.severity, x.advisory) for x in joins.worst_advisory(r, adv).collect()}
    want = {}
    for x in points:
        hits = [(i % 4, i) for i, p, low, high in asked if i % 6 and i % 7 and inside([x], p, low, high)]
        if hits:
            want[x[0], x[3]] = max(hits)
    assert got == want


def test_empty_tables(spark, world):
    r, deps = frames(spark, world)
    assert joins.resolve_dependency(deps.limit(0), r).count() == 0
    assert joins.resolve_dependency(deps, r.limit(0)).where("release IS NULL AND NOT matched").count() == deps.count()
    assert joins.matching_extremes(deps, r.limit(0)).count() == joins.upgrade_target(deps, r.limit(0)).count() == 0


def test_one_hot_package(spark):
    """10**5 releases and 10**6 dependencies of one package: a product would have 10**11 rows."""
    r = spark.range(100_000).selectExpr("'hot' AS package", "id AS release", KEY.format("id") + " AS sort_key", "(id * 7919) % 100000 AS created", "id % 10 = 0 AS yanked")
    deps = spark.range(1_000_000).selectExpr("id AS dep_id", "'hot' AS package", KEY.format("id % 3000 * 33") + " AS low", KEY.format("id % 3000 * 33 + 1 + id % 7 * 100") + " AS high")
    got = joins.resolve_dependency(deps, r)
    found = got.join(deps, ["dep_id", "package"]).select("release", "matched", "low", "high").distinct().toPandas()
    assert got.where("matched").count() + got.where("NOT matched").count() == 1_000_000
    for x in found.sample(300, random_state=1).itertuples():
        live = [n for n in range(int(x.low), min(100_000, int(x.high))) if n % 10]
        assert x.matched == bool(live) and (not live or x.release == max(live, key=lambda n: n * 7919 % 100_000))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.integers(0, 300), st.integers(1, 300), min_size=1, max_size=30))
def test_any_spans(spark, sizes):
    spans = {a: a + n for a, n in sizes.items()}
    assert {a: sorted(x) for a, (x, _) in covered_by(spark, spans).items()} == {a: list(range(a, b)) for a, b in spans.items()}


def covered_by(spark, spans):
    got = {}
    for r in ranges.pieces(spark.createDataFrame(list(spans.items()), "first long, past long")).collect():
        unit = ranges.BASE**r["size"]
        places, n = got.get(r["first"], ([], 0))
        got[r["first"]] = (places + list(range(r["block"] * unit, (r["block"] + 1) * unit)), n + 1)
    return got
