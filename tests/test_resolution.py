"""The dependency walk over releases and features against a plain walk."""

import random

import pytest

from pkgloom.operators import graph


def plain_closure(root, features, deps):
    """Two walks of a registry of dicts; features: {(release, feature): [descriptor]}."""
    out, direct = {}, set()
    for level in (0, 1):
        states, todo = {}, []

        def put(release, feature, kind, states=states, todo=todo):
            if states.get((release, feature), 9) > kind:
                states[release, feature] = kind
                todo.append((release, feature, kind))

        def bring(d, kind, near, put=put, level=level):
            if d["to_release"] is None or (d["target_specific"] and not level):
                return
            if d["to_release"] == root:
                return
            if near:
                direct.add(d["to_release"])
            for f in {"", *(x.lower() for x in d["features"]), *(["default"] if d["default_features"] else [])}:
                put(d["to_release"], f, max(kind, d["kind"]))

        put(root, "", 0), put(root, "default", 0)
        if level:
            for (release, f), what in features.items():
                if release == root and what:
                    put(root, f, 0)
            for d in deps:
                if d["release"] == root and (d["optional"] or d["kind"] == 2):
                    put(root, d["dep"].lower(), 0) if d["optional"] else None
                    bring(d, 0, True)
        while todo:
            release, feature, kind = todo.pop()
            near, own = release == root, [d for d in deps if d["release"] == release and d["kind"] < 2]
            if feature == "":
                for d in own:
                    if not d["optional"]:
                        bring(d, kind, near)
            elif (release, feature) in features:
                for x in features[release, feature]:
                    name, _, sub = x.partition("/")
                    key = name.removeprefix("dep:").removesuffix("?").lower()
                    if not sub and not x.startswith("dep:") and (release, key) in features:
                        put(release, key, kind)
                    for d in own:
                        if d["dep"].lower() == key:
                            if d["optional"]:
                                bring(d, kind, near)
                            if sub and d["to_release"] not in (None, root) and (level or not d["target_specific"]):
                                put(d["to_release"], sub.lower(), max(kind, d["kind"]))
                                if near:
                                    direct.add(d["to_release"])
            else:
                for d in own:
                    if d["optional"] and d["dep"].lower() == feature:
                        bring(d, kind, near)
        for (release, _), kind in states.items():
            if release != root:
                old = out.get(release, (9, False))
                out[release] = (min(old[0], kind), old[1] or level == 0)
    return {r: (k, d, r in direct) for r, (k, d) in out.items()}


def registry(seed):
    rng = random.Random(seed)
    releases = range(14)
    deps = [{"release": r, "dep": f"Dep{rng.randrange(6)}", "kind": rng.choice([0, 0, 0, 1, 2]), "optional": rng.random() < 0.5, "target_specific": rng.random() < 0.15, "default_features": rng.random() < 0.5, "features": rng.sample(["a", "B", "c"], rng.randrange(3)), "to_release": rng.choice([*releases, None])} for r in releases for _ in range(3)]
    for d in deps:
        d["optional"] = d["optional"] and d["kind"] < 2
    features = {}
    for r in releases:
        for f in ("default", "a", "b", "c", "dep3"):
            if rng.random() < 0.7:
                features[r, f] = rng.sample(["a", "b", "c", "dep:Dep1", "dep2", "Dep4/a", "dep5?/b", "dep:dep0/c", "dep3"], rng.randrange(4))
    return deps, features


def frames(spark, deps, features):
    d = spark.createDataFrame([tuple(x.values()) for x in deps], "release int, dep string, kind int, optional boolean, target_specific boolean, default_features boolean, features array<string>, to_release int")
    return spark.createDataFrame([(r, f, x) for (r, f), what in features.items() for x in what or [None]], "release int, feature string, enables string"), d


@pytest.mark.parametrize("seed", range(4))
def test_closure_equals_a_plain_walk(spark, seed):
    deps, features = registry(seed)
    f, d = frames(spark, deps, features)
    got = {}
    for x in graph.resolved_closure(spark.createDataFrame([(r,) for r in range(14)], "release int"), f, d).collect():
        got.setdefault(x.root, {})[x.release] = (x.kind, x.is_default, x.direct)
    assert got == {r: want for r in range(14) if (want := plain_closure(r, features, deps))}


def test_deep_features_descriptors_and_cycles(spark):
    """A chain of features six levels deep hands a feature to a dependency, whose own dependency comes along."""
    features = {(1, "default"): ["f0"], **{(1, f"f{i}"): [f"f{i + 1}"] for i in range(5)}, (1, "f5"): ["serde?/derive", "f0"], (2, "derive"): ["dep:macros"], (2, "default"): []}
    base = {"kind": 0, "optional": True, "target_specific": False, "default_features": False, "features": []}
    deps = [{"release": 1, "dep": "Serde", **base, "to_release": 2}, {"release": 2, "dep": "macros", **base, "to_release": 3}, {"release": 3, "dep": "back", **base, "optional": False, "to_release": 1}]
    order = ["release", "dep", "kind", "optional", "target_specific", "default_features", "features", "to_release"]
    f, d = frames(spark, [{k: x[k] for k in order} for x in deps], features)
    got = {x.release: (x.kind, x.is_default, x.direct) for x in graph.resolved_closure(spark.createDataFrame([(1,)], "release int"), f, d).collect()}
    assert got == {2: (0, True, True), 3: (0, True, False)}
    enabled = graph.enabled_dependencies(spark.createDataFrame([(1,), (2,)], "release int"), f, d, spark.createDataFrame([(1, "Default"), (2, "other")], "release int, feature string"))
    assert [(x.release, x.dep) for x in enabled.collect()] == [(1, "Serde")]


def test_versions_of_a_package(spark):
    closure = spark.createDataFrame([(0, 10, 0, False, True), (0, 11, 1, True, False), (0, 20, 2, False, False), (0, 21, 2, False, False)], "root int, release int, kind int, is_default boolean, direct boolean")
    releases = spark.createDataFrame([(10, "p", "1"), (11, "p", "2"), (20, "q", "1"), (21, "q", "3")], "release int, package string, sort_key string")
    flat = graph.flattened(closure, releases)
    assert sorted(map(tuple, flat.collect())) == [(0, "p", 0, True, True, 10, 2), (0, "q", 2, False, False, 21, 2)]
    assert sorted(map(tuple, graph.version_counts(flat).collect())) == [("p", 10, 1), ("q", 21, 1)]


def test_plain_closure_keeps_optional_runtime_beside_build(spark):
    e = spark.createDataFrame([(1, 2, 0, False), (2, 3, 0, True), (2, 3, 1, False), (3, 1, 0, False), (1, 4, 2, False), (4, 5, 0, False), (5, 6, 2, False)], "src int, dst int, kind int, optional boolean")
    got = {(x.root, x.node): (x.kind, x.is_default, x.direct) for x in graph.dependency_closure(e).collect() if x.root in (1, 2)}
    assert got == {(1, 2): (0, True, True), (1, 3): (0, True, False), (1, 4): (2, True, True), (1, 5): (2, True, False), (2, 3): (0, True, True), (2, 1): (0, True, False)}
    assert graph.dependency_closure(e.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_versions_are_counted_without_rows_of_roots(spark, seed):
    """With cycles, several releases a package and direct ones among them, against the closure told in rows."""
    deps, features = registry(seed)
    f, d = frames(spark, deps, features)
    roots, releases = spark.createDataFrame([(r,) for r in range(14)], "release int"), spark.createDataFrame([(r, r % 5, f"{r // 5}") for r in range(14)], "release int, package int, sort_key string")
    want = graph.version_counts(graph.flattened(graph.resolved_closure(roots, f, d), releases))
    got = graph.resolved_version_counts(roots, f, d, releases)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_a_state_goes_on_once_however_many_roads_lead_to_it(spark):
    """Of a ladder every release is reached over roads of many lengths, of which each round used to find one."""
    edges = [(i, i + j) for i in range(12) for j in (1, 2, 3)]
    links = spark.createDataFrame([(a, "", b, "", 0, 0) for a, b in edges], "release int, feature string, to_release int, to_feature string, edge_kind int, least_level int")
    starts = spark.createDataFrame([(r, 0, r, "", 0) for r in range(4)], "root int, level int, release int, feature string, kind int")
    states = [x.release for x in graph._walk(starts, links, graph._blocks(starts)).collect() if x.release < 12]
    assert sorted(states) == list(range(12))
    level, n, cyclic = graph._levels(links)
    assert ({x.release: x.level for x in level.collect()}, n, cyclic) == ({i: i for i in range(12)}, 12, False)
    around = links.unionByName(links.limit(1).selectExpr("14 AS release", "feature", "5 AS to_release", "to_feature", "edge_kind", "least_level"))
    level, n, cyclic = graph._levels(around)
    assert ({x.release: x.level for x in level.collect()}, n, cyclic) == ({**{i: min(i, 5) for i in range(12)}, 14: 5}, 5, True)
