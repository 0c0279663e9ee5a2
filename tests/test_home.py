"""The home page's categories against a plain, sequential version."""

import random

import pytest

from pkgloom.operators import windows


def plain_home(tree, best, info, adjust, pairs):
    """tree: {slug: (parent, place, own)}; best: {slug: [package]}; info: {package: (name, downloads, updated)}."""
    children = {}
    for slug, (parent, place, _) in tree.items():
        children.setdefault(parent, []).append((place, slug))
    seen, top, rank, display, pops, dls = set(), {}, {}, {}, {}, {}

    def choose(parent):
        slugs = [s for _, s in sorted(children.get(parent, []))]
        for s in slugs:
            choose(s)
            pops[s] = max([tree[s][2], *(pops[c] for _, c in children.get(s, []))])
        for s in sorted(slugs, key=lambda s: (pops[s], s)):
            top[s] = [p for p in best.get(s, [])[:35] if p not in seen][:8]
            seen.update(top[s])
            sub = display.get(s, [])
            dls[s] = max(sum(info[p][1] for p in top[s]), dls[sub[0]] if sub else 0)
            rank[s] = float(dls[s]) * pops[s] * adjust.get(s, 1.0)
        for a, b in pairs:
            if a in slugs and b in slugs:
                rank[a], rank[b] = (rank[a] * 17 + rank[b] * 15) / 32, (rank[a] * 15 + rank[b] * 17) / 32
        display[parent] = sorted(slugs, key=lambda s: (-rank[s], s))

    def add(parent):
        for s in display.get(parent, []):
            add(s)
            used = sum(len(info[p][0]) + 1 for p in top[s])
            for p in sorted(best.get(s, []), key=lambda p: (-info[p][2], p)):
                if p not in seen:
                    seen.add(p)
                    fresh.setdefault(s, []).append(p)
                    used += len(info[p][0]) + 1
                    if used >= 140:
                        break

    fresh = {}
    choose(None)
    add(None)
    return top, fresh, rank, display


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_one_after_another(spark, seed):
    rng = random.Random(seed)
    slugs = [f"c{i:02d}" for i in range(14)]
    tree = {s: (None if i < 4 else rng.choice(slugs[: i - 1]), rng.randrange(50), rng.randrange(5, 400)) for i, s in enumerate(slugs)}
    info = {p: ("n" * rng.randrange(3, 30), rng.randrange(1, 5000), rng.randrange(10**6)) for p in range(160)}
    best = {s: rng.sample(range(160), rng.choice([0, 5, 30, 60])) for s in slugs}
    adjust, pairs = {"c01": 0.5, "c02": 3.0}, (("c00", "c01"), ("c04", "c05"))
    pairs = tuple(p for p in pairs if tree[p[0]][0] == tree[p[1]][0])
    t = spark.createDataFrame([(s, *x) for s, x in tree.items()], "slug string, parent string, place int, own_popularity int")
    b = spark.createDataFrame([(s, p, i) for s, ps in best.items() for i, p in enumerate(ps, 1)], "slug string, package int, pos int")
    k = spark.createDataFrame([(p, *x) for p, x in info.items()], "package int, name string, downloads int, updated int")
    rows, shown = windows.home_categories(b, k, t, adjust, pairs)
    top, fresh, rank, display = plain_home(tree, best, info, adjust, pairs)
    got = {}
    for r in rows.orderBy("slug", "is_recent", "place").collect():
        got.setdefault((r.slug, r.is_recent), []).append(r.package)
    assert got == {(s, False): x for s, x in top.items() if x} | {(s, True): x for s, x in fresh.items()}
    for r in shown.collect():
        assert abs(r["rank"] - rank[r.slug]) < 1e-6 * max(1, rank[r.slug]) and display[r.parent][r.display - 1] == r.slug


def test_no_packages(spark):
    t = spark.createDataFrame([("a", None, 1, 3), ("b", "a", 1, 9)], "slug string, parent string, place int, own_popularity int")
    b = spark.createDataFrame([], "slug string, package int, pos int")
    k = spark.createDataFrame([], "package int, name string, downloads int, updated int")
    rows, shown = windows.home_categories(b, k, t)
    assert rows.count() == 0 and sorted((r.slug, r.display) for r in shown.collect()) == [("a", 1), ("b", 1)]
    assert [r.slug for r in windows.category_turns(t).orderBy("turn").collect()] == ["b", "a"]
