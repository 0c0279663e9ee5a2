"""Small cases of the column expressions and helpers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pkgloom.functions import semver
from pkgloom.operators import aggregates, categorise, clean, compat, graph, ingest, scoring, text, timeseries, windows
from pkgloom.operators import joins as j


def column(spark, values, f, kind="string"):
    return [r[1] for r in sorted(spark.createDataFrame(list(enumerate(values)), f"i int, c {kind}").select("i", f(F.col("c"))).collect())]


def test_versions_sort_with_pre_releases(spark):
    order = ["0.0.1", "0.9.0", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.2.0", "1.10.0", "10.0.0"]
    keys = column(spark, order, semver.key)
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    assert column(spark, ["bad", "1.2", "01.2.3", None], semver.key) == [None] * 4
    assert column(spark, ["1.2.3", "0.4.1", "0.0.7"], semver.compat_class) == ["1", "0.4", "0.0.7"]


@pytest.mark.parametrize(("requirement", "yes", "no"), [
    ("^1.2", ["1.2.0", "1.9.9"], ["1.1.9", "2.0.0", "2.0.0-rc.1"]), ("1.2.3", ["1.2.3", "1.3.0"], ["1.2.2", "2.0.0"]), ("~1.2.3", ["1.2.9"], ["1.3.0"]), ("=1.2.3", ["1.2.3"], ["1.2.4"]),
    ("0.3", ["0.3.5"], ["0.4.0"]), ("^0.0.3", ["0.0.3"], ["0.0.4"]), (">=1, <1.5", ["1.4.9"], ["1.5.0"]), ("1.*", ["1.7.0"], ["2.0.0"]), ("*", ["0.0.1", "9.9.9"], []), (">1.2.3", ["1.2.4"], ["1.2.3"]), ("<=1.2", ["1.2.9"], ["1.3.0"]),
])
def test_requirements(spark, requirement, yes, no):
    low, high = semver.interval(requirement)
    keys = dict(zip(yes + no, column(spark, yes + no, semver.key), strict=True))
    assert all(low <= keys[v] < high for v in yes) and not any(low <= keys[v] < high for v in no)


def test_impossible_requirements():
    assert semver.interval("banana") is None and semver.interval(">2, <1") is None


def test_repositories(spark):
    urls = ["HTTPS://GITHUB.COM/FOO/BAR", "https://gitlab.com/user/sub/project.git", "N/A", "https://github.com/a/b.git#x"]
    got = column(spark, urls, clean.parse_repo)
    assert (got[0].owner, got[0].repo) == ("foo", "bar") and (got[1].owner, got[1].repo) == ("user", "sub/project") and got[2] is None and got[3].repo == "b"
    links = column(spark, urls, lambda c: clean.repo_urls(clean.parse_repo(c)))
    assert links[0].git == "https://github.com/foo/bar.git" and links[1].readme_base == "https://gitlab.com/user/sub/project/-/blob/HEAD/"


def test_origins(spark):
    keys = ["crates.io:hello", "github:foo/bar/baz"]
    assert column(spark, keys, lambda c: clean.format_origin(clean.parse_origin(c))) == keys
    assert [o.package for o in column(spark, keys, clean.parse_origin)] == ["hello", "baz"]


def test_licences_trains_and_keywords(spark):
    assert column(spark, ["AGPL AND MIT", "FTL / GPL-2.0", "Apache/MIT AND LGPL", "Mystery", "AGPL OR MIT", "MIT/Apache/LGPL", "MPL/LGPL", "IJG OR GPL-2.0"], clean.license_virality) == [6, 0, 2, None, 0, 0, 0, 0]
    assert column(spark, [dt.date(2015, 5, 15), dt.date(2015, 5, 14), dt.date(2016, 5, 15)], clean.release_train, "date") == [0, 0, 8]
    assert column(spark, ["FooBar baz", "test-CRATE", "Über_X"], clean.normalize_keyword) == ["foo-bar-baz", "test-crate", "über_x"]
    assert column(spark, ["https://www.a.org/x", "http://me.github.io", "https://raw.githubusercontent.com/x", "no"], clean.url_domain) == ["a.org", "github.io", None, None]


def test_scores(spark):
    one = spark.range(1)
    s = lambda rules: one.select(scoring.score(rules)).first()[0]
    assert s([("a", 5, F.lit(5))]) == 1.0
    assert s([("a", 5, F.lit(5)), ("b", 15, F.lit(0))]) == 0.25
    assert s([("a", 10, F.lit(5)), ("b", 28, F.lit(14))]) == 0.5


def test_readme_and_code(spark):
    page = spark.createDataFrame([(1, "<h1>T</h1><p>hello <img src=a.png><img src='https://shields.io/x.svg'></p><ul><li>a</li><li>b</li></ul><pre>12345</pre>")], "id int, html string")
    r = clean.readme_props(page, "id", "html").first()
    assert (r.n_images, r.n_sections, r.n_rows, r.n_pre, r.code_len) == (1, 1, 2, 1, 5)
    files = spark.createDataFrame([("p", "src/lib.rs", "fn main() {}\n// note\n"), ("p", "b.c", "int x;"), ("p", "tests/t.rs", "x"), ("p", ".hidden.py", "x"), ("p", "README", "x")], "package string, path string, content string")
    assert {(x.language, x.code, x.comments) for x in clean.code_stats(files).collect()} == {("Rust", 1, 1), ("C", 1, 0)}


def test_upsert_sequence(spark):
    schema = "id long, login string, html_url string, kind string"
    old = spark.createDataFrame([(1, "HELLO", "u", None)], schema)
    out = ingest.upsert_coalesce(spark.createDataFrame([(1, "HELlO", None, "user"), (2, "", None, None)], schema), old, ["id"], ["login", "html_url", "kind"])
    assert {tuple(r) for r in out.collect()} == {(1, "HELlO", "u", "user"), (2, None, None, None)}


def test_daily_max_is_commutative(spark):
    a = spark.createDataFrame([("p", 1, 5), ("q", 1, 2)], "k string, d int, n int")
    b = spark.createDataFrame([("p", 1, 7), ("r", 1, 1)], "k string, d int, n int")
    no = lambda df: df.withColumn("o", F.lit(False))
    one = {tuple(r) for r in ingest.merge_daily_max(no(a), b, ["k", "d"], "n", "o").collect()}
    assert one == {tuple(r) for r in ingest.merge_daily_max(no(b), a, ["k", "d"], "n", "o").collect()} == {("p", 1, 7), ("q", 1, 2), ("r", 1, 1)}


def test_closure_is_idempotent_and_cycles_end(spark):
    edges = spark.createDataFrame([(1, 2, 0, False), (2, 3, 1, False), (3, 1, 0, False), (1, 4, 2, True), (4, 5, 0, False)], "src int, dst int, kind int, optional boolean")
    got = {tuple(r) for r in graph.dependency_closure(edges).collect()}
    assert (1, 3, 1, True, False) in got and (1, 5, 2, False, False) in got and (3, 2, 0, True, False) in got
    again = graph.dependency_closure(spark.createDataFrame([(a, b, k, not d) for a, b, k, d, _ in got], edges.schema))
    assert {r[:2] for r in map(tuple, again.collect())} == {r[:2] for r in got}


def test_enabled_dependencies(spark):
    deps = spark.createDataFrame([(1, "Serde", True), (1, "log", False), (1, "rand", True)], "release int, dep string, optional boolean")
    features = spark.createDataFrame([(1, "full", "extra"), (1, "extra", "serde")], "release int, feature string, enables string")
    wanted = spark.createDataFrame([(1, "full")], "release int, feature string")
    got = graph.enabled_dependencies(spark.createDataFrame([(1,)], "release int"), features, deps, wanted)
    assert {r.dep for r in got.collect()} == {"Serde", "log"}


def test_pagerank_keeps_its_mass(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "src int, dst int")
    start = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 1.0)], "node int, score double")
    assert abs(graph.pagerank(edges, start).agg(F.sum("score")).first()[0] - 1) < 1e-9


def test_compat_has_no_success_below_a_certain_failure(spark):
    rows = [("p", 1, 40, "Y"), ("p", 1, 30, "X"), ("p", 1, 20, "y"), ("p", 2, 50, "N"), ("p", 2, 45, "Y"), ("q", 1, 30, "N"), ("q", 1, 20, "n")]
    m = compat.normalise(compat.matrix(spark.createDataFrame(rows, "package string, release int, compiler int, verdict string")))
    got = {tuple(r) for r in m.collect()}
    assert got == {("p", 1, 40, "Y"), ("p", 1, 30, "X"), ("p", 2, 45, "Y"), ("q", 1, 20, "n")}
    filled = {tuple(r) for r in compat.fill(m).collect()}
    assert got <= filled and ("p", 2, 30, "N") in filled


def test_diversify_keeps_the_rows_and_lowers_repeats(spark):
    items = spark.createDataFrame([(1, i, 10.0 - i / 10) for i in range(20)], "list_id int, item int, score double")
    owners = spark.createDataFrame([(i, 0, "same" if i < 15 else f"o{i}") for i in range(20)], "item int, place int, owner string")
    keywords = spark.createDataFrame([(i, 0, f"k{i % 3}") for i in range(20)], "item int, place int, keyword string")
    out = {r["item"]: r["pos"] for r in windows.diversify(items, owners, keywords).collect()}
    assert set(out) == set(range(20)) and out[15] < 15 and out[0] == 1


def test_release_counts_and_names(spark):
    r = spark.createDataFrame([("p", i, f"0.{i}.0", dt.datetime(2020, 1, 1 + i), False) for i in range(10)], "package string, release int, version string, created timestamp, yanked boolean")
    c = aggregates.release_counts(semver.semver_table(r), F.lit("2020-02-01").cast("date")).first()
    assert (c.total, c.breaking, c.stable, c.patch) == (10, 9, 0, 0)
    s = spark.createDataFrame([("p", "The LaTeX tool", "latex"), ("p", "We use LaTeX", "latex"), ("p", "latex it is", "latex")], "package string, text string, name string")
    assert aggregates.name_capitalisation(s).first().spelling == "LaTeX"


def test_dependency_changes(spark):
    h = spark.createDataFrame([("r", dt.datetime(2020, 1, 1), ["a", "b"]), ("r", dt.datetime(2020, 2, 1), ["b", "c"])], "repo string, committed timestamp, deps array<string>")
    got = {(r.package, r.replacement): round(r.weight, 4) for r in aggregates.dependency_changes(h).collect()}
    assert got == {("a", "c"): 1.0, ("a", None): 1.0}  # what the history begins with was never added


def test_dependency_changes_one_commit_after_another(spark):
    rng = random.Random(8)
    histories = {f"r{i}": [sorted(d for d in "abcdefghijklmn" if rng.random() < 0.3 + 0.4 * ((ord(d) + n // 3 + i) % 3 == 0)) for n in range(rng.randrange(1, 9))] for i in range(25)}
    want = {}
    for commits in histories.values():
        state, newest_first = {}, commits[::-1][:6]
        for age, deps in enumerate(newest_first):
            added = sorted(d for d, open_ in state.items() if open_ and d not in deps)
            state.update(dict.fromkeys(added, False))
            removed = sorted(d for d in deps if d not in state and age)
            state.update({d: True for d in deps if d not in state})
            n = len(added)
            pairs = [(a, b, 8 / (7 + n)) for a in removed for b in added] + [(a, None, 8 / (7 + n) if n else 0.95) for a in removed]
            if not removed and n > 1:
                pairs += [(a, b, 30 / n**2 / (30 + age)) for a in added[:8] for b in added[:5] if a != b]
            for a, b, w in pairs:
                want[a, b] = want.get((a, b), 0) + w
    h = spark.createDataFrame([(r, dt.datetime(2020, 1, 1 + n), d) for r, commits in histories.items() for n, d in enumerate(commits)], "repo string, committed timestamp, deps array<string>")
    got = {(r.package, r.replacement): r.weight for r in aggregates.dependency_changes(h, 6).groupBy("package", "replacement").agg(F.sum("weight").alias("weight")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 50


def test_top_result_keywords_and_lists(spark):
    r = spark.createDataFrame([(1, d, k, 1.0) for d in range(6) for k in (["web"] if d < 2 else ["cli", "web"] if d == 2 else ["all"])], "query_id int, doc_id int, keyword string, score double")
    assert {x.keyword for x in aggregates.top_result_keywords(r, 0.6).collect()} == {"web", "all"}


def test_adjust_categories(spark):
    c = spark.createDataFrame([("p", "a", 0.4), ("p", "b", 0.39), ("p", "c", 0.1)], "package string, slug string, weight double")
    bag = spark.createDataFrame([("p", "x"), ("p", "y")], "package string, keyword string")
    out = categorise.adjust_categories(c, bag, [{"kind": "any", "keywords": ["x", "y"], "slug": "b", "mul": 1.0, "add": 0.1}]).collect()
    assert [(r.slug, round(r.weight, 3)) for r in out] == [("b", 0.531)]


def test_auto_keywords(spark):
    d = spark.createDataFrame([(1, "The fast parser of tables. A fast parser; fast parser!"), (2, None), (3, "")], "doc_id int, text string")
    assert text.auto_keywords(d).where("pos = 1").first().phrase == "fast parser"


def test_despam_raises_nothing(spark):
    day = dt.date(2020, 1, 1)
    rows = [("p", "1", day + dt.timedelta(i), 10 if i != 10 else 1000) for i in range(20)]
    d = spark.createDataFrame(rows, "package string, version string, day date, n long")
    out = timeseries.despam(d, [{"start": "2020-01-10", "end": "2020-01-12", "headroom": 5, "lookaround": 5, "names": None}]).where("override").collect()
    assert [(r.day, r.n) for r in out] == [(day + dt.timedelta(10), 10)]


def test_hot_key_top_n(spark):
    df = spark.range(1000).selectExpr("id", "1 AS k")
    assert [r.id for r in j.top_n(df, ["k"], [F.desc("id")], 3).orderBy("pos").collect()] == [999, 998, 997]


def scan(text, nested=True):
    """(code, comments) of a C-like text, character by character."""
    depth = code = comments = 0
    for raw in text.split("\n"):
        t, i, in_string, has_code, has_comment = raw.strip(), 0, False, False, depth > 0
        if not t:
            continue
        while i < len(t):
            two = t[i : i + 2]
            if depth:
                step = 2 if two in ("/*", "*/") else 1
                depth += (1 if nested else 0) if two == "/*" else -1 if two == "*/" else 0
                i += step
            elif in_string:
                i += 2 if t[i] == "\\" else 1
                in_string = t[i - 1] != '"' or t[i - 2 : i - 1] == "\\"
            elif two == "//":
                has_comment = True
                break
            elif two == "/*":
                depth, has_comment, i = 1, True, i + 2
            else:
                has_code |= not t[i].isspace()
                in_string = t[i] == '"'
                i += 1
        code += has_code
        comments += not has_code and has_comment
    return code, comments


def test_code_lines_with_block_comments(spark):
    rng = random.Random(4)
    lines = ["/*", "*/", "/* a */", "// b", "x = 1;", 'y("/* no */");', 's("// no");', "", "  ", "z(); /* open", "text */", "done */ w();", "/* a */ v();", "u(); // /*", 't("\\" /* ");', "* star"]
    texts = ["\n".join(rng.choices(lines, k=30)) for _ in range(80)]
    files = spark.createDataFrame([(i, "src/a.rs", t) for i, t in enumerate(texts)] + [(99, "a.py", None)], "package int, path string, content string")
    got = {r.package: (r.code, r.comments) for r in clean.code_stats(files).collect()}
    assert got == {i: scan(t) for i, t in enumerate(texts) if sum(scan(t))}


def test_docstrings_and_flags(spark):
    files = spark.createDataFrame([
        ("p", "a.py", '"""doc\n\nmore"""\nx = 1  # y\n# z\ndef f():\n    """one"""\n'), ("p", "src/lib.rs", '/*!\n  hello\nworld */ rest\n//! more\n/*! not */\n#![feature(x)]\nlet s = "#![feature(y)]";\n'),
        ("q", "lib.rs", "// #![feature(x)]\nfn a() { try!(b) }\n"), ("q", "src/deep/tests/x.rs", "// try!(x)\nf();"), ("q", "x.h", "int a;"), ("r", "src/main.rs", None),
    ], "package string, path string, content string")
    assert {(x.package, x.language, x.code, x.comments) for x in clean.code_stats(files).collect()} == {("p", "Python", 2, 4), ("p", "Rust", 3, 4), ("q", "Rust", 2, 2)}
    assert {tuple(x) for x in clean.source_flags(files).collect()} == {("p", True, False, "hello\nworld \n more"), ("q", False, True, ""), ("r", False, False, "")}
