"""Bindings of files, names, addresses, dates and flags."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions import days
from ..functions.semver import _padded as sort_key
from ..operators import clean, flags, ingest
from ..sources import dump
from ..streaming.feed import folder
from .registry import query
from .views import Views


@query("a1_read_dump", """WITH d AS (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS downloads FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS id, o_custkey AS crate_id, concat('1.', o_orderkey % 10, '.0') AS num, concat('{"a": ["b,', o_orderkey % 7, '"]}', chr(10), 'end') AS features, c_name AS login, downloads FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN d ON l_orderkey = o_orderkey""")
def _(v: Views):
    path = folder(v.spark, "dump")
    text = F.lit("2020-01-01 00:00:00")
    versions = v.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("crate_id"), F.expr("concat('1.', o_orderkey % 10, '.0')").alias("num"), F.lit(10).alias("crate_size"), text.alias("created_at"), text.alias("updated_at"), F.lit(1).alias("downloads"),
        F.concat(F.lit('{"a": ["b,'), F.expr("CAST(o_orderkey % 7 AS STRING)"), F.lit('"]}\nend')).alias("features"), F.lit("MIT").alias("license"), F.lit("x").alias("links"), F.col("o_custkey").alias("published_by"), F.lit("f").alias("yanked"), F.lit("0").alias("checksum"),
    )
    users = v.customer.selectExpr("c_custkey AS id", "c_custkey AS github_id", "c_name AS login", "c_name AS name", "'a' AS avatar")
    downloads = v.lineitem.selectExpr("CAST(l_shipdate AS DATE) AS date", "CAST(l_quantity AS BIGINT) AS downloads", "l_orderkey AS version_id")
    for name, table in {"versions": versions, "users": users, "version_downloads": downloads}.items():
        table.write.option("escape", '"').csv(f"{path}/{name}.csv", header=True)
    read = dump.read_dump(v.spark, path, {n: dump.SCHEMAS[n] for n in ("versions", "users", "version_downloads")})
    total = read["version_downloads"].groupBy(F.col("version_id").alias("id")).agg(F.sum("downloads").alias("downloads"))
    people = read["users"].select(F.col("id").alias("published_by"), "login")
    return read["versions"].drop("downloads").join(people, "published_by", "left").join(total, "id", "left").select("id", "crate_id", "num", "features", "login", "downloads")


@query("a3_read_rule_list", "SELECT concat('part', p_partkey) AS name, concat(p_type, ': ', p_brand) AS slugs FROM part")
def _(v: Views):
    path = folder(v.spark, "rules")
    lines = F.array(F.lit("# rules"), F.lit(""), F.expr("concat(' part', p_partkey, ': ', p_type, ': ', p_brand, '  # a note')"))
    v.part.select(F.explode(lines).alias("value")).write.text(path)
    return dump.read_rule_list(v.spark, path, ":", ["name", "slugs"])


@query("a4_read_registry_index", "SELECT concat('crate', package) AS name, version AS vers, yanked, concat('Dep', release % 7) AS dep, '^1' AS req, 'std' AS feature FROM releases WHERE release % 50 > 0")
def _(v: Views):
    path = folder(v.spark, "index")
    dep = F.expr("named_struct('name', concat('Dep', release % 7), 'req', '^1', 'optional', false, 'kind', 'normal', 'target', CAST(NULL AS STRING))")
    rows = v.releases.select(F.expr("CASE WHEN release % 50 = 0 THEN 'Test+Package' ELSE concat('Crate', package) END").alias("name"), F.col("version").alias("vers"), F.array(dep).alias("deps"), F.expr("map('std', array('alloc'))").alias("features"), "yanked")
    rows.write.json(path)
    index = dump.read_registry_index(v.spark, path)
    return index.select("name", "vers", "yanked", F.explode("deps").alias("d"), "features").select("name", "vers", "yanked", F.col("d.name").alias("dep"), "d.req", F.explode(F.map_keys("features")).alias("feature"))


@query("a7_explode_contributions", """WITH o AS (SELECT o_orderkey AS repo, concat('u', o_custkey) AS login, o_orderkey % 1000 * 604800 AS w FROM orders)
SELECT repo, login, w AS week, repo % 9 AS added, 1 AS deleted, 2 AS commits FROM o UNION ALL SELECT repo, login, w + 604800, 0, repo % 5, 1 FROM o""")
def _(v: Views):
    week = "named_struct('w', {w}, 'a', {a}, 'd', {d}, 'c', {c})"
    weeks = f"array({week.format(w='o_orderkey % 1000 * 604800', a='o_orderkey % 9', d='1L', c='2')}, {week.format(w='o_orderkey % 1000 * 604800 + 604800', a='0L', d='o_orderkey % 5', c='1')})"
    repos = v.orders.selectExpr("o_orderkey AS repo", f"to_json(array(named_struct('author', named_struct('login', concat('u', o_custkey)), 'weeks', {weeks}))) AS json")
    return dump.explode_contributions(repos).withColumn("week", F.unix_timestamp("week"))


@query("a18_read_years", "SELECT package, version, day, n FROM daily WHERE year(day) IN (1995, 1996)")
def _(v: Views):
    path = folder(v.spark, "years")
    ingest.write_partitioned_years(v.daily, path)
    return ingest.read_years(v.spark, path, [1995, 1996]).select("package", "version", "day", "n")


@query("b1_parse_origin", """WITH p AS (SELECT p_partkey AS package, p_size % 3 AS k, replace(upper(p_name), ' ', '-') AS name FROM part)
SELECT package, CASE k WHEN 0 THEN 'registry' WHEN 1 THEN 'github' ELSE 'gitlab' END AS host, CASE WHEN k = 0 THEN lower(name) ELSE name END AS name, CASE WHEN k > 0 THEN concat('o', k) END AS owner, CASE WHEN k > 0 THEN concat('r', package) END AS repo,
CASE k WHEN 0 THEN concat('registry:', lower(name)) WHEN 1 THEN concat('github:o1/r', package, '/', name) ELSE concat('gitlab:o2/r', package, '/', name) END AS text FROM p""")
def _(v: Views):
    p = v.part.selectExpr("p_partkey AS package", "p_size % 3 AS k", "replace(upper(p_name), ' ', '-') AS name")
    p = p.selectExpr("package", "CASE k WHEN 0 THEN concat('registry:', name) WHEN 1 THEN concat('github:o1/r', package, '/', name) ELSE concat('gitlab:o2/r', package, '/', name) END AS c")
    o = clean.parse_origin(F.col("c"))
    return p.select("package", o["host"].alias("host"), o["package"].alias("name"), o["owner"].alias("owner"), o["repo"].alias("repo"), clean.format_origin(o).alias("text"))


REPOSITORIES = """CASE p_size % 6 WHEN 0 THEN concat('https://www.GitHub.com/Owner', p_size, '/Repo', p_partkey, '.git') WHEN 1 THEN concat('https://gitlab.com/Group', p_size, '/Sub/Repo', p_partkey, '/-/tree/main')
WHEN 2 THEN concat('git+https://bitbucket.org/o', p_size, '/R', p_partkey, '/src') WHEN 3 THEN 'https://example.org/a/b' WHEN 4 THEN 'https://github.com/only' ELSE concat('https://gitlab.com/o', p_size, '/r', p_partkey, '#readme') END"""
HOSTED = """r AS (SELECT p_partkey AS package, p_size % 6 AS k, CASE p_size % 6 WHEN 0 THEN 'github.com' WHEN 1 THEN 'gitlab.com' WHEN 2 THEN 'bitbucket.org' WHEN 5 THEN 'gitlab.com' END AS host,
CASE p_size % 6 WHEN 0 THEN concat('owner', p_size) WHEN 1 THEN concat('group', p_size) WHEN 2 THEN concat('o', p_size) WHEN 5 THEN concat('o', p_size) END AS owner,
CASE p_size % 6 WHEN 0 THEN concat('repo', p_partkey) WHEN 1 THEN concat('sub/repo', p_partkey) WHEN 2 THEN concat('r', p_partkey) WHEN 5 THEN concat('r', p_partkey) END AS repo, CASE WHEN p_partkey % 2 = 0 THEN 'a/b' ELSE '' END AS dir, CASE WHEN p_partkey % 3 = 0 THEN 'v1' ELSE 'HEAD' END AS rev FROM part)"""


@query("b3_parse_repo", f"WITH {HOSTED} SELECT package, host, owner, repo FROM r")
def _(v: Views):
    r = clean.parse_repo(F.col("url"))
    return v.part.selectExpr("p_partkey AS package", f"{REPOSITORIES} AS url").select("package", r["host"].alias("host"), r["owner"].alias("owner"), r["repo"].alias("repo"))


@query("b4_repo_urls", f"""WITH {HOSTED}, u AS (SELECT *, concat('https://', host, '/', owner, '/', repo) AS base, concat('https://', host, '/', owner, '/', repo, CASE WHEN k = 1 THEN '/-' ELSE '' END) AS web, concat('/', rev, '/', dir, CASE WHEN dir <> '' THEN '/' ELSE '' END) AS below FROM r WHERE host IS NOT NULL)
SELECT package, concat(base, CASE WHEN k = 2 THEN '' ELSE '.git' END) AS git, concat(web, CASE WHEN dir = '' AND rev = 'HEAD' THEN '' ELSE concat(CASE WHEN k = 2 THEN '/src/' ELSE '/tree/' END, rev, '/', dir) END) AS http, concat(web, CASE WHEN k = 2 THEN '/src' ELSE '/blob' END, below) AS readme_base,
CASE WHEN k = 0 THEN concat('https://raw.githubusercontent.com/', owner, '/', repo, below) ELSE concat(web, '/raw', below) END AS image_base, CASE k WHEN 0 THEN concat(base, '/graphs/contributors') WHEN 2 THEN concat(base, '/commits/all') ELSE concat(web, '/graphs/master') END AS contributors FROM u
UNION ALL SELECT package, NULL, NULL, NULL, NULL, NULL FROM r WHERE host IS NULL""")
def _(v: Views):
    p = v.part.selectExpr("p_partkey AS package", f"{REPOSITORIES} AS url", "CASE WHEN p_partkey % 2 = 0 THEN 'a/b' END AS dir", "CASE WHEN p_partkey % 3 = 0 THEN 'v1' END AS rev")
    urls = p.select("package", clean.repo_urls(clean.parse_repo(F.col("url")), F.col("dir"), F.col("rev")).alias("u"))
    return urls.select("package", "u.git", "u.http", "u.readme_base", "u.image_base", "u.contributors")


@query("b8_normalize_keyword", "SELECT p_partkey AS package, concat(CASE p_size % 5 WHEN 0 THEN 'foo-bar-' WHEN 1 THEN 'http-server' WHEN 2 THEN 'ios-app' WHEN 3 THEN 'x-y-' ELSE 'überkey' END, p_partkey) AS keyword FROM part")
def _(v: Views):
    p = v.part.selectExpr("p_partkey AS package", "concat(CASE p_size % 5 WHEN 0 THEN 'FooBar_' WHEN 1 THEN 'HTTPServer' WHEN 2 THEN 'iOS_app' WHEN 3 THEN '  x..Y ' ELSE 'ÜberKey' END, p_partkey) AS c")
    return p.select("package", clean.normalize_keyword(F.col("c")).alias("keyword"))


@query("b9_clean_keyword", """SELECT p_partkey AS package, CASE p_size % 5 WHEN 0 THEN concat('key', p_partkey) WHEN 2 THEN 'the' WHEN 3 THEN concat('my-k', p_partkey) END AS keyword, CASE p_size % 5 WHEN 0 THEN p_size * 1e0 WHEN 2 THEN p_size / 1e1 WHEN 3 THEN p_size * 1e0 END AS weight FROM part""")
def _(v: Views):
    p = v.part.selectExpr("p_partkey AS package", "CASE p_size % 5 WHEN 0 THEN concat('\"rust-key', p_partkey, '-rs\"') WHEN 1 THEN ' Rust! ' WHEN 2 THEN 'The' WHEN 3 THEN concat('--myK', p_partkey) ELSE '***' END AS c", "CAST(p_size AS DOUBLE) AS weight")
    k = clean.clean_keyword(F.col("c"), F.col("weight"), ["the", "a"])
    return p.select("package", k["keyword"].alias("keyword"), k["weight"].alias("weight"))


@query("b10_namespace_prefix", "SELECT p_partkey AS package, CASE p_size % 4 WHEN 0 THEN concat('foo', p_partkey) WHEN 1 THEN concat('bar', p_partkey) WHEN 2 THEN concat('bc', p_partkey) ELSE 'a-b' END AS namespace FROM part")
def _(v: Views):
    p = v.part.selectExpr("p_partkey AS package", "CASE p_size % 4 WHEN 0 THEN concat('cargo-foo', p_partkey) WHEN 1 THEN concat('rust-libbar', p_partkey, '-sys') WHEN 2 THEN concat('a_bc', p_partkey) ELSE 'a-b' END AS name")
    return p.select("package", clean.namespace_prefix(F.col("name")).alias("namespace"))


@query("b11_unprefix", "SELECT p_partkey AS package, concat(CASE p_size % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'y' WHEN 2 THEN 'z' ELSE 'w' END, p_partkey) AS name FROM part")
def _(v: Views):
    p = v.part.selectExpr("p_partkey AS package", "CASE p_size % 4 WHEN 0 THEN concat('rust_x', p_partkey) WHEN 1 THEN concat('y', p_partkey, '-rs') WHEN 2 THEN concat('rustz', p_partkey) ELSE concat('w', p_partkey) END AS c")
    return p.select("package", clean.unprefix(F.col("c")).alias("name"))


@query("b16_deprecated_requirements", "SELECT name, requirement, bool_or(p = 1 OR (p = 2 AND low <= '000000000000.000000000001.000000000099~' AND high > '000000000000.000000000001.000000000099~')) AS is_deprecated FROM (SELECT concat('p', package % 9) AS name, package % 9 AS p, requirement, low, high FROM intervals) i GROUP BY name, requirement")
def _(v: Views):
    rules = v.spark.createDataFrame([("p1", None), ("p2", sort_key(0, 1, 99))], "name string, bound string")
    return flags.deprecated_requirements(v.intervals.selectExpr("concat('p', package % 9) AS name", "requirement", "low", "high"), rules)


@query("b27_release_train", """WITH r AS (SELECT release, CASE WHEN release % 9 = 0 THEN CAST(created AS DATE) ELSE CAST(created + INTERVAL 20 YEAR AS DATE) END AS day FROM releases), t AS (SELECT release, CAST(floor((floor((day - DATE '2015-05-15') / 7e0) + 1) / 6e0) AS INT) AS train FROM r) SELECT release, CASE WHEN train >= 0 THEN train END AS train FROM t""")
def _(v: Views):
    r = v.releases.select("release", F.when(F.col("release") % 9 == 0, F.to_date("created")).otherwise(F.add_months("created", 240)).alias("day"))
    return r.select("release", clean.release_train(F.col("day")).alias("train"))


@query("b29_mini_date", """WITH r AS (SELECT release, CAST(created AS DATE) AS a, CAST(created AS DATE) + CAST(release % 401 - 200 AS INT) AS b FROM releases), n AS (SELECT *, CAST(year(a) * 365 + dayofyear(a) - 1 AS INT) AS na, CAST(year(b) * 365 + dayofyear(b) - 1 AS INT) AS nb FROM r)
SELECT release, na + 45 AS later, na + CAST(trunc((nb - na) / 2e0) AS INT) AS middle, CAST(least(floor((dayofyear(a) - 1) / 3e1), 11) AS INT) AS pseudo_month FROM n""")
def _(v: Views):
    r = v.releases.select("release", F.to_date("created").alias("a"), F.expr("date_add(CAST(created AS DATE), CAST(release % 401 - 200 AS INT))").alias("b"))
    a, b = days.mini_date(F.col("a")), days.mini_date(F.col("b"))
    return r.select("release", days.days_later(a, F.lit(45)).alias("later"), days.half_way(a, b).alias("middle"), days.pseudo_month(F.col("a")).alias("pseudo_month"))


@query("b37_non_dep_features", "SELECT p_partkey AS package, CASE WHEN p_size % 2 = 0 THEN 'a,b' ELSE 'a' END AS features FROM part")
def _(v: Views):
    p = v.part.selectExpr("p_partkey AS package", "map('default', array('a'), '_hidden', array('a'), 'a', CAST(array() AS ARRAY<STRING>), 'b', array(CASE WHEN p_size % 2 = 0 THEN 'a' ELSE 'dep:x' END)) AS features")
    return p.select("package", F.array_join(clean.non_dep_features(F.col("features")), ",").alias("features"))


@query("j3_flag_packages", """WITH p AS (SELECT p_partkey AS package, p_size % 12 AS k, p_size % 5 = 3 AS is_junk FROM part) SELECT package, k IN (0, 4, 5, 8, 11) OR k IN (1, 2, 6, 9) OR is_junk AS is_deprecated, k IN (1, 2, 6, 9) AS is_placeholder, is_junk, k = 3 AS is_autopublished FROM p""")
def _(v: Views):
    said = ["Deprecated: use other", "This crate is a placeholder for later", "(Reserved.)", "Automatically published bindings", "WIP parser", "-- do not use this --", "...", "A fast parser, unfinished", "unfinished parser", None, None, "A parser"]
    text = "CASE p_size % 12 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(said) if s) + " END AS description"
    p = v.part.selectExpr("p_partkey AS package", text, "CASE WHEN p_size % 12 = 11 THEN '0.0.1' ELSE '1.0.0' END AS version", "CASE WHEN p_size % 12 = 9 THEN 'Reserve the name' ELSE 'A parser' END AS readme", "concat('c', p_size % 5) AS content")
    return flags.flag_packages(p, (hashlib.sha256(b"c3").hexdigest(),))
