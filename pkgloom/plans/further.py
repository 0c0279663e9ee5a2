"""Bindings of sources, people and the remaining cleaning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import clean, people
from ..sources import dump
from .registry import query, rounded
from .views import Views


@query("a2_parse_dump_ts", "SELECT event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS at FROM events")
def _(v: Views):
    e = v.events.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("text"))
    return e.select("event_id", dump.parse_dump_ts(F.col("text")).cast("timestamp_ntz").alias("at"))


@query("a5_flatten_taxonomy", "SELECT r_name AS slug, NULL AS parent_slug, 0 AS depth, (SELECT count(*) FROM region) - 1 AS n_siblings FROM region UNION ALL SELECT r_name || '::' || n_name, r_name, 1, count(*) OVER (PARTITION BY r_name) - 1 FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(v: Views):
    roots = v.region.selectExpr("concat('r', r_regionkey) AS id", "CAST(NULL AS STRING) AS parent", "r_name AS name")
    return dump.flatten_taxonomy(roots.unionByName(v.nation.selectExpr("concat('n', n_nationkey) AS id", "concat('r', n_regionkey) AS parent", "n_name AS name")), 3)


@query("a6_explode_api_metadata", "SELECT package, version AS num, CAST(release % 9 AS VARCHAR) AS login FROM releases")
def _(v: Views):
    action = F.struct(F.lit("publish").alias("action"), (F.col("release") % 9).cast("string").alias("login"), F.lit("x").alias("time"))
    r = v.releases.select("package", F.to_json(F.struct(F.array(F.struct(F.col("version").alias("num"), "yanked", F.array(action).alias("audit_actions"))).alias("versions"))).alias("json"))
    return dump.explode_api_metadata(r)["actions"].select("package", "num", "login")


@query("event_payload", "SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(v: Views):
    return dump.event_payload(v.events)


@query("b38_freshness_class", "SELECT package, CASE WHEN package % 17 = 0 THEN 'obsolete' WHEN package % 2 = 0 AND rank * 10 < 33e-2 THEN 'verynew' WHEN rank * 10 >= 75e-2 THEN 'common' WHEN rank * 10 >= 33e-2 THEN 'outdated' ELSE 'obsolete' END AS freshness FROM packages")
def _(v: Views):
    return v.packages.select("package", clean.freshness_class(F.col("rank") * 10, F.col("package") % 2 == 0, F.lit(False), F.col("package") % 17 == 0).alias("freshness"))


@query("j1_clean_packages", """WITH p AS (SELECT p_partkey AS package, replace(p_name, ' ', CASE WHEN p_size % 5 = 0 THEN ' ' ELSE '-' END) AS name, concat('https://github.com/', lower(p_type), '/r', p_partkey) AS repository, CASE WHEN p_size % 3 = 0 THEN concat('http://GitHub.com/', lower(p_type), '/r', p_partkey, '/') ELSE concat('https://www.site', p_size, '.org/x') END AS homepage FROM part)
SELECT package, 'registry:' || name AS origin, NOT contains(name, ' ') AS is_valid, 'github.com' AS repo_host, CASE WHEN contains(homepage, 'GitHub') THEN NULL ELSE homepage END AS homepage, CASE WHEN contains(homepage, 'GitHub') THEN NULL ELSE regexp_extract(homepage, 'www[.]([^/]+)', 1) END AS domain FROM p""")
def _(v: Views):
    p = v.part.selectExpr("p_partkey AS package", "replace(p_name, ' ', CASE WHEN p_size % 5 = 0 THEN ' ' ELSE '-' END) AS name", "concat('https://github.com/', lower(p_type), '/r', p_partkey) AS repository", "CASE WHEN p_size % 3 = 0 THEN concat('http://GitHub.com/', lower(p_type), '/r', p_partkey, '/') ELSE concat('https://www.site', p_size, '.org/x') END AS homepage", "CAST(NULL AS STRING) AS documentation")
    return clean.clean_packages(p).select("package", "origin", "is_valid", "repo_host", "homepage", "domain")


@query("b33_fix_category_slugs", "SELECT n_nationkey AS package, replace(lower(r_name) || '::' || lower(n_name) || ',' || lower(r_name), ' ', '-') AS slugs FROM nation JOIN region ON r_regionkey = n_regionkey")
def _(v: Views):
    n = v.nation.join(v.region, F.col("n_regionkey") == F.col("r_regionkey"))
    tree = v.region.select(F.lower("r_name").alias("slug"), F.lit(0).alias("depth")).unionByName(n.select(F.concat_ws("::", F.lower("r_name"), F.lower("n_name")).alias("slug"), F.lit(1).alias("depth")))
    tree = tree.withColumn("slug", F.regexp_replace("slug", r"\s+", "-"))
    p = n.select(F.col("n_nationkey").alias("package"), F.array(F.col("r_name"), F.concat_ws(":", "r_name", "n_name"), F.lit("unknown")).alias("categories"))
    return clean.fix_category_slugs(p, tree).select("package", F.array_join("slugs", ",").alias("slugs"))


@query("c4_merge_people", """WITH a AS (SELECT DISTINCT l_partkey AS package, l_suppkey AS person FROM lineitem WHERE l_linenumber = 1), o AS (SELECT package, owner AS person FROM owners WHERE kind = 0), c AS (SELECT l_partkey AS package, l_suppkey AS person, sum(l_quantity) AS contribution FROM lineitem WHERE l_linenumber > 2 GROUP BY ALL),
u AS (SELECT package, person FROM a UNION SELECT package, person FROM o UNION SELECT package, person FROM c), r AS (SELECT u.package, u.person, a.person IS NOT NULL AS is_author, o.person IS NOT NULL AS is_owner, coalesce(contribution, 0) AS contribution FROM u LEFT JOIN a ON a.package = u.package AND a.person = u.person LEFT JOIN o ON o.package = u.package AND o.person = u.person LEFT JOIN c ON c.package = u.package AND c.person = u.person),
q AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY contribution + CASE WHEN is_owner THEN 100 ELSE 0 END + CASE WHEN is_author THEN 50 ELSE 0 END DESC, person) AS pos, greatest(count(*) OVER (PARTITION BY package) - 15, 0) AS n_passive FROM r) SELECT * FROM q WHERE pos <= 15""")
def _(v: Views):
    li = v.lineitem.select(F.col("l_partkey").alias("package"), F.col("l_suppkey").alias("person"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("contribution"))
    return people.merge_people(li.where("line = 1"), v.owners.where("kind = 0").select("package", F.col("owner").alias("person")), li.where("line > 2"))


@query("c5_owners_from_audit", """WITH o AS (SELECT package, owner AS person, invited_at FROM owners WHERE kind = 1), x AS (SELECT l_partkey AS package, l_suppkey AS person, CAST(l_shipdate AS DATE) AS seen FROM lineitem WHERE l_linenumber < 3), l AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY seen DESC, person) = 1 AS is_last FROM x), g AS (SELECT package, person, max(seen) AS last_seen, bool_or(is_last) AS is_last FROM l GROUP BY ALL)
SELECT coalesce(o.package, g.package) AS package, coalesce(o.person, g.person) AS person, o.person IS NOT NULL OR coalesce(is_last, false) AS is_owner, greatest(invited_at, last_seen) AS last_seen FROM o FULL JOIN g ON o.package = g.package AND o.person = g.person""")
def _(v: Views):
    actions = v.lineitem.where("l_linenumber < 3").select(F.col("l_partkey").alias("package"), F.col("l_suppkey").alias("person"), F.col("l_shipdate").cast("date").alias("at"))
    return people.owners_from_audit(v.owners.where("kind = 1").select("package", F.col("owner").alias("person"), "invited_at"), actions)


@query("c17_namespace_related", """WITH fine AS (SELECT DISTINCT package, owner FROM owners WHERE owner NOT IN (SELECT owner FROM excluded)), pairs AS (SELECT package AS a, package + 1 AS b, rank AS commonality FROM packages), c AS (SELECT a, b, count(r.owner) / count(*) AS share FROM pairs JOIN fine l ON l.package = a LEFT JOIN fine r ON r.package = b AND r.owner = l.owner GROUP BY a, b)
SELECT p.a, p.b, round(greatest(commonality / 3 * coalesce(share, 0), CASE WHEN coalesce(x.category = y.category, false) THEN 1e-1 * commonality ELSE 0e0 END), 9) AS relation FROM pairs p LEFT JOIN c ON c.a = p.a AND c.b = p.b LEFT JOIN packages x ON x.package = p.a LEFT JOIN packages y ON y.package = p.b""")
def _(v: Views):
    pairs = v.packages.selectExpr("package AS a", "package + 1 AS b", "rank AS commonality")
    return rounded(people.namespace_related(pairs, v.owners, v.excluded, v.packages.selectExpr("package", "category AS repo_owner")), "relation", places=9)


def _projects(v: Views):
    p = v.packages.selectExpr("package", "concat('r', package % 997, '-', category) AS repo", "name AS prefix")
    return people.same_project_candidates(p, v.owners.where("kind = 0"))


PROJECTS = """p AS (SELECT package, concat('r', package % 997, '-', category) AS repo, name AS prefix FROM packages), o AS (SELECT DISTINCT o.package, owner, prefix FROM owners o JOIN p ON p.package = o.package WHERE kind = 0),
u AS (SELECT a.package, b.package AS other, 1e0 AS weight FROM p a JOIN p b ON a.repo = b.repo WHERE a.package <> b.package UNION ALL SELECT DISTINCT a.package, b.package, 5e-1 FROM o a JOIN o b ON a.owner = b.owner AND a.prefix = b.prefix WHERE a.package <> b.package),
s AS (SELECT package, other, sum(weight) AS weight FROM u GROUP BY ALL), proj AS (SELECT package, other, weight, row_number() OVER (PARTITION BY package ORDER BY weight DESC, other) AS pos FROM (SELECT *, max(weight) OVER (PARTITION BY package) AS best FROM s) b WHERE weight >= least(2e-1, best / 3))"""


@query("c18_same_project_candidates", f"WITH {PROJECTS} SELECT * FROM proj WHERE pos <= 20")
def _(v: Views):
    return _projects(v)


@query("c19_related_merged", f"""WITH {PROJECTS}, a AS (SELECT package, other, weight, 0 AS list FROM proj WHERE pos <= 20 UNION ALL SELECT DISTINCT package, package + 1, 4e-1, 1 FROM packages UNION ALL SELECT DISTINCT package, package * 2, 35e-2, 2 FROM packages),
m AS (SELECT package, other, min(list) AS list, max_by(weight, (-list, weight)) AS weight FROM a GROUP BY ALL), b AS (SELECT *, max(weight) OVER (PARTITION BY package) AS best FROM m)
SELECT package, other, weight, pos FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY weight DESC, list, other) AS pos FROM b WHERE weight >= least(3e-1, best / 2)) r WHERE pos <= 10""")
def _(v: Views):
    p = v.packages
    return people.related_merged(_projects(v), p.selectExpr("package", "package + 1 AS other", "4e-1 AS weight"), p.selectExpr("package", "package * 2 AS other", "35e-2 AS weight"))


@query("d9_dependency_changes", """WITH h AS (SELECT DISTINCT concat('r', l_suppkey % 50, '-', l_orderkey % 7) AS repo, date_trunc('quarter', l_shipdate) AS committed, CAST(l_partkey % 60 AS VARCHAR) AS package FROM lineitem WHERE (l_partkey % 60) * 53 < date_diff('day', DATE '1992-01-01', l_shipdate) + 700 AND (l_partkey % 60 > 30 OR date_diff('day', DATE '1992-01-01', l_shipdate) < 60 * (l_partkey % 60) + 900)),
g AS (SELECT repo, committed, row_number() OVER (PARTITION BY repo ORDER BY committed DESC) - 1 AS age FROM (SELECT DISTINCT repo, committed FROM h) x), o AS (SELECT repo, max(age) AS oldest FROM g GROUP BY repo),
p AS (SELECT h.repo, package, age FROM h JOIN g ON g.repo = h.repo AND g.committed = h.committed),
r AS (SELECT repo, package, min(age) AS newest FROM p GROUP BY ALL),
e AS (SELECT r.repo, package, newest, (SELECT min(g.age) FROM g WHERE g.repo = r.repo AND g.age > r.newest AND NOT EXISTS (SELECT 1 FROM p WHERE p.repo = g.repo AND p.package = r.package AND p.age = g.age)) AS absent FROM r),
a AS (SELECT repo, absent AS age, list_sort(list(package)) AS added FROM e WHERE absent IS NOT NULL GROUP BY repo, absent), d AS (SELECT repo, newest AS age, package FROM e WHERE newest > 0),
w AS (SELECT d.package, unnest(added) AS replacement, 8 / (7 + len(added)) AS weight FROM d JOIN a ON a.repo = d.repo AND a.age = d.age
UNION ALL SELECT d.package, NULL, CASE WHEN added IS NULL THEN 95e-2 ELSE 8 / (7 + len(added)) END FROM d LEFT JOIN a ON a.repo = d.repo AND a.age = d.age
UNION ALL SELECT * FROM (SELECT x.package, unnest(added[:5]) AS replacement, weight FROM (SELECT unnest(added[:8]) AS package, added, 1 / (len(added) * len(added)) * 30 / (30 + age) AS weight FROM a WHERE len(added) > 1 AND NOT EXISTS (SELECT 1 FROM d WHERE d.repo = a.repo AND d.age = a.age)) x WHERE weight > 2e-3) y WHERE package <> replacement)
SELECT package, replacement, round(sum(weight), 6) AS weight FROM w GROUP BY ALL""")
def _(v: Views):
    days = "datediff(l_shipdate, DATE '1992-01-01')"
    some = v.lineitem.where(f"(l_partkey % 60) * 53 < {days} + 700 AND (l_partkey % 60 > 30 OR {days} < 60 * (l_partkey % 60) + 900)")
    h = some.groupBy(F.concat(F.lit("r"), F.col("l_suppkey") % 50, F.lit("-"), F.col("l_orderkey") % 7).alias("repo"), F.date_trunc("quarter", F.col("l_shipdate")).alias("committed")).agg(F.collect_set((F.col("l_partkey") % 60).cast("string")).alias("deps"))
    c = agg.dependency_changes(h)
    return rounded(c.groupBy("package", "replacement").agg(F.sum("weight").alias("weight")), "weight")


@query("d14_rev_dep_histogram", "WITH s AS (SELECT package, count(DISTINCT depender) AS total, count(*) FILTER (WHERE kind < 2) AS direct FROM uses GROUP BY package), r AS (SELECT *, row_number() OVER (PARTITION BY total ORDER BY direct DESC, package) AS i FROM s) SELECT total, count(*) AS n, string_agg(CAST(package AS VARCHAR), ',' ORDER BY i) FILTER (WHERE i <= 8) AS examples FROM r GROUP BY total")
def _(v: Views):
    s = v.uses.groupBy("package").agg(F.count_distinct("depender").alias("total"), F.count_if(F.col("kind") < 2).alias("direct"))
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("total").orderBy(F.desc("direct"), "package"))
    few = s.withColumn("i", place).where("i <= 8").groupBy("total").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "package"))), lambda x: x["package"].cast("string")), ",").alias("examples"))
    return s.groupBy("total").agg(F.count("*").alias("n")).join(few, "total")


@query("d17_name_capitalisation", r"""WITH s AS (SELECT source AS package, unnest(regexp_split_to_array(text, '[.!?\n]+\s*')) AS t FROM documents), w AS (SELECT package, unnest(a) AS word, generate_subscripts(a, 1) AS place FROM (SELECT package, regexp_split_to_array(t, '[^\p{L}\p{N}_-]+') AS a FROM s) x),
v AS (SELECT package, word, sum(CASE WHEN place = 1 THEN 5e-1 ELSE 1e0 END) AS votes FROM w WHERE lower(word) = 'the' GROUP BY package, word) SELECT package, word AS spelling, votes FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY votes DESC, word DESC) AS i FROM v) r WHERE i = 1""")
def _(v: Views):
    s = v.documents.select(F.col("source").alias("package"), F.explode(F.split("text", r"[.!?\n]+\s*")).alias("text")).withColumn("name", F.lit("the"))
    return agg.name_capitalisation(s)


@query("d25_top_result_keywords", """WITH r AS (SELECT query_id, doc_id, keyword, score FROM results JOIN (SELECT DISTINCT package, keyword FROM keywords) k ON k.package = doc_id), t AS (SELECT query_id, count(DISTINCT doc_id) AS nr FROM r GROUP BY query_id), s AS (SELECT r.query_id, keyword, round(sum(score), 6) AS score FROM r JOIN t ON t.query_id = r.query_id GROUP BY r.query_id, keyword, nr HAVING count(*) > 1 AND count(*) < nr * 5e-1)
SELECT query_id, keyword, round(score, 2) AS score FROM (SELECT *, sum(length(keyword) + 1) OVER (PARTITION BY query_id ORDER BY score DESC, keyword) AS letters FROM s) x WHERE letters <= 75""")
def _(v: Views):
    r = v.results.join(v.keywords.selectExpr("package AS doc_id", "keyword").distinct(), "doc_id")
    return rounded(agg.top_result_keywords(r), "score", places=2)


@query("g2_enabled_dependencies", """WITH dd AS (SELECT DISTINCT l_orderkey AS release, 'Dep' || CAST(l_partkey % 20 AS VARCHAR) AS dep, l_partkey % 20 < 12 AS optional FROM lineitem), wanted AS (SELECT o_orderkey AS release, o_orderkey % 4 AS f FROM orders)
SELECT release, dep FROM dd WHERE NOT optional UNION SELECT d.release, d.dep FROM dd d JOIN wanted w ON w.release = d.release WHERE optional AND (d.dep = 'Dep' || CAST(w.f AS VARCHAR) OR d.dep = 'Dep' || CAST(w.f + 4 AS VARCHAR))""")
def _(v: Views):
    from ..operators import graph

    deps = v.lineitem.selectExpr("l_orderkey AS release", "concat('Dep', l_partkey % 20) AS dep", "l_partkey % 20 < 12 AS optional")
    # Feature f<n> enables a dependency and feature g<n>, which enables another one.
    f = v.orders.selectExpr("o_orderkey AS release", "o_orderkey % 4 AS f")
    features = f.selectExpr("release", "stack(3, concat('f', f), concat('dep', f), concat('f', f), concat('g', f), concat('g', f), concat('dep', f + 4)) AS (feature, enables)")
    wanted = f.selectExpr("release", "concat('f', f) AS feature")
    return graph.enabled_dependencies(v.orders.selectExpr("o_orderkey AS release"), features, deps, wanted).select("release", "dep").distinct()


@query("b28_min_compiler", "SELECT p_partkey AS package, greatest(CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 31 WHEN 2 THEN 56 ELSE 85 END, CASE p_size % 3 WHEN 1 THEN 51 WHEN 2 THEN 84 ELSE 1 END, CASE WHEN p_size % 5 = 0 THEN 60 ELSE 1 END, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 1 END) AS min_compiler FROM part")
def _(v: Views):
    p = v.part.selectExpr("p_partkey AS package", "CASE p_size % 4 WHEN 0 THEN 2015 WHEN 1 THEN 2018 WHEN 2 THEN 2021 ELSE 2024 END AS edition", "CASE p_size % 3 WHEN 1 THEN '2' WHEN 2 THEN '3' END AS resolver", "map('std', array(CASE WHEN p_size % 5 = 0 THEN 'dep:x' ELSE 'y' END)) AS features", "CASE WHEN p_size % 2 = 0 THEN concat('1.', p_size) END AS declared")
    return p.select("package", clean.min_compiler(F.col("edition"), F.col("resolver"), F.col("features"), F.col("declared")).alias("min_compiler"))


@query("b34_override_categories", "SELECT package, CASE WHEN slug = 'SMALL' AND package % 3 = 0 THEN 'tiny' WHEN slug = 'ECONOMY' AND package % 2 = 0 THEN 'budget' ELSE slug END AS slug FROM categories")
def _(v: Views):
    c = v.categories.selectExpr("package", "slug", "array(concat('k', package % 3), concat('m', package % 2)) AS keywords")
    return clean.override_categories(c, [("ECONOMY", "budget", ["m0"]), ("SMALL", "tiny", ["k0"])])


@query("b39_package_kinds", "SELECT p_partkey AS package, p_size % 2 = 0 AS has_bin, p_size % 3 > 0 AS has_lib, p_size % 2 = 0 AND (p_size % 3 = 0 OR p_size % 5 = 0) AS is_app, p_size % 7 = 0 AS is_sys, p_size % 11 = 0 AS is_proc_macro, p_size % 13 = 0 AS is_no_std FROM part")
def _(v: Views):
    p = v.part.selectExpr("p_partkey AS package", "p_name AS name", "p_size % 2 = 0 AS has_bin", "p_size % 3 > 0 AS has_lib", "CASE WHEN p_size % 7 = 0 THEN 'z' END AS links", "p_size % 11 = 0 AS proc_macro", "array(CASE WHEN p_size % 5 = 0 THEN 'command-line-utilities' ELSE 'x' END, CASE WHEN p_size % 13 = 0 THEN 'no-std' ELSE 'y' END) AS categories", "'' AS readme")
    return clean.package_kinds(p)


@query("b40_log_to_verdict", """WITH e AS (SELECT user_id % 40 AS p, CAST(floor(value) AS INT) % 5 AS ver, event_type AS compiler, event_id % 4 AS k FROM events), g AS (SELECT p, ver, compiler, max(CASE WHEN k = 0 THEN 2 WHEN k = 1 THEN 1 ELSE 0 END) AS r, count(*) FILTER (WHERE k < 2) AS n, bool_or(k = 2) AS ok FROM e GROUP BY ALL)
SELECT 'p' || p AS package, '1.0.' || ver AS version, compiler, CASE WHEN r = 2 THEN 'X' WHEN r = 1 THEN 'n' WHEN n > 0 THEN 'N' WHEN ok THEN 'Y' ELSE 'N' END AS verdict FROM g""")
def _(v: Views):
    text = "CASE event_id % 4 WHEN 0 THEN 'cannot find macro x' WHEN 1 THEN 'failed to select a version for y' ELSE 'unused import' END"
    m = v.events.selectExpr("event_type AS compiler", "CAST(CAST(floor(value) AS INT) % 5 AS STRING) AS ver", "user_id % 40 AS p", "event_id % 4 AS k", f"{text} AS t")
    line = F.to_json(F.struct(F.lit("compiler-message").alias("reason"), F.concat(F.lit("p"), F.col("p").cast("string"), F.lit(" 1.0."), F.col("ver")).alias("package_id"), (F.col("k") == 2).alias("success"), F.struct(F.when(F.col("k") < 2, "error").otherwise("warning").alias("level"), F.col("t").alias("message")).alias("message")))
    rules = v.spark.createDataFrame([("cannot find", "X", 2), ("failed to select", "n", 1)], "prefix string, verdict string, rank int")
    return clean.log_to_verdict(m.select("compiler", line.alias("line")), rules)


@query("j6_code_stats", "SELECT source AS package, 'Python' AS language, count(*) FILTER (WHERE NOT starts_with(l, '#')) AS code, count(*) FILTER (WHERE starts_with(l, '#')) AS comments FROM (SELECT source, trim(unnest(string_split(text, chr(10)))) AS l FROM documents WHERE doc_id % 3 > 0) x WHERE l <> '' GROUP BY source")
def _(v: Views):
    return clean.code_stats(v.documents.selectExpr("source AS package", "concat(CASE WHEN doc_id % 3 = 0 THEN 'tests/' ELSE 'src/' END, doc_id, '.py') AS path", "text AS content"))


@query("t13_normalise_query", "SELECT event_id, CASE event_type WHEN 'error' THEN 'failure' ELSE event_type END || ' x-y' AS q FROM events")
def _(v: Views):
    from ..operators import text

    q = v.events.selectExpr("event_id AS query_id", "concat(upper(event_type), ' X_Y') AS text")
    synonyms = v.spark.createDataFrame([("error", "failure", 1.0)], "find string, replace string, relevance double")
    return text.normalise_query(q, synonyms).select(F.col("query_id").alias("event_id"), F.col("text").alias("q"))
