"""Bindings of time-series, graph and compatibility operators (W, G, M) to the test tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import compat, graph
from ..operators import timeseries as ts
from .ordered import DIVERSE, item_owners
from .registry import query, rounded
from .views import Views

AS_OF = "2001-08-01"


def day():
    return F.lit(AS_OF).cast("date")

INCIDENTS = [
    {"start": "1997-03-01", "end": "1997-05-31", "headroom": 5, "lookaround": 400, "names": None},
    {"start": "1999-01-01", "end": "1999-12-31", "headroom": 2, "lookaround": 300, "names": list(range(0, 50))},
]


@query("w1_despam", """WITH a AS (SELECT package, version, day, CAST(n AS BIGINT) AS n FROM daily),
b1 AS (SELECT *, max(CASE WHEN day >= DATE '1997-03-01' - 400 AND day < DATE '1997-03-01' THEN n END) OVER w AS bef, max(CASE WHEN day > DATE '1997-05-31' AND day <= DATE '1997-05-31' + 400 THEN n END) OVER w AS aft FROM a WINDOW w AS (PARTITION BY package, version)),
c1 AS (SELECT *, coalesce(aft, CAST(floor(bef * 5 / 4) AS BIGINT)) AS aft2 FROM b1), d1 AS (SELECT *, coalesce(day BETWEEN DATE '1997-03-01' AND DATE '1997-05-31' AND bef IS NOT NULL AND n > 5 + greatest(bef, aft2), false) AS hit FROM c1),
e1 AS (SELECT package, version, day, CASE WHEN hit THEN CAST(floor((bef + aft2) / 2) AS BIGINT) ELSE n END AS n, hit AS override FROM d1),
b2 AS (SELECT *, max(CASE WHEN day >= DATE '1999-01-01' - 300 AND day < DATE '1999-01-01' THEN n END) OVER w AS bef, max(CASE WHEN day > DATE '1999-12-31' AND day <= DATE '1999-12-31' + 300 THEN n END) OVER w AS aft FROM e1 WINDOW w AS (PARTITION BY package, version)),
c2 AS (SELECT *, coalesce(aft, CAST(floor(bef * 5 / 4) AS BIGINT)) AS aft2 FROM b2), d2 AS (SELECT *, coalesce(package < 50 AND day BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' AND bef IS NOT NULL AND n > 2 + greatest(bef, aft2), false) AS hit FROM c2)
SELECT package, version, day, CASE WHEN hit THEN CAST(floor((bef + aft2) / 2) AS BIGINT) ELSE n END AS n, override OR hit AS override FROM d2""")
def _(v: Views):
    return ts.despam(v.daily, INCIDENTS)


@query("w2_total_by_day", "SELECT day, sum(n) AS n FROM daily GROUP BY day")
def _(v: Views):
    return ts.total_by_day(v.daily)


@query("w3_daily_by_package", "SELECT package, day, sum(n) AS n FROM daily GROUP BY ALL")
def _(v: Views):
    return ts.daily_by_package(v.daily)


@query("w4_downloads_last_30", f"""WITH d AS (SELECT *, max(day) OVER (PARTITION BY package) AS last FROM daily WHERE n > 0 AND day <= DATE '{AS_OF}'), s AS (SELECT package, sum(n) AS n FROM d WHERE last >= DATE '{AS_OF}' - 7 AND day > last - 30 GROUP BY package)
SELECT p.package, coalesce(s.n, downloads / 3) AS downloads FROM packages p LEFT JOIN s ON s.package = p.package""")
def _(v: Views):
    return ts.downloads_last_30(v.daily, day(), v.packages.selectExpr("package", "downloads AS recent"))


@query("w5_weekly", "WITH d AS (SELECT *, CAST(floor(date_diff('day', day, max(day) OVER (PARTITION BY package)) / 7) AS INT) AS week FROM daily) SELECT package, week, sum(n) AS n FROM d WHERE week < 52 GROUP BY ALL")
def _(v: Views):
    return ts.weekly(v.daily, 52)


@query("w6_recent_by_version", """WITH d AS (SELECT *, CAST(floor(date_diff('day', day, max(day) OVER (PARTITION BY package)) / 4) + 1 AS INT) * 4 AS span FROM daily), p AS (SELECT package, span, sum(n) AS n FROM d GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY package ORDER BY span) AS total FROM p),
s AS (SELECT package, coalesce(min(span) FILTER (WHERE total > 60 OR span >= 30), 30) AS stop FROM r GROUP BY package)
SELECT d.package, version, round(sum(n) * 30 / max(stop), 6) AS monthly FROM d JOIN s ON s.package = d.package WHERE span <= stop GROUP BY ALL""")
def _(v: Views):
    return rounded(ts.recent_by_version(v.daily, enough=60), "monthly")


@query("w7_weekday_weekend", "WITH t AS (SELECT day, sum(n) AS n FROM daily GROUP BY day), d AS (SELECT *, CAST(floor(date_diff('day', day, (SELECT max(day) FROM t)) / 7) AS INT) AS week FROM t) SELECT week, sum(CASE WHEN isodow(day) < 6 THEN n ELSE 0 END) AS weekdays, sum(CASE WHEN isodow(day) >= 6 THEN n ELSE 0 END) AS weekends FROM d GROUP BY week")
def _(v: Views):
    return ts.weekday_weekend(v.daily)


@query("w8_year_over_year", "WITH d AS (SELECT *, CAST(floor(date_diff('day', day, max(day) OVER (PARTITION BY package)) / 7) AS INT) AS week FROM daily), w AS (SELECT package, week, sum(n) AS n FROM d WHERE week < 104 GROUP BY ALL) SELECT package, round(sum(CASE WHEN week < 52 THEN n ELSE 0 END) / 364, 6) AS this_year, round(sum(CASE WHEN week >= 52 THEN n ELSE 0 END) / 364, 6) AS last_year, max(n) AS peak FROM w GROUP BY package")
def _(v: Views):
    return rounded(ts.year_over_year(v.daily), "this_year", "last_year")


# a year's downloads, denser and higher towards its last day
LATELY = f"""SELECT package, CAST(DATE '{AS_OF}' - CAST(1 + floor(place * place / 90) AS INT) AS DATE) AS day, sum(n * CAST(floor(8000 / (10 + floor(place * place / 90))) AS INT)) AS n FROM (SELECT l_partkey AS package, l_orderkey % 90 AS place, CAST(l_quantity AS INT) AS n FROM {{lineitem}}) l GROUP BY ALL"""
LISTS = f"""lately AS ({LATELY.replace('{lineitem}', 'lineitem')}), ld AS (SELECT package, n, date_diff('day', day, DATE '{AS_OF}') AS age FROM lately WHERE day >= DATE '2001-01-01' AND n > 0),
la AS (SELECT package, coalesce(sum(n) FILTER (WHERE age <= 10), 0) / greatest(count(*) FILTER (WHERE age <= 10), 8) AS tw, coalesce(sum(n) FILTER (WHERE age > 10 AND age <= 20), 0) / greatest(count(*) FILTER (WHERE age > 10 AND age <= 20), 7) AS pw, coalesce(sum(n) FILTER (WHERE age <= 21), 0) / greatest(count(*) FILTER (WHERE age <= 21), 14) AS t4,
 greatest(coalesce(sum(n) FILTER (WHERE age > 21 AND age <= 42), 0) / greatest(count(*) FILTER (WHERE age > 21 AND age <= 42), 7), coalesce(sum(n) FILTER (WHERE age > 42), 0) / greatest(count(*) FILTER (WHERE age > 42), 7)) AS p4 FROM ld GROUP BY package),
lr AS (SELECT package, round((800 + tw) / (900 + pw) * least(sqrt(pw), 10), 6) AS ratio1, round(8e-1 * (700 + t4) / (600 + p4) * least(sqrt(p4), 9), 6) AS ratio4 FROM la WHERE pw >= 70 AND pw < tw AND p4 < least(t4, pw, tw)),
lf AS (SELECT package, 'short' AS list, ratio1 AS ratio FROM lr ORDER BY ratio1 DESC, package LIMIT 20), ll AS (SELECT package, 'long' AS list, ratio4 AS ratio FROM lr WHERE package NOT IN (SELECT package FROM lf) ORDER BY ratio4 DESC, package LIMIT 20),
lists AS (SELECT * FROM lf UNION ALL SELECT * FROM ll)"""


def _lists(v: Views):
    return ts.trending_lists(v.spark.sql(LATELY, lineitem=v.lineitem), dt.date.fromisoformat(AS_OF), 20)


@query("w9_trending", f"WITH {LISTS} SELECT * FROM lists")
def _(v: Views):
    return _lists(v)


@query("w10_active_dependers")
def _(v: Views):
    uses = v.lineitem.join(v.orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr("o_custkey AS package", "o_orderkey AS release", "l_partkey AS dep")
    return ts.active_dependers(v.releases, uses, v.owners.select("package", "owner"), day())


TRACTION = """WITH m AS (SELECT package AS dep, CAST(date_trunc('month', day) AS DATE) AS month, sum(n) AS users, sum(version % 2) AS removed, sum(version % 3) AS expired, count(*) AS crates FROM daily GROUP BY ALL),
a AS (SELECT *, row_number() OVER w - 1 AS age, (users + lag(users) OVER w) / 2 AS pair FROM m WINDOW w AS (PARTITION BY dep ORDER BY month DESC)),
g AS (SELECT dep, coalesce(max(pair), 0) AS peak, coalesce(max(users) FILTER (WHERE age = 0), 0) AS cur, coalesce(max(crates) FILTER (WHERE age = 0), 0) AS crates, coalesce(max(removed) FILTER (WHERE age = 0), 0) AS removed, coalesce(max(expired) FILTER (WHERE age = 0), 0) AS expired,
coalesce(max(users) FILTER (WHERE age = 0), 0) + coalesce(max(users) FILTER (WHERE age = 1), 0) AS now, coalesce(max(users) FILTER (WHERE age = 4), 0) + coalesce(max(users) FILTER (WHERE age = 5), 0) AS past, coalesce(max(users) FILTER (WHERE age = 3), 0) AS quarter FROM a GROUP BY dep)
SELECT dep, round(pow(least(1e0, (cur + 11) / (peak + 10)), 1 + 7e-1 * (1 - (expired + 10) / (removed + expired + 10)) + CASE WHEN quarter - cur > 2 THEN 5e-1 ELSE 0e0 END), 6) AS former_glory, round(CASE WHEN cur > 0 THEN (now + 15) / (past + 15) ELSE least((now + 15) / (past + 15), 1) END, 6) AS growth,
round(least(1e0, greatest(pow((greatest(cur - 2, 0) + 5) * 16e-1 / (greatest(crates - 5, 0) + 5), 11e-1), cur / 400)), 6) AS external_usage, cur AS active_users FROM g"""


@query("w11_traction", TRACTION)
def _(v: Views):
    return _traction(v)


def _traction(v: Views):
    m = v.daily.groupBy(F.col("package").alias("dep"), F.to_date(F.trunc("day", "month")).alias("month")).agg(F.sum("n").alias("users"), F.sum(F.col("version") % 2).alias("removed"), F.sum(F.col("version") % 3).alias("expired"), F.count("*").alias("crates"))
    return rounded(ts.traction(m), "former_glory", "growth", "external_usage")


@query("w9_trending_ranked", f"""WITH {LISTS}, traction AS ({TRACTION}), users_of AS (SELECT package, count(DISTINCT depender) AS n_users FROM uses GROUP BY package),
scored AS (SELECT l.package, ratio * CASE WHEN n_users > 10 THEN 11e-1 ELSE 1e0 END * CASE WHEN n_users > 100 THEN 11e-1 ELSE 1e0 END * (3e-1 + coalesce(p.rank, 0)) * coalesce((100 + least(growth, 2e0) * least(1 + active_users, 50)) * least(growth, 11e-1) * external_usage * former_glory, 1e0) AS score
 FROM lists l LEFT JOIN users_of u ON u.package = l.package LEFT JOIN packages p ON p.package = l.package LEFT JOIN traction t ON t.dep = l.package WHERE l.package NOT IN (SELECT dst FROM edges WHERE src IN (SELECT package FROM lists))),
items AS (SELECT 0 AS list_id, package AS item, round(score, 6) AS score FROM scored WHERE round(score, 6) > 0), {DIVERSE}
SELECT item AS package, new_score AS score, pos FROM (SELECT *, row_number() OVER (ORDER BY new_score DESC, item) AS pos FROM new) x WHERE pos <= 20""")
def _(v: Views):
    direct = v.uses.groupBy("package").agg(F.count_distinct("depender").alias("users"))
    return ts.trending(_lists(v), v.edges.selectExpr("dst AS package", "src AS user"), direct, v.packages.select("package", "rank"), _traction(v), item_owners(v), v.keywords.selectExpr("package AS item", "keyword", "place"), 20)


EDGES = "SELECT src, dst, (src + dst) % 3 AS kind, src % 4 = 0 AS optional FROM edges"


@query("g1_dependency_closure", f"""WITH RECURSIVE e AS ({EDGES}), walk(root, node, kind, is_default, direct) AS (SELECT src, dst, kind, NOT optional, true FROM e UNION
SELECT w.root, e.dst, greatest(w.kind, e.kind), w.is_default AND NOT e.optional, false FROM walk w JOIN e ON e.src = w.node WHERE e.kind < 2 AND w.root <> e.dst)
SELECT root, node, min(kind) AS kind, bool_or(is_default) AS is_default, bool_or(direct) AS direct FROM walk GROUP BY ALL""")
def _(v: Views):
    return graph.dependency_closure(v.edges.selectExpr("src", "dst", "(src + dst) % 3 AS kind", "src % 4 = 0 AS optional"))


@query("g3_reverse_dependency_stats", """WITH c AS (SELECT DISTINCT depender AS root, package AS node, min(kind) AS kind, bool_or(NOT optional) AS is_default, bool_or(kind < 2) AS direct FROM uses GROUP BY depender, package)
SELECT node AS package, count(*) FILTER (WHERE kind = 0 AND is_default) AS runtime_def, count(*) FILTER (WHERE kind = 0 AND NOT is_default) AS runtime_opt, count(*) FILTER (WHERE kind = 1 AND is_default) AS build_def, count(*) FILTER (WHERE kind = 1 AND NOT is_default) AS build_opt, count(*) FILTER (WHERE kind = 2) AS dev, count(*) FILTER (WHERE direct) AS direct, count(*) AS total FROM c GROUP BY node""")
def _(v: Views):
    return graph.reverse_dependency_stats(_closure(v))


def _closure(v: Views):
    return v.uses.groupBy(F.col("depender").alias("root"), F.col("package").alias("node")).agg(F.min("kind").alias("kind"), F.bool_or(~F.col("optional")).alias("is_default"), F.bool_or(F.col("kind") < 2).alias("direct"))


@query("g4_role_from_usage", """WITH s AS (SELECT package, count(*) FILTER (WHERE kind = 0) AS r, count(*) FILTER (WHERE kind = 1) AS b, count(*) FILTER (WHERE kind = 2) AS dev FROM (SELECT depender, package, CASE WHEN package % 3 = 0 THEN 1 ELSE min(kind) END AS kind FROM uses GROUP BY depender, package) c GROUP BY package)
SELECT package, b > 3 * (r + 5) AS is_build, dev > 3 * (r + b + 5) AS is_dev FROM s""")
def _(v: Views):
    c = _closure(v).withColumn("kind", F.when(F.col("node") % 3 == 0, 1).otherwise(F.col("kind")))
    return graph.role_from_usage(graph.reverse_dependency_stats(c))


@query("g5_version_popularity", """WITH u AS (SELECT package, sort_key, release % 37 AS users, is_pre, yanked FROM keyed), b AS (SELECT dep_id, i.package, low, high, users, sort_key, is_pre, yanked, sort_key >= low AND sort_key < high AS inside FROM (SELECT DISTINCT dep_id, package, low, high FROM intervals) i JOIN u ON u.package = i.package),
s AS (SELECT dep_id, package, coalesce(sum(users) FILTER (WHERE inside), 0) + 1 AS hit, coalesce(max(users) FILTER (WHERE inside), 0) + 1 AS hit_max, coalesce(sum(users) FILTER (WHERE NOT inside), 0) AS miss, coalesce(max(users) FILTER (WHERE NOT inside), 0) AS miss_max, max_by(inside, (NOT yanked AND NOT is_pre, sort_key)) OR max_by(inside, (NOT yanked, sort_key)) AS latest FROM b GROUP BY dep_id, package, low, high)
SELECT dep_id, package, round(CASE WHEN package % 13 = 0 OR hit + miss = 1 THEN 0e0 ELSE (hit / (hit + miss) + hit_max / (hit_max + miss_max)) / 2 END, 6) AS popularity, latest AND package % 13 <> 0 AS matches_latest FROM s""")
def _(v: Views):
    users = v.keyed.selectExpr("package", "sort_key", "release % 37 AS users", "is_pre", "yanked")
    out = graph.version_popularity(v.intervals.select("dep_id", "package", "low", "high").distinct(), users, v.packages.where("package % 13 = 0").select("package"))
    return rounded(out, "popularity")


@query("g6_global_popularity", "SELECT package, version AS release, round(count(*) / (SELECT count(*) FROM part), 9) AS popularity FROM daily GROUP BY package, version")
def _(v: Views):
    usage = v.daily.groupBy("package", F.col("version").alias("release")).agg(F.count("*").alias("n_dependents"))
    return rounded(graph.global_popularity(usage, v.part.count()), "popularity", places=9)


def _ranks(rounds: int) -> str:
    steps = ["WITH e AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS n FROM edges)", "s0 AS (SELECT p_partkey AS node, p_size / (SELECT sum(p_size) FROM part) AS share, p_size / (SELECT sum(p_size) FROM part) AS score FROM part)"]
    for i in range(rounds):
        steps.append(f"s{i + 1} AS (SELECT a.node, share, 15e-2 * score + coalesce(got, 0) + coalesce((SELECT sum(85e-2 * score) FROM s{i} WHERE node NOT IN (SELECT src FROM e)), 0) * share AS score FROM s{i} a LEFT JOIN (SELECT dst, sum(85e-2 * score / n) AS got FROM s{i} JOIN e ON src = node GROUP BY dst) g ON g.dst = a.node)")
    return ", ".join(steps) + f" SELECT node, round(score, 9) AS score FROM s{rounds}"


@query("g7_pagerank", _ranks(10))
def _(v: Views):
    return rounded(graph.pagerank(v.edges, v.part.selectExpr("p_partkey AS node", "CAST(p_size AS DOUBLE) AS score")), "score", places=9)


@query("g8_initial_importance", """WITH o AS (SELECT package, count(DISTINCT owner) AS n FROM owners GROUP BY package), r AS (SELECT package, count(*) AS n_releases, date_diff('day', CAST(min(created) AS DATE), DATE '2001-12-01') AS age FROM releases GROUP BY package)
SELECT p.package, round(log2(3 * downloads + 1) + CASE WHEN n <= 1 THEN 1e-1 WHEN n <= 5 THEN n * 2e-1 ELSE greatest(0e0, 1 - 5e-2 * (n - 5)) END + log2(1 + age / 365) + sqrt(n_releases), 6) AS importance FROM packages p JOIN o ON o.package = p.package JOIN r ON r.package = p.package""")
def _(v: Views):
    o = v.owners.groupBy("package").agg(F.count_distinct("owner").alias("n_owners"))
    r = v.releases.groupBy("package").agg(F.count("*").alias("n_releases"), F.datediff(F.lit("2001-12-01").cast("date"), F.min("created")).alias("age_days"))
    return rounded(graph.initial_importance(v.packages.join(o, "package").join(r, "package")), "importance")


@query("g9_author_trust", """WITH c0 AS (SELECT l_partkey AS package, l_suppkey AS author, sum(l_quantity) AS amount, min(l_linenumber) = 1 AS own FROM lineitem GROUP BY ALL), c1 AS (SELECT *, amount / sum(amount) OVER (PARTITION BY package) * CASE WHEN own THEN 1e0 ELSE 5e-2 END + CASE WHEN own THEN 2e-1 ELSE 0e0 END AS q FROM c0), c AS (SELECT package, author, own, q / sum(q) OVER (PARTITION BY package) AS q FROM c1),
d0 AS (SELECT author, sum(rank * q) AS direct FROM c JOIN packages p ON p.package = c.package GROUP BY author), d AS (SELECT author, direct + CASE WHEN direct > 4 AND author % 5 = 0 THEN 1e0 ELSE 0e0 END AS direct FROM d0),
t AS (SELECT package, sum(direct * q) AS trust FROM c JOIN d ON d.author = c.author WHERE own GROUP BY package), x AS (SELECT author, sum(trust * q) AS passed FROM c JOIN t ON t.package = c.package GROUP BY author)
SELECT d.author, round(direct + coalesce(passed, 0), 4) AS trust FROM d LEFT JOIN x ON x.author = d.author""")
def _(v: Views):
    c = v.lineitem.groupBy(F.col("l_partkey").alias("package"), F.col("l_suppkey").alias("author")).agg(F.sum("l_quantity").alias("amount"), (F.min("l_linenumber") == 1).alias("is_owner"))
    bonus = v.supplier.where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("author"), F.lit(1.0).alias("bonus"))
    return rounded(graph.author_trust(v.packages.selectExpr("package", "rank AS importance"), c, bonus), "trust", places=4)


@query("g10_niche_dep_keywords", "WITH s AS (SELECT package AS dep, count(DISTINCT depender) AS direct FROM uses GROUP BY package) SELECT DISTINCT depender AS package, 'dep:' || CAST(package AS VARCHAR) AS keyword, round(1e0 / (1 + direct), 9) AS weight FROM uses JOIN s ON s.dep = package WHERE direct BETWEEN 3 AND 40")
def _(v: Views):
    stats = v.uses.groupBy("package").agg(F.count_distinct("depender").alias("direct"))
    return rounded(graph.niche_dep_keywords(v.uses.selectExpr("depender AS package", "package AS dep").distinct(), stats, most=40), "weight", places=9)


BEST = "SELECT package, release, compiler, CASE WHEN bool_or(verdict = 'Y') THEN 'Y' WHEN bool_or(verdict = 'y') THEN 'y' ELSE 'X' END AS verdict FROM builds GROUP BY package, release, compiler"
NORMAL = f"""WITH b AS ({BEST}), m AS (SELECT *, bool_or(verdict = 'Y') OVER (PARTITION BY package) AS built, max(CASE WHEN verdict = 'X' THEN compiler END) OVER (PARTITION BY package, release) AS worst FROM b),
k AS (SELECT * FROM m WHERE verdict = 'X' OR worst IS NULL OR compiler > worst), l AS (SELECT *, min(CASE WHEN verdict <> 'X' THEN compiler END) OVER (PARTITION BY package, release) AS least FROM k),
norm AS (SELECT package, release, compiler, verdict FROM l WHERE (verdict <> 'X' OR least IS NULL OR compiler < least) AND (built OR verdict = 'X'))"""


@query("m1_compat_matrix", BEST)
def _(v: Views):
    return compat.matrix(v.builds)


@query("m2_compat_normalise", f"{NORMAL} SELECT * FROM norm")
def _(v: Views):
    return compat.normalise(compat.matrix(v.builds))


@query("m3_compat_fill")
def _(v: Views):
    return compat.fill(compat.normalise(compat.matrix(v.builds)))


RANGES = f"""{NORMAL}, per AS (SELECT package, release, min(compiler) FILTER (WHERE verdict <> 'X') AS ok, max(compiler) FILTER (WHERE verdict = 'X') AS bad FROM norm GROUP BY package, release),
ranged AS (SELECT package, compiler, max(release) FILTER (WHERE compiler >= ok) AS newest_ok, min(release) FILTER (WHERE compiler <= bad) AS oldest_bad, max(release) FILTER (WHERE compiler <= bad) AS newest_bad FROM per, (VALUES (10), (20), (30), (40), (50)) c(compiler) GROUP BY ALL)"""


@query("m4_compat_ranges", f"{RANGES} SELECT * FROM ranged")
def _(v: Views):
    return compat.ranges(compat.normalise(compat.matrix(v.builds)), [10, 20, 30, 40, 50])


@query("m5_compat_assume_release_date", """WITH m AS (SELECT package, release % 100 AS release, CAST(release % 40 AS INT) AS compiler, 'X' AS verdict FROM releases), r AS (SELECT package, release % 100 AS release, created + INTERVAL 18 YEAR AS created FROM releases),
n AS (SELECT package, release, CAST(floor((floor(date_diff('day', DATE '2015-05-15', CAST(created AS DATE)) / 7) + 1) / 6) AS INT) AS compiler FROM r WHERE created >= DATE '2015-05-15')
SELECT * FROM m UNION ALL SELECT package, release, compiler, 'y' FROM n WHERE (package, release, compiler) NOT IN (SELECT package, release, compiler FROM m)""")
def _(v: Views):
    m = v.releases.selectExpr("package", "release % 100 AS release", "CAST(release % 40 AS INT) AS compiler", "'X' AS verdict")
    return compat.assume_release_date(m, v.releases.selectExpr("package", "release % 100 AS release", "created + INTERVAL 18 YEAR AS created"))


@query("m6_compat_propagate", """WITH RECURSIVE d AS (SELECT src AS release, dst AS dep FROM edges), walk(release, bad) AS (SELECT p_partkey, p_size FROM part UNION SELECT d.release, w.bad FROM walk w JOIN d ON d.dep = w.release WHERE w.bad >= 25)
SELECT release, max(bad) AS newest_bad FROM walk GROUP BY release""")
def _(v: Views):
    deps = v.edges.selectExpr("src AS release", "dst AS dep_id", "dst AS dep_release")
    return compat.propagate(v.part.selectExpr("p_partkey AS release", "p_size AS newest_bad"), deps)


@query("m7_compat_export", f"{RANGES}, up AS (SELECT package, compiler, max(newest_ok) OVER (PARTITION BY package ORDER BY compiler) AS best FROM ranged WHERE newest_ok IS NOT NULL) SELECT package, string_agg('1.' || compiler || '<=' || best, ' ' ORDER BY compiler) AS line FROM up GROUP BY package")
def _(v: Views):
    return compat.export(compat.ranges(compat.normalise(compat.matrix(v.builds)), [10, 20, 30, 40, 50]))


@query("m8_next_build_candidates", f"""{NORMAL}, per AS (SELECT package, release, coalesce(max(compiler) FILTER (WHERE verdict = 'X'), 0) AS low, coalesce(min(compiler) FILTER (WHERE verdict <> 'X'), 60) AS high FROM norm GROUP BY package, release),
c AS (SELECT per.package, release, CAST(floor((low + high) / 2) AS BIGINT) AS compiler, (high - low) * (p.rank + 1e-1) AS priority FROM per JOIN packages p ON p.package = per.package WHERE high - low > 1)
SELECT package, release, compiler, round(priority, 6) AS priority, pos FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY priority DESC, release DESC) AS pos FROM c) r WHERE pos <= 3""")
def _(v: Views):
    m = compat.normalise(compat.matrix(v.builds))
    bad = F.col("verdict") == "X"
    limits = m.groupBy("package", "release").agg(F.max(F.when(bad, F.col("compiler"))).alias("newest_bad"), F.min(F.when(~bad, F.col("compiler"))).alias("oldest_ok"))
    return rounded(compat.next_build_candidates(limits, v.packages), "priority")
