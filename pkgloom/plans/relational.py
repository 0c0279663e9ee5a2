"""Bindings of ingest, join and aggregate operators (A, C, D, J2) to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import semver
from ..operators import aggregates as agg
from ..operators import ingest, joins
from .registry import query, rounded
from .views import Views

AS_OF = "2001-12-01"


@query("a8_all_packages", "SELECT p_partkey AS package FROM part UNION SELECT l_suppkey + 1000000 FROM lineitem")
def _(v: Views):
    return ingest.all_packages(v.part.select(F.col("p_partkey").alias("package")), v.lineitem.select((F.col("l_suppkey") + 1000000).alias("package")))


@query("a9_reload_ownership", "SELECT package, owner, kind, invited_at, CASE WHEN inviter <> owner THEN inviter END AS inviter FROM owners WHERE package IN (SELECT package FROM packages WHERE downloads > 1000)")
def _(v: Views):
    return ingest.reload_ownership(v.owners, v.packages.where("downloads > 1000"))


@query("a10_insert_ignore", "SELECT package, day, n FROM (SELECT package, day, min(n) AS n FROM daily WHERE version = 1 GROUP BY ALL) a UNION ALL SELECT package, day, min(n) AS n FROM daily d WHERE version <> 1 AND NOT EXISTS (SELECT 1 FROM daily o WHERE o.version = 1 AND o.package = d.package AND o.day = d.day) GROUP BY package, day")
def _(v: Views):
    old = v.daily.where("version = 1").groupBy("package", "day").agg(F.min("n").alias("n"))
    return ingest.insert_ignore(v.daily.where("version <> 1").select("package", "day", "n"), old, ["package", "day"])


@query("a11_upsert_coalesce", "SELECT coalesce(c.c_custkey, s.id) AS id, coalesce(nullif(trim(s.login), ''), c.c_name) AS login, coalesce(s.balance, c.c_acctbal) AS balance FROM customer c FULL JOIN (SELECT s_suppkey * 3 AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END AS login, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal END AS balance FROM supplier) s ON c.c_custkey = s.id")
def _(v: Views):
    new = v.supplier.selectExpr("s_suppkey * 3 AS id", "CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END AS login", "CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal END AS balance")
    return ingest.upsert_coalesce(new, v.customer.selectExpr("c_custkey AS id", "c_name AS login", "c_acctbal AS balance"), ["id"], ["login", "balance"])


@query("a12_merge_daily_max", "SELECT coalesce(o.package, w.package) AS package, coalesce(o.day, w.day) AS day, CASE WHEN w.over THEN w.n ELSE greatest(w.n, o.n) END AS n FROM (SELECT package, day, sum(n) AS n FROM daily WHERE version < 4 GROUP BY package, day) o FULL JOIN (SELECT package, day, sum(n) AS n, package % 5 = 0 AS over FROM daily WHERE version >= 3 GROUP BY package, day) w ON o.package = w.package AND o.day = w.day")
def _(v: Views):
    old = v.daily.where("version < 4").groupBy("package", "day").agg(F.sum("n").alias("n"))
    new = v.daily.where("version >= 3").groupBy("package", "day").agg(F.sum("n").alias("n")).withColumn("override", F.col("package") % 5 == 0)
    return ingest.merge_daily_max(new, old, ["package", "day"], "n", "override")


@query("a13_replace_children", "SELECT package, keyword, weight FROM keywords WHERE place = 0 AND package NOT IN (SELECT package FROM keywords WHERE place = 1 AND visible) UNION ALL SELECT package, keyword, weight FROM keywords WHERE place = 1 AND visible")
def _(v: Views):
    k = v.keywords
    return ingest.replace_children(k.where("place = 1 AND visible").select("package", "keyword", "weight"), k.where("place = 0").select("package", "keyword", "weight"), "package")


@query("a14_cascade_delete", "SELECT 'keywords' AS source, count(*) AS n FROM keywords WHERE package NOT IN (SELECT package FROM packages WHERE downloads > 2500) UNION ALL SELECT 'owners', count(*) FROM owners WHERE package NOT IN (SELECT package FROM packages WHERE downloads > 2500)")
def _(v: Views):
    left = ingest.cascade_delete({"keywords": v.keywords, "owners": v.owners}, v.packages.where("downloads > 2500"))
    return ingest.union_all([df.agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "n") for name, df in left.items()])


@query("a15_merge_best", "SELECT package, release, compiler, CASE WHEN max(CASE verdict WHEN 'X' THEN 4 WHEN 'Y' THEN 3 ELSE 1 END) = 4 THEN 'X' WHEN max(CASE verdict WHEN 'X' THEN 4 WHEN 'Y' THEN 3 ELSE 1 END) = 3 THEN 'Y' ELSE 'y' END AS verdict FROM builds GROUP BY package, release, compiler")
def _(v: Views):
    rank = F.when(F.col("verdict") == "X", 4).when(F.col("verdict") == "Y", 3).otherwise(1)
    return ingest.merge_best(v.builds.where("release > 3"), v.builds.where("release <= 3"), ["package", "release", "compiler"], rank)


@query("a17_sitemap_rows", f"SELECT package, least(1e0, greatest(0e0, (rank - 15e-2) * 2)) AS priority, CASE WHEN date_diff('day', updated, DATE '{AS_OF}') > 540 THEN 'yearly' WHEN date_diff('day', updated, DATE '{AS_OF}') > 60 THEN 'monthly' ELSE 'weekly' END AS changefreq FROM (SELECT package, max(day) AS updated FROM daily GROUP BY package) d JOIN packages USING (package)")
def _(v: Views):
    rows = v.daily.groupBy("package").agg(F.max("day").alias("updated")).join(v.packages.select("package", "rank"), "package")
    return ingest.sitemap_rows(rows, F.lit(AS_OF).cast("date"), url="package")


@query("a19_drop_expired", "SELECT package, next_update FROM packages WHERE next_update % 1000 = 0 OR next_update % 1000 > 500")
def _(v: Views):
    return ingest.drop_expired(v.packages.withColumn("expires", F.col("next_update") % 1000), "expires", F.lit(500)).select("package", "next_update")


@query("j2_semver_table", "SELECT package, release, sort_key, compat, is_pre, stability FROM keyed")
def _(v: Views):
    return semver.semver_table(v.releases).select("package", "release", "sort_key", "compat", "is_pre", "stability")


@query("j2_requirement_intervals", "SELECT DISTINCT requirement, low, high FROM intervals")
def _(v: Views):
    return semver.requirement_intervals(v.deps)


@query("c1_versions_of", "SELECT package, name, release FROM packages JOIN releases USING (package)")
def _(v: Views):
    return joins.versions_of(v.packages.select("package", "name"), v.releases.select("package", "release"))


@query("c2_resolve_owners", """WITH named AS (SELECT o.*, CASE WHEN kind = 0 THEN c_name ELSE s_name END AS login, first_value(owner) OVER (PARTITION BY package ORDER BY invited_at, kind, owner) AS first_owner
FROM owners o LEFT JOIN customer ON c_custkey = owner AND c_custkey > 0 LEFT JOIN supplier ON s_suppkey = owner WHERE CASE WHEN kind = 0 THEN c_name ELSE s_name END IS NOT NULL)
SELECT package, owner, kind, login, CASE WHEN coalesce(inviter, first_owner) <> owner THEN coalesce(inviter, first_owner) END AS inviter, invited_at FROM named""")
def _(v: Views):
    return joins.resolve_owners(v.owners, v.customer.selectExpr("c_custkey AS account", "c_name AS login"), v.supplier.selectExpr("s_suppkey AS account", "s_name AS login"))


@query("c3_resolve_email", """WITH users AS (SELECT c_custkey AS account, concat('u', c_custkey % 700) AS login, concat('u', c_custkey % 700, '@x.org') AS email, c_custkey AS seen FROM customer),
mails AS (SELECT DISTINCT CASE user_id % 3 WHEN 0 THEN concat('12+u', user_id, '@users.noreply.example.org') WHEN 1 THEN concat('u', user_id, '+tag@x.org') ELSE concat('u', user_id, '@x.org') END AS email FROM events)
SELECT email, coalesce((SELECT max(account) FROM users u WHERE u.login = regexp_extract(m.email, '^(?:[0-9]+[+])?([^@+]+)@users[.]noreply[.]', 1)), (SELECT max(account) FROM users u WHERE u.email = m.email), (SELECT max(account) FROM users u WHERE u.email = regexp_replace(m.email, '[+][^@]*@', '@'))) AS account FROM mails m""")
def _(v: Views):
    users = v.customer.selectExpr("c_custkey AS account", "concat('u', c_custkey % 700) AS login", "concat('u', c_custkey % 700, '@x.org') AS email", "c_custkey AS seen")
    mails = v.events.selectExpr("CASE user_id % 3 WHEN 0 THEN concat('12+u', user_id, '@users.noreply.example.org') WHEN 1 THEN concat('u', user_id, '+tag@x.org') ELSE concat('u', user_id, '@x.org') END AS email")
    return joins.resolve_email(mails, users)


TREES = """SELECT repo, package, path FROM {paths} UNION ALL SELECT concat('r', r), 1000000 + r, '' FROM (SELECT DISTINCT p_partkey % 40 AS r FROM {part}) x WHERE r % 8 = 0
    UNION ALL SELECT concat('q', p_partkey % 50), p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'tool' WHEN 1 THEN 'lib/x' ELSE concat('y', p_partkey) END FROM {part} WHERE p_partkey % 50 < 20 AND p_partkey < 150"""
REPOS = "SELECT repo, CASE WHEN package % 2 = 0 THEN 'rust-tool' ELSE 'other' END AS repo_name, CASE WHEN package % 5 = 0 THEN 'tool-rs' ELSE 'someone' END AS owner_name FROM (SELECT repo, min(package) AS package FROM trees GROUP BY repo) m"


@query("c6_nearest_ancestor", f"""WITH trees AS ({TREES.replace('{', '').replace('}', '')}), one AS (SELECT repo, path, min(package) AS package FROM trees GROUP BY repo, path), names AS ({REPOS}), big AS (SELECT repo FROM one GROUP BY repo HAVING count(*) > 1),
up AS (SELECT a.repo, a.package, max_by(b.package, length(b.path)) AS parent FROM one a JOIN big USING (repo) JOIN one b ON b.repo = a.repo AND b.path <> a.path AND (b.path = '' OR starts_with(a.path, b.path || '/')) GROUP BY ALL),
by_name AS (SELECT o.repo, o.path, o.package, list_position([repo_name, regexp_replace(repo_name, '^rust[-_]|[-_]rs$', ''), owner_name, regexp_replace(owner_name, '^rust[-_]|[-_]rs$', '')], o.path) AS place FROM one o JOIN big USING (repo) JOIN names n ON n.repo = o.repo),
named AS (SELECT a.repo, a.package, min_by(b.package, b.place) AS parent FROM one a JOIN by_name b ON b.repo = a.repo AND b.place > 0 AND b.path <> a.path GROUP BY ALL)
SELECT o.repo, o.package, coalesce(u.parent, n.parent) AS parent FROM one o LEFT JOIN up u ON u.repo = o.repo AND u.package = o.package LEFT JOIN named n ON n.repo = o.repo AND n.package = o.package""")
def _(v: Views):
    trees = v.spark.sql(TREES, paths=v.paths, part=v.part)
    return joins.nearest_ancestor(trees, v.spark.sql(REPOS.replace("trees", "{trees}"), trees=trees))


@query("c7_prefix_parent", """WITH names AS (SELECT DISTINCT replace(p_name, ' ', '-') AS name FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part UNION SELECT DISTINCT concat(replace(p_name, ' ', '-'), '_', p_size % 3) FROM part)
SELECT a.name, (SELECT max_by(b.name, length(b.name)) FROM names b WHERE starts_with(a.name, b.name || '-') OR starts_with(a.name, b.name || '_')) AS parent FROM names a""")
def _(v: Views):
    p = v.part
    names = p.selectExpr("replace(p_name, ' ', '-') AS name").union(p.selectExpr("split_part(p_name, ' ', 1)")).union(p.selectExpr("concat(replace(p_name, ' ', '-'), '_', p_size % 3)")).distinct()
    return joins.prefix_parent(names)


@query("c8_sub_components", "WITH names AS (SELECT DISTINCT replace(p_name, ' ', '-') AS name FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part) SELECT a.name, b.name AS stem FROM names a JOIN names b ON a.name = b.name || '-ring' OR a.name = b.name || '-bolt'")
def _(v: Views):
    names = v.part.selectExpr("replace(p_name, ' ', '-') AS name").union(v.part.selectExpr("split_part(p_name, ' ', 1)")).distinct()
    return joins.sub_components(names, ["ring", "bolt"])


INNER = """SELECT replace(p_name, ' ', '-') AS name FROM {part} UNION SELECT split_part(p_name, ' ', 1) FROM {part} UNION SELECT concat(split_part(p_name, ' ', 1), '_', CASE p_size % 5 WHEN 0 THEN 'internal' WHEN 1 THEN 'impl' WHEN 2 THEN 'private' ELSE 'other' END) FROM {part} UNION SELECT concat('no', p_partkey, '-impl') FROM {part}"""


@query("c8_internal_packages", f"WITH names AS ({INNER.replace('{part}', 'part')}) SELECT a.name, b.name AS parent FROM names a JOIN names b ON a.name IN (b.name || '_internal', b.name || '_impl', b.name || '_private', b.name || '_internals', b.name || '-internal', b.name || '-impl', b.name || '-private', b.name || '-internals')")
def _(v: Views):
    return joins.internal_packages(v.spark.sql(INNER, part=v.part))


@query("c9_verified_repo", "SELECT repo, name, package FROM (SELECT concat('r', downloads) AS repo, name, package FROM packages) p WHERE (repo, name) IN (SELECT concat('r', downloads), name FROM packages WHERE package % 3 = 0)")
def _(v: Views):
    p = v.packages.selectExpr("concat('r', downloads) AS repo", "name", "package")
    return joins.verified_repo(p, p.where("package % 3 = 0").select("repo", "name"))


@query("c10_in_external_list", "SELECT package, name FROM packages WHERE name IN (SELECT name FROM packages WHERE package < 20)")
def _(v: Views):
    p = v.packages.select("package", "name")
    return joins.in_external_list(p, p.where("package < 20").select("name").distinct())


@query("c11_worst_advisory", """WITH advisories AS (SELECT package, dep_id AS advisory, CASE WHEN dep_id % 4 > 0 THEN dep_id % 4 END AS severity, low, high, dep_id % 7 = 0 AS withdrawn FROM intervals WHERE dep_id % 5 = 0)
SELECT package, release, max_by(advisory, (severity, advisory)) AS advisory, max(severity) AS severity FROM keyed JOIN advisories USING (package) WHERE NOT withdrawn AND severity IS NOT NULL AND sort_key >= low AND sort_key < high GROUP BY package, release""")
def _(v: Views):
    adv = v.intervals.where("dep_id % 5 = 0").selectExpr("package", "dep_id AS advisory", "CASE WHEN dep_id % 4 > 0 THEN dep_id % 4 END AS severity", "low", "high", "dep_id % 7 = 0 AS withdrawn")
    return joins.worst_advisory(v.keyed, adv)


@query("c12_blocked_packages", "WITH listed AS (SELECT s_suppkey AS owner, concat('reason', s_suppkey % 3) AS reason FROM supplier WHERE s_suppkey % 4 = 0) SELECT package, count(reason) AS n_blocked, array_to_string(list_sort(list_distinct(list(reason) FILTER (WHERE reason IS NOT NULL))), ',') AS reasons, bool_and(reason IS NOT NULL) AS all_blocked FROM owners LEFT JOIN listed USING (owner) GROUP BY package HAVING count(reason) > 0")
def _(v: Views):
    return joins.blocked_packages(v.owners, v.supplier.where("s_suppkey % 4 = 0").selectExpr("s_suppkey AS owner", "concat('reason', s_suppkey % 3) AS reason"))


@query("c13_uncategorized", "SELECT package, rank FROM packages WHERE package NOT IN (SELECT package FROM categories WHERE relevance < 5e-1) ORDER BY rank DESC, package LIMIT 50")
def _(v: Views):
    return joins.uncategorized(v.packages.select("package", "rank"), v.categories.where("relevance < 0.5"), 50)


@query("c14_related_by_keyword", """WITH sums AS (SELECT a.package, b.package AS related, sum(a.weight * b.weight) AS score FROM keywords a JOIN keywords b USING (keyword) JOIN packages p ON p.package = b.package AND p.downloads > 500 WHERE a.package <> b.package GROUP BY ALL HAVING round(sum(a.weight * b.weight), 6) > 200)
SELECT package, related, round(score, 6) AS score, pos FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY round(score, 6) DESC, related) AS pos FROM sums) r WHERE pos <= 15""")
def _(v: Views):
    return rounded(joins.related_by_keyword(v.keywords, v.packages, 500, 200), "score")


@query("c15_related_categories", """WITH sums AS (SELECT a.slug, b.slug AS related, sum(a.relevance * b.relevance) AS score FROM categories a JOIN categories b USING (package) WHERE a.slug <> b.slug GROUP BY ALL HAVING round(sum(a.relevance * b.relevance), 6) > 1)
SELECT slug, related, round(score, 6) AS score, pos FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY round(score, 6) DESC, related) AS pos FROM sums) r WHERE pos <= 6""")
def _(v: Views):
    return rounded(joins.related_categories(v.categories, 1), "score")


@query("c16_common_owners", """WITH fine AS (SELECT DISTINCT package, owner FROM owners WHERE owner NOT IN (SELECT owner FROM excluded)), pairs AS (SELECT DISTINCT package AS a, package + 1 AS b FROM fine)
SELECT a, b, count(r.owner) AS n_common, count(*) AS n_a FROM pairs JOIN fine l ON l.package = a LEFT JOIN fine r ON r.package = b AND r.owner = l.owner GROUP BY a, b""")
def _(v: Views):
    pairs = v.owners.join(v.excluded, "owner", "left_anti").selectExpr("package AS a", "package + 1 AS b").distinct()
    return joins.common_owners(v.owners, pairs, v.excluded)


@query("c20_resolve_dependency", """SELECT dep_id, i.package, coalesce(max_by(release, (created, release)) FILTER (WHERE sort_key >= low AND sort_key < high AND NOT yanked), max_by(release, (created, release)) FILTER (WHERE release IS NOT NULL)) AS release,
count(*) FILTER (WHERE sort_key >= low AND sort_key < high AND NOT yanked) > 0 AS matched FROM (SELECT DISTINCT dep_id, package, low, high FROM intervals) i LEFT JOIN keyed k ON k.package = i.package GROUP BY dep_id, i.package""")
def _(v: Views):
    return joins.resolve_dependency(v.intervals.select("dep_id", "package", "low", "high").distinct(), v.keyed)


@query("c21_matching_extremes", "SELECT dep_id, max_by(release, (sort_key, release)) AS highest, min_by(release, (sort_key, release)) AS lowest FROM intervals i JOIN keyed k ON k.package = i.package AND sort_key >= low AND sort_key < high GROUP BY dep_id")
def _(v: Views):
    return joins.matching_extremes(v.intervals, v.keyed)


@query("c22_asof_version_downloads", """WITH picked AS (SELECT DISTINCT package, sort_key, compat FROM keyed WHERE release % 2 = 0), loads AS (SELECT package, sort_key, compat, CAST(release % 100 AS DOUBLE) AS n FROM keyed)
SELECT d.package, s.sort_key, sum(n) AS downloads FROM loads d JOIN picked s ON s.package = d.package AND s.sort_key = (SELECT min(t.sort_key) FROM picked t WHERE t.package = d.package AND t.sort_key >= d.sort_key) WHERE s.compat = d.compat GROUP BY ALL""")
def _(v: Views):
    k = v.keyed
    return joins.asof_version_downloads(k.where("release % 2 = 0").select("package", "sort_key", "compat").distinct(), k.selectExpr("package", "sort_key", "compat", "CAST(release % 100 AS DOUBLE) AS n"))


@query("c23_upgrade_target", """WITH top AS (SELECT dep_id, i.package, max(CASE WHEN sort_key >= low AND sort_key < high THEN sort_key END) AS matched FROM intervals i JOIN keyed k ON k.package = i.package GROUP BY ALL),
t AS (SELECT dep_id, max_by(release, (CASE WHEN is_pre THEN 0 ELSE 1 END, k.sort_key, release)) AS target, max_by(version, (CASE WHEN is_pre THEN 0 ELSE 1 END, k.sort_key, release)) AS version FROM top t JOIN keyed k ON k.package = t.package AND (matched IS NULL OR k.sort_key >= matched) GROUP BY dep_id)
SELECT dep_id, target, CASE WHEN regexp_full_match(version, '[1-9][0-9]*\\.[1-9][0-9]*\\.[0-9]') THEN regexp_replace(version, '[0-9]$', '0') ELSE version END AS target_version FROM t""")
def _(v: Views):
    return joins.upgrade_target(v.intervals.select("dep_id", "package", "low", "high"), v.keyed)


@query("c24_rev_deps_table", """WITH one AS (SELECT u.package, depender, max(downloads) AS downloads, bool_and(optional) AS optional, min(u.kind) AS kind FROM uses u JOIN packages p ON p.package = depender GROUP BY ALL)
SELECT package, depender, downloads, optional, kind, pos FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY optional, downloads DESC, depender) AS pos FROM one) r WHERE pos <= 1000""")
def _(v: Views):
    return joins.rev_deps_table(v.uses, v.packages)


@query("d1_latest_timestamp", "SELECT max(created) AS latest FROM releases")
def _(v: Views):
    return agg.latest_timestamp(v.releases)


@query("d2_owner_summary", "SELECT owner, min(invited_at) AS first_invited, count(*) AS n_packages FROM owners GROUP BY owner")
def _(v: Views):
    return agg.owner_summary(v.owners)


@query("d3_packages_of_owner", """SELECT owner, package, invited_at, latest, rank, pos FROM (SELECT owner, o.package, invited_at, latest, rank, row_number() OVER (PARTITION BY owner ORDER BY latest DESC, o.package) AS pos
FROM owners o JOIN (SELECT package, max(created) AS latest FROM releases GROUP BY package) n USING (package) JOIN packages USING (package)) r WHERE pos <= 50""")
def _(v: Views):
    return agg.packages_of_owner(v.owners, v.releases, v.packages, 50)


@query("d4_keyword_count", "SELECT keyword, count(*) AS n, count(*) >= 3 AS is_populated, count(*) >= 5 AS is_keyword FROM keywords WHERE visible GROUP BY keyword")
def _(v: Views):
    return agg.keyword_count(v.keywords)


@query("d5_popular_keywords", "SELECT keyword, round(sum(weight) * count(*), 6) AS score FROM keywords WHERE visible GROUP BY keyword ORDER BY round(sum(weight) * count(*), 6) DESC, keyword LIMIT 40")
def _(v: Views):
    return rounded(agg.popular_keywords(v.keywords, 40), "score")


@query("d6_category_counts", "SELECT slug, count(*) AS n, round(sum(rank_weight), 6) AS weight FROM categories GROUP BY slug")
def _(v: Views):
    return rounded(agg.category_counts(v.categories), "weight")


@query("d7_keywords_in_category", """WITH sums AS (SELECT slug, keyword, round(sum(weight * relevance), 6) AS score FROM categories JOIN keywords USING (package) WHERE visible GROUP BY ALL HAVING sum(weight) > 7 AND count(*) >= 4),
wide AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY score DESC, keyword) AS wide_pos FROM sums), fine AS (SELECT * FROM wide WHERE wide_pos <= 12 AND keyword NOT LIKE slug || '-r%')
SELECT slug, keyword, score, pos FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY score DESC, keyword) AS pos FROM fine) r WHERE pos <= 10""")
def _(v: Views):
    obvious = v.keywords.where("keyword LIKE '%-r%'").selectExpr("split_part(keyword, '-', 1) AS slug", "keyword").distinct()
    k = v.keywords.withColumn("weight", F.round("weight", 6))
    return rounded(agg.keywords_in_category(v.categories, k, obvious), "score")


@query("d8_replacements", """WITH sums AS (SELECT package, depender AS replacement, CAST(count(*) AS DOUBLE) * 11 AS weight FROM uses WHERE depender <> package GROUP BY ALL HAVING count(*) * 11 > 20)
SELECT package, replacement, weight, pos FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY weight DESC, replacement) AS pos FROM sums) r WHERE pos <= 4""")
def _(v: Views):
    return agg.replacements(v.uses.where("depender <> package").selectExpr("package", "depender AS replacement", "1.1e1 AS weight"))


@query("d10_first_seen_version", "SELECT package, version, min(day) AS first_seen FROM daily GROUP BY ALL")
def _(v: Views):
    return agg.first_seen_version(v.daily.withColumnRenamed("day", "committed"))


@query("d11_histogram", "WITH r AS (SELECT downloads, package, row_number() OVER (PARTITION BY downloads ORDER BY package) AS i FROM packages) SELECT downloads, count(*) AS n, string_agg(CAST(package AS VARCHAR), ',' ORDER BY i) FILTER (WHERE i <= 5) AS examples FROM r GROUP BY downloads")
def _(v: Views):
    return agg.histogram(v.packages, "downloads", "package")


SIZED = "SELECT o_custkey AS package, o_orderkey AS release, o_orderdate AS created, o_orderstatus = 'P' AS yanked, CASE WHEN o_orderkey % 13 > 0 THEN CAST(floor(o_totalprice * 40) AS BIGINT) END AS size, o_orderpriority AS license FROM {orders}"


@query("d12_release_histograms", f"""WITH sized AS ({SIZED.replace('{orders}', 'orders')}), per AS (SELECT package, count(*) FILTER (WHERE NOT yanked) AS live, count(*) AS n, min_by(created, release) AS a, max_by(created, release) AS b, max(release) AS release FROM sized GROUP BY package HAVING count(*) FILTER (WHERE NOT yanked) > 0),
nd AS (SELECT l_orderkey AS release, count(*) AS n_deps FROM lineitem WHERE l_linenumber > 1 GROUP BY l_orderkey), x AS (SELECT per.*, size, license, coalesce(n_deps, 0) AS n_deps FROM per JOIN sized ON sized.release = per.release LEFT JOIN nd ON nd.release = per.release),
w AS (SELECT package, 'releases' AS histogram, CAST(live AS VARCHAR) AS bucket FROM x UNION ALL SELECT package, 'age', CAST(date_diff('day', CAST(a AS DATE), DATE '{AS_OF}') // 7 AS VARCHAR) FROM x UNION ALL SELECT package, 'languish', CAST(date_diff('day', CAST(b AS DATE), DATE '{AS_OF}') // 7 AS VARCHAR) FROM x
 UNION ALL SELECT package, 'maintenance', CAST(CASE WHEN n = 1 THEN 0 ELSE greatest(CAST(floor(date_diff('day', CAST(a AS DATE), CAST(b AS DATE)) / 7) AS BIGINT), 1) END AS VARCHAR) FROM x UNION ALL SELECT package, 'deps', CAST(n_deps AS VARCHAR) FROM x UNION ALL SELECT package, 'licenses', license FROM x
 UNION ALL SELECT package, 'sizes', CAST(CASE WHEN size > 5000000 THEN size // 500000 * 500 ELSE size // 1000 END AS VARCHAR) FROM x WHERE size IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY histogram, bucket ORDER BY package) AS i FROM w)
SELECT histogram, bucket, count(*) AS n, string_agg(CAST(package AS VARCHAR), ',' ORDER BY i) FILTER (WHERE i <= 5) AS examples FROM r GROUP BY ALL""")
def _(v: Views):
    deps = v.lineitem.where("l_linenumber > 1").groupBy(F.col("l_orderkey").alias("release")).agg(F.count("*").alias("n_deps"))
    return agg.release_histograms(v.spark.sql(SIZED, orders=v.orders), deps, F.lit(AS_OF).cast("date"))


@query("d13_bucketize", "SELECT CASE WHEN downloads >= 4000 THEN 4000 WHEN downloads >= 2000 THEN 2000 WHEN downloads >= 500 THEN 500 ELSE 0 END AS bucket, count(*) AS n FROM packages GROUP BY 1")
def _(v: Views):
    return agg.bucketize(v.packages.groupBy(F.col("downloads").alias("value")).agg(F.count("*").alias("n")), [0, 500, 2000, 4000])


@query("d15_owner_package_histogram", "WITH per AS (SELECT owner, count(DISTINCT package) AS n_packages FROM owners WHERE owner NOT IN (SELECT owner FROM excluded) GROUP BY owner), r AS (SELECT *, row_number() OVER (PARTITION BY n_packages ORDER BY owner) AS i FROM per) SELECT n_packages, count(*) AS n, string_agg(CAST(owner AS VARCHAR), ',' ORDER BY i) FILTER (WHERE i <= 5) AS examples FROM r GROUP BY n_packages")
def _(v: Views):
    return agg.owner_package_histogram(v.owners, v.excluded)


@query("d16_compiler_support_shares", """WITH r AS (SELECT package, max(compiler) FILTER (WHERE verdict = 'X') AS newest_bad, min(compiler) FILTER (WHERE verdict <> 'X') AS oldest_ok FROM builds GROUP BY package)
SELECT compiler, count(*) FILTER (WHERE coalesce(compiler <= newest_bad, false)) AS bad, count(*) FILTER (WHERE coalesce(compiler >= oldest_ok, false) AND NOT coalesce(compiler <= newest_bad, false)) AS ok, count(*) FILTER (WHERE NOT coalesce(compiler >= oldest_ok, false) AND NOT coalesce(compiler <= newest_bad, false)) AS unknown
FROM r, (VALUES (10), (20), (30), (40), (50)) c(compiler) GROUP BY compiler""")
def _(v: Views):
    bad = F.col("verdict") == "X"
    ranges = v.builds.groupBy("package").agg(F.max(F.when(bad, F.col("compiler"))).alias("newest_bad"), F.min(F.when(~bad, F.col("compiler"))).alias("oldest_ok"))
    return agg.compiler_support_shares(ranges, [10, 20, 30, 40, 50])


@query("d18_language_share", "WITH s AS (SELECT package, version AS language, sum(n) AS code FROM daily GROUP BY ALL), t AS (SELECT package, language, code / sum(code) OVER (PARTITION BY package) AS share FROM s), u AS (SELECT *, max(share) OVER (PARTITION BY package) AS top FROM t) SELECT package, language, round(share, 6) AS share FROM u WHERE top < 0.9")
def _(v: Views):
    return rounded(agg.language_share(v.daily.groupBy("package", F.col("version").alias("language")).agg(F.sum("n").alias("code"))), "share")


@query("d19_dep_weighted_size", """WITH c AS (SELECT DISTINCT depender AS package, package AS dep, kind, optional FROM uses), s AS (SELECT package AS dep, downloads * 1000 AS size, rank / 100 AS commonality, downloads % 700 = 0 AS is_macro FROM packages)
SELECT package, round(round(sum(size * CASE WHEN NOT optional THEN 1e0 WHEN kind < 2 THEN 25e-2 ELSE 15e-2 END * (1 - commonality) * CASE WHEN is_macro THEN 1e-1 ELSE 1e0 END * CASE WHEN kind = 0 THEN 1e0 WHEN kind = 1 AND NOT optional AND size > 1000000 THEN 1e0 ELSE 1e-1 END), 6), 0) AS typical,
round(round(sum(CASE WHEN NOT optional AND NOT is_macro AND kind = 0 THEN size * (1 - commonality) * (1 - commonality) ELSE 0e0 END), 6), 0) AS minimal FROM c JOIN s USING (dep) GROUP BY package""")
def _(v: Views):
    c = v.uses.selectExpr("depender AS package", "package AS dep", "CASE kind WHEN 0 THEN 'runtime' WHEN 1 THEN 'build' ELSE 'dev' END AS kind", "NOT optional AS is_default", "kind < 2 AS direct").distinct()
    s = v.packages.selectExpr("package AS dep", "downloads * 1000 AS size", "rank / 100 AS commonality", "downloads % 700 = 0 AS is_macro")
    return rounded(agg.dep_weighted_size(c, s), "typical", "minimal", places=0)


@query("d20_release_counts", f"""WITH r AS (SELECT *, lag(compat) OVER (PARTITION BY package ORDER BY sort_key, release) AS prev FROM keyed WHERE NOT yanked)
SELECT package, count(*) AS total, count(*) FILTER (WHERE stability = 'stable') AS stable, count(*) FILTER (WHERE prev <> compat) AS breaking, count(*) FILTER (WHERE prev = compat) AS patch, count(*) FILTER (WHERE is_pre) AS pre,
count(*) FILTER (WHERE date_diff('day', CAST(created AS DATE), DATE '{AS_OF}') <= 280) AS total_recent, count(*) FILTER (WHERE date_diff('day', CAST(created AS DATE), DATE '{AS_OF}') <= 280 AND prev <> compat) AS breaking_recent FROM r GROUP BY package""")
def _(v: Views):
    return agg.release_counts(v.keyed, F.lit(AS_OF).cast("date"))


@query("d21_version_usage", "SELECT package, version AS release, count(*) AS n_dependents FROM daily GROUP BY ALL")
def _(v: Views):
    return agg.version_usage(v.daily.withColumnRenamed("version", "release"))


@query("d22_contribution_by_login", "SELECT login, round(sum(greatest(commits, 0) + sqrt(added + 2 * deleted)), 4) AS contribution FROM (SELECT CASE WHEN user_id % 10 = 0 THEN concat('u', user_id, '[bot]') ELSE concat('u', user_id) END AS login, event_id % 5 - 1 AS commits, event_id % 100 AS added, event_id % 30 AS deleted FROM events) w WHERE login NOT LIKE '%[bot]' GROUP BY login")
def _(v: Views):
    weeks = v.events.selectExpr("CASE WHEN user_id % 10 = 0 THEN concat('u', user_id, '[bot]') ELSE concat('u', user_id) END AS login", "event_id % 5 - 1 AS commits", "event_id % 100 AS added", "event_id % 30 AS deleted")
    return rounded(agg.contribution_by_login(weeks), "contribution", places=4)


@query("d23_author_keywords", """WITH sums AS (SELECT owner, keyword, round(sum((rank + 5e-1) / (place + 2)), 6) AS score FROM (SELECT DISTINCT owner, package FROM owners) o JOIN packages USING (package) JOIN keywords USING (package) GROUP BY ALL)
SELECT owner, keyword, score, pos FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY score DESC, keyword) AS pos FROM sums) r WHERE pos <= 7""")
def _(v: Views):
    p = v.packages.withColumn("rank", F.col("rank"))
    return rounded(agg.author_keywords(v.owners, p, v.keywords), "score")


@query("d24_collaborators", """WITH o AS (SELECT DISTINCT owner, package, rank FROM owners JOIN packages USING (package)), sums AS (SELECT a.owner, b.owner AS other, round(sum(a.rank + 5e-1), 6) AS score FROM o a JOIN o b USING (package) WHERE a.owner <> b.owner GROUP BY ALL)
SELECT owner, other, score FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY score DESC, other) AS pos FROM sums) r WHERE pos <= 1000""")
def _(v: Views):
    return rounded(agg.collaborators(v.owners, v.packages, 1000), "score").drop("pos")


@query("d26_warning_groups", "SELECT owner, title, count(DISTINCT package) AS n, max(severity) AS severity, min(package) AS first_package FROM warned GROUP BY owner, title HAVING count(DISTINCT package) >= 3")
def _(v: Views):
    return agg.warning_groups(v.warned)


@query("d27_total_owners_by_month", "WITH f AS (SELECT owner, CAST(date_trunc('month', min(invited_at)) AS DATE) AS month FROM owners GROUP BY owner), m AS (SELECT month, count(*) AS joined FROM f GROUP BY month) SELECT month, joined, sum(joined) OVER (ORDER BY month) AS total FROM m")
def _(v: Views):
    return agg.total_owners_by_month(v.owners)
