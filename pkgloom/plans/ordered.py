"""Bindings of ordered computations and top lists (E, F) to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import windows as win
from .registry import query, rounded
from .views import Views

AS_OF = "2001-12-01"


@query("e1_half_life_intervals", """WITH c AS (SELECT package, count(*) AS n_owners FROM owners GROUP BY package), r AS (SELECT r.*, coalesce(n_owners, 0) > 1 AS team, release % 17 AS odd, lead(created) OVER (PARTITION BY r.package ORDER BY release) AS next, count(*) OVER (PARTITION BY r.package) AS n FROM releases r LEFT JOIN c ON c.package = r.package),
d AS (SELECT *, CASE WHEN version = '0.1.0' THEN 60 + odd + CASE WHEN team THEN 14 ELSE 0 END WHEN version LIKE '0.%' AND n < 3 THEN 180 + 2 * odd + CASE WHEN team THEN 30 ELSE 0 END WHEN version LIKE '0.%' OR n < 3 THEN 365 + 3 * odd + CASE WHEN team THEN 90 ELSE 0 END ELSE 730 + 4 * odd + CASE WHEN team THEN 365 ELSE 0 END END AS days FROM r)
SELECT package, release, CAST(created AS DATE) AS start, CASE WHEN next IS NOT NULL THEN CAST(created AS DATE) + CAST(floor(date_diff('day', CAST(created AS DATE), CAST(next AS DATE)) / 2) AS INT) ELSE CAST(created AS DATE) + CAST(days AS INT) END AS "end", CASE WHEN next IS NOT NULL THEN 'removed' ELSE 'expired' END AS how FROM d""")
def _(v: Views):
    return win.half_life_intervals(v.releases, v.owners.groupBy("package").agg(F.count("*").alias("n_owners")))


CHANGES = "SELECT package AS dep, version AS owner, day, CASE WHEN day < DATE '1998-06-01' THEN 25e-2 ELSE -125e-3 END AS delta FROM daily"


@query("e2_running_active_users", f"""WITH c AS ({CHANGES}), d AS (SELECT dep, owner, day, sum(delta) AS delta FROM c GROUP BY ALL), r AS (SELECT *, least(round(sum(delta) OVER (PARTITION BY dep, owner ORDER BY day), 9), 1e0) AS now FROM d),
s AS (SELECT *, now - coalesce(lag(now) OVER (PARTITION BY dep, owner ORDER BY day), 0e0) AS step FROM r), t AS (SELECT dep, day, sum(step) AS step FROM s GROUP BY dep, day)
SELECT dep, day, CAST(ceil(round(sum(step) OVER (PARTITION BY dep ORDER BY day), 6)) AS BIGINT) AS users FROM t""")
def _(v: Views):
    return win.running_active_users(v.daily.selectExpr("package AS dep", "version AS owner", "day", "CASE WHEN day < DATE '1998-06-01' THEN 25e-2 ELSE -125e-3 END AS delta"), v.partitions)


@query("e3_monthly_running_totals", """WITH m AS (SELECT package AS dep, CAST(date_trunc('month', day) AS DATE) AS month, sum(version) AS added, sum(version % 2) AS removed, sum(version % 3) AS expired, max_by(n, (day, version)) AS users FROM (SELECT package, day, max(version) AS version, max(n) AS n FROM daily GROUP BY package, day) x GROUP BY ALL),
g AS (SELECT dep, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM m GROUP BY dep)
SELECT g.dep, g.month, sum(coalesce(added, 0)) OVER w AS added, sum(coalesce(removed, 0)) OVER w AS removed, sum(coalesce(expired, 0)) OVER w AS expired, last_value(users IGNORE NULLS) OVER w AS users FROM g LEFT JOIN m ON m.dep = g.dep AND m.month = g.month WINDOW w AS (PARTITION BY g.dep ORDER BY g.month ROWS UNBOUNDED PRECEDING)""")
def _(v: Views):
    d = v.daily.groupBy("package", "day").agg(F.max("version").alias("version"), F.max("n").alias("n"))
    return win.monthly_running_totals(d.selectExpr("package AS dep", "day", "version AS added", "version % 2 AS removed", "version % 3 AS expired", "n AS users"))


@query("e4_smoothed_peak", "SELECT dep, max((users + nxt) / 2) AS peak FROM (SELECT *, lead(users) OVER (PARTITION BY dep ORDER BY month) AS nxt FROM months) m GROUP BY dep")
def _(v: Views):
    return win.smoothed_peak(v.months)


@query("e5_keyword_rank", """WITH k AS (SELECT k.package, keyword, rank() OVER (PARTITION BY keyword ORDER BY p.rank DESC) AS top, count(*) OVER (PARTITION BY keyword) AS total FROM keywords k JOIN packages p ON p.package = k.package WHERE visible)
SELECT package, keyword, top, total FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY top + (top + 30) / total, keyword) AS i FROM k WHERE total >= 5) r WHERE i = 1""")
def _(v: Views):
    return win.keyword_rank(v.keywords, v.packages)


@query("e6_category_rank", """WITH c AS (SELECT c.package, slug, row_number() OVER (PARTITION BY slug ORDER BY p.rank * rank_weight DESC, c.package) AS place FROM categories c JOIN packages p ON p.package = c.package)
SELECT package, min_by(slug, (place, slug)) AS slug, min(place) AS place FROM c GROUP BY package""")
def _(v: Views):
    return win.category_rank(v.categories, v.packages)


@query("e7_release_diffs", """WITH d AS (SELECT l_orderkey AS release, list_sort(list_distinct(list(l_partkey % 50))) AS deps FROM lineitem GROUP BY l_orderkey), r AS (SELECT package, k.release, deps, lag(deps) OVER w AS old, compat, lag(compat) OVER w AS old_compat FROM keyed k JOIN d ON d.release = k.release WHERE NOT yanked WINDOW w AS (PARTITION BY package ORDER BY sort_key, k.release))
SELECT package, release, len(list_filter(deps, lambda x: NOT list_contains(coalesce(old, []), x))) AS n_added, len(list_filter(coalesce(old, []), lambda x: NOT list_contains(deps, x))) AS n_removed, coalesce(old_compat <> compat, false) AS is_major FROM r""")
def _(v: Views):
    deps = v.lineitem.groupBy(F.col("l_orderkey").alias("release")).agg(F.collect_set(F.col("l_partkey") % 50).alias("deps"))
    return win.release_diffs(v.keyed.join(deps, "release"))


@query("e8_group_versions", """WITH r AS (SELECT *, CAST(created AS DATE) AS d, CAST(date_trunc('month', created) AS DATE) AS m, CAST(date_trunc('quarter', created) AS DATE) AS q FROM keyed), n AS (SELECT package, count(DISTINCT d) AS nd, count(DISTINCT m) AS nm FROM r GROUP BY package),
g AS (SELECT r.package, CASE WHEN nd <= 5 THEN d WHEN nm <= 5 THEN m ELSE q END AS period, max_by(release, (sort_key, release)) AS release, count(*) AS n FROM r JOIN n ON n.package = r.package GROUP BY ALL)
SELECT package, period, release, n, pos FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY period DESC) AS pos FROM g) x WHERE pos <= 5""")
def _(v: Views):
    return win.group_versions(v.keyed)


@query("e9_top_in_category", """SELECT slug, package, round(value, 6) AS value, pos FROM (SELECT slug, c.package, p.rank * rank_weight AS value, row_number() OVER (PARTITION BY slug ORDER BY p.rank * rank_weight DESC, c.package) AS pos FROM categories c JOIN packages p ON p.package = c.package) r WHERE pos <= 20""")
def _(v: Views):
    return rounded(win.top_in_category(v.categories, v.packages, 20), "value")


@query("e10_recently_updated", """SELECT g.package, round(epoch(latest) + 604800 * p.rank, 4) AS value FROM (SELECT package, max(created) AS latest, count(*) AS n FROM releases GROUP BY package) g JOIN packages p ON p.package = g.package WHERE n >= 2 AND p.rank > 0.01 ORDER BY epoch(latest) + 604800 * p.rank DESC, g.package LIMIT 50""")
def _(v: Views):
    return rounded(win.recently_updated(v.releases, v.packages, 50, 0.01), "value", places=4)


@query("e11_most_downloaded", "SELECT package, downloads FROM packages ORDER BY downloads DESC, package LIMIT 50")
def _(v: Views):
    return win.most_downloaded(v.packages, 50)


@query("e12_notable", "SELECT p.package, p.rank, max(created) AS updated FROM packages p JOIN releases r ON r.package = p.package WHERE p.rank > 0.1 GROUP BY ALL")
def _(v: Views):
    return win.notable(v.packages, v.releases, 0.1)


@query("e13_overdue", "SELECT package, next_update FROM packages WHERE next_update < 50000 ORDER BY next_update, package LIMIT 1000")
def _(v: Views):
    return win.overdue(v.packages, F.lit(50000))


@query("e14_changed_since", "SELECT package FROM releases GROUP BY package HAVING max(created) >= TIMESTAMP '2001-06-01' UNION SELECT package FROM (SELECT package FROM packages WHERE next_update < 20000 ORDER BY next_update, package LIMIT 1000) o")
def _(v: Views):
    return win.changed_since(v.releases, F.lit("2001-06-01").cast("timestamp_ntz"), win.overdue(v.packages, F.lit(20000)))


@query("e15_most_popular", """WITH m AS (SELECT dep AS package, max_by(users, month) AS last, max(users) AS peak FROM months GROUP BY dep) SELECT m.package, round(last / peak * downloads, 4) AS value FROM m JOIN packages p ON p.package = m.package WHERE last > 30 AND last >= 5e-1 * peak AND m.package % 9 <> 0 ORDER BY last / peak * downloads DESC, m.package LIMIT 40""")
def _(v: Views):
    return rounded(win.most_popular(v.months, v.packages, v.packages.where("package % 9 = 0").select("package"), 40), "value", places=4)


ITEM_OWNERS = "SELECT package AS item, CAST(owner AS VARCHAR) AS owner, row_number() OVER (PARTITION BY package ORDER BY invited_at, owner) - 1 AS place FROM owners"
# from ``items`` (list_id, item, score) to ``new`` (list_id, item, new_score)
DIVERSE = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY score DESC, item) AS pl FROM items), io AS ({ITEM_OWNERS}),
o AS (SELECT list_id, item, pl, owner AS name FROM ranked JOIN io USING (item) WHERE place < 5),
k0 AS (SELECT list_id, ranked.item, pl, keyword AS name, place FROM ranked JOIN keywords ON package = item),
uses_of AS (SELECT list_id, name, row_number() OVER (PARTITION BY list_id ORDER BY count(*) DESC, name) AS most, count(*) OVER (PARTITION BY list_id) AS n FROM k0 GROUP BY list_id, name),
k AS (SELECT k0.* FROM k0 JOIN uses_of USING (list_id, name) WHERE place < 5 AND most > greatest(2, least(10, floor(n / 10)))),
pair AS (SELECT list_id, k0.item, pl, coalesce(owner, '') || '|' || name AS name FROM k0 LEFT JOIN (SELECT item, owner FROM io WHERE place = 0) f USING (item) WHERE place < 5),
pen AS (SELECT list_id, item, greatest(2 * (count(*) OVER (PARTITION BY list_id, name ORDER BY pl ROWS UNBOUNDED PRECEDING) - 1) - 3, 0) AS penalty, 2 AS weight FROM o
 UNION ALL SELECT list_id, item, greatest((count(*) OVER (PARTITION BY list_id, name ORDER BY pl ROWS UNBOUNDED PRECEDING) - 1) - 4, 0), 1 FROM k
 UNION ALL SELECT list_id, item, 3 * (count(*) OVER (PARTITION BY list_id, name ORDER BY pl ROWS UNBOUNDED PRECEDING) - 1), 2 FROM pair),
dupe AS (SELECT list_id, item, sum(penalty) / (sum(weight) + 10) AS dupe FROM pen GROUP BY ALL),
new AS (SELECT r.list_id, r.item, round(score / 2 + (score + 7) / (7 + coalesce(dupe, 0)), 6) AS new_score FROM ranked r LEFT JOIN dupe d ON d.list_id = r.list_id AND d.item = r.item)"""


def item_owners(v: Views):
    """Owners of packages as items, in the order of their invitations."""
    place = F.row_number().over(Window.partitionBy("package").orderBy("invited_at", "owner")) - 1
    return v.owners.select(F.col("package").alias("item"), F.col("owner").cast("string").alias("owner"), place.alias("place"))


@query("e16_diversify", f"WITH items AS (SELECT kind AS list_id, package AS item, rank AS score FROM packages), {DIVERSE} SELECT * FROM new")
def _(v: Views):
    items = v.packages.selectExpr("kind AS list_id", "package AS item", "rank AS score")
    return win.diversify(items, item_owners(v), v.keywords.selectExpr("package AS item", "keyword", "place")).drop("pos")


@query("e17_category_list_size", "SELECT slug, count(*) AS n, greatest(100, least(3000, CAST(floor((floor(count(*) / 2) + 25) / 50) * 50 AS BIGINT))) AS listed FROM categories GROUP BY slug")
def _(v: Views):
    return win.category_list_size(v.categories)


HOME = {
    "tree": "SELECT slug, CASE WHEN slug LIKE 'Brand#1%' THEN 'SMALL' WHEN slug LIKE 'Brand#2%' THEN 'Brand#1' END AS parent, row_number() OVER (ORDER BY slug) AS place, n AS own_popularity FROM (SELECT slug, count(*) AS n FROM {categories} GROUP BY slug) c",
    "ranked": "SELECT c.slug, c.package, row_number() OVER (PARTITION BY c.slug ORDER BY p.rank * c.rank_weight DESC, c.package) AS pos FROM {categories} c JOIN {packages} p ON p.package = c.package",
    "dated": "SELECT package, name, downloads, next_update AS updated FROM {packages}",
}


def _tables(v: Views):
    return [v.spark.sql(HOME[k], **{n: getattr(v, n) for n in ("categories", "packages") if f"{{{n}}}" in HOME[k]}) for k in ("ranked", "dated", "tree")]


def _choices() -> str:
    """Turn after turn, for the 31 categories of the test tables."""
    steps = [f"""WITH RECURSIVE tree AS ({HOME['tree']}), ranked AS ({HOME['ranked']}),
walk(slug, path) AS (SELECT slug, [{{'kind': 0, 'at': CAST(place AS DOUBLE), 'slug': slug}}] FROM tree WHERE parent IS NULL UNION ALL SELECT t.slug, list_append(path, {{'kind': 0, 'at': CAST(place AS DOUBLE), 'slug': t.slug}}) FROM walk w JOIN tree t ON t.parent = w.slug),
pop AS (SELECT u.a.slug AS slug, max(own_popularity) AS popularity FROM (SELECT slug, unnest(path) AS a FROM walk) u JOIN tree t ON t.slug = u.slug GROUP BY 1),
turns AS MATERIALIZED (SELECT w.slug, row_number() OVER (ORDER BY list_append(path[:-2], {{'kind': 1, 'at': CAST(popularity AS DOUBLE), 'slug': w.slug}})) AS turn FROM walk w JOIN pop p ON p.slug = w.slug),
best AS MATERIALIZED (SELECT turn, r.* FROM ranked r JOIN turns t ON t.slug = r.slug WHERE pos <= 35), c0 AS (SELECT slug, package, 0 AS place FROM best WHERE false)""".replace("{categories}", "categories").replace("{packages}", "packages")]
    for i in range(1, 32):
        steps.append(f"c{i} AS MATERIALIZED (SELECT * FROM c{i - 1} UNION ALL SELECT * FROM (SELECT slug, package, row_number() OVER (ORDER BY pos) AS place FROM best WHERE turn = {i} AND package NOT IN (SELECT package FROM c{i - 1})) n WHERE place <= 8)")
    return ", ".join(steps) + " SELECT * FROM c31"


@query("e18_home_choices", _choices())
def _(v: Views):
    return win.home_choices(*_tables(v))[0].drop("downloads")


def _home(v: Views):
    return win.home_categories(*_tables(v), {"Brand#3": 1.5, "ECONOMY": 0.25}, (("ECONOMY", "STANDARD"), ("Brand#10", "Brand#11")))


@query("e18_home_categories")
def _(v: Views):
    return _home(v)[0]


@query("e18_category_display")
def _(v: Views):
    return rounded(_home(v)[1], "rank", places=3)


@query("e19_split_good_bad", """WITH r AS (SELECT *, score >= 33e-2 * max(score) OVER (PARTITION BY query_id) AS good, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM results), n AS (SELECT *, count(*) FILTER (WHERE good) OVER (PARTITION BY query_id) AS ng FROM r)
SELECT query_id, doc_id, score, good FROM n WHERE good OR place - ng <= 10 + floor(ng / 2)""")
def _(v: Views):
    return win.split_good_bad(v.results)


@query("e20_dashboard_order", """WITH s AS (SELECT owner, w.package, p.rank, sum(severity * severity) AS s2 FROM warned w JOIN packages p ON p.package = w.package GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY rank DESC, package) <= ceil(count(*) OVER (PARTITION BY owner) / 8) AS first FROM s)
SELECT owner, package, row_number() OVER (PARTITION BY owner ORDER BY first DESC, (s2 * 1000 + 5000) * rank DESC, package) AS pos FROM f""")
def _(v: Views):
    return win.dashboard_order(v.warned, v.packages)


@query("e21_founder_member_split", """WITH l AS (SELECT package, max(created) AS latest FROM releases GROUP BY package), r AS (SELECT owner, o.package, inviter IS NULL AS founder, p.rank, latest FROM owners o JOIN packages p ON p.package = o.package LEFT JOIN l ON l.package = o.package)
SELECT owner, founder, package, pos FROM (SELECT *, row_number() OVER (PARTITION BY owner, founder ORDER BY CASE WHEN founder THEN latest END DESC NULLS LAST, rank DESC, package) AS pos FROM r) x WHERE pos <= 200""")
def _(v: Views):
    return win.founder_member_split(v.owners, v.packages, v.releases)


@query("e22_new_and_trending", """WITH b AS (SELECT package, rank AS value, 0 AS part FROM packages WHERE package % 2 = 0 UNION ALL SELECT package, CAST(downloads AS DOUBLE), 1 FROM packages WHERE package % 3 = 0), o AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY part) AS turn FROM b)
SELECT part, package, pos FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY value DESC, package) AS pos FROM o WHERE turn = 1) r WHERE pos <= 40""")
def _(v: Views):
    p = v.packages
    return win.new_and_trending(p.where("package % 2 = 0").selectExpr("package", "rank AS value"), p.where("package % 3 = 0").selectExpr("package", "CAST(downloads AS DOUBLE) AS value"))


@query("f1_set_differences", """WITH a AS (SELECT DISTINCT package, keyword FROM keywords WHERE place = 0), b AS (SELECT DISTINCT package, keyword FROM keywords WHERE place = 1 OR package % 3 = 0)
SELECT coalesce(a.package, b.package) AS package, count(*) FILTER (WHERE b.keyword IS NULL) AS only_a, count(*) FILTER (WHERE a.keyword IS NULL) AS only_b, count(*) FILTER (WHERE a.keyword IS NOT NULL AND b.keyword IS NOT NULL) AS common FROM a FULL JOIN b ON a.package = b.package AND a.keyword = b.keyword GROUP BY 1""")
def _(v: Views):
    return win.set_differences(v.keywords.where("place = 0"), v.keywords.where("place = 1 OR package % 3 = 0"), "package", "keyword")


@query("f4_except_known", "SELECT package, owner FROM owners EXCEPT SELECT package, owner FROM owners WHERE kind = 1")
def _(v: Views):
    return win.except_known(v.owners.select("package", "owner"), v.owners.where("kind = 1").select("package", "owner"), ["package", "owner"])


@query("f5_dedupe_within_run", "SELECT DISTINCT depender, package FROM uses")
def _(v: Views):
    return win.dedupe_within_run(v.uses.select("depender", "package"), ["depender", "package"])
