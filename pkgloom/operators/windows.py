"""Ordered computations and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import settled
from .joins import top_n


def half_life_intervals(releases: DataFrame, owner_counts: DataFrame) -> DataFrame:
    """A release is in use until midway to the next, the last one until its expiry by maturity."""
    w = Window.partitionBy("package").orderBy("release")
    r = releases.join(owner_counts, "package", "left").withColumns({"next": F.lead("created").over(w), "n": F.count("*").over(Window.partitionBy("package"))})
    team, odd = F.coalesce(F.col("n_owners"), F.lit(0)) > 1, F.pmod("release", F.lit(17))
    zero = F.col("version").startswith("0.")
    days = (
        F.when(F.col("version") == "0.1.0", 60 + odd + F.when(team, 14).otherwise(0))
        .when(zero & (F.col("n") < 3), 180 + 2 * odd + F.when(team, 30).otherwise(0))
        .when(zero | (F.col("n") < 3), 365 + 3 * odd + F.when(team, 90).otherwise(0))
        .otherwise(730 + 4 * odd + F.when(team, 365).otherwise(0))
    ).cast("int")
    start = F.to_date("created")
    until = F.when(F.col("next").isNotNull(), F.date_add(start, F.floor(F.datediff("next", "created") / 2).cast("int"))).otherwise(F.date_add(start, days))
    return r.select("package", "release", start.alias("start"), until.alias("end"), F.when(F.col("next").isNotNull(), "removed").otherwise("expired").alias("how"))


def capped_steps(changes: DataFrame, partitions: int | None = None) -> DataFrame:
    """Per dependency and day the sum of the steps of its owners' balances, each capped at 1. ``changes``: dep, owner, day, delta."""
    # One exchange serves the sums per day and the window over them.
    daily = changes.repartition(*[partitions] * bool(partitions), "dep", "owner").groupBy("dep", "owner", "day").agg(F.sum("delta").alias("delta"))
    w = Window.partitionBy("dep", "owner").orderBy("day")
    capped = F.least(F.round(F.sum("delta").over(w), 9), F.lit(1.0))
    step = daily.withColumn("now", capped).withColumn("step", F.col("now") - F.coalesce(F.lag("now").over(w), F.lit(0.0)))
    return step.groupBy("dep", "day").agg(F.sum("step").alias("step"))


def users_by_day() -> Column:
    """A dependency's users, rounded up, of the sums of ``capped_steps``."""
    return F.ceil(F.round(F.sum("step").over(Window.partitionBy("dep").orderBy("day")), 6))


def running_active_users(changes: DataFrame, partitions: int | None = None) -> DataFrame:
    """Per dependency and day the number of owners in use, each owner's balance capped at 1, rounded up.

    ``changes``: dep, owner, day, delta. The delta of the capped balance is
    summed, so no grid of days and owners is needed. ``partitions``: how many
    tasks share the rows; without it Spark joins partitions by their bytes.
    """
    steps = capped_steps(changes, partitions)
    return (steps.repartition(partitions, "dep") if partitions else steps).select("dep", "day", users_by_day().alias("users"))


def monthly_running_totals(daily: DataFrame) -> DataFrame:
    """Gap-filled months with running sums of added, removed, expired; users carried forward."""
    month = F.trunc("day", "month")
    m = daily.groupBy("dep", month.alias("month")).agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.sum("expired").alias("expired"), F.max_by("users", "day").alias("users"))
    span = m.groupBy("dep").agg(F.min("month").alias("a"), F.max("month").alias("b")).select("dep", F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
    w = Window.partitionBy("dep").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).over(w).alias(c)
    return span.join(m, ["dep", "month"], "left").select("dep", "month", total("added"), total("removed"), total("expired"), F.last("users", ignorenulls=True).over(w).alias("users"))


def smoothed_peak(monthly: DataFrame, key: str = "dep", value: str = "users", order: str = "month") -> DataFrame:
    """The largest mean of two consecutive months."""
    w = Window.partitionBy(key).orderBy(order)
    pair = (F.col(value) + F.lead(value).over(w)) / 2
    return monthly.withColumn("pair", pair).groupBy(key).agg(F.max("pair").alias("peak"))


def keyword_rank(keywords: DataFrame, packages: DataFrame, least: int = 5) -> DataFrame:
    """E5: the explicit keyword in which a package stands best, by (place + (place + 30) / total)."""
    k = keywords.where("visible").select("package", "keyword").join(packages.select("package", "rank"), "package")
    place = F.rank().over(Window.partitionBy("keyword").orderBy(F.desc("rank")))
    total = F.count("*").over(Window.partitionBy("keyword"))
    r = k.withColumns({"top": place, "total": total}).where(F.col("total") >= least).withColumn("quality", F.col("top") + (F.col("top") + 30) / F.col("total"))
    return top_n(r, ["package"], [F.col("quality"), F.col("keyword")], 1).select("package", "keyword", "top", "total")


def category_rank(categories: DataFrame, packages: DataFrame) -> DataFrame:
    """The best place of a package over its categories' lists."""
    c = categories.join(packages.select("package", "rank"), "package").withColumn("place", F.row_number().over(Window.partitionBy("slug").orderBy(F.desc(F.col("rank") * F.col("rank_weight")), "package")))
    return c.groupBy("package").agg(F.min(F.struct("place", "slug")).alias("b")).select("package", F.col("b.slug").alias("slug"), F.col("b.place").alias("place"))


def release_diffs(releases: DataFrame) -> DataFrame:
    """Dependencies added and removed against the previous release in version order, and whether the class is new."""
    w = Window.partitionBy("package").orderBy("sort_key", "release")
    empty = F.array().cast("array<bigint>")
    r = releases.where("NOT yanked").withColumns({"old": F.coalesce(F.lag("deps").over(w), empty), "old_compat": F.lag("compat").over(w)})
    return r.select("package", "release", F.size(F.array_except("deps", "old")).alias("n_added"), F.size(F.array_except("old", "deps")).alias("n_removed"), F.coalesce(F.col("old_compat") != F.col("compat"), F.lit(False)).alias("is_major"))


def group_versions(releases: DataFrame, most: int = 5) -> DataFrame:
    """The best version per day, month or quarter, the finest grouping that leaves at most ``most`` rows, else the last quarters."""
    day, month, quarter = F.to_date("created"), F.to_date(F.trunc("created", "month")), F.to_date(F.date_trunc("quarter", "created"))
    r = releases.withColumns({"day": day, "month": month, "quarter": quarter})
    n = r.groupBy("package").agg(F.count_distinct("day").alias("n_day"), F.count_distinct("month").alias("n_month"))
    unit = F.when(F.col("n_day") <= most, F.col("day")).when(F.col("n_month") <= most, F.col("month")).otherwise(F.col("quarter"))
    g = r.join(n, "package").groupBy("package", unit.alias("period")).agg(F.max(F.struct("sort_key", "release")).alias("best"), F.count("*").alias("n"))
    return top_n(g, ["package"], [F.desc("period")], most).select("package", "period", F.col("best.release").alias("release"), "n", "pos")


def top_in_category(categories: DataFrame, packages: DataFrame, n: int) -> DataFrame:
    """Per category the ``n`` best by rank times rank weight."""
    c = categories.join(packages.select("package", "rank"), "package").withColumn("value", F.col("rank") * F.col("rank_weight"))
    return top_n(c, ["slug"], [F.desc("value"), F.col("package")], n).select("slug", "package", "value", "pos")


def recently_updated(releases: DataFrame, packages: DataFrame, n: int, least_rank: float = 0.33) -> DataFrame:
    """Packages of two or more releases by newest release plus a week per unit of rank."""
    g = releases.groupBy("package").agg(F.max("created").alias("latest"), F.count("*").alias("n_releases")).where("n_releases >= 2").join(packages.select("package", "rank"), "package").where(F.col("rank") > least_rank)
    return g.withColumn("value", F.unix_timestamp(F.col("latest").cast("timestamp")) + 604800 * F.col("rank")).orderBy(F.desc("value"), "package").limit(n).select("package", "value")


def most_downloaded(packages: DataFrame, n: int) -> DataFrame:
    """E11."""
    return packages.select("package", "downloads").orderBy(F.desc("downloads"), "package").limit(n)


def notable(packages: DataFrame, releases: DataFrame, least: float = 0.25) -> DataFrame:
    """Packages above a rank with their last update."""
    return packages.where(F.col("rank") > least).join(releases.groupBy("package").agg(F.max("created").alias("updated")), "package").select("package", "rank", "updated")


def overdue(packages: DataFrame, as_of: Column, n: int = 1000) -> DataFrame:
    """E13."""
    return packages.where(F.col("next_update") < as_of).orderBy("next_update", "package").limit(n).select("package", "next_update")


def changed_since(releases: DataFrame, since: Column, overdue_packages: DataFrame) -> DataFrame:
    """Packages released since a time, and the overdue ones."""
    new = releases.groupBy("package").agg(F.max("created").alias("latest")).where(F.col("latest") >= since).select("package")
    return new.unionByName(overdue_packages.select("package")).distinct()


def most_popular(monthly: DataFrame, packages: DataFrame, excluded: DataFrame, n: int, least_users: int = 30) -> DataFrame:
    """Packages whose last users hold at least half their peak, by ratio times downloads."""
    m = monthly.groupBy("dep").agg(F.max_by("users", "month").alias("last"), F.max("users").alias("peak")).where((F.col("last") > least_users) & (F.col("last") >= 0.5 * F.col("peak")))
    r = m.withColumnRenamed("dep", "package").join(packages.select("package", "downloads"), "package").join(excluded, "package", "left_anti")
    return r.withColumn("value", F.col("last") / F.col("peak") * F.col("downloads")).orderBy(F.desc("value"), "package").limit(n).select("package", "value")


def diversify(items: DataFrame, owners: DataFrame, keywords: DataFrame) -> DataFrame:
    """Scores lowered for items whose owners and keywords came often before, in score order of each list.

    ``items``: list_id, item, score; ``owners`` and ``keywords``: item, place and
    name, of which the first five count. A list's most common keywords, a tenth
    of its distinct ones within 2 to 10, count only together with an item's first
    owner. ``seen`` before an item is a constant times the rows before it, so
    running counts replace the loop.
    """
    ranked = items.withColumn("place_in_list", F.row_number().over(Window.partitionBy("list_id").orderBy(F.desc("score"), "item")))
    spot = ranked.select("list_id", "item", "place_in_list")
    o = spot.join(owners.where("place < 5").select("item", F.col("owner").alias("name"), F.col("place").alias("rank_of")), "item")
    all_k = spot.join(keywords.select("item", F.col("keyword").alias("name"), F.col("place").alias("rank_of")), "item")
    by_list = Window.partitionBy("list_id")
    uses = all_k.groupBy("list_id", "name").agg(F.count("*").alias("uses")).withColumns({"most": F.row_number().over(by_list.orderBy(F.desc("uses"), "name")), "n": F.count("*").over(by_list)})
    common = uses.where(F.col("most") <= F.greatest(F.lit(2), F.least(F.lit(10), F.floor(F.col("n") / 10)))).select("list_id", "name")
    first_five = all_k.where("rank_of < 5")
    k = first_five.join(common, ["list_id", "name"], "left_anti")
    primary = owners.where("place = 0").select("item", "owner")
    pair = first_five.join(primary, "item", "left").withColumn("name", F.concat_ws("|", F.coalesce("owner", F.lit("")), "name"))

    def penalty(df: DataFrame, grows: int, free: int, weight: int) -> DataFrame:
        before = F.count("*").over(Window.partitionBy("list_id", "name").orderBy("place_in_list").rowsBetween(Window.unboundedPreceding, -1))
        return df.select("list_id", "item", F.greatest(before * grows - free, F.lit(0)).alias("penalty"), F.lit(weight).alias("weight"))

    all_of = penalty(o, 2, 3, 2).unionByName(penalty(k, 1, 4, 1)).unionByName(penalty(pair, 3, 0, 2))
    dupe = all_of.groupBy("list_id", "item").agg((F.sum("penalty") / (F.sum("weight") + 10)).alias("dupe"))
    new = F.round(F.col("score") / 2 + (F.col("score") + 7) / (7 + F.coalesce("dupe", F.lit(0.0))), 6)
    out = ranked.join(dupe, ["list_id", "item"], "left").withColumn("new_score", new)
    return out.withColumn("pos", F.row_number().over(Window.partitionBy("list_id").orderBy(F.desc("new_score"), "item"))).select("list_id", "item", "new_score", "pos")


def category_list_size(categories: DataFrame) -> DataFrame:
    """How many packages a category's page lists."""
    n = F.col("n")
    return categories.groupBy("slug").agg(F.count("*").alias("n")).withColumn("listed", F.greatest(F.lit(100), F.least(F.lit(3000), F.floor((F.floor(n / 2) + 25) / 50) * 50)))


CANDIDATES, PLACES, LETTERS = 35, 8, 140


def _claims(wanted: DataFrame, fits, taken: DataFrame | None = None) -> DataFrame:
    """Packages go to categories one category after the other, each package once.

    ``wanted``: turn (a category's place in the order), package, pos, ...; ``fits(open)`` is a condition on the rows of a
    category that no other has taken, in the order of ``pos``. In a round every category moves whose open candidates no
    earlier open category wants, so the outcome is that of the order and rounds are far fewer than categories.
    """
    left = wanted.join(taken.select("package"), "package", "left_anti") if taken is not None else wanted
    left, done = settled(left), None
    while not left.isEmpty():
        first = F.min("turn").over(Window.partitionBy("package"))
        ready = left.withColumn("first", first).withColumn("free", F.min((F.col("first") == F.col("turn")).cast("int")).over(Window.partitionBy("turn")) == 1)
        moved = settled(fits(ready.where("free").drop("first", "free")))
        done = moved if done is None else done.unionByName(moved)
        left = settled(ready.where("NOT free").drop("first", "free").join(moved.select("package"), "package", "left_anti"))
    return done if done is not None else fits(left)


def category_turns(tree: DataFrame) -> DataFrame:
    """The order in which categories choose: subtrees first, in their given order, then a level's categories from the least popular.

    ``tree``: slug, parent (null at the top), place, own_popularity. A category is as popular as its most popular descendant.
    """
    level = tree.where("parent IS NULL").select("slug", F.array(F.struct("place", "slug")).alias("path"))
    nodes = settled(level.withColumn("depth", F.lit(0)))
    front, depth = nodes, 0
    while not front.isEmpty():
        depth += 1
        below = tree.join(front.select(F.col("slug").alias("parent"), "path"), "parent").select("slug", F.concat("path", F.array(F.struct("place", "slug"))).alias("path"), F.lit(depth).alias("depth"))
        front = settled(below)
        nodes = nodes.unionByName(front)
    named = nodes.join(tree, "slug")
    popular = named.select(F.explode(F.transform("path", lambda p: p["slug"])).alias("slug"), "own_popularity").groupBy("slug").agg(F.max("own_popularity").alias("popularity"))
    # subtrees sort as (0, place) before the level's own choice (1, popularity)
    step = lambda kind, by, slug: F.struct(F.lit(kind).alias("kind"), by.cast("double").alias("by"), slug.alias("slug"))
    above = F.transform(F.slice("path", F.lit(1), F.size("path") - 1), lambda p: step(0, p["place"], p["slug"]))
    key = F.concat(above, F.array(step(1, F.col("popularity"), F.col("slug"))))
    turns = named.join(popular, "slug").withColumn("key", key)
    return turns.select("slug", "parent", "depth", "popularity", F.row_number().over(Window.orderBy("key")).alias("turn"))  # the categories of a site


def home_choices(categories: DataFrame, packages: DataFrame, tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """E18, first half: in the order of ``category_turns`` each category takes, of its 35 best packages, the first 8 that no other took.

    ``categories``: slug, package, pos (from 1, best first). Returns (slug, package, place, downloads) and the turns.
    """
    turns = settled(category_turns(tree))
    best = categories.where(F.col("pos") <= CANDIDATES).join(turns.select("slug", "turn"), "slug").join(packages.select("package", "downloads"), "package").select("turn", "slug", "package", "pos", "downloads")
    numbered = F.row_number().over(Window.partitionBy("turn").orderBy("pos", "package"))
    return settled(_claims(best, lambda d: d.withColumn("place", numbered).where(F.col("place") <= PLACES)).select("slug", "package", "place", "downloads")), turns


def home_categories(categories: DataFrame, packages: DataFrame, tree: DataFrame, adjust: dict[str, float] | None = None, pairs: tuple[tuple[str, str], ...] = ()) -> tuple[DataFrame, DataFrame]:
    """What a home page shows of each category, every package once.

    After ``home_choices`` the categories add, children first and in the order of display, recently updated packages until
    the names fill 140 letters (a letter between two), at least one. ``packages``: package, name, downloads, updated. A
    category's display rank is its popularity times the downloads of its choice (or of its first child's, if more), times
    ``adjust``; the ranks of ``pairs`` are drawn together.

    Returns (slug, package, place, is_recent) and (slug, parent, rank, display).
    """
    top, turns = home_choices(categories, packages, tree)
    own = top.groupBy("slug").agg(F.sum("downloads").alias("own_dl"))
    ranked = None
    for depth in range(turns.agg(F.max("depth")).first()[0] or 0, -1, -1):
        here = turns.where(F.col("depth") == depth).join(own, "slug", "left")
        if ranked is not None:
            child = ranked.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("slug")).agg(F.max(F.struct("rank", F.col("dl").alias("child_dl")))["child_dl"].alias("child_dl"))
            here = here.join(child, "slug", "left")
        else:
            here = here.withColumn("child_dl", F.lit(None).cast("double"))
        dl = F.greatest(F.coalesce("own_dl", F.lit(0)), F.coalesce("child_dl", F.lit(0)))
        factor = F.coalesce(*[F.when(F.col("slug") == s, F.lit(float(x))) for s, x in (adjust or {}).items()], F.lit(1.0))
        here = here.withColumn("dl", dl.cast("double")).withColumn("rank", F.col("dl") * F.col("popularity") * factor)
        for a, b in pairs:
            both = Window.partitionBy("parent")
            of = lambda s: F.max(F.when(F.col("slug") == s, F.col("rank"))).over(both)
            drawn = F.when(F.col("slug") == a, (of(a) * 17 + of(b) * 15) / 32).when(F.col("slug") == b, (of(a) * 15 + of(b) * 17) / 32)
            here = here.withColumn("rank", F.coalesce(drawn, F.col("rank")))
        here = here.select("slug", "parent", "depth", "dl", "rank")
        ranked = settled(here if ranked is None else ranked.unionByName(here))
    shown = ranked.withColumn("display", F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("rank"), "slug")))
    # children first: deeper chains of (display) sort before the category that ends them
    paths = _display_paths(shown)
    recent_turn = paths.select("slug", F.row_number().over(Window.orderBy("key")).alias("turn"))
    used = top.join(packages.select("package", "name"), "package").groupBy("slug").agg(F.sum(F.length("name") + 1).alias("used"))
    news = categories.join(packages.select("package", "name", "updated"), "package").join(recent_turn, "slug").join(used, "slug", "left")
    news = news.withColumn("pos", F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("updated"), "package"))).select("turn", "slug", "package", "pos", (F.length("name") + 1).alias("letters"), F.coalesce("used", F.lit(0)).alias("used"))

    def filling(d: DataFrame) -> DataFrame:
        w = Window.partitionBy("turn").orderBy("pos")
        before = F.coalesce(F.sum("letters").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return d.withColumn("n", F.row_number().over(w)).withColumn("before", F.col("used") + before).where((F.col("n") == 1) | (F.col("before") < LETTERS)).drop("before")

    added = _claims(news, filling, top)
    row = top.select("slug", "package", "place", F.lit(False).alias("is_recent")).unionByName(added.select("slug", "package", F.col("n").alias("place"), F.lit(True).alias("is_recent")))
    return row, shown.select("slug", "parent", "rank", "display")


def _display_paths(shown: DataFrame) -> DataFrame:
    """Sort keys that put a category behind all its descendants, siblings in the order of display."""
    last = F.lit(1 << 30)
    front = shown.where("parent IS NULL").select("slug", F.array("display").alias("path"))
    out = front = settled(front)
    while not front.isEmpty():
        front = settled(shown.join(front.select(F.col("slug").alias("parent"), "path"), "parent").select("slug", F.concat("path", F.array("display")).alias("path")))
        out = out.unionByName(front)
    return out.select("slug", F.concat("path", F.array(last)).alias("key"))


def split_good_bad(results: DataFrame, share: float = 0.33) -> DataFrame:
    """Results of at least ``share`` of the best score are good; the tail keeps 10 + n/2 rows."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    r = results.withColumn("good", F.col("score") >= share * best)
    n_good = F.count(F.when(F.col("good"), 1)).over(Window.partitionBy("query_id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return r.withColumns({"n_good": n_good, "place": place}).where(F.col("good") | (F.col("place") - F.col("n_good") <= 10 + F.floor(F.col("n_good") / 2))).select("query_id", "doc_id", "score", "good")


def dashboard_order(warnings: DataFrame, packages: DataFrame) -> DataFrame:
    """An owner's top eighth of packages by rank first, both parts by (sum of severity² · 1000 + 5000) · rank."""
    s = warnings.groupBy("owner", "package").agg(F.sum(F.col("severity") * F.col("severity")).alias("s2")).join(packages.select("package", "rank"), "package")
    w = Window.partitionBy("owner").orderBy(F.desc("rank"), "package")
    s = s.withColumns({"first": F.row_number().over(w) <= F.ceil(F.count("*").over(Window.partitionBy("owner")) / 8), "value": (F.col("s2") * 1000 + 5000) * F.col("rank")})
    return s.withColumn("pos", F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("first"), F.desc("value"), "package"))).select("owner", "package", "pos")


def founder_member_split(owners: DataFrame, packages: DataFrame, releases: DataFrame, n: int = 200) -> DataFrame:
    """An owner's packages where nobody invited it, by newest release, and the others, by rank."""
    latest = releases.groupBy("package").agg(F.max("created").alias("latest"))
    r = owners.select("owner", "package", F.col("inviter").isNull().alias("founder")).join(packages.select("package", "rank"), "package").join(latest, "package", "left")
    order = [F.desc(F.when(F.col("founder"), F.col("latest"))), F.desc("rank"), F.col("package")]
    return top_n(r, ["owner", "founder"], order, n).select("owner", "founder", "package", "pos")


def new_and_trending(updated: DataFrame, trending: DataFrame, n: int = 40) -> DataFrame:
    """Updated packages, then trending ones that were not shown yet, ``n`` of each."""
    both = updated.select("package", F.col("value"), F.lit(0).alias("part")).unionByName(trending.select("package", F.col("value"), F.lit(1).alias("part")))
    once = both.withColumn("turn", F.row_number().over(Window.partitionBy("package").orderBy("part"))).where("turn = 1")
    return top_n(once, ["part"], [F.desc("value"), F.col("package")], n).select("part", "package", "pos")


def set_differences(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """per key the values only in a, only in b and in both."""
    both = a.select(key, value, F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).distinct().unionByName(b.select(key, value, F.lit(0).alias("in_a"), F.lit(1).alias("in_b")).distinct())
    one = both.groupBy(key, value).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    return one.groupBy(key).agg(F.sum(F.col("in_a") * (1 - F.col("in_b"))).alias("only_a"), F.sum(F.col("in_b") * (1 - F.col("in_a"))).alias("only_b"), F.sum(F.col("in_a") * F.col("in_b")).alias("common"))


def except_known(candidates: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """F4."""
    return candidates.join(known, on, "left_anti")


def dedupe_within_run(df: DataFrame, keys: list[str]) -> DataFrame:
    """F5."""
    return df.dropDuplicates(keys)
