"""Aggregations over packages, releases and owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import DIGITS, top_n


def latest_timestamp(releases: DataFrame) -> DataFrame:
    """D1."""
    return releases.agg(F.max("created").alias("latest"))


def owner_summary(owners: DataFrame) -> DataFrame:
    """Per owner the first invitation and the number of packages."""
    return owners.groupBy("owner").agg(F.min("invited_at").alias("first_invited"), F.count("*").alias("n_packages"))


def packages_of_owner(owners: DataFrame, releases: DataFrame, packages: DataFrame, n: int = 2000) -> DataFrame:
    """D3: per owner its packages with newest release and rank, newest first."""
    newest = releases.groupBy("package").agg(F.max("created").alias("latest"))
    rows = owners.select("owner", "package", "invited_at").join(newest, "package").join(packages.select("package", "rank"), "package")
    return top_n(rows, ["owner"], [F.desc("latest"), F.col("package")], n)


def keyword_count(keywords: DataFrame, populated: int = 3, real: int = 5) -> DataFrame:
    """Explicit uses of every keyword, whether it is populated and a keyword proper."""
    n = keywords.where("visible").groupBy("keyword").agg(F.count("*").alias("n"))
    return n.withColumns({"is_populated": F.col("n") >= populated, "is_keyword": F.col("n") >= real})


def popular_keywords(keywords: DataFrame, n: int) -> DataFrame:
    """Visible keywords by the sum of weights times uses."""
    sums = keywords.where("visible").groupBy("keyword").agg(F.round(F.sum("weight") * F.count("*"), DIGITS).alias("score"))
    return sums.orderBy(F.desc("score"), "keyword").limit(n)


def category_counts(categories: DataFrame) -> DataFrame:
    """D6."""
    return categories.groupBy("slug").agg(F.count("*").alias("n"), F.sum("rank_weight").alias("weight"))


def keywords_in_category(categories: DataFrame, keywords: DataFrame, obvious: DataFrame, least_weight: float = 7, least_count: int = 4, wide: int = 12, n: int = 10) -> DataFrame:
    """Per category its heaviest keywords that are not obvious for it."""
    rows = categories.select("package", "slug", "relevance").join(keywords.where("visible").select("package", "keyword", "weight"), "package")
    sums = rows.groupBy("slug", "keyword").agg(F.sum(F.col("weight") * F.col("relevance")).alias("score"), F.sum("weight").alias("total"), F.count("*").alias("n")).where((F.col("total") > least_weight) & (F.col("n") >= least_count))
    first = top_n(sums, ["slug"], [F.desc("score"), F.col("keyword")], wide, "wide_pos").join(obvious, ["slug", "keyword"], "left_anti")
    return top_n(first, ["slug"], [F.desc("score"), F.col("keyword")], n).select("slug", "keyword", "score", "pos")


def replacements(changes: DataFrame, least: float = 20, n: int = 4) -> DataFrame:
    """Per package what replaced it most."""
    sums = changes.where("replacement IS NOT NULL").groupBy("package", "replacement").agg(F.round(F.sum("weight"), DIGITS).alias("weight")).where(F.col("weight") > least)
    return top_n(sums, ["package"], [F.desc("weight"), F.col("replacement")], n)


def dependency_changes(history: DataFrame, commits: int = 1000) -> DataFrame:
    """Replacement, removal and joint-addition weights from a repository's last ``commits`` dependency sets.

    ``history``: repo, committed, deps array; equal times are one commit, age 0 is the newest. Of a package's runs of
    commits only the most recent counts: it is added at the commit before the run (never, if the history begins with it) and
    removed at the run's last commit (never, if that is the newest). Runs are found per (repository, package), so no row
    holds more than one commit's packages. Of many added together the first by name are paired, 8 with 5.
    """
    ages = history.select("repo", "committed").distinct().withColumn("age", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("committed"))) - 1).where(F.col("age") < commits)
    known = ages.groupBy("repo").agg(F.max("age").alias("oldest"))
    held = history.select("repo", "committed", F.explode("deps").alias("package")).distinct().join(ages, ["repo", "committed"])
    per = Window.partitionBy("repo", "package").orderBy("age")
    run = held.withColumn("skipped", F.col("age") - F.row_number().over(per) + 1).withColumn("newest", F.min("age").over(Window.partitionBy("repo", "package"))).where("skipped = newest")
    runs = run.groupBy("repo", "package").agg(F.min("age").alias("removed_at"), (F.max("age") + 1).alias("added_at")).join(known, "repo")
    moves = F.array(F.struct(F.lit(True).alias("is_added"), F.col("added_at").alias("age")), F.struct(F.lit(False).alias("is_added"), F.col("removed_at").alias("age")))
    events = runs.select("repo", "package", "oldest", F.inline(moves)).where(F.when(F.col("is_added"), F.col("age") <= F.col("oldest")).otherwise(F.col("age") > 0))
    names = lambda which: F.sort_array(F.collect_set(F.when(which, F.col("package"))))
    c = events.groupBy("repo", "age").agg(names(F.col("is_added")).alias("added"), names(~F.col("is_added")).alias("removed")).withColumn("n", F.size("added"))  # one commit's packages
    swap = c.select(F.explode("removed").alias("package"), "added", "n").select("package", F.explode("added").alias("replacement"), (8 / (7 + F.col("n"))).alias("weight"))
    gone = c.select(F.explode("removed").alias("package"), F.lit(None).cast("string").alias("replacement"), F.when(F.col("n") > 0, 8 / (7 + F.col("n"))).otherwise(0.95).alias("weight"))
    joint = c.where("size(removed) = 0 AND n > 1").withColumn("weight", 1 / (F.col("n") * F.col("n")) * 30 / (30 + F.col("age"))).where("weight > 0.002").select(F.explode(F.slice("added", 1, 8)).alias("package"), "added", "weight")
    joint = joint.select("package", F.explode(F.slice("added", 1, 5)).alias("replacement"), "weight").where("package != replacement")
    return swap.unionByName(gone).unionByName(joint)


def first_seen_version(history: DataFrame) -> DataFrame:
    """D10."""
    return history.groupBy("package", "version").agg(F.min("committed").alias("first_seen"))


def histogram(df: DataFrame, value: str, example: str, k: int = 5, order: list[Column] | None = None) -> DataFrame:
    """Rows per value and the first ``k`` examples; a window keeps the examples of a hot value bounded."""
    place = F.row_number().over(Window.partitionBy(value).orderBy(*(order or []), F.col(example)))
    few = df.select(value, example, place.alias("_n")).where(F.col("_n") <= k).groupBy(value).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", F.col(example).alias("e")))), lambda s: s["e"].cast("string")), ",").alias("examples"))
    return df.groupBy(value).agg(F.count("*").alias("n")).join(few, value)


def release_histograms(releases: DataFrame, deps: DataFrame, as_of: Column, k: int = 5) -> DataFrame:
    """Seven histograms over packages with a live release, in one long table of histogram, bucket, n and k examples.

    ``releases``: package, release, created, yanked, size, license; ``deps``:
    release, n_deps. Age, maintenance and languish are weeks of the first and the
    last release, yanked ones included; a package of two releases or more was
    maintained for a week at least. Sizes are in thousands of bytes, above five
    millions in steps of 500. Sizes, deps and licenses are the last release's; a
    null size is left out. Buckets are text, as licenses are.
    """
    last = F.max_by(F.struct("release", "created", "size", "license"), "release")
    per = releases.groupBy("package").agg(F.count_if(~F.col("yanked")).alias("live"), F.count("*").alias("n"), F.min_by("created", "release").alias("first"), last.alias("last")).where("live > 0")
    per = per.withColumn("release", F.col("last.release")).join(deps, "release", "left")
    weeks = lambda a, b: F.floor(F.datediff(a, b) / 7)
    size, created = F.col("last.size"), F.col("last.created")
    values = {
        "releases": F.col("live"), "age": weeks(as_of, F.col("first")), "languish": weeks(as_of, created), "deps": F.coalesce("n_deps", F.lit(0)), "licenses": F.col("last.license"),
        "maintenance": F.when(F.col("n") == 1, 0).otherwise(F.greatest(weeks(created, F.col("first")), F.lit(1))), "sizes": F.when(size > 5_000_000, F.floor(size / 500_000) * 500).otherwise(F.floor(size / 1000)),
    }
    stacked = per.select("package", F.explode(F.create_map(*[x for name, v in values.items() for x in (F.lit(name), v.cast("string"))])).alias("histogram", "bucket")).where("bucket IS NOT NULL")
    keys = ["histogram", "bucket"]
    placed = stacked.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("package")))
    few = placed.where(F.col("_n") <= k).groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list("package")), lambda p: p.cast("string")), ",").alias("examples"))
    return stacked.groupBy(*keys).agg(F.count("*").alias("n")).join(few, keys)


def bucketize(hist: DataFrame, thresholds: list[int], value: str = "value", count: str = "n") -> DataFrame:
    """Counts per bucket [threshold, next); smaller values go to the first, larger to the last bucket."""
    t = sorted(thresholds)
    label = F.lit(t[0])
    for x in t[1:]:
        label = F.when(F.col(value) >= x, F.lit(x)).otherwise(label)
    return hist.groupBy(label.alias("bucket")).agg(F.sum(count).alias("n"))


def owner_package_histogram(owners: DataFrame, excluded: DataFrame) -> DataFrame:
    """Owners by number of packages, without excluded accounts."""
    per = owners.join(excluded, "owner", "left_anti").groupBy("owner").agg(F.count_distinct("package").alias("n_packages"))
    return histogram(per, "n_packages", "owner")


def compiler_support_shares(ranges: DataFrame, compilers: list[int]) -> DataFrame:
    """Per compiler how many packages are bad, ok or unknown; the compilers are a short list, exploded per row."""
    c = ranges.select("package", "newest_bad", "oldest_ok", F.explode(F.array(*map(F.lit, compilers))).alias("compiler"))
    bad, ok = F.col("compiler") <= F.col("newest_bad"), F.col("compiler") >= F.col("oldest_ok")
    return c.groupBy("compiler").agg(F.count_if(F.coalesce(bad, F.lit(False))).alias("bad"), F.count_if(F.coalesce(ok, F.lit(False)) & ~F.coalesce(bad, F.lit(False))).alias("ok"), F.count_if(~F.coalesce(bad, F.lit(False)) & ~F.coalesce(ok, F.lit(False))).alias("unknown"))


def name_capitalisation(sentences: DataFrame, key: str = "package", text: str = "text", name: str = "name") -> DataFrame:
    """The spelling of a name that its texts use most; a word at a sentence's begin counts half."""
    words = sentences.select(key, name, F.posexplode(F.split(text, r"[^\p{L}\p{N}_-]+")).alias("pos", "word")).where(F.lower("word") == F.lower(name))
    votes = words.groupBy(key, "word").agg(F.sum(F.when(F.col("pos") == 0, 0.5).otherwise(1.0)).alias("votes"))
    return votes.groupBy(key).agg(F.max(F.struct("votes", "word")).alias("w")).select(key, F.col("w.word").alias("spelling"), F.col("w.votes").alias("votes"))


def language_share(stats: DataFrame, most: float = 0.9) -> DataFrame:
    """Share of code per language, for packages whose main language has less than ``most``."""
    w = Window.partitionBy("package")
    share = stats.withColumn("share", F.col("code") / F.sum("code").over(w)).withColumn("top", F.max("share").over(w))
    return share.where(F.col("top") < most).select("package", "language", "share")


def dep_weighted_size(closure: DataFrame, sizes: DataFrame) -> DataFrame:
    """Typical and minimal weight of a package's closure."""
    c = closure.join(sizes, "dep")
    base = F.when(F.col("is_default"), 1.0).when(F.col("direct"), 0.25).otherwise(0.15)
    kind = F.when(F.col("kind") == "runtime", 1.0).when((F.col("kind") == "build") & F.col("is_default") & (F.col("size") > 1_000_000), 1.0).otherwise(0.1)
    rare = 1 - F.col("commonality")
    typical = F.col("size") * base * rare * F.when(F.col("is_macro"), 0.1).otherwise(1.0) * kind
    minimal = F.when(F.col("is_default") & ~F.col("is_macro") & (F.col("kind") == "runtime"), F.col("size") * rare * rare).otherwise(0.0)
    return c.groupBy("package").agg(F.round(F.sum(typical), DIGITS).alias("typical"), F.round(F.sum(minimal), DIGITS).alias("minimal"))


def release_counts(releases: DataFrame, as_of: Column, recent_days: int = 280) -> DataFrame:
    """Releases by kind of change against the previous one, in version order; also those of the last 40 weeks."""
    w = Window.partitionBy("package").orderBy("sort_key", "release")
    r = releases.where("NOT yanked").withColumn("prev", F.lag(F.struct("compat", "is_pre")).over(w))
    breaking = F.col("prev").isNotNull() & (F.col("prev.compat") != F.col("compat"))
    recent = F.datediff(as_of, F.col("created")) <= recent_days
    return r.withColumns({"breaking": breaking, "recent": recent}).groupBy("package").agg(
        F.count("*").alias("total"), F.count_if(F.col("stability") == "stable").alias("stable"), F.count_if("breaking").alias("breaking"),
        F.count_if(F.col("prev").isNotNull() & ~F.col("breaking")).alias("patch"), F.count_if("is_pre").alias("pre"),
        F.count_if("recent").alias("total_recent"), F.count_if(F.col("recent") & F.col("breaking")).alias("breaking_recent"),
    )


def version_usage(resolved: DataFrame) -> DataFrame:
    """Dependents of every release."""
    return resolved.groupBy("package", "release").agg(F.count("*").alias("n_dependents"))


def contribution_by_login(weeks: DataFrame) -> DataFrame:
    """Sum over weeks of commits and the root of changed lines; bots are left out."""
    human = weeks.where(~F.col("login").rlike(r"(\[bot\]|-bot)$"))
    return human.groupBy("login").agg(F.sum(F.greatest("commits", F.lit(0)) + F.sqrt(F.col("added") + 2 * F.col("deleted"))).alias("contribution"))


def author_keywords(owners: DataFrame, packages: DataFrame, keywords: DataFrame, n: int = 7) -> DataFrame:
    """Per owner keywords by the sum of (rank + .5) / (place + 2)."""
    rows = owners.select("owner", "package").distinct().join(packages.select("package", "rank"), "package").join(keywords.select("package", "keyword", "place"), "package")
    sums = rows.groupBy("owner", "keyword").agg(F.round(F.sum((F.col("rank") + 0.5) / (F.col("place") + 2)), DIGITS).alias("score"))
    return top_n(sums, ["owner"], [F.desc("score"), F.col("keyword")], n)


def collaborators(owners: DataFrame, packages: DataFrame, n: int = 100) -> DataFrame:
    """Per owner the others it shares packages with, by the sum of rank + .5."""
    o = owners.select("owner", "package").distinct().join(packages.select("package", "rank"), "package")
    # two owners share the same packages from either side, so only the one before the other sums them: it gets those behind
    # it in a package's order as one array, and the sum goes to both
    groups = o.where("owner IS NOT NULL").groupBy("package").agg(F.sort_array(F.collect_list(F.struct("owner", "rank"))).alias("members"))
    listed = groups.select("members", F.col("members.owner").alias("others"))  # before the members are told apart: once a package
    dealt = listed.select(F.posexplode("members").alias("at", "m"), "others")
    dealt = dealt.select("m.owner", "m.rank", F.slice("others", F.col("at") + 2, F.size("others")).alias("others")).where("size(others) > 0").repartition("owner")
    pairs = dealt.select("owner", "rank", F.explode("others").alias("other")).where("owner != other")
    sums = pairs.groupBy("owner", "other").agg(F.round(F.sum(F.col("rank") + 0.5), DIGITS).alias("score"))
    both = sums.select(F.inline(F.array(F.struct("owner", "other"), F.struct(F.col("other").alias("owner"), F.col("owner").alias("other")))), "score")
    return top_n(both, ["owner"], [F.desc("score"), F.col("other")], n)


def top_result_keywords(results: DataFrame, most_share: float = 0.5, letters: int = 75) -> DataFrame:
    """Per query keywords of more than one result that are not obvious, while their texts fit ``letters``."""
    total = results.groupBy("query_id").agg(F.count_distinct("doc_id").alias("n_results"))
    sums = results.groupBy("query_id", "keyword").agg(F.count("*").alias("n"), F.round(F.sum("score"), DIGITS).alias("score")).join(total, "query_id").where((F.col("n") > 1) & (F.col("n") < F.col("n_results") * most_share))
    used = F.sum(F.length("keyword") + 1).over(Window.partitionBy("query_id").orderBy(F.desc("score"), "keyword"))
    return sums.withColumn("letters", used).where(F.col("letters") <= letters).select("query_id", "keyword", "score")


def warning_groups(warnings: DataFrame, least: int = 3) -> DataFrame:
    """A warning shared by at least ``least`` packages becomes one row."""
    g = warnings.groupBy("owner", "title").agg(F.count_distinct("package").alias("n"), F.max("severity").alias("severity"), F.min("package").alias("first_package"))
    return g.where(F.col("n") >= least)


def total_owners_by_month(owners: DataFrame) -> DataFrame:
    """Owners known by the end of each month; monthly sums first, so the running window has one row a month."""
    first = owners.groupBy("owner").agg(F.min(F.trunc("invited_at", "month")).alias("month"))
    months = first.groupBy("month").agg(F.count("*").alias("joined"))
    return months.withColumn("total", F.sum("joined").over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)))
