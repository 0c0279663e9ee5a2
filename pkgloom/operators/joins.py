"""Joins over packages, releases, owners and repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import semver
from . import ranges
from .graph import settled

DIGITS = 6  # sums of floats depend on their order; they are rounded before a threshold or a rank sees them


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "pos") -> DataFrame:
    """The first ``n`` rows of every group with their place from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def versions_of(packages: DataFrame, releases: DataFrame, on: str = "package") -> DataFrame:
    """C1."""
    return packages.join(releases, on)


def resolve_owners(owners: DataFrame, users: DataFrame, teams: DataFrame) -> DataFrame:
    """Kind 0 names users (positive ids), kind 1 teams. A missing inviter is the earliest owner; nobody invites themselves."""
    u = users.where("account > 0").select(F.col("account").alias("owner"), F.col("login").alias("user_login"))
    t = teams.select(F.col("account").alias("owner"), F.col("login").alias("team_login"))
    named = owners.join(u, "owner", "left").join(t, "owner", "left").withColumn("login", F.when(F.col("kind") == 0, F.col("user_login")).otherwise(F.col("team_login"))).where(F.col("login").isNotNull())
    first = F.first("owner").over(Window.partitionBy("package").orderBy("invited_at", "kind", "owner"))
    inviter = F.coalesce(F.col("inviter"), first)
    return named.withColumn("inviter", F.when(inviter != F.col("owner"), inviter)).select("package", "owner", "kind", "login", "inviter", "invited_at")


def resolve_email(emails: DataFrame, users: DataFrame) -> DataFrame:
    """An automatic address names its login; otherwise the exact address, then the one without +tag; newest user row of each."""
    newest = users.withColumn("_n", F.row_number().over(Window.partitionBy("email").orderBy(F.desc("seen"), "account"))).where("_n = 1").select("email", "account")
    logins = users.withColumn("_n", F.row_number().over(Window.partitionBy("login").orderBy(F.desc("seen"), "account"))).where("_n = 1").select("login", F.col("account").alias("by_login"))
    e = emails.select("email").distinct().withColumn("login", F.nullif(F.regexp_extract("email", r"^(?:[0-9]+\+)?([^@+]+)@users\.noreply\.", 1), F.lit(""))).withColumn("plain", F.regexp_replace("email", r"\+[^@]*@", "@"))
    exact, plain = newest.withColumnRenamed("account", "by_email"), newest.select(F.col("email").alias("plain"), F.col("account").alias("by_plain"))
    return e.join(logins, "login", "left").join(exact, "email", "left").join(plain, "plain", "left").select("email", F.coalesce("by_login", "by_email", "by_plain").alias("account"))


def nearest_ancestor(paths: DataFrame, repos: DataFrame | None = None, repo: str = "repo", path: str = "path", package: str = "package") -> DataFrame:
    """The package at the longest proper path prefix in a repository, "" being the root; else, with ``repos``, the one at the path of the repository's name, then its owner's.

    ``repos``: repo, repo_name, owner_name. A path holds one package (the smallest of several); the only package of a
    repository has no parent.
    """
    from .clean import unprefix

    one = paths.groupBy(repo, path).agg(F.min(package).alias(package))
    one = one.join(one.groupBy(repo).agg(F.count("*").alias("_n")), repo)
    depth = F.when(F.col(path) == "", 0).otherwise(F.size(F.split(path, "/")))
    ups = one.where(depth > 0).select(repo, package, path, F.explode(F.sequence(F.lit(0), depth - 1)).alias("cut"))
    ups = ups.withColumn("up", F.array_join(F.slice(F.split(path, "/"), 1, F.col("cut")), "/"))
    held = one.select(repo, F.col(path).alias("up"), F.col(package).alias("parent"))
    above = ups.join(held, [repo, "up"]).groupBy(repo, path).agg(F.max_by("parent", "cut").alias("above"))
    out = one.join(above, [repo, path], "left")
    if repos is not None:
        tries = repos.select(repo, F.posexplode(F.array("repo_name", unprefix(F.col("repo_name")), "owner_name", unprefix(F.col("owner_name")))).alias("try", "up"))
        hits = tries.join(held, [repo, "up"]).groupBy(repo).agg(F.sort_array(F.collect_set(F.struct("try", "up", "parent"))).alias("hits"))  # four at most
        out = out.join(hits, repo, "left").withColumn("above", F.coalesce("above", F.get(F.filter("hits", lambda h: h["up"] != F.col(path)), 0)["parent"]))
    return out.select(repo, package, F.when(F.col("_n") > 1, F.col("above")).alias("parent"))


def prefix_parent(names: DataFrame, name: str = "name") -> DataFrame:
    """The longest existing name left after cutting at a later dash or underscore."""
    cuts = names.select(name, F.explode(F.expr(f"filter(transform(sequence(1, length({name})), i -> CASE WHEN substr({name}, i, 1) IN ('-', '_') THEN i END), i -> i > 1)")).alias("at"))
    stems = cuts.withColumn("stem", F.substring(F.col(name), F.lit(1), F.col("at") - 1))
    found = stems.join(names.select(F.col(name).alias("stem")).distinct(), "stem").groupBy(name).agg(F.max_by("stem", "at").alias("parent"))
    return names.select(name).distinct().join(found, name, "left")


def sub_components(names: DataFrame, suffixes: list[str], name: str = "name") -> DataFrame:
    """Names that end in -suffix and whose stem is a name itself."""
    stem = F.regexp_replace(name, rf"[-_](?:{'|'.join(suffixes)})$", "")
    cut = names.select(name, stem.alias("stem")).where(F.col("stem") != F.col(name))
    return cut.join(names.select(F.col(name).alias("stem")).distinct(), "stem", "left_semi").select(name, "stem")


INTERNAL = ("private", "internals", "internal", "impl")  # fixed values


def internal_packages(names: DataFrame, suffixes: tuple[str, ...] = INTERNAL) -> DataFrame:
    """Names whose last part says that they are inner parts of a package that exists, the name before that part."""
    whole = r"^(.+)[-_]([^-_]*)$"
    told = names.select("name", F.regexp_extract("name", whole, 1).alias("parent"), F.regexp_extract("name", whole, 2).alias("suffix")).where(F.col("suffix").isin(*suffixes))
    return told.join(names.select(F.col("name").alias("parent")).distinct(), "parent", "left_semi").select("name", "parent")


def verified_repo(packages: DataFrame, repo_packages: DataFrame) -> DataFrame:
    """Packages whose repository lists them under their name."""
    return packages.join(repo_packages, ["repo", "name"], "left_semi")


def in_external_list(packages: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """C10."""
    return packages.join(names, name, "left_semi")


def worst_advisory(releases: DataFrame, advisories: DataFrame) -> DataFrame:
    """C11: the most severe advisory whose affected range [low, high) holds the release; withdrawn and unrated ones are ignored."""
    live = advisories.where(~F.col("withdrawn") & F.col("severity").isNotNull()).select("package", "low", "high", F.struct("severity", "advisory").alias("w"))
    hit = ranges.stabbed(ranges.place(releases.select("package", "release", "sort_key"), live), live, "w")
    return hit.groupBy("package", "release").agg(F.max("w").alias("w")).select("package", "release", F.col("w.advisory").alias("advisory"), F.col("w.severity").alias("severity"))


def blocked_packages(owners: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Packages with a listed owner, the reasons, and whether every owner is listed."""
    marked = owners.select("package", "owner").distinct().join(blocklist.groupBy("owner").agg(F.min("reason").alias("reason")), "owner", "left")
    return marked.groupBy("package").agg(F.count("reason").alias("n_blocked"), F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"), F.bool_and(F.col("reason").isNotNull()).alias("all_blocked")).where("n_blocked > 0")


def uncategorized(packages: DataFrame, categories: DataFrame, n: int) -> DataFrame:
    """The top ``n`` packages by rank that have no category."""
    return packages.join(categories.select("package").distinct(), "package", "left_anti").orderBy(F.desc("rank"), "package").limit(n)


def related_by_keyword(keywords: DataFrame, packages: DataFrame, min_downloads: int, min_weight: float, n: int = 15) -> DataFrame:
    """C14: per package the ``n`` packages with the largest sum of weight products over shared keywords.

    Packages with the same keywords and weights form a class: classes are compared instead of packages. Of the candidates of
    a class, whose scores are equal, only the ``n + 1`` smallest can be among the first ``n`` of any package, and of the
    classes only the best ``n + 1``; a package's list is that of its class without itself.
    """
    k = keywords.where("package IS NOT NULL AND keyword IS NOT NULL")
    bags = k.groupBy("package").agg(F.sort_array(F.collect_list(F.struct("keyword", "weight"))).alias("bag"))  # the keywords of one package
    classes = bags.groupBy("bag").agg(F.min("package").alias("class"))
    members = settled(bags.join(classes, "bag").select("package", "class"))
    liked = members.join(packages.where(F.col("downloads") > min_downloads).select("package"), "package", "left_semi")
    first = top_n(liked, ["class"], [F.col("package")], n + 1).groupBy("class").agg(F.sort_array(F.collect_list("package")).alias("first"))
    words = settled(classes.select("class", F.inline("bag")).groupBy("class", "keyword").agg(F.sum("weight").alias("weight")))
    other = words.join(first, "class", "left_semi").select(F.col("class").alias("other"), "keyword", F.col("weight").alias("w2"))
    sums = words.join(other, "keyword").groupBy("class", "other").agg(F.round(F.sum(F.col("weight") * F.col("w2")), DIGITS).alias("score")).where(F.col("score") > min_weight)
    best = top_n(sums.join(first.withColumnRenamed("class", "other"), "other"), ["class"], [F.desc("score"), F.col("first")[0]], n + 1)
    rows = top_n(best.select("class", "score", F.explode("first").alias("related")), ["class"], [F.desc("score"), F.col("related")], n + 1)
    lists = rows.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("pos", "related", "score"))).alias("list"))
    mine = F.slice(F.filter("list", lambda x: x["related"] != F.col("package")), 1, n)
    return members.join(lists, "class").select("package", F.posexplode(mine).alias("pos", "x")).select("package", "x.related", "x.score", (F.col("pos") + 1).alias("pos"))


def related_categories(categories: DataFrame, min_weight: float, n: int = 6) -> DataFrame:
    """Per category the ``n`` that share most relevance over common packages."""
    other = categories.select("package", F.col("slug").alias("related"), F.col("relevance").alias("r2"))
    pairs = categories.join(other, "package").where("slug != related")
    sums = pairs.groupBy("slug", "related").agg(F.round(F.sum(F.col("relevance") * F.col("r2")), DIGITS).alias("score")).where(F.col("score") > min_weight)
    return top_n(sums, ["slug"], [F.desc("score"), F.col("related")], n)


def common_owners(owners: DataFrame, pairs: DataFrame, excluded: DataFrame) -> DataFrame:
    """For pairs (a, b) the owners in common and the owners of a, without excluded accounts."""
    fine = owners.select("package", "owner").distinct().join(excluded, "owner", "left_anti")
    left, right = fine.select(F.col("package").alias("a"), "owner"), fine.select(F.col("package").alias("b"), "owner", F.lit(1).alias("hit"))
    both = pairs.join(left, "a").join(right, ["b", "owner"], "left")
    return both.groupBy("a", "b").agg(F.count("hit").alias("n_common"), F.count("*").alias("n_a"))


def resolve_dependency(deps: DataFrame, releases: DataFrame) -> DataFrame:
    """C20: the newest-published release in [low, high) that is not yanked, else the most recent release of the package."""
    r = releases.select("package", "release", "sort_key", "created", "yanked")
    found = ranges.aggregated(ranges.place(r.where("NOT yanked"), deps), newest=(F.struct("created", "release"), F.max))
    recent = r.groupBy("package").agg(F.max(F.struct("created", "release")).alias("recent"))
    both = deps.join(found, ["package", "low", "high"], "left").join(recent, "package", "left")
    return both.select("dep_id", "package", F.coalesce("newest", "recent")["release"].alias("release"), F.col("newest").isNotNull().alias("matched"))


def matching_extremes(deps: DataFrame, releases: DataFrame) -> DataFrame:
    """The highest and lowest matching release; of releases with equal keys the larger one above and the smaller one below."""
    one = F.struct("sort_key", "release")
    found = ranges.aggregated(ranges.place(releases.select("package", "sort_key", "release"), deps), highest=(one, F.max), lowest=(one, F.min)).where("highest IS NOT NULL")
    best = deps.join(found, ["package", "low", "high"]).groupBy("dep_id").agg(F.max("highest").alias("highest"), F.min("lowest").alias("lowest"))
    return best.select("dep_id", F.col("highest.release").alias("highest"), F.col("lowest.release").alias("lowest"))


def asof_version_downloads(selected: DataFrame, downloads: DataFrame) -> DataFrame:
    """Each download row goes to the next selected version at or above it, if of the same compatibility class."""
    rows = selected.select("package", "sort_key", "compat", F.lit(True).alias("picked"), F.lit(0).cast("double").alias("n")).unionByName(downloads.select("package", "sort_key", "compat", F.lit(False).alias("picked"), "n"))
    up = Window.partitionBy("package").orderBy(F.desc("sort_key"), F.desc("picked")).rowsBetween(Window.unboundedPreceding, 0)
    target = F.last(F.when(F.col("picked"), F.struct("sort_key", "compat")), ignorenulls=True).over(up)
    dealt = rows.withColumn("t", target).where("NOT picked AND t.compat = compat")
    return dealt.groupBy("package", F.col("t.sort_key").alias("sort_key")).agg(F.sum("n").alias("downloads"))


def upgrade_target(deps: DataFrame, releases: DataFrame) -> DataFrame:
    """The newest stable release at or above the highest match, else the newest pre-release; without a match, of all releases.

    ``target_version`` has patch 0 for a stable target from 1.1 on whose patch is below 10.
    All releases above are the package's last ones, so its newest stable and its newest release of all answer every requirement.
    """
    r = releases.where("sort_key IS NOT NULL").select("package", "release", "version", "sort_key", "is_pre")
    highest = ranges.aggregated(ranges.place(r.select("package", "sort_key"), deps), matched=(F.col("sort_key"), F.max))
    one = F.struct("sort_key", "release", "version")
    last = r.groupBy("package").agg(F.max(F.when(~F.col("is_pre"), one)).alias("stable"), F.max(one).alias("any"))
    both = deps.join(highest, ["package", "low", "high"], "left").join(last, "package")
    stable = F.col("stable").isNotNull() & (F.col("matched").isNull() | (F.col("stable.sort_key") >= F.col("matched")))
    v = semver.parse(F.col("t.version"))
    short = v["pre"].isNull() & (v["major"] > 0) & (v["minor"] > 0) & (v["patch"] < 10)
    plain = F.regexp_replace("t.version", r"\+.*$", "")
    best = both.select("dep_id", F.when(stable, F.struct(F.lit(1).alias("is_stable"), "stable.*")).otherwise(F.struct(F.lit(0).alias("is_stable"), "any.*")).alias("t")).groupBy("dep_id").agg(F.max("t").alias("t"))
    return best.select("dep_id", F.col("t.release").alias("target"), F.when(short, F.regexp_replace(plain, r"[0-9]+$", "0")).otherwise(plain).alias("target_version"))


def rev_deps_table(deps: DataFrame, packages: DataFrame, n: int = 1000) -> DataFrame:
    """Per package its dependers with downloads and kind, most downloaded first."""
    rows = deps.join(packages.select(F.col("package").alias("depender"), "downloads"), "depender")
    one = rows.groupBy("package", "depender").agg(F.max("downloads").alias("downloads"), F.bool_and("optional").alias("optional"), F.min("kind").alias("kind"))
    return top_n(one, ["package"], [F.col("optional"), F.desc("downloads"), F.col("depender")], n)
