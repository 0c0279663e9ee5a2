"""People and projects around a package."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import common_owners, top_n


def merge_people(authors: DataFrame, owners: DataFrame, contributors: DataFrame, n: int = 15) -> DataFrame:
    """C4: one row per (package, person) of all three sources; owners and authors first, then by contribution; the top ``n``.

    ``authors`` and ``owners``: package, person; ``contributors``: package,
    person, contribution. ``n_passive`` counts those left out.
    """
    a = authors.select("package", "person").distinct().withColumn("is_author", F.lit(True))
    o = owners.select("package", "person").distinct().withColumn("is_owner", F.lit(True))
    c = contributors.groupBy("package", "person").agg(F.sum("contribution").alias("contribution"))
    both = a.join(o, ["package", "person"], "full_outer").join(c, ["package", "person"], "full_outer")
    both = both.select("package", "person", F.coalesce("is_author", F.lit(False)).alias("is_author"), F.coalesce("is_owner", F.lit(False)).alias("is_owner"), F.coalesce("contribution", F.lit(0.0)).alias("contribution"))
    value = F.col("contribution") + F.when(F.col("is_owner"), 100).otherwise(0) + F.when(F.col("is_author"), 50).otherwise(0)
    both = both.withColumns({"value": value, "n_people": F.count("*").over(Window.partitionBy("package"))})
    return top_n(both, ["package"], [F.desc("value"), F.col("person")], n).withColumn("n_passive", F.greatest(F.col("n_people") - n, F.lit(0))).drop("n_people", "value")


def owners_from_audit(owners: DataFrame, actions: DataFrame) -> DataFrame:
    """Past publishers join the owners as contributors; the newest action's user counts as owner."""
    newest = Window.partitionBy("package").orderBy(F.desc("at"), "person")
    acts = actions.withColumn("is_last", F.row_number().over(newest) == 1).groupBy("package", "person").agg(F.max("at").alias("last_seen"), F.max("is_last").alias("is_last"))
    both = owners.select("package", "person", "invited_at").join(acts, ["package", "person"], "full_outer")
    return both.select("package", "person", (F.col("invited_at").isNotNull() | F.coalesce("is_last", F.lit(False))).alias("is_owner"), F.greatest("invited_at", "last_seen").alias("last_seen"))


def namespace_related(pairs: DataFrame, owners: DataFrame, excluded: DataFrame, repos: DataFrame) -> DataFrame:
    """C17: for pairs (a, b, commonality) a third of the commonality times the owners' overlap, or a tenth of it within one verified repository owner."""
    overlap = common_owners(owners, pairs.select("a", "b"), excluded)
    own = lambda c: repos.select(F.col("package").alias(c), F.col("repo_owner").alias(f"repo_{c}"))
    p = pairs.join(overlap, ["a", "b"], "left").join(own("a"), "a", "left").join(own("b"), "b", "left")
    shared = F.col("commonality") / 3 * F.coalesce(F.col("n_common") / F.col("n_a"), F.lit(0.0))
    same = F.coalesce(F.col("repo_a") == F.col("repo_b"), F.lit(False))
    return p.select("a", "b", F.greatest(shared, F.when(same, 0.1 * F.col("commonality")).otherwise(0.0)).alias("relation"))


def same_project_candidates(packages: DataFrame, owners: DataFrame, n: int = 20) -> DataFrame:
    """Packages of the same repository (weight 1), and of a common owner under a common first name part (weight .5).

    ``packages``: package, repo, prefix, one row a package. Cut off below min(.2, best/3). Of a group only the ``n + 1``
    smallest members are made pairs of: apart from the package itself and those of a larger weight, which groups of owner,
    prefix and repository bring, no more can be among its first ``n``.
    """
    p = packages.select("package", "repo", "prefix")
    o = owners.select("package", "owner").distinct().join(p, "package")

    def pairs(df: DataFrame, by: list[str]) -> DataFrame:
        first = top_n(df, by, [F.col("package")], n + 1).groupBy(*by).agg(F.collect_list(F.struct(F.col("package").alias("other"), F.col("repo").alias("its_repo"))).alias("first"))
        return df.select("package", "repo", *[c for c in by if c != "repo"]).join(first, by).select("package", "repo", F.inline("first"))

    same = F.coalesce(F.col("repo") == F.col("its_repo"), F.lit(False))
    by_owner = pairs(o, ["owner", "prefix"]).unionByName(pairs(o.where("repo IS NOT NULL"), ["owner", "prefix", "repo"])).select("package", "other", same.alias("same"), F.lit(True).alias("own"))
    by_repo = pairs(p.where("repo IS NOT NULL"), ["repo"]).select("package", "other", F.lit(True).alias("same"), F.lit(False).alias("own"))
    weight = F.when(F.bool_or("same"), 1.0).otherwise(0.0) + F.when(F.bool_or("own"), 0.5).otherwise(0.0)
    sums = by_repo.unionByName(by_owner).where("package != other").groupBy("package", "other").agg(weight.alias("weight"))
    sums = sums.withColumn("best", F.max("weight").over(Window.partitionBy("package"))).where(F.col("weight") >= F.least(F.lit(0.2), F.col("best") / 3))
    return top_n(sums, ["package"], [F.desc("weight"), F.col("other")], n).select("package", "other", "weight", "pos")


def related_merged(same_project: DataFrame, replacements: DataFrame, by_keyword: DataFrame, n: int = 10) -> DataFrame:
    """The three lists (package, other, weight) in one; a pair keeps its first list; cut off below min(.3, best/2)."""
    both = None
    for i, df in enumerate((same_project, replacements, by_keyword)):
        part = df.select("package", "other", F.col("weight").cast("double").alias("weight"), F.lit(i).alias("list"))
        both = part if both is None else both.unionByName(part)
    once = both.groupBy("package", "other").agg(F.min(F.struct("list", (-F.col("weight")).alias("w"))).alias("m")).select("package", "other", F.col("m.list").alias("list"), (-F.col("m.w")).alias("weight"))
    once = once.withColumn("best", F.max("weight").over(Window.partitionBy("package"))).where(F.col("weight") >= F.least(F.lit(0.3), F.col("best") / 2))
    return top_n(once, ["package"], [F.desc("weight"), F.col("list"), F.col("other")], n).select("package", "other", "weight", "pos")
