"""Upserts and reloads of keyed tables (A8 to A19), as joins that return the new table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def all_packages(registry: DataFrame, repository_only: DataFrame) -> DataFrame:
    """Every package of either list once."""
    return registry.unionByName(repository_only).distinct()


def reload_ownership(owners: DataFrame, known: DataFrame, package: str = "package", owner: str = "owner", inviter: str = "inviter") -> DataFrame:
    """The new ownership table. Rows without an account or of unknown packages go; an invitation by oneself has no inviter."""
    fine = owners.where(F.col(owner).isNotNull()).join(known.select(package).distinct(), package, "left_semi")
    return fine.withColumn(inviter, F.when(F.col(inviter) != F.col(owner), F.col(inviter)))


def insert_ignore(new: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """A10: the target with those new rows whose key it lacks; of equal new keys one row is taken."""
    order = Window.partitionBy(*keys).orderBy(*[c for c in new.columns if c not in keys])
    first = new.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return target.unionByName(first.join(target.select(*keys), keys, "left_anti"))


def upsert_coalesce(new: DataFrame, target: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Non-null, non-empty new values win; otherwise the old ones stay."""
    clean = new.select(*keys, *[F.nullif(F.trim(F.col(v)), F.lit("")).alias(f"_{v}") if dict(new.dtypes)[v] == "string" else F.col(v).alias(f"_{v}") for v in values])
    return target.join(clean, keys, "full_outer").select(*keys, *[F.coalesce(f"_{v}", v).alias(v) for v in values])


def merge_daily_max(new: DataFrame, old: DataFrame, keys: list[str], value: str, override: str) -> DataFrame:
    """The larger value of a key, or the new one where its override flag is set."""
    left = new.select(*keys, F.col(value).alias("_new"), F.coalesce(F.col(override), F.lit(False)).alias("_set"))
    both = old.select(*keys, value).join(left, keys, "full_outer")
    return both.select(*keys, F.when(F.col("_set"), F.col("_new")).otherwise(F.greatest("_new", value)).alias(value))


def replace_children(new: DataFrame, target: DataFrame, parent: str) -> DataFrame:
    """All rows of the parents in ``new`` are replaced by the new ones."""
    return target.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def cascade_delete(tables: dict[str, DataFrame], keys: DataFrame, key: str = "package") -> dict[str, DataFrame]:
    """Each table without the rows of the given keys."""
    gone = keys.select(key).distinct()
    return {name: df.join(gone, key, "left_anti") for name, df in tables.items()}


def merge_best(new: DataFrame, target: DataFrame, keys: list[str], rank: Column) -> DataFrame:
    """Per key the row of the highest ``rank``; of equal ranks the new row wins."""
    both = target.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy(rank.desc(), F.desc("_new"), *[c for c in target.columns if c not in keys])
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_new")


def sitemap_rows(pages: DataFrame, as_of: Column, rank: str = "rank", updated: str = "updated", url: str = "url") -> DataFrame:
    """Address, priority and change frequency of every page by rank and age."""
    age = F.datediff(as_of, F.col(updated))
    return pages.select(
        url,
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(rank) - 0.15) * 2)).alias("priority"),
        F.when(age > 540, "yearly").when(age > 60, "monthly").otherwise("weekly").alias("changefreq"),
    )


def write_partitioned_years(daily: DataFrame, path: str, day: str = "day") -> None:
    """The download store, one folder per year."""
    daily.withColumn("year", F.year(day)).write.mode("overwrite").partitionBy("year").parquet(path)


def read_years(spark, path: str, years: list[int]) -> DataFrame:
    """Only the folders of the given years are read."""
    return spark.read.parquet(path).where(F.col("year").isin(years))


def drop_expired(rows: DataFrame, expires: str, as_of: Column) -> DataFrame:
    """Rows that never expire (0) or expire later."""
    return rows.where((F.col(expires) == 0) | (F.col(expires) > as_of))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
