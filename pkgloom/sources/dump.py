"""Reading registry dumps, rule lists and nested metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The dump's tables and their columns.
SCHEMAS = {
    "crate_owners": "crate_id LONG, created_at STRING, created_by_id LONG, owner_id LONG, owner_kind INT",
    "teams": "id LONG, github_id LONG, login STRING, name STRING, avatar STRING",
    "users": "id LONG, github_id LONG, login STRING, name STRING, avatar STRING",
    "versions": "id LONG, crate_id LONG, num STRING, crate_size LONG, created_at STRING, updated_at STRING, downloads LONG, features STRING, license STRING, links STRING, published_by LONG, yanked STRING, checksum STRING",
    "version_downloads": "date DATE, downloads LONG, version_id LONG",
}


def read_dump(spark: SparkSession, folder: str, schemas: dict[str, str] = SCHEMAS) -> dict[str, DataFrame]:
    """A1: the dump's CSV tables with fixed schemas; a malformed row fails the job. Other files of the folder are not looked at."""
    return {name: spark.read.schema(ddl).option("mode", "FAILFAST").csv(f"{folder}/{name}.csv", header=True, multiLine=True, escape='"', enforceSchema=False) for name, ddl in schemas.items()}


def parse_dump_ts(c: Column) -> Column:
    """A2: ``YYYY-MM-DD HH:MM:SS[.frac]`` as UTC, the fraction trimmed; a trailing offset of +00 is accepted."""
    return F.try_to_timestamp(F.regexp_replace(F.split_part(c, F.lit("."), F.lit(1)), r"\+00$", ""), F.lit("yyyy-MM-dd HH:mm:ss"))


def read_rule_list(spark: SparkSession, path: str, sep: str, names: list[str]) -> DataFrame:
    """A3: a line-oriented rule file; blank lines and # comments are skipped, the last field keeps further separators."""
    line = F.trim(F.regexp_replace("value", r"(^|\s)#.*$", ""))
    parts = F.split(line, f"\\Q{sep}\\E", len(names))
    return spark.read.text(path).where(line != "").select(*[F.trim(F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(names)])


INDEX = "name STRING, vers STRING, deps ARRAY<STRUCT<name: STRING, req: STRING, optional: BOOLEAN, kind: STRING, target: STRING>>, features MAP<STRING, ARRAY<STRING>>, yanked BOOLEAN"


def read_registry_index(spark: SparkSession, path: str, bogus: tuple[str, ...] = ("test+package",)) -> DataFrame:
    """A4: releases with nested dependencies and features; names in lower case, bogus ones dropped."""
    return spark.read.schema(INDEX).option("mode", "FAILFAST").json(path).withColumn("name", F.lower("name")).where(~F.col("name").isin(*bogus))


def flatten_taxonomy(nodes: DataFrame, depth: int = 6) -> DataFrame:
    """A5: rows (id, parent, name) as slugs ``a::b`` with depth; a node's siblings are counted."""
    level = nodes.where("parent IS NULL").select("id", F.col("name").alias("slug"), F.lit(None).cast("string").alias("parent_slug"), F.lit(0).alias("depth"))
    out = level
    for d in range(1, depth):  # a taxonomy has a handful of levels
        level = nodes.join(level.select(F.col("id").alias("parent"), F.col("slug").alias("parent_slug")), "parent").select("id", F.concat_ws("::", "parent_slug", "name").alias("slug"), "parent_slug", F.lit(d).alias("depth"))
        out = out.unionByName(level)
    n = out.groupBy(F.col("parent_slug").alias("_parent")).agg((F.count("*") - 1).alias("n_siblings"))
    return out.join(n, F.col("parent_slug").eqNullSafe(F.col("_parent"))).select("slug", "parent_slug", "depth", "n_siblings")


API = "STRUCT<versions: ARRAY<STRUCT<num: STRING, yanked: BOOLEAN, audit_actions: ARRAY<STRUCT<action: STRING, login: STRING, time: STRING>>>>, keywords: ARRAY<STRUCT<keyword: STRING>>>"


def explode_api_metadata(packages: DataFrame, key: str = "package", json: str = "json") -> dict[str, DataFrame]:
    """Releases, audit actions and keywords of nested package metadata; unreadable metadata gives none."""
    parsed = packages.select(key, F.from_json(json, API).alias("m"))
    versions = parsed.select(key, F.explode("m.versions").alias("v"))
    return {
        "releases": versions.select(key, "v.num", "v.yanked"),
        "actions": versions.select(key, "v.num", F.explode("v.audit_actions").alias("a")).select(key, "num", "a.action", "a.login", "a.time"),
        "keywords": parsed.select(key, F.posexplode("m.keywords").alias("place", "k")).select(key, "place", "k.keyword"),
    }


WEEKS = "ARRAY<STRUCT<author: STRUCT<login: STRING>, weeks: ARRAY<STRUCT<w: LONG, a: INT, d: INT, c: INT>>>>"


def explode_contributions(repos: DataFrame, key: str = "repo", json: str = "json") -> DataFrame:
    """(login, week, added, deleted, commits) of contribution statistics."""
    people = repos.select(key, F.explode(F.from_json(json, WEEKS)).alias("p"))
    return people.select(key, "p.author.login", F.explode("p.weeks").alias("w")).select(key, "login", F.timestamp_seconds("w.w").alias("week"), F.col("w.a").alias("added"), F.col("w.d").alias("deleted"), F.col("w.c").alias("commits"))


def event_payload(events: DataFrame) -> DataFrame:
    """The JSON properties of events as columns."""
    return events.select("event_id", "event_type", F.from_json("props", "STRUCT<k: LONG>").alias("p")).select("event_id", "event_type", F.col("p.k").alias("k"))
