"""The test tables in the roles of a package registry.

Each role is one SELECT that Spark and the SQL oracle both read, so a query and
its oracle start from the same rows.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def pad(x: str) -> str:
    return f"lpad(CAST({x} AS STRING), 12, '0')"


VIEWS: dict[str, str] = {
    "packages": "SELECT p_partkey AS package, p_name AS name, p_brand AS category, p_type AS kind, (p_retailprice - 900) / 100 AS rank, p_size * 100 AS downloads, p_partkey * 7919 % 100000 AS next_update FROM {part}",
    "keywords": "SELECT p_partkey AS package, concat(p_brand, '-', split_part(p_name, ' ', 1)) AS keyword, 1.65e1 + p_size % 3 AS weight, 0 AS place, p_size % 5 > 0 AS visible FROM {part} UNION ALL SELECT p_partkey AS package, concat(p_brand, '-', split_part(p_name, ' ', 2)) AS keyword, 1.25e1 + p_size % 2 AS weight, 1 AS place, p_size % 7 > 0 AS visible FROM {part}",
    "categories": "SELECT p_partkey AS package, p_type AS slug, 1e0 / (1 + p_size % 4) AS relevance, 1e0 / (1 + p_size % 3) AS rank_weight FROM {part} UNION ALL SELECT p_partkey AS package, p_brand AS slug, 5e-1 AS relevance, 4e-1 AS rank_weight FROM {part} WHERE p_size % 2 = 0",
    "releases": "SELECT o_custkey AS package, o_orderkey AS release, o_orderdate AS created, o_orderstatus = 'P' AS yanked, concat(o_orderkey % 3, '.', o_orderkey % 10, '.', o_orderkey % 7, CASE WHEN o_orderkey % 11 = 0 THEN '-rc.1' ELSE '' END) AS version FROM {orders}",
    "keyed": f"""SELECT package, release, created, yanked, version,
        concat({pad('release % 3')}, '.', {pad('release % 10')}, '.', {pad('release % 7')}, CASE WHEN release % 11 = 0 THEN '-1rc 0000000000001' ELSE '~' END) AS sort_key,
        CASE WHEN release % 3 > 0 THEN CAST(release % 3 AS STRING) WHEN release % 10 > 0 THEN concat('0.', release % 10) ELSE concat('0.0.', release % 7) END AS compat,
        release % 11 = 0 AS is_pre,
        CASE WHEN release % 11 = 0 THEN 'unstable' WHEN release % 3 > 0 THEN 'stable' WHEN release % 10 > 1 AND release % 7 > 0 THEN 'okay' ELSE 'unstable' END AS stability FROM {{releases}}""",
    "deps": "SELECT l_orderkey * 10 + l_linenumber AS dep_id, l_partkey AS package, concat('^', l_linenumber % 3, '.', l_partkey % 10) AS requirement, l_linenumber % 3 AS major, l_partkey % 10 AS minor FROM {lineitem}",
    "intervals": f"""SELECT dep_id, package, requirement, concat({pad('major')}, '.', {pad('minor')}, '.', {pad('0')}, '-') AS low,
        CASE WHEN major > 0 THEN concat({pad('major + 1')}, '.', {pad('0')}, '.', {pad('0')}, '-') ELSE concat({pad('0')}, '.', {pad('minor + 1')}, '.', {pad('0')}, '-') END AS high FROM {{deps}}""",
    "uses": "SELECT o_custkey AS depender, l_partkey AS package, l_linenumber % 3 AS kind, l_linenumber > 4 AS optional FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey",
    "owners": "SELECT l_partkey AS package, l_suppkey AS owner, l_suppkey % 2 AS kind, CAST(min(l_shipdate) AS DATE) AS invited_at, CASE WHEN min(l_quantity) > 10 THEN (l_suppkey * 7 + 3) % 100 END AS inviter FROM {lineitem} GROUP BY l_partkey, l_suppkey",
    "daily": "SELECT l_partkey AS package, l_linenumber AS version, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS n FROM {lineitem} GROUP BY l_partkey, l_linenumber, CAST(l_shipdate AS DATE)",
    "builds": "SELECT l_partkey AS package, l_linenumber AS release, CAST(l_quantity AS INT) AS compiler, CASE l_returnflag WHEN 'A' THEN 'X' WHEN 'N' THEN 'y' ELSE 'Y' END AS verdict FROM {lineitem}",
    "warned": "SELECT l_suppkey AS owner, l_partkey AS package, concat(l_returnflag, l_linestatus) AS title, l_linenumber % 4 AS severity FROM {lineitem}",
    "results": "SELECT l_orderkey % 500 AS query_id, l_partkey AS doc_id, max(l_extendedprice) AS score FROM {lineitem} GROUP BY l_orderkey % 500, l_partkey",
    "paths": "SELECT concat('r', p_size) AS repo, p_partkey AS package, CASE WHEN p_partkey % 4 = 0 THEN concat('a', p_partkey) WHEN p_partkey % 4 = 1 THEN concat('a', p_partkey - 1, '/b', p_partkey) WHEN p_partkey % 4 = 2 THEN concat('a', p_partkey - 2, '/x/c', p_partkey) ELSE concat('z/y', p_partkey) END AS path FROM (SELECT p_partkey, p_partkey % 40 - p_partkey % 4 AS p_size FROM {part}) p",
    "months": "SELECT l_partkey AS dep, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, sum(l_quantity) AS users FROM {lineitem} GROUP BY l_partkey, CAST(date_trunc('month', l_shipdate) AS DATE)",
    "excluded": "SELECT s_suppkey AS owner FROM {supplier} WHERE s_suppkey % 9 = 0",
    "edges": "SELECT DISTINCT l_partkey AS src, CAST(floor(l_partkey / (l_linenumber + 1)) AS BIGINT) AS dst FROM {lineitem} WHERE l_partkey > l_linenumber",
}


# Roles that group a row or few per package, supplier or day; they hold nearly as many rows as their table.
DEALT = ("owners", "daily", "results", "months")
ROWS = 500_000  # of a large table in a task


class Views:
    """The roles as DataFrames over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    @cached_property
    def partitions(self) -> int | None:
        """How many tasks a large lineitem takes, so that a task's memory does not grow with the table; None leaves a small one to Spark."""
        n = self.lineitem.count()  # of the files' footers
        return -(-n // ROWS) if n > 8 * ROWS else None

    @cached_property
    def dealt(self) -> DataFrame:
        """lineitem by package, the key by which the roles of ``DEALT`` are grouped and joined."""
        return self.lineitem.repartition(self.partitions, "l_partkey") if self.partitions else self.lineitem

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in VIEWS:
                sql = VIEWS[name]
                self.made[name] = self.spark.sql(sql, **{n: self.dealt if name in DEALT and n == "lineitem" else getattr(self, n) for n in re.findall(r"\{(\w+)\}", sql)})
            elif name in TABLES:
                self.made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self.made[name]


def oracle(sql: str) -> str:
    """``sql`` for the oracle, with the views it needs in front."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in need:
                visit(re.sub(r"\{(\w+)\}", r"\1", VIEWS[name]))
                if name not in need:
                    need.append(name)

    visit(re.sub(r"(?<=AS )\w+", "", sql))
    views = ", ".join(f"{n} AS ({re.sub(r'[{]([a-z]+)[}]', r'\1', VIEWS[n])})" for n in need)
    recursive = bool(re.match(r"\s*WITH RECURSIVE\b", sql))
    rest = re.sub(r"^\s*WITH( RECURSIVE)?\s+", "", sql)
    if not views:
        return sql
    return f"WITH{' RECURSIVE' * recursive} {views}{', ' if rest != sql else ' '}{rest}"
