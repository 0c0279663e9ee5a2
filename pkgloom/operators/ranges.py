"""Search of ranges of sort keys without a row for each pair of range and point.

Points (releases) and the ends of distinct ranges (requirements, advisories)
are put in one order by package and key, range-partitioned, so a package with
very many releases spreads over partitions. Every row gets its place in that
order; a range covers the points between its ends' places. Places are cut into
aligned blocks of 1, BASE, BASE**2, ... rows; a range is a union of few blocks
(at most 2 (BASE - 1) of each size), and a join on (size, block) replaces the
product of ranges and points. Ranges of one package never reach into another's
points, so one order serves all packages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import settled

BASE, SIZES = 4, 31  # blocks grow by BASE; SIZES of them reach beyond any table
BLOCK = f"place DIV CAST(power({BASE}, size) AS BIGINT)"


@dataclass
class Placed:
    """``points`` with ``place``; ``ranges`` (package, low, high) with the places ``first`` and ``past`` of their ends; no two share an end's place."""

    points: DataFrame
    ranges: DataFrame


def place(points: DataFrame, ranges: DataFrame, package: str = "package", key: str = "sort_key") -> Placed:
    """Places of all points, and of the ends of every distinct (package, low, high) of ``ranges``; ends that are null cover nothing."""
    payload = F.struct(*points.columns)
    nothing = F.lit(None).cast(points.schema[key].dataType)
    wanted = ranges.select(package, "low", "high").where("low < high").distinct()
    ends = wanted.select(package, F.explode(F.array("low", "high")).alias("at"), F.lit(False).alias("is_point"), F.lit(None).cast(points.select(payload).schema[0].dataType).alias("point"), "low", "high")
    # an end stands before the points of its key: a range holds its low key and not its high one
    marks = points.where(F.col(key).isNotNull()).select(package, F.col(key).alias("at"), F.lit(True).alias("is_point"), payload.alias("point"), nothing.alias("low"), nothing.alias("high")).unionByName(ends)
    order = [F.col(package), F.col("at"), F.col("is_point"), F.xxhash64("point", "low", "high")]
    # partition bounds are sampled, so the order is written before anything depends on it
    ordered = settled(marks.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("n", F.monotonically_increasing_id()))
    chunk = F.shiftright("n", 33)
    sizes = ordered.groupBy(chunk.alias("chunk")).agg(F.count("*").alias("size"))  # a row for each partition
    before = sizes.select("chunk", F.coalesce(F.sum("size").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    found = ordered.withColumn("chunk", chunk).join(F.broadcast(before), "chunk").withColumn("place", F.col("before") + F.col("n").bitwiseAND((1 << 33) - 1))
    return Placed(
        found.where("is_point").select("point.*", "place"),
        found.where("NOT is_point").groupBy(package, "low", "high").agg(F.min("place").alias("first"), F.max("place").alias("past")),
    )


def pieces(ranges: DataFrame) -> DataFrame:
    """(first, size, block): the blocks that make up every [first, past)."""
    unit = f"CAST(power({BASE}, j) AS BIGINT)"
    a, b = f"((first + {unit} - 1) DIV {unit})", f"(past DIV {unit})"
    up, down = f"({BASE} * (({a} + {BASE - 1}) DIV {BASE}))", f"({BASE} * ({b} DIV {BASE}))"
    # the blocks of a size that no larger block of the range holds: those before its first and behind its last multiple of BASE
    side = lambda lo, hi: f"IF({lo} < {hi}, sequence({lo}, {hi} - 1), array())"
    blocks = f"IF({a} >= {b}, array(), IF({up} >= {down}, {side(a, b)}, concat({side(a, up)}, {side(down, b)})))"
    # a size whose multiples up and down meet has no larger blocks within the range
    sizes = f"sequence(0, CAST(log({BASE}, past - first) AS INT) + 1)"  # one more, as logarithms are rounded
    per = ranges.select("first", "past", F.explode(F.expr(sizes)).alias("j")).withColumn("block", F.expr(blocks))
    return per.select("first", F.col("j").alias("size"), F.explode("block").alias("block"))


def _sizes(of: DataFrame) -> int:
    """How many block sizes the longest range uses."""
    longest = of.agg(F.max(F.col("past") - F.col("first"))).first()[0] or 1
    return next(j for j in range(1, SIZES + 1) if BASE**j > longest)


def aggregated(placed: Placed, package: str = "package", **values: tuple[Column, object]) -> DataFrame:
    """Every placed range with each of ``values``: (expression over points, an aggregate that can be combined, such as F.max or F.sum); null where nothing is covered."""
    levels = F.explode(F.sequence(F.lit(0), F.lit(_sizes(placed.ranges) - 1)))
    spread = placed.points.select(levels.alias("size"), "place", *[e.alias(n) for n, (e, _) in values.items()]).withColumn("block", F.expr(BLOCK))
    tree = spread.groupBy("size", "block").agg(*[f(n).alias(n) for n, (_, f) in values.items()])
    answers = pieces(placed.ranges).join(tree, ["size", "block"]).groupBy("first").agg(*[f(n).alias(n) for n, (_, f) in values.items()])
    return placed.ranges.join(answers, "first", "left").select(package, "low", "high", *values)


def stabbed(placed: Placed, valued: DataFrame, value: str, package: str = "package") -> DataFrame:
    """Points with the largest ``value`` of all ranges (package, low, high, ``value``) that cover them; points without one are left out."""
    worth = valued.groupBy(package, "low", "high").agg(F.max(value).alias(value))
    spans = placed.ranges.join(worth, [package, "low", "high"]).select("first", value)
    best = pieces(placed.ranges).join(spans, "first").groupBy("size", "block").agg(F.max(value).alias(value))
    levels = F.explode(F.sequence(F.lit(0), F.lit(_sizes(placed.ranges) - 1)))
    asked = placed.points.select("place", levels.alias("size")).withColumn("block", F.expr(BLOCK))
    hit = asked.join(best, ["size", "block"]).groupBy("place").agg(F.max(value).alias(value))
    return placed.points.join(hit, "place").drop("place")
