"""Dependency graph: closure, reverse statistics, importance.

Loops cut their lineage by writing each round to the shared checkpoint folder.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import semver

KINDS = ("runtime", "build", "dev")  # strongest first


def settled(df: DataFrame, *parts: str) -> DataFrame:
    """``df`` written to the session's shared folder, in a folder for each value of ``parts``, and read again."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:  # a single machine, as in tests
        where = tempfile.mkdtemp(prefix="pkgloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    path = f"{where}/pkgloom-round-{uuid.uuid4().hex}"
    df.write.partitionBy(*parts).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BITS = 64  # roots a block; a mask is one long
MASKS = ("plain", "k0", "k1", "k2")  # roots of the default answer; roots that reach a state with at most kind 0, 1, 2
ANY = " OR ".join(f"{m} <> 0" for m in MASKS)
COMPACT = 8  # rounds
TURNS = 32  # levels of releases that are walked in their order


def _blocks(roots: DataFrame) -> DataFrame:
    """Roots (column root) in their order, dealt to blocks of 64: root, block, bit (a mask with the root's own bit)."""
    ids = roots.select("root").where("root IS NOT NULL").distinct().repartitionByRange("root").sortWithinPartitions("root").withColumn("id", F.monotonically_increasing_id())
    return settled(ids.select("root", F.shiftright("id", 6).alias("block"), F.expr(f"shiftleft(1L, CAST(id & {BITS - 1} AS INT))").alias("bit")))


def _united(df: DataFrame, keys: list[str], masks: tuple[str, ...] = MASKS) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.bit_or(m).alias(m) for m in masks])


def _levels(edges: DataFrame) -> tuple[DataFrame, int, bool]:
    """Every release with edges and its level (release, level), the number of levels, and whether any are left over.

    The level of a release is above those of all that lead to it. Releases on cycles, those with edges behind them and those
    deeper than ``TURNS`` have the number of levels for theirs.
    """
    tables, n = [settled(edges.select("release", "to_release").distinct())], [-1]
    while True:
        left, of = tables[-1], tables[-1].count()  # of the files' footers
        if of in (0, n[-1]) or len(tables) > TURNS:
            break
        n.append(of)
        tables.append(settled(left.join(left.select(F.col("to_release").alias("release")).distinct(), "release", "left_semi")))
    levels = len(tables) - 1 - bool(of)  # the last round is that of what is left over, on cycles or behind them
    every = [t.select("release", F.lit(i).alias("level")) for i, t in enumerate(tables[: levels + 1])]
    return settled(functools.reduce(DataFrame.unionByName, every).groupBy("release").agg(F.max("level").alias("level"))), levels, bool(of)


def _walk(starts: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Every state (release, feature) that the roots of a block reach: block, release, feature and the masks of ``MASKS``; a state may stand there in several rows.

    ``starts``: root, level, release, feature, kind; ``edges``: release, feature, to_release, to_feature, edge_kind,
    least_level; ``roots`` as ``_blocks`` gives them. What a root reaches on level 0, the default, it reaches on level 1.
    Roots next to each other reach much the same, so 64 roots walk as one row a state. A root is not entered again from
    another release.

    Releases are walked in the order of ``_levels``: when a release's turn comes, all that leads to it is there, so each
    state goes on once and each step is exchanged once, however often roads meet. A round writes its steps in folders by the
    round that reads them, and its states. Cycles are walked at the end, round by round.
    """
    state = ["block", "release", "feature"]
    none = F.lit(0).cast("bigint")
    only = lambda when, what: F.when(when, what).otherwise(none)
    level, n, cyclic = _levels(edges)
    s = starts.join(roots, "root")
    start = s.select(*state, only(F.col("level") == 0, F.col("bit")).alias("plain"), *[only(F.col("kind") <= k, F.col("bit")).alias(f"k{k}") for k in range(3)])
    turn = F.coalesce("turn", F.lit(n + 1))  # releases without edges end a road
    folders: dict[int, set[str]] = {}
    columns = start.schema

    def written(df: DataFrame) -> None:
        for file in settled(df.select(*columns.names, "turn"), "turn").inputFiles():
            folder = file.rsplit("/", 1)[0]
            folders.setdefault(int(folder.rsplit("=", 1)[1]), set()).add(folder)

    def of_turn(*turns: int) -> DataFrame:
        paths = sorted(x for i in turns for x in folders.get(i, ()))
        return starts.sparkSession.read.schema(columns).parquet(*paths) if paths else start.limit(0)  # one scan, whatever the number of rounds

    written(_united(start, state).join(level.withColumnRenamed("level", "turn"), "release", "left").withColumn("turn", turn))
    own = roots.select(F.col("root").alias("to_release"), F.col("block").alias("own_block"), F.col("bit").alias("own_bit"))
    to = level.select(F.col("release").alias("to_release"), F.col("level").alias("turn"))
    links = edges.join(own, "to_release", "left").withColumn("own_block", F.when(F.col("to_release") != F.col("release"), F.col("own_block")))
    links = settled(links.join(level, "release").join(to, "to_release", "left").withColumn("turn", turn), "level")
    fine = F.when(F.col("own_block") == F.col("block"), F.bitwise_not(F.col("own_bit"))).otherwise(F.lit(-1).cast("bigint"))
    follows = {"plain": F.col("least_level") == 0, **{f"k{k}": F.col("edge_kind") <= k for k in range(3)}}

    def steps(front: DataFrame, links: DataFrame, *more: Column) -> DataFrame:
        onward = front.join(links, ["release", "feature"])
        return onward.select("block", F.col("to_release").alias("release"), F.col("to_feature").alias("feature"), *[only(follows[m], F.col(m).bitwiseAND(fine)).alias(m) for m in MASKS], *more).where(ANY)

    for i in range(n):
        front = _united(of_turn(i).repartition("release", "feature"), state)  # the exchange that the join needs as well
        written(steps(front, links.where(F.col("level") == i), F.col("turn")).unionByName(front.withColumn("turn", F.lit(-1))))
    done = of_turn(-1, n + 1)
    return done.unionByName(_circled(settled(_united(of_turn(n), state)), settled(links.where(F.col("level") == n)), steps)) if cyclic else done


def _circled(front: DataFrame, links: DataFrame, steps: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """States reached from ``front`` over ``links`` with cycles. Masks only gain bits and a round hands on the bits gained in the last one, so cycles end."""
    state = ["block", "release", "feature"]
    none = F.lit(0).cast("bigint")
    seen, i = front, 0
    while not front.isEmpty():
        step = steps(front, links).select("*", *[none.alias(f"had_{m}") for m in MASKS])
        both = step.unionByName(seen.select(*state, *[none.alias(m) for m in MASKS], *[F.col(m).alias(f"had_{m}") for m in MASKS]))
        gained = _united(both, state, (*MASKS, *[f"had_{m}" for m in MASKS])).select(*state, *[F.col(m).bitwiseAND(F.bitwise_not(F.col(f"had_{m}"))).alias(m) for m in MASKS])
        front = settled(gained.where(ANY))
        seen, i = seen.unionByName(front), i + 1
        if i % COMPACT == 0:
            seen = settled(_united(seen, state))
    return seen


def _reached(states: DataFrame, direct: DataFrame, roots: DataFrame) -> DataFrame:
    """The releases that the roots of a block reach: block, release, the masks of ``MASKS`` and ``near``, the roots of which it is a direct dependency. ``direct``: root, release."""
    none = F.lit(0).cast("bigint")
    near = direct.join(roots, "root").select("block", "release", *[none.alias(m) for m in MASKS], F.col("bit").alias("near"))
    return _united(states.select("block", "release", *MASKS, none.alias("near")).unionByName(near), ["block", "release"], (*MASKS, "near")).where("k2 <> 0")


def _told(flat: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, release, kind, is_default, direct) of what ``_reached`` gives."""
    members = roots.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("root", "bit"))).alias("members"))  # 64 at most
    rows = flat.join(members, "block").select("release", *MASKS, "near", F.explode("members").alias("m")).select("*", "m.root", "m.bit")
    has = lambda m: F.col(m).bitwiseAND(F.col("bit")) != 0
    return rows.where(has("k2")).select("root", "release", F.when(has("k0"), 0).when(has("k1"), 1).otherwise(2).alias("kind"), has("plain").alias("is_default"), has("near").alias("direct"))


def dependency_closure(edges: DataFrame) -> DataFrame:
    """G1 without versions: all transitive dependencies of every source with the strongest kind, and whether a path is default or direct.

    ``edges``: src, dst, kind (0 runtime, 1 build, 2 dev), optional. Dev edges count at the root only; below a build edge
    everything is build, below a dev edge dev. Two walks, of the edges that are not optional and of all, with one state a node.
    """
    e = settled(edges.groupBy("src", "dst", "kind").agg(F.bool_and("optional").alias("optional")))
    node = lambda c: [F.col(c).alias("release"), F.lit("").alias("feature")]
    least = F.col("optional").cast("int")
    starts = e.select(F.col("src").alias("root"), F.explode(F.sequence(least, F.lit(1))).alias("level"), *node("dst"), "kind")
    inner = e.where("kind < 2").groupBy("src", "dst").agg(F.min("kind").alias("edge_kind"), F.min(F.when(F.col("kind") == 0, least)).alias("free"), F.min(least).alias("least_level"))
    # a link of both kinds whose runtime side is optional stays two links
    both = (F.col("edge_kind") == 0) & (F.col("free") > F.col("least_level"))
    kinds = F.when(both, F.array(F.struct(F.lit(0).alias("edge_kind"), F.col("free").alias("least_level")), F.struct(F.lit(1).alias("edge_kind"), "least_level"))).otherwise(F.array(F.struct("edge_kind", "least_level")))
    links = inner.select(*node("src"), F.col("dst").alias("to_release"), F.lit("").alias("to_feature"), F.inline(kinds))
    roots = _blocks(e.select(F.col("src").alias("root")))
    return _told(_reached(_walk(starts, links, roots), e.select(F.col("src").alias("root"), F.col("dst").alias("release")), roots), roots).withColumnRenamed("release", "node")


def _named(enables: Column) -> tuple[Column, Column]:
    """The dependency or feature that a descriptor names and the feature it hands on: ``x``, ``dep:x``, ``x/f``, ``dep:x/f``, ``x?/f`` (which enables x like ``x/f``)."""
    first = F.split(enables, "/", 2)
    return F.lower(F.regexp_replace(F.get(first, 0), r"^dep:|\?$", "")), F.lower(F.get(first, 1))


def feature_edges(features: DataFrame, deps: DataFrame) -> DataFrame:
    """What every (release, feature) of a registry brings along; feature "" is the release itself.

    ``features``: release, feature, enables (a descriptor a row, null for a feature that enables nothing); ``deps``: release,
    dep (name), kind, optional, target_specific, default_features, features (array), to_release (as C20 resolves it). An
    optional dependency is brought by a feature that names it, or by a feature of its name if the release declares none.
    Target-specific dependencies are of level 1. Names are compared in lower case.
    """
    f = features.select("release", F.lower("feature").alias("feature"), "enables").distinct()
    name, handed = _named(F.col("enables"))
    descriptors = f.where("enables IS NOT NULL").select("release", "feature", name.alias("key"), handed.alias("handed"), (F.col("enables").startswith("dep:") | handed.isNotNull()).alias("only_dep"))
    declared = f.select("release", "feature").distinct()
    wanted = F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.coalesce("features", F.array().cast("array<string>")), F.lower), F.when(F.col("default_features"), F.array(F.lit("default"))).otherwise(F.array().cast("array<string>"))))
    d = deps.where("to_release IS NOT NULL").select("release", F.lower("dep").alias("key"), F.col("kind").alias("edge_kind"), "optional", F.col("target_specific").cast("int").alias("least_level"), "to_release", wanted.alias("wanted"))
    brought = d.withColumn("to_feature", F.explode("wanted"))
    out = ["release", "feature", "to_release", "to_feature", "edge_kind", "least_level"]
    always = brought.where("NOT optional").withColumn("feature", F.lit("")).select(*out)
    named = descriptors.join(brought.where("optional"), ["release", "key"]).select(*out)
    hands = descriptors.where("handed IS NOT NULL").join(d.drop("wanted"), ["release", "key"]).withColumn("to_feature", F.col("handed")).select(*out)
    inner = descriptors.where("NOT only_dep").join(declared.withColumnRenamed("feature", "key"), ["release", "key"]).select("release", "feature", F.col("release").alias("to_release"), F.col("key").alias("to_feature"), F.lit(0).alias("edge_kind"), F.lit(0).alias("least_level"))
    implicit = brought.where("optional").withColumnRenamed("key", "feature").join(declared, ["release", "feature"], "left_anti").select(*out)
    return always.unionByName(named).unionByName(hands).unionByName(inner).unionByName(implicit).groupBy("release", "feature", "to_release", "to_feature", "edge_kind").agg(F.min("least_level").alias("least_level"))


def enabled_dependencies(releases: DataFrame, features: DataFrame, deps: DataFrame, wanted: DataFrame) -> DataFrame:
    """Dependencies of a release that its wanted features enable, through features of any depth, and all that are not optional.

    ``features``: release, feature, enables (a descriptor a row); ``deps``: release, dep, optional, ...; ``wanted``: release, feature.
    No feature leads to another release, and a registry's record holds all features of a release in one map. So they are
    brought to one row a release, which walks them by itself; dependencies stay rows and are joined to it once.
    """
    name, handed = _named(F.col("enables"))
    described = F.struct(F.lower("feature").alias("feature"), name.alias("key"), (handed.isNull() & ~F.col("enables").startswith("dep:")).alias("inner"))
    no_row, no_name, no = F.lit(None).cast("struct<feature: string, key: string, inner: boolean>").alias("row"), F.lit(None).cast("string").alias("asked"), F.lit(False).alias("known")
    parts = features.where("feature IS NOT NULL").select("release", described.alias("row"), no_name, no).unionByName(wanted.select("release", no_row, F.lower("feature").alias("asked"), no)).unionByName(releases.select("release", no_row, no_name, F.lit(True).alias("known")))
    one = parts.where("release IS NOT NULL").groupBy("release").agg(F.collect_set("row").alias("rows"), F.collect_set("asked").alias("asked"), F.bool_or("known").alias("known")).where("known")
    rows = F.col("rows")

    def onward(walk: Column, _: Column) -> Column:
        """A round, from what the last one reached; there are at most as many as rows, those after the end do nothing."""
        found = F.transform(F.filter(rows, lambda x: x["inner"] & F.array_contains(walk["front"], x["feature"])), lambda x: x["key"])
        fresh = F.array(F.array_except(found, walk["reached"]))
        return F.when(F.size(walk["front"]) == 0, walk).otherwise(F.get(F.transform(fresh, lambda n: F.struct(F.array_union(walk["reached"], n).alias("reached"), n.alias("front"))), F.lit(0)))

    walked = one.select("release", "rows", F.aggregate(rows, F.struct(F.col("asked").alias("reached"), F.col("asked").alias("front")), onward, lambda walk: walk["reached"]).alias("reached"))
    keys = F.transform(F.filter(rows, lambda x: F.array_contains("reached", x["feature"]) & x["key"].isNotNull()), lambda x: x["key"])
    undeclared = F.array_except("reached", F.transform(rows, lambda x: x["feature"]))
    names = walked.select("release", F.array_union(keys, undeclared).alias("_names"))
    return deps.join(names, "release").where(~F.col("optional") | (F.col("optional") & F.array_contains("_names", F.lower("dep")))).select(*deps.columns)


def _condensed(edges: DataFrame) -> DataFrame:
    """``edges`` between releases only: features that lead to features of their own release get what these bring along."""
    inner = (F.col("release") == F.col("to_release")) & (F.col("edge_kind") == 0) & (F.col("least_level") == 0)
    pairs, n = settled(edges.where(inner).where("feature <> to_feature").select("release", "feature", F.col("to_feature").alias("last"))), -1
    while (now := pairs.count()) > n:  # roads of twice the length in each round
        n, onward = now, pairs.select("release", F.col("feature").alias("last"), F.col("last").alias("beyond"))
        pairs = settled(pairs.unionByName(pairs.join(onward, ["release", "last"]).select("release", "feature", F.col("beyond").alias("last"))).where("feature <> last").distinct())
    outer = edges.where(~inner)
    handed = outer.withColumnRenamed("feature", "last").join(pairs, ["release", "last"]).drop("last")
    return outer.unionByName(handed).groupBy("release", "feature", "to_release", "to_feature", "edge_kind").agg(F.min("least_level").alias("least_level"))


def _resolved(roots: DataFrame, features: DataFrame, deps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``_reached`` and the blocks of roots of ``resolved_closure``."""
    every = settled(feature_edges(features, deps))
    links = settled(_condensed(every.where("edge_kind < 2")))
    # features that bring nothing need no state
    links = settled(links.join(links.select(F.col("release").alias("to_release"), F.col("feature").alias("to_feature")).distinct().withColumn("goes_on", F.lit(True)), ["to_release", "to_feature"], "left").where((F.col("to_feature") == "") | F.col("goes_on")).drop("goes_on"))
    own = roots.select(F.col("release").alias("root"), "release").distinct()
    plain = own.select("*", F.explode(F.expr("array(struct(0 AS level, '' AS feature), struct(0 AS level, 'default' AS feature), struct(1 AS level, '' AS feature), struct(1 AS level, 'default' AS feature))")).alias("s")).select("root", "s.level", "release", "s.feature", F.lit(0).alias("kind"))
    declared = features.where("enables IS NOT NULL").select("release", F.lower("feature").alias("feature"))
    optional = deps.where("optional").select("release", F.lower("dep").alias("feature"))
    asked = own.join(declared.unionByName(optional).distinct(), "release").select("root", F.lit(1).alias("level"), "release", "feature", F.lit(0).alias("kind"))
    # all optional dependencies are asked for by name, whether or not a feature has it
    by_name = deps.where("optional AND to_release IS NOT NULL").select(F.col("release").alias("root"), F.col("to_release").alias("release"), F.col("kind"), F.explode(F.concat(F.array(F.lit("")), F.transform(F.coalesce("features", F.array().cast("array<string>")), F.lower), F.when(F.col("default_features"), F.array(F.lit("default"))).otherwise(F.array().cast("array<string>")))).alias("feature"))
    dev = every.where("edge_kind = 2 AND feature = ''").select(F.col("release").alias("root"), F.col("to_release").alias("release"), F.lit(2).alias("kind"), F.col("to_feature").alias("feature"))
    first = by_name.unionByName(dev).join(own.select("root"), "root", "left_semi").where("release <> root").select("root", F.lit(1).alias("level"), "release", "feature", "kind")
    blocks = _blocks(own)
    states = _walk(plain.unionByName(asked).unionByName(first), links, blocks)
    at_root = states.join(blocks.withColumnRenamed("root", "release"), ["release", "block"]).where(F.col("k2").bitwiseAND(F.col("bit")) != 0).select(F.col("release").alias("root"), "feature").distinct()
    near = at_root.join(links.withColumnRenamed("release", "root"), ["root", "feature"]).select("root", F.col("to_release").alias("release")).unionByName(first.select("root", "release"))
    return _reached(states, near, blocks), blocks


def resolved_closure(roots: DataFrame, features: DataFrame, deps: DataFrame) -> DataFrame:
    """G1 with versions: (root, release) of every release that a root brings along, with the strongest kind, is_default and direct.

    ``roots``: release, a package's own latest one; ``features`` and ``deps`` as for ``feature_edges``. A root asks twice: for
    its default features, without target-specific dependencies anywhere, and for all its features, optional and dev
    dependencies; what the first answer holds is default. Features reach the releases they are handed to and act there.
    Dev dependencies count at the root only. Several releases of one package may be brought along.
    """
    return _told(*_resolved(roots, features, deps)).where("root <> release")


def resolved_version_counts(roots: DataFrame, features: DataFrame, deps: DataFrame, releases: DataFrame) -> DataFrame:
    """How many roots use each release of a package; of several releases of a package a root uses the one that ``flattened`` keeps.

    64 roots are counted at once: a package's releases are gone through from the best on, and each takes the roots that none
    before it took, so the closure is never told as rows of roots.
    """
    flat, blocks = _resolved(roots, features, deps)
    own = blocks.select(F.col("root").alias("release"), F.col("block").alias("own_block"), F.col("bit").alias("own_bit"))
    itself = F.when(F.col("own_block") == F.col("block"), F.bitwise_not(F.col("own_bit"))).otherwise(F.lit(-1).cast("bigint"))
    used = flat.join(own, "release", "left").select("block", "release", F.col("k2").bitwiseAND(itself).alias("mask"), "near").where("mask <> 0")
    either = F.array(F.struct(F.lit(True).alias("direct"), F.col("mask").bitwiseAND(F.col("near")).alias("bits")), F.struct(F.lit(False).alias("direct"), F.col("mask").bitwiseAND(F.bitwise_not(F.col("near"))).alias("bits")))
    offers = used.join(releases.select("release", "package", "sort_key"), "release").select("block", "package", "release", "sort_key", F.inline(either)).where("bits <> 0")
    order = F.sort_array(F.collect_list(F.struct("direct", "sort_key", "release", "bits")), asc=False)
    best = offers.groupBy("block", "package").agg(order.alias("offers"))
    # what earlier ones took is a running union
    taken = "aggregate(offers, struct(0L AS taken, CAST(array() AS array<struct<release: {0}, n: bigint>>) AS counts), (t, x) -> struct(t.taken | x.bits AS taken, IF(x.bits & ~t.taken = 0, t.counts, concat(t.counts, array(struct(x.release AS release, CAST(bit_count(x.bits & ~t.taken) AS bigint) AS n)))) AS counts), t -> t.counts)"
    kind = releases.schema["release"].dataType.simpleString()
    return best.select("package", F.inline(F.expr(taken.format(kind)))).groupBy("package", "release").agg(F.sum("n").alias("n_roots"))




def flattened(closure: DataFrame, releases: DataFrame) -> DataFrame:
    """One row a (root, package) of a closure over releases: flags united; the version is a direct one if there is one, of several the highest."""
    r = releases.select("release", "package", "sort_key")
    best = F.max(F.struct("direct", "sort_key", "release"))["release"]
    return closure.join(r, "release").groupBy("root", "package").agg(F.min("kind").alias("kind"), F.bool_or("is_default").alias("is_default"), F.bool_or("direct").alias("direct"), best.alias("release"), F.count("*").alias("n_versions"))


def version_counts(flat: DataFrame) -> DataFrame:
    """How many roots use each release of a package."""
    return flat.groupBy("package", "release").agg(F.count("*").alias("n_roots"))


def reverse_dependency_stats(closure: DataFrame) -> DataFrame:
    """Per package its dependents by kind, default or not, and the direct ones."""
    kind = lambda k, d: F.count_if((F.col("kind") == k) & (F.col("is_default") == d))
    return closure.groupBy(F.col("node").alias("package")).agg(
        kind(0, True).alias("runtime_def"), kind(0, False).alias("runtime_opt"), kind(1, True).alias("build_def"), kind(1, False).alias("build_opt"),
        F.count_if(F.col("kind") == 2).alias("dev"), F.count_if("direct").alias("direct"), F.count("*").alias("total"),
    )


def role_from_usage(stats: DataFrame) -> DataFrame:
    """Mostly a build or mostly a dev dependency."""
    runtime, build = F.col("runtime_def") + F.col("runtime_opt"), F.col("build_def") + F.col("build_opt")
    return stats.select("package", (build > 3 * (runtime + 5)).alias("is_build"), (F.col("dev") > 3 * (runtime + build + 5)).alias("is_dev"))


def version_popularity(requirements: DataFrame, versions: DataFrame, deprecated: DataFrame) -> DataFrame:
    """How much of a package's use a requirement covers, and whether it matches the latest version.

    ``versions``: package, sort_key, users, is_pre, yanked. The popularity is the mean of two shares, of users and of the most
    used version, covered against not covered, with one user added to the covered side; 0 if deprecated or nobody uses the
    package. The latest version is the highest stable one or the highest of all, not yanked if there is such a one.
    """
    from . import ranges

    v = versions.select("package", "sort_key", "users", "is_pre", "yanked").where("sort_key IS NOT NULL")
    low, top = F.lit(""), F.lit(semver.TOP * 2)
    asked = settled(requirements.select("package", "low", "high").where("low < high").distinct())
    around = asked.unionByName(asked.select("package", low.alias("low"), F.col("low").alias("high"))).unionByName(asked.select("package", F.col("high").alias("low"), top.alias("high"))).distinct()
    found = settled(ranges.aggregated(ranges.place(v.select("package", "sort_key", "users"), around), got=(F.col("users"), F.sum), best=(F.col("users"), F.max)))  # read for a range, what is below and what is above
    within, below, above = found, found.where(F.col("low") == low).select("package", F.col("high").alias("low"), F.col("best").alias("below")), found.where(F.col("high") == top).select("package", F.col("low").alias("high"), F.col("best").alias("above"))
    last = v.groupBy("package").agg(F.sum("users").alias("every"), F.max(F.struct(~F.col("yanked") & ~F.col("is_pre"), "sort_key"))["sort_key"].alias("stable"), F.max(F.struct(~F.col("yanked"), "sort_key"))["sort_key"].alias("any"))
    r = requirements.join(within, ["package", "low", "high"], "left").join(below, ["package", "low"], "left").join(above, ["package", "high"], "left").join(last, "package").join(deprecated.select("package", F.lit(True).alias("gone")), "package", "left")
    got, best = F.coalesce("got", F.lit(0)) + 1, F.coalesce("best", F.lit(0)) + 1
    valid = F.col("low") < F.col("high")
    other = F.when(valid, F.coalesce(F.greatest("below", "above"), F.lit(0)))
    share = (got / (F.col("every") + 1) + best / (best + other)) / 2
    holds = lambda c: (F.col(c) >= F.col("low")) & (F.col(c) < F.col("high"))
    popularity = F.when(F.col("gone") | (F.col("every") == 0), 0.0).otherwise(share)
    return r.select("dep_id", "package", popularity.alias("popularity"), F.coalesce(~F.coalesce("gone", F.lit(False)) & (holds("stable") | holds("any")), F.lit(False)).alias("matches_latest"))


def global_popularity(usage: DataFrame, n_packages: int) -> DataFrame:
    """Users of each release over all packages."""
    return usage.select("package", "release", (F.col("n_dependents") / n_packages).alias("popularity"))


def pagerank(edges: DataFrame, initial: DataFrame, damping: float = 0.85, rounds: int = 10, settle_every: int = 1) -> DataFrame:
    """Importance spread along dependencies; a node keeps 1 - damping, sinks feed a pool dealt by the initial share.

    ``edges``: src, dst; ``initial``: node, score.
    """
    e = edges.select("src", "dst").distinct()
    e = settled(e.withColumn("n", F.count("*").over(Window.partitionBy("src"))))  # every round reads it
    total = initial.agg(F.sum("score")).scalar()
    sources = e.select(F.col("src").alias("node")).distinct().withColumn("source", F.lit(True))
    start = initial.select("node", (F.col("score") / total).alias("share")).join(sources, "node", "left")
    now = settled(start.select("node", "share", F.col("source").isNull().alias("sink"), F.col("share").alias("score")))
    for i in range(rounds):
        spread = e.join(now.select(F.col("node").alias("src"), "score"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(damping * F.col("score") / F.col("n")).alias("got"))
        pool = now.where("sink").agg(F.coalesce(F.sum(damping * F.col("score")), F.lit(0.0))).scalar()
        now = now.join(spread, "node", "left").select("node", "share", "sink", ((1 - damping) * F.col("score") + F.coalesce("got", F.lit(0.0)) + pool * F.col("share")).alias("score"))
        if (i + 1) % settle_every == 0:
            now = settled(now)
    return now.select("node", "score")


def initial_importance(packages: DataFrame) -> DataFrame:
    """Downloads, owners, age and releases of a package. Columns: package, downloads, n_owners, age_days, n_releases."""
    n = F.col("n_owners")
    curve = F.when(n <= 1, 0.1).when(n <= 5, n * 0.2).otherwise(F.greatest(F.lit(0.0), 1 - 0.05 * (n - 5)))
    return packages.select("package", (F.log2(3 * F.col("downloads") + 1) + curve + F.log2(1 + F.col("age_days") / 365) + F.sqrt("n_releases")).alias("importance"))


def author_trust(importance: DataFrame, contributions: DataFrame, org_bonus: DataFrame) -> DataFrame:
    """authors' importance from their packages, and one hop from owners to co-authors.

    ``contributions``: package, author, amount, is_owner.
    """
    per = Window.partitionBy("package")
    c = contributions.withColumn("part", F.col("amount") / F.sum("amount").over(per))
    c = c.withColumn("part", F.col("part") * F.when(F.col("is_owner"), 1.0).otherwise(0.05) + F.when(F.col("is_owner"), 0.2).otherwise(0.0))
    c = c.withColumn("part", F.col("part") / F.sum("part").over(per)).select("package", "author", "is_owner", "part")
    own = c.join(importance, "package").groupBy("author").agg(F.sum(F.col("importance") * F.col("part")).alias("direct"))
    own = own.join(org_bonus, "author", "left").withColumn("direct", F.col("direct") + F.when(F.col("direct") > 4, F.coalesce("bonus", F.lit(0.0))).otherwise(0.0)).drop("bonus")
    owners = c.where("is_owner").join(own, "author").select("package", (F.col("direct") * F.col("part")).alias("trust")).groupBy("package").agg(F.sum("trust").alias("trust"))
    passed = c.join(owners, "package").groupBy("author").agg(F.sum(F.col("trust") * F.col("part")).alias("passed"))
    return own.join(passed, "author", "left").select("author", (F.col("direct") + F.coalesce("passed", F.lit(0.0))).alias("trust"))


def niche_dep_keywords(deps: DataFrame, stats: DataFrame, weight: float = 1.0, least: int = 3, most: int = 199) -> DataFrame:
    """Dependencies with a few direct users become keywords of weight w / (1 + users)."""
    s = stats.where(F.col("direct").between(least, most)).select(F.col("package").alias("dep"), "direct")
    return deps.join(s, "dep").select("package", F.concat(F.lit("dep:"), F.col("dep").cast("string")).alias("keyword"), (weight / (1 + F.col("direct"))).alias("weight")).distinct()
