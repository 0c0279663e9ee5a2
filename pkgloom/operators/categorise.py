"""Category guesses and their adjustment (K1 to K4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import top_n


def candidate_categories(keywords: DataFrame, categories: DataFrame, n: int = 10) -> DataFrame:
    """K1: categories of packages that share keywords, damped by how heavy a keyword is overall.

    Sums per (keyword, category) first, so a frequent keyword costs its
    categories and not its pairs of packages; the package's own part is taken
    off again.
    """
    total = keywords.groupBy("keyword").agg(F.sum("weight").alias("total"))
    tagged = keywords.select("package", "keyword", "weight").join(categories.select("package", "slug", "relevance"), "package")
    own = tagged.groupBy("package", "keyword", "slug").agg(F.sum(F.col("relevance") * F.col("weight")).alias("own"), F.count("*").alias("own_n"))
    per = own.groupBy("keyword", "slug").agg(F.sum("own").alias("all"), F.sum("own_n").alias("all_n"))
    mine = keywords.select("package", "keyword", "weight").join(total, "keyword").withColumn("mine", F.col("weight") / (8000 + F.col("total")))
    both = mine.join(per, "keyword").join(own, ["package", "keyword", "slug"], "left")
    rest, rest_n = F.col("all") - F.coalesce("own", F.lit(0.0)), F.col("all_n") - F.coalesce("own_n", F.lit(0))
    sums = both.where(rest_n > 0).groupBy("package", "slug").agg((F.sum(rest * F.col("mine")) / (8 + F.sum(rest_n))).alias("weight"))
    return top_n(sums.withColumn("weight", F.round("weight", 9)), ["package"], [F.desc("weight"), F.col("slug")], n).select("package", "slug", "weight")


def _table(rows: list[tuple], fields: str) -> Column:
    """A short list of tuples as one literal array of structs, empty lists included."""
    names = [f.split(":")[0] for f in fields.split(", ")]
    structs = [F.struct(*[(F.array(*map(F.lit, x)) if isinstance(x, (list, tuple)) else F.lit(x)).alias(n) for n, x in zip(names, r, strict=True)]) for r in rows]
    return F.array(*structs).cast(f"array<struct<{fields}>>")


def _pairs(scores: Column, pairs: list[tuple[str, str]], change: Callable[[Column, Column, Column, Column, Column], Column]) -> Column:
    """``change(name, score, place, a, b)`` over the scores for each pair in turn whose both ends have a score."""

    def step(m: Column, p: Column) -> Column:
        a, b = F.try_element_at(m, p["a"]), F.try_element_at(m, p["b"])
        return F.when(a.isNotNull() & b.isNotNull(), F.transform_values(m, lambda k, w: change(k, w, p, a, b))).otherwise(m)

    return F.aggregate(_table(pairs, "a:string, b:string"), scores, step) if pairs else scores


def _related(scores: Column, tree: list[tuple[str, str | None]]) -> Column:
    """Half of a parent's score to its children, at most doubling theirs, and a sixth of the best child's own score to the parent."""
    if not tree:
        return scores
    zero = F.lit(0.0)

    def down(m: Column, t: Column) -> Column:
        from_parent = F.coalesce(F.try_element_at(m, t["parent"]) / 2, zero)
        return F.transform_values(m, lambda k, w: F.when(k == t["slug"], w + F.least(w, from_parent)).otherwise(w))

    below: dict[str, list[str]] = {}
    for slug, parent in tree:
        if parent is not None:
            below.setdefault(parent, []).append(slug)
    passed = F.aggregate(_table([(s, p or "") for s, p in tree], "slug:string, parent:string"), scores, down)
    if not below:
        return passed
    children = F.create_map(*[x for p, c in below.items() for x in (F.lit(p), F.array(*map(F.lit, c)))])
    best = lambda k: F.aggregate(F.coalesce(F.try_element_at(children, k), F.array().cast("array<string>")), zero, lambda m, c: F.greatest(m, F.coalesce(F.try_element_at(scores, c), zero)))
    return F.transform_values(passed, lambda k, w: w + best(k) / 6)


def adjust_categories(
    candidates: DataFrame, bag: DataFrame, rules: list[dict], exclusions: list[tuple[str, str]] = (), threshold: float = 0.1,
    tree: list[tuple[str, str | None]] = (), rivals: list[tuple[str, str]] = (), late_exclusions: list[tuple[str, str]] = (), preference: dict[str, float] | None = None, most: int | None = None,
) -> DataFrame:
    """K2: ordered rules over the candidate categories of every package that has candidates or keywords.

    A rule is {kind: any | all | not_any, keywords, slug, mul, add}. ``any``
    counts its hits, the others match once; score = score · mul^r + add · r +
    1e-6 with r the root of the matches. Then, in this order: exclusions (a, b)
    lower b by min(a, b/3); ``tree`` (slug, parent; parents first) exchanges
    scores between levels; of ``rivals`` (a, b) the one below .66 of the other
    gives half of its score to it; ``late_exclusions``; ``preference`` multiplies.
    What reaches max(threshold, .951 · best) stays, at most ``most``, best first.

    The rules are one literal array and a package's scores one map, so all steps
    are folds inside the row of a package: no shuffle but that of its keywords.
    """
    words = bag.groupBy("package").agg(F.collect_set("keyword").alias("keywords"))
    scores = candidates.groupBy("package").agg(F.map_from_entries(F.collect_list(F.struct("slug", F.col("weight").cast("double").alias("weight")))).alias("scores"))
    none = F.create_map().cast("map<string,double>")
    rows = scores.join(words, "package", "full_outer").select("package", F.coalesce("scores", none).alias("scores"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))

    def matches(r: Column) -> Column:
        hits = F.size(F.filter(r["words"], lambda k: F.array_contains("keywords", k)))
        return F.when(r["kind"] == "any", hits).when(r["kind"] == "all", (hits == F.size(r["words"])).cast("int")).otherwise((hits == 0).cast("int"))

    def put(m: Column, r: Column) -> Column:
        root = F.sqrt(r["matches"])
        new = F.coalesce(F.try_element_at(m, r["slug"]), F.lit(0.0)) * F.pow(r["mul"], root) + r["add"] * root + 1e-6
        return F.map_concat(F.map_filter(m, lambda k, _: k != r["slug"]), F.create_map(r["slug"], new))

    if rules:
        table = _table([(r["kind"], list(r["keywords"]), r["slug"], float(r["mul"]), float(r["add"])) for r in rules], "kind:string, words:array<string>, slug:string, mul:double, add:double")
        counted = F.transform(table, lambda r: F.struct(r["slug"].alias("slug"), r["mul"].alias("mul"), r["add"].alias("add"), matches(r).alias("matches")))
        rows = rows.withColumn("matched", F.filter(counted, lambda r: r["matches"] > 0)).withColumn("scores", F.aggregate("matched", F.col("scores"), put))
    lower = lambda k, w, p, a, b: F.when(k == p["b"], w - F.least(a, w / 3)).otherwise(w)

    def share(k: Column, w: Column, p: Column, a: Column, b: Column) -> Column:
        a_leads, b_leads = a * 0.66 > b, ~(a * 0.66 > b) & (b * 0.66 > a)
        gains, halves = (a_leads & (k == p["a"])) | (b_leads & (k == p["b"])), (a_leads & (k == p["b"])) | (b_leads & (k == p["a"]))
        return F.when(gains, w + F.when(a_leads, b).otherwise(a) / 2).when(halves, w * 0.5).otherwise(w)

    rows = rows.withColumn("scores", _pairs(F.col("scores"), list(exclusions), lower))
    rows = rows.withColumn("scores", _related(F.col("scores"), list(tree)))
    rows = rows.withColumn("scores", _pairs(F.col("scores"), list(rivals), share))
    rows = rows.withColumn("scores", _pairs(F.col("scores"), list(late_exclusions), lower))
    if preference:
        liked = F.create_map(*[x for s, w in preference.items() for x in (F.lit(s), F.lit(float(w)))])
        rows = rows.withColumn("scores", F.transform_values("scores", lambda k, w: w * F.coalesce(F.try_element_at(liked, k), F.lit(1.0))))
    ordered = F.sort_array(F.transform(F.map_entries("scores"), lambda e: F.struct((-F.round(e["value"], 6)).alias("w"), e["key"].alias("slug"))))
    rows = rows.select("package", ordered.alias("all")).withColumn("least", F.greatest(F.lit(threshold), -0.951 * F.get(F.col("all")["w"], F.lit(0))))
    kept = F.filter("all", lambda e: -e["w"] >= F.round("least", 6))
    if most is not None:
        kept = F.slice(kept, 1, most)
    return rows.select("package", F.explode(kept).alias("e")).select("package", F.col("e.slug").alias("slug"), (-F.col("e.w")).alias("weight"))


def category_weights(categories: DataFrame) -> DataFrame:
    """K3: relevance over the package's best, .4 for guesses, .8 for general categories."""
    best = F.max("relevance").over(Window.partitionBy("package"))
    w = F.col("relevance") / best * F.when(F.col("explicit"), 1.0).otherwise(0.4) * F.when(F.col("is_general"), 0.8).otherwise(1.0)
    return categories.select("package", "slug", w.alias("rank_weight"))


def top_keywords(keywords: DataFrame, categories: DataFrame, n: int = 10) -> DataFrame:
    """K4: visible keywords that are no categories by mean weight times own weight, at least a twentieth of the best."""
    mean = keywords.groupBy("keyword").agg(F.avg("weight").alias("mean"))
    s = keywords.where("visible").join(mean, "keyword").join(categories.select(F.col("slug").alias("keyword")).distinct(), "keyword", "left_anti").withColumn("score", F.round(F.col("mean") * F.col("weight"), 6))
    s = s.where(F.col("score") >= 0).withColumn("top", F.max("score").over(Window.partitionBy("package"))).where(F.col("score") >= F.col("top") / 20)
    return top_n(s, ["package"], [F.desc("score"), F.col("keyword")], n).select("package", "keyword", "score", "pos")
