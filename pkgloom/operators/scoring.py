"""Quality scores and lint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, float, Column]


def has(condition: Column, most: float) -> Column:
    return F.when(condition, F.lit(float(most))).otherwise(F.lit(0.0))


def score(rules: list[Rule]) -> Column:
    """Sum of the rules' values, each between 0 and its maximum, over the sum of the maxima."""
    total = sum((F.greatest(F.lit(0.0), F.least(F.coalesce(v.cast("double"), F.lit(0.0)), F.lit(float(most)))) for _, most, v in rules), F.lit(0.0))
    return total / float(sum(most for _, most, _ in rules))


def manifest_rules() -> list[Rule]:
    c = F.col
    return [
        ("description", 30, c("description_len") / 300 * 30), ("build script", 10, F.when(c("has_links"), 5).when(~c("has_build"), 10).otherwise(0)), ("examples", 5, has(c("has_examples"), 5)),
        ("tests", 5, has(c("has_tests"), 5)), ("code of conduct", 10, has(c("has_conduct"), 10)), ("benches", 5, has(c("has_benches"), 5)), ("documentation", 30, has(c("has_docs"), 30)),
        ("homepage", 20, has(c("has_homepage"), 20)), ("repository", 10, has(c("has_repo"), 10)), ("verified", 15, has(c("is_verified"), 15)), ("keywords", 8, c("n_keywords")),
        ("categories", 6, c("n_categories")), ("features", 4, c("n_features")), ("badges", 1, c("n_badges")), ("stable compiler", 20, has(c("on_stable"), 20)),
        ("edition", 5, F.when(c("edition") >= 2021, 5).when(c("edition") >= 2018, 4).otherwise(0)), ("licence", 10, has(c("useful_license"), 10)),
    ]


def readme_rules() -> list[Rule]:
    c = F.col
    return [
        ("length", 75, c("text_len") / 3000 * 75), ("code length", 100, c("code_len") / 2000 * 100), ("blocks", 25, c("n_pre") * 5), ("has code", 30, has((c("code_len") > 150) & (c("n_pre") > 0), 30)),
        ("images", 35, c("n_images") * 25), ("sections", 30, c("n_sections") * 4), ("rows", 25, c("n_rows") * 2),
    ]


def version_rules() -> list[Rule]:
    c = F.col
    live = lambda value: F.when(c("n_live") > 0, value).otherwise(0)
    return [
        ("more than one", 20, has(c("n_releases") > 1, 20)), ("history", 40, live(c("history_days") / 11)), ("recent", 10, live(has(c("last_year") > 2017, 10))), ("proper", 15, live(c("n_proper"))),
        ("patches of stable", 20, live(4 * c("n_stable_patches"))), ("patches", 10, live(c("max_patch"))), ("0.x patches", 8, live(has(c("zero_patched"), 8))), ("pre-release", 5, live(has(c("n_pre") > 0, 5))),
        ("stable", 10, live(has(c("n_stable") > 0, 10))), ("yanked", 2, live(has(c("n_yanked") > 0, 2))),
    ]


def people_rules() -> list[Rule]:
    c = F.col
    return [("several owners", 3, has(c("n_owners") > 1, 3)), ("owners", 4, c("n_owners")), ("authors", 5, c("n_authors")), ("contributors", 7, c("n_contributors") / 7)]


def code_rules() -> list[Rule]:
    c = F.col
    return [("some", 1, has(c("code_lines") > 700, 1)), ("not too much", 1, has(c("code_lines") < 80_000, 1)), ("size", 2, c("code_lines") / 5000 * 2), ("comments", 2, 10 * c("comment_lines") / (3000 + c("code_lines")) * 2)]


def static_score(packages: DataFrame) -> DataFrame:
    """The five groups weigh 2, 5, 2, 5 and 3."""
    groups = [("manifest", 2, score(manifest_rules()) * 2), ("readme", 5, score(readme_rules()) * 5), ("code", 2, score(code_rules()) * 2), ("versions", 5, score(version_rules()) * 5), ("people", 3, score(people_rules()) * 3)]
    return packages.withColumn("static_score", score(groups))


def freshness_interval() -> Column:
    """Days after which a release of this maturity counts as old."""
    major, minor, patch = F.col("major"), F.col("minor"), F.col("patch")
    days = F.when((major > 0) & (patch > 3), 700).when(major > 0, 450).when(patch > 10, 300).when(patch > 3, 200).when(minor > 1, 140).otherwise(80)
    return F.least(days, 50 * F.col("n_releases")) / F.when(F.col("is_nightly"), 4).otherwise(1)


def temporal_rules() -> list[Rule]:
    c, app = F.col, F.col("is_app_only")
    interval = freshness_interval()
    decay = interval / 2 + F.when(c("is_nightly"), 30).when(c("is_app_only"), 300).otherwise(200)
    fresh = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (c("age_days") - interval) / decay))
    cleaned, rd = c("cleaned_downloads"), F.sqrt(c("direct_users"))
    return [
        ("growth", 2, F.when(~app, c("growth") - 1)), ("freshness", 14, 14 * fresh), ("dependencies", 10, 10 * c("dep_freshness")),
        ("downloads", 5, (F.log2(F.greatest(c("downloads"), F.lit(150))) - 6) / F.when(app, 5).otherwise(6)), ("cleaned downloads", 17, F.log2(F.greatest(cleaned, F.lit(1))) - 5), ("traction", 2, 2 * c("external_usage")),
        ("users", 8, F.when(~app, F.sqrt(c("active_users")))), ("dependents", 10, F.when(~app, rd)), ("indirect", 6, F.when(~app, F.log2(1 + c("indirect_users") / 4))), ("docs", 1, has(c("has_docs"), 1)),
    ]


def temporal_score(packages: DataFrame) -> DataFrame:
    """S3."""
    return packages.withColumn("temporal_score", score(temporal_rules()))


def combined_score(packages: DataFrame) -> DataFrame:
    """.4 static + .5 temporal + .1 of the larger, times the penalties that apply."""
    c = F.col
    base = 0.4 * c("static_score") + 0.5 * c("temporal_score") + 0.1 * F.greatest("static_score", "temporal_score")
    factors = [("is_macro_or_sys", 0.9), ("is_sub_component", 0.8), ("is_internal", 0.5), ("is_autopublished", 0.8), ("is_deprecated", 0.2), ("in_flagged_category", 0.4), ("off_registry", 0.75), ("is_yanked_or_squatted", 0.001)]
    for flag, factor in factors:
        base = base * F.when(F.coalesce(c(flag), F.lit(False)), factor).otherwise(1.0)
    return packages.withColumn("score", base * c("former_glory"))


def dependency_freshness(deps: DataFrame) -> DataFrame:
    """Per package the product over dependencies of .2 + .8 times their freshness (1 if the latest matched)."""
    f = F.when(F.col("matches_latest"), 1.0).when(F.col("optional"), 0.8 + 0.2 * F.col("popularity")).otherwise(F.col("popularity"))
    return deps.groupBy("package").agg(F.product(0.2 + 0.8 * f).alias("dep_freshness"))


def cleaned_downloads(daily: DataFrame, uses: DataFrame, packages: DataFrame, halve: float = 0.5) -> DataFrame:
    """A package's downloads minus a share of those of its largest user."""
    total = daily.groupBy("package").agg(F.sum("n").alias("downloads"))
    largest = uses.select("package", "depender").distinct().join(total.select(F.col("package").alias("depender"), F.col("downloads").alias("theirs")), "depender").groupBy("package").agg(F.max("theirs").alias("theirs"))
    out = packages.select("package").join(total, "package", "left").join(largest, "package", "left")
    return out.select("package", F.greatest(F.lit(0.0), F.coalesce("downloads", F.lit(0.0)) - halve * F.coalesce("theirs", F.lit(0.0))).alias("cleaned_downloads"))


def pairwise_rank_check(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of expert pairs (lower, higher) how many the scores put in that order."""
    s = scores.select("package", "score")
    both = pairs.join(s.select(F.col("package").alias("lower"), F.col("score").alias("a")), "lower").join(s.select(F.col("package").alias("higher"), F.col("score").alias("b")), "higher")
    return both.agg(F.count("*").alias("n_pairs"), F.count_if(F.col("a") < F.col("b")).alias("n_right"))


def stale_after(releases: DataFrame) -> DataFrame:
    """Limits in days for stable and pre-releases by maintenance status, and the severity of being over.

    Columns: package, age_days, is_pre, is_nightly, newer_pre, has_stable, status (1 passive to 8 as the status factor).
    """
    c = F.col
    stable = F.least(F.lit(2330.0), F.when(c("is_nightly"), 6 * 31).otherwise(36 * 31) * F.when(c("newer_pre"), 2).otherwise(1) * c("status") / 3)
    pre = F.least(F.lit(366.0), F.when(c("is_nightly"), 2 * 31).otherwise(3 * 31) * F.when(~c("has_stable"), 3).otherwise(1) * c("status") / 3)
    limit = F.when(c("is_pre"), pre).otherwise(stable)
    return releases.select("package", limit.alias("limit_days"), F.when(c("age_days") > limit, F.least(F.lit(3.0), c("age_days") / limit)).otherwise(0.0).alias("severity"))


def package_warnings(packages: DataFrame, rules: list[tuple[str, int, Column]]) -> DataFrame:
    """One row per package and rule that holds. A rule is (kind, severity, condition); the frame is read once."""
    hits = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(kind).alias("kind"), F.lit(sev).alias("severity"))) for kind, sev, cond in rules]))
    return packages.select("package", F.explode(hits).alias("w")).select("package", "w.kind", "w.severity")


def lint_rules() -> list[tuple[str, int, Column]]:
    """The lints that follow from one row: flagged or squatted packages get only that one."""
    c = F.col
    plain = ~F.coalesce(c("is_flagged"), F.lit(False)) & ~F.coalesce(c("is_placeholder"), F.lit(False))
    helper = F.coalesce(c("is_macro"), F.lit(False)) | F.coalesce(c("is_internal"), F.lit(False))
    return [
        ("flagged", 3, c("is_flagged")), ("reserved", 2, ~F.coalesce(c("is_flagged"), F.lit(False)) & c("is_placeholder")), ("big", 1, plain & (c("size") > 10_000_000)), ("license_slash", 0, plain & c("license").contains("/")),
        ("not_in_repo", 2, plain & (c("n_releases") > 1) & ~c("found_in_repo")), ("no_keywords", 1, plain & ~helper & (c("n_keywords") == 0)), ("no_categories", 1, plain & ~helper & (c("n_categories") == 0)),
        ("native_without_links", 1, plain & c("is_sys") & ~c("has_links")), ("old_edition", 1, plain & (((c("min_compiler") >= 56) & (c("edition") < 2021)) | ((c("min_compiler") >= 31) & (c("edition") < 2018)))),
        ("docs_failed", 2, plain & ~c("docs_built")), ("outdated_dependency", 2, plain & (c("outdated_share") > 0.5)), ("wildcard_requirement", 2, plain & (c("requirement") == "*")),
    ]
