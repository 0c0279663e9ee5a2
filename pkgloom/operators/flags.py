"""Deprecated, reserved, junk and autopublished packages."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases in descriptions of deprecated packages, in lower case.
DEPRECATED_BEGIN = (
    "unmaintained ", "unmaintained! ", "deprecated", "this crate was renamed", "this crate is deprecated", "this package was renamed", "obsolete", "unfinished", "an unfinished", "unsafe and deprecated",
    "crate is abandoned", "abandoned", "an empty crate", "discontinued", "wip. ", "very early wip", "renamed to ", "crate renamed to ", "temporary fork",
)
DEPRECATED_WITHIN = ("this crate is abandoned", "this crate has been abandoned", "do not use", "this is a dummy package", "no longer maintained", "this tool is abandoned", "deprecated in favor", "project is deprecated")
DEPRECATED_END = ("please dont use", "deprecated")
# Phrases in descriptions of reserved names; the last list holds after openers are taken off.
RESERVED_BEGIN = ("contact me if you want this name", "unused crate name", "unused. contact me", "crate name not in use", "if you want to use this crate name, please contact ")
RESERVED_WITHIN = (
    "this crate is a placeholder", "reserving this crate", "only to reserve the name", "this crate has been retired", " if you want this crate name", "want to use this name", "this is a dummy package",
    "if you would like to use this crate name, please contact", "if you want this name, please contact me", "this crate is reserved ",
)
RESERVED_END = (" placeholder", " reserved for use")
RESERVED_REST = (
    "reserved crate ", "reserved for future use", "placeholder", "dummy crate", "available for ownership transfer", "reserved, for", "crate name reserved for", "wip: reserved", "empty crate", "an empty crate",
    "reserved for ", "stub to squat", "claiming it before someone", "reserved name", "reserved package", "reserve the name",
)
OPENERS = "^(this crate )*(is being )*(is )*(has been )*(has )*(a )*"


def _trimmed(text: Column) -> Column:
    """``text`` from its first to its last ASCII letter; a null one is empty."""
    return F.coalesce(F.regexp_replace(text, "^[^A-Za-z]+|[^A-Za-z]+$", ""), F.lit(""))


def _phrased(text: Column, begin: tuple[str, ...] = (), within: tuple[str, ...] = (), end: tuple[str, ...] = ()) -> Column:
    return reduce(operator.or_, [*[text.startswith(p) for p in begin], *[text.contains(p) for p in within], *[text.endswith(p) for p in end]])


def deprecated_text(version: Column, description: Column, status: Column) -> Column:
    """By version marks, the declared status, or phrases of the description."""
    v, d = F.coalesce(version, F.lit("")), _trimmed(description)
    said = d.startswith("WIP") | d.endswith("WIP") | _phrased(F.lower(d), DEPRECATED_BEGIN, DEPRECATED_WITHIN, DEPRECATED_END)
    return v.contains("deprecated") | v.isin("0.0.0", "0.0.1") | F.coalesce(F.lower(status) == "deprecated", F.lit(False)) | said


def reserved_text(text: Column) -> Column:
    d = F.lower(_trimmed(text))
    return (d == "reserved") | _phrased(d, RESERVED_BEGIN, RESERVED_WITHIN, RESERVED_END) | _phrased(F.ltrim(F.regexp_replace(d, OPENERS, "")), RESERVED_REST)


def placeholder(version: Column, description: Column, readme: Column, authors: Column) -> Column:
    """A reserved name by its version, its description (the readme where there is none) or an author called ``...``."""
    v = F.coalesce(version, F.lit(""))
    dots = F.coalesce(description == "...", F.lit(False)) | F.coalesce((F.size(authors) == 1) & (F.get(authors, F.lit(0)) == "..."), F.lit(False))
    return v.contains("reserved") | v.contains("placeholder") | dots | reserved_text(F.coalesce(description, readme))


def known_junk(content: Column, hashes: tuple[str, ...]) -> Column:
    """Whether the content's SHA-256 (lower-case hex) is among ``hashes``, a short list."""
    return F.coalesce(F.sha2(content.cast("binary"), 256).isin(*hashes), F.lit(False)) if hashes else F.lit(False)


def autopublished(name: Column, description: Column) -> Column:
    """B15."""
    return F.coalesce(description.startswith("Automatically published "), F.lit(False)) | F.coalesce(name.startswith("rustc-ap-"), F.lit(False))


def deprecated_requirements(intervals: DataFrame, rules: DataFrame) -> DataFrame:
    """(name, requirement, is_deprecated) of every distinct requirement.

    ``intervals``: name, requirement, low, high (B19's sort keys, high
    exclusive). ``rules``: name, bound; a requirement is deprecated if a rule of
    its name has no bound, or a bound (a sort key) that the interval holds.
    """
    wanted = intervals.select("name", "requirement", "low", "high").distinct()
    hit = F.col("_rule") & (F.col("bound").isNull() | ((F.col("bound") >= F.col("low")) & (F.col("bound") < F.col("high"))))
    found = wanted.join(rules.select("name", "bound", F.lit(True).alias("_rule")), "name", "left")
    return found.groupBy("name", "requirement").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("is_deprecated"))


def flag_packages(packages: DataFrame, junk: tuple[str, ...] = ()) -> DataFrame:
    """Flags of packages (package, version, description; name, status, readme, authors array and content where the table has them).

    A reserved name and known junk count as deprecated too.
    """

    def given(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in packages.columns else F.lit(None).cast(kind)

    d, v = F.col("description"), F.col("version")
    flags = packages.select(
        "package", deprecated_text(v, d, given("status")).alias("said"), placeholder(v, d, given("readme"), given("authors", "array<string>")).alias("is_placeholder"),
        known_junk(given("content"), junk).alias("is_junk"), autopublished(given("name"), d).alias("is_autopublished"),
    )
    return flags.select("package", (F.col("said") | F.col("is_placeholder") | F.col("is_junk")).alias("is_deprecated"), "is_placeholder", "is_junk", "is_autopublished")
