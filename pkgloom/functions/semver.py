"""Versions as sortable columns, and requirements as intervals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATTERN = r"^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)(?:-([0-9A-Za-z.-]+))?(?:\+([0-9A-Za-z.-]+))?$"
TOP = "￿"


def parse(version: Column) -> Column:
    """(major, minor, patch, pre, build); null if it is no version."""
    part = lambda i: F.regexp_extract(version, PATTERN, i)
    text = lambda i: F.nullif(part(i), F.lit(""))
    fields = F.struct(part(1).cast("bigint").alias("major"), part(2).cast("bigint").alias("minor"), part(3).cast("bigint").alias("patch"), text(4).alias("pre"), text(5).alias("build"))
    return F.when(version.rlike(PATTERN), fields)


def key(version: Column) -> Column:
    """A text that sorts as versions do: numbers padded, a release after its pre-releases, numeric parts before words."""
    v = parse(version)
    number = lambda c: F.lpad(c.cast("string"), 12, "0")
    parts = F.transform(F.split(v["pre"], r"\."), lambda p: F.when(p.rlike("^[0-9]+$"), F.concat(F.lit("0"), F.lpad(p, 12, "0"))).otherwise(F.concat(F.lit("1"), p)))
    pre = F.when(v["pre"].isNull(), F.lit("~")).otherwise(F.concat(F.lit("-"), F.array_join(parts, " ")))
    return F.when(v.isNotNull(), F.concat(number(v["major"]), F.lit("."), number(v["minor"]), F.lit("."), number(v["patch"]), pre))


def compat_class(version: Column) -> Column:
    """What an upgrade may change without breaking: the major number, below 1 the minor, below 0.1 the patch."""
    v = parse(version)
    return F.when(v["major"] > 0, F.concat(v["major"].cast("string"))).when(v["minor"] > 0, F.concat(F.lit("0."), v["minor"].cast("string"))).when(v.isNotNull(), F.concat(F.lit("0.0."), v["patch"].cast("string")))


def major_differs(a: Column, b: Column) -> Column:
    return compat_class(a) != compat_class(b)


def stability(version: Column) -> Column:
    """Stable from 1.0, okay for later 0.x, else unstable; pre-releases are unstable."""
    v = parse(version)
    return F.when(v["pre"].isNotNull(), "unstable").when(v["major"] > 0, "stable").when((v["minor"] > 1) & (v["patch"] > 0), "okay").when(v.isNotNull(), "unstable")


def _padded(major: int, minor: int = 0, patch: int = 0, tail: str = "~") -> str:
    return f"{major:012d}.{minor:012d}.{patch:012d}{tail}"


def interval(requirement: str) -> tuple[str, str] | None:
    """[low, high) on sort keys of one requirement; pre-releases only match where the requirement names one."""
    low, high = _padded(0, tail="-"), TOP
    for clause in (requirement or "").split(","):
        clause = clause.strip()
        op = clause[: len(clause) - len(clause.lstrip("^~<>= "))].strip()
        body = clause.lstrip("^~<>= ").split("+")[0]
        if body in ("*", "") and not op:
            continue
        core, _, pre = body.partition("-")
        parts = core.split(".")
        numbers = [p for p in parts if p not in ("*", "x", "X")]
        if not numbers or len(parts) > 3 or not all(p.isdigit() for p in numbers):
            return None
        n = [int(p) for p in numbers]
        full = n + [0] * (3 - len(n))
        words = " ".join(f"0{int(p):012d}" if p.isdigit() else f"1{p}" for p in pre.split(".")) if pre else ""
        start = _padded(*full, tail=f"-{words}" if pre else "-")
        exact = _padded(*full, tail=f"-{words}" if pre else "~")
        up = lambda i: _padded(*[*full[:i], full[i] + 1, *[0] * (2 - i)], tail="-")
        if len(numbers) < len(parts) and op in ("", "=", "^", "~"):
            a, b = start, up(len(n) - 1)
        elif op in ("", "^"):
            a, b = start if not pre else exact, up(next((i for i, x in enumerate(n) if x), len(n) - 1))
        elif op == "~":
            a, b = start if not pre else exact, up(min(1, len(n) - 1))
        elif op == "=":
            a, b = (exact, exact + "\x00") if len(n) == 3 else (start, up(len(n) - 1))
        elif op == ">=":
            a, b = (exact if pre else start), TOP
        elif op == ">":
            a, b = (exact + "\x00") if len(n) == 3 else up(len(n) - 1), TOP
        elif op == "<":
            a, b = low, (exact if pre else start)
        elif op == "<=":
            a, b = low, (exact + "\x00") if len(n) == 3 else up(len(n) - 1)
        else:
            return None
        low, high = max(low, a), min(high, b)
    return (low, high) if low < high else None


def requirement_intervals(deps: DataFrame, requirement: str = "requirement") -> DataFrame:
    """Every distinct requirement with its [low, high) of sort keys; impossible ones have nulls."""

    def compiled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            bounds = [interval(r) or (None, None) for r in frame[requirement]]
            yield frame.assign(low=[b[0] for b in bounds], high=[b[1] for b in bounds])

    return deps.select(requirement).distinct().mapInPandas(compiled, f"`{requirement}` string, low string, high string")


def semver_table(releases: DataFrame, version: str = "version") -> DataFrame:
    """Releases with ``sort_key``, ``compat`` class, ``is_pre`` and ``stability``."""
    v = F.col(version)
    return releases.withColumns({"sort_key": key(v), "compat": compat_class(v), "is_pre": parse(v)["pre"].isNotNull(), "stability": stability(v)})
