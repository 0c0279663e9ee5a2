"""Secret scans: base patterns, and sliding-window Shannon entropy over candidate strings.

Base kinds are key assignments, access keys and long hex runs. Further
candidates are runs of 20 or more key characters holding a digit and a letter.
A window of ``WINDOW`` characters slides over each; the counts of the entering
and the leaving character update the sum of c * log2(c), so every step costs
the same, and a text of any length is scanned in time that grows with it. The highest window entropy is held against the threshold of the
narrowest character class the candidate fits (hex, letters and digits, base64).
Candidates on the allow list (UUIDs, paths, addresses of pages, dotted or
counting texts, placeholders) and those that a base span covers add nothing.

Column expressions only. Edge cases: a null text has no spans (as an empty
one); repeated rows are scanned alike; other columns are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import clear_of, counted, let, listed, matches, ordered, plain, replaced

KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
# Bits of a window: class pattern, least entropy.
CLASSES = (("^[0-9A-Fa-f]+$", 3.0), ("^[0-9A-Za-z]+$", 3.6), ("^[0-9A-Za-z+/_=-]+$", 3.8))
ALLOWED = (
    "^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    "^[+-]?[0-9]+([eE][+-]?[0-9]+)?$",
    "^/?(?:[A-Za-z_-]++/){2,}+[A-Za-z0-9_-]*$",
    "(?i)example|placeholder|changeme|x{4,}|0123456789|abcdefgh",
    "^[A-Za-z]++(?:[_-][A-Za-z]++)*+[_-]?[0-9]{1,4}$",
)
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"


def base_spans(text: Column) -> Column:
    assign = F.filter(matches(text, ASSIGN, "assign", text.rlike(r"(?i)(?:passw(?:or)?d|secret|token|api_?key)[\"']?\x20*[:=]")), lambda s: F.length(F.regexp_replace(s["value"], ASSIGN_VALUE, "")) >= 6)
    access = F.filter(matches(text, ACCESS, "access", text.contains("AKIA")), lambda s: F.length(s["value"]) >= 20)
    hexes = matches(text, HEX, "hex", text.rlike(HEX))
    return ordered(F.concat(assign, access, hexes), KINDS)


def window_entropy(value: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy (bits) of any ``window`` characters of an ASCII text; 0 for a shorter one."""
    plogp = [c * math.log2(c) if c > 1 else 0.0 for c in range(window + 2)]
    up = F.array(*[F.lit(b - a) for a, b in zip(plogp, plogp[1:], strict=False)])  # a further one of c equal characters
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.ascii(c))
    zero = F.struct(F.expr("CAST(array() AS array<int>)").alias("held"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))
    count = lambda held, x: F.size(F.filter(held, lambda y: y == x))
    full = lambda acc: F.size(acc["held"]) == window
    highest = lambda acc: F.greatest(acc["best"], F.when(full(acc), math.log2(window) - acc["s"] / window).otherwise(0.0))

    def step(acc: Column, x: Column) -> Column:
        rest = F.when(full(acc), F.slice(acc["held"], 2, window)).otherwise(acc["held"])
        left = F.when(full(acc), F.get(up, count(rest, F.get(acc["held"], F.lit(0))))).otherwise(0.0)
        return F.struct(F.array_append(rest, x).alias("held"), (acc["s"] - left + F.get(up, count(rest, x))).alias("s"), highest(acc).alias("best"))

    return F.aggregate(codes, zero, step, highest)


def entropy_spans(text: Column, base: Column) -> Column:
    """Candidates with a window above their class's threshold, neither allowed nor overlapping a base span."""
    found = matches(text, CANDIDATE, "entropy", text.rlike(CANDIDATE))

    def secret(s: Column) -> Column:
        v = s["value"]
        least = F.coalesce(*[F.when(v.rlike(p), F.lit(t)) for p, t in CLASSES], F.lit(9.0))
        allowed = F.lit(False)
        for p in ALLOWED:
            allowed = allowed | v.rlike(p)
        return v.rlike("[0-9]") & v.rlike("[A-Za-z]") & ~allowed & (window_entropy(v) >= least - 1e-9)

    return F.filter(clear_of(found, base), secret)


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus ``base`` and ``spans``, arrays of (kind, start, end, value)."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(*keep, _both(body).alias("_found")).select(*keep, plain(F.col("_found.base")).alias("base"), plain(F.col("_found.spans")).alias("spans"))


def _both(text: Column) -> Column:
    """(base, spans): base spans, and these with the entropy spans."""
    return let(base_spans(text), lambda base: F.struct(base.alias("base"), ordered(F.concat(base, entropy_spans(text, base)), KINDS).alias("spans")))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns, with every secret in ``text`` replaced by ``mark``; null texts stay null."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(text, let(_both(body), lambda both: replaced(F.col(text), both["spans"], mark)))


def digest(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The scan as counts and digests per row."""
    found = scan(docs, text, (key,))
    return found.select(
        key,
        *[counted(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        counted(F.col("spans"), "entropy").alias("n_entropy"),
    )
