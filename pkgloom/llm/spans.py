"""Regular-expression matches with their places, as column expressions whose work grows with the text and no faster."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind:string,start:bigint,end:bigint,value:string,before:string,after:string>"
BLOCK = 256  # elements, or code points, handled together
BEFORE = 40  # code points of context before a match


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` evaluated once; within a lambda Spark evaluates a repeated expression every time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def none(element: str) -> Column:
    return F.expr(f"CAST(array() AS array<{element}>)")


def running(items: Column, zero: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], element: str) -> Column:
    """``emit(state, x)`` for every x, where ``state`` is ``zero`` advanced by ``step`` over the elements before x.

    Appending copies an array, so states are appended once per block and results
    within a block; ``element`` is the type of a result.
    """

    def blocked(blocks: Column) -> Column:
        onward = lambda acc, block: F.struct(F.aggregate(block, acc["state"], step).alias("state"), F.array_append(acc["starts"], acc["state"]).alias("starts"))
        starts = F.aggregate(blocks, F.struct(zero.alias("state"), F.slice(F.array(zero), 1, 0).alias("starts")), onward, lambda acc: acc["starts"])

        def one(block: Column, start: Column) -> Column:
            put = lambda acc, x: F.struct(step(acc["state"], x).alias("state"), F.array_append(acc["out"], emit(acc["state"], x)).alias("out"))
            return F.aggregate(block, F.struct(start.alias("state"), none(element).alias("out")), put, lambda acc: acc["out"])

        return F.flatten(F.zip_with(blocks, starts, one))

    def cut(xs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(xs) - 1) / BLOCK).cast("int"), F.lit(0))), lambda b: F.slice(xs, b * BLOCK + 1, BLOCK))

    return let(items, lambda xs: let(cut(xs), blocked))


def matches(text: Column, pattern: str, kind: str, only_if: Column) -> Column:
    """Leftmost non-overlapping matches as :data:`SPAN`, code points, end exclusive.

    ``split`` and ``regexp_extract_all`` walk the same matches, so the pieces
    between them give every place, and a match's context: up to ``BEFORE`` code
    points since the match before it, and one after it. ``only_if`` is a cheap
    test that holds for every text with a match; other texts get an empty array.
    """

    def placed(p: Column) -> Column:
        n = F.size(p["found"])
        triples = F.arrays_zip(F.slice(p["pieces"], F.lit(1), n).alias("gap"), p["found"].alias("value"), F.slice(p["pieces"], F.lit(2), n).alias("next"))

        def span(at: Column, x: Column) -> Column:
            begin = at + F.length(x["gap"])
            return F.struct(
                F.lit(kind).alias("kind"), begin.alias("start"), (begin + F.length(x["value"])).alias("end"), x["value"].alias("value"),
                F.right(x["gap"], F.lit(BEFORE)).alias("before"), F.substring(x["next"], 1, 1).alias("after"),
            )

        return running(triples, F.lit(0).cast("bigint"), lambda at, x: at + F.length(x["gap"]) + F.length(x["value"]), span, SPAN)

    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.when(only_if, let(both, placed)).otherwise(none(SPAN))


def ordered(spans: Column, kinds: tuple[str, ...]) -> Column:
    """By start, then kind in the given order, then end."""
    rank = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    key = lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s.alias("span"))
    return F.transform(F.array_sort(F.transform(spans, key)), lambda k: k["span"])


def plain(spans: Column) -> Column:
    """(kind, start, end, value) of every span."""
    return F.transform(spans, lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "value")]))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def clear_of(spans: Column, others: Column) -> Column:
    """Those of ``spans`` that overlap none of ``others``, by start: one pass each way over both in order."""
    mark = f"struct<start:bigint,own:int,span:{SPAN},hit:boolean>"

    def marked(own: int):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s.alias("span"), F.lit(False).alias("hit"))

    def passed(items: Column, zero: int, edge: Callable[[Column, Column], Column], hit: Callable[[Column, Column], Column]) -> Column:
        step = lambda state, m: F.when(m["own"] == 0, edge(state, m["span"])).otherwise(state)
        emit = lambda state, m: F.struct(m["start"].alias("start"), m["own"].alias("own"), m["span"].alias("span"), (m["hit"] | hit(state, m["span"])).alias("hit"))
        return running(items, F.lit(zero).cast("bigint"), step, emit, mark)

    def kept(spans: Column) -> Column:
        both = F.array_sort(F.concat(F.transform(others, marked(0)), F.transform(spans, marked(1))))
        forth = passed(both, 0, lambda last, s: F.greatest(last, s["end"]), lambda last, s: last > s["start"])
        back = passed(F.reverse(forth), 1 << 62, lambda next_, s: F.least(next_, s["start"]), lambda next_, s: next_ < s["end"])
        left = F.transform(F.filter(F.reverse(back), lambda m: (m["own"] == 1) & ~m["hit"]), lambda m: m["span"])
        return F.when((F.size(spans) > 0) & (F.size(others) > 0), left).otherwise(spans)

    return let(spans, kept)


def replaced(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with every maximal run of overlapping spans replaced by ``mark``; ``spans`` ordered by start."""

    def cut(p: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            inside = lambda i: F.substring(F.get(p["blocks"], i.cast("int")), (F.greatest(a - i * BLOCK, F.lit(0)) + 1).cast("int"), (F.least(b, (i + 1) * BLOCK) - F.greatest(a, i * BLOCK)).cast("int"))
            first = F.floor(a / BLOCK)
            return F.when(b > a, F.array_join(F.transform(F.sequence(first, F.greatest(F.floor((b - 1) / BLOCK), first)), inside), "")).otherwise("")

        emit = lambda at, s: F.when(s["start"] >= at, F.concat(piece(at, s["start"]), F.lit(mark))).otherwise("")
        parts = running(p["spans"], F.lit(0).cast("bigint"), lambda at, s: F.greatest(at, s["end"]), emit, "string")
        return F.concat(F.array_join(parts, ""), piece(F.array_max(F.transform(p["spans"], lambda s: s["end"])), p["size"].cast("bigint")))

    def whole(spans: Column) -> Column:
        parts = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)).alias("blocks"), spans.alias("spans"), F.length(text).alias("size"))
        return F.when(F.size(spans) > 0, let(parts, cut)).otherwise(text)

    return let(spans, whole)
