"""Language identification by prediction by partial matching (PPM).

For every language a variable-order byte context tree (orders 0 to 3) is
counted over a bounded sample of the training rows, then frozen. A text's code
length under a language is the sum over its bytes of -log2 P(byte | longest
retained context); an unseen byte pays the escape probability of method C and
is coded by the next shorter context, with the symbols already ruled out
excluded. The language with the shortest code wins.

The compiled trees are one dense table (context, byte class) -> code length per
language. ``model_mb`` bounds it, so it is broadcast whatever the corpus size.

Edge cases: a null text, or one without any letter, is ``und`` with score 0;
rows without a language, text or known key still get a prediction but are never
training rows; ties go to the alphabetically first language; without any
training row everything is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import field_ddl, slices, small_batches, text_bytes

START = 10  # what stands before a text's first byte
WINDOW = 1 << 18


@dataclass
class PpmModel:
    languages: list[str]
    classes: np.ndarray  # byte -> class, 0 for bytes never seen in training
    context: np.ndarray  # three classes -> node of the longest retained context
    cost: np.ndarray  # (node * classes + class) -> bits per language


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 4 << 20):
        langs = batch.column("lang")
        for lang in pc.unique(langs).to_pylist():
            buf, offs = text_bytes(batch.column("text").filter(pc.equal(langs, lang)))
            grams = [_grams(buf, offs, a, min(a + WINDOW, int(offs[-1]))) for a in range(int(offs[0]), int(offs[-1]), WINDOW)]
            if not grams:
                continue
            keys, n = np.unique(np.concatenate(grams), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def _shifted(buf: np.ndarray, offs: np.ndarray, a: int, b: int, start: int) -> list[np.ndarray]:
    """Values at positions i-3, i-2, i-1 and i for i in [a, b); before a text's start stands ``start``."""
    out = []
    for k in (3, 2, 1, 0):
        lo = a - k
        part = buf[max(lo, 0) : b - k].copy() if b - k > max(lo, 0) else buf[:0].copy()
        if lo < 0:
            part = np.concatenate([np.full(min(-lo, b - a), start, buf.dtype), part])
        for j in range(k):
            at = offs + j
            at = at[(at >= a) & (at < b)] - a
            part[at] = start
        out.append(part)
    return out


def _grams(buf: np.ndarray, offs: np.ndarray, a: int, b: int) -> np.ndarray:
    out = np.zeros(b - a, np.uint32)
    for part in _shifted(buf, offs, a, b, START):
        out = (out << np.uint32(8)) | part
    return out


def train(docs: DataFrame, is_training: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", docs_per_language: int = 4000, max_grams: int = 600_000, model_mb: int = 48) -> PpmModel:
    """Fit on about ``docs_per_language`` rows of each language, taken by a hash of the key.

    The sample share follows from one count per language; whole texts are used.
    ``max_grams`` (the most frequent 4-grams) bounds what reaches the driver,
    ``model_mb`` the compiled table.
    """
    rows = small_batches(docs).where(is_training & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 20)).alias("h"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return PpmModel([], np.zeros(256, np.int64), np.zeros(1, np.int32), np.zeros((0, 0), np.float32))
    limit = F.coalesce(*[F.when(F.col("lang") == x, F.lit(int((1 << 20) * min(1.0, docs_per_language / sizes[x])) + 1)) for x in languages])
    counts = rows.where(F.col("h") < limit).select("lang", "text").mapInArrow(_gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "lang", "gram").limit(max_grams).toArrow()
    return _compile(languages, top, model_mb)


def _compile(languages: list[str], counts: pa.Table, model_mb: int) -> PpmModel:
    lang = np.array([languages.index(x) for x in counts["lang"].to_pylist()], np.int64)
    gram, n = counts["gram"].to_numpy().astype(np.int64), counts["n"].to_numpy().astype(np.float64)
    seen = np.unique(np.concatenate([(gram >> s) & 255 for s in (0, 8, 16, 24)] + [np.array([START])]))
    classes = np.zeros(256, np.int64)
    classes[seen] = np.arange(1, len(seen) + 1)
    width, count = len(seen) + 1, len(languages)
    c = [classes[(gram >> s) & 255] for s in (24, 16, 8, 0)]
    most = max(1, (model_mb << 20) // (4 * width * count))
    # Tables of counts by order: context code, language, symbol.
    nodes = [np.zeros(1, np.int64)]
    for order in (1, 2, 3):
        code = _code(c[3 - order : 3], width)
        keys, inverse = np.unique(code, return_inverse=True)
        weight = np.bincount(inverse, n)
        left = most - sum(map(len, nodes))
        keep = np.sort(np.argsort(-weight, kind="stable")[: max(0, left)])
        nodes.append(keys[keep])
    first = np.cumsum([0, *map(len, nodes)])
    dense = np.empty((first[-1], count, width), np.float32)
    node_of: list[np.ndarray] = []
    for order in range(4):
        table = np.full(width**order, -1, np.int32)
        table[nodes[order]] = first[order] + np.arange(len(nodes[order]))
        if order:  # a context that was not retained falls back to its suffix
            shorter = np.tile(node_of[-1], width)
            table = np.where(table < 0, shorter, table)
        node_of.append(table)
        if not len(nodes[order]):
            continue
        code = _code(c[3 - order : 3], width) if order else np.zeros(len(n), np.int64)
        at = np.searchsorted(nodes[order], code)
        ok = (at < len(nodes[order])) & (nodes[order][np.minimum(at, len(nodes[order]) - 1)] == code)
        total = np.zeros((len(nodes[order]), count, width))
        np.add.at(total, (at[ok], lang[ok], c[3][ok]), n[ok])
        if order:
            parent = dense[node_of[order - 1][nodes[order] % width ** (order - 1)]].astype(np.float64)
        else:
            parent = np.full((1, count, width), 1.0 / 256)
        dense[first[order] : first[order + 1]] = _mix(total, parent)
    cost = -np.log2(np.maximum(dense, 1e-12))
    return PpmModel(languages, classes, node_of[3], np.ascontiguousarray(cost.transpose(0, 2, 1).reshape(-1, count)).astype(np.float32))


def _code(parts: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros(len(parts[0]), np.int64)
    for p in parts:
        out = out * width + p
    return out


def _mix(count: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Method C: seen symbols get n/(N+d); the escape d/(N+d) goes to the others in the parent's proportions."""
    seen = count > 0
    total, kinds = count.sum(-1, keepdims=True), seen.sum(-1, keepdims=True)
    free = np.where(seen, 0.0, parent)
    rest = free.sum(-1, keepdims=True)
    escape = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0)
    return np.where(seen, count / np.maximum(total + kinds, 1), escape * free / np.maximum(rest, 1e-9))


def code_lengths(model: PpmModel, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Bits of every text (row) under every language (column)."""
    bits = np.zeros((len(offs) - 1, len(model.languages)))
    width = int(model.classes.max()) + 1
    for a in range(int(offs[0]), int(offs[-1]), WINDOW):
        b = min(a + WINDOW, int(offs[-1]))
        c3, c2, c1, c0 = (model.classes[p] for p in _shifted(buf, offs, a, b, START))
        cost = model.cost[model.context[(c3 * width + c2) * width + c1].astype(np.int64) * width + c0]
        rows = np.flatnonzero((offs[:-1] < b) & (offs[1:] > a))
        bits[rows] += np.add.reduceat(cost, np.maximum(offs[rows] - a, 0), axis=0, dtype=np.float64)
    return bits


def predict(docs: DataFrame, model: PpmModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus ``lang_pred`` and ``score`` (posterior under equal priors) of every text."""
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = handle.value
        names = np.array([*m.languages, "und"], object)
        for batch in slices(batches, text):
            column = batch.column(text)
            known = pc.match_substring_regex(column, r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
            best, score = np.full(batch.num_rows, len(m.languages)), np.zeros(batch.num_rows)
            if m.languages:
                bits = code_lengths(m, *text_bytes(column))
                gap = bits - bits.min(1, keepdims=True)
                best = np.where(known, bits.argmin(1), best)
                score = np.where(known, 1 / np.exp2(-np.minimum(gap, 1000)).sum(1), 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(names[best], pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    return small_batches(docs).select(*keep, text).mapInArrow(run, f"{field_ddl(docs, *keep)}, lang_pred string, score double")
