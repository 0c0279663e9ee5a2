"""Learned operators: exact code lengths, held-out accuracy, edge cases."""

import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pkgloom.llm import decontamination, language_id, toxicity
from pkgloom.llm.common import fold, text_bytes


@pytest.fixture(scope="module")
def frames(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("held_out", fold(F.col("doc_id")) == 0)
    return docs.cache(), spark.read.parquet(f"{d}/labels.parquet")


def test_languages_of_held_out_rows(frames):
    docs, _ = frames
    model = language_id.train(docs, ~F.col("held_out"), docs_per_language=300)
    got = language_id.predict(docs.where("held_out"), model, keep=("doc_id", "lang")).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.99
    assert got.score.between(0, 1).all()


def test_code_lengths_are_those_of_the_frozen_statistics(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("abab", "x"), ("abba", "x"), ("bbbb", "y"), ("bbba", "y")])]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    model = language_id.train(df, F.lit(True))
    counts = {}
    for _, t, lang in rows:
        padded = "\n\n\n" + t
        for p in range(3, len(padded)):
            for k in range(4):
                c = counts.setdefault(lang, {}).setdefault(padded[p - k : p], {})
                c[padded[p]] = c.get(padded[p], 0) + 1
    symbols = [chr(i) for i in range(256)]

    def dist(lang, context):
        """The same mixture by plain recursion over all byte values."""
        parent = {s: 1 / 256 for s in symbols} if not context else dist(lang, context[1:])
        known = any(context in counts[x] for x in counts)
        c = counts[lang].get(context, {}) if known else {}
        if context == "":
            parent = {s: 1 / 256 for s in symbols}
        if not c:
            return parent
        total, kinds = sum(c.values()), len(c)
        seen_classes = {s for x in counts.values() for v in x.values() for s in v} | {"\n"}
        free = {s: p for s, p in parent.items() if s not in c and (s in seen_classes)}
        other = parent["\x00"]
        rest = sum(free.values()) + other
        out = {s: total and c[s] / (total + kinds) for s in c}
        out |= {s: kinds / (total + kinds) * p / rest for s, p in free.items()}
        return {s: out.get(s, kinds / (total + kinds) * other / rest) for s in symbols}

    for text in ("ab", "bba", "aaaa"):
        bits = language_id.code_lengths(model, *text_bytes(pa.array([text])))[0]
        for j, lang in enumerate(model.languages):
            padded = "\n\n\n" + text
            want = sum(-math.log2(dist(lang, padded[p - 3 : p])[padded[p]]) for p in range(3, len(padded)))
            assert abs(bits[j] - want) < 1e-3


def test_language_edge_cases(spark):
    df = spark.createDataFrame([(1, "hello world", "en"), (2, "bonjour le monde", "fr"), (3, None, "en"), (4, "12 !?", "fr"), (5, "hello", None), (6, "", "en"), (None, "world " * 40000, "en")], "doc_id long, text string, lang string")
    model = language_id.train(df, F.lit(True))
    got = {r.doc_id: r for r in language_id.predict(df, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, 6, None)] == ["en", "fr", "und", "und", "en", "und", "en"] and got[3].score == 0
    none = language_id.train(df, F.lit(False))
    assert {r.lang_pred for r in language_id.predict(df, none).collect()} == {"und"}
    assert language_id.predict(df.limit(0), model).count() == 0


def test_toxicity_of_held_out_rows(frames):
    docs, labels = frames
    model = toxicity.train(docs, labels, ~F.col("held_out"), fold(F.col("doc_id")) == 1)
    got = toxicity.predict(docs.where("held_out"), model).join(labels, "doc_id").toPandas()
    rank = got.score.rank()
    n1 = got.toxic.sum()
    auc = (rank[got.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(got) - n1))
    assert auc > 0.93 and (got.predicted == got.toxic).mean() > 0.93
    edge = docs.sparkSession.createDataFrame([(1, None), (2, ""), (3, "!!!"), (4, "idiot moron " * 5)], "doc_id int, text string")
    out = {r.doc_id: r for r in toxicity.predict(edge, model).collect()}
    assert out[1].score == out[2].score == out[3].score and out[1].predicted == 0 and out[4].predicted == 1


def test_toxicity_without_a_class(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    model = toxicity.train(df, labels, F.lit(True), F.lit(False))
    assert [r.score for r in toxicity.predict(df, model).collect()] == [0.0, 0.0]
    assert toxicity.train(df, labels.limit(0), F.lit(True), F.lit(False)).constant == 0.0


def plain_kneser_ney(texts):
    """Probability of a symbol after a history, per class, by the textbook's sums over dictionaries."""
    words = [[(chr(toxicity.EDGE) + w + chr(toxicity.EDGE)) for t, c in texts if c == j for w in t.split()] for j in (0, 1)]
    raw = [{}, {}]
    for j in (0, 1):
        for w in words[j]:
            for i in range(1, len(w)):
                g = w[max(0, i - toxicity.ORDER + 1) : i + 1]
                raw[j][g] = raw[j].get(g, 0) + 1
    every = set(raw[0]) | set(raw[1])
    tables = {}
    for order in range(toxicity.ORDER, 0, -1):
        longer = {g for g in (every if order == toxicity.ORDER else set(tables[order + 1])) if len(g) > order} if order < toxicity.ORDER else set()
        grams = {g for g in every if len(g) == order} | {g[1:] for g in longer}
        tables[order] = {}
        for g in grams:
            counts = []
            for j in (0, 1):
                up = [h for h in longer if h[1:] == g]
                counts.append(raw[j].get(g, 0) + sum(tables[order + 1][h][j] > 0 for h in up))
            pooled = sum(raw[j].get(g, 0) for j in (0, 1)) + sum(sum(tables[order + 1][h][2:]) > 0 for h in [h for h in longer if h[1:] == g])
            tables[order][g] = (*counts, pooled)

    def probability(j, history, symbol):
        p = 1 / 256
        for order in range(1, toxicity.ORDER + 1):
            if len(history) < order - 1:
                break
            context = history[len(history) - order + 1 :]
            row = {g: (c[2] if order <= toxicity.SHARED else c[j]) for g, c in tables[order].items() if g[:-1] == context}
            row = {g: c for g, c in row.items() if c}
            if row:
                total = sum(row.values())
                p = max(row.get(context + symbol, 0) - toxicity.DISCOUNT, 0) / total + toxicity.DISCOUNT * len(row) / total * p
        return p

    return probability


def test_kneser_ney_equals_the_plain_sums(spark):
    rng = np.random.default_rng(3)
    texts = [(" ".join("".join(rng.choice(list("abc"), rng.integers(1, 9))) for _ in range(12)), i % 3 == 0) for i in range(9)] + [("zyxwvu", True)]
    rows = spark.createDataFrame([(t, bool(c)) for t, c in texts], "text string, toxic boolean")
    counts = rows.mapInArrow(toxicity._counted, "gram bigint, n0 bigint, n1 bigint").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    table = toxicity.kneser_ney(counts)
    plain = plain_kneser_ney([(t, int(c)) for t, c in texts])
    number = lambda g: int.from_bytes(g.encode("latin-1"), "big")
    histories = ["\x02", "\x02a", "\x02ab", "abcab", "\x02zyx", "zyxwv", "qqqqq"]
    symbols = [chr(c) for c in range(1, 256)]
    grams = {(h + s)[-toxicity.ORDER :]: (h, s) for h in histories for s in symbols}
    got = {r.gram: (r.p0, r.p1) for r in toxicity.probabilities(spark.createDataFrame([(number(g),) for g in grams], "gram bigint"), table).collect()}
    for g, (h, s) in grams.items():
        assert got[number(g)] == pytest.approx((plain(0, h, s), plain(1, h, s)), rel=1e-9), (h, s)
    for h in histories:
        for j in (0, 1):
            assert sum(got[number((h + s)[-toxicity.ORDER :])][j] for s in symbols) + plain(j, h, "\0") == pytest.approx(1)


def test_both_ways_of_toxicity_score_alike(spark):
    texts = ["plain words here", "zyxwvu", "other plain words, und ÄRGER", "zyxwvu plain", None, "", "?!", "plain " * 40_000, "x" * 70_000, "zyxwvu"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"score": F.lit("mine"), "evidence": F.lit(1), "digest": F.lit(2), "gram": F.lit(3)})
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 0), (3, 1), (3, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(df, labels, F.col("doc_id") < 3, F.lit(False))
    one = {r.doc_id: r.e for r in toxicity.evidence_of(df, model, ("doc_id",), name="e").collect()}
    two = {r.doc_id: r.e for r in toxicity.evidence_of(df, model, ("doc_id",), name="e", most=0).collect()}
    assert one.keys() == two.keys() and one == pytest.approx(two, rel=1e-5, abs=1e-9)
    assert one[1] == one[9] > 0 > one[0] and one[4] == one[5] == one[6] == 0
    assert toxicity.remove(df, model).columns == df.columns
    assert toxicity.predict(df.limit(0), model).count() == 0


def contaminated(doc, item, window=15, similarity=0.8):
    m = min(window, len(item))
    for shift in range(-len(item), len(doc) + 1):
        same = [0 <= t + shift < len(doc) and doc[t + shift] == item[t] for t in range(len(item))]
        lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
        for s in range(lo, hi - m + 1):
            if sum(same[s : s + m]) >= similarity * m:
                return True
    return False


def test_decontamination(spark):
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(3000)}"
    items = [[word() for _ in range(n)] for n in (40, 20, 7, 15, 33, 3, 1, 6)]
    docs = [[word() for _ in range(300)] for _ in range(60)]
    for i, doc in enumerate(docs[:40]):
        item = list(items[i % 8])
        for p in range(3, len(item), 7):
            if i % 3 == 0:
                item[p] = "changed"
        at = rng.integers(250)
        doc[at : at + len(item)] = item if i % 7 else item[: max(5, len(item) // 2)]
    bench = spark.createDataFrame([(i, " ".join(t).upper()) for i, t in enumerate(items)] + [(77, None), (78, "")], "item_id long, text string")
    rows = spark.createDataFrame([(i, ", ".join(t)) for i, t in enumerate(docs)] + [(900, None), (901, ""), (None, " ".join(items[0]))], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    got = {(r.doc_id, r.item_id) for r in decontamination.find(rows, bench).collect()}
    want = {(i, j) for i, d in enumerate(docs) for j, t in enumerate(items) if contaminated(d, t)} | {(None, 0)}
    assert got == want
    kept = {r.doc_id for r in decontamination.remove(rows, bench).collect()}
    assert kept == {i for i in [*range(60), 900, 901]} - {d for d, _ in want}
    assert decontamination.find(rows, bench.limit(0)).count() == 0 and decontamination.find(rows.limit(0), bench).count() == 0
    wide = {(r.doc_id, r.item_id) for r in decontamination.find(rows, bench, broadcast_rows=0).collect()}
    assert wide == want


def test_every_accepted_substitution_leaves_a_seed():
    for words in range(1, 16):
        most = max(k for k in range(words) if words - k >= 0.8 * words)
        masks = [[i for i, bit in enumerate(decontamination.MASKS[m]) if bit == "1"] for m in decontamination.masks_of(words)]
        for changed in itertools.combinations(range(words), most):
            assert any(all(s + i not in changed for i in mask) for mask in masks for s in range(words - mask[-1])), (words, changed)


def test_short_items_with_a_changed_word(spark):
    rows = [(e, " ".join(f"q{e}x" if j == e else f"w{j}" for j in range(n))) for n in (5,) for e in range(5)] + [(10 + e, " ".join("zz" if j == e else f"v{j}" for j in range(6))) for e in range(6)] + [(20, "before one two after"), (21, "one three two")]
    bench = spark.createDataFrame([(1, "w0 w1 w2 w3 w4"), (2, "v0 v1 v2 v3 v4 v5"), (3, "one two")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(e, 1) for e in range(5)} | {(10 + e, 2) for e in range(6)} | {(20, 3)}
