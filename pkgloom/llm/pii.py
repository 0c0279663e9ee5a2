"""Personal data by weak supervision.

Base kinds (email, ip, card, phone) come from fixed patterns and checks. A
looser pattern per kind adds candidates. Four labelers vote on every candidate:
the strict pattern, a gazetteer (known mail endings, card prefixes, country
codes, public addresses), a context word shortly before, and the characters
around it. Votes of all documents are counted in Spark by (kind, vote pattern),
which is at most kinds x 16 rows; expectation-maximisation over these counts
estimates each labeler's reliability (two classes, votes independent given the
class), and its posteriors are the soft labels on which the final span
classifier, a logistic model over the votes and the candidate's length class,
is trained, again from counts. Candidates above one half become spans; base
spans always stay.

Column expressions and tables of counts only. Edge cases: a null text has no
spans (as an empty one); without candidates nothing is learned and only base
spans are returned; candidates overlapping a base span of their kind are
dropped; repeated rows are scanned alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .spans import clear_of, counted, let, listed, matches, ordered, replaced

KINDS = ("email", "ip", "card", "phone")
OCTET = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"  # possessive: no recursion
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\)|@)\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?[A-Za-z]{2,})++",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:.])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){2}[\x20-]?[0-9]{2,4}(?![0-9])",
    "phone": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
CHEAP = {"email": r"@|\[at\]|\(at\)", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]|[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"}
CONTEXT = {"email": r"(?i)mail|contact|write|e-mail|correo|courriel|@\s*$", "ip": r"(?i)\bip\b|address|host|server|adresse", "card": r"(?i)card|visa|master|amex|credit|karte|carte|tarjeta", "phone": r"(?i)phone|\btel|call|fax|mobil|whatsapp|\+\s*$"}
GAZETTEER = {"email": r"(?i)\.(com|org|net|edu|gov|de|fr|es|uk|io)$", "ip": r"^(?!0*(0|10|127)\.)", "card": r"^(4|5[1-5]|2[2-7]|3[47]|6011|65)", "phone": r"^\+?\(?(1|33|34|44|49|[2-9][0-9]{2})"}
LABELERS = ("strict", "gazetteer", "context", "edges")
REACH = 40
STRICT_MOST = 0.7  # the strict pattern misses other spellings by construction, however often it hits


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.array_remove(F.split(F.regexp_replace(value, "[^0-9]", ""), ""), ""))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 1, F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)).otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def base_spans(text: Column) -> Column:
    email = matches(text, EMAIL, "email", text.contains("@"))
    ip = F.filter(matches(text, IP, "ip", text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")), lambda s: s["value"].rlike(rf"^{OCTET}(\.{OCTET}){{3}}$"))
    card = F.filter(matches(text, CARD, "card", text.rlike(CHEAP["card"])), lambda s: _digits(s["value"]).between(14, 19) & _luhn(s["value"]))
    phone = F.filter(matches(text, PHONE, "phone", text.rlike(r"\+[0-9]")), lambda s: _digits(s["value"]).between(10, 15))
    return ordered(F.concat(email, ip, card, phone), KINDS)


def _candidates(text: Column, base: Column) -> Column:
    """Base spans and loose matches that overlap none of them, with the labelers' votes as a bit pattern; no values, which are personal."""
    loose = ordered(F.concat(*[matches(text, LOOSE[k], k, text.rlike(CHEAP[k])) for k in KINDS]), KINDS)

    def voted(strict: bool):
        def vote(s: Column) -> Column:
            around = F.concat(F.right(s["before"], F.lit(1)), F.lit("|"), s["after"])
            by_kind = lambda table, value: F.coalesce(*[F.when(s["kind"] == k, value.rlike(table[k])) for k in KINDS], F.lit(False))
            bits = F.lit(1 if strict else 0) + F.when(by_kind(GAZETTEER, s["value"]), 2).otherwise(0) + F.when(by_kind(CONTEXT, s["before"]), 4).otherwise(0) + F.when(around.rlike(r"^[\s(\[\"'<,;:]?\|[\s)\]\"'>,;:.!?]?$"), 8).otherwise(0)
            size = F.least(F.floor(F.length(s["value"]) / 8), F.lit(4)).cast("int")
            return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), bits.alias("votes"), size.alias("size"))
        return vote

    return F.concat(F.transform(base, voted(True)), F.transform(clear_of(loose, base), voted(False)))


def reliabilities(counts: dict[tuple[str, int], int], rounds: int = 60) -> dict[tuple[str, int], float]:
    """Posterior of the positive class per (kind, vote pattern), by expectation-maximisation over the counts.

    Every kind has its own prior and labeler rates, with weak Beta priors (a
    labeler is right more often than not; the strict pattern nearly always).
    """
    out = {}
    for kind in KINDS:
        rows = {v: n for (k, v), n in counts.items() if k == kind}
        hit = [0.9, 0.7, 0.4, 0.8]
        false = [0.05, 0.3, 0.1, 0.5]
        share = 0.5
        post: dict[int, float] = {}
        for _ in range(rounds if rows else 0):
            for v in rows:
                a = math.log(share) + sum(math.log(hit[j] if v >> j & 1 else 1 - hit[j]) for j in range(4))
                b = math.log(1 - share) + sum(math.log(false[j] if v >> j & 1 else 1 - false[j]) for j in range(4))
                post[v] = 1 / (1 + math.exp(max(-700.0, min(700.0, b - a))))
            yes, no = sum(n * post[v] for v, n in rows.items()), sum(n * (1 - post[v]) for v, n in rows.items())
            share = (yes + 1) / (yes + no + 2)
            for j in range(4):
                weight = (18, 2) if j == 0 else (6, 4)
                hit[j] = (sum(n * post[v] for v, n in rows.items() if v >> j & 1) + weight[0]) / (yes + sum(weight) + 1)
                hit[j] = min(hit[j], STRICT_MOST) if j == 0 else hit[j]
                false[j] = (sum(n * (1 - post[v]) for v, n in rows.items() if v >> j & 1) + weight[1]) / (no + sum(weight) + 1)
        out |= {(kind, v): p for v, p in post.items()}
    return out


def classifier(counts: dict[tuple[str, int, int], int], soft: dict[tuple[str, int], float], steps: int = 400, rate: float = 0.5) -> dict[tuple[str, int, int], float]:
    """Logistic model per kind over votes and length class, on soft labels; its probability per pattern."""
    out = {}
    for kind in KINDS:
        rows = [(v, z, n, soft[(kind, v)]) for (k, v, z), n in sorted(counts.items()) if k == kind]
        total = sum(n for *_, n, _ in rows)
        weights = [0.0] * 10
        features = lambda v, z: [1.0, *[1.0 if v >> j & 1 else 0.0 for j in range(4)], *[1.0 if z == i else 0.0 for i in range(5)]]
        predict = lambda x: 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(weights, x, strict=True))))))
        for _ in range(steps):
            grad = [0.0] * 10
            for v, z, n, y in rows:
                x = features(v, z)
                miss = n / total * (y - predict(x))
                grad = [g + miss * f for g, f in zip(grad, x, strict=True)]
            weights = [w + rate * 4 * (g - 1e-4 * w) for w, g in zip(weights, grad, strict=True)]
        out |= {(kind, v, z): predict(features(v, z)) for v, z, *_ in rows}
    return out


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.5) -> DataFrame:
    """``keep`` columns plus ``base`` and ``spans``, arrays of (kind, start, end); spans also carry the model's additions."""
    body = F.coalesce(F.col(text), F.lit(""))
    place = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    found = let(base_spans(body), lambda base: F.struct(F.transform(base, place).alias("base"), _candidates(body, base).alias("cands")))
    rows = cut(docs.select(*keep, found.alias("_found")).select(*keep, "_found.base", "_found.cands"), "pii")
    counted_rows = rows.where(F.size("cands") > 0).select(F.explode("cands").alias("c")).groupBy("c.kind", "c.votes", "c.size").agg(F.count("*").alias("n")).collect()
    counts = {(r["kind"], r["votes"], r["size"]): r["n"] for r in counted_rows}  # kinds x 16 votes x 5 lengths at most
    by_votes: dict[tuple[str, int], int] = {}
    for (k, v, _), n in counts.items():
        by_votes[(k, v)] = by_votes.get((k, v), 0) + n
    model = classifier(counts, reliabilities(by_votes))
    accepted = [F.lit(f"{k}:{v}:{z}") for (k, v, z), p in sorted(model.items()) if p >= threshold and not v & 1]
    patterns = F.array(*accepted) if accepted else F.expr("CAST(array() AS array<string>)")
    added = F.filter("cands", lambda c: (c["votes"].bitwiseAND(1) == 0) & F.array_contains(patterns, F.concat_ws(":", c["kind"], c["votes"].cast("string"), c["size"].cast("string"))))
    return rows.select(*keep, "base", ordered(F.concat("base", F.transform(added, place)), KINDS).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[PII]") -> DataFrame:
    """All rows and columns with the base spans in ``text`` replaced; null texts stay null."""
    return docs.withColumn(text, let(base_spans(F.coalesce(F.col(text), F.lit(""))), lambda base: replaced(F.col(text), base, mark)))


def digest(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    found = scan(docs, text, (key,))
    return found.select(
        key, *[counted(F.col("base"), k).alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("bigint").alias("n_added"),
    )
