"""Groups, links and counts against a plain version."""

import hashlib
from collections import Counter, defaultdict

import pandas as pd
import pyarrow.parquet as pq
import pytest

from pkgloom.llm import alignment, queries
from pkgloom.llm.queries import tokenizer_path

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
HARD = [None, "", " ", "a", "Hello world", "  two  spaces ", "<|endoftext|> <s></s> <0x41>", "tab\tnew\nline\r\n", "É é ́x ﬁ Σ", "😀😀 日本語 ▁ low", "a▁b", "\x00\x01", "x" * 3000, "don't I'll we've 12345 !!! ???", "ＡＢＣ ａ", " nbsp　wide", "same same same " * 4000]


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(A))
    t.encode_special_tokens = True
    t.no_padding(), t.no_truncation()
    return t, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(B))


def brute(docs, tokenizers):
    a, b = tokenizers
    letters, n = {}, 0
    for x in range(256):
        if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255:
            letters[chr(x)] = x
        else:
            letters[chr(256 + n)] = x
            n += 1
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    per, counts = [], Counter()
    for i, text in docs:
        row = {"n_a": 0, "n_b": 0, "groups": [], "links": [], "sha": ""}
        per.append((i, row))
        if not text:
            continue
        one, two = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a, bytes_b = [bytes(letters[c] for c in a.id_to_token(t)) for t in one], [piece(t) for t in two]
        if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            continue
        ends_a, ends_b, at = {}, {}, 0
        for t, x in zip(one, bytes_a, strict=True):
            at += len(x)
            ends_a[at] = t
        at = 0
        for t, x in zip(two, bytes_b, strict=True):
            at += len(x)
            ends_b[at] = t
        common = sorted(set(ends_a) & set(ends_b))
        groups = walk(list(ends_a.items()), list(ends_b.items()), common)
        row |= {"n_a": len(one), "n_b": len(two), "groups": groups, "links": [(ends_a[c], ends_b[c]) for c in common], "sha": hashlib.sha256(";".join(groups).encode()).hexdigest()}
        counts.update(row["links"])
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(i, r["n_a"], r["n_b"], len(r["groups"]), len(r["links"]), sum(counts[x] == best[x[1]] for x in r["links"]), sum(counts[x] for x in r["links"]), r["sha"]) for i, r in per]


def walk(one, two, common):
    out, i, j = [], 0, 0
    for c in common:
        p, q = [], []
        while i < len(one) and one[i][0] <= c:
            p.append(str(one[i][1]))
            i += 1
        while j < len(two) and two[j][0] <= c:
            q.append(str(two[j][1]))
            j += 1
        out.append(",".join(p) + "|" + ",".join(q))
    return out


def rows(found):
    return sorted(map(tuple, found), key=str)


def test_query_equals_plain_version(spark, data, tokenizers):
    docs = pd.read_parquet(f"{data}/documents.parquet")
    got = queries.QUERIES["op12_alignment"](spark, data)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows(got.collect()) == rows(brute(list(zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True)), tokenizers))


def test_hard_texts_repeats_and_clashing_columns(spark, tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE", 200)
    docs = [(i, t) for i, t in enumerate(HARD)] + [(3, "a"), (3, "a"), (None, "no id")]
    df = spark.createDataFrame(docs, "doc_id int, text string").selectExpr("*", "1 AS part", "2 AS pair", "3 AS key", "4 AS n").repartition(3)
    got = rows(alignment.align(df, tokenizer_path(A), tokenizer_path(B)).collect())
    assert got == rows(brute(docs, tokenizers))
    assert sum(r[1] > 0 for r in got) >= 12 and sum(r[1] == 0 for r in got) >= 2
    assert alignment.align(df.limit(0), tokenizer_path(A), tokenizer_path(B)).count() == 0


def test_ranked_encoder_is_the_library(tokenizers):
    pair = alignment.pair_of(tokenizer_path(A), tokenizer_path(B))
    assert pair.quick
    for low in range(0, 0x30000, 7):  # letters, digits, marks and spaces of every block, in every neighbourhood
        if not 0xD800 <= low < 0xE000:
            c = chr(low)
            text = f" a{c}a1{c}1 {c} .{c}.{c}{c}  a\n{c}'{c}s"
            assert pair.encode_a([text])[0] == tokenizers[0].encode(text, add_special_tokens=False).ids


def test_slices_are_written_in_small_groups(spark, tokenizers, monkeypatch):
    """A reader takes a row group as one batch: with hundreds of slices in a group, a task held them all."""
    written, real = {}, alignment.cut
    monkeypatch.setattr(alignment, "SLICE", 100)
    monkeypatch.setattr(alignment, "cut", lambda df, name, **options: written.setdefault(name, real(df, name, **options)))
    docs = [(i, f"text {i} of some words " * 4) for i in range(300)]
    got = alignment.align(spark.createDataFrame(docs, "doc_id int, text string").coalesce(1), tokenizer_path(A), tokenizer_path(B))
    assert rows(got.collect()) == rows(brute(docs, tokenizers))
    sizes = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in written["alignment"].inputFiles()]
    groups = [m.row_group(i).num_rows for m in sizes for i in range(m.num_row_groups)]
    assert sum(groups) >= 300 and max(groups) <= alignment.GROUP
