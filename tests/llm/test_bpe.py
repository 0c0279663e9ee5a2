"""Chunk reuse against the tokenizers library on whole texts."""

import hashlib
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pkgloom.llm import bpe
from pkgloom.llm.common import text_bytes
from pkgloom.llm.queries import tokenizer_path

HARD = [None, "", " ", "a", "\n\n", "don't I'll we've <|endoftext|>x <|startoftext|>", "É é ́x ﬁ Σίσυφος ΟΔΟΣ", "a b c\x85d\x1ce", "😀😀 " * 900, "x" * 9000, "abc def " * 3000, "1234567890" * 40, "!!! ??? ...", "日本語のテキスト" * 700, "ab̈" * 3000, "ÀÉÎÕÜ ß ÿ ÷× ª²½ \x1c\x00 'S 'LL it's", "Σ ΑΣ İI", "x" * 300 + "<|endoftext|>" + "y" * 300]


def expected(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.no_padding(), t.no_truncation()
    return t


def test_equals_the_library(spark, data, tokenizer):
    texts = pd.read_parquet(f"{data}/documents.parquet").text.tolist() + HARD
    texts += [t + " tail" for t in texts if t][:40] + [("shared passage " * 60) + str(i) for i in range(30)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    got = {r.doc_id: r for r in bpe.encode(rows, tokenizer_path()).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == expected(tokenizer, t), (i, t)
        assert got[i].ids == tokenizer.encode(t or "", add_special_tokens=False).ids
    assert bpe.shared_chunks(rows, tokenizer_path())


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id int, text string"), tokenizer_path()).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abcXYZ ,.'!\n\té́日9 ")), max_size=1500), max_size=4))
def test_chunks_cover_texts_and_joins_are_exact(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    buf, offs = text_bytes(pa.array(texts, pa.string()))
    ends = bpe.chunk_ends(buf, offs)
    assert set(offs[1:][np.diff(offs) > 0]) <= set(ends)
    encoder, begin = bpe.Encoder(tokenizer_path(), bpe.special_tokens(tokenizer_path())), 0
    for text, a, b in zip(texts, offs[:-1], offs[1:], strict=True):
        inner = [int(x) for x in ends if a < x <= b]
        chunks = [buf[x:y].tobytes() for x, y in zip([a, *inner[:-1]], inner, strict=True)] if inner else []
        assert b"".join(chunks) == text.encode() and all(c.decode() for c in chunks)
        ids, _ = encoder.documents([chunks], {})[0]
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
        begin = b
