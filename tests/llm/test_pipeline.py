"""The stages one after another on a small fixture, each against a plain version."""

import re
import shutil
from pathlib import Path

import corpus_pipeline
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pkgloom.llm.queries import tokenizer_path
from .tests_helpers import brute_groups


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The smallest tables with copies, a leak, secrets and null rows added."""
    out = tmp_path_factory.mktemp("sf")
    for f in Path("/root/testdata/sf0.001").glob("*.parquet"):
        shutil.copyfile(f, out / f.name)
    docs, bench = pd.read_parquet(out / "documents.parquet"), pd.read_parquet(out / "benchmark.parquet")
    clean = docs.text[5]
    more = [clean, clean + " tail", "Some words first. " + bench.text[3] + " And after.", 'x token = "abcdef1234567890" y', None, ""]
    extra = pd.DataFrame({"doc_id": range(10_000, 10_000 + len(more)), "text": more, "lang": None, "source": "s", "n_chars": [len(m or "") for m in more]})
    pd.concat([docs, extra]).to_parquet(out / "documents.parquet")
    return str(out)


def test_stages(spark, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet").withColumns({"score": F.lit("mine"), "kept": F.lit(1), "spans": F.lit(None).cast("string")}), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        docs = corpus_pipeline.cut(stage(spark, docs, folder), name)
        seen[name] = (before, docs.toPandas())
        if name != "bpe":
            assert docs.columns == columns
    before, after = seen["near_dedup"]
    groups = brute_groups(list(zip(before.doc_id, before.text, strict=True)), 5, 80)
    assert set(after.doc_id) == {i for i, c in groups.items() if i == c}
    assert not {10_000, 10_001} <= set(after.doc_id)
    before, after = seen["decontamination"]
    assert 10_002 in set(before.doc_id) and 10_002 not in set(after.doc_id)
    items = pd.read_parquet(f"{folder}/benchmark.parquet").text
    flat = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    assert {d for d, t in zip(before.doc_id, before.text, strict=True) if any(flat(i) in flat(t) for i in items)} <= set(before.doc_id) - set(after.doc_id)
    before, after = seen["secrets"]
    assert len(before) == len(after) and after.set_index("doc_id").text[10_003] == 'x [SECRET]" y'
    before, after = seen["bpe"]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    ids = after.set_index("doc_id").ids
    for d, text in zip(before.doc_id, before.text, strict=True):
        assert list(ids[d]) == t.encode(text or "", add_special_tokens=False).ids


def test_run_equals_the_chain(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "n_tokens", "ids_sha256"} <= set(got.columns)
    assert got.select(F.countDistinct("doc_id")).first()[0] == got.count() > 0
