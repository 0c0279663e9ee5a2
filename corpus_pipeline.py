"""Corpus preparation: toxicity, near-dedup, decontamination, secrets, BPE; each stage reads what the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgloom.llm import bpe, decontamination, near_dedup, secrets, toxicity
from pkgloom.llm.common import cut, fold, table
from pkgloom.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half. The model learns from the labelled rows outside fold 0."""
    key = F.col("doc_id")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold(key) != 0, fold(key) == 1)
    return toxicity.remove(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return near_dedup.remove(docs).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark passage."""
    return decontamination.remove(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets replaced by a mark and ``n_chars`` counted anew."""
    return secrets.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars"))).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of ids and decoded text."""
    return bpe.encode(docs, tokenizer_path(), keep=("doc_id", "lang", "source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", mask_secrets),
    ("bpe", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # a learned model, exact set similarity and a tokenizer are not SQL; tests/llm compares with brute force
