"""License scans by diagonal voting.

A text's words are hashed in rolling groups of ``k``, which Spark joins with
the hashes of all template positions. Hits of one (text, template) with the same offset
between text and template lie on a diagonal; a diagonal's votes are its hits.
Diagonals within ``slack`` words of each other are merged (an inserted or
dropped word shifts the rest), and a merged group is verified as a span: the
template positions it covers must be at least ``coverage`` of the template. Its
span is reported with the template's label. Phrases of the base list are found
at every place where their words stand consecutively.

DataFrame functions only; the templates are a fixed list, so broadcasting their
hashes is bounded. Edge cases: null and empty texts have no words; a text
shorter than ``k`` words can only have base places; ties cannot occur, every
span and label is kept once; rows are told apart by key and text, so repeated
rows get equal results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Public license notices, one label each.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("mit", "Released under the MIT License."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("bsd-3", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, SEPARATORS), "")


def _grams(w: Column, k: int) -> Column:
    """arrays_zip of the k shifted word lists: one struct for each position; the last k-1 hold nulls."""
    return F.arrays_zip(*[(F.slice(w, F.lit(i + 1), F.greatest(F.size(w), F.lit(1))) if i else w).alias(f"w{i}") for i in range(k)])


def _hash(g: str, k: int) -> Column:
    return F.xxhash64(*[F.col(f"{g}.w{i}") for i in range(k)])


def templates(spark, k: int) -> DataFrame:
    rows = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(TEMPLATES)], "template int, label string, notice string").withColumn("w", words(F.col("notice")))
    grams = rows.select("template", "label", F.size("w").alias("size"), F.posexplode(_grams(F.col("w"), k)).alias("at", "g")).where(F.col(f"g.w{k - 1}").isNotNull())
    return grams.select(_hash("g", k).alias("hash"), "template", "label", "size", "at")


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = 3, slack: int = 3, coverage: float = 0.7) -> DataFrame:
    """Per row: ``key``, word count, base places, base labels and the labels and spans of diagonal voting."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("row"), words(F.col(text)).alias("w"))
    phrases = [(p.split(" "), label) for p, label in PHRASES.items()]
    starts = [_phrase_starts(F.col("w"), p) for p, _ in phrases]
    places = F.concat(*starts)
    labelled = F.array_compact(F.array(*[F.when(F.size(s) > 0, F.lit(label)) for s, (_, label) in zip(starts, phrases, strict=True)]))
    found = rows.withColumns({"places": places, "base": labelled})
    hits = (
        rows.select("_key", "row", F.posexplode(_grams(F.col("w"), k)).alias("pos", "g"))
        .select("_key", "row", "pos", _hash("g", k).alias("hash"))
        .join(F.broadcast(templates(spark, k)), "hash")
    )
    votes = hits.groupBy("_key", "row", "template", "label", "size", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.min("pos").alias("first"), (F.max("pos") + k).alias("last"), F.collect_set("at").alias("seen"))
    order = Window.partitionBy("_key", "row", "template").orderBy("diagonal")
    chained = votes.withColumn("new", (F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order), F.lit(slack + 1)) > slack).cast("int")).withColumn("group", F.sum("new").over(order))
    spans = (
        chained.groupBy("_key", "row", "template", "label", "size", "group")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen"))
        .withColumn("covered", F.size(F.array_distinct(F.flatten(F.transform("seen", lambda a: F.sequence(a, a + k - 1))))))
        .where((F.col("covered") >= F.lit(coverage) * F.col("size")))
    )
    marks = spans.groupBy("_key", "row").agg(F.collect_set("label").alias("extra"), F.max(F.col("covered") / F.col("size")).alias("share"), F.sort_array(F.collect_set(F.struct("first", "last", "label"))).alias("spans"))
    base = found.select("_key", "row", F.size("w").cast("bigint").alias("n_words"), "places", "base")
    marks = marks.withColumnsRenamed({"_key": "_other", "row": "_same"})
    joined = base.join(marks, F.col("_key").eqNullSafe(F.col("_other")) & F.col("row").eqNullSafe(F.col("_same")), "left")
    return joined.drop("_other", "_same", "row").withColumnRenamed("_key", key)


def _phrase_starts(w: Column, phrase: list[str]) -> Column:
    """All places (from 0) where the words of ``phrase`` stand consecutively."""
    rare = phrase[-1] if len(phrase[-1]) > 1 else phrase[0]
    at = phrase.index(rare)
    lead = F.transform(w, lambda x, i: F.when(x == rare, i - at))
    candidates = F.when(F.array_contains(w, rare), F.array_compact(lead)).otherwise(F.expr("CAST(array() AS array<int>)"))
    same = lambda s: reduce(lambda a, b: a & b, [F.coalesce(F.get(w, s + i) == x, F.lit(False)) for i, x in enumerate(phrase)])
    return F.filter(candidates, lambda s: (s >= 0) & same(s))


def digest(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    found = scan(docs, text, key)
    extra = F.coalesce("extra", F.expr("CAST(array() AS array<string>)"))
    return found.select(
        key, "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places").cast("bigint").alias("first_word"), F.array_max("places").cast("bigint").alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_distinct(F.concat("base", extra))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
        F.transform(F.coalesce("spans", F.expr("CAST(array() AS array<struct<first:int,last:int,label:string>>)")), lambda s: F.concat_ws(":", s["label"], s["first"].cast("string"), s["last"].cast("string"))).alias("spans"),
    )
