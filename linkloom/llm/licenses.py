"""License scan by diagonal voting.

Every rolling word bigram of every text is hashed, exploded and joined in Spark to the
positions of the same bigrams in license templates (a fixed table of a few hundred rows,
broadcast). Hits are aggregated by text, template segment and offset diagonal; diagonals
a few words apart are merged, which bridges inserted and dropped words; a span is then
verified by the share of the segment's bigrams that it holds and by its length. A short
phrase must be whole on one diagonal.

Defined results: a null or empty text has no words and no labels; equal (id, text) rows
get equal results each; ids may repeat or be null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from linkloom.llm import kernels as K
from linkloom.llm.common import mapped, table

#: Words in a gram, words in a template segment, gap between diagonals that are merged,
#: and the least share of a segment's grams in a verified span.
GRAM, SEGMENT, NEAR, COVER = 2, 50, 3, 0.6

# The phrases and labels of the scan's contract.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices as published with the licenses, and short marks.
NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
}
MARKS = {
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "creative commons attribution": "cc-by",
    "all rights reserved": "all-rights-reserved",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
}
# Common words; a notice's bigram of two of them casts no vote.
COMMON = frozenset("a an and any are as at be by following for from if in is it may must not of on one or that the this to under was with you".split())


def words_of(text: str) -> list[str]:
    data, offsets = K.column_bytes(pa.array([text]))
    data = K.LOWER[data]
    start, end, _ = K.find_words(data, offsets)
    return [data[s:e].tobytes().decode() for s, e in zip(start, end, strict=True)]


def word_hashes(words: list[str]) -> np.ndarray:
    data, offsets = K.column_bytes(pa.array(words, pa.string()))
    return K.span_hashes(data, offsets[:-1], offsets[1:]) if words else np.empty(0, np.uint64)


def template_rows(base: dict[str, str] = BASE, marks: dict[str, str] = MARKS, notices: dict[str, str] = NOTICES) -> list[tuple[int, int, int, int, str, bool, bool, int]]:
    """(gram, segment, place, grams in it, label, is base, must be whole, words) for every voting template gram."""
    rows, segment = [], 0
    short = [(p, label, True) for p, label in base.items()] + [(p, label, False) for p, label in marks.items()]
    parts = [(words_of(p), label, is_base, True) for p, label, is_base in short]
    for label, text in notices.items():
        words = words_of(text)
        parts += [(words[i : i + SEGMENT], label, False, False) for i in range(0, len(words) - SEGMENT // 2, SEGMENT)] if len(words) > SEGMENT // 2 else [(words, label, False, False)]
    for words, label, is_base, whole in parts:
        grams = K.rolling(word_hashes(words), GRAM).view(np.int64).tolist()
        votes = [(g, i) for i, g in enumerate(grams) if whole or not {words[i], words[i + 1]} <= COMMON]
        rows += [(g, segment, i, len(votes), label, is_base, whole, len(words)) for g, i in votes]
        segment += 1
    return rows


def _gram_mapper(with_grams: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in K.chunks(batch.column(1)):
                low = K.LOWER[data]
                start, end, text = K.find_words(low, offsets)
                counts = np.bincount(text, minlength=hi - lo)
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(K.text_hash(low, offsets).view(np.int64)), pa.array(counts, pa.int64())]
                if with_grams:
                    grams = K.rolling(K.span_hashes(low, start, end), GRAM)
                    inside = text[: len(grams)] == text[GRAM - 1 :] if len(grams) else np.empty(0, bool)
                    columns.append(K.list_array(grams[inside].view(np.int64), np.maximum(counts - GRAM + 1, 0), pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "n_words", "grams"][: len(columns)])

    return run


def license_scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", templates: list[tuple] | None = None) -> DataFrame:
    """One row per document: words, base places, labels and the best verified coverage."""
    spark = docs.sparkSession
    kind = docs.schema[id_column].dataType.simpleString()
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    head = f"doc_id {kind}, text_key long, n_words long"
    rows = mapped(texts, _gram_mapper(False), head)
    grams = mapped(texts, _gram_mapper(True), head + ", grams array<long>")
    index = spark.createDataFrame(template_rows() if templates is None else templates, "gram long, segment int, place int, votes int, label string, is_base boolean, whole boolean, words int")
    keys = ["doc_id", "text_key", "segment"]
    hits = grams.select("doc_id", "text_key", F.posexplode("grams").alias("pos", "gram")).join(F.broadcast(index), "gram")
    facts = [F.first(c).alias(c) for c in ("votes", "label", "is_base", "whole", "words")]
    diagonal = (
        hits.groupBy(*keys, (F.col("pos") - F.col("place")).alias("diagonal"))
        .agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("mask"), F.min("pos").alias("begin"), F.max("pos").alias("end"), *facts)
        .where(~F.col("whole") | (F.bit_count("mask") == F.col("votes")))
    )
    by = W.partitionBy(*keys).orderBy("diagonal")
    gap = F.when(F.col("whole") | (F.col("diagonal") - F.lag("diagonal").over(by) > NEAR), 1).otherwise(0)
    merged = (
        diagonal.withColumn("_new", gap)
        .withColumn("_group", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*keys, "_group")
        .agg(F.expr("bit_or(mask)").alias("mask"), F.min("begin").alias("begin"), F.max("end").alias("end"), F.min("diagonal").alias("diagonal"), *facts)
        .withColumn("coverage", F.bit_count("mask") / F.col("votes"))
    )
    spans = merged.where(F.col("whole") | ((F.col("coverage") >= COVER) & (F.col("end") - F.col("begin") <= 1.5 * F.col("words"))))
    base = F.col("is_base")
    found = spans.groupBy("doc_id", "text_key").agg(
        F.sum(base.cast("long")).alias("n_base"),
        F.min(F.when(base, F.col("diagonal").cast("long"))).alias("first_word"),
        F.max(F.when(base, F.col("diagonal").cast("long"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("coverage").alias("score"),
    )
    same = rows["doc_id"].eqNullSafe(found["doc_id"]) & (rows["text_key"] == found["text_key"])
    return rows.join(found, same, "left").select(
        rows["doc_id"],
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
