"""License scans by diagonal voting (operator 11).

A template is a license phrase or notice as a row of words. All rolling k-grams of all texts
are joined, by hash, to the places where templates hold them. A hit at word d of a text and
word t of a template votes for the diagonal d - t, the word at which a whole copy would begin.

* *Votes.* Hits are gathered per (text, template, diagonal) as the set of template places seen,
  which is bounded by the template and does not change where copies of a text vote twice.
* *Phrases* count where a diagonal has every vote of the phrase: one place of a text each.
* *Notices* may have words put in or left out, which moves the rest to a neighbouring diagonal.
  Diagonals of a notice at most ``SHIFT`` apart are merged to one span; its coverage is the
  share of the notice's words that voted k-grams cover.
* *Verification.* Spans of enough coverage go back to their texts, where each voted k-gram is
  compared word by word; coverage is then taken from what is equal.

Only hashes of k-grams and places move through the join: the templates' side is a fixed list
(``TEMPLATES``, or one given by the caller) and is broadcast up to ``MAX_GRAMS`` k-grams, joined
beyond that. Texts move once for those that have a span, one copy of each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convolytics.llm import words as W
from convolytics.llm.common import keep, sized, text_column

#: Words of a k-gram.
K = 3
#: Diagonals of a notice that are at most so many words apart are one span.
SHIFT = 3
#: A notice is found if so much of it is there; a span of less than ``LEAST_SCORE`` is noise.
ACCEPTED = 0.7
LEAST_SCORE = 0.5
#: Templates with up to so many k-grams are broadcast (40 bytes each).
MAX_GRAMS = 200_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """Words that stand for ``label``: exactly (``phrase``) or mostly (a notice)."""

    label: str
    text: str
    phrase: bool = False


#: Phrases of the base labels, and notices of common licenses.
TEMPLATES = (
    Template("mit", "under the mit license", phrase=True),
    Template("apache-2", "apache license version 2", phrase=True),
    Template("cc-by-nc", "cc by nc", phrase=True),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the Software), to deal in the Software "
        "without restriction",
    ),
    Template("mit", "Released under the terms of the MIT license"),
    Template(
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at",
    ),
    Template("apache-2", "Licensed under the Apache License, Version 2.0"),
    Template(
        "gpl-3",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version",
    ),
    Template("gpl-3", "licensed under the GNU General Public License, version 3"),
    Template("gpl-2", "licensed under the GNU General Public License, version 2"),
    Template("lgpl-3", "licensed under the GNU Lesser General Public License, version 3"),
    Template("agpl-3", "licensed under the GNU Affero General Public License, version 3"),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
    ),
    Template(
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted",
    ),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    Template(
        "cc-by-sa",
        "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    Template(
        "cc-by-nc",
        "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
)
#: Bytes that are no part of a word: all of ASCII but digits and (lower-cased) letters.
BREAK = np.zeros(256, bool)
BREAK[:128] = True
BREAK[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = False


def word_spans(data: np.ndarray, offsets: np.ndarray):
    """Start, end and row of every word of lower-cased bytes."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~BREAK[data]
    edge = inside[1:] & ~inside[:-1]
    close = inside[:-1] & ~inside[1:]
    # A row border inside a run of word bytes ends one word and begins another.
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    both = np.unique(cuts[inside[cuts] & inside[cuts + 1]])
    edge[both] = True
    close[both] = True
    starts, ends = np.flatnonzero(edge), np.flatnonzero(close)
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def gram_hashes(data: np.ndarray, offsets: np.ndarray, k: int):
    """(words per row, k-grams per row, hashes of all rolling k-grams in order)."""
    data = W.LOWER[data]
    starts, ends, rows = word_spans(data, offsets)
    counts = np.bincount(rows, minlength=len(offsets) - 1).astype(np.int64)
    if not len(starts):
        return counts, np.zeros_like(counts), np.zeros(0, np.uint64)
    full = W.window_hashes(W.span_hashes(W.BYTE[data], starts, ends), k)
    same = rows[: len(full)] == rows[len(rows) - len(full) :]
    return counts, np.maximum(counts - k + 1, 0), full[same]


def scan_rows(k: int, grams: bool):
    """Map (doc_id, text) to (doc_id, key, n_words), with ``grams`` to (key, grams)."""

    def run(batches):
        for batch in batches:
            data, offsets = W.utf8(batch.column(1))
            for low, high in W.slices(offsets):
                part = data[offsets[low] : offsets[high]]
                at = offsets[low : high + 1] - offsets[low]
                raw = memoryview(part)
                keys = pa.array(
                    [hashlib.sha256(raw[a:b]).digest() for a, b in zip(at[:-1], at[1:], strict=True)],
                    pa.binary(),
                )
                counts, sizes, hashes = gram_hashes(part, at, k)
                if grams:
                    flat = np.append(0, np.cumsum(sizes)).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(flat), pa.array(hashes.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([keys, lists], ["key", "grams"])
                else:
                    ids = batch.column(0).slice(low, high - low)
                    yield pa.RecordBatch.from_arrays(
                        [ids, keys, pa.array(counts)], ["doc_id", "key", "n_words"]
                    )

    return run


def template_words(template: Template) -> list[str]:
    return re.findall(WORD, template.text.translate(str.maketrans(UPPER, UPPER.lower())))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def template_rows(spark: SparkSession, templates: Sequence[Template], k: int):
    """The templates (template, label, phrase, words) and their k-grams (h, template, at)."""
    table, grams = [], []
    for number, template in enumerate(templates):
        words = template_words(template)
        if len(words) < k:
            raise ValueError(f"a template has at least {k} words: {template.text!r}")
        table.append((number, template.label, template.phrase, words))
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        _, _, hashes = gram_hashes(data, np.array([0, len(data)]), k)
        grams += [(int(h), number, at) for at, h in enumerate(hashes.view(np.int64))]
    return (
        F.broadcast(
            spark.createDataFrame(
                table, "template int, label string, phrase boolean, words array<string>"
            )
        ),
        spark.createDataFrame(grams, "h long, template int, at int"),
        len(grams),
    )


def _covered(places, k: int):
    """How many words the k-grams at ``places`` (array of template places) cover."""
    one = F.flatten(F.transform(places, lambda t: F.sequence(t, t + (k - 1))))
    return F.size(F.array_distinct(one))


def spans(texts: DataFrame, templates: Sequence[Template] = TEMPLATES, k: int = K) -> DataFrame:
    """(key, label, phrase, first, last, coverage): verified spans of each distinct text.

    ``key`` is the SHA-256 of the text, ``first`` and ``last`` the words where the span begins
    and ends. Phrases are there as often as they stand in the text, whole; notices with a
    coverage of at least ``LEAST_SCORE``.
    """
    known, grams, n_grams = template_rows(texts.sparkSession, templates, k)
    grams = F.broadcast(grams) if n_grams <= MAX_GRAMS else grams
    hits = (
        texts.mapInArrow(scan_rows(k, grams=True), "key binary, grams array<long>")
        .select("key", F.posexplode("grams").alias("place", "h"))
        .join(grams, "h")
    )
    votes = hits.groupBy("key", "template", (F.col("place") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("votes")
    )
    full = F.size("votes") == F.size("words") - (k - 1)
    votes = keep(
        votes.join(known, "template").where(~F.col("phrase") | full).drop("label", "words"),
        "license-votes",
    )
    order = Window.partitionBy("key", "template").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(order) > F.when(
        F.col("phrase"), 0
    ).otherwise(SHIFT)
    runs = votes.withColumn("run", F.sum(F.coalesce(far, F.lit(True)).cast("int")).over(order))
    # A run holds few diagonals: distinct places of one template, SHIFT apart at most.
    merged = (
        runs.groupBy("key", "template", "run")
        .agg(F.collect_list(F.struct("diagonal", "votes")).alias("diagonals"))
        .drop("run")
        .join(known, "template")
    )
    seen = _covered(F.flatten(F.col("diagonals.votes")), k) / F.size("words")
    merged = keep(merged.where(seen >= LEAST_SCORE), "license-spans")

    keys = keep(merged.select("key").distinct(), "license-keys")
    keyed = texts.select(F.unhex(F.sha2("text", 256)).alias("key"), "text")
    found = keyed.join(sized(keys), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    in_text = F.regexp_extract_all(F.translate("text", UPPER, UPPER.lower()), F.lit(WORD), F.lit(0))
    both = merged.withColumnRenamed("words", "wanted").join(
        found.select("key", in_text.alias("words")), "key"
    )

    def equal(d):
        return F.filter(
            d["votes"],
            lambda t: F.slice("words", d["diagonal"] + t + 1, F.lit(k))
            == F.slice("wanted", t + 1, F.lit(k)),
        )

    checked = both.select(
        "key",
        "label",
        "phrase",
        F.size("wanted").alias("size"),
        F.filter(
            F.transform(
                "diagonals", lambda d: F.struct(d["diagonal"].alias("diagonal"), equal(d).alias("votes"))
            ),
            lambda d: F.size(d["votes"]) > 0,
        ).alias("d"),
    ).withColumn("coverage", _covered(F.flatten(F.col("d.votes")), k) / F.col("size"))
    ends = F.transform("d", lambda d: d["diagonal"] + F.array_max(d["votes"]) + (k - 1))
    begins = F.transform("d", lambda d: d["diagonal"] + F.array_min(d["votes"]))
    enough = F.when(F.col("phrase"), F.col("coverage") == 1).otherwise(F.col("coverage") >= LEAST_SCORE)
    return checked.where(enough).select(
        "key",
        "label",
        "phrase",
        F.array_min(begins).alias("first"),
        F.array_max(ends).alias("last"),
        "coverage",
    )


def labels(
    documents: DataFrame, templates: Sequence[Template] = TEMPLATES, k: int = K
) -> DataFrame:
    """Licenses named in each row of ``documents`` (doc_id, text).

    Returns doc_id, n_words, n_base (places of phrases), first_word and last_word (least and
    largest place where a phrase begins, null without one), base_labels (of phrases) and labels
    (of phrases, and of notices with a coverage of at least ``ACCEPTED``), both distinct, sorted
    and comma-joined ('' for none), and score: the largest coverage of a span, 0 without one.

    Null and empty texts have no words and no spans. Each row has its own result, repeated rows
    and rows without doc_id too; columns other than doc_id and text are not read. An empty table
    gives an empty result.
    """
    texts = documents.select(
        documents["doc_id"].cast("long").alias("doc_id"),
        text_column(documents, "text").alias("text"),
    )
    counted = texts.mapInArrow(scan_rows(k, grams=False), "doc_id long, key binary, n_words long")
    base = F.col("phrase")
    fine = base | (F.col("coverage") >= ACCEPTED)
    summary = (
        spans(texts, templates, k)
        .groupBy("key")
        .agg(
            F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("first"))).alias("first_word"),
            F.max(F.when(base, F.col("first"))).alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set(F.when(fine, F.col("label")))), ",").alias("labels"),
            F.max("coverage").alias("score"),
        )
    )
    summary = keep(summary, "license-texts")
    return counted.join(summary, "key", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).cast("double").alias("score"),
    )
