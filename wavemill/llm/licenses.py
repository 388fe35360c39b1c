"""License scan by diagonal voting.

All rolling k-word grams of all texts are hashed where the texts lie; what is no
template gram by its hash goes at once, and the rest is joined with the grams of the
license templates. Each hit votes for the diagonal (position in the text minus position
in the template); votes on neighbouring diagonals, which insertions and
deletions cause, are merged into one span; a span counts if its hits cover
enough of the template's words. A phrase stands word for word at a place if and
only if all its grams vote for one diagonal.

The gram table is as large as the templates, which are a fixed parameter of at
most ``MOST_GRAMS`` grams; that is why it may be broadcast. The join compares the
words of the grams, so a hash collision cannot vote.

Defined cases: a null text is empty; texts without words get no labels and
score 0; repeated rows are each scanned; ties of a template's spans go to the
leftmost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import kept
from .words import ALNUM, LOWER, shingles, texts_of, words_of

MOST_GRAMS = 20_000
#: The words of a text whose A-Z became lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that count wherever they stand word for word, with their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Further templates, found also where some words differ, with their labels.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("all-rights-reserved", "all rights reserved"),
]


def template_grams(base: dict[str, str], templates: list[tuple[str, str]], k: int) -> list[tuple]:
    """(template, label, is base, words in it, position, gram) of all templates."""
    out = []
    for i, (label, phrase, is_base) in enumerate([(label, phrase, True) for phrase, label in base.items()] + [(*t, False) for t in templates]):
        w = phrase.split()
        if len(w) < k:
            raise ValueError(f"a template needs at least {k} words: {phrase}")
        out += [(i, label, is_base, len(w), p, " ".join(w[p : p + k])) for p in range(len(w) - k + 1)]
    if len(out) > MOST_GRAMS:
        raise ValueError(f"more than {MOST_GRAMS} grams in the templates")
    return out


def _hashes(data: bytes, offsets: np.ndarray, k: int) -> tuple:
    """Words of some texts, hashes of their k-word grams, and where each text's grams begin."""
    w = words_of(np.frombuffer(data, np.uint8), offsets, ALNUM, LOWER)
    return w, *shingles(w, k)


def _hits(grams: list[str], k: int):
    """Rows (id, text) to id, number of words, and the places and words of what may be template grams."""
    one = [_hashes(g.encode(), np.array([0, len(g.encode())]), k)[1][0] for g in grams]
    known = np.unique(np.array(one, np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, offsets in texts_of(b.column(1)):
                w, hashes, offs = _hashes(data, offsets, k)
                n_words = np.diff(w.first)
                hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes)
                text = np.searchsorted(offs, hit, "right") - 1
                whole = n_words[text] >= k
                hit, text = hit[whole], text[whole]
                place = hit - offs[text]
                first = w.first[text] + place
                found = [b" ".join(data[a:z].tobytes() for a, z in zip(w.start[i : i + k], w.end[i : i + k], strict=True)).lower() for i in first]
                each = pa.StructArray.from_arrays([pa.array(place, pa.int64()), pa.array(found, pa.binary()).cast(pa.string())], ["place", "gram"])
                begin = np.searchsorted(text, np.arange(len(n_words) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(n_words)), pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(pa.array(begin), each)], names=["doc_id", "n_words", "hits"])

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, k: int = 3, shift: int = 2, cover: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Per text: row (its own number), doc_id, n_words, hits; and its spans: row, template, label, is_base, n_exact, first_exact, last_exact, first_word, score.

    ``shift`` is the largest step between neighbouring diagonals of a span, ``cover`` the smallest part of a template's words that a span must cover.
    """
    spark = docs.sparkSession
    table = template_grams(BASE if base is None else base, TEMPLATES if templates is None else templates, k)
    grams = spark.createDataFrame(table, "template int, label string, is_base boolean, n_template int, at int, gram string")
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_hits([g[-1] for g in table], k), f"doc_id {kind}, n_words long, hits array<struct<place:long,gram:string>>")
    texts = kept(texts.withColumn("row", F.monotonically_increasing_id()))
    hits = texts.select("row", F.explode("hits").alias("hit")).select("row", "hit.*").join(F.broadcast(grams), "gram")
    key = ["row", "template", "label", "is_base", "n_template"]
    diagonals = hits.withColumn("diagonal", F.col("place") - F.col("at")).groupBy(*key, "diagonal").agg(F.collect_set("at").alias("ats"))  # a template's positions, so bounded
    exact = F.size("ats") == F.col("n_template") - (k - 1)
    # neighbours: diagonals of one template that lie within shift of the one before
    line = Window.partitionBy("row", "template").orderBy("diagonal")
    fresh = F.when(F.col("diagonal") - F.lag("diagonal").over(line) <= shift, 0).otherwise(1)
    merged = diagonals.withColumn("exact", exact).withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    spans = merged.groupBy(*key, "span").agg(
        F.sum(F.col("exact").cast("long")).alias("n_exact"),
        F.min(F.when(F.col("exact"), F.col("diagonal"))).alias("first_exact"),
        F.max(F.when(F.col("exact"), F.col("diagonal"))).alias("last_exact"),
        F.min("diagonal").alias("first_word"),
        F.array_distinct(F.flatten(F.transform(F.array_distinct(F.flatten(F.collect_set("ats"))), lambda a: F.sequence(a, a + (k - 1))))).alias("covered"),
    )
    spans = spans.withColumn("score", F.size("covered") / F.col("n_template")).where((F.col("n_exact") > 0) | (~F.col("is_base") & (F.col("score") >= cover)))
    return texts, spans.drop("covered", "span")


def summary(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    texts, spans = scan(docs, **options)
    base = F.when(F.col("is_base"), F.col("label"))
    found = spans.groupBy("row").agg(
        F.sum(F.when(F.col("is_base"), F.col("n_exact"))).alias("n_base"),
        F.min(F.when(F.col("is_base"), F.col("first_exact"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("is_base"), F.col("last_exact"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
    )
    return texts.drop("hits").join(found, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
