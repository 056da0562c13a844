"""License scans by diagonal voting.

Words are those of ALNUM_WORD in text lower-cased over A-Z. Every rolling hash of GRAM words of every text is joined
by Spark to the positions of the template notices. A hit votes for its diagonal, text position minus template position;
distinct template positions are counted per diagonal, diagonals of one template that lie close to each other (words added or
left out) are merged into a span, in which each template position counts once, and spans with votes enough are verified: the
span's words, with a few around it, are aligned with the template's word by word (a longest common subsequence), so that a
template word counts once however often the text repeats it. Phrases that name a license are found word by word beside that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import mixed, texts_of, words_of
from .bitmap import bits_for, column_hashes, counted, held
from .common import table, written

GRAM = 4
SPAN = 1 << 19
#: A span is verified if it has VOTES of its template's hashes, and holds if the text has LEAST_SHARE of the template's words, or
#: SHORT_SHARE where those are under SHORT; diagonals this far apart at most are merged.
VOTES, LEAST_SHARE, SHORT_SHARE, SHORT, NEIGHBOUR = 0.25, 0.6, 0.9, 12, 8
#: Template positions (under 100 bytes each) that may be broadcast.
BROADCAST = 1 << 17
#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices in common use and their labels.
TEMPLATES = {
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at""",
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version""",
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software""",
    "mit-short": "Released under the MIT License.",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.""",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-short": "Licensed under CC BY-NC 4.0.",
}


def gram_hashes(hashes: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Hashes of all windows of n words."""
    m = max(len(hashes) - n + 1, 0)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = mixed(out + hashes[k : m + k] + np.uint64(k + 1))
    return out


def template_rows(templates: dict[str, str]) -> list[tuple[int, str, int, int]]:
    """(hash, label, position, number of hashes) of each template; "-short" is no part of a label."""
    out = []
    for label, text in templates.items():
        hashes = gram_hashes(words_of([text], lower=True, alnum=True).hashes).view(np.int64).tolist()
        out += [(h, label, k, len(hashes)) for k, h in enumerate(hashes)]
    return out


def hits(docs: DataFrame, spark: SparkSession, templates: dict[str, str], phrases: dict[str, str]) -> DataFrame:
    """One row of base figures for each row of docs (pos -1), and a row for each template position a hash of it meets."""
    known = [(words_of([p], lower=True, alnum=True).hashes, label) for p, label in phrases.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_key", "pos", "h", "n_words", "n_base", "first_word", "last_word", "base_labels"]
        for batch in batches:
            ids = batch.column(0)
            for at, texts in texts_of(batch.column(1), SPAN):
                end = at + len(texts)
                words = words_of(texts, lower=True, alnum=True)
                bounds, sizes = words.bounds, np.diff(words.bounds)
                owner = np.repeat(np.arange(end - at), sizes)
                grams = gram_hashes(words.hashes)
                inside = owner[: len(grams)] == owner[GRAM - 1 :] if len(grams) else np.zeros(0, bool)
                own = owner[: len(grams)][inside]
                position = (np.arange(len(grams))[inside] - bounds[own]).astype(np.int32)
                keys = words_keys(texts)
                empty = pa.nulls(len(own))
                for a in range(0, len(own), 1 << 17):
                    b = a + (1 << 17)
                    rows = [ids.take(pa.array(own[a:b] + at)), pa.array(keys[own[a:b]]), pa.array(position[a:b]), pa.array(grams[inside][a:b].view(np.int64))]
                    nothing = [empty[a:b].cast(t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())]
                    yield pa.RecordBatch.from_arrays([*rows, *nothing], names=names)
                found = np.zeros((end - at, 3), np.int64)
                found[:, 1] = np.iinfo(np.int64).max
                found[:, 2] = -1
                labels: list[set[str]] = [set() for _ in range(end - at)]
                for phrase, label in known:
                    m, n = max(len(words.hashes) - len(phrase) + 1, 0), len(phrase)
                    same = np.ones(m, bool)
                    for k in range(n):
                        same &= words.hashes[k : m + k] == phrase[k]
                    starts = np.flatnonzero(same)
                    starts = starts[owner[starts] == owner[starts + n - 1]]
                    place = starts - bounds[owner[starts]]
                    np.add.at(found[:, 0], owner[starts], 1)
                    np.minimum.at(found[:, 1], owner[starts], place)
                    np.maximum.at(found[:, 2], owner[starts], place)
                    for k in np.unique(owner[starts]):
                        labels[k].add(label)
                none = found[:, 0] == 0
                count = end - at
                rows = [ids.slice(at, count), pa.array(keys), pa.array(np.full(count, -1, np.int32)), pa.nulls(count, pa.int64()), pa.array(sizes), pa.array(found[:, 0])]
                edges = [pa.array(found[:, k], mask=none) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([*rows, *edges, pa.array([",".join(sorted(x)) for x in labels])], names=names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, text_key bigint, pos int, h bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string"
    known_rows = template_rows(templates)
    places = spark.createDataFrame(known_rows, "h bigint, template string, at int, size int")
    places = F.broadcast(places) if len(known_rows) <= BROADCAST else places
    grams = docs.select("doc_id", "text").mapInArrow(run, schema)
    return grams.join(places, "h", "left").where("template is not null or pos = -1").drop("h")


def words_keys(texts: list[bytes]) -> np.ndarray:
    """A hash of each text, to tell rows with one id and different texts apart."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64).view(np.int64)


def aligned(text: np.ndarray, template: np.ndarray) -> tuple[int, int, int]:
    """(first, end, n): the longest common subsequence of two arrays of word hashes: where it lies in the text, and its size."""
    rows = np.zeros((len(template) + 1, len(text) + 1), np.int32)
    for k, word in enumerate(template):
        rows[k + 1, 1:] = np.maximum.accumulate(np.maximum(rows[k, 1:], rows[k, :-1] + (text == word)))
    i, j, size = len(template), len(text), int(rows[-1, -1])
    end, first = 0, 0
    while i and j and rows[i, j]:
        if rows[i, j] == rows[i, j - 1]:
            j -= 1
        elif rows[i, j] == rows[i - 1, j]:
            i -= 1
        else:
            i, j = i - 1, j - 1
            first, end = j, end or j + 1
    return first, end, size


def verified(docs: DataFrame, spans: DataFrame, templates: dict[str, str]) -> DataFrame:
    """Rows (doc_id, text_key, template, start, end, votes) that hold, word by word, with their share of the template's words.

    Only texts with a span are read into the join.
    """
    known = {label: words_of([text], lower=True, alnum=True).hashes for label, text in templates.items()}
    listed = spans.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("template", "start", "end", "votes")).alias("spans"))
    listed = written(listed.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "spans"), "license-spans")
    [marked] = counted(listed.select("k"), column_hashes, bits_for(listed, 4), (1,))
    marks = docs.sparkSession.sparkContext.broadcast(marked)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.frombuffer(marks.value, np.uint8)
        for batch in batches:
            for at, texts in texts_of(batch.column(1), SPAN):
                keys = words_keys(texts)
                which = np.flatnonzero(held(there, keys.view(np.uint64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which + at)), pa.array(keys[which]), pa.array([texts[k] for k in which], pa.binary())], names=["doc_id", "text_key", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, out = [], []
            for row in range(batch.num_rows):
                words = words_of([batch.column(2)[row].as_py()], lower=True, alnum=True).hashes
                for span in batch.column(3)[row].as_py():
                    template = known[span["template"]]
                    low, high, best = max(0, span["start"] - NEIGHBOUR), min(len(words), span["end"] + NEIGHBOUR), (0, 0, 0)
                    size = 2 * len(template) + 2 * NEIGHBOUR  # a longer span is a chain of repeats: its best stretch holds
                    for at in range(low, max(low + 1, high - size // 2), size // 2):
                        first, end, n = aligned(words[at : min(high, at + size)], template)
                        best = max(best, (n, -(at + first), at + end))
                    n, first, end = best
                    if n >= (LEAST_SHARE if len(template) >= SHORT else SHORT_SHARE) * len(template):
                        own.append(row)
                        out.append((span["template"], -first, end, span["votes"], n / len(template)))
            columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), batch.column(1).take(pa.array(own, pa.int64())), *columns], names=["doc_id", "text_key", "template", "start", "end", "votes", "share"])

    texts = docs.select("doc_id", "text").mapInArrow(read, f"doc_id {id_type}, text_key bigint, data binary")
    joined = texts.join(listed, texts["doc_id"].eqNullSafe(listed["d"]) & (texts["text_key"] == listed["k"])).select("doc_id", "text_key", "data", "spans")
    return joined.mapInArrow(run, f"doc_id {id_type}, text_key bigint, template string, start int, end int, votes bigint, share double").distinct()


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text) to (documents, spans).

    spans: doc_id, text_key, template, label, start, end (words, end exclusive), votes, share: the verified ones.
    documents, a row for each row: doc_id, text_key, n_words, n_base, first_word, last_word, base_labels, labels, score. score is
    1 where a phrase stands, else the largest share of a verified span, else 0. A null text counts as empty; rows with one id
    and one text get the same result each, and their spans are given once; a null id is an id; an empty table gives no rows.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    found = written(hits(docs, spark, templates, PHRASES if phrases is None else phrases), "license-hits")
    votes = found.where("template is not null").select("doc_id", "text_key", "template", "size", "at", "pos", (F.col("pos") - F.col("at")).alias("diagonal"))
    diagonals = votes.groupBy("doc_id", "text_key", "template", "size", "diagonal").agg(F.collect_set("at").alias("ats"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    by = Window.partitionBy("doc_id", "text_key", "template").orderBy("diagonal", "low")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > NEIGHBOUR), F.lit(True))
    merged = (
        diagonals.withColumn("apart", apart.cast("int"))
        .withColumn("span", F.sum("apart").over(by))
        .select("doc_id", "text_key", "template", "size", "span", "low", "high", F.explode("ats").alias("at"))
        .groupBy("doc_id", "text_key", "template", "size", "span")
        .agg(F.countDistinct("at").alias("votes"), F.min("low").alias("start"), (F.max("high") + GRAM).alias("end"))
    )
    chosen = merged.where(F.col("votes") >= VOTES * F.col("size")).select("doc_id", "text_key", "template", "start", "end", "votes")
    spans = written(verified(docs, chosen, templates), "license-verified").withColumn("label", F.regexp_replace("template", "-short$", ""))
    by_doc = spans.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).agg(F.collect_set("label").alias("more"), F.max("share").alias("best"))
    base = found.where("pos = -1").drop("pos", "template", "at", "size")
    own = F.when(F.col("base_labels") == "", F.array().cast("array<string>")).otherwise(F.split("base_labels", ","))
    documents = base.join(by_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left").select(
        "doc_id",
        "text_key",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        "base_labels",
        F.array_join(F.array_sort(F.array_union(own, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
    return documents, spans


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    """scan() of every whole text of documents."""
    return scan(table(spark, sf_dir, "documents"))[0].drop("text_key")
