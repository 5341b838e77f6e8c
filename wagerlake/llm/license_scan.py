"""License notices by diagonal voting over rolling hashes of word k-grams.

Every k-gram hash of every text is a row that Spark joins with the places of the same hash in the templates. Hits of a text and a template on one diagonal (word of the
text less word of the template) are counted; diagonals close to each other, as insertions and deletions make them, are one candidate.
Candidates with enough votes are verified against the words of the text itself. Base phrases are templates of two and three words, found by their 2-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FOLD, Words, runs_hash, same_rows, staged

#: Words of a k-gram, for templates and for base phrases.
K, BASE_K = 4, 2
#: Diagonals at most this far from the next one are one candidate.
SHIFT = 8
#: Percent of a template's k-grams that must vote, and of its words that must be verified.
VOTES, VERIFIED = 40, 75
#: Bytes of text that a task hashes at once; longer texts are cut between words.
RUN = 2 << 20
# Phrases and labels of the contract, then wording of published licenses and of common notices.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
TEMPLATES = [
    ("Released under the MIT License.", "mit"),
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "mit",
    ),
    ("Licensed under the Apache License, Version 2.0.", "apache"),
    (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "apache",
    ),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
        "gpl",
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "bsd",
    ),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("Licensed under CC BY 4.0.", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("Licensed under CC BY-SA 4.0.", "cc-by-sa"),
]
GRAMS = "doc_id long, text_key long, k int, start long, hashes array<long>"
FOUND = "doc_id long, text_key long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def templates() -> list[tuple[int, str, int, list[bytes]]]:
    """(number, label, words of a k-gram, words); base phrases first."""
    each = [(t, label, BASE_K) for t, label in BASE] + [(t, label, K) for t, label in TEMPLATES]
    return [(i, label, k, words(t)) for i, (t, label, k) in enumerate(each)]


def template_grams() -> list[tuple[int, int | None, int, int, int]]:
    """(hash, template, k, place in it, its words) of all k-grams, and the row that keeps the number of words of a text."""
    out: list[tuple[int, int | None, int, int, int]] = [(0, None, 0, 0, 0)]
    for i, _, k, w in templates():
        hashes = runs_hash(Words([b" ".join(w)]).hash, k).view(np.int64)
        out += [(int(h), i, k, at, len(w)) for at, h in enumerate(hashes)]
    return out


def _cut(raw: bytes, limit: int) -> Iterator[tuple[int, bytes]]:
    """(number of the first word, part) of a folded text; each part begins with the K - 1 words before it."""
    at, before, tail = 0, 0, []
    while len(raw) - at > limit:
        end = raw.rfind(b" ", at, at + limit)
        end = end if end >= at else raw.find(b" ", at + limit)
        if end < 0:
            break
        part = raw[at:end].split()
        yield before - len(tail), b" ".join([*tail, *part])
        before += len(part)
        tail = [*tail, *part][-(K - 1) :]
        at = end + 1
    yield before - len(tail), b" ".join([*tail, raw[at:]])


def _grams(limit: int):
    def batch(keys: list[tuple[int | None, int]], parts: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        w = Words([raw for _, _, raw in parts])
        owner = np.repeat(np.arange(len(parts)), np.diff(w.bounds))
        of = [i for i, _, _ in parts]
        ids, texts, starts = pa.array([keys[i][0] for i in of], pa.int64()), pa.array([keys[i][1] for i in of], pa.int64()), pa.array([at for _, at, _ in parts], pa.int64())
        for k in (K, BASE_K):
            h = runs_hash(w.hash, k)
            inside = owner[: len(h)] == owner[k - 1 :] if len(h) else np.zeros(0, bool)
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner[: len(h)][inside], minlength=len(parts)))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(h[inside].view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids, texts, pa.array([k] * len(of), pa.int32()), starts, lists], names=["doc_id", "text_key", "k", "start", "hashes"])
        total: dict[int, int] = {}
        for (i, at, _), n in zip(parts, np.diff(w.bounds).tolist(), strict=True):
            total[i] = at + n
        yield from counted(keys, total)

    def counted(keys: list, total: dict[int, int]) -> Iterator[pa.RecordBatch]:
        done = [i for i in total if i in last]
        if done:
            row = [pa.array([keys[i][0] for i in done], pa.int64()), pa.array([keys[i][1] for i in done], pa.int64()), pa.array([0] * len(done), pa.int32())]
            yield pa.RecordBatch.from_arrays([*row, pa.array([total[i] for i in done], pa.int64()), pa.array([[0]] * len(done), pa.list_(pa.int64()))], names=["doc_id", "text_key", "k", "start", "hashes"])

    last: set[int] = set()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keys = list(zip(rows.column("doc_id").to_pylist(), rows.column("text_key").to_pylist(), strict=True))
            parts, size = [], 0
            last.clear()
            for i, text in enumerate(rows.column("text")):
                raw = (text.as_py() or "").encode().translate(FOLD)
                for at, part in _cut(raw, limit):
                    if parts and size + len(part) > limit:
                        yield from batch(keys, parts)
                        parts, size = [], 0
                        last.clear()
                    parts.append((i, at, part))
                    size += len(part)
                last.add(i)
            if parts:
                yield from batch(keys, parts)

    return run


def _verified(known: list[tuple[int, str, int, list[bytes]]]):
    def judged(w: list[bytes], spans: list) -> tuple:
        places, base, labels, best = set(), set(), set(), 0.0
        covered: dict[tuple[int, int], set[int]] = {}
        for s in spans:
            _, label, k, t = known[s["template"]]
            same = {p - s["diagonal"] for p in range(s["lo"], s["hi"]) if w[p] == t[p - s["diagonal"]]}
            if k == BASE_K:
                if len(same) == len(t):
                    places.add((s["template"], s["diagonal"]))
                    base.add(label)
            else:
                covered.setdefault((s["template"], s["group"]), set()).update(same)
        for (i, _), same in covered.items():
            _, label, _, t = known[i]
            if 100 * len(same) >= VERIFIED * len(t):
                labels.add(label)
                best = max(best, len(same) / len(t))
        at = [d for _, d in places]
        return len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if base else best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])
        for rows in batches:
            out = [(i.as_py(), k.as_py(), *judged(words(t.as_py()), s.as_py())) for i, k, t, s in zip(*(rows.column(c) for c in ("doc_id", "text_key", "text", "spans")), strict=True)]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)

    return run


def scan(docs: DataFrame, limit: int = RUN) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row (doc_id, text).

    n_base counts the places where the words of a base phrase stand one behind the other; first_word and last_word are their least and largest start.
    labels has the base labels and those of templates of which VOTES percent of the k-grams vote for one candidate and VERIFIED percent of
    the words are equal, word by word, on its diagonals. The score is the largest such share, 1 where a base phrase stands, 0 without a label.
    Null and empty texts have no words, no places (null first_word and last_word) and empty labels. Repeated rows come back each; rows of one id keep their own
    texts' results; a null doc_id comes back as null. An empty table gives none. Extra columns are ignored. Texts are told apart by doc_id and a 64-bit hash
    of the text. The template table is broadcast: a row for each of its some 600 words, whatever the input.
    """
    spark = docs.sparkSession
    rows = same_rows(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    places = spark.createDataFrame(template_grams(), "hash long, template int, k_words int, place int, template_words int")
    grams = rows.mapInArrow(_grams(limit), GRAMS).select("doc_id", "text_key", "start", F.posexplode("hashes").alias("i", "hash"))
    hits = grams.join(F.broadcast(places), "hash").select("doc_id", "text_key", (F.col("start") + F.col("i")).alias("at"), "template", "k_words", "place", "template_words")
    hits = staged(hits, "license-hits")
    n = hits.where("k_words = 0").select("doc_id", "text_key", F.col("at").alias("n_words"))
    row, k, length = ["doc_id", "text_key"], F.col("k_words"), F.col("template_words")
    diagonals = hits.where("k_words > 0").groupBy(*row, "template", "k_words", "template_words", (F.col("at") - F.col("place")).alias("diagonal"))
    diagonals = diagonals.agg(F.count_distinct("at").alias("votes"), F.min("at").alias("lo"), (F.max("at") + F.first("k_words")).alias("hi"))
    by = Window.partitionBy(*row, "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > SHIFT, F.lit(True)) | (k == BASE_K)
    grouped = diagonals.withColumn("group", F.sum(apart.cast("long")).over(by))
    votes = F.sum("votes").over(Window.partitionBy(*row, "template", "group"))
    enough = F.when(k == BASE_K, F.col("votes") == length - k + 1).otherwise(100 * votes >= VOTES * (length - k + 1))
    spans = grouped.withColumn("enough", enough).where("enough").groupBy(*row).agg(F.collect_list(F.struct("template", "group", "diagonal", "lo", "hi")).alias("spans"))
    spans = staged(spans, "license-spans").select(F.col("doc_id").alias("span_doc"), F.col("text_key").alias("span_key"), "spans")
    met = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("span_doc")) & (F.col("text_key") == F.col("span_key"))).select("doc_id", "text_key", "text", "spans")
    found = met.mapInArrow(_verified(templates()), FOUND).distinct().withColumnsRenamed({"doc_id": "found_doc", "text_key": "found_key"})
    out = n.join(found, F.col("doc_id").eqNullSafe(F.col("found_doc")) & (F.col("text_key") == F.col("found_key")), "left")
    none = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word", none("base_labels", ""), none("labels", ""), none("score", 0.0))
