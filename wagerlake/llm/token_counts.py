"""Token counts of a sentencepiece model, huge documents by overlapping chunks that are spliced where both agree.

A document of more than chunk characters is dealt out as overlapping chunks, a row each, so no task holds more than one
chunk and its overlap. Every chunk is encoded with offsets. Two neighbours are spliced at a boundary that both
show inside their overlap and that is proven stable: a non-space before it and a space behind it, while no piece of the vocabulary
holds such a pair (checked when the model is loaded), so no merge can cross it. Documents with a pair of chunks that shows no such
boundary are encoded again with twice the overlap, until it reaches across.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import same_rows, staged

CHUNK, OVERLAP = 1 << 16, 1 << 10
_models: dict[str, object] = {}


def processor(path: str):
    """The model, once per worker; refuses vocabularies in which the splice rule doesn't hold."""
    if path not in _models:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(model.id_to_piece, range(model.get_piece_size()))
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{path}: a piece holds a space behind a non-space; chunks of its texts can't be spliced")
        _models[path] = model
    return _models[path]


def boundaries(model, text: str, at: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(offsets in the document, tokens before each) of the stable boundaries in a chunk that begins at offset at; its tokens."""
    spans = model.encode(text, return_type="proto").pieces
    begin = np.fromiter((p.begin for p in spans), np.int64, len(spans))  # in bytes
    raw = np.frombuffer(text.encode(), np.uint8)
    inside = np.flatnonzero((begin > 0) & (begin < len(raw)))
    stable = inside[(raw[begin[inside]] == 32) & (raw[begin[inside] - 1] != 32)]
    return np.cumsum((raw & 0xC0) != 0x80)[begin[stable]] - 1 + at, stable, len(begin)


def _chunked(path: str):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = processor(path)
        for batch in batches:
            out = []
            for r in batch.itertuples():
                where, before, n = boundaries(model, r.part, r.at)
                head, tail = where < r.at + r.overlap, where >= r.at + len(r.part) - r.overlap
                out.append((r.doc_id, r.row, r.at, n, where[head], before[head], where[tail], before[tail]))
            yield pd.DataFrame(out, columns=["doc_id", "row", "at", "n", "head", "head_n", "tail", "tail_n"])

    return count


def _spliced(rows: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """doc_id, row, n_tokens, null where two neighbours share no stable boundary."""
    step = F.posexplode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("size") - overlap - 1), F.lit(chunk).cast("long"))).alias("k", "at")
    parts = rows.withColumn("size", F.length("text").cast("long")).select("doc_id", "row", "text", step)
    parts = parts.select("doc_id", "row", "at", F.lit(overlap).cast("long").alias("overlap"), F.expr(f"substring(text, cast(at + 1 as int), {chunk + overlap})").alias("part"))
    parts = parts.repartition(F.xxhash64("doc_id", "row", "at"))
    done = parts.mapInPandas(_chunked(path), "doc_id long, row long, at long, n long, head array<long>, head_n array<long>, tail array<long>, tail_n array<long>")
    left = done.select("doc_id", "row", (F.col("at") + chunk).alias("at"), "tail", "tail_n", F.col("n").alias("left_n"))
    pairs = done.drop("tail", "tail_n").join(left, ["doc_id", "row", "at"], "left").withColumn("met", F.expr("array_min(array_intersect(tail, head))"))
    # up to the splice the left chunk's tokens count, behind it the right chunk's
    kept = F.expr("element_at(tail_n, cast(array_position(tail, met) as int)) - left_n - element_at(head_n, cast(array_position(head, met) as int))")
    share = F.col("n") + F.when(F.col("at") == 0, F.lit(0).cast("long")).otherwise(F.when(F.col("met").isNotNull(), kept))
    return pairs.groupBy("doc_id", "row").agg(F.when(F.count(share) == F.count("*"), F.sum(share)).alias("n_tokens"))


def token_counts(docs: DataFrame, model_path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every whole text, as the model encodes it without begin or end tokens.

    docs needs doc_id and text. A null or empty text has no tokens. Rows that repeat a doc_id are counted each for itself,
    a null doc_id keeps its row, an empty table gives none. model_path must be readable on every executor.
    """
    rows = same_rows(docs, "doc_id", "text")
    sized = rows.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text", F.lit(3)).alias("row"))
    small = sized.where(F.coalesce(F.length("text"), F.lit(0)) <= chunk)
    counts = small.mapInPandas(_whole_with_bytes(model_path), "doc_id long, n_bytes long, n_tokens long")
    huge = sized.where(F.length("text") > chunk)
    keys = huge.groupBy("doc_id", "row").agg(F.count("*").alias("copies"), F.max(F.octet_length("text")).cast("long").alias("n_bytes"), F.max(F.length("text")).cast("long").alias("size"))
    keys = staged(keys, "huge").withColumn("doc_key", F.coalesce("doc_id", F.lit(0).cast("long")))
    if keys.isEmpty():
        return counts
    text = huge.dropDuplicates(["doc_id", "row"]).withColumn("doc_id", F.coalesce("doc_id", F.lit(0).cast("long")))
    text = staged(text.dropDuplicates(["doc_id", "row"]), "texts")
    longest = keys.agg(F.max("size")).first()[0]
    done = None
    while True:
        tried = staged(_spliced(text, model_path, chunk, overlap), "spliced")
        ok = tried.where("n_tokens is not null")
        done = ok if done is None else done.unionByName(ok)
        text = text.join(tried.where("n_tokens is null").select("doc_id", "row"), ["doc_id", "row"], "left_semi")
        if text.isEmpty():
            break
        overlap *= 2
        if overlap >= longest:
            chunk = overlap = longest + 1
    n = done.select(F.col("doc_id").alias("doc_key"), "row", "n_tokens")
    huge_counts = keys.join(n, ["doc_key", "row"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return counts.unionByName(huge_counts.select("doc_id", "n_bytes", "n_tokens"))


def _whole_with_bytes(path: str):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = processor(path)
        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"].tolist()]
            sizes = [len(x) for i in range(0, len(texts), 256) for x in model.encode(texts[i : i + 256], num_threads=1)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": np.array(sizes, np.int64)})

    return count
