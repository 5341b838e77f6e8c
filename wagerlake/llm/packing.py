"""Packing documents into training sequences of several permitted lengths: best fit over variable capacities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, blocks, same_rows, staged

#: Permitted sequence lengths in tokens, and what a sequence costs besides its tokens.
LENGTHS, OVERHEAD = (512, 1024, 2048, 4096), 64
#: Documents that are packed together; groups are dealt by hash, so nothing hot makes one larger.
GROUP = 8192


def best_fit(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each piece and the final capacity of each bin; sizes must be sorted, largest first.

    A piece goes to the open bin that it leaves with the least room. If it fits none, the size opens that costs least for
    each token it can expect: (length + overhead) / min(length, tokens still to place). A bin that is not full at the end
    shrinks to the smallest permitted length that holds its contents.
    """
    lengths = tuple(sorted(lengths))
    if len(sizes) and sizes.max() > lengths[-1]:
        raise ValueError("a piece is longer than the longest permitted sequence")
    left = int(sizes.sum())
    free: list[list[int]] = [[] for _ in range(lengths[-1] + 1)]
    some = 0  # bit r is set while a bin with room r is open
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    used: list[int] = []
    room: list[int] = []
    for i, size in enumerate(sizes.tolist()):
        fits = some >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                some &= ~(1 << r)
        else:
            r = min((c for c in lengths if c >= size), key=lambda c: ((c + overhead) / min(c, left), c))
            b = len(used)
            used.append(0)
            room.append(r)
        where[i], offset[i] = b, used[b]
        used[b] += size
        left -= size
        room[b] = r - size
        if room[b]:
            free[room[b]].append(b)
            some |= 1 << room[b]
    fill = np.array(used, np.int64)
    return where, offset, np.array(lengths, np.int64)[np.searchsorted(lengths, fill)]


def _lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for first, raws in blocks(batch["text"].tolist()):
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[first : first + len(raws)], "n_tokens": np.diff(Words(raws).bounds)})


def word_lengths(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens: words of every whole text; none for a null text."""
    return same_rows(docs, "doc_id", "text").mapInPandas(_lengths, "doc_id long, n_tokens long")


def pack(sized: DataFrame, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, group: int = GROUP) -> DataFrame:
    """doc_id, piece, n_tokens, bin_id, bin_length, bin_offset for rows (doc_id, n_tokens) of any size.

    A document longer than the longest sequence is cut in pieces of that length and a rest. Documents without tokens
    (null, 0 or negative) fill no bin and have no row. Repeated rows are packed each. An empty table gives no rows.
    Groups are dealt by hash of id, row and piece, about group documents each, so neither a row repeated often nor the pieces of
    one huge document share a group, and packed apart; only ids and sizes move.
    """
    longest = max(lengths)
    sized = staged(same_rows(sized, "doc_id", "n_tokens").select(F.col("doc_id").cast("long"), F.col("n_tokens").cast("long")).where("n_tokens > 0"), "sizes")
    groups = max(1, -(-sized.count() // group))
    sized = sized.withColumn("row", F.monotonically_increasing_id())  # of a written table, so the same if a task runs again
    pieces = sized.withColumn("piece", F.explode(F.expr(f"sequence(0L, (n_tokens - 1) div {longest}L)")))
    pieces = pieces.select("doc_id", "piece", F.expr(f"least({longest}L, n_tokens - piece * {longest}L)").alias("n_tokens"), F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(groups)).alias("group"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        where, offset, size = best_fit(pdf["n_tokens"].to_numpy(), lengths, overhead)
        return pdf.assign(bin_id=pdf["group"] * (1 << 32) + where, bin_length=size[where], bin_offset=offset)[["doc_id", "piece", "n_tokens", "bin_id", "bin_length", "bin_offset"]]

    return pieces.groupBy("group").applyInPandas(one, "doc_id long, piece long, n_tokens long, bin_id long, bin_length long, bin_offset long")
