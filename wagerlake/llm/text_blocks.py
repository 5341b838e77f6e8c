"""Whole texts in compressed blocks, and sorted key lists that blocks and shards of a key space exchange.

A block holds the documents whose id has one hash value: it is the same block in every pass, whatever order the table is read in.
Blocks travel as zstd frames, so a pass that needs each text beside what others have said about it moves about
half of the table's bytes. Keys (n-grams, hashes) go from blocks to shards as fragments of sorted distinct values; the answer
to a fragment has one entry for each of its keys, in the same order, so keys never travel back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, same_rows

#: Bytes of text of a block on average; blocks that share a group of one shard; bytes of a batch that a task deals out at once.
BLOCK_BYTES, SALT, SLICE = 12 << 20, 1024, 16 << 20
BLOCKS = "block int, ids binary, sizes binary, texts binary"


def block_count(docs: DataFrame, least: int | None = None) -> int:
    """How many blocks the texts of docs make: one for each BLOCK_BYTES, or enough to keep all cores busy."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(4 * docs.sparkSession.sparkContext.defaultParallelism if least is None else least, -(-size // BLOCK_BYTES))


def block_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x51ED2701)) % np.uint64(blocks)).astype(np.int64)


def squeeze(raw: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(raw)


def expand(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def text_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """Rows (block, ids, sizes, texts): some documents of a block each; null ids are left out, a null text is the empty one."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(b, ids.tobytes(), sizes.tobytes(), squeeze(raw, 3)) for b, ids, sizes, raw in parts(batch, blocks)]
            kinds = (pa.int32(), *[pa.binary()] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, kinds, strict=True)], names=["block", "ids", "sizes", "texts"])

    return identified(docs).mapInArrow(pack, BLOCKS)


def identified(docs: DataFrame) -> DataFrame:
    rows = same_rows(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.where("doc_id is not null")


def parts(batch: pa.RecordBatch, blocks: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, memoryview]]:
    """(block, ids, sizes, texts in UTF-8) of a batch of (doc_id, text), about SLICE bytes of text at a time."""
    step = max(1, int(len(batch) * SLICE / max(1, batch.column("text").nbytes)))
    for at in range(0, len(batch), step):
        some = batch.slice(at, step)
        ids = some.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        to = block_of(ids, blocks)
        order = np.argsort(to, kind="stable")
        text = some.column("text").cast(pa.large_string()).fill_null("").take(pa.array(order))
        ids, to = ids[order], to[order]
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        raw = memoryview(text.buffers()[2] or b"")
        cuts = np.flatnonzero(np.diff(to)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(to)], strict=True):
            yield int(to[a]), ids[a:b], np.diff(ends[a : b + 1]), raw[ends[a] : ends[b]]


def documents_of(block: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, bytes]]:
    """(ids, sizes, texts) of each part of a block, in an order that doesn't depend on how the parts came."""
    parts = sorted(zip(block["ids"], block["sizes"], block["texts"], strict=True))
    for ids, sizes, texts in parts:
        yield np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64), expand(texts)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys as differences, byte by byte of their places, compressed."""
    step = np.diff(keys, prepend=np.uint64(0))
    return squeeze(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_keys(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(expand(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_numbers(x: np.ndarray) -> bytes:
    """Integers, unsorted, as planes of their bytes."""
    return squeeze(np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(expand(raw), np.uint8).reshape(8, -1).T).view(np.int64).ravel()


class Finder:
    """Places of keys in a sorted array of distinct uint64: one probe of a hash table each, a binary search where two keys share a slot."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(10, min(22, (4 * len(keys)).bit_length())))
        self.slots = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.slots[self._slot(keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, x: np.ndarray) -> np.ndarray:
        return ((x * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there) of each x."""
        if not len(self.keys):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        at = self.slots[self._slot(x)].astype(np.int64)
        there = self.keys[at] == x
        rest = np.flatnonzero(~there)
        if len(rest):
            found = np.minimum(np.searchsorted(self.keys, x[rest]), len(self.keys) - 1)
            at[rest], there[rest] = found, self.keys[found] == x[rest]
        return at, there
