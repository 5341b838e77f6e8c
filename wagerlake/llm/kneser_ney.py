"""Interpolated modified Kneser-Ney models over bytes, one for each class, counted and looked up in shards.

Pass 1 goes over the blocks of texts (text_blocks.py). For each class it counts the n-grams of the documents that teach it, and
for each block it lists the distinct n-grams that its documents ask about. Counts are summed by shard; orders below the
highest have continuation counts, discounts come from counts of counts. A shard holds all n-grams whose context ends in the
same two bytes, so every order above two of an n-gram, and its contexts, lie in one shard as sorted arrays of keys; the
first two orders are a dense table of 65,536 entries a class. Shards answer each block's list, and pass 2 sums the
answers over its texts. What moves grows with the number of blocks times their distinct n-grams, never with the square of anything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, staged
from .text_blocks import SALT, Finder, block_count, block_of, documents_of, expand, pack_keys, pack_numbers, squeeze, text_blocks, unpack_keys, unpack_numbers

ORDER, SHARDS, MOST_CLASSES = 5, 128, 512
#: Steps of one bit in an answer; an answer is at most 65,535 steps, or 32 bits.
STEPS = 2048
#: Bytes of text whose n-grams a task lists at once.
RUN = 2 << 20
FRAGMENTS = "kind int, block int, salt int, shard int, cls int, keys binary, counts binary"


def runs(block: pd.DataFrame, clean: Callable[[np.ndarray], np.ndarray], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """(ids, n-grams, where each document's begin, their texts) of runs of a block's documents.

    clean maps all bytes of a run, documents apart by the byte 0, to the symbols of the model (0 stays); every symbol of a document is
    the end of one n-gram, the first ones with 0 before them.
    """
    for ids, sizes, raw in documents_of(block):
        ends = np.cumsum(sizes)
        cut = 0
        while cut < len(ids):
            base = ends[cut] - sizes[cut]
            to = max(cut + 1, int(np.searchsorted(ends, base + RUN, side="right")))
            pieces = [raw[ends[i] - sizes[i] : ends[i]].replace(b"\0", b" ") for i in range(cut, to)]
            symbols = clean(np.frombuffer(b"\0" + b"\0".join(pieces) + b"\0", np.uint8))
            zero = symbols == 0
            last = symbols.astype(np.uint64)
            grams = last.copy()
            since = np.arange(len(symbols)) - np.maximum.accumulate(np.where(zero, np.arange(len(symbols)), 0))
            for k in range(1, order):
                part = last[:-k] << np.uint64(8 * k)
                part[since[k:] <= k] = 0
                grams[k:] |= part
            inside = ~zero
            marks = np.cumsum(inside)
            at = np.flatnonzero(zero)
            yield ids[cut:to], grams[inside], marks[at], pieces
            cut = to


def shard_of(grams: np.ndarray, shards: int) -> np.ndarray:
    """By the two symbols before the last."""
    return (mix((grams >> np.uint64(8)) & np.uint64(0xFFFF)) % np.uint64(shards)).astype(np.int64)


def asked(block: pd.DataFrame, clean: Callable, order: int, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places by shard, where each shard's begin, values) of a block's distinct n-grams."""
    parts = [np.unique(g) for _, g, *_ in runs(block, clean, order)]
    return _dealt(np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64), shards)


def _dealt(grams: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    where = shard_of(grams, shards)
    order = np.argsort(where, kind="stable")
    return order, np.searchsorted(where[order], np.arange(shards + 1)), grams


def _listed(classes: list[str], clean: Callable, order: int, shards: int):
    def one(block: pd.DataFrame, teach: pd.DataFrame) -> pd.DataFrame:
        if not len(block):
            return pd.DataFrame(columns=["kind", "block", "salt", "shard", "cls", "keys", "counts"])
        b = int(block["block"].iloc[0])
        teacher = teach.dropna().set_index("doc_id")["cls"].map({c: i for i, c in enumerate(classes)})
        every: list[np.ndarray] = []
        counted: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in classes]
        for ids, grams, marks, _ in runs(block, clean, order):
            every.append(np.unique(grams))
            cls = teacher.reindex(ids).fillna(-1).to_numpy(np.int64)
            of = np.repeat(cls, np.diff(marks))
            for c in np.unique(cls[cls >= 0]):
                counted[c].append(np.unique(grams[of == c], return_counts=True))
        rows = []
        order_, cuts, grams = _dealt(np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64), shards)
        for s in range(shards):
            if cuts[s] < cuts[s + 1]:
                rows.append((0, b, b // SALT, s, -1, pack_keys(grams[order_[cuts[s] : cuts[s + 1]]]), None))
        for c, parts in enumerate(counted):
            if parts:
                grams, n = summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                order_, cuts, grams = _dealt(grams, shards)
                rows += [(1, b, b // SALT, s, c, pack_keys(grams[i]), pack_numbers(n[i])) for s in range(shards) if len(i := order_[cuts[s] : cuts[s + 1]])]
        return pd.DataFrame(rows, columns=["kind", "block", "salt", "shard", "cls", "keys", "counts"])

    return one


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of n over each."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(keys) else n


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for c, part in pdf.groupby("cls"):
        keys, n = summed(np.concatenate([unpack_keys(x) for x in part["keys"]]), np.concatenate([unpack_numbers(x) for x in part["counts"]]))
        out.append(pd.DataFrame({"shard": pdf["shard"].iloc[0], "cls": c, "gram": keys.view(np.int64), "n": n}))
    return pd.concat(out)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and 3 or more from how many n-grams have counts 1 to 4; fixed ones where a count of counts is 0."""
    if min(n) <= 0:
        return 0.5, 0.75, 0.9
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(float(min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i)) for i in (1, 2, 3))


def context_terms(grams: np.ndarray, c: np.ndarray, d: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted n-grams with counts c: each one's own share, the distinct contexts and the weight each leaves to the lower order."""
    ctx = grams >> np.uint64(8)
    first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(ctx) else np.zeros(0, np.int64)
    cut = np.array([0, *d])[np.minimum(c, 3)]
    total = np.add.reduceat(c, first).astype(float) if len(ctx) else np.zeros(0)
    left = np.add.reduceat(cut, first) / total if len(ctx) else np.zeros(0)
    size = np.diff(np.append(first, len(ctx)))
    return (c - cut) / np.repeat(total, size), ctx[first], left


class Model:
    """What every shard needs of each class besides its own n-grams: discounts by order and the dense first two orders."""

    def __init__(self, classes: list[str], counts: DataFrame, order: int):
        """counts: cls, gram, n of the highest order. The driver sees counts of counts and at most 65,536 byte pairs a class."""
        self.classes, self.order = classes, order
        now = counts.select("cls", "gram", "n")
        many: dict[tuple[int, int, int], int] = {}
        for k in range(order, 1, -1):
            if k < order:
                low = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")
                now = now.groupBy("cls", low).agg(F.count("*").alias("n"))
                now = now if k > 2 else staged(now, "pairs")
            for r in now.where("n <= 4").groupBy("cls", "n").agg(F.count("*").alias("many")).collect():
                many[r["cls"], k, r["n"]] = r["many"]
        pairs = now.toPandas()
        self.discounts, self.dense = {}, []
        for c in range(len(classes)):
            part = pairs[pairs["cls"] == c].sort_values("gram")
            if part.empty:  # its documents are not there, or have no symbols: never the best
                self.dense.append(np.full(65536, 2.0**-40))
                self.discounts |= {(c, k): discounts([0]) for k in range(2, order + 1)}
                continue
            grams, n = part["gram"].to_numpy(np.int64).view(np.uint64), part["n"].to_numpy(np.int64)
            one = np.bincount((grams & np.uint64(255)).astype(np.int64), minlength=256)
            for k in range(2, order + 1):
                self.discounts[c, k] = discounts([many.get((c, k, i), 0) for i in (1, 2, 3, 4)])
            d1 = discounts([int((one == i).sum()) for i in (1, 2, 3, 4)])
            seen = np.flatnonzero(one).astype(np.uint64)
            p = np.full(256, 1 / 256)
            if len(seen):
                own, _, left = context_terms(seen, one[seen.astype(np.int64)], d1)
                p *= left[0]
                p[seen.astype(np.int64)] += own
            table = np.tile(p, (256, 1))
            own, ctx, left = context_terms(grams, n, self.discounts[c, 2])
            table[ctx.astype(np.int64)] *= left[:, None]
            table.reshape(-1)[grams.astype(np.int64)] += own
            self.dense.append(table.ravel())

    def shard(self, counts: pd.DataFrame) -> list:
        """Sorted arrays of one shard, by class and order: n-grams, their shares, contexts, weights left to the lower order."""
        out = []
        for c in range(len(self.classes)):
            part = counts[counts["cls"] == c]
            grams, n = part["gram"].to_numpy(np.int64).view(np.uint64), part["n"].to_numpy(np.int64)
            order = np.argsort(grams)
            grams, n, levels = grams[order], n[order], []
            for k in range(self.order, 2, -1):
                if k < self.order:
                    grams, n = np.unique(grams & np.uint64((1 << 8 * k) - 1), return_counts=True)
                own, ctx, left = context_terms(grams, n, self.discounts[c, k])
                levels.append((k, grams, own, ctx, left))
            out.append(levels[::-1])
        return out

    def bits(self, shard: list, grams: np.ndarray) -> np.ndarray:
        """-log2 of each n-gram's probability in each class, in steps; grams sorted."""
        out = np.zeros((len(self.classes), len(grams)), np.uint16)
        for c, levels in enumerate(shard):
            p = self.dense[c][(grams & np.uint64(0xFFFF)).astype(np.int64)]
            for k, keys, own, ctx, left in levels:
                g = grams & np.uint64((1 << 8 * k) - 1)
                at, there = _found(ctx, g >> np.uint64(8))
                p = np.where(there, left[at] if len(left) else 1, 1) * p
                at, there = _found(keys, g)
                p = p + np.where(there, own[at] if len(own) else 0, 0)
            out[c] = np.minimum(np.floor(-np.log2(p) * STEPS + 0.5), 65535).astype(np.uint16)
        return out


def _found(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


def _answers(model: Model):
    def one(questions: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        if not len(questions):
            return pd.DataFrame({"block": [], "shard": [], "bits": []})
        shard = model.shard(counts)
        bits = [squeeze(np.ascontiguousarray(model.bits(shard, unpack_keys(x)).view(np.uint8).reshape(-1, 2).T).tobytes()) for x in questions["keys"]]
        return pd.DataFrame({"block": questions["block"], "shard": questions["shard"], "bits": bits})

    return one


def _read(classes: int, clean: Callable, order: int, shards: int, mark: Callable[[bytes], bool]):
    def one(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(block):
            return pd.DataFrame({"doc_id": [], "n": [], "bits": [], "mark": []})
        by, cuts, grams = asked(block, clean, order, shards)
        table = np.zeros((classes, len(grams)), np.uint16)
        for s, raw in zip(answers["shard"], answers["bits"], strict=True):
            planes = np.frombuffer(expand(raw), np.uint8).reshape(2, -1)
            table[:, by[cuts[s] : cuts[s + 1]]] = np.ascontiguousarray(planes.T).view(np.uint16).reshape(classes, -1)
        find, out = Finder(grams), []
        for ids, own, marks, texts in runs(block, clean, order):
            at, _ = find(own)
            total = [np.diff(np.concatenate([[0], np.cumsum(row[at], dtype=np.int64)])[marks]) for row in table]
            n = np.diff(marks)
            out.append(pd.DataFrame({"doc_id": ids, "n": n, "bits": list(np.stack(total, 1) / (STEPS * np.maximum(n, 1))[:, None]) if classes else [np.zeros(0)] * len(ids), "mark": list(map(mark, texts))}))
        return pd.concat(out)

    return one


def cross_entropies(docs: DataFrame, teach: DataFrame, clean: Callable[[np.ndarray], np.ndarray], order: int = ORDER, shards: int | None = None, blocks: int | None = None, mark: Callable[[bytes], bool] = bool) -> tuple[DataFrame, list[str]]:
    """(rows doc_id, n, bits, mark), classes: symbols of each document of docs, bits a symbol under each class's model, and what mark says of its text.

    docs needs doc_id and text; teach has (doc_id, cls) of the documents that each class is learned from. bits[i] belongs to
    classes[i]; a document without symbols has n 0 and bits 0. Rows that repeat a doc_id come back each; null ids have no row. Of several
    classes of one doc_id the least by name counts. The driver holds 512 KB for each class, so more than MOST_CLASSES are refused. The bits of one n-gram are
    cut at 32, which only those reach that every order finds unlikely; shards grow with the blocks beyond 64.
    """
    one = teach.select(F.col("doc_id").cast("long"), "cls").where("doc_id is not null and cls is not null").groupBy("doc_id").agg(F.min("cls").alias("cls"))
    classes = sorted(r[0] for r in one.select("cls").distinct().limit(MOST_CLASSES + 1).collect())
    if len(classes) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes to learn; the driver holds a table for each")
    blocks = blocks or block_count(docs)
    shards = shards or min(1 << 14, SHARDS << max(0, (blocks // 64).bit_length() - 1))
    texts = text_blocks(docs, blocks)
    here = _block_column(one, blocks)
    found = texts.groupBy("block").cogroup(here.groupBy("block")).applyInPandas(_listed(classes, clean, order, shards), FRAGMENTS)
    found = staged(found, "ngrams")
    merged = found.where("kind = 1").groupBy("salt", "shard").applyInPandas(_merged, "shard int, cls int, gram long, n long")
    counts = staged(merged.groupBy("shard", "cls", "gram").agg(F.sum("n").alias("n")), "counts")
    model = Model(classes, counts, order)
    salts = -(-blocks // SALT)
    sent = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))) if salts > 1 else counts.withColumn("salt", F.lit(0))
    questions = found.where("kind = 0").select("salt", "shard", "block", "keys")
    answers = questions.groupBy("salt", "shard").cogroup(sent.groupBy("salt", "shard")).applyInPandas(_answers(model), "block int, shard int, bits binary")
    scored = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_read(len(classes), clean, order, shards, mark), "doc_id long, n long, bits array<double>, mark boolean")
    return scored, classes


def _block_column(rows: DataFrame, blocks: int) -> DataFrame:
    @F.pandas_udf("int")
    def block(ids: pd.Series) -> pd.Series:
        return pd.Series(block_of(ids.to_numpy(np.int64), blocks)).astype("int32")

    return rows.withColumn("block", block("doc_id"))
