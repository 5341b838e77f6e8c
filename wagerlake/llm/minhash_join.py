"""Near-duplicate documents: chosen-path set similarity join over minwise tokens.

Every document's set of 5-word shingles is embedded as SLOTS minwise tokens. Independent trees branch on one or two slots chosen by the
node's key, FAN on average; a document goes to the child named by its own token there. A pair of similarity s shares s * FAN children a
level: pairs under 1 / FAN thin out, pairs at the threshold keep a chance in every tree (recall() gives it for any depth).
Branching is by the data alone: a node whose documents are linked already is done, one of at most LEAF documents is
compared exhaustively, a larger one branches, unless that would not lessen the pairs to compare (its documents are all too alike for
that); then it is compared exhaustively too, block by block, so no node is cut short and no depth is set.

A comparison looks at packed sketches in numpy: set sizes, 4 bits of each token, and the parity of the set's hashes in PARITY places. Sets
differ in at least as many elements as their parities do, so the last loses no pair; it is sharp for sets up to about PARITY shingles, the
tokens serve beyond. What the sketches leave is confirmed on full shingle sets.

Two passes come before the exhaustive one, so that large groups of copies cost some rows a document, not a row a pair: the first links each
document with the smallest one of its first nodes, the second with the nearest one of another component in each of its nodes, by sketch. What is
linked by then needs no comparison; the exhaustive pass looks at all pairs of documents that still are in different components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, blocks, mix, runs_hash, same_rows, staged
from .components import components

SLOTS = 64
#: Trees; children of a node on average, between 1 and 2; documents compared at once; share of a node's pairs that its children may still have to compare.
TREES, FAN, LEAF, SHRINK = 10, 1.4, 1024, 0.9
#: Bits of the parity sketch, bytes of shingle sets that are confirmed together, standard deviations of token differences that are let pass.
PARITY, SET_BYTES, SIGMAS = 1024, 4 << 20, 6
#: 64-bit words of a sketch: set size, 4 bits a token, parities.
WORDS = 1 + SLOTS // 16 + PARITY // 64
_A = np.random.default_rng(11).integers(1, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(12).integers(0, 1 << 63, SLOTS, dtype=np.uint64)


def shingle_sets(raws: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; below width words the whole sequence is one, no words give none."""
    w = Words(raws, lower=True)
    runs = {n: runs_hash(w.hash, n) for n in range(1, width + 1)}
    out = []
    for lo, hi in zip(w.bounds[:-1], w.bounds[1:], strict=True):
        n = min(width, hi - lo)
        out.append(np.unique(runs[n][lo : hi - n + 1]) if n else np.zeros(0, np.uint64))
    return out


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The smallest of each slot's hashes over the set."""
    out = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        part = shingles[i : i + 2048, None] * _A + _B
        np.minimum(out, part.min(axis=0), out=out)
    return (mix(out) >> np.uint64(33)).astype(np.int64)


def parities(shingles: np.ndarray) -> np.ndarray:
    """For each of PARITY places whether an odd number of the set's hashes fall there, packed to 64-bit words."""
    odd = np.bincount((mix(shingles ^ np.uint64(0xA0761D6478BD642F)) & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketch(shingles: np.ndarray, mins: np.ndarray) -> bytes:
    nibble = ((mins & 15).astype(np.uint64).reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64)
    return np.concatenate([[len(shingles)], nibble.view(np.int64), parities(shingles)]).tobytes()


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for first, raws in blocks(batch["text"].tolist()):
            rows = []
            for s in shingle_sets(raws):
                m = minwise(s)
                d1 = (np.bitwise_xor.reduce(mix(s + np.uint64(1))) if len(s) else np.uint64(0)).astype(np.int64)
                d2 = mix(s * np.uint64(0x9FB21C651E98DF25)).sum(dtype=np.uint64).astype(np.int64)
                rows.append((len(s), d1, d2, m.astype(np.int32), sketch(s, m)))
            part = pd.DataFrame(rows, columns=["n_shingles", "d1", "d2", "mins", "sketch"])
            for c in ("text_key", "doc_id"):
                part.insert(0, c, batch[c].to_numpy()[first : first + len(raws)])
            yield part


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and text_key, by which rows that repeat a doc_id are told apart; null ids are left out."""
    rows = same_rows(docs, "doc_id", "text").where("doc_id is not null")
    return rows.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_key())


def text_key():
    return F.xxhash64(F.col("text").cast("string"), F.lit(3)).alias("text_key")


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, a 128-bit digest of the set, its minwise tokens and its sketch."""
    return keyed(docs).mapInPandas(_sketches, "doc_id long, text_key long, n_shingles long, d1 long, d2 long, mins array<int>, sketch binary")


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for first, raws in blocks(batch["text"].tolist()):
            yield pd.DataFrame({"id": batch["id"].to_numpy()[first : first + len(raws)], "shingles": [s.tobytes() for s in shingle_sets(raws)]})


def _linked(threshold: int):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, x, others = (batch.column(c) for c in ("a", "x", "others"))
            left, right = [], []
            for i in range(len(batch)):
                p, some = np.frombuffer(x[i].as_buffer(), np.uint64), others[i].values
                ids, sets = some.field("b").to_numpy(), some.field("y")
                for k in range(len(ids)):
                    q = np.frombuffer(sets[k].as_buffer(), np.uint64)
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    if both and 100 * both >= threshold * (len(p) + len(q) - both):
                        left.append(a[i].as_py())
                        right.append(int(ids[k]))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return judge


def confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) of reps (id, doc_id, text_key) whose full shingle sets reach threshold percent.

    Only documents of some pair are read again. The set of b travels once a pair, that of a once for about SET_BYTES of its partners' sets.
    """
    pairs = staged(pairs.distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct().join(reps, "id")
    text = keyed(docs).join(wanted, ["doc_id", "text_key"]).groupBy("id").agg(F.first("text").alias("text"))  # equal texts all
    sets = staged(text.mapInPandas(_sets, "id long, shingles binary"), "sets")
    sized = pairs.join(sets.select(F.col("id").alias("b"), F.octet_length("shingles").alias("size")), "b")
    cells = sized.groupBy("a").agg(F.ceil(F.sum("size") / SET_BYTES).alias("cells"))
    dealt = sized.join(cells, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("cells")).alias("cell"))
    side = lambda k, v: sets.select(F.col("id").alias(k), F.col("shingles").alias(v))
    grouped = dealt.join(side("b", "y"), "b").groupBy("a", "cell").agg(F.collect_list(F.struct("b", "y")).alias("others"))
    return grouped.join(side("a", "x"), "a").select("a", "x", "others").mapInArrow(_linked(threshold), "a long, b long")


def most_unlike(threshold: int) -> int:
    """Differing token bits allowed: SIGMAS standard deviations beyond what a pair at the threshold shows."""
    p = (1 - threshold / 100) * 15 / 16
    return math.ceil(SLOTS * p + SIGMAS * math.sqrt(SLOTS * p * (1 - p)))


def may_link(x: np.ndarray, y: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether sizes and sketches leave the threshold possible, and how unlike they are; x and y, words in the first place, broadcast against each other.

    The smaller set must have threshold percent of the larger one, and linked sets of m and n elements differ in at
    most (m + n) * (100 - threshold) / (100 + threshold) of them.
    """
    m, n = x[0].astype(np.int64), y[0].astype(np.int64)
    unlike = odd = 0
    for k in range(1, WORDS):  # a word at a time keeps what is between in the cache
        apart = x[k] ^ y[k]
        if k <= SLOTS // 16:
            apart |= apart >> np.uint64(1)
            apart = (apart | (apart >> np.uint64(2))) & np.uint64(0x1111111111111111)
            unlike = unlike + np.bitwise_count(apart).astype(np.uint16)
        else:
            odd = odd + np.bitwise_count(apart).astype(np.uint16)
    odd = odd.astype(np.int64)
    may = (100 * np.minimum(m, n) >= threshold * np.maximum(m, n)) & ((100 + threshold) * odd <= (100 - threshold) * (m + n)) & (unlike <= most_unlike(threshold))
    return may, unlike + SLOTS * odd / np.maximum(m + n, 1)


def _binary(column: pa.Array) -> np.ndarray:
    """Sketches, a row for each of their words."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(np.uint64).reshape(-1, WORDS).T.copy()


def _ruled(threshold: int):
    """Pairs (a, b, x, y) that their sketches don't rule out."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                good, _ = may_link(_binary(batch.column("x")), _binary(batch.column("y")), threshold)
                yield batch.select(["a", "b"]).filter(pa.array(good))

    return judge


def _nearest(p: np.ndarray, q: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Places of the pairs that are the least unlike one of either p or q."""
    best = []
    for side in (p, q):
        order = np.lexsort((apart, side))
        best.append(order[np.concatenate([[True], side[order[1:]] != side[order[:-1]]])] if len(order) else order)
    return np.unique(np.concatenate(best))


def _compared(threshold: int, nearest: bool):
    """Rows (x, y): the documents of a node, or those of two blocks of one; pairs of different components that may be linked.

    nearest: of these only each document's least unlike one in the row.
    """

    def parts(column: pa.Array):
        ends = np.concatenate([[0], np.cumsum([n or 0 for n in pc.list_value_length(column).to_pylist()])])
        flat = column.flatten()
        return ends, flat.field("id").to_numpy(), flat.field("component").to_numpy(), _binary(flat.field("sketch"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            ends, ids, comp, words = parts(batch.column("x"))
            other = parts(batch.column("y"))
            size, found = np.diff(ends), [np.zeros((2, 0), np.int64)]
            alone = np.array(batch.column("y").is_null())
            for n in np.unique(size[alone & (size <= 32)]):  # all small nodes of a size at once
                i, j = np.triu_indices(n, 1)
                at = ends[:-1][alone & (size == n)]
                for some in np.split(at, range(8192, len(at), 8192)):
                    p, q = (some[:, None] + i).ravel(), (some[:, None] + j).ravel()
                    on = comp[p] != comp[q]
                    p, q = p[on], q[on]
                    on, apart = may_link(words[:, p], words[:, q], threshold)
                    p, q = p[on], q[on]
                    if nearest:
                        best = _nearest(p, q, apart[on])
                        p, q = p[best], q[best]
                    found.append(np.stack([ids[p], ids[q]]))
            for r in np.flatnonzero(~alone | (size > 32)):
                a = slice(ends[r], ends[r + 1])
                of = (ends, ids, comp, words) if alone[r] else other
                b = slice(of[0][r], of[0][r + 1])
                here = []
                for k in range(a.start, a.stop, 64):
                    s = slice(k, min(k + 64, a.stop))
                    on, apart = may_link(words[:, s, None], of[3][:, None, b], threshold)
                    p, q = np.nonzero(on & (comp[s, None] != of[2][None, b]))
                    apart = apart[p, q]
                    if nearest:
                        best = _nearest(p, q, apart)
                        p, q, apart = p[best], q[best], apart[best]
                    here.append((ids[s][p], of[1][b][q], apart))
                p, q, apart = map(np.concatenate, zip(*here, strict=True))
                best = _nearest(p, q, apart) if nearest else slice(None)
                found.append(np.stack([p[best], q[best]]))
            pairs = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return judge


def compared(rows: DataFrame, known: DataFrame, threshold: int, leaf: int, nearest: bool = False) -> DataFrame:
    """Candidate pairs (a, b) within each node of rows (key, id, n); known: id, component, sketch. n documents make blocks of about leaf."""
    cells = F.ceil(F.col("n") / leaf).cast("int")
    rows = rows.select("key", cells.alias("cells"), F.pmod(F.xxhash64("id"), cells).cast("int").alias("i"), "id").join(known, "id")
    packs = rows.groupBy("key", "cells", "i").agg(F.collect_list(F.struct("id", "component", "sketch")).alias("x"))
    packs = staged(packs, "packs")
    one = packs.where("cells = 1").select("x", F.lit(None).cast(packs.schema["x"].dataType).alias("y"))
    left = packs.where("cells > 1").select("key", "x", "i", F.explode(F.sequence("i", F.col("cells") - 1)).alias("j"))
    right = packs.where("cells > 1").select("key", F.col("x").alias("y"), F.col("i").alias("j"), F.explode(F.sequence(F.lit(0), "i")).alias("i"))
    two = left.join(right, ["key", "i", "j"]).select("x", "y")
    return one.unionByName(two).mapInArrow(_compared(threshold, nearest), "a long, b long")


def _children(rows: DataFrame, fan: float, *more: str) -> DataFrame:
    """(parent, key, id and more columns) for rows (key, id, mins): one slot or two chosen by the node's key, then the document's own token there."""
    first = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(SLOTS)).cast("int")
    second = F.pmod(first + 1 + F.pmod(F.xxhash64("key", F.lit(2)), F.lit(SLOTS - 1)), F.lit(SLOTS)).cast("int")
    both = F.pmod(F.xxhash64("key", F.lit(3)), F.lit(1000)) < round((fan - 1) * 1000)
    slots = F.when(both, F.array(first, second)).otherwise(F.array(first))
    return rows.withColumn("slot", F.explode(slots)).select(F.col("key").alias("parent"), F.xxhash64("key", "slot", F.get("mins", F.col("slot"))).alias("key"), "id", *more)


def _open(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """(key, id, n) of the nodes (key, id) that hold more than one component; n documents each."""
    size = nodes.join(known.select("id", "component"), "id").groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    return nodes.join(size.where("lo < hi").select("key", "n"), "key").select("key", "id", "n")


def recall(similarity: float, depth: int, trees: int = TREES, fan: float = FAN) -> float:
    """Chance that a pair meets in some node of that depth: a branching process of one or two children, each shared with chance similarity."""
    lost = 0.0
    for _ in range(depth):
        on = 1 - similarity + similarity * lost
        lost = (2 - fan) * on + (fan - 1) * on * on
    return 1 - lost**trees


def near_duplicates(docs: DataFrame, threshold: int = 75, trees: int = TREES, fan: float = FAN, leaf: int = LEAF, shrink: float = SHRINK) -> DataFrame:
    """doc_id, n_shingles, component_id, text_key, group_id: documents linked at 100 * |A and B| >= threshold * |A or B| on shingle sets.

    docs needs doc_id and text; other columns are ignored. A null doc_id has no row. A null or empty text, or one
    without words, has an empty set: its own component, linked with nothing. Equal sets are always linked. Rows that
    repeat a doc_id come back as often, each in the component of its own text; component_id is the smallest doc_id of the component, group_id
    (null for empty sets) tells apart components that share one. text_key is the key of a row's text. An empty table gives no rows.
    """
    all_docs = staged(sketched(docs), "sketches")
    full = all_docs.where("n_shingles > 0")
    classes = full.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"))
    classes = staged(classes.select("d1", "d2", "rep.*", F.monotonically_increasing_id().alias("id")), "classes")
    reps = full.join(classes, ["d1", "d2", "doc_id", "text_key"]).groupBy("id").agg(*(F.first(c).alias(c) for c in ("doc_id", "text_key", "mins", "sketch")))  # rows of a class and an id are equal
    reps = staged(reps, "reps")
    names, sketches, mins = reps.select("id", "doc_id", "text_key"), reps.select("id", "sketch"), reps.select("id", "mins")

    def components_of(edges: DataFrame) -> DataFrame:
        known = reps.join(components(edges).withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"), "sketch")
        return staged(known, "known")

    roots = reps.select("id", "mins", "doc_id", F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("tree")).withColumn("key", F.xxhash64("tree", F.lit(0)))
    first = staged(_children(roots, fan, "doc_id").select("key", "id", "doc_id"), "nodes")
    nodes = first.select("key", "id")
    heads = first.groupBy("key").agg(F.min(F.struct("doc_id", "id"))["id"].alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
    star = nodes.join(heads, "key").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    star = star.join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("x")), "a").join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("y")), "b")
    edges = staged(confirmed(star.select("a", "b", "x", "y").mapInArrow(_ruled(threshold), "a long, b long"), names, docs, threshold), "links")

    known, done = components_of(edges), []
    while True:
        rows = staged(_open(nodes, known), "open")
        done.append(rows.where(F.col("n") <= leaf))
        large = rows.where(F.col("n") > leaf)
        if large.isEmpty():
            break
        kids = staged(_children(large.join(mins, "id"), fan), "kids")
        pairs = kids.groupBy("parent", "key").agg(F.count("*").cast("double").alias("m")).groupBy("parent").agg(F.sum(F.col("m") * F.col("m")).alias("pairs"))
        stuck = large.groupBy("key").agg(F.max("n").alias("n")).join(pairs.withColumnRenamed("parent", "key"), "key").where(F.col("pairs") >= shrink * F.col("n") * F.col("n")).select("key")
        stuck = staged(stuck, "stuck")
        done.append(large.join(stuck, "key", "left_semi"))
        nodes = staged(kids.join(stuck.withColumnRenamed("key", "parent"), "parent", "left_anti").select("key", "id"), "nodes")
    rows = reduce(DataFrame.unionByName, done)
    near = confirmed(compared(rows, known, threshold, leaf, nearest=True), names, docs, threshold)
    edges = staged(edges.unionByName(near), "links")
    known = components_of(edges)
    edges = edges.unionByName(confirmed(compared(_open(rows.select("key", "id"), known), known, threshold, leaf), names, docs, threshold))

    final = names.select("id", "doc_id").join(components(edges).withColumnRenamed("node", "id"), "id", "left").select("id", "doc_id", F.coalesce("component", "id").alias("group_id"))
    final = staged(final, "components")
    least = final.groupBy("group_id").agg(F.min("doc_id").alias("component_id"))
    of_class = classes.select("d1", "d2", "id").join(final.select("id", "group_id"), "id").join(least, "group_id").select("d1", "d2", "component_id", "group_id")
    with_words = full.select("doc_id", "n_shingles", "text_key", "d1", "d2").join(of_class, ["d1", "d2"]).select("doc_id", "n_shingles", "component_id", "text_key", "group_id")
    return with_words.unionByName(all_docs.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_key", F.lit(None).cast("long").alias("group_id")))
