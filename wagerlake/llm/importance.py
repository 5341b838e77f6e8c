"""Importance resampling towards a target distribution over hashed word n-grams.

DuckDB runs inside the tasks: SQL unnests the words of a few megabytes of text, windows them into pairs and counts the buckets of a registered
zlib CRC function. The counts of each text are spilled to Parquet in the shared folder; Spark sums them over both corpora,
turns the sums into a gain for each bucket, scores every text from its spilled counts and draws the highest scores.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FOLD, same_rows, staged

#: Number of buckets: what the driver takes of a corpus, and what a task holds of a text, is bounded by it.
BUCKETS = 10_000
#: Bytes of text that one SQL statement counts at once; longer texts are cut at a space.
RUN = 4 << 20
COUNTS = "doc_id long, n_features long, buckets array<int>, counts array<int>"
#: batch(k, carried, text): a carried piece begins with the last word of the piece before, whose own occurrence is counted there.
_SQL = """
WITH w AS (SELECT k, carried, unnest(string_split(text, ' ')) AS w FROM batch),
p AS MATERIALIZED (SELECT k, w, lead(w) OVER () AS after, lead(k) OVER () AS next_k, carried AND lag(k) OVER () IS DISTINCT FROM k AS again FROM w WHERE w <> ''),
g AS (SELECT k, w AS feature FROM p WHERE NOT again UNION ALL SELECT k, w || ' ' || after FROM p WHERE k = next_k),
d AS MATERIALIZED (SELECT feature, crc_bucket(feature) AS b FROM (SELECT DISTINCT feature FROM g))
SELECT k, b, count(*) AS c FROM g JOIN d USING (feature) GROUP BY ALL"""


def _crc_bucket(buckets: int):
    def function(features: pa.Array) -> pa.Array:
        x = features.combine_chunks() if isinstance(features, pa.ChunkedArray) else features
        x = x.cast(pa.large_binary())
        ends = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1].tolist()
        raw = x.buffers()[2].to_pybytes() if x.buffers()[2] is not None else b""
        crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(ends, ends[1:], strict=False)), np.uint32, len(x))
        return pa.array((crc % buckets).astype(np.int32))

    return function


def connection(buckets: int):
    """A DuckDB of one thread that keeps row order, writes no file and knows crc_bucket."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
    con.create_function("crc_bucket", _crc_bucket(buckets), ["VARCHAR"], "INTEGER", type="arrow")
    return con


def pieces(raw: bytes, limit: int = RUN) -> Iterator[tuple[bool, bytes]]:
    """(carried, piece) of a folded text, pieces of about limit bytes; a carried one begins with the last word before it."""
    at, word = 0, b""
    while len(raw) - at > limit:
        cut = raw.rfind(b" ", at, at + limit)
        cut = cut if cut >= at else raw.find(b" ", at + limit)
        if cut < 0:
            break
        part = raw[at:cut]
        yield bool(word), word + b" " + part
        word = part.rstrip(b" ").rpartition(b" ")[2] or word
        at = cut + 1
    yield bool(word), word + b" " + raw[at:]


def _runs(texts: list[str | None], limit: int) -> Iterator[tuple[list[int], list[bool], list[str]]]:
    """(index of the text, carried, piece) of runs of about limit bytes."""
    of, carried, run, size = [], [], [], 0
    for i, t in enumerate(texts):
        for again, part in pieces(t.encode().translate(FOLD) if t else b"", limit):
            if size and size + len(part) > limit:
                yield of, carried, run
                of, carried, run, size = [], [], [], 0
            of.append(i)
            carried.append(again)
            run.append(part.decode())
            size += len(part)
    if of:
        yield of, carried, run


def _rows(ids: list, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    ends = np.concatenate([[0], np.cumsum([len(b) for b, _ in found])]).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([x[k] for x in found]).astype(np.int32))) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([int(c.sum()) for _, c in found], pa.int64()), *lists], names=["doc_id", "n_features", "buckets", "counts"])


def _counted(buckets: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connection(buckets)
        for rows in batches:
            ids, texts = rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()
            held: dict[int, np.ndarray] = {}
            for of, carried, run in _runs(texts, limit):
                batch = pa.table({"k": pa.array(range(len(of)), pa.int32()), "carried": carried, "text": run})
                con.register("batch", batch)
                got = con.sql(_SQL).to_arrow_table()
                con.unregister("batch")
                doc = np.asarray(of)[got["k"].to_numpy()]
                order = np.argsort(doc, kind="stable")
                doc, b, c = doc[order], got["b"].to_numpy()[order], got["c"].to_numpy()[order]
                at = np.searchsorted(doc, [*dict.fromkeys(of), of[-1] + 1])
                for i, lo, hi in zip(dict.fromkeys(of), at, at[1:], strict=False):
                    held[i] = held.get(i, 0) + np.bincount(b[lo:hi], c[lo:hi], buckets).astype(np.int64) if i in held or lo < hi else np.zeros(buckets, np.int64)
                done = [i for i in held if i < of[-1]]
                if done:
                    yield _rows([ids[i] for i in done], [_sparse(held.pop(i)) for i in done])
            if held:
                yield _rows([ids[i] for i in held], [_sparse(x) for x in held.values()])
        con.close()

    return run


def _sparse(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    some = np.flatnonzero(total)
    return some, total[some]


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS, limit: int = RUN) -> DataFrame:
    """Rows of COUNTS: how often each row (doc_id, text) has features of each bucket; one row for each given one."""
    return rows.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_counted(buckets, limit), COUNTS)


def totals(counts: DataFrame) -> dict[int, int]:
    """Features of a corpus by bucket; at most BUCKETS rows come to the driver."""
    each = counts.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy("x.buckets").agg(F.sum("x.counts").alias("n"))
    return {r[0]: r[1] for r in each.collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """floor(1000 ln) of the smoothed target share over the smoothed source share, for each bucket."""
    n, m = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1.0) * n / ((source.get(b, 0) + 1.0) * m))) for b in range(buckets)]


def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS, limit: int = RUN) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row (doc_id, text); target has a column text.

    Features are runs of one and two words, repeats counted. The weight is the floored mean gain of a text's features; the score adds Gumbel noise
    hashed from seed and doc_id, so that the highest scores are a draw without replacement in proportion to exp(weight / 1000).
    floor(percent * N / 100) rows are drawn of the N with at least least_words words and an id; rank counts them from 1, by score descending, then doc_id,
    then n_features descending; rows equal in all that have ranks in any order. Null and empty texts have no feature and weight 0. A null doc_id has a null score
    and is never drawn, but its features count. Repeated rows count each and come back each. An empty table gives none; an empty target leaves
    only the smoothing. Extra columns are ignored.

    Scores are whole numbers between the least gain less 3,200 and the largest gain and 23,000, so their distinct values are bounded whatever the number of rows: places
    are counted by score first, and only rows of one score are ordered inside a task.
    """
    mine = staged(bucket_counts(same_rows(docs, "doc_id", "text"), buckets, limit), "bucket-counts")
    theirs = staged(bucket_counts(same_rows(target, "text").select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets, limit), "bucket-counts")
    gain = F.split(F.lit(",".join(map(str, gains(totals(mine), totals(theirs), buckets)))), ",").cast("array<long>")  # folded to one literal
    summed = F.aggregate(F.zip_with("buckets", "counts", lambda b, c: F.get(gain, b) * c), F.lit(0).cast("long"), lambda a, x: a + x)
    n = F.col("n_features")
    rows = mine.select("doc_id", "n_features", summed.alias("s"))
    rows = rows.withColumn("weight", F.when(n == 0, F.lit(0).cast("long")).otherwise(F.expr("(s - pmod(s, n_features)) div n_features")))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = staged(rows.select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score")), "scores")
    may = (n + 1 >= 2 * least_words) & F.col("score").isNotNull()
    places = rows.where(may).groupBy("score").agg(F.count("*").alias("rows"))
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    places = places.withColumn("before", F.coalesce(F.sum("rows").over(above), F.lit(0))).withColumn("all", F.sum("rows").over(Window.partitionBy()))
    places = places.select("score", "before", F.expr(f"{percent} * all div 100").alias("drawn")).where("before < drawn")
    ranked = rows.withColumn("may", may).join(F.broadcast(places), "score", "left")  # a row a distinct score: bounded, see above
    by = Window.partitionBy("score").orderBy("doc_id", F.desc("n_features"))
    drawn = ranked.where("may and before is not null").withColumn("place", F.col("before") + F.row_number().over(by))
    drawn = drawn.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") <= F.col("drawn"), F.col("place")).alias("rank"))
    rest = ranked.where("not may or before is null").select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return drawn.unionByName(rest)
