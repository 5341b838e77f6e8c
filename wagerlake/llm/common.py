"""Helpers that the corpus operators share: table access, staged tables and packed text in numpy."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into numpy arrays at once.
BLOCK = 2 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z in lower case, the bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ as they are, all else a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

_MASK = (1 << 64) - 1
_ODD = 0x9E3779B97F4A7C15 | 1
_INV = pow(_ODD, -1, 1 << 64)
_power = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)
_LETTER = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir, or wagerlake.shared.dir where a session has none; executors read no other."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("wagerlake.shared.dir", "")
    if not found and spark.sparkContext.master.startswith("local"):
        found = f"{spark.conf.get('spark.sql.warehouse.dir')}/wagerlake-shared"  # one machine has it, so every task can read it
    if not found:
        raise ValueError("set spark.checkpoint.dir (or wagerlake.shared.dir) to a folder that all executors share")
    return found.rstrip("/")


#: Paths that staged() has written, by the innermost Staging that was open.
_open: list[Staging] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Staging:
    """The tables that are staged inside a with block; drop() deletes these and no others, once nothing that reads them is needed."""

    def __init__(self):
        self.paths: list[str] = []

    def __enter__(self) -> Staging:
        _open.append(self)
        return self

    def __exit__(self, *_) -> None:
        _open.remove(self)

    def drop(self, spark: SparkSession) -> None:
        while self.paths:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Spark drops a query's shuffle files when the query ends, not when the driver happens to collect its plan."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table in the shared folder and read again: lineage ends here, and any executor may be lost later."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].paths.append(path)
    with _tidy(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_rounds(dfs: Iterable[DataFrame], name: str, spark: SparkSession, schema: str) -> DataFrame:
    """All of dfs, one after the other, as one staged table; each one's shuffle files go before the next begins. It needs no rows, nor any df."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].paths.append(path)
    with _tidy(spark):
        spark.createDataFrame([], schema).write.parquet(path)
        for df in dfs:
            df.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64 for i < n, as far as any block has needed them."""
    global _power, _inverse
    if len(_power) < n:
        steps = np.full((2, n), [[_ODD], [_INV]], np.uint64)
        steps[:, 0] = 1
        _power, _inverse = np.cumprod(steps, axis=1, dtype=np.uint64)
    return _power, _inverse


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Sums whose differences give the rolling hash of any substring, see spans_hash."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_LETTER[buf] * powers(len(buf) + 1)[0][: len(buf)], out=out[1:], dtype=np.uint64)
    return out


def spans_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end]; equal bytes give equal hashes wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64))


def blocks(texts: Sequence[str | None], limit: int = BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, UTF-8 texts) of runs of texts with about limit bytes; null is the empty text."""
    first, run, size = 0, [], 0
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        if run and size + len(raw) > limit:
            yield first, run
            first, run, size = i, [], 0
        run.append(raw)
        size += len(raw)
    if run:
        yield first, run


_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end]: mixed from length and bytes up to 16 bytes, xxh3 of the bytes beyond."""
    n = end - start
    padded = np.concatenate([buf, np.zeros(16, np.uint8)])
    eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    lo, hi = eight[start] & _FIRST[np.minimum(n, 8)], eight[start + 8] & _FIRST[np.clip(n - 8, 0, 8)]
    out = mix(mix(mix(lo + np.uint64(_ODD)) + hi) + n.astype(np.uint64))
    for i in np.flatnonzero(n > 16):
        out[i] = xxhash.xxh3_64_intdigest(buf[start[i] : end[i]].tobytes())
    return out


class Words:
    """Words [^\\x20\\x09-\\x0D]+ of a run of texts: byte spans, hashes and where each text's words begin."""

    def __init__(self, raws: list[bytes], lower: bool = False):
        self.buf = buf = np.frombuffer(b"\n".join([*raws, b""]), np.uint8)
        if lower:
            self.buf = buf = buf + ((buf >= 65) & (buf <= 90)) * np.uint8(32)
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        self.ends = np.cumsum(sizes + 1) - 1
        self.begins = self.ends - sizes
        space = SPACE[buf]
        before = np.concatenate([[True], space[:-1]])
        self.start = np.flatnonzero(before & ~space)
        self.end = np.flatnonzero(~before & space) if len(buf) else self.start
        self.bounds = np.searchsorted(self.start, np.concatenate([self.begins, [len(buf)]]))
        self.hash = word_hashes(buf, self.start, self.end)


def runs_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n neighbours in h, for every start; len(h) - n + 1 of them."""
    m = max(0, len(h) - n + 1)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out += h[i : i + m] * np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64))
    return mix(out + np.uint64(n))


def same_rows(df: DataFrame, *names: str) -> DataFrame:
    """The columns an operator reads, missing ones as typed nulls; clashing extra columns stay behind."""
    return df.select(*names) if set(names) <= set(df.columns) else df.select(*(F.col(x) if x in df.columns else F.lit(None).alias(x) for x in names))
