"""Near-duplicate vectors by tiled comparison over PCA-ordered dimensions.

Equal vectors are first one class. The second-moment matrix of the unit vectors (d x d, whatever the number of vectors) gives an
orthogonal basis in order of variance. Vectors are laid out in tiles by their first two coordinates; two tiles whose boxes
over the leading coordinates are too far apart are never brought together. Inside a pair of tiles the leading products
are summed first; the rest of a product is at most the product of the suffix norms, so most pairs stop there.
Tiles meet in rounds, in which each moves once or twice whatever their number, and a round's shuffle files go with it: disk grows with the vectors, not with the pairs of tiles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staging, same_rows, staged, staged_rounds
from .components import components

#: Vectors of a tile; leading coordinates of a tile's box and of the first products.
TILE, BOX, HEAD = 4096, 8, 16
#: Slack for rounding when a bound is held against the threshold.
SLACK = 1e-9
#: Bytes of vectors that a task takes of either side, and bytes that a round moves even where that is more than each tile once on either side.
GROUP, ROUND = 4 << 20, 128 << 20


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector by the power of two that brings its largest component to 0.5 or more, below 1: exact, and no square leaves the range of doubles."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = scaled(vectors)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Vectors as bytes, of floats where these are exact, of doubles where not (w bytes a component), with a digest; null ones stay null."""
    for batch in batches:
        out = []
        for v in batch["v"]:
            if v is None:
                out.append((0, 0, None, None))
                continue
            x = np.asarray(v, np.float64)
            with np.errstate(over="ignore"):
                y = x.astype(np.float32)
            x = y if (y == x).all() else x
            out.append((len(x), x.itemsize, x.tobytes(), hashlib.sha256(bytes([x.itemsize]) + x.tobytes()).digest()))
        yield pd.DataFrame(out, columns=["d", "w", "v", "digest"]).assign(vec_id=batch["vec_id"].to_numpy())


def packed(rows: DataFrame) -> DataFrame:
    """vec_id, d, w, v, digest of rows (vec_id, v array<double>): d components of w bytes each."""
    return rows.mapInPandas(_packed, "vec_id long, d int, w int, v binary, digest binary")


def _vectors(v: bytes, d: int, w: int) -> np.ndarray:
    return np.frombuffer(v, np.float32 if w == 4 else np.float64).reshape(-1, d).astype(np.float64)


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for (d, w), part in batch.groupby(["d", "w"]):
            u = _unit(_vectors(b"".join(part["v"]), d, w))
            total[d] = total.get(d, 0) + u.T @ u
    if total:
        yield pd.DataFrame({"d": list(total), "m": [m.ravel() for m in total.values()]})


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for d, m in zip(batch["d"], batch["m"], strict=True):
            total[d] = total.get(d, 0) + m
    if total:
        yield pd.DataFrame({"d": list(total), "m": list(total.values())})


def bases(vectors: DataFrame) -> dict[int, np.ndarray]:
    """An orthogonal basis in order of variance for each dimension, from vectors v as arrays or packed (d, w, v); matrices are summed in two steps, so the driver sees one d x d matrix a dimension."""
    if "w" not in vectors.columns:
        vectors = packed(vectors.select(F.lit(0).cast("long").alias("vec_id"), "v"))
    found = vectors.select("d", "w", "v").mapInPandas(_moments, "d int, m array<double>")
    for tasks in (max(1, round(vectors.sparkSession.sparkContext.defaultParallelism ** 0.5)), 1):
        found = found.repartition(tasks).mapInPandas(_summed, "d int, m array<double>")
    out: dict[int, np.ndarray] = {}
    for d, m in found.toPandas().itertuples(index=False):
        m = np.asarray(m).reshape(d, d)
        out[int(d)] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1]
        if not np.isfinite(out[int(d)]).all():
            raise ValueError(f"no basis for dimension {d}")
    return out


def _group_pair(basis: dict[int, np.ndarray], threshold: float):
    """Compares the tiles of two groups: each of left with its mates of right."""

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        of, hits = {r.t: r for r in right.itertuples()}, [pd.DataFrame({"rep": [], "n": [], "least": []}, dtype=np.int64)]
        for x in left.itertuples():
            a, ia, na = _vectors(x.v, x.d, x.w), np.frombuffer(x.i, np.int64), np.frombuffer(x.n, np.int64)
            for y in map(of.get, x.mates):
                ib, nb = np.frombuffer(y.i, np.int64), np.frombuffer(y.n, np.int64)
                i, j = linked(a, _vectors(y.v, y.d, y.w), basis[x.d], threshold, x.t == y.t)
                n, ids = np.zeros(len(ia) + len(ib), np.int64), np.concatenate([ia, ib])
                np.add.at(n, i, nb[j])
                np.add.at(n, len(ia) + j, na[i])
                label = _labels(i, len(ia) + j, len(ids), ids)
                some = np.flatnonzero(n)
                hits.append(pd.DataFrame({"rep": ids[some], "n": n[some], "least": label[some]}))
        return pd.concat(hits)

    return compare


def _rounds(tiles: DataFrame, boxes: DataFrame, groups: int, steps: int, compare, schema: str) -> Iterator[DataFrame]:
    """What compare makes of all boxes (a, b, pairs of tiles), by rounds. Tiles are dealt to groups in a ring; in a step a group meets the one that lies so many places further, so each tile
    moves once as left and once as right."""
    ga, gb = (F.pmod(F.xxhash64(k), F.lit(groups)) for k in "ab")
    far = F.pmod(gb - ga, F.lit(groups))
    turn = (2 * far > groups) | ((2 * far == groups) & (ga > gb))
    way = lambda x, y: F.when(turn, x).otherwise(y)
    met = staged(boxes.select(way(F.col("b"), F.col("a")).alias("l"), way(F.col("a"), F.col("b")).alias("r"), way(gb, ga).alias("g"), F.least(far, groups - far).alias("step")), "met")
    there = sorted(r.step for r in met.select("step").distinct().collect())
    for at in range(0, len(there), steps):
        some = there[at : at + steps]
        part = met.where(F.col("step").isin(some))
        left = tiles.join(F.broadcast(part.groupBy(F.col("l").alias("t"), "g", "step").agg(F.collect_list("r").alias("mates"))), "t")
        right = tiles.join(F.broadcast(part.select(F.col("r").alias("t"), "g", "step").distinct()), "t")
        right = right.select(*(F.col(x).alias(x) for x in right.columns))  # columns of its own, else Spark can't tell the sides apart
        by = lambda df: df.repartition(2 * groups * len(some), "g", "step").groupBy("g", "step")
        yield by(left).cogroup(by(right)).applyInPandas(compare, schema)


def _labels(i: np.ndarray, j: np.ndarray, n: int, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each of n nodes reaches over links (i, j)."""
    label = ids.copy()
    while len(i):
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        if (label == before).all():
            break
    return label


def linked(a: np.ndarray, b: np.ndarray, basis: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all pairs with cosine >= threshold; of one tile with itself only i < j."""
    a, b = scaled(a), scaled(b)
    ua, ub = _unit(a), _unit(b)
    pa, pb = ua @ basis, ub @ basis
    h = min(HEAD, a.shape[1])
    ra, rb = (np.sqrt(np.maximum(0, np.einsum("ij,ij->i", p[:, h:], p[:, h:]))) for p in (pa, pb))
    left, right = [], []
    for k in range(0, len(a), 512):
        head = pa[k : k + 512, :h] @ pb[:, :h].T
        head += ra[k : k + 512, None] * rb
        i, j = np.nonzero(head >= threshold - SLACK)
        if same:
            up = i + k < j
            i, j = i[up], j[up]
        for m in range(0, len(i), 1 << 16):
            x, y = i[m : m + (1 << 16)] + k, j[m : m + (1 << 16)]
            part = np.einsum("ij,ij->i", pa[x, :h], pb[y, :h])
            for c in range(h, a.shape[1], h):
                sa, sb = (np.sqrt(np.einsum("ij,ij->i", p, p)) for p in (pa[x, c:], pb[y, c:]))
                on = part + sa * sb >= threshold - SLACK
                x, y, part = x[on], y[on], part[on]
                part = part + np.einsum("ij,ij->i", pa[x, c : c + h], pb[y, c : c + h])
            sure = np.einsum("ij,ij->i", a[x], b[y]) / np.sqrt(np.einsum("ij,ij->i", a[x], a[x]) * np.einsum("ij,ij->i", b[y], b[y])) >= threshold
            left.append(x[sure])
            right.append(y[sure])
    none = np.zeros(0, np.int64)
    return (np.concatenate(left) if left else none), (np.concatenate(right) if right else none)


def _coordinates(basis: dict[int, np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (d, w), part in batch.groupby(["d", "w"]):
                yield part.assign(c=list(_unit(_vectors(b"".join(part["v"]), d, w)) @ basis[d][:, :BOX]))

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id for rows (vec_id, embedding array of float or double), by cosine >= threshold in double precision.

    Null vectors, zero ones and such with null or non-finite components link with nothing; vectors of different lengths don't
    either. Vectors of any finite magnitude are compared alike. Equal vectors are linked. Rows that repeat a vec_id count each as a vector and come back each; a null vec_id has no row; extra columns are
    ignored; an empty table, or one without a sound vector, gives no links. The query compares all pairs of classes of equal vectors: work is quadratic in them but for what boxes and
    bounds cut off, every task holds two groups of tiles, and a tile pair answers with a row for each linked vector at most. Staged tables go as soon as nothing needs them.
    """
    spark = vectors.sparkSession
    rows = same_rows(vectors, "vec_id", "embedding").where("vec_id is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.expr("v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    flat = F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
    rows = rows.withColumn("v", F.when(F.coalesce(sound, F.lit(False)), flat))
    with Staging() as whole:
        every = staged(packed(rows), "vectors")
        classes = staged(every.where("v is not null").groupBy("digest", "d", "w", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
        basis = bases(classes)
    rows, keys = staged(every.select("vec_id", "digest"), "ids"), staged(classes.select("digest", "rep", "copies"), "keys")
    with Staging() as laid:
        placed = classes.select("rep", "copies", "d", "w", "v").mapInPandas(_coordinates(basis), "rep long, copies long, d int, w int, v binary, c array<double>")
        placed = staged(placed, "placed")
    whole.drop(spark)
    found, size = placed.agg(F.count("*"), F.coalesce(F.sum(F.length("v")), F.lit(0))).first()
    parts = max(1, round((found / tile) ** 0.5))
    cuts = placed.agg(*(F.percentile_approx(F.get("c", F.lit(k)), [x / parts for x in range(1, parts)] or [0.5], 10_000).alias(f"q{k}") for k in (0, 1))).first()
    spot = lambda k: F.size(F.filter(F.array(*map(F.lit, cuts[k] or [0.0])), lambda q: q < F.get("c", F.lit(k))))
    celled = placed.withColumn("cell", F.concat_ws(",", "d", "w", spot(0), F.coalesce(spot(1), F.lit(0))))
    split = celled.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("splits"))
    tiles = celled.join(split, "cell").withColumn("tile", F.concat_ws(":", "cell", F.pmod(F.xxhash64("rep"), F.col("splits"))))

    def gathered(pdf: pd.DataFrame) -> pd.DataFrame:
        c = np.stack(pdf["c"].to_numpy())
        blob = lambda k: pdf[k].to_numpy(np.int64).tobytes()
        return pd.DataFrame([(pdf["tile"].iloc[0], int(pdf["d"].iloc[0]), int(pdf["w"].iloc[0]), blob("rep"), blob("copies"), b"".join(pdf["v"]), c.min(axis=0), c.max(axis=0))], columns=["t", "d", "w", "i", "n", "v", "lo", "hi"])

    with Staging() as tiled:
        tiles = staged(tiles.groupBy("tile").applyInPandas(gathered, "t string, d int, w int, i binary, n binary, v binary, lo array<double>, hi array<double>"), "tiles")
    laid.drop(spark)
    # unit vectors with cosine >= threshold are at most reach apart in every coordinate: tiles meet in the cells of such a grid, not all in one key
    reach = max((2 - 2 * threshold) ** 0.5, 0.05)

    def gridded(df: DataFrame, lo: str, hi: str, more: int) -> DataFrame:
        for k in (0, 1):
            at = lambda c, k=k: F.floor(F.coalesce(F.get(c, F.lit(k)), F.lit(0.0)) / reach)
            df = df.withColumn(f"g{k}", F.explode(F.sequence(at(lo) - more, at(hi) + more)))
        return df

    side = lambda k, *more: [F.col("t").alias(k), *(F.col(x).alias(x + k) for x in more)]
    gap = F.expr("aggregate(zip_with(zip_with(loa, hib, (p, q) -> greatest(p - q, 0D)), zip_with(lob, hia, (p, q) -> greatest(p - q, 0D)), (p, q) -> greatest(p, q)), 0D, (s, x) -> s + x * x)")
    left, right = gridded(tiles.select("d", *side("a", "lo", "hi")), "loa", "hia", 0), gridded(tiles.select("d", *side("b", "lo", "hi")), "lob", "hib", 1)
    boxes = left.join(right, ["d", "g0", "g1"]).where((F.col("a") <= F.col("b")) & (gap <= 2 - 2 * threshold + SLACK)).select("d", "a", "b").distinct()
    groups = max(1, min(tiles.count(), max(-(-size // GROUP), 2 * spark.sparkContext.defaultParallelism)))
    body = tiles.select("t", "d", "w", "i", "n", "v")
    schema, steps = "rep long, n long, least long", max(1, ROUND // (2 * size + 1))
    hits = staged_rounds(_rounds(body, boxes, groups, steps, _group_pair(basis, threshold), schema), "hits", spark, schema)
    tiled.drop(spark)
    groups = components(hits.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    counts = hits.groupBy("rep").agg(F.sum("n").alias("others"))
    known = keys.join(counts, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("digest", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    sure = rows.where("digest is not null").join(known, "digest").select("vec_id", "n_links", "component_id")
    return sure.unionByName(rows.where("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
