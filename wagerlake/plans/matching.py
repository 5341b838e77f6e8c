"""Matching two catalogues: cosine scores within a category, one-to-one assignment, token similarity; intervals."""

from __future__ import annotations

import heapq
import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wagerlake.registry import query
from wagerlake.sources.carriers import table, trades
from wagerlake.sources.shared import checkpointed

c = F.col
#: Classes and components of vectors in a tile, rows compared at a time; open links and members that the driver matches one by one, and links that a task does, in how many parts it cuts ties.
TILE, CELLS, ROWS = 2048, 1 << 17, 256
REST, AHEAD, STEPS = 20_000, 1_000_000, 256


def catalogues(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (side, key, id) of the two catalogues (even and odd ids), and their classes of equal vectors (side, label, key, least, v).

    A vector that is null, empty or has a null or non-finite component is an empty one here: it scores 0, as a zero vector does.
    """
    sound = "embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    v = F.expr(f"CASE WHEN {sound} THEN transform(embedding, x -> cast(x AS double) + 0D) ELSE cast(array() AS array<double>) END")
    rows = e.where("label is not null and vec_id % 2 in (0, 1)").select((c("vec_id") % 2).alias("side"), "label", c("vec_id").alias("id"), v.alias("v"))
    each = checkpointed(rows.groupBy("side", "label", "v").agg(F.min("id").alias("least")).withColumn("key", F.monotonically_increasing_id()))
    return rows.join(each.select("side", "label", "v", "key"), ["side", "label", "v"]).select("side", "key", "id"), each


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rounded scores of all vectors of x with all of y, in double; 0 where the lengths differ or a vector has no length."""
    out = np.zeros((len(x), len(y)))
    nx, ny = (np.fromiter(map(len, z), np.int64, len(z)) for z in (x, y))
    for n in np.intersect1d(nx[nx > 0], ny):
        i, j = np.flatnonzero(nx == n), np.flatnonzero(ny == n)
        a, b = np.stack(x[i]), np.stack(y[j])
        size = np.sqrt(np.einsum("ij,ij->i", a, a))[:, None] * np.sqrt(np.einsum("ij,ij->i", b, b))
        out[np.ix_(i, j)] = np.divide(a @ b.T, size, out=np.zeros_like(size), where=size > 0)
    return np.floor(out * 10_000 + 0.5) / 10_000


def near(x: np.ndarray, y: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """i, j, score of cosines() from least up, some rows at a time."""
    if least <= 0:
        for at in range(0, len(x), ROWS):
            s = cosines(x[at : at + ROWS], y)
            i, j = np.nonzero(s >= least)
            yield at + i, j, s[i, j]
        return
    nx, ny = (np.fromiter(map(len, z), np.int64, len(z)) for z in (x, y))
    for n in np.intersect1d(nx[nx > 0], ny):
        i, j = np.flatnonzero(nx == n), np.flatnonzero(ny == n)
        a, b = np.stack(x[i]), np.stack(y[j])
        la, lb = (np.sqrt(np.einsum("ij,ij->i", z, z)) for z in (a, b))
        for at in range(0, len(i), ROWS):
            size = np.outer(la[at : at + ROWS], lb)
            s = np.divide(a[at : at + ROWS] @ b.T, size, out=np.zeros_like(size), where=True if size.all() else size > 0)
            k, m = np.nonzero(s >= least - 1e-4)
            t = np.floor(s[k, m] * 10_000 + 0.5) / 10_000
            k, m, t = k[t >= least], m[t >= least], t[t >= least]
            yield i[at + k], j[m], t


def best(x: np.ndarray, y: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """i, j, score of each row's best of cosines(), of equal ones that with the smallest of ids, some rows at a time."""
    for at in range(0, len(x), ROWS):
        s = cosines(x[at : at + ROWS], y)
        i = np.arange(len(s))
        j = np.where(s == s.max(axis=1, keepdims=True), ids, np.iinfo(np.int64).max).argmin(axis=1)
        yield at + i, j, s[i, j]


def tiles(each: DataFrame, *columns: str) -> DataFrame:
    """Salted tiles of the classes of side 0 with those of side 1 that share their label, a row a pair of tiles: the columns of both, as arrays, named _a and _b."""
    split = each.groupBy("side", "label").agg(F.count("*").alias("n"), F.ceil(F.greatest(F.count("*") / TILE, F.sum(F.size("v")) / CELLS, F.lit(1))).alias("splits"))
    many = lambda n, k: split.where(c("side") == n).select("label", c("n").alias(f"n{k}"), c("splits").alias(f"s{k}"))
    both = checkpointed(many(0, "a").join(many(1, "b"), "label"))
    pairs, cells = both.agg(F.sum(c("sa") * c("sb")), F.sum(c("na").cast("double") * c("nb"))).first()
    parts = int(max(1, min(pairs or 0, max((pairs or 0) // 64, (cells or 0) // (1 << 20)))))
    tile = lambda k: F.pmod(F.xxhash64("key"), c(f"s{k}")).alias(f"t{k}")

    def side(n: int, k: str, o: str) -> DataFrame:
        rows = each.where(c("side") == n).join(both, "label").groupBy("label", tile(k), f"s{o}").agg(F.collect_list(F.struct(*columns)).alias("x"))
        rows = rows.withColumn(f"t{o}", F.explode(F.sequence(F.lit(0).cast("long"), c(f"s{o}").cast("long") - 1)))
        return rows.select("label", "ta", "tb", *(c(f"x.{m}").alias(f"{m}_{k}") for m in columns)).repartition(parts, "label", "ta", "tb")

    return side(0, "a", "b").hint("merge").join(side(1, "b", "a"), ["label", "ta", "tb"])


def links(each: DataFrame, least: float | None) -> DataFrame:
    """p, q, score of the classes of both sides that share a label, compared in salted tiles: those from least up, or each p's best,
    of equal ones that with the smallest id."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                for i, j, s in best(r.v_a, r.v_b, r.least_b) if least is None else near(r.v_a, r.v_b, least):
                    yield pd.DataFrame({"p": r.key_a[i], "q": r.key_b[j], "score": s, "b": r.least_b[j]})

    return checkpointed(tiles(each, "key", "least", "v").mapInPandas(compare, "p long, q long, score double, b long"))


def pairs_of(e: DataFrame, least: float) -> DataFrame:
    """Scored candidates of two catalogues; the category is the join key, so no cross product is formed."""
    members, each = catalogues(e)
    side = lambda n, k, i: members.where(c("side") == n).select(c("key").alias(k), c("id").alias(i))
    return links(each, least).drop("b").join(side(0, "p", "a"), "p").join(side(1, "q", "b"), "q").select("a", "b", "score")


def pairs(spark: SparkSession, d: str, least: float) -> DataFrame:
    return pairs_of(table(spark, d, "embeddings"), least)


_PAIRS = "SELECT x.vec_id AS a, y.vec_id AS b, floor(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) * 10000 + 0.5) / 10000.0::DOUBLE AS score FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id % 2 = 0 AND y.vec_id % 2 = 1"


@query("M06_J05_P26_scored_pairs", f"SELECT * FROM ({_PAIRS}) WHERE score >= 0.3")
def scored_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d, 0.3)


@query("J08_best_candidate", f"SELECT a, arg_max(b, struct_pack(s := score, b := -b)) AS b, max(score) AS score FROM ({_PAIRS}) GROUP BY a")
def best_candidate(spark: SparkSession, d: str) -> DataFrame:
    return best_of(table(spark, d, "embeddings"))


def best_of(e: DataFrame) -> DataFrame:
    members, each = catalogues(e)
    left = members.where("side = 0").select(c("key").alias("p"), c("id").alias("a"))
    order = F.struct("score", -c("b"))
    best = links(each, None).groupBy("p").agg(F.max_by("b", order).alias("b"), F.max("score").alias("score"))
    return left.join(best, "p").groupBy("a").agg(F.max_by("b", order).alias("b"), F.max("score").alias("score"))


def matched(links: DataFrame, left: DataFrame, right: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Greedy one-to-one assignment (a, b, score) by (score, a, b) between classes whose members have the same scores.

    links (p, q, score) are one row a pair of classes; left (p, a) and right (q, b) have every id once; groups (p, g) parts the classes so that no link of one meets a class of
    another. A class gives its members away in ascending order. By turns, each group's best links are matched one by one in a task (ahead), and a round takes mutual best pairs,
    until no link between open members is left; once links and members are few enough, the driver takes the rest one by one.
    """
    done, tasks = None, True
    if groups is not None:
        links = links.join(groups, "p")
    while True:
        links = checkpointed(links.join(left.select("p").distinct(), "p", "left_semi").join(right.select("q").distinct(), "q", "left_semi"))
        left, right = (checkpointed(x.join(links.select(k).distinct(), k, "left_semi")) for x, k in ((left, "p"), (right, "q")))
        if links.count() + left.count() + right.count() <= REST:
            rows = [x.toPandas() for x in (links.select("p", "q", "score"), left.select("p", "a"), right.select("q", "b"))]
            rest = left.sparkSession.createDataFrame(greedy(*rows), types(left, right))
            return rest if done is None else done.unionByName(rest)
        taken = checkpointed((ahead if tasks else mutual)(links, left, right))
        done = taken if done is None else done.unionByName(taken)
        left, right, tasks = left.join(taken.select("a"), "a", "left_anti"), right.join(taken.select("b"), "b", "left_anti"), not tasks


def types(left: DataFrame, right: DataFrame) -> str:
    return f"a {left.schema['a'].dataType.simpleString()}, b {right.schema['b'].dataType.simpleString()}, score double"


def mutual(links: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """A round: of two classes that are each other's best, the k-th smallest a with the k-th smallest b as long as neither has an equally good class with a smaller member,
    so copies cost no rounds of their own."""
    met = links.select("p", "q", "score").join(left.groupBy("p").agg(F.min("a").alias("a0")), "p").join(right.groupBy("q").agg(F.min("b").alias("b0")), "q")
    for k, head in (("p", "b0"), ("q", "a0")):
        w = Window.partitionBy(k).orderBy(F.desc("score"), head)
        met = met.withColumn(f"r_{k}", F.row_number().over(w)).withColumn(f"end_{k}", F.when(F.lead("score").over(w) == c("score"), F.lead(head).over(w)))
    runs = met.where("r_p = 1 and r_q = 1").select("p", "q", "score", "end_p", "end_q")
    nth = lambda x, k, i: x.withColumn("n", F.row_number().over(Window.partitionBy(k).orderBy(i)))
    taken = nth(left, "p", "a").join(runs, "p").join(nth(right, "q", "b"), ["q", "n"])
    return taken.where("(end_p is null or b < end_p) and (end_q is null or a < end_q)").select("a", "b", "score")


def ahead(links: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """What greedy takes of each group's first links in the order of (score, a, b), as many as a task holds: whole scores as far as they go, else the smallest a of the best score.

    Near copies whose scores are equal are a chain of as many rounds as pairs, and no round here. A group with too many members to its first links is left to the rounds.
    """
    links = links.withColumn("g", c("g") if "g" in links.columns else F.lit(0)).withColumn("bin", F.floor(c("score") * 10_000))
    bins = links.groupBy("g", "bin").agg(F.count("*").alias("n"), (F.min("score") == F.max("score")).alias("one"))
    falling = Window.partitionBy("g").orderBy(F.desc("bin"))
    bins = bins.withColumn("upto", F.sum("n").over(falling)).withColumn("r", F.row_number().over(falling))
    top = lambda x: F.max(F.when(c("r") == 1, c(x))).alias(x)
    cut = checkpointed(bins.where((c("r") == 1) | (c("upto") <= AHEAD)).groupBy("g").agg(F.min("bin").alias("from"), top("n"), top("one")).where(c("one") | (c("n") <= AHEAD)))
    first = checkpointed(links.join(cut, "g").where("bin >= from").select("g", "p", "q", "score", "n"))
    # Of a best score that is too much for a task, the links of the smallest a; a group without such a part waits for a round.
    heads = first.where(c("n") > AHEAD).join(left.groupBy("p").agg(F.min("a").alias("a0")), "p")
    over = heads.groupBy("g", "n").agg(F.percentile_approx("a0", [k / STEPS for k in range(1, STEPS)], 100 * STEPS).alias("at"))
    until = checkpointed(over.select("g", F.when(c("n") <= STEPS * AHEAD, F.get("at", F.floor(F.lit(STEPS * AHEAD) / c("n")).cast("int") - 1)).alias("until")))
    first = first.join(until, "g", "left").where((c("n") <= AHEAD) | c("until").isNotNull())
    mine = first.select("g", "p", "until").distinct().join(left, "p").where("until is null or a < until").select("g", F.lit(0).alias("side"), c("p").alias("k"), c("a").alias("i"))
    other = first.join(mine.select(c("k").alias("p")).distinct(), "p", "left_semi").select("g", "q").distinct().join(right, "q").select("g", F.lit(1).alias("side"), c("q").alias("k"), c("b").alias("i"))
    members = checkpointed(mine.unionByName(other))
    small = members.groupBy("g").agg(F.count("*").alias("m")).where(c("m") <= 2 * AHEAD).select("g")
    pick = first.join(small, "g", "left_semi").join(members.where("side = 0").select(c("k").alias("p")).distinct(), "p", "left_semi").select("g", "p", "q", "score")

    def one_by_one(x: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        side = lambda n, k, i: m[m["side"] == n][["k", "i"]].set_axis([k, i], axis=1)
        return pd.DataFrame(greedy(x[["p", "q", "score"]], side(0, "p", "a"), side(1, "q", "b")), columns=["a", "b", "score"])

    return pick.groupBy("g").cogroup(members.join(small, "g", "left_semi").groupBy("g")).applyInPandas(one_by_one, types(left, right))


def greedy(links: pd.DataFrame, left: pd.DataFrame, right: pd.DataFrame) -> list[tuple]:
    """matched() one by one, in memory."""
    a_of, b_of = defaultdict(list), defaultdict(list)
    for of, rows in ((a_of, left), (b_of, right)):
        for k, x in zip(*(rows[n].tolist() for n in rows.columns)):
            of[k].append(x)
    for ids in (*a_of.values(), *b_of.values()):
        ids.sort(reverse=True)
    out = []
    rows = links.sort_values("score", ascending=False)
    for score, level in itertools.groupby(zip(rows["score"].tolist(), rows["p"].tolist(), rows["q"].tolist()), lambda r: r[0]):
        to = defaultdict(list)
        for _, p, q in level:
            to[p].append(q)
        heads = [(a_of[p][-1], p) for p in to if a_of[p]]
        heapq.heapify(heads)
        while heads:
            a, p = heapq.heappop(heads)
            some = [q for q in to[p] if b_of[q]]
            if not some:
                continue
            out.append((a_of[p].pop(), b_of[min(some, key=lambda q: b_of[q][-1])].pop(), score))
            if a_of[p]:
                heapq.heappush(heads, (a_of[p][-1], p))
    return out


def assigned(scored: DataFrame) -> DataFrame:
    """matched() for pairs (a, b, score), every id a class of its own."""
    one = scored.groupBy(c("a").alias("p"), c("b").alias("q")).agg(F.max(c("score").cast("double")).alias("score"))
    return matched(checkpointed(one), scored.select(c("a").alias("p"), "a").distinct(), scored.select(c("b").alias("q"), "b").distinct())


@query("J07_greedy_assignment", None)
def greedy_assignment(spark: SparkSession, d: str) -> DataFrame:
    return assigned_of(table(spark, d, "embeddings"), 0.3)


def assigned_of(e: DataFrame, least: float) -> DataFrame:
    """Greedy assignment of two catalogues; ids with the same vectors (one, but for repeated ids) are one class."""
    members, each = catalogues(e)
    ids = members.groupBy("side", "id").agg(F.array_sort(F.collect_set("key")).alias("keys")).withColumn("node", F.concat_ws(",", c("keys").cast("array<string>")))
    ids = checkpointed(ids)
    nodes = ids.select("side", "node", "keys").distinct().select("side", "node", F.explode("keys").alias("key"))
    side = lambda n, x, i: nodes.where(c("side") == n).select(c("node").alias(x), c("key").alias(i))
    met = links(each, least).select(c("p").alias("i"), c("q").alias("j"), "score").join(side(0, "p", "i"), "i").join(side(1, "q", "j"), "j").groupBy("p", "q").agg(F.max("score").alias("score"))
    own = lambda n, x, i: ids.where(c("side") == n).select(c("node").alias(x), c("id").alias(i))
    return matched(met, own(0, "p", "a"), own(1, "q", "b"))


@query("J23_merge_groups", f"SELECT a, b, max(score) AS score FROM (SELECT * FROM ({_PAIRS}) WHERE score >= 0.4 UNION ALL SELECT a, b, score + 0.01::DOUBLE FROM ({_PAIRS}) WHERE score >= 0.4 AND b % 3 = 0) GROUP BY a, b")
def merge_groups(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d, 0.4)
    more = p.where("b % 3 = 0").withColumn("score", c("score") + 0.01)
    return p.unionByName(more).groupBy("a", "b").agg(F.max("score").alias("score"))


_TOK = "SELECT p_partkey AS market, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS t FROM part"


@query("F22_J21_similar_markets", f"""WITH u AS (SELECT market, len(t) AS n, unnest(t) AS w FROM ({_TOK})), m AS (SELECT x.market, y.market AS other, count(*) AS k, any_value(x.n) AS nx, any_value(y.n) AS ny FROM u x JOIN u y ON x.w = y.w AND x.market <> y.market GROUP BY 1, 2)
SELECT market, other, score FROM (SELECT market, other, floor(k / (nx + ny - k) * 10000 + 0.5) / 10000.0::DOUBLE AS score, row_number() OVER (PARTITION BY market ORDER BY floor(k / (nx + ny - k) * 10000 + 0.5) DESC, other) AS r FROM m) WHERE r <= 3 AND score >= 0.12""")
def similar_markets(spark: SparkSession, d: str, least: float = 0.12, top: int = 3, asked: Column | None = None) -> DataFrame:
    """The nearest markets by Jaccard of title tokens, of all markets or those that asked says. Markets with equal token sets are one
    side of the comparison, so the join on tokens meets distinct titles, not markets."""
    tok = table(spark, d, "part").select(c("p_partkey").alias("market"), F.array_sort(F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " "))).alias("t"))
    first = tok.withColumn("r", F.row_number().over(Window.partitionBy("t").orderBy("market"))).where(c("r") <= top + 1)
    mine = tok if asked is None else tok.where(asked)
    inverted = lambda df, k: df.select("t").distinct().select(c("t").alias(k), F.explode("t").alias("w"))
    met = inverted(mine, "x").join(inverted(tok, "y"), "w").groupBy("x", "y").agg(F.count("*").alias("both"))
    score = F.floor(c("both") / (F.size("x") + F.size("y") - c("both")) * 10_000 + 0.5) / F.lit(10_000.0)
    near = met.select("x", "y", score.alias("score")).where(c("score") >= least)
    each = near.join(first.select(c("t").alias("y"), c("market").alias("other")), "y")
    best = each.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("score"), "other"))).where(c("r") <= top + 1).select("x", "score", "other")
    out = mine.withColumnRenamed("t", "x").join(best, "x").where("market <> other")
    return out.withColumn("r", F.row_number().over(Window.partitionBy("market").orderBy(F.desc("score"), "other"))).where(c("r") <= top).select("market", "other", "score")


@query("M05_token_adjustment", "SELECT p_partkey AS market, least(1, greatest((p_size % 50) / 50.0::DOUBLE + CASE WHEN p_name LIKE '%ring%' THEN 0.15::DOUBLE ELSE 0 END, CASE WHEN p_name LIKE '%ring%' THEN 0.75::DOUBLE ELSE 0 END)) AS adjusted FROM part")
def token_adjustment(spark: SparkSession, d: str) -> DataFrame:
    raw, shared = c("p_size") % 50 / F.lit(50.0), c("p_name").contains("ring")
    return table(spark, d, "part").select(c("p_partkey").alias("market"), F.least(F.lit(1.0), F.greatest(raw + F.when(shared, 0.15).otherwise(0.0), F.when(shared, 0.75).otherwise(0.0))).alias("adjusted"))


@query("F05_F06_title_tokens", "SELECT p_partkey AS market, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS title, list_distinct(regexp_extract_all(p_brand, '[0-9]+')) AS numbers FROM part")
def title_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(c("p_partkey").alias("market"), F.trim(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", " ")).alias("title"), F.array_distinct(F.regexp_extract_all("p_brand", F.lit("([0-9]+)"))).alias("numbers"))


@query("F01_F04_category", "SELECT p_partkey AS market, CASE WHEN regexp_matches(lower(p_name), 'ring|bolt') THEN 'hardware' WHEN regexp_matches(lower(p_name), 'widget|gear') THEN 'machine' ELSE 'other' END AS category FROM part")
def category(spark: SparkSession, d: str) -> DataFrame:
    """First matching pattern of an ordered list; the lexicon is a parameter, here one for part names."""
    return table(spark, d, "part").select(c("p_partkey").alias("market"), lexicon(F.lower("p_name"), {"hardware": "ring|bolt", "machine": "widget|gear"}).alias("category"))


def lexicon(text: Column, patterns: dict[str, str], other: str = "other") -> Column:
    return F.coalesce(*(F.when(text.rlike(p), name) for name, p in patterns.items()), F.lit(other))


_ISL = "SELECT condition, min(a) AS a, max(b) AS b FROM (SELECT *, sum(fresh::INT) OVER (PARTITION BY condition ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, coalesce(a > max(b) OVER (PARTITION BY condition ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, true) AS fresh FROM (SELECT condition, ts // 86400 AS a, ts // 86400 + shares AS b FROM v_trades))) GROUP BY condition, g"


def islands(r: DataFrame, key: str) -> DataFrame:
    """Closed ranges [a, b] of a key, overlapping or adjacent ones joined."""
    order = Window.partitionBy(key).orderBy("a", "b")
    fresh = F.coalesce(c("a") > F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True)).cast("int")
    g = r.withColumn("fresh", fresh).withColumn("g", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy(key, "g").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("g")


def ranges(spark: SparkSession, d: str) -> DataFrame:
    day = F.floor(c("ts") / 86400)
    return islands(trades(spark, d).select("condition", day.alias("a"), (day + c("shares")).alias("b")), "condition")


@query("J19_range_islands", _ISL)
def range_islands(spark: SparkSession, d: str) -> DataFrame:
    return ranges(spark, d)


@query("J20_resume_plan", f"SELECT condition, 4001 AS requested, sum(greatest(least(b, 13000) - greatest(a, 9000) + 1, 0))::BIGINT AS reused, (4001 - sum(greatest(least(b, 13000) - greatest(a, 9000) + 1, 0)))::BIGINT AS to_fetch FROM ({_ISL}) GROUP BY condition")
def resume_plan(spark: SparkSession, d: str, first: int = 9000, last: int = 13000) -> DataFrame:
    covered = F.sum(F.greatest(F.least("b", F.lit(last)) - F.greatest("a", F.lit(first)) + 1, F.lit(0)))
    n = last - first + 1
    return ranges(spark, d).groupBy("condition").agg(F.lit(n).alias("requested"), covered.alias("reused"), (n - covered).alias("to_fetch"))


@query("J22_live_backfill", "SELECT k, coalesce(live, cents) AS cents, live IS NOT NULL AS is_live FROM (SELECT k, cents FROM v_trades WHERE cents % 5 <> 1) FULL JOIN (SELECT k, cents + 1 AS live FROM v_trades WHERE cents % 3 = 0) USING (k)")
def live_backfill(spark: SparkSession, d: str) -> DataFrame:
    t = trades(spark, d)
    live = t.where("cents % 3 = 0").select("k", (c("cents") + 1).alias("live"))
    return t.where("cents % 5 <> 1").select("k", "cents").join(live, "k", "full").select("k", F.coalesce("live", "cents").alias("cents"), c("live").isNotNull().alias("is_live"))
