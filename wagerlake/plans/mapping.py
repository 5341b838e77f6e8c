"""Mapping two catalogues of markets: cosines raised by shared tokens, one-to-one in rounds of falling thresholds, merged with pairs known from their structure."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wagerlake.plans.matching import matched, near, tiles
from wagerlake.plans.reports import BOOST, BY_TOKENS, COINS, LEAGUES, MACRO, by_tokens
from wagerlake.registry import query
from wagerlake.sources.carriers import table
from wagerlake.sources.shared import checkpointed

c = F.col
#: Thresholds of the rounds, the last one for broad coverage.
ROUNDS = (0.75, 0.62, 0.55, 0.52)
#: Half of the last decimal of a score.
HALF = 5e-5


def classes(markets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (side, key, id) of markets (side, id, label, v, words, numbers, period), and their classes: equal in all but the id."""
    of = ["side", "label", "v", "words", "numbers", "period"]
    rows = markets.where("label is not null").select("id", *(F.array_sort(c(x)).alias(x) if x in ("words", "numbers") else c(x) for x in of))
    rows = rows.withColumn("digest", F.sha2(F.to_json(F.struct(*of)), 256))
    each = checkpointed(rows.groupBy("digest").agg(F.min("id").alias("least"), *(F.first(x).alias(x) for x in of)).withColumn("key", F.monotonically_increasing_id()))
    return rows.join(each.select("digest", "key"), "digest").select("side", "key", "id"), each


def shared(x: np.ndarray, y: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of i and j: the codes, a row a pair, of x[i] that stand in y[j] too, 0 where one doesn't."""

    def table_of(z: np.ndarray) -> np.ndarray:
        out = np.zeros((len(z), max(1, max(map(len, z)))), np.int64)
        for k, codes in enumerate(z):
            out[k, : len(codes)] = codes
        return out

    a, b = table_of(x), table_of(y)

    def of(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        u, v = a[i], b[j]
        return np.where(np.logical_or.reduce([u == v[:, [n]] for n in range(v.shape[1])]), u, 0)

    return of


def certain(words: np.ndarray, numbers: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Whether tokens alone pair two markets in by_tokens, from the codes that they share."""
    kind = lambda n: ((words != 0) & (words & 7 == n)).sum(axis=1)
    k, n, teams, cup = (words != 0).sum(axis=1), (numbers != 0).any(axis=1), kind(1), kind(2)
    return ((teams >= 2) & (n | (cup > 0))) | ((cup + kind(3) + teams >= 2) & n) | (same & n & (k >= 1))


def reach(raw: np.ndarray, words: np.ndarray, numbers: np.ndarray, same: np.ndarray) -> np.ndarray:
    """At least what by_tokens makes of raw, from codes that two markets share: the most of the steps that hold, not the first."""
    kind = lambda n: ((words != 0) & (words & 7 == n)).sum(axis=1)
    k, teams, coins, macro = (words != 0).sum(axis=1), kind(1), kind(4), kind(5)
    leagues, sure = kind(2) + kind(3), certain(words, numbers, same)
    most = raw + BOOST * np.select([(coins > 0) & (raw >= 0.55), ((leagues > 0) | (teams >= 2)) & (raw >= 0.52) | (macro > 0) & (raw >= 0.6), k >= 2], [1, 0.75, 0.5], 0)
    return np.where(sure, np.maximum(raw + BOOST, BY_TOKENS), most)


def coded(each: DataFrame) -> DataFrame:
    """Classes with codes for their tokens. Equal tokens have equal codes, never 0; the last three bits of a word's code are its kind. No vector is an empty one."""
    kind = lambda w: F.when(w.startswith("team:"), 1).when(w == "world_cup", 2).when(w.isin(*LEAGUES), 3).when(w.isin(*COINS), 4).when(w.isin(*MACRO), 5).otherwise(6)
    codes = lambda x, f: F.coalesce(F.transform(x, f), F.array().cast("array<long>")).alias(x)
    word = lambda w: F.shiftleft(F.xxhash64(w), 3).bitwiseOR(kind(w).cast("long"))
    period = F.when(c("period").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("period").bitwiseOR(F.lit(1).cast("long"))).alias("period")
    v = F.coalesce("v", F.array().cast("array<double>")).alias("v")
    return each.select("side", "label", "key", v, codes("words", word), codes("numbers", lambda x: F.xxhash64(x).bitwiseOR(F.lit(1).cast("long"))), period)


def scored(each: DataFrame, least: float, flat: bool = False) -> DataFrame:
    """p, q, raw, score, method of the classes of both sides that share a label, from least up after what their tokens add.

    All classes of a label are compared, in tiles, so pairs are exact and work is quadratic in the classes of a label. Pairs whose cosine is more than the largest boost below least can
    only be those that tokens alone pair, at BY_TOKENS whatever their cosine: they are not here. With flat none that score just BY_TOKENS by that rule are (by_words has them all).
    A tile's pairs leave it only if tokens can raise them to least: codes of tokens are compared there, and by_tokens has the last word on those few.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                words, numbers = shared(r.words_a, r.words_b), shared(r.numbers_a, r.numbers_b)
                for i, j, raw in near(r.v_a, r.v_b, least - BOOST):
                    same = (r.period_a[i] == r.period_b[j]) & (r.period_a[i] != 0)
                    w, n = words(i, j), numbers(i, j)
                    ok = reach(raw, w, n, same) >= least - 1e-4
                    if flat:
                        ok &= (raw > BY_TOKENS - BOOST + HALF) | ~certain(w, n, same)
                    yield pd.DataFrame({"p": r.key_a[i[ok]], "q": r.key_b[j[ok]], "raw": raw[ok]})

    met = tiles(coded(each), "key", "v", "words", "numbers", "period").mapInPandas(compare, "p long, q long, raw double")
    side = lambda n, k: each.where(c("side") == n).select(c("key").alias(k), *(c(x).alias(f"{x}_{k}") for x in ("words", "numbers", "period")))
    met = checkpointed(met).join(side(0, "p"), "p").join(side(1, "q"), "q")
    said = by_tokens(c("raw"), F.array_intersect("numbers_p", "numbers_q"), F.array_intersect("words_p", "words_q"), F.coalesce(c("period_p") == c("period_q"), F.lit(False)))
    return met.withColumn("s", said).select("p", "q", "raw", F.floor(c("s.adjusted") * 10_000 + 0.5).alias("score") / 10_000, c("s.method").alias("method")).toDF("p", "q", "raw", "score", "method").where(c("score") >= least)


def by_words(each: DataFrame) -> DataFrame:
    """s, t of the classes of equal tokens (side, label, key, words, numbers, period) of both sides that share a label and that tokens alone pair."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                words, numbers, j = shared(r.words_a, r.words_b), shared(r.numbers_a, r.numbers_b), np.arange(len(r.key_b))
                for at in range(len(r.key_a)):
                    i = np.full(len(j), at)
                    ok = certain(words(i, j), numbers(i, j), (r.period_a[i] == r.period_b) & (r.period_a[i] != 0))
                    yield pd.DataFrame({"s": r.key_a[i[ok]], "t": r.key_b[ok]})

    each = each.withColumn("v", F.array().cast("array<double>"))
    return checkpointed(tiles(coded(each), "key", "words", "numbers", "period").mapInPandas(compare, "s long, t long"))


def in_turn(pairs: DataFrame, each: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """matched() of pairs (all but those that tokens alone pair at BY_TOKENS) and of these, which are far too many to write down one by one.

    First go the pairs above BY_TOKENS. Of what they leave open, each two markets that tokens alone pair score just BY_TOKENS, so markets with equal tokens are one class; those with another pair of just that score are
    their own, as they have links that the others don't. Then follow the pairs below.
    """
    of = ["side", "label", "words", "numbers", "period"]
    each = each.withColumn("digest", F.sha2(F.to_json(F.struct(*of)), 256))
    tokens = checkpointed(each.groupBy("digest").agg(*(F.first(x).alias(x) for x in of)).withColumn("key", F.monotonically_increasing_id()))
    token = each.join(tokens.select("digest", c("key").alias("t")), "digest").select("key", "label", "t")
    groups = each.select(c("key").alias("p"), c("label").alias("g"))
    links = lambda where: pairs.where(where).select("p", "q", "score")
    rest = lambda taken: (left.join(taken.select("a"), "a", "left_anti"), right.join(taken.select("b"), "b", "left_anti"))

    first = checkpointed(matched(links(c("score") > BY_TOKENS + HALF), left, right, groups))
    left, right = map(checkpointed, rest(first))
    even = links(F.abs(c("score") - BY_TOKENS) <= HALF).join(left.select("p").distinct(), "p", "left_semi").join(right.select("q").distinct(), "q", "left_semi")
    even = checkpointed(even)

    def nodes(members: DataFrame, k: str) -> DataFrame:
        own = even.select(k).distinct().withColumn("own", c(k) * 2)
        return checkpointed(members.join(token.withColumnRenamed("key", k), k).join(own, k, "left").withColumn("node", F.coalesce("own", c("t") * 2 + 1)))

    p, q = nodes(left, "p"), nodes(right, "q")
    node = lambda x, k, t: x.select(c("node").alias(k), c("t").alias(t)).distinct()
    met = by_words(tokens).join(node(p, "p", "s"), "s").join(node(q, "q", "t"), "t").select("p", "q", F.lit(BY_TOKENS).alias("score"))
    met = met.unionByName(even.select(c("p") * 2, c("q") * 2, F.lit(BY_TOKENS)).toDF("p", "q", "score"))
    second = checkpointed(matched(met, p.select(c("node").alias("p"), "a"), q.select(c("node").alias("q"), "b"), p.select(c("node").alias("p"), c("label").alias("g")).distinct()))
    return first.unionByName(second).unionByName(matched(links(c("score") < BY_TOKENS - HALF), *rest(second), groups))


def mapped(markets: DataFrame, structural: DataFrame | None = None, rounds: tuple[float, ...] = ROUNDS, fallback: bool = True, whole: bool = False) -> DataFrame:
    """a, b, score, method, round of markets of side 0 (a) and side 1 (b).

    Pairs are taken one-to-one by falling score. What a lower round finds is what it finds among those that higher rounds left, so one pass down to the last threshold is all
    rounds; round is the first threshold that a pair meets, null for pairs that only structural (a, b, score) knows. Without fallback only the first round is held.
    Of a pair that both know the higher score counts. Empty catalogues give the structural pairs alone. With whole, as in the query, tokens pair two markets whatever their cosine;
    without it, those whose cosine is more than the largest boost below the last threshold are left to the structural pairs.
    """
    least = rounds[-1] if fallback else rounds[0]
    members, each = classes(markets)
    flat = whole and least <= BY_TOKENS
    pairs = checkpointed(scored(each, least, flat))
    side = lambda n, k, i: members.where(c("side") == n).select(c("key").alias(k), c("id").alias(i))
    left, right = side(0, "p", "a"), side(1, "q", "b")
    if flat:
        taken = checkpointed(in_turn(pairs, each, left, right))
    else:
        taken = matched(pairs.select("p", "q", "score"), left, right, each.where("side = 0").select(c("key").alias("p"), c("label").alias("g")))
    how = pairs.select("p", "q", "method").join(left, "p").join(taken.select("a", "b"), "a").join(right, ["q", "b"]).select("a", "b", "method")
    first = F.coalesce(*(F.when(c("score") >= t, F.lit(t)) for t in rounds))
    out = taken.join(how, ["a", "b"], "left").select("a", "b", "score", F.coalesce("method", F.lit("token_heuristic")).alias("method"), first.alias("round"))
    if structural is None:
        return out
    known = structural.groupBy("a", "b").agg(F.max("score").alias("known"))
    both = out.join(known, ["a", "b"], "full")
    up = c("score").isNull() | (c("known") > c("score"))
    return both.select("a", "b", F.when(up, c("known")).otherwise(c("score")).alias("score"), F.when(up, "deterministic").otherwise(c("method")).alias("method"), "round")


@query("C02_market_mapping")
def market_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Mapping of the even and the odd vectors, with words and numbers beside them, and every 50th pair of neighbours known from its structure."""
    i = c("vec_id")
    half = F.floor(i / 2).cast("long")
    words = F.array(F.concat(F.lit("w"), half % 3), F.concat(F.lit("x"), half % 2), F.when(half % 5 == 0, "btc").otherwise("fed"))
    m = table(spark, d, "embeddings").select((i % 2).alias("side"), i.alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"), words.alias("words"), F.array(half % 7).alias("numbers"), (half % 4).alias("period"))
    known = table(spark, d, "embeddings").where(i % 100 == 0).select(i.alias("a"), (i + 1).alias("b"), F.lit(0.9).alias("score"))
    return mapped(m, known, whole=True)
