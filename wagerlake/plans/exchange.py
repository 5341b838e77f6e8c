"""Prices across venues: which fair line to trust, what a trade is worth against it, boxes of two venues, and scores of trades and traders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wagerlake.functions import prices as P
from wagerlake.registry import query
from wagerlake.sources.carriers import games, positions, table, trades

c = F.col
#: Widest spread of a live line, seconds that a quote stays fresh, most that a box may cost, EV percent of a synthetic arbitrage.
SPREAD, FRESH, BOX, SYNTHETIC = 0.05, 60, 0.98, 2.0
VENUES = {"kalshi": "k", "polymarket": "p", "manifold": "m"}


def mid(v: str) -> Column:
    """Middle of a venue's book (bid, ask, age in columns vb, va, vg); null without both prices."""
    return F.when((c(f"{v}b") > 0) & (c(f"{v}a") > 0), (c(f"{v}b") + c(f"{v}a")) / 2)


def liveness(fair: str, own: str) -> Column:
    """ok, fair_line_stale or in_play for a fair book: before the start a narrow spread is enough, later both books must be fresh and agree."""
    tight = lambda v: F.coalesce(c(f"{v}a") - c(f"{v}b") <= SPREAD, F.lit(False))
    fresh = lambda v: tight(v) & F.coalesce(c(f"{v}g") <= FRESH, F.lit(False))
    before = F.coalesce(c("starts_in") > 0, c("days_off") > 0)
    apart = F.coalesce(F.abs(mid(own) - mid(fair)) > 2 * SPREAD, F.lit(False))
    return (
        F.when(mid(fair).isNull(), "fair_line_stale").when(before, F.when(tight(fair), "ok").otherwise("fair_line_stale"))
        .when(~(fresh(fair) & fresh(own)) | apart, "in_play").otherwise("ok")
    )


def standing(fair: str, own: str) -> Column:
    """What speaks for or against a book as the fair line; null where there is no book. Manifold needs a middle inside (0, 1)."""
    there = c(f"{fair}b").isNotNull() | c(f"{fair}a").isNotNull()
    sound = mid(fair).isNotNull() & (mid(fair) > 0) & (mid(fair) < 1) if fair == "m" else mid(fair).isNotNull()
    return F.when(there, F.when(sound, liveness(fair, own)).otherwise("fair_line_stale"))


def cross_market(g: DataFrame, source: Column, paid: Column) -> DataFrame:
    """g with fair_source, fair_prob, price_paid, ev (percent, one decimal) and reason: the other venue first, then manifold."""

    def by(own: str, other: str) -> Column:
        a, b = standing(other, own), standing("m", own)
        name = next(n for n, v in VENUES.items() if v == other)
        pick = F.when(a == "ok", F.struct(F.lit(name).alias("source"), mid(other).alias("mid"), F.lit("ok").alias("reason")))
        pick = pick.when(b == "ok", F.struct(F.lit("manifold").alias("source"), mid("m").alias("mid"), F.lit("ok").alias("reason")))
        return pick.otherwise(F.struct(F.lit(None).cast("string").alias("source"), F.lit(None).cast("double").alias("mid"), F.coalesce(b, a, F.lit("no_match")).alias("reason")))

    g = g.withColumn("pick", F.when(source == "polymarket", by("p", "k")).otherwise(by("k", "p")))
    g = g.withColumn("price", F.when(paid > 0, paid).otherwise(F.when(source == "polymarket", mid("p")).otherwise(mid("k"))))
    known = c("price") > 0
    ok = F.coalesce(known & (c("pick.reason") == "ok"), F.lit(False))
    return g.select(
        "*", F.when(ok, c("pick.source")).alias("fair_source"), F.when(ok, P.half_up(c("pick.mid"), 2)).alias("fair_prob"), P.half_up(c("price"), 2).alias("price_paid"),
        F.when(ok, P.half_up((c("pick.mid") - c("price")) / c("price") * 100, 1)).alias("ev"), F.when(F.coalesce(known, F.lit(False)), c("pick.reason")).otherwise("missing_price").alias("reason"),
    ).drop("pick", "price")


def _mid(v: str) -> str:
    return f"CASE WHEN {v}b > 0 AND {v}a > 0 THEN ({v}b + {v}a) / 2 END"


def _live(f: str, o: str) -> str:
    fresh = "coalesce({0}a - {0}b <= 0.05 AND {0}g <= 60, false)"
    return f"""CASE WHEN {_mid(f)} IS NULL THEN 'fair_line_stale' WHEN coalesce(starts_in > 0, days_off > 0) THEN CASE WHEN {f}a - {f}b <= 0.05 THEN 'ok' ELSE 'fair_line_stale' END
 WHEN NOT ({fresh.format(f)} AND {fresh.format(o)}) OR coalesce(abs(({_mid(o)}) - ({_mid(f)})) > 0.1, false) THEN 'in_play' ELSE 'ok' END"""


def _stands(f: str, o: str) -> str:
    more = f" AND ({_mid(f)}) > 0 AND ({_mid(f)}) < 1" if f == "m" else ""
    return f"CASE WHEN {f}b IS NOT NULL OR {f}a IS NOT NULL THEN CASE WHEN ({_mid(f)}) IS NOT NULL{more} THEN {_live(f, o)} ELSE 'fair_line_stale' END END"


def _cross(source: str, paid: str) -> str:
    own = f"CASE WHEN {source} = 'polymarket' THEN {{}} ELSE {{}} END"
    return f"""SELECT * EXCLUDE (a, b, other, price), CASE WHEN ok THEN fair END AS fair_source, CASE WHEN ok THEN floor(fm * 100 + 0.5) / 100 END AS fair_prob, floor(price * 100 + 0.5) / 100 AS price_paid,
 CASE WHEN ok THEN floor((fm - price) / price * 100 * 10 + 0.5) / 10 END AS ev, CASE WHEN coalesce(price > 0, false) THEN CASE WHEN a = 'ok' OR b = 'ok' THEN 'ok' ELSE coalesce(b, a, 'no_match') END ELSE 'missing_price' END AS reason FROM (
 SELECT *, CASE WHEN a = 'ok' THEN other WHEN b = 'ok' THEN 'manifold' END AS fair, CASE WHEN a = 'ok' THEN om WHEN b = 'ok' THEN {_mid("m")} END AS fm, coalesce(price > 0 AND (coalesce(a = 'ok', false) OR coalesce(b = 'ok', false)), false) AS ok FROM (
 SELECT *, {own.format(_stands("k", "p"), _stands("p", "k"))} AS a, {own.format(_stands("m", "p"), _stands("m", "k"))} AS b, {own.format("'kalshi'", "'polymarket'")} AS other, {own.format(_mid("k"), _mid("p"))} AS om,
 CASE WHEN {paid} > 0 THEN {paid} ELSE {own.format(_mid("p"), _mid("k"))} END AS price FROM v_games))"""


@query("M13_liveness", f"SELECT market, {_live('k', 'p')} AS of_kalshi, {_live('p', 'k')} AS of_polymarket, {_live('m', 'p')} AS of_manifold FROM v_games")
def liveness_of_books(spark: SparkSession, d: str) -> DataFrame:
    return games(spark, d).select("market", liveness("k", "p").alias("of_kalshi"), liveness("p", "k").alias("of_polymarket"), liveness("m", "p").alias("of_manifold"))


@query("M14_M15_C03_cross_market_ev", f"SELECT market, fair_source, fair_prob, price_paid, ev, reason FROM ({_cross('source', 'paid')})")
def cross_market_ev(spark: SparkSession, d: str) -> DataFrame:
    return cross_market(games(spark, d), c("source"), c("paid")).select("market", "fair_source", "fair_prob", "price_paid", "ev", "reason")


@query("M46_synthetic_arbitrage", f"""SELECT market, pm_ev, k_ev, best, coalesce(best > 2, false) AS qualifies, CASE WHEN pmid IS NULL OR kmid IS NULL THEN 'missing_price' WHEN best IS NULL THEN 'no_match' WHEN best > 2 THEN 'ok' ELSE 'below_threshold' END AS reason FROM (
 SELECT x.market, x.ev AS pm_ev, y.ev AS k_ev, CASE WHEN pmid IS NOT NULL AND kmid IS NOT NULL THEN greatest(CASE WHEN x.ev > 0 THEN x.ev END, CASE WHEN y.ev > 0 THEN y.ev END) END AS best, pmid, kmid
 FROM (SELECT market, ev, {_mid("p")} AS pmid, {_mid("k")} AS kmid FROM ({_cross("'polymarket'", "NULL::DOUBLE")})) x JOIN (SELECT market, ev FROM ({_cross("'kalshi'", "NULL::DOUBLE")})) y USING (market))""")
def synthetic_arbitrage(spark: SparkSession, d: str) -> DataFrame:
    """The better of buying on either venue at its middle against the other's line."""
    g, none = games(spark, d), F.lit(None).cast("double")
    names = ["fair_source", "fair_prob", "price_paid", "reason"]
    both = cross_market(g, F.lit("polymarket"), none).withColumnRenamed("ev", "pm_ev").drop(*names)
    both = cross_market(both, F.lit("kalshi"), none).withColumnRenamed("ev", "k_ev").drop(*names)
    priced = mid("p").isNotNull() & mid("k").isNotNull()
    best = F.when(priced, F.greatest(F.when(c("pm_ev") > 0, c("pm_ev")), F.when(c("k_ev") > 0, c("k_ev"))))
    reason = F.when(~priced, "missing_price").when(c("best").isNull(), "no_match").when(c("best") > SYNTHETIC, "ok").otherwise("below_threshold")
    return both.withColumn("best", best).select("market", "pm_ev", "k_ev", "best", F.coalesce(c("best") > SYNTHETIC, F.lit(False)).alias("qualifies"), reason.alias("reason"))


@query("J12_outcome_index", """SELECT game, outcome, k.b AS kalshi, p.b AS polymarket FROM (SELECT n_nationkey AS game, o AS outcome FROM nation, (SELECT unnest(['team_a', 'team_b', 'draw']) AS o))
 LEFT JOIN (SELECT c_nationkey AS game, (['team_a', 'team_b', 'draw'])[c_custkey % 3 + 1] AS outcome, min(c_custkey) AS b FROM customer WHERE c_custkey % 5 = 0 GROUP BY ALL) k USING (game, outcome)
 LEFT JOIN (SELECT s_nationkey AS game, (['team_a', 'team_b', 'draw'])[s_suppkey % 3 + 1] AS outcome, min(s_suppkey) AS b FROM supplier GROUP BY ALL) p USING (game, outcome) WHERE k.b IS NOT NULL OR p.b IS NOT NULL""")
def outcome_index(spark: SparkSession, d: str) -> DataFrame:
    """Every game with its three outcomes, the books that two venues have for each; outcomes without any go."""
    three = F.array(*map(F.lit, ("team_a", "team_b", "draw")))
    index = table(spark, d, "nation").select(c("n_nationkey").alias("game"), F.explode(three).alias("outcome"))
    venue = lambda name, key, nation, to, where="true": table(spark, d, name).where(where).groupBy(c(nation).alias("game"), F.get(three, (c(key) % 3).cast("int")).alias("outcome")).agg(F.min(key).alias(to))
    k, p = venue("customer", "c_custkey", "c_nationkey", "kalshi", "c_custkey % 5 = 0"), venue("supplier", "s_suppkey", "s_nationkey", "polymarket")
    return index.join(k, ["game", "outcome"], "left").join(p, ["game", "outcome"], "left").where("kalshi is not null or polymarket is not null")


_BOX = "SELECT market, 'pm_yes_kalshi_no' AS strategy, pa + (1 - kb) AS cost FROM v_games WHERE market % 6 <> 0 UNION ALL SELECT market, 'kalshi_yes_pm_no', ka + (1 - pb) FROM v_games WHERE market % 6 <> 0"


@query("M24_J13_pair_arbitrage", f"SELECT market, strategy, floor(cost * 1e6 + 0.5) / 1e6 AS cost, floor((1 - cost) * 1e6 + 0.5) / 1e6 AS profit FROM ({_BOX}) WHERE cost < 0.98")
def pair_arbitrage(spark: SparkSession, d: str, most: float = BOX) -> DataFrame:
    """YES on one venue and NO on the other for less than a payout; NO's ask is what its YES bid leaves. Inverted mappings have none."""
    box = lambda name, yes, no: F.struct(F.lit(name).alias("strategy"), (c(yes) + (1 - c(no))).alias("cost"))
    both = games(spark, d).where("market % 6 <> 0").select("market", F.inline(F.array(box("pm_yes_kalshi_no", "pa", "kb"), box("kalshi_yes_pm_no", "ka", "pb"))))
    return both.where(c("cost") < most).select("market", "strategy", P.half_up(c("cost"), 6).alias("cost"), P.half_up(1 - c("cost"), 6).alias("profit"))


@query("M44_consensus_asks", "SELECT market, kb AS yes_bid, ka AS yes_ask, floor((1 - ka) * 10000 + 0.5) / 10000 AS no_ask FROM v_games")
def consensus_asks(spark: SparkSession, d: str) -> DataFrame:
    return games(spark, d).select("market", c("kb").alias("yes_bid"), c("ka").alias("yes_ask"), P.half_up(1 - c("ka"), 4).alias("no_ask"))


@query("A32_cross_market_stats", f"""WITH e AS (SELECT market, ev, fair_source FROM ({_cross('source', 'paid')})), t AS (SELECT wallet, ev, fair_source FROM v_trades JOIN e ON condition = market),
 n AS (SELECT wallet, fair_source, count(*) AS n FROM t WHERE fair_source IS NOT NULL GROUP BY ALL), m AS (SELECT wallet, arg_min(fair_source, struct_pack(n := -n, s := fair_source)) AS main FROM n GROUP BY wallet)
SELECT wallet, count(*) AS evaluated, count(ev) AS valid, floor(sum((ev * 10)::BIGINT)::DOUBLE / count(ev) * 10 + 0.5) / 100 AS avg_ev, any_value(main) AS main FROM t LEFT JOIN m USING (wallet) GROUP BY wallet""")
def cross_market_stats(spark: SparkSession, d: str) -> DataFrame:
    """A wallet's mean edge over fair lines, and the venue that most of them come from (of equal ones the first by name)."""
    e = cross_market(games(spark, d), c("source"), c("paid")).select(c("market").alias("condition"), "ev", "fair_source")
    per = trades(spark, d).select("wallet", "condition").join(e, "condition").groupBy("wallet", "fair_source").agg(F.count("*").alias("n"), F.count("ev").alias("valid"), F.sum(F.round(c("ev") * 10).cast("long")).alias("tenths"))
    main = F.min_by("fair_source", F.when(c("fair_source").isNotNull(), F.struct((-c("n")).alias("n"), "fair_source")))
    out = per.groupBy("wallet").agg(F.sum("n").alias("evaluated"), F.sum("valid").alias("valid"), F.sum("tenths").alias("tenths"), main.alias("main"))
    return out.select("wallet", "evaluated", "valid", (F.floor(c("tenths").cast("double") / F.nullif("valid", F.lit(0)) * 10 + 0.5) / 100).alias("avg_ev"), "main")


@query("M27_clv_with_fallback", """SELECT market, CASE WHEN closing IS NOT NULL AND paid > 0 THEN floor((closing - paid) / paid * 1e6 + 0.5) / 1e6 WHEN roi IS NOT NULL THEN CASE WHEN abs(roi) <= 1 THEN roi ELSE roi / 100 END
 WHEN avg_ev IS NOT NULL THEN CASE WHEN abs(avg_ev) <= 1 THEN avg_ev ELSE avg_ev / 100 END END AS clv FROM (SELECT market, paid, CASE WHEN market % 3 = 0 THEN kb END AS closing, CASE WHEN market % 4 = 1 THEN (market % 50 - 25) / 10.0::DOUBLE END AS roi, CASE WHEN market % 4 = 2 THEN (market % 30) / 20.0::DOUBLE END AS avg_ev FROM v_games)""")
def clv_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Closing-line value of a trade; without a closing price the wallet's ROI or else its mean EV, percentages as shares."""
    m = c("market")
    share = lambda x: F.when(F.abs(x) <= 1, x).otherwise(x / 100)
    closing, roi, ev = F.when(m % 3 == 0, c("kb")), F.when(m % 4 == 1, (m % 50 - 25) / F.lit(10.0)), F.when(m % 4 == 2, (m % 30) / F.lit(20.0))
    own = F.when(closing.isNotNull() & (c("paid") > 0), P.half_up((closing - c("paid")) / c("paid"), 6))
    return games(spark, d).select("market", F.coalesce(own, share(roi), share(ev)).alias("clv"))


#: Coefficients of Acklam's rational approximation of the inverse normal distribution (published 2003), and its lower break point.
INV_A = (-39.6968302866538, 220.946098424521, -275.928510446969, 138.357751867269, -30.6647980661472, 2.50662827745924)
INV_B = (-54.4760987982241, 161.585836858041, -155.698979859887, 66.8013118877193, -13.2806815528857, 1.0)
INV_C = (-7.78489400243029e-3, -0.322396458077136, -2.40075827716184, -2.54973253934373, 4.37466414146497, 2.93816398269878)
INV_D = (7.78469570904146e-3, 0.32246712907004, 2.445134137143, 3.75440866190742, 1.0)
INV_LOW = 0.02425


def clamped(p: Column) -> Column:
    return F.greatest(F.lit(0.001), F.least(F.lit(0.999), p))


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for a in coefficients[1:]:
        out = out * x + a
    return out


def normal_inverse(p: Column) -> Column:
    """Quantile of the normal distribution for p held to 0.001 and 0.999."""
    p = clamped(p)
    tail = lambda q: _horner(INV_C, q) / _horner(INV_D, q)
    q = p - 0.5
    return F.when(p < INV_LOW, tail(F.sqrt(-2 * F.log(p)))).when(p > 1 - INV_LOW, -tail(F.sqrt(-2 * F.log(1 - p)))).otherwise(_horner(INV_A, q * q) * q / _horner(INV_B, q * q))


def _sql_horner(coefficients: tuple[float, ...], x: str) -> str:
    out = f"({coefficients[0]!r})::DOUBLE"
    for a in coefficients[1:]:
        out = f"({out} * {x} + ({a!r})::DOUBLE)"
    return out


def _sql_inverse(p: str) -> str:
    p = f"greatest(0.001::DOUBLE, least(0.999::DOUBLE, {p}))"
    tail = lambda q: f"{_sql_horner(INV_C, q)} / {_sql_horner(INV_D, q)}"
    low, high, q = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))", f"({p} - 0.5::DOUBLE)"
    return f"CASE WHEN {p} < 0.02425::DOUBLE THEN {tail(low)} WHEN {p} > 1 - 0.02425::DOUBLE THEN -({tail(high)}) ELSE {_sql_horner(INV_A, f'({q} * {q})')} * {q} / {_sql_horner(INV_B, f'({q} * {q})')} END"


@query("M38_normal_inverse", f"SELECT market, floor(({_sql_inverse('(market % 1001) / 1000.0::DOUBLE')}) * 1e6 + 0.5) / 1e6 AS z FROM v_games")
def normal_inverse_of(spark: SparkSession, d: str) -> DataFrame:
    return games(spark, d).select("market", P.half_up(normal_inverse((c("market") % 1001) / F.lit(1000.0)), 6).alias("z"))


def tail_probability(p: Column, above: Column, primary: Column, strike: Column, usd: Column, volatility: Column, asks_above: Column) -> Column:
    """Chance that a price ends beyond strike, from that of a primary strike: log distance for money, plain distance in percent otherwise."""
    shift = F.when(usd & (primary > 0) & (strike > 0), F.log(strike / primary) / volatility).otherwise((strike - primary) / (volatility * 100))
    z = normal_inverse(F.when(above, p).otherwise(1 - p)) - shift
    return clamped(P.normal_cdf(F.when(asks_above == above, z).otherwise(-z)))


def _sql_cdf(x: str) -> str:
    t = f"(1 / (1 + 0.2316419::DOUBLE * abs({x})))"
    tail = f"0.3989423::DOUBLE * exp(-({x}) * ({x}) / 2) * {t} * (0.3193815::DOUBLE + {t} * (-0.3565638::DOUBLE + {t} * (1.781478::DOUBLE + {t} * (-1.821256::DOUBLE + {t} * 1.330274::DOUBLE))))"
    return f"CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END"


@query("M39_tail_probability", f"""SELECT market, floor(greatest(0.001::DOUBLE, least(0.999::DOUBLE, {_sql_cdf("(CASE WHEN asks = above THEN z ELSE -z END)")})) * 1e5 + 0.5) / 1e5 AS p FROM (SELECT market, above, asks, ({_sql_inverse("CASE WHEN above THEN p ELSE 1 - p END")})
 - CASE WHEN usd THEN ln(strike / prim) / 0.25::DOUBLE ELSE (strike - prim) / (0.25::DOUBLE * 100) END AS z FROM (SELECT market, (market * 29 % 97 + 2) / 100.0::DOUBLE AS p, market % 2 = 0 AS above, market % 3 = 0 AS asks, market % 5 <> 0 AS usd, (market % 90 + 50)::DOUBLE AS prim, (market % 70 + 60)::DOUBLE AS strike FROM v_games))""")
def tail_probabilities(spark: SparkSession, d: str) -> DataFrame:
    m = c("market")
    p = tail_probability((m * 29 % 97 + 2) / F.lit(100.0), m % 2 == 0, (m % 90 + 50).cast("double"), (m % 70 + 60).cast("double"), m % 5 != 0, F.lit(0.25), m % 3 == 0)
    return games(spark, d).select("market", P.half_up(p, 5).alias("p"))


@query("M37_exact_score", """SELECT market, CASE WHEN market % 9 <> 0 THEN floor(greatest(0.001::DOUBLE, least(0.999::DOUBLE, exp(-la) * pow(la, a) / factorial(a) * exp(-lb) * pow(lb, b) / factorial(b))) * 1e6 + 0.5) / 1e6 END AS p FROM (
 SELECT *, 2.6::DOUBLE * share AS la, 2.6::DOUBLE * (1 - share) AS lb FROM (SELECT market, (market % 4)::INT AS a, (market % 3)::INT AS b, (pa / greatest(pa + pb, 0.001::DOUBLE)) AS share FROM v_games))""")
def exact_score(spark: SparkSession, d: str, goals: float = 2.6) -> DataFrame:
    """Chance of a score a to b: two Poisson counts whose means share the goals by the teams' chances to win."""
    share = c("pa") / F.greatest(c("pa") + c("pb"), F.lit(0.001))
    pmf = lambda k, mean: F.exp(-mean) * F.pow(mean, k) / F.factorial(k)
    a, b = (c("market") % 4).cast("int"), (c("market") % 3).cast("int")
    p = clamped(pmf(a, goals * share) * pmf(b, goals * (1 - share)))
    return games(spark, d).select("market", F.when(c("market") % 9 != 0, P.half_up(p, 6)).alias("p"))


#: Words of a high-profile title.
PROFILE = ("president", "election", "fed", "bitcoin", "world cup")


def whale_score(size: Column, price: Column, side: Column, title: Column) -> Column:
    """Points for stake, conviction, direction and profile of a trade."""
    points = F.when(size >= 10_000, 40).when(size >= 5000, 30).when(size >= 1000, 20).otherwise(10)
    points += F.when((price > 0.85) | (price < 0.15), 20).when((price > 0.4) & (price < 0.6), 10).otherwise(0)
    return points + F.when(side == "BUY", 20).otherwise(5) + F.when(F.lower(title).rlike("|".join(PROFILE)), 20).otherwise(10)


def _bands(score: Column) -> Column:
    return F.when(score >= 80, "Strong Follow Signal").when(score >= 60, "Worth Watching").when(score >= 40, "Proceed with Caution").otherwise("Low Signal")


@query("M48_whale_score", """SELECT k, score, CASE WHEN score >= 80 THEN 'Strong Follow Signal' WHEN score >= 60 THEN 'Worth Watching' WHEN score >= 40 THEN 'Proceed with Caution' ELSE 'Low Signal' END AS verdict FROM (
 SELECT k, CASE WHEN cash * 5 >= 10000 THEN 40 WHEN cash * 5 >= 5000 THEN 30 WHEN cash * 5 >= 1000 THEN 20 ELSE 10 END + CASE WHEN cents / 100 > 0.85 OR cents / 100 < 0.15 THEN 20 WHEN cents / 100 > 0.4 AND cents / 100 < 0.6 THEN 10 ELSE 0 END
 + CASE WHEN side = 'BUY' THEN 20 ELSE 5 END + CASE WHEN condition % 4 = 0 THEN 20 ELSE 10 END AS score FROM v_trades)""")
def whale_scores(spark: SparkSession, d: str) -> DataFrame:
    title = F.when(c("condition") % 4 == 0, "World Cup winner").otherwise("Rain in May")
    score = whale_score(c("cash") * 5, c("cents") / 100, c("side"), title)
    return trades(spark, d).select("k", score.alias("score"), _bands(score).alias("verdict"))


def copy_verdict(signals: Column) -> Column:
    """Verdict over an array of signals that are true, false or null."""
    good, bad = F.size(F.filter(signals, lambda s: s)), F.size(F.filter(signals, lambda s: ~s))
    return F.when((good >= 3) & (bad == 0), "Strong Copy Signal").when((good >= 2) & (bad <= 1), "Worth Considering").when(bad >= 2, "Proceed With Caution").otherwise("Weak Signal")


@query("M49_copy_verdict", "SELECT market, CASE WHEN good >= 3 AND bad = 0 THEN 'Strong Copy Signal' WHEN good >= 2 AND bad <= 1 THEN 'Worth Considering' WHEN bad >= 2 THEN 'Proceed With Caution' ELSE 'Weak Signal' END AS verdict FROM (SELECT market, len(list_filter(s, lambda x: x)) AS good, len(list_filter(s, lambda x: NOT x)) AS bad FROM (SELECT market, [CASE WHEN market % 3 > 0 THEN market % 3 = 1 END, CASE WHEN market % 5 > 1 THEN market % 5 < 4 END, CASE WHEN market % 7 > 2 THEN market % 7 < 6 END, market % 11 > 4] AS s FROM v_games))")
def copy_verdicts(spark: SparkSession, d: str) -> DataFrame:
    m = c("market")
    signals = F.array(F.when(m % 3 > 0, m % 3 == 1), F.when(m % 5 > 1, m % 5 < 4), F.when(m % 7 > 2, m % 7 < 6), m % 11 > 4)
    return games(spark, d).select("market", copy_verdict(signals).alias("verdict"))


def _score(x: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), F.floor(x + 0.5))).cast("long")


@query("M52_edge_score", """SELECT wallet, source, ev, least(100, greatest(0, floor(CASE source WHEN 'pipeline' THEN 55 + ev * 2 + CASE WHEN ev > 0 THEN 20 ELSE 0 END WHEN 'estimated' THEN 40 + ev * 3 + CASE WHEN roi > 0 THEN 15 ELSE 0 END END + 0.5)))::BIGINT AS score FROM (
 SELECT wallet, roi, CASE WHEN wallet % 3 = 0 THEN 'pipeline' WHEN roi IS NULL THEN 'unavailable' ELSE 'estimated' END AS source, CASE WHEN wallet % 3 = 0 THEN floor((wallet % 41 - 20) / 100.0::DOUBLE * 1000 + 0.5) / 10 ELSE floor(roi * 0.15::DOUBLE * 10 + 0.5) / 10 END AS ev FROM (
 SELECT wallet, sum(CASE WHEN status <> 'OPEN' THEN realized END)::DOUBLE / nullif(sum(CASE WHEN status <> 'OPEN' THEN bought END), 0) * 100 AS roi FROM v_positions GROUP BY wallet))""")
def edge_score(spark: SparkSession, d: str) -> DataFrame:
    """A wallet's strategy EV and score: from the pipeline's mean EV where there is one, else estimated from the ROI of closed positions."""
    closed = lambda x: F.sum(F.when(c("status") != "OPEN", c(x)))
    per = positions(spark, d).groupBy("wallet").agg((closed("realized").cast("double") / F.nullif(closed("bought"), F.lit(0)) * 100).alias("roi"))
    piped = c("wallet") % 3 == 0
    source = F.when(piped, "pipeline").when(c("roi").isNull(), "unavailable").otherwise("estimated")
    ev = F.when(piped, F.floor((c("wallet") % 41 - 20) / F.lit(100.0) * 1000 + 0.5) / 10).otherwise(P.half_up(c("roi") * 0.15, 1))
    x = per.select("wallet", "roi", source.alias("source"), ev.alias("ev"))
    return x.select("wallet", "source", "ev", _score(F.when(c("source") == "pipeline", 55 + c("ev") * 2 + F.when(c("ev") > 0, 20).otherwise(0)).when(c("source") == "estimated", 40 + c("ev") * 3 + F.when(c("roi") > 0, 15).otherwise(0))).alias("score"))


@query("K11_derivative_order", "SELECT market, r = 1 AS first, CASE WHEN r = 1 THEN 0 ELSE 1 END AS stage FROM (SELECT market, row_number() OVER (PARTITION BY source, market // 16 ORDER BY market * 37 % 101, market) AS r FROM v_games)")
def derivative_order(spark: SparkSession, d: str) -> DataFrame:
    """Of an event's strikes the lowest is priced first and anchors the others, which make a second stage."""
    w = Window.partitionBy("source", F.floor(c("market") / 16)).orderBy(c("market") * 37 % 101, "market")
    r = F.row_number().over(w)
    return games(spark, d).select("market", (r == 1).alias("first"), F.when(r == 1, 0).otherwise(1).alias("stage"))
