"""Pricing, expected value and arbitrage over order books."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wagerlake.functions import prices as P
from wagerlake.registry import query
from wagerlake.sources.carriers import books, resolution, spread

c = F.col
_CLAMP = "least(greatest({}, 1e-9::DOUBLE), 1 - 1e-9::DOUBLE)"
_MID = "CASE WHEN bid_size + ask_size > 0 THEN (bid * ask_size + ask * bid_size) / (bid_size + ask_size) ELSE (bid + ask) / 2 END"


def r6(x: str) -> str:
    return f"floor(({x}) * 1000000 + 0.5) / 1000000.0::DOUBLE"


@query("M01_microprice", f"SELECT market, CASE WHEN bid > 0 AND bid < ask THEN {r6(_CLAMP.format(_MID))} END AS midpoint, ask - bid AS spread FROM v_books")
def midpoint(spark: SparkSession, d: str) -> DataFrame:
    b = books(spark, d)
    return b.select("market", P.half_up(P.microprice(c("bid"), c("ask"), c("bid_size"), c("ask_size")), 6).alias("midpoint"), (c("ask") - c("bid")).alias("spread"))


@query("M02_true_ev", f"""SELECT market, {r6("p_true * (1 - bid) - (1 - p_true) * bid")} AS gross_ev, CASE WHEN kind % 2 = 0 THEN {r6("0.07::DOUBLE * bid * (1 - bid)")} ELSE {r6("0.001::DOUBLE * bid")} END AS fee_drag,
 CASE WHEN kind % 2 = 0 THEN {r6("p_true * (1 - bid) - (1 - p_true) * bid - 0.07::DOUBLE * bid * (1 - bid)")} ELSE {r6("p_true * (1 - bid) - (1 - p_true) * bid - 0.001::DOUBLE * bid")} END AS net_ev FROM v_books""")
def true_ev(spark: SparkSession, d: str) -> DataFrame:
    gross, fee = P.gross_ev(c("p_true"), c("bid")), F.when(c("kind") % 2 == 0, P.taker_fee(c("bid"))).otherwise(P.slippage(c("bid")))
    return books(spark, d).select("market", P.half_up(gross, 6).alias("gross_ev"), P.half_up(fee, 6).alias("fee_drag"), P.half_up(gross - fee, 6).alias("net_ev"))


@query("M03_taker_fee", f"SELECT market, {r6('0.07::DOUBLE * ask * (1 - ask)')} AS fee FROM v_books")
def taker_fee(spark: SparkSession, d: str) -> DataFrame:
    return books(spark, d).select("market", P.half_up(P.taker_fee(c("ask")), 6).alias("fee"))


@query("M04_kelly", f"SELECT market, {r6('least(greatest((p_true * ((1 - ask) / ask) - (1 - p_true)) / ((1 - ask) / ask) * 0.25::DOUBLE, 0), 1)')} AS fraction FROM v_books")
def kelly(spark: SparkSession, d: str) -> DataFrame:
    return books(spark, d).select("market", P.half_up(P.kelly(c("p_true"), c("ask")), 6).alias("fraction"))


@query("M07_M09_cross_mid", f"""SELECT market, (bid + ask) / 2 AS mid, {r6("(bid + ask) / 2 * (1 / greatest(ask - bid, 0.001::DOUBLE))")} AS weight,
 {r6("((bid + ask) / 2 * ((bid + ask) / 2 * (1 / greatest(ask - bid, 0.001::DOUBLE))) + (bid2 + ask2) / 2 * ((bid2 + ask2) / 2 * (1 / greatest(ask2 - bid2, 0.001::DOUBLE)))) / ((bid + ask) / 2 * (1 / greatest(ask - bid, 0.001::DOUBLE)) + (bid2 + ask2) / 2 * (1 / greatest(ask2 - bid2, 0.001::DOUBLE)))")} AS cross_mid FROM v_books""")
def cross_mid(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("double")
    m1, m2 = P.resting_mid(c("bid"), c("ask"), none), P.resting_mid(c("bid2"), c("ask2"), none)
    w1, w2 = P.liquidity_weight(c("bid"), c("ask"), none), P.liquidity_weight(c("bid2"), c("ask2"), none)
    return books(spark, d).select("market", m1.alias("mid"), P.half_up(w1, 6).alias("weight"), P.half_up((m1 * w1 + m2 * w2) / (w1 + w2), 6).alias("cross_mid"))


@query("M10_p_true_ladder", """SELECT market, CASE kind WHEN 0 THEN p_true WHEN 1 THEN (bid2 + ask2) / 2 WHEN 2 THEN (bid + ask) / 2 ELSE 0.5::DOUBLE END AS p_true, CASE kind WHEN 0 THEN 'consensus' WHEN 1 THEN 'cross_venue' WHEN 2 THEN 'own_book' ELSE 'universal_prior' END AS source,
 CASE kind WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.7::DOUBLE WHEN 2 THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END AS confidence FROM v_books""")
def p_true_ladder(spark: SparkSession, d: str) -> DataFrame:
    tier = lambda on, p, name, sure: F.when(on, F.struct(p.alias("p"), F.lit(name).alias("source"), F.lit(sure).alias("confidence")))
    first = F.coalesce(tier(c("kind") == 0, c("p_true"), "consensus", 0.9), tier(c("kind") == 1, (c("bid2") + c("ask2")) / 2, "cross_venue", 0.7), tier(c("kind") == 2, (c("bid") + c("ask")) / 2, "own_book", 0.5), tier(F.lit(True), F.lit(0.5), "universal_prior", 0.1))
    return books(spark, d).select("market", first.alias("x")).select("market", c("x.p").alias("p_true"), "x.source", "x.confidence")


@query("M11_trade_ev_display", f"SELECT market, CASE WHEN kind = 3 THEN (bid2 + ask2) / 2 ELSE ask END AS p_market, {r6('(p_true * (1 - (CASE WHEN kind = 3 THEN (bid2 + ask2) / 2 ELSE ask END)) - (1 - p_true) * (CASE WHEN kind = 3 THEN (bid2 + ask2) / 2 ELSE ask END)) * 100')} AS gross_percent FROM v_books")
def trade_ev_display(spark: SparkSession, d: str) -> DataFrame:
    paid = F.coalesce(F.when(c("kind") != 3, c("ask")), (c("bid2") + c("ask2")) / 2, c("p_true"))
    return books(spark, d).select("market", paid.alias("p_market"), P.half_up(P.gross_ev(c("p_true"), paid) * 100, 6).alias("gross_percent"))


@query("M12_ev_percent", f"SELECT market, CASE WHEN ask > 0 THEN {r6('(p_true - ask) / ask * 100')} END AS ev_percent FROM v_books")
def ev_percent(spark: SparkSession, d: str) -> DataFrame:
    return books(spark, d).select("market", P.half_up(P.ev_percent(c("ask"), c("p_true")), 6).alias("ev_percent"))


_BOX = """SELECT market, strategy, floor((a + b) * 10000 + 0.5) / 10000.0::DOUBLE AS cost, a, b FROM (SELECT market, 'first_yes' AS strategy, ask AS a, 1 - bid2 AS b FROM v_books WHERE kind <> 3 UNION ALL SELECT market, 'second_yes', ask2, 1 - bid FROM v_books WHERE kind <> 3) WHERE a > 0 AND a < 1 AND b > 0 AND b < 1"""


def windows(b: DataFrame) -> DataFrame:
    """Both directions of the box over two venues' books; none where the second is inverted (kind 3)."""
    legs = F.array(F.struct(F.lit("first_yes").alias("strategy"), c("ask").alias("a"), (1 - c("bid2")).alias("b")), F.struct(F.lit("second_yes").alias("strategy"), c("ask2").alias("a"), (1 - c("bid")).alias("b")))
    each = b.where("kind <> 3").select("market", F.inline(legs)).where("a > 0 and a < 1 and b > 0 and b < 1")
    return each.withColumn("cost", P.box_cost(c("a"), c("b")))


@query("M16_M17_M22_box_windows", f"SELECT market, strategy, cost, floor((1 - cost) * 10000 + 0.5) / 10000.0::DOUBLE AS profit, floor(cost * 100 * 10 + 0.5) / 10.0::DOUBLE AS implied_sum, cost < 1 AS actionable FROM ({_BOX})")
def box_windows(spark: SparkSession, d: str) -> DataFrame:
    return windows(books(spark, d)).select("market", "strategy", "cost", P.half_up(1 - c("cost"), 4).alias("profit"), P.half_up(c("cost") * 100, 1).alias("implied_sum"), (c("cost") < 1).alias("actionable"))


def split(w: DataFrame, stake: float = 1000.0) -> DataFrame:
    """Stakes on both legs that pay out alike."""
    units = F.lit(stake) / (c("a") + c("b"))
    w = w.where("a + b < 1").select("market", "strategy", P.half_up(units * c("a"), 2).alias("stake_a"), P.half_up(units * c("b"), 2).alias("stake_b"), P.half_up(units, 2).alias("payout"))
    w = w.withColumn("profit", P.half_up(c("payout") - stake, 2))
    return w.withColumn("roi", P.half_up(c("profit") / stake * 100, 1))


@query("M18_equal_payout", f"""SELECT *, floor(profit / 1000.0::DOUBLE * 100 * 10 + 0.5) / 10.0::DOUBLE AS roi FROM (SELECT *, floor((payout - 1000.0::DOUBLE) * 100 + 0.5) / 100.0::DOUBLE AS profit FROM (
 SELECT market, strategy, floor(1000.0::DOUBLE / (a + b) * a * 100 + 0.5) / 100.0::DOUBLE AS stake_a, floor(1000.0::DOUBLE / (a + b) * b * 100 + 0.5) / 100.0::DOUBLE AS stake_b, floor(1000.0::DOUBLE / (a + b) * 100 + 0.5) / 100.0::DOUBLE AS payout FROM ({_BOX}) WHERE a + b < 1))""")
def equal_payout(spark: SparkSession, d: str) -> DataFrame:
    return split(windows(books(spark, d)))


@query("M19_venue_minimum", f"""SELECT market, strategy, floor(sa * s * 100 + 0.5) / 100.0::DOUBLE AS stake_a, floor(sb * s * 100 + 0.5) / 100.0::DOUBLE AS stake_b FROM (SELECT *, greatest(1, 300.0::DOUBLE / least(sa, sb)) AS s FROM (
 SELECT market, strategy, floor(1000.0::DOUBLE / (a + b) * a * 100 + 0.5) / 100.0::DOUBLE AS sa, floor(1000.0::DOUBLE / (a + b) * b * 100 + 0.5) / 100.0::DOUBLE AS sb FROM ({_BOX}) WHERE a + b < 1))""")
def venue_minimum(spark: SparkSession, d: str, least: float = 300.0) -> DataFrame:
    s = F.greatest(F.lit(1.0), least / F.least("stake_a", "stake_b"))
    return split(windows(books(spark, d))).select("market", "strategy", P.half_up(c("stake_a") * s, 2).alias("stake_a"), P.half_up(c("stake_b") * s, 2).alias("stake_b"))


@query("M20_M21_yes_no_asks", "SELECT market, ask AS yes_ask, 1 - bid AS no_ask, ask < 1 AND bid < ask AS complete FROM v_books WHERE ask < 1")
def yes_no_asks(spark: SparkSession, d: str) -> DataFrame:
    ok = lambda x: F.when((x > 0) & (x < 1), x)
    yes, no = ok(c("ask")), ok(1 - ok(c("bid")))
    return books(spark, d).where("ask < 1").select("market", yes.alias("yes_ask"), no.alias("no_ask"), (yes.isNotNull() & no.isNotNull() & (c("bid") < yes)).alias("complete"))


@query("M23_consensus_arb", "SELECT market, floor((ask + 1 - p_true) * 10000 + 0.5) / 10000.0::DOUBLE AS cost FROM v_books WHERE floor((ask + 1 - p_true) * 10000 + 0.5) / 10000.0::DOUBLE < 0.98")
def consensus_arb(spark: SparkSession, d: str, most: float = 0.98) -> DataFrame:
    return books(spark, d).select("market", P.box_cost(c("ask") + 1, -c("p_true")).alias("cost")).where(c("cost") < most)


@query("M25_quote_fallback", "SELECT market, CASE WHEN kind = 0 THEN ask WHEN kind = 1 THEN ask2 WHEN kind = 2 THEN (bid + ask) / 2 END AS yes_ask, CASE kind WHEN 0 THEN 'book' WHEN 1 THEN 'other_venue' WHEN 2 THEN 'mid' ELSE 'none' END AS source FROM v_books")
def quote_fallback(spark: SparkSession, d: str) -> DataFrame:
    k = c("kind")
    return books(spark, d).select("market", F.coalesce(F.when(k == 0, c("ask")), F.when(k == 1, c("ask2")), F.when(k == 2, (c("bid") + c("ask")) / 2)).alias("yes_ask"), F.when(k == 0, "book").when(k == 1, "other_venue").when(k == 2, "mid").otherwise("none").alias("source"))


@query("M26_M28_clv", f"SELECT market, CASE WHEN ask > 0 THEN {r6('(p_true - ask) / ask')} END AS clv, floor((p_true - ask) * 1000 + 0.5) / 10.0::DOUBLE AS clv_cents FROM v_books")
def clv(spark: SparkSession, d: str) -> DataFrame:
    return books(spark, d).select("market", F.when(c("ask") > 0, P.half_up((c("p_true") - c("ask")) / c("ask"), 6)).alias("clv"), (F.floor((c("p_true") - c("ask")) * 1000 + 0.5) / F.lit(10.0)).alias("clv_cents"))


@query("M30_M32_odds", f"""SELECT market, {r6("CASE WHEN o > 0 THEN 100.0::DOUBLE / (o + 100) WHEN o < 0 THEN abs(o)::DOUBLE / (abs(o) + 100) END")} AS implied, {r6("ask / (ask + ask2)")} AS fair_a, {r6("ask / (ask + ask2 + p_true)")} AS fair_home FROM (SELECT *, market * 37 % 801 - 400 AS o FROM v_books)""")
def odds(spark: SparkSession, d: str) -> DataFrame:
    return books(spark, d).select("market", P.half_up(P.american_odds(c("market") * 37 % 801 - 400), 6).alias("implied"), P.half_up(c("ask") / (c("ask") + c("ask2")), 6).alias("fair_a"), P.half_up(c("ask") / (c("ask") + c("ask2") + c("p_true")), 6).alias("fair_home"))


_CDF = "0.3989423::DOUBLE * exp(-z * z / 2) * t * (0.3193815::DOUBLE + t * (-0.3565638::DOUBLE + t * (1.781478::DOUBLE + t * (-1.821256::DOUBLE + t * 1.330274::DOUBLE))))"


@query("M35_M36_spread_cover", f"SELECT market, floor(least(greatest(CASE WHEN z >= 0 THEN 1 - {_CDF} ELSE {_CDF} END, 1e-9::DOUBLE), 1 - 1e-9::DOUBLE) * 1000000 + 0.5) / 1000000.0::DOUBLE AS cover FROM (SELECT *, 1 / (1 + 0.2316419::DOUBLE * abs(z)) AS t FROM (SELECT market, ((p_true - 0.5::DOUBLE) * 20 - kind) / 12.0::DOUBLE AS z FROM v_books))")
def spread_cover(spark: SparkSession, d: str, sigma: float = 12.0) -> DataFrame:
    return books(spark, d).select("market", P.half_up(P.clamp(P.normal_cdf(((c("p_true") - 0.5) * 20 - c("kind")) / sigma)), 6).alias("cover"))


@query("M33_poisson_over", "SELECT market, floor(least(greatest(1 - (SELECT coalesce(sum(exp(-p_true * 4) * pow(p_true * 4, k) / factorial(k::INT)), 0) FROM range(kind + 1) AS r(k)), 1e-9::DOUBLE), 1 - 1e-9::DOUBLE) * 1000000 + 0.5) / 1000000.0::DOUBLE AS over FROM v_books")
def poisson_over(spark: SparkSession, d: str) -> DataFrame:
    return books(spark, d).select("market", P.half_up(P.poisson_over(c("p_true") * 4, c("kind") + F.lit(0.5)), 6).alias("over"))


@query("M34_poisson_rate", "SELECT market, floor(greatest(-ln(1 - p_true), 0.05::DOUBLE) * 10000 + 0.5) / 10000.0::DOUBLE AS rate FROM v_books")
def poisson_rate(spark: SparkSession, d: str) -> DataFrame:
    """Calibrated rates for one or more events, where the answer is known: -ln(1 - chance), within the bracket."""
    return spread(books(spark, d), "market").select("market", P.half_up(P.poisson_rate(F.lit(0.5), c("p_true")), 4).alias("rate"))


@query("M42_M43_logit_and_divergence", f"SELECT market, {r6('1 / (1 + exp(-(ln(p_true / (1 - p_true)) + 1.75::DOUBLE * (bid - 0.5::DOUBLE) * ask2)))')} AS shifted, {r6('0.5::DOUBLE * (p_true * ln(p_true / m) + (1 - p_true) * ln((1 - p_true) / (1 - m))) + 0.5::DOUBLE * (bid * ln(bid / m) + (1 - bid) * ln((1 - bid) / (1 - m)))')} AS divergence FROM (SELECT *, 0.5::DOUBLE * (p_true + bid) AS m FROM v_books)")
def logit_and_divergence(spark: SparkSession, d: str) -> DataFrame:
    return books(spark, d).select("market", P.half_up(P.shifted(c("p_true"), c("bid") - 0.5, c("ask2")), 6).alias("shifted"), P.half_up(P.js_divergence(c("p_true"), c("bid")), 6).alias("divergence"))


@query("M45_outcome_mid", "SELECT market, CASE WHEN kind % 2 = 0 THEN (bid + ask) / 2 ELSE 1 - (bid + ask) / 2 END AS mid FROM v_books")
def outcome_mid(spark: SparkSession, d: str) -> DataFrame:
    mid = (c("bid") + c("ask")) / 2
    return books(spark, d).select("market", F.when(c("kind") % 2 == 0, mid).otherwise(1 - mid).alias("mid"))


@query("M47_liquidity", "SELECT market, floor((ask - bid) * 100 + 0.5) AS spread_cents, CASE WHEN floor((ask - bid) * 100 + 0.5) <= 2 THEN 'tight' WHEN floor((ask - bid) * 100 + 0.5) <= 4 THEN 'fair' ELSE 'wide' END AS quality, bid_size + ask_size AS depth FROM v_books")
def liquidity(spark: SparkSession, d: str) -> DataFrame:
    wide = F.floor((c("ask") - c("bid")) * 100 + 0.5)
    return books(spark, d).select("market", wide.cast("double").alias("spread_cents"), F.when(wide <= 2, "tight").when(wide <= 4, "fair").otherwise("wide").alias("quality"), (c("bid_size") + c("ask_size")).alias("depth"))


@query("M40_M41_event_anchor", "SELECT market, brand, floor(greatest(least(a.p_true + (b.bid - a.bid) / 2, 1), 0) * 1000000 + 0.5) / 1000000.0::DOUBLE AS p FROM v_books b JOIN (SELECT brand, arg_max(struct_pack(p_true := p_true, bid := bid), market) AS a FROM v_books WHERE kind = 0 GROUP BY brand) USING (brand) WHERE kind <> 0")
def event_anchor(spark: SparkSession, d: str) -> DataFrame:
    """Derivative markets take the anchor of their event's last primary market."""
    b = books(spark, d)
    anchor = b.where("kind = 0").groupBy("brand").agg(F.max_by(F.struct("p_true", "bid"), "market").alias("a"))
    p = F.greatest(F.least(c("a.p_true") + (c("bid") - c("a.bid")) / 2, F.lit(1.0)), F.lit(0.0))
    return b.where("kind <> 0").join(anchor, "brand").select("market", "brand", P.half_up(p, 6).alias("p"))


@query("K05_K06_top_windows", f"SELECT market, strategy, cost, floor((1 - cost) / cost * 1000 + 0.5) / 10.0::DOUBLE AS roi FROM ({_BOX}) WHERE cost < 1 ORDER BY cost, market, strategy LIMIT 8")
def top_windows(spark: SparkSession, d: str, top: int = 8) -> DataFrame:
    w = windows(books(spark, d)).where("cost < 1").select("market", "strategy", "cost", (F.floor((1 - c("cost")) / c("cost") * 1000 + 0.5) / F.lit(10.0)).alias("roi"))
    return w.orderBy("cost", "market", "strategy").limit(top)


@query("A28_scan_coverage", f"SELECT count(*) AS scanned, count(*) FILTER (n = 0) AS without_window, count(*) FILTER (n > 0) AS with_window, coalesce(sum(good), 0)::BIGINT AS actionable FROM (SELECT market, count(strategy) AS n, count(*) FILTER (cost < 1) AS good FROM (SELECT market FROM v_books) LEFT JOIN ({_BOX}) USING (market) GROUP BY market)")
def scan_coverage(spark: SparkSession, d: str) -> DataFrame:
    b = books(spark, d)
    per = b.select("market").join(windows(b), "market", "left").groupBy("market").agg(F.count("strategy").alias("n"), F.count_if(c("cost") < 1).alias("good"))
    return per.agg(F.count("*").alias("scanned"), F.count_if(c("n") == 0).alias("without_window"), F.count_if(c("n") > 0).alias("with_window"), F.coalesce(F.sum("good"), F.lit(0)).alias("actionable"))


@query("C14_arbitrage_scan", f"SELECT w.market, strategy, cost, resolved_at FROM ({_BOX}) w JOIN v_resolution ON market = condition WHERE cost < 1 AND final")
def arbitrage_scan(spark: SparkSession, d: str) -> DataFrame:
    live = resolution(spark, d).where("final").select(c("condition").alias("market"), "resolved_at")
    return windows(books(spark, d)).where("cost < 1").join(live, "market").select("market", "strategy", "cost", "resolved_at")
