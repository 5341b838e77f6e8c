"""Verdicts and reports over several inputs: capped copy verdicts, display ladders, consensus of agents, policy grids, coverage and batch reports, receipts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wagerlake import registry
from wagerlake.functions import prices as P
from wagerlake.plans.exchange import cross_market_stats
from wagerlake.plans.performance import RELIABLE, track_record
from wagerlake.registry import query
from wagerlake.sources.carriers import books, feed, positions, resolution, spread, table

c = F.col
#: EV above which a strong verdict stays, least stake and EV percent of the feed, largest pull back to the prior.
STRONG_EV, FEED_STAKE, FEED_EV, SHRINK = 0.02, 500, 3, 0.45


def chosen(xs: tuple[str | None, ...], key: Column) -> Column:
    return F.get(F.array(*map(F.lit, xs)), (key % len(xs)).cast("int"))


def _chosen(xs: tuple[str | None, ...], key: str) -> str:
    return f"([{', '.join('NULL' if x is None else repr(x) for x in xs)}])[({key}) % {len(xs)} + 1]"


def holds(x: Column) -> Column:
    """x, false where it is null."""
    return F.coalesce(x, F.lit(False))


VERDICTS = ("Strong Copy Signal", "Worth Considering", "Proceed With Caution", "Weak Signal")


def capped(verdict: Column, good: Column, known: Column, closed: Column, win_rate: Column, roi: Column, ev: Column) -> Column:
    """A trade's verdict held back by its trader: unproven traders get a verdict of their own, strong ones need a good record and an EV above 2 percent."""
    strong, unproven = verdict == VERDICTS[0], ~(known & holds(closed >= RELIABLE))
    proven = holds((win_rate >= 50) & (roi >= 0)) & holds(ev > STRONG_EV)
    return (
        F.when(unproven & (strong | (good >= 3)), "Promising Bet, Unproven Trader").when(unproven & (verdict == VERDICTS[1]), "Unproven Trader — Limited Track Record")
        .when(~unproven & strong & ~proven, VERDICTS[1]).otherwise(verdict)
    )


_RECORD = "SELECT wallet, count(*) FILTER (realized <> 0) AS closed, count(*) FILTER (realized > 0) / nullif(count(*) FILTER (realized <> 0), 0) * 100 AS win_rate, sum(realized) / nullif(sum(bought) FILTER (realized <> 0), 0) * 100 AS roi, sum(realized) / nullif(count(*) FILTER (realized <> 0), 0) AS average FROM v_positions GROUP BY wallet"


@query("M50_track_record_cap", f"""SELECT wallet, CASE WHEN few AND (verdict = 'Strong Copy Signal' OR good >= 3) THEN 'Promising Bet, Unproven Trader' WHEN few AND verdict = 'Worth Considering' THEN 'Unproven Trader — Limited Track Record'
 WHEN NOT few AND verdict = 'Strong Copy Signal' AND NOT (win_rate >= 50 AND roi >= 0 AND coalesce(net, pct / 100, 0) > 0.02::DOUBLE) THEN 'Worth Considering' ELSE verdict END AS verdict FROM (SELECT *, wallet % 11 = 0 OR closed < 5 AS few, {_chosen(VERDICTS, 'wallet')} AS verdict,
 wallet // 4 % 5 AS good, CASE WHEN wallet % 3 = 0 THEN (wallet % 70 - 20) / 1000.0::DOUBLE END AS net, CASE WHEN wallet % 7 > 0 THEN (wallet % 90 - 30) / 10.0::DOUBLE END AS pct FROM ({_RECORD}))""")
def track_record_cap(spark: SparkSession, d: str) -> DataFrame:
    w = c("wallet")
    net, pct = F.when(w % 3 == 0, (w % 70 - 20) / F.lit(1000.0)), F.when(w % 7 > 0, (w % 90 - 30) / F.lit(10.0))
    win_rate = c("wins") / F.nullif(c("closed"), F.lit(0)) * 100
    out = capped(chosen(VERDICTS, w), F.floor(w / 4) % 5, w % 11 != 0, c("closed"), win_rate, c("roi"), F.coalesce(net, pct / 100))
    return track_record(spark, d).select("wallet", out.alias("verdict"))


def shown_ev(closed: Column, clv: Column, cross: Column, average: Column) -> Column:
    """What stands for a wallet's mean EV: its closing-line value, its edge across venues, or else its mean return; nothing without a closed bet.

    clv and cross are structs of total, enough and mean, null where there is none.
    """
    usable = lambda s: holds((s["total"] > 0) & s["enough"] & s["mean"].isNotNull())
    way = lambda mode, x: F.struct(F.lit(mode).alias("mode"), x.cast("double").alias("value"))
    none = way("unavailable", F.lit(None))
    return (
        F.when(F.coalesce(closed, F.lit(0)) == 0, none).when(usable(clv), way("clv", clv["mean"])).when(usable(cross), way("cross_market", cross["mean"]))
        .when(average.isNotNull(), way("avg_return_fallback", average)).otherwise(none)
    )


@query("M51_average_ev_display", f"""SELECT wallet, CASE WHEN closed = 0 THEN 'unavailable' WHEN clv THEN 'clv' WHEN crossed THEN 'cross_market' WHEN average IS NOT NULL THEN 'avg_return_fallback' ELSE 'unavailable' END AS mode,
 CASE WHEN closed = 0 THEN NULL WHEN clv THEN (wallet % 31 - 15) / 100.0::DOUBLE WHEN crossed THEN (wallet % 41 - 20) / 10.0::DOUBLE ELSE floor(average * 100 + 0.5) / 100 END AS value FROM (
 SELECT *, wallet % 3 = 0 AND wallet % 8 > 0 AND wallet % 5 > 0 AS clv, wallet % 4 > 1 AND wallet % 7 > 3 AND wallet % 9 > 0 AS crossed FROM ({_RECORD}))""")
def average_ev_display(spark: SparkSession, d: str) -> DataFrame:
    w = c("wallet")
    stats = lambda there, total, enough, mean: F.when(there, F.struct(total.alias("total"), enough.alias("enough"), mean.alias("mean")))
    clv = stats(w % 3 == 0, w % 8, w % 5 > 0, (w % 31 - 15) / F.lit(100.0))
    cross = stats(w % 4 > 1, w % 9, w % 7 > 3, (w % 41 - 20) / F.lit(10.0))
    return track_record(spark, d).select("wallet", shown_ev(c("closed"), clv, cross, P.half_up(c("average"), 2)).alias("s")).select("wallet", "s.mode", "s.value")


def consensus(prior: Column, agents: Column) -> Column:
    """Consensus of an array of agents (p, weight, confidence): the weighted mean is pulled to the prior by how much the agents disagree.

    Struct of p_true, variance, divergence, shrinkage and source_score. Without agents: the prior, 0.25 and zeros; without weight the mean is 0.5.
    """
    add = lambda f: F.aggregate(agents, F.lit(0.0), lambda s, a: s + f(a))
    share = lambda a: a["weight"] * a["confidence"]
    total, n = add(share), F.size(agents)
    over = lambda x, empty: F.when(total > 0, x / total).otherwise(empty)
    mean = over(add(lambda a: a["p"] * share(a)), F.lit(0.5))
    spread = over(add(lambda a: share(a) * (a["p"] - mean) * (a["p"] - mean)), F.lit(0.25))
    apart = F.when(n > 1, F.least(F.lit(1.0), F.greatest(F.lit(0.0), add(lambda a: P.js_divergence(a["p"], mean)) / n / F.ln(F.lit(2.0))))).otherwise(0.0)
    pull = F.least(F.lit(SHRINK), apart * SHRINK * 2)
    known = F.when(n > 0, P.clamp((1 - pull) * P.clamp(mean, P.JS_EPS) + pull * P.clamp(prior, P.JS_EPS), P.JS_EPS)).otherwise(P.clamp(prior, P.JS_EPS))
    return F.struct(
        known.alias("p_true"), F.when(n > 0, spread).otherwise(0.25).alias("variance"), F.when(n > 0, apart).otherwise(0.0).alias("divergence"), F.when(n > 0, pull).otherwise(0.0).alias("shrinkage"),
        F.when(n > 0, over(add(lambda a: a["confidence"] * share(a)), F.lit(0.0))).otherwise(0.0).alias("source_score"),
    )


#: Weights of the baseline models.
BASELINES = {"weather": 0.85, "economic": 0.9, "market_microstructure": 0.4}


def _clamped(x: str) -> str:
    return f"least(greatest({x}, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE)"


_AGENT = "CASE WHEN {there} THEN struct_pack(p := " + _clamped("1 / (1 + exp(-(ln(prior / (1 - prior)) + 1.75::DOUBLE * {impact} * {conf})))") + ", w := {weight}::DOUBLE * {conf}, c := {conf}) END"
_AGENTS = ", ".join((
    _AGENT.format(there="llm OR rel > 0", impact="imp", conf="rel", weight="(CASE WHEN llm THEN 1 ELSE 0.25 END)"), _AGENT.format(there="market % 5 = 0", impact="wimp", conf="0.55::DOUBLE", weight="0.85"),
    _AGENT.format(there="market % 7 = 0", impact="eimp", conf="0.6::DOUBLE", weight="0.9"), _AGENT.format(there="market % 2 = 0", impact="mimp", conf="0.35::DOUBLE", weight="0.4"),
))
_KL = "(0.5::DOUBLE * ({x} * ln({x} / {m}) + (1 - {x}) * ln((1 - {x}) / (1 - {m}))))"


@query("A43_agent_consensus", f"""WITH a AS (SELECT market, prior, list_filter([{_AGENTS}], lambda x: x IS NOT NULL) AS g FROM (SELECT market, p_true AS prior, market % 4 = 1 AS llm, market % 3 / 4.0::DOUBLE AS rel, (market % 21 - 10) / 10.0::DOUBLE AS imp, (market % 7 - 3) / 10.0::DOUBLE AS wimp, (market % 11 - 5) / 20.0::DOUBLE AS eimp, (p_true - 0.5) * -0.15::DOUBLE AS mimp FROM v_books)),
 e AS (SELECT market, unnest(g) AS x FROM a), m AS (SELECT market, count(*) AS n, CASE WHEN sum(x.w) > 0 THEN sum(x.w * x.p) / sum(x.w) ELSE 0.5 END AS mean, sum(x.w) AS tw, CASE WHEN sum(x.w) > 0 THEN sum(x.w * x.c) / sum(x.w) ELSE 0 END AS score FROM e GROUP BY market),
 s AS (SELECT market, any_value(n) AS n, any_value(mean) AS mean, any_value(score) AS score, CASE WHEN any_value(tw) > 0 THEN sum(x.w * (x.p - mean) * (x.p - mean)) / any_value(tw) ELSE 0.25 END AS variance, CASE WHEN any_value(n) > 1 THEN least(1, greatest(0, avg({_KL.format(x="x.p", m="(0.5::DOUBLE * (x.p + mean))")} + {_KL.format(x="mean", m="(0.5::DOUBLE * (x.p + mean))")}) / ln(2))) ELSE 0 END AS js FROM e JOIN m USING (market) GROUP BY market)
SELECT a.market, coalesce(n, 0)::BIGINT AS agents, floor({_clamped("CASE WHEN n IS NULL THEN prior ELSE (1 - least(0.45::DOUBLE, js * 0.9::DOUBLE)) * mean + least(0.45::DOUBLE, js * 0.9::DOUBLE) * prior END")} * 1e6 + 0.5) / 1e6 AS p_true, floor(coalesce(variance, 0.25) * 1e6 + 0.5) / 1e6 AS variance,
 floor(coalesce(js, 0) * 1e6 + 0.5) / 1e6 AS divergence, floor(CASE WHEN n IS NULL THEN 0 ELSE least(0.45::DOUBLE, js * 0.9::DOUBLE) END * 1e6 + 0.5) / 1e6 AS shrinkage, floor(coalesce(score, 0) * 1e6 + 0.5) / 1e6 AS source_score FROM a LEFT JOIN s USING (market)""")
def agent_consensus(spark: SparkSession, d: str) -> DataFrame:
    """What a sentiment model and baseline models make of a market's price; each model moves the price's log odds by impact and confidence."""
    m, prior = c("market"), c("p_true")
    agent = lambda there, impact, conf, weight: F.when(there, F.struct(P.shifted(prior, impact, conf).alias("p"), weight.cast("double").alias("weight"), conf.alias("confidence")))
    llm, rel = m % 4 == 1, m % 3 / F.lit(4.0)
    agents = F.array_compact(F.array(
        agent(llm | (rel > 0), (m % 21 - 10) / F.lit(10.0), rel, F.when(llm, 1.0).otherwise(0.25)), agent(m % 5 == 0, (m % 7 - 3) / F.lit(10.0), F.lit(0.55), F.lit(BASELINES["weather"])),
        agent(m % 7 == 0, (m % 11 - 5) / F.lit(20.0), F.lit(0.6), F.lit(BASELINES["economic"])), agent(m % 2 == 0, (prior - 0.5) * -0.15, F.lit(0.35), F.lit(BASELINES["market_microstructure"])),
    ))
    out = spread(books(spark, d), "market").select("market", "p_true", agents.alias("agents")).select("market", F.size("agents").cast("long").alias("n"), consensus(prior, c("agents")).alias("s"))
    return out.select("market", c("n").alias("agents"), *(P.half_up(c(f"s.{x}"), 6).alias(x) for x in ("p_true", "variance", "divergence", "shrinkage", "source_score")))


#: The grid's policies: ROI threshold, whether it must be exceeded, rate threshold; null where a policy has none.
POLICIES = (
    ("portfolioRealizedRoi > 0", 0.0, True, None), ("portfolioRealizedRoi >= 0.03", 0.03, False, None), ("portfolioRealizedRoi >= 0.05", 0.05, False, None), ("profitablePositionRate >= 0.40", None, False, 0.4),
    ("profitablePositionRate >= 0.50", None, False, 0.5), ("profitablePositionRate >= 0.60", None, False, 0.6), ("ROI > 0 AND profitablePositionRate >= 0.40", 0.0, True, 0.4), ("ROI > 0 AND profitablePositionRate >= 0.50", 0.0, True, 0.5),
    ("ROI >= 0.03 AND profitablePositionRate >= 0.40", 0.03, False, 0.4), ("ROI >= 0.03 AND profitablePositionRate >= 0.50", 0.03, False, 0.5),
)
FLOORS = (10, 20, 50)


def passes(roi: Column, rate: Column, policy: tuple) -> Column:
    """Whether a wallet's ROI and rate of profitable positions meet a policy; unknown or non-finite ones never do."""
    _, least_roi, above, least_rate = policy
    usable = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    tests = [usable(roi) & (roi > least_roi if above else roi >= least_roi)] if least_roi is not None else []
    tests += [usable(rate) & (rate >= least_rate)] if least_rate is not None else []
    return holds(reduce(lambda a, b: a & b, tests))


_GRID = " UNION ALL ".join(
    f"SELECT '{name}' AS policy, count(*) FILTER (ok) AS passed, {', '.join(f'count(*) FILTER (ok AND closed >= {n}) AS passed_{n}' for n in FLOORS)} FROM (SELECT closed, {' AND '.join(([f'coalesce(roi / 100 {chr(62) if above else chr(62) + chr(61)} {x}::DOUBLE, false)'] if x is not None else []) + ([f'coalesce(win_rate / 100 >= {y}::DOUBLE, false)'] if y is not None else []))} AS ok FROM r)"
    for name, x, above, y in POLICIES
)


@query("P29_policy_grid", f"WITH r AS ({_RECORD}) {_GRID}")
def policy_grid(spark: SparkSession, d: str) -> DataFrame:
    """How many wallets each policy lets pass, in all and from each floor of closed positions; wallets are counted once for all policies."""
    roi, rate = c("roi") / 100, c("wins") / F.nullif(c("closed"), F.lit(0)) * 100 / 100
    each = F.array(*(F.struct(F.lit(p[0]).alias("policy"), passes(roi, rate, p).alias("ok")) for p in POLICIES))
    flat = track_record(spark, d).select("closed", F.inline(each))
    return flat.groupBy("policy").agg(F.count_if("ok").alias("passed"), *(F.count_if(c("ok") & (c("closed") >= n)).alias(f"passed_{n}") for n in FLOORS))


METHODS = ("direct", "ambiguous", "unresolved", "proxy", "direct")


def history(identity: Column, low: Column, only_positions: Column, events: Column, backfill: Column, activity_cut: Column, trades_cut: Column, held_missing: Column, required: Column, covered: Column, material: Column, unclear: Column, unclear_share: Column, order: Column) -> Column:
    """Why a wallet's history falls short, in fixed order, and what that makes of its metrics and history (struct of reasons, metrics, credible, history)."""
    thin = (required > 0) & (covered < required)
    reasons = F.array_compact(F.array(
        F.when(identity == "ambiguous", "identity_ambiguous"), F.when(identity == "unresolved", "identity_unresolved"), F.when(low, "identity_low_confidence"), F.when(only_positions, "positions_without_history_events"),
        F.when(events == 0, "no_history_events"), F.when(backfill, "historical_backfill_required"), F.when(activity_cut, "activity_truncated"), F.when(trades_cut, "trades_truncated"),
        F.when(held_missing > 0, "gamma_resolution_missing_on_held_positions"), F.when(thin, "gamma_resolution_incomplete"), F.when(material, "merge_split_material").when(unclear > 0, "merge_split_unresolved"), F.when(order, "unresolved_chain_order"),
    ))
    blocked = low | identity.isin("ambiguous", "unresolved") | only_positions | (events == 0) | backfill | activity_cut | trades_cut | (held_missing > 0) | (unclear_share >= 0.05) | order
    state = lambda metrics, name: F.struct(F.lit(metrics).alias("metrics"), F.lit(name).alias("history"))
    s = F.when(events == 0, state("unusable", "unusable")).when(blocked, state("partial", "partial-and-metrics-unsafe")).when(thin, state("complete", "partial-but-metrics-safe")).otherwise(state("complete", "complete"))
    return F.struct(reasons.alias("reasons"), s["metrics"].alias("metrics"), (~blocked).alias("credible"), s["history"].alias("history"))


@query("L11_validity_reasons", f"""SELECT wallet, list_filter([CASE WHEN m = 'ambiguous' THEN 'identity_ambiguous' END, CASE WHEN m = 'unresolved' THEN 'identity_unresolved' END, CASE WHEN low THEN 'identity_low_confidence' END, CASE WHEN bare THEN 'positions_without_history_events' END, CASE WHEN events = 0 THEN 'no_history_events' END,
 CASE WHEN back THEN 'historical_backfill_required' END, CASE WHEN acut THEN 'activity_truncated' END, CASE WHEN tcut THEN 'trades_truncated' END, CASE WHEN missing > 0 THEN 'gamma_resolution_missing_on_held_positions' END, CASE WHEN thin THEN 'gamma_resolution_incomplete' END,
 CASE WHEN mat THEN 'merge_split_material' WHEN unclear > 0 THEN 'merge_split_unresolved' END, CASE WHEN unsorted THEN 'unresolved_chain_order' END], lambda x: x IS NOT NULL) AS reasons, CASE WHEN events = 0 THEN 'unusable' WHEN blocked THEN 'partial' ELSE 'complete' END AS metrics, NOT blocked AS credible,
 CASE WHEN events = 0 THEN 'unusable' WHEN blocked THEN 'partial-and-metrics-unsafe' WHEN thin THEN 'partial-but-metrics-safe' ELSE 'complete' END AS history FROM (
 SELECT *, low OR m IN ('ambiguous', 'unresolved') OR bare OR events = 0 OR back OR acut OR tcut OR missing > 0 OR unclear >= 0.05::DOUBLE * n OR unsorted AS blocked FROM (SELECT wallet, n, {_chosen(METHODS, 'wallet % 16')} AS m, wallet % 17 = 0 AS low, wallet % 19 = 0 AS bare, CASE WHEN wallet % 23 = 0 THEN 0 ELSE n END AS events,
 wallet % 29 = 0 AS back, wallet % 13 = 0 AS acut, wallet % 31 = 0 AS tcut, CASE WHEN wallet % 4 = 0 THEN missing ELSE 0 END AS missing, required > covered AS thin, wallet % 37 = 0 AS mat, wallet % 3 AS unclear, wallet % 41 = 0 AS unsorted FROM (
 SELECT wallet, count(*) AS n, count(*) FILTER (status <> 'OPEN') AS required, count(*) FILTER (status = 'CLOSED' OR (status = 'REDEEMABLE' AND wallet % 2 = 0)) AS covered, count(*) FILTER (redeemable AND price = 0) AS missing FROM v_positions GROUP BY wallet)))""")
def validity_reasons(spark: SparkSession, d: str) -> DataFrame:
    w = c("wallet")
    got = (c("status") == "CLOSED") | ((c("status") == "REDEEMABLE") & (w % 2 == 0))
    per = positions(spark, d).groupBy("wallet").agg(F.count("*").alias("n"), F.count_if(c("status") != "OPEN").alias("required"), F.count_if(got).alias("covered"), F.count_if(c("redeemable") & (c("price") == 0)).alias("missing"))
    says = history(
        chosen(METHODS, w % 16), w % 17 == 0, w % 19 == 0, F.when(w % 23 == 0, 0).otherwise(c("n")), w % 29 == 0, w % 13 == 0, w % 31 == 0, F.when(w % 4 == 0, c("missing")).otherwise(0), c("required"), c("covered"), w % 37 == 0, w % 3,
        w % 3 / c("n"), w % 41 == 0,
    )
    return per.select("wallet", says.alias("s")).select("wallet", "s.*")


def kalshi_gate(venue: Column, stake: Column, ticker: Column, ev: Column) -> Column:
    """Why a trade stays out of the feed; null where it passes. Other venues fail on the stake; a blank ticker counts as none."""
    none = ticker.isNull() | (F.trim(ticker) == "")
    return F.when(~holds((venue == "kalshi") & (stake >= FEED_STAKE)), "stake_floor").when(none, "unmapped_ticker").when(ev.isNull() | F.isnan(ev), "missing_trade_ev").when(ev < FEED_EV, "trade_ev")


TICKERS = ("KXMLB-1", None, " ", "KXFED-2", "KXBTC-3")


@query("P33_kalshi_gate", f"""SELECT id, reason IS NULL AS passed, reason, CASE WHEN reason IS NULL OR reason IN ('trade_ev', 'missing_trade_ev') THEN shown END AS ev, CASE WHEN reason IS NOT NULL AND reason IN ('stake_floor', 'unmapped_ticker') THEN NULL WHEN piped THEN 'ok' ELSE 'missing' END AS status FROM (
 SELECT *, CASE WHEN venue <> 'kalshi' OR stake_cents < 50000 THEN 'stake_floor' WHEN ticker IS NULL OR trim(ticker) = '' THEN 'unmapped_ticker' WHEN shown IS NULL THEN 'missing_trade_ev' WHEN shown < 3 THEN 'trade_ev' END AS reason FROM (
 SELECT id, venue, stake_cents, id % 3 > 0 AND ev IS NOT NULL AS piped, CASE WHEN id % 3 > 0 AND ev IS NOT NULL THEN ev WHEN id % 4 > 0 THEN (id % 90 - 20) / 10.0::DOUBLE END AS shown, {_chosen(TICKERS, 'id')} AS ticker FROM v_feed))""")
def kalshi_gates(spark: SparkSession, d: str) -> DataFrame:
    """Gate of each trade; its EV is the pipeline's, or else that of the contract's middle price."""
    i = c("id")
    piped = (i % 3 > 0) & c("ev").isNotNull()
    ev = F.when(piped, c("ev")).when(i % 4 > 0, (i % 90 - 20) / F.lit(10.0))
    f = feed(spark, d).select("id", piped.alias("piped"), ev.alias("shown"), kalshi_gate(c("venue"), c("stake_cents") / 100, chosen(TICKERS, i), ev).alias("reason"))
    early = holds(c("reason").isin("stake_floor", "unmapped_ticker"))
    return f.select("id", c("reason").isNull().alias("passed"), "reason", F.when(~early, c("shown")).alias("ev"), F.when(~early, F.when(c("piped"), "ok").otherwise("missing")).alias("status"))


#: Keywords of coins, leagues and macro themes, boost of shared tokens and least score of a match by tokens.
COINS, LEAGUES = ("btc", "eth"), ("nfl", "nba", "mlb", "nhl", "world_cup")
MACRO = ("fed", "cpi", "gdp", "inflation", "unemployment", "rate_cut", "rate_hike", "recession", "tariff", "interest_rate")
BOOST, BY_TOKENS = 0.25, 0.85


def by_tokens(raw: Column, numbers: Column, words: Column, same_period: Column) -> Column:
    """A similarity raised by what two titles share (arrays of numbers and keywords): struct of adjusted and method."""
    among = lambda xs: F.size(F.filter(words, lambda k: k.isin(*xs)))
    teams, n, k = F.size(F.filter(words, lambda x: x.startswith("team:"))), F.size(numbers), F.size(words)
    leagues = among(LEAGUES)
    sure = ((teams >= 2) & ((n >= 1) | F.array_contains(words, "world_cup"))) | ((leagues + teams >= 2) & (n >= 1)) | (same_period & (n >= 1) & (k >= 1))
    up = lambda part: F.least(F.lit(1.0), raw + BOOST * part)
    boosted = F.when(k >= 2, up(0.5)).when((among(COINS) >= 1) & (raw >= 0.55), up(1)).when(((leagues >= 1) | (teams >= 2)) & (raw >= 0.52), up(0.75)).when((among(MACRO) >= 1) & (raw >= 0.6), up(0.75))
    return F.struct(
        F.when(sure, F.least(F.lit(1.0), F.greatest(raw + BOOST, F.lit(BY_TOKENS)))).otherwise(F.coalesce(boosted, raw)).alias("adjusted"),
        F.when(sure, "token_heuristic").when(boosted.isNotNull(), "token_boost").otherwise("vector").alias("method"),
    )


_LEFT, _RIGHT = ("btc", "team:ars", "nfl", "fed", "world_cup", "team:che"), ("team:ars", "btc", "team:che", "world_cup", "nfl", "cpi", "fed")
_SIDES = f"SELECT p_partkey AS market, p_partkey % 50 / 50.0::DOUBLE AS raw, p_partkey % 3 = 0 AS same, list_intersect([p_partkey % 4, p_partkey % 9], [p_partkey % 5 + 1]) AS n, list_distinct(list_intersect([{_chosen(_LEFT, 'p_partkey')}, {_chosen(_LEFT, 'p_partkey // 6')}, 'team:che'], [{_chosen(_RIGHT, 'p_partkey')}, {_chosen(_RIGHT, 'p_partkey // 7')}, 'team:che'][:CASE WHEN p_partkey % 8 > 0 THEN 2 ELSE 3 END])) AS w FROM part"
_LEAGUE, _TEAM = f"len(list_filter(w, lambda x: x IN {LEAGUES}))", "len(list_filter(w, lambda x: starts_with(x, 'team:')))"


@query("M05_token_ladder", f"""SELECT market, CASE way WHEN 0 THEN least(1, greatest(raw + 0.25::DOUBLE, 0.85::DOUBLE)) WHEN 1 THEN least(1, raw + 0.125::DOUBLE) WHEN 2 THEN least(1, raw + 0.25::DOUBLE) WHEN 3 THEN least(1, raw + 0.1875::DOUBLE) ELSE raw END AS adjusted, CASE way WHEN 0 THEN 'token_heuristic' WHEN 4 THEN 'vector' ELSE 'token_boost' END AS method FROM (
 SELECT market, raw, CASE WHEN (t >= 2 AND (len(n) >= 1 OR list_contains(w, 'world_cup'))) OR (l + t >= 2 AND len(n) >= 1) OR (same AND len(n) >= 1 AND len(w) >= 1) THEN 0 WHEN len(w) >= 2 THEN 1 WHEN len(list_filter(w, lambda x: x IN {COINS})) >= 1 AND raw >= 0.55::DOUBLE THEN 2
 WHEN (l >= 1 OR t >= 2) AND raw >= 0.52::DOUBLE THEN 3 WHEN len(list_filter(w, lambda x: x IN {MACRO})) >= 1 AND raw >= 0.6::DOUBLE THEN 3 ELSE 4 END AS way FROM (SELECT *, {_LEAGUE} AS l, {_TEAM} AS t FROM ({_SIDES})))""")
def token_ladder(spark: SparkSession, d: str) -> DataFrame:
    k = c("p_partkey")
    words = F.array_intersect(F.array(chosen(_LEFT, k), chosen(_LEFT, F.floor(k / 6)), F.lit("team:che")), F.slice(F.array(chosen(_RIGHT, k), chosen(_RIGHT, F.floor(k / 7)), F.lit("team:che")), 1, F.when(k % 8 > 0, 2).otherwise(3)))
    out = by_tokens(k % 50 / F.lit(50.0), F.array_intersect(F.array(k % 4, k % 9), F.array(k % 5 + 1)), words, k % 3 == 0)
    return table(spark, d, "part").select(k.alias("market"), out.alias("s")).select("market", "s.*")


POLICY_SAYS = ("PASS", "FAIL", "UNKNOWN", "PASS", "FAIL")


def policy_coverage(seen: DataFrame) -> DataFrame:
    """Daily rollup of observations (day, batch, wallet, qualified, gated, visible, policy), several batches a day.

    Counts of batches add up; numbers of distinct wallets are those of a day's first batch. Wallets are counted through one row a wallet, so no day's
    set of wallets is gathered; null wallets count as rows but not as wallets.
    """
    is_ = lambda *xs: reduce(lambda a, b: a & b, (holds(x) for x in xs))
    says = lambda x: c("policy") == x
    flags = {"production": is_(c("gated")), "visible": is_(c("visible"))}
    for name in ("PASS", "FAIL", "UNKNOWN"):
        flags[name.lower()] = is_(c("gated"), says(name))
        flags[f"visible_{name.lower()}"] = is_(c("visible"), says(name))
    per = seen.groupBy("day", "batch", "wallet").agg(F.count("*").alias("trades"), F.count_if("qualified").alias("qualified"), *(F.count_if(x).alias(n) for n, x in flags.items()))
    sums = ("trades", "qualified", *flags)
    own = {f"wallets_{n}": F.count_if((c(n) > 0) & c("wallet").isNotNull()) for n in ("production", "pass", "fail", "unknown")}
    batches = per.groupBy("day", "batch").agg(*(F.sum(n).alias(n) for n in sums), *(x.alias(n) for n, x in own.items()))
    return batches.groupBy("day").agg(*(F.sum(n).alias(n) for n in sums), *(F.min_by(n, "batch").alias(n) for n in own))


_COUNTS = {"production": "gated", "visible": "seen"} | {k: v for p in ("PASS", "FAIL", "UNKNOWN") for k, v in ((p.lower(), f"gated AND policy = '{p}'"), (f"visible_{p.lower()}", f"seen AND policy = '{p}'"))}


@query("A22_policy_coverage", f"""WITH o AS (SELECT day, id % 3 AS batch, wallet, stake_cents >= 50000 AS qualified, wallet % 3 > 0 AS gated, id % 4 > 0 AS seen, {_chosen(POLICY_SAYS, 'wallet // 2')} AS policy FROM v_feed), f AS (SELECT day, min(batch) AS batch FROM o GROUP BY day)
SELECT day, count(*) AS trades, count(*) FILTER (qualified) AS qualified, {', '.join(f'count(*) FILTER ({x}) AS {n}' for n, x in _COUNTS.items())}, {', '.join(f'count(DISTINCT wallet) FILTER ({_COUNTS[n]} AND o.batch = f.batch) AS wallets_{n}' for n in ('production', 'pass', 'fail', 'unknown'))} FROM o JOIN f USING (day) GROUP BY day""")
def policy_coverage_daily(spark: SparkSession, d: str) -> DataFrame:
    i, w = c("id"), c("wallet")
    return policy_coverage(feed(spark, d).select("day", (i % 3).alias("batch"), "wallet", (c("stake_cents") >= FEED_STAKE * 100).alias("qualified"), (w % 3 > 0).alias("gated"), (i % 4 > 0).alias("visible"), chosen(POLICY_SAYS, F.floor(w / 2)).alias("policy")))


def outcome(status: Column, validity: Column) -> Column:
    """How an audit of a wallet ended."""
    unsafe = holds(validity == "partial-and-metrics-unsafe")
    return (
        F.when(status.isin("deferred_infra", "failed"), "deferred-infra").when(status == "internal_error", "internal-error").when(status == "wallet_failed", "wallet-failed")
        .when(status == "unusable", F.when(unsafe, "metrics-unsafe").otherwise("unusable")).when(status == "complete", "metrics-safe").otherwise("not-attempted")
    )


def batch_summary(cohort: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for a batch of audits: outcomes of the cohort's wallets, decisions of complete ones, and the 50th, 90th and 95th percentile (nearest rank) of run times above 0.

    Wallets meet in lower case, of a wallet's rows the one with the largest run counts. Percentiles keep a count for each whole millisecond.
    """
    last = rows.groupBy(F.lower("wallet").alias("w")).agg(F.max_by(F.struct("status", "validity", "decision", "indexed", "ms"), "run").alias("r")).select("w", "r.*")
    met = cohort.withColumn("w", F.lower("wallet")).join(last, "w", "left").withColumn("outcome", outcome(c("status"), c("validity")))
    tried, safe = c("outcome") != "not-attempted", holds(c("status") == "complete")
    n = lambda x: F.count_if(holds(x))
    ms = F.when(tried & (c("ms") > 0), c("ms"))
    out = met.withColumn("timed", ms).agg(
        F.count("*").alias("cohort"), n(tried).alias("attempted"), *(n(c("outcome") == x).alias(x.replace("-", "_")) for x in ("metrics-safe", "metrics-unsafe", "unusable", "deferred-infra", "wallet-failed", "internal-error", "not-attempted")),
        n(safe & c("decision")).alias("production_pass"), n(safe & ~c("decision")).alias("production_fail"), n(safe & c("decision").isNull()).alias("production_unknown"), n(safe & c("indexed")).alias("indexed_pass"),
        n(safe & c("decision") & ~c("indexed")).alias("only_production"), n(safe & ~c("decision") & c("indexed")).alias("only_indexed"),
        *(F.coalesce(F.expr(f"percentile_disc({p / 100}) within group (order by timed)"), F.lit(0)).cast("long").alias(f"p{p}_ms") for p in (50, 90, 95)),
    )
    return out


STATUS = ("complete", "complete", "complete", "unusable", "failed", "deferred_infra", "wallet_failed", "internal_error", "complete", "other")


@query("A41_batch_summary", f"""WITH m AS (SELECT c_custkey AS k, c_custkey % 13 > 0 AS there FROM customer), r AS (SELECT k, CASE WHEN there THEN {_chosen(STATUS, 'k')} END AS status, CASE WHEN there THEN k % 4 = 1 END AS unsafe, CASE WHEN there AND k % 5 > 0 THEN k % 5 > 2 END AS decision, CASE WHEN there THEN k % 3 > 0 END AS indexed, CASE WHEN there THEN k * 7919 % 5000 END AS ms FROM m),
 o AS (SELECT *, CASE WHEN status IN ('deferred_infra', 'failed') THEN 'deferred-infra' WHEN status = 'internal_error' THEN 'internal-error' WHEN status = 'wallet_failed' THEN 'wallet-failed' WHEN status = 'unusable' THEN CASE WHEN unsafe THEN 'metrics-unsafe' ELSE 'unusable' END WHEN status = 'complete' THEN 'metrics-safe' ELSE 'not-attempted' END AS outcome FROM r),
 t AS (SELECT ms, row_number() OVER (ORDER BY ms) AS i, count(*) OVER () AS n FROM o WHERE outcome <> 'not-attempted' AND ms > 0)
SELECT count(*) AS cohort, count(*) FILTER (outcome <> 'not-attempted') AS attempted, {', '.join(f"count(*) FILTER (outcome = '{x}') AS {x.replace('-', '_')}" for x in ('metrics-safe', 'metrics-unsafe', 'unusable', 'deferred-infra', 'wallet-failed', 'internal-error', 'not-attempted'))},
 count(*) FILTER (status = 'complete' AND decision) AS production_pass, count(*) FILTER (status = 'complete' AND NOT decision) AS production_fail, count(*) FILTER (status = 'complete' AND decision IS NULL) AS production_unknown, count(*) FILTER (status = 'complete' AND indexed) AS indexed_pass,
 count(*) FILTER (status = 'complete' AND decision AND NOT indexed) AS only_production, count(*) FILTER (status = 'complete' AND NOT decision AND indexed) AS only_indexed, {', '.join(f'coalesce((SELECT min(ms) FILTER (i * 100 >= {p} * n) FROM t), 0)::BIGINT AS p{p}_ms' for p in (50, 90, 95))} FROM o""")
def batch_summary_of(spark: SparkSession, d: str) -> DataFrame:
    """Every customer is in the cohort; most have two rows in another case, of which the second run's counts."""
    k = c("c_custkey")
    named = table(spark, d, "customer").select(k, F.concat(F.lit("0xAb"), k).alias("wallet"))
    says = F.struct(chosen(STATUS, k).alias("status"), F.when(k % 4 == 1, "partial-and-metrics-unsafe").otherwise("complete").alias("validity"), F.when(k % 5 > 0, k % 5 > 2).alias("decision"), (k % 3 > 0).alias("indexed"), (k * 7919 % 5000).alias("ms"))
    rows = named.where("c_custkey % 13 > 0").select(k, F.upper("wallet").alias("wallet"), F.explode(F.array(F.lit(1), F.lit(2))).alias("run")).withColumn("s", says)
    return batch_summary(named.select("wallet"), rows.select("wallet", "run", F.when(c("run") == 2, c("s.status")).otherwise("failed").alias("status"), "s.validity", "s.decision", "s.indexed", "s.ms"))


def receipts(posts: DataFrame, sent: DataFrame, resolved: DataFrame) -> DataFrame:
    """Published posts (id, market) without a receipt, and what becomes of each: enqueued if its market is resolved to YES, else skipped with the reason.

    sent has the ids with a receipt (any number of rows each), resolved a row a market (condition, final, yes). Posts without a market are skipped.
    """
    open_ = posts.join(sent.select("id"), "id", "left_anti").join(resolved.withColumnRenamed("condition", "market"), "market", "left")
    won = holds(c("final") & c("yes"))
    return open_.select("id", "market", won.alias("enqueued"), F.when(~won, "market_not_resolved_yes").alias("reason"))


@query("C17_resolution_receipts", """SELECT id, market, won AS enqueued, CASE WHEN NOT won THEN 'market_not_resolved_yes' END AS reason FROM (SELECT p.id, market, coalesce(final AND winning_asset % 2 = 1, false) AS won FROM (SELECT id, CASE WHEN id % 10 > 0 THEN id % 400 END AS market FROM v_feed WHERE venue = 'polymarket') p
 LEFT JOIN v_resolution ON condition = market WHERE p.id NOT IN (SELECT event_id FROM events WHERE event_id % 6 = 0))""")
def resolution_receipts(spark: SparkSession, d: str) -> DataFrame:
    posts = feed(spark, d).where("venue = 'polymarket'").select("id", F.when(c("id") % 10 > 0, c("id") % 400).alias("market"))
    sent = table(spark, d, "events").where("event_id % 6 = 0").select(c("event_id").alias("id"))
    return receipts(posts, sent, resolution(spark, d).select("condition", "final", (c("winning_asset") % 2 == 1).alias("yes")))


def _of(name: str) -> str:
    return registry._oracles[name]  # noqa: SLF001


@query("C07_wallet_track_record", f"SELECT wallet, bets, closed, wins, pnl, roi, average, reliable, evaluated, valid, avg_ev, main FROM ({_of('A06_A12_track_record')}) LEFT JOIN ({_of('A32_cross_market_stats')}) USING (wallet)")
def wallet_track_record(spark: SparkSession, d: str) -> DataFrame:
    """A wallet's record with its edge across venues; both sides have a row a wallet."""
    return track_record(spark, d).join(cross_market_stats(spark, d), "wallet", "left").select("wallet", "bets", "closed", "wins", "pnl", "roi", "average", "reliable", "evaluated", "valid", "avg_ev", "main")
