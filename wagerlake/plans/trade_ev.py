"""What a trade was worth when it was made: the last fresh word of every source, a ladder of fair prices, and the EV of the price paid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wagerlake.functions import prices as P
from wagerlake.plans.evidence import finite, placeholder
from wagerlake.registry import query
from wagerlake.sources.carriers import cents, feed

c = F.col
#: Seconds for which a source's word is fresh.
AGES = {"pm_book": 10, "kalshi_book": 10, "mapping": 300, "ensemble": 1800, "consensus": 1800, "cached": 1800}
#: Confidence below which a fair price counts as a weak one, size of a book without both sides.
LOW_CONFIDENCE, NO_SIDES = 0.35, 0.05
_FAIR = "struct<p_true:double,source:string,confidence:double,mode:string>"


def as_of(asks: DataFrame, quotes: DataFrame, ages: dict[str, int] = AGES) -> DataFrame:
    """asks (market, ts, ...) with a column for each source: the struct q of its last quote (source, market, ts, seq, q) at or before ts and at most its age old, or null.

    Asks and quotes are one table, dealt by market and cell of time: one exchange for all sources. A cell is as long as the largest age, and a quote stands in its
    own and the next one, so no ask looks further back and no market is one task. Quotes of one source and time count by seq, then by q. A null market or time meets nothing.
    """
    size = max(ages.values())
    cell = F.floor(c("ts") / size).cast("long")
    q = quotes.where(c("source").isin(*ages) & c("market").isNotNull() & c("ts").isNotNull()).withColumn("_cell", F.explode(F.array(cell, cell + 1)))
    q = q.select("market", "_cell", "ts", F.lit(0).alias("_ask"), F.struct("ts", "seq", "q").alias("_said"), c("source").alias("_source"), F.lit(None).cast(asks.select(F.struct("*")).schema[0].dataType).alias("_row"))
    kind = q.schema["_said"].dataType
    a = asks.select("market", cell.alias("_cell"), "ts", F.lit(1).alias("_ask"), F.lit(None).cast(kind).alias("_said"), F.lit(None).cast("string").alias("_source"), F.struct("*").alias("_row"))
    lone = c("market").isNull() | c("ts").isNull()
    by = Window.partitionBy("market", "_cell").orderBy("ts", "_ask", "_said").rowsBetween(Window.unboundedPreceding, 0)
    last = {s: F.last(F.when(c("_source") == s, c("_said")), ignorenulls=True).over(by) for s in ages}
    met = a.where(~lone).unionByName(q).select("_ask", "ts", "_row", *(x.alias(f"_{s}") for s, x in last.items())).where("_ask = 1")
    fresh = [F.when(c("ts") - c(f"_{s}.ts") <= age, c(f"_{s}.q")).alias(s) for s, age in ages.items()]
    none = [F.lit(None).cast(kind["q"].dataType).alias(s) for s in ages]
    return met.select("_row.*", *fresh).unionByName(a.where(lone).select("_row.*", *none))


def paid(raw: Column) -> Column:
    """A price paid as a probability: a fraction up to 1, percent up to 100, none else."""
    return F.when(finite(raw) & (raw > 0) & (raw <= 1), raw).when(finite(raw) & (raw > 1) & (raw <= 100), raw / 100)


def resting(book: Column) -> Column:
    return F.when(book.isNotNull(), P.resting_mid(book["bid"], book["ask"], F.when(finite(book["mid"]), book["mid"])))


def cross_mid(pm: Column, kalshi: Column, a: Column, b: Column) -> Column:
    """The middle of two venues' books (a and b are their resting middles), weighted by how tight they are; of one book, its own middle."""
    weight = lambda book, mid: F.coalesce(F.nullif(P.liquidity_weight(book["bid"], book["ask"], book["mid"]), F.lit(0.0)), mid)
    x, y = weight(pm, a), weight(kalshi, b)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise((a * x + b * y) / (x + y))


def with_mids(df: DataFrame) -> DataFrame:
    """df with a and b, the resting middles of pm_book and kalshi_book, then cross, own and prior: columns, so that no expression carries another one over and over."""
    df = df.withColumns({"a": resting(c("pm_book")), "b": resting(c("kalshi_book"))})
    prior = F.when(c("a").isNotNull() & c("b").isNotNull(), (c("a") + c("b")) / 2).otherwise(F.coalesce("a", "b", F.lit(0.5)))
    return df.withColumns({"cross": cross_mid(c("pm_book"), c("kalshi_book"), c("a"), c("b")), "own": F.when(c("platform") == "polymarket", c("a")).otherwise(c("b")), "prior": prior})


def fair_price(pair: Column, polymarket: Column, cross: Column, own: Column, prior: Column, consensus: Column, ensemble: Column, execution: Column) -> Column:
    """The first step of the ladder that has a price (struct of p_true, source, confidence, mode): books of both venues of a mapped pair, ensemble, consensus,
    the venue's own book, the price paid, a prior. Where a book or the consensus leads, an ensemble gives the price. All prices are usable or null, an ensemble that is a placeholder is null too."""

    def step(when: Column, price: Column, source: str, alone: float, mode: str, led: float | None = None) -> Column:
        p = F.coalesce(ensemble, price) if led is not None else price
        name, sure = (F.when(ensemble.isNotNull(), x).otherwise(y) for x, y in (("cached_ensemble", source), (led if led is not None else alone, alone)))
        plain = F.lit(source), F.lit(alone)
        name, sure = (name, sure) if led is not None else plain
        return F.when(when & price.isNotNull(), F.struct(P.clamp(p).alias("p_true"), name.alias("source"), sure.cast("double").alias("confidence"), F.lit(mode).alias("mode")).cast(_FAIR))

    yes = F.lit(True)
    return F.coalesce(
        step(pair, cross, "cross_venue_ob", 0.85, "paired_cross", 0.8), step(pair, ensemble, "cached_ensemble", 0.75, "paired_cross"), step(pair, consensus, "sportsbook_consensus", 0.7, "exchange_consensus"),
        step(~pair & polymarket, consensus, "sportsbook_consensus", 0.7, "exchange_consensus", 0.75), step(yes, own, "standalone_ob", 0.8, "standalone_resting", 0.75), step(~pair, ensemble, "cached_ensemble", 0.65, "standalone_resting"),
        step(yes, consensus, "sportsbook_consensus", 0.6, "exchange_consensus"), step(yes, execution, "execution_price", 0.25, "standalone_resting"),
        step(pair, prior, "universal_prior", 0.1, "paired_cross"), step(yes, prior, "universal_prior", 0.1, "standalone_resting"),
    )


def percent(ev: Column) -> Column:
    """EV in percent to one decimal."""
    return F.floor(ev * 1000 + 0.5) / 10


def priced(fair: Column, market: Column, polymarket: Column) -> Column:
    """struct of gross and net: what the fair price gives over the market's, in percent, net of the venue's fee or slippage."""
    gross = P.gross_ev(fair["p_true"], market)
    return F.struct(percent(gross).alias("gross"), percent(gross - F.when(polymarket, P.slippage(market)).otherwise(P.taker_fee(market))).alias("net"))


def trade_ev(asks: DataFrame, quotes: DataFrame, ages: dict[str, int] = AGES) -> DataFrame:
    """asks (id, market, ts, platform, mapped, price) with status, p_true, source, confidence, weak, mode, p_market, gross, net.

    q of a quote has bid, ask, mid, p. A fresh cached EV is priced anew with the books of the moment, its fair price standing in for a missing ensemble; it counts unless
    nothing was paid and its net is 0, then the ladder decides without it. Trades without a market (mapped false) are unmapped and have no EV.
    """
    usable = lambda p: F.when(~placeholder(p, F.lit(None).cast("string"), F.lit(None).cast("double")), p)
    met = with_mids(as_of(asks, quotes, ages))
    met = met.withColumns({"execution": paid(c("price")), "polymarket": c("platform") == "polymarket", "pair": c("mapping").isNotNull(), "agreed": F.when(finite(c("consensus.mid")), c("consensus.mid")), "known": usable(c("ensemble.p")), "kept": usable(c("cached.p"))})
    met = met.withColumns({"either": F.coalesce("known", "kept"), "p_market": F.coalesce("execution", "own", "prior")})
    ladder = lambda ensemble: fair_price(c("pair"), c("polymarket"), c("cross"), c("own"), c("prior"), c("agreed"), c(ensemble), c("execution"))
    met = met.withColumns({"live": ladder("known"), "again": ladder("either")})
    met = met.withColumns({"live_ev": priced(c("live"), c("p_market"), c("polymarket")), "again_ev": priced(c("again"), c("p_market"), c("polymarket"))})
    cached = c("cached").isNotNull() & (c("execution").isNotNull() | (c("again_ev.net") != 0))
    met = met.withColumn("fair", F.when(cached, c("again")).otherwise(c("live"))).withColumn("ev", F.when(cached, c("again_ev")).otherwise(c("live_ev")))
    ok = F.coalesce("mapped", F.lit(False))
    show = lambda x, name: F.when(ok, x).alias(name)
    return met.select(
        "id", F.when(ok, "ok").otherwise("unmapped").alias("status"), show(cached, "from_cache"), show(c("fair.p_true"), "p_true"), show(c("fair.source"), "source"), show(c("fair.confidence"), "confidence"), show(c("fair.confidence") < LOW_CONFIDENCE, "weak"),
        show(c("fair.mode"), "mode"), show(c("p_market"), "p_market"), show(c("ev.gross"), "gross"), show(c("ev.net"), "net"),
    )


#: Markets of the query, and by how much its clock is slowed so that sources are fresh now and then.
MARKETS, SLOWER = 60, 600


def _asks_and_quotes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    i, ts = c("id"), F.floor(c("ts") / SLOWER).cast("long")
    f = feed(spark, d)
    asks = f.select("id", (i % MARKETS).alias("market"), ts.alias("ts"), c("venue").alias("platform"), (i % 29 > 0).alias("mapped"), F.when(i % 10 == 0, None).when(i % 8 == 1, (i * 31 % 100).cast("double")).otherwise(cents(i * 31 % 100)).alias("price"))
    low = cents(i * 13 % 90 + 3)
    said = F.struct(F.when(i % 5 > 0, low).alias("bid"), F.when(i % 7 > 0, low + cents(i % 4)).alias("ask"), F.when(i % 11 > 0, low).alias("mid"), F.when(i % 4 == 0, 0.5).otherwise(cents(i * 17 % 100)).alias("p"))
    names = F.array(*map(F.lit, AGES))
    return asks, f.select(F.get(names, (F.floor(i / 2) % 6).cast("int")).alias("source"), (i * 7 % MARKETS).alias("market"), ts.alias("ts"), i.alias("seq"), said.alias("q"))


_NAMES = "[" + ", ".join(f"'{s}'" for s in AGES) + "]"
_AGE = "CASE source " + " ".join(f"WHEN '{s}' THEN {a}" for s, a in AGES.items()) + " END"
_REST = "CASE WHEN {b}.bid > 0 AND {b}.ask > 0 AND {b}.bid < {b}.ask THEN ({b}.bid + {b}.ask) / 2 ELSE {b}.mid END"
_WEIGHT = "coalesce(nullif(coalesce({m} * (1 / CASE WHEN {b}.bid IS NOT NULL AND {b}.ask IS NOT NULL THEN greatest({b}.ask - {b}.bid, 0.001::DOUBLE) ELSE 0.05 END), 0), 0), {m})"


def _ladder_sql(e: str) -> str:
    s = lambda when, price, source, alone, mode, led=None: f"WHEN ({when}) AND {price} IS NOT NULL THEN struct_pack(p := " + (f"coalesce({e}, {price})" if led else price) + ", s := " + (f"CASE WHEN {e} IS NOT NULL THEN 'cached_ensemble' ELSE '{source}' END" if led else f"'{source}'") + ", c := " + (f"CASE WHEN {e} IS NOT NULL THEN {led} ELSE {alone} END::DOUBLE" if led else f"{alone}::DOUBLE") + f", m := '{mode}')"
    return "CASE " + " ".join((
        s("pair", "cross_mid", "cross_venue_ob", 0.85, "paired_cross", 0.8), s("pair", e, "cached_ensemble", 0.75, "paired_cross"), s("pair", "cons", "sportsbook_consensus", 0.7, "exchange_consensus"), s("NOT pair AND pmk", "cons", "sportsbook_consensus", 0.7, "exchange_consensus", 0.75),
        s("true", "own", "standalone_ob", 0.8, "standalone_resting", 0.75), s("NOT pair", e, "cached_ensemble", 0.65, "standalone_resting"), s("true", "cons", "sportsbook_consensus", 0.6, "exchange_consensus"), s("true", "ex", "execution_price", 0.25, "standalone_resting"),
        s("pair", "prior", "universal_prior", 0.1, "paired_cross"), s("true", "prior", "universal_prior", 0.1, "standalone_resting"),
    )) + " END"


_CL = "least(greatest({}, 1e-9::DOUBLE), 1 - 1e-9::DOUBLE)"
_GROSS = f"({_CL.format('{f}.p')} * (1 - {_CL.format('mk')}) - (1 - {_CL.format('{f}.p')}) * {_CL.format('mk')})"
_DRAG = f"CASE WHEN pmk THEN 0.001::DOUBLE * {_CL.format('mk')} ELSE 0.07::DOUBLE * {_CL.format('mk')} * (1 - {_CL.format('mk')}) END"


@query("C05_C06_M10_M11_trade_ev", f"""WITH f AS (SELECT id, venue, ts // {SLOWER} AS ts FROM v_feed), a AS (SELECT id, id % {MARKETS} AS market, ts, venue = 'polymarket' AS pmk, id % 29 > 0 AS mapped, CASE WHEN id % 10 = 0 THEN NULL WHEN id % 8 = 1 THEN (id * 31 % 100)::DOUBLE ELSE (id * 31 % 100) / 100.0::DOUBLE END AS price FROM f),
q AS (SELECT ({_NAMES})[id // 2 % 6 + 1] AS source, id * 7 % {MARKETS} AS market, ts, id AS seq, struct_pack(bid := CASE WHEN id % 5 > 0 THEN (id * 13 % 90 + 3) / 100.0::DOUBLE END, ask := CASE WHEN id % 7 > 0 THEN (id * 13 % 90 + 3) / 100.0::DOUBLE + (id % 4) / 100.0::DOUBLE END, mid := CASE WHEN id % 11 > 0 THEN (id * 13 % 90 + 3) / 100.0::DOUBLE END, p := CASE WHEN id % 4 = 0 THEN 0.5::DOUBLE ELSE (id * 17 % 100) / 100.0::DOUBLE END) AS q FROM f),
l AS (SELECT a.id, source, arg_max(q.q, struct_pack(t := q.ts, s := seq)) AS q FROM a JOIN q ON q.market = a.market AND q.ts <= a.ts AND a.ts - q.ts <= {_AGE} GROUP BY ALL),
w AS (SELECT a.*, {", ".join(f"any_value(l.q) FILTER (source = '{s}') AS {s}" for s in AGES)}, count(*) FILTER (source = 'mapping') > 0 AS pair, count(*) FILTER (source = 'cached') > 0 AS has FROM a LEFT JOIN l USING (id) GROUP BY ALL),
x AS (SELECT *, {_REST.format(b="pm_book")} AS ra, {_REST.format(b="kalshi_book")} AS rb, consensus.mid AS cons, CASE WHEN price > 0 AND price <= 1 THEN price WHEN price > 1 AND price <= 100 THEN price / 100 END AS ex, CASE WHEN abs(ensemble.p - 0.5) > 1e-6 THEN ensemble.p END AS en, CASE WHEN abs(cached.p - 0.5) > 1e-6 THEN cached.p END AS ca FROM w),
y AS (SELECT *, {_WEIGHT.format(b="pm_book", m="ra")} AS wa, {_WEIGHT.format(b="kalshi_book", m="rb")} AS wb, CASE WHEN pmk THEN ra ELSE rb END AS own, CASE WHEN ra IS NOT NULL AND rb IS NOT NULL THEN (ra + rb) / 2 ELSE coalesce(ra, rb, 0.5) END AS prior, coalesce(en, ca) AS en2 FROM x),
z AS (SELECT *, CASE WHEN ra IS NULL THEN rb WHEN rb IS NULL THEN ra ELSE (ra * wa + rb * wb) / (wa + wb) END AS cross_mid, coalesce(ex, own, prior) AS mk FROM y),
r AS (SELECT *, {_ladder_sql("en")} AS live, {_ladder_sql("en2")} AS again FROM z),
s AS (SELECT *, floor(({_GROSS.format(f="again")} - {_DRAG}) * 1000 + 0.5) / 10 AS again_net FROM r),
t AS (SELECT *, has AND (ex IS NOT NULL OR again_net <> 0) AS cache, CASE WHEN has AND (ex IS NOT NULL OR again_net <> 0) THEN again ELSE live END AS fair FROM s)
SELECT id, CASE WHEN mapped THEN 'ok' ELSE 'unmapped' END AS status, CASE WHEN mapped THEN cache END AS from_cache, CASE WHEN mapped THEN floor({_CL.format("fair.p")} * 1000000 + 0.5) / 1000000 END AS p_true, CASE WHEN mapped THEN fair.s END AS source, CASE WHEN mapped THEN fair.c END AS confidence, CASE WHEN mapped THEN fair.c < 0.35 END AS weak, CASE WHEN mapped THEN fair.m END AS mode,
 CASE WHEN mapped THEN floor(mk * 1000000 + 0.5) / 1000000 END AS p_market, CASE WHEN mapped THEN floor({_GROSS.format(f="fair")} * 1000 + 0.5) / 10 END AS gross, CASE WHEN mapped THEN floor(({_GROSS.format(f="fair")} - {_DRAG}) * 1000 + 0.5) / 10 END AS net FROM t""")
def trade_evs(spark: SparkSession, d: str) -> DataFrame:
    """EV of every trade of the feed by what six sources said about its market when it was made."""
    asks, quotes = _asks_and_quotes(spark, d)
    return trade_ev(asks, quotes).withColumns({x: P.half_up(c(x), 6) for x in ("p_true", "p_market")})
