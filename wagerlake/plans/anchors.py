"""Derivative markets priced from the market of their event that was priced before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wagerlake.functions import prices as P
from wagerlake.plans.exchange import _sql_cdf, _sql_inverse, clamped, normal_inverse
from wagerlake.registry import query
from wagerlake.sources.carriers import games

c = F.col
#: Volatility by unit, pull of a nomination towards one half, spread of a bracket, swing of a condition, and how a lead becomes a margin.
VOLATILITY, PULL, SPREAD, SWING, LEAD, MARGIN_SPREAD = {"percent": 0.07, "usd": 0.25, None: 0.1}, 0.85, 0.12, (0.52, 0.35), 20, 4


def ordered(markets: DataFrame) -> DataFrame:
    """markets with store (whose anchors a market uses), primary and priority. Of several financial strikes of an event only the lowest may stay primary; primaries
    come first, then totals, other sports, financial ones by strike, politics, the rest, and last what isn't known to be a derivative."""
    money = (c("class") == "financial") & c("strike").isNotNull() & (c("strike") != 0)
    by = Window.partitionBy("class", "event", money).orderBy("strike", "id")
    m = markets.withColumn("rank", F.row_number().over(by))
    m = m.withColumn("primary", F.coalesce("primary", F.lit(False)) & ~(money & (c("rank") > 1))).drop("rank")
    later = F.when(c("class") == "sports", F.when(c("kind") == "total", 11.0).otherwise(12.0)).when(c("class") == "financial", 20 + F.coalesce("strike", F.lit(0.0)) / 1_000_000).when(c("class") == "politics", 30.0).when(c("class").isNotNull(), 40.0).otherwise(100.0)
    return m.withColumns({"store": F.when(c("class").isin("financial", "other"), "financial").otherwise(c("class")), "priority": F.when(c("primary") & c("class").isNotNull(), 0.0).otherwise(later)})


def politics(kind: Column, low: Column, high: Column, p: Column) -> Column:
    """Struct of p and method from the anchor's price; null for kinds that don't follow from it."""
    high = F.coalesce(high, low)
    scale = F.when(high > 100, 538.0).when(high > 50, 100.0).otherwise(1.0)
    mean = clamped(0.5 + (p - 0.5) * PULL) * scale
    z = lambda x: P.normal_cdf((x - mean) / (scale * SPREAD))
    of = lambda x, name: F.struct(x.alias("p"), F.lit(name).alias("method"))
    return (
        F.when((kind == "bracket") & low.isNotNull(), of(clamped(z(high) - z(low)), "politics_bracket_tree"))
        .when(kind == "conditional", of(clamped(p * clamped(SWING[0] + SWING[1] * (p - 0.5))), "politics_conditional_tree"))
        .when(kind == "margin", of(clamped(P.normal_cdf(((p - 0.5) * LEAD - F.coalesce(low, F.lit(0.0))) / MARGIN_SPREAD)), "politics_margin_tree"))
    )


def derived(markets: DataFrame) -> DataFrame:
    """id, priority, anchor, p, method for markets (id, class, event, primary, kind, direction, strike, low, high, unit, p_true, prior).

    A market that is primary, or can't be derived, or has no anchor yet keeps p_true (method ensemble) and becomes the anchor of what follows in its event and store, if it can be
    one: financial anchors need a strike. Others take their price from the anchor before them, brackets as the mass between two tails. Order is by priority, ties
    by id. All of it is one window by event, so a chain costs no rounds.
    """
    m = ordered(markets)
    fin, pol = c("store") == "financial", c("store") == "politics"
    bracket = c("low").isNotNull() & c("high").isNotNull() & (c("direction") == "between")
    can = F.coalesce(F.when(fin, bracket | c("strike").isNotNull()).when(pol, ((c("kind") == "bracket") & c("low").isNotNull()) | c("kind").isin("conditional", "margin")), F.lit(False))
    able = F.coalesce(F.when(fin, c("strike").isNotNull()).when(pol, F.lit(True)), F.lit(False))
    order = Window.partitionBy("store", "event").orderBy("priority", "id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumns({"can": can, "able": able}).withColumn("first", c("able") & ~F.coalesce(F.max("able").over(before), F.lit(False)))
    sets = c("able") & (c("primary") | ~c("can") | c("first"))
    up = F.when(c("direction") == "below", False).when(c("direction") == "above", True).otherwise(c("prior") >= 0.5)
    said = F.struct("id", clamped(c("p_true")).alias("p"), "strike", up.alias("above"), (c("unit") == "usd").alias("usd"), F.when(c("unit") == "percent", VOLATILITY["percent"]).when(c("unit") == "usd", VOLATILITY["usd"]).otherwise(VOLATILITY[None]).alias("volatility"))
    m = m.withColumn("a", F.last(F.when(sets, said), ignorenulls=True).over(before))
    m = m.withColumn("z", normal_inverse(F.when(c("a.above"), c("a.p")).otherwise(1 - c("a.p"))))

    def tail(strike: Column, asks: Column) -> Column:
        """The quantile beyond strike, seen from the anchor's, as exchange.tail_probability has it."""
        money = F.coalesce("a.usd", F.lit(False)) & (c("a.strike") > 0) & (strike > 0)
        z = c("z") - F.when(money, F.log(strike / c("a.strike")) / c("a.volatility")).otherwise((strike - c("a.strike")) / (c("a.volatility") * 100))
        return F.when(asks == c("a.above"), z).otherwise(-z)

    asks = F.when(c("direction") == "below", False).when(c("direction") == "above", True).otherwise(c("a.above"))
    m = m.withColumns({"z_low": tail(c("low"), F.lit(True)), "z_high": tail(c("high"), F.lit(True)), "z_strike": tail(c("strike"), asks)})
    chance = lambda z: clamped(P.normal_cdf(c(z)))
    mass = F.struct(clamped(chance("z_low") - chance("z_high")).alias("p"), F.lit("financial_bracket_interp").alias("method"))
    alone = F.struct(chance("z_strike").alias("p"), F.lit("financial_vol_interp").alias("method"))
    from_anchor = F.when(fin & bracket, mass).when(fin, alone).otherwise(politics(c("kind"), c("low"), c("high"), c("a.p")))
    m = m.withColumn("d", F.when(~c("primary") & c("can") & c("a").isNotNull(), from_anchor))
    return m.select("id", "priority", F.when(c("d").isNotNull(), c("a.id")).alias("anchor"), F.coalesce("d.p", "p_true").alias("p"), F.coalesce("d.method", F.lit("ensemble")).alias("method"))


_M = """SELECT market AS id, ([NULL, 'financial', 'politics', 'other', 'financial', 'politics', 'sports'])[market // 12 % 7 + 1] AS class, market // 12 AS event, market % 12 = 5 OR market % 36 = 7 AS prim, (['bracket', 'conditional', 'margin', 'winner', 'total'])[market % 5 + 1] AS kind, (['above', 'below', 'between', NULL])[market % 4 + 1] AS direction,
 CASE WHEN market % 4 <> 2 AND market % 9 > 0 THEN (market * 37 % 90 + 50)::DOUBLE END AS strike, CASE WHEN market % 6 > 0 THEN (market * 7 % 40)::DOUBLE END AS low, CASE WHEN market % 5 > 0 THEN (market * 7 % 40 + market % 70)::DOUBLE END AS high, (['usd', 'percent', NULL])[market % 3 + 1] AS unit, (market * 29 % 97 + 2) / 100.0::DOUBLE AS p_true, (market * 31 % 100) / 100.0::DOUBLE AS prior FROM v_games"""
_C = "greatest(0.001::DOUBLE, least(0.999::DOUBLE, {}))"


def _tail_sql(strike: str, asks: str) -> str:
    z = f"(({_sql_inverse('CASE WHEN a.above THEN a.p ELSE 1 - a.p END')}) - CASE WHEN a.usd AND a.strike > 0 AND {strike} > 0 THEN ln({strike} / a.strike) / a.vol ELSE ({strike} - a.strike) / (a.vol * 100) END)"
    return _C.format(_sql_cdf(f"(CASE WHEN {asks} = a.above THEN {z} ELSE -{z} END)"))


@query("K11_M40_M41_anchored", f"""WITH m AS (SELECT *, class = 'financial' AND strike IS NOT NULL AS money FROM ({_M})), r AS (SELECT *, row_number() OVER (PARTITION BY class, event, money ORDER BY strike, id) AS rank FROM m),
o AS (SELECT * REPLACE (prim AND NOT coalesce(money AND rank > 1, false) AS prim), CASE WHEN class IN ('financial', 'other') THEN 'financial' ELSE class END AS store FROM r),
p AS (SELECT *, CASE WHEN prim AND class IS NOT NULL THEN 0 WHEN class = 'sports' THEN CASE WHEN kind = 'total' THEN 11 ELSE 12 END WHEN class = 'financial' THEN 20 + coalesce(strike, 0) / 1000000 WHEN class = 'politics' THEN 30 WHEN class IS NOT NULL THEN 40 ELSE 100 END::DOUBLE AS priority, low IS NOT NULL AND high IS NOT NULL AND coalesce(direction = 'between', false) AS bracket FROM o),
q AS (SELECT *, coalesce(CASE store WHEN 'financial' THEN bracket OR strike IS NOT NULL WHEN 'politics' THEN (kind = 'bracket' AND low IS NOT NULL) OR kind IN ('conditional', 'margin') END, false) AS can, coalesce(CASE store WHEN 'financial' THEN strike IS NOT NULL WHEN 'politics' THEN true END, false) AS able FROM p),
f AS (SELECT *, able AND NOT coalesce(bool_or(able) OVER (PARTITION BY store, event ORDER BY priority, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS fst FROM q),
s AS (SELECT *, last_value(CASE WHEN able AND (prim OR NOT can OR fst) THEN struct_pack(id := id, p := {_C.format("p_true")}, strike := strike, above := CASE direction WHEN 'below' THEN false WHEN 'above' THEN true ELSE prior >= 0.5 END, usd := coalesce(unit = 'usd', false), vol := CASE unit WHEN 'percent' THEN 0.07 WHEN 'usd' THEN 0.25 ELSE 0.1 END::DOUBLE) END IGNORE NULLS) OVER (PARTITION BY store, event ORDER BY priority, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a FROM f),
t AS (SELECT *, NOT prim AND can AND a IS NOT NULL AS der, coalesce(high, low) AS hi, CASE WHEN coalesce(high, low) > 100 THEN 538 WHEN coalesce(high, low) > 50 THEN 100 ELSE 1 END::DOUBLE AS scale FROM s), u AS (SELECT *, {_C.format("0.5 + (a.p - 0.5) * 0.85::DOUBLE")} * scale AS mean, CASE direction WHEN 'below' THEN false WHEN 'above' THEN true ELSE a.above END AS asks FROM t),
v AS (SELECT *, CASE WHEN store = 'financial' AND bracket THEN {_C.format(f"{_tail_sql('low', 'true')} - {_tail_sql('high', 'true')}")} WHEN store = 'financial' THEN {_tail_sql("strike", "asks")} WHEN kind = 'bracket' THEN {_C.format(f"({_sql_cdf('((hi - mean) / (scale * 0.12::DOUBLE))')}) - ({_sql_cdf('((low - mean) / (scale * 0.12::DOUBLE))')})")}
 WHEN kind = 'conditional' THEN {_C.format("a.p * " + _C.format("0.52::DOUBLE + 0.35::DOUBLE * (a.p - 0.5)"))} WHEN kind = 'margin' THEN {_C.format(_sql_cdf("(((a.p - 0.5) * 20 - coalesce(low, 0)) / 4)"))} END AS d FROM u)
SELECT id, priority, CASE WHEN der THEN a.id END AS anchor, floor(CASE WHEN der THEN d ELSE p_true END * 1e5 + 0.5) / 1e5 AS p, CASE WHEN NOT der THEN 'ensemble' WHEN store = 'financial' AND bracket THEN 'financial_bracket_interp' WHEN store = 'financial' THEN 'financial_vol_interp' ELSE 'politics_' || kind || '_tree' END AS method FROM v""")
def anchored(spark: SparkSession, d: str) -> DataFrame:
    """Prices of derivative markets of events of twelve, of all classes, kinds and gaps."""
    m, half = c("market"), F.floor(c("market") / 12).cast("long")
    pick = lambda xs, at: F.get(F.array(*map(F.lit, xs)), at.cast("int"))
    low, high = F.when(m % 6 > 0, (m * 7 % 40).cast("double")), F.when(m % 5 > 0, (m * 7 % 40 + m % 70).cast("double"))
    g = games(spark, d).select(
        m.alias("id"), pick((None, "financial", "politics", "other", "financial", "politics", "sports"), half % 7).alias("class"), half.alias("event"), ((m % 12 == 5) | (m % 36 == 7)).alias("primary"), pick(("bracket", "conditional", "margin", "winner", "total"), m % 5).alias("kind"), pick(("above", "below", "between", None), m % 4).alias("direction"),
        F.when((m % 4 != 2) & (m % 9 > 0), (m * 37 % 90 + 50).cast("double")).alias("strike"), low.alias("low"), high.alias("high"), pick(("usd", "percent", None), m % 3).alias("unit"), ((m * 29 % 97 + 2) / F.lit(100.0)).alias("p_true"), (m * 31 % 100 / F.lit(100.0)).alias("prior"),
    )
    return derived(g).withColumn("p", P.half_up(c("p"), 5))
