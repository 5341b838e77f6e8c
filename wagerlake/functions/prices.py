"""Scalar pricing: columns in, a column out; null where a value is unusable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the domain.
PROB_EPS, TAKER_FEE, SLIPPAGE, KELLY, JS_EPS, LOGIT_SCALE = 1e-9, 0.07, 10 / 10_000, 0.25, 1e-6, 1.75


def clamp(p: Column, eps: float = PROB_EPS) -> Column:
    return F.when(p.isNull() | F.isnan(p), 0.5).otherwise(F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps)))


def half_up(x: Column, places: int) -> Column:
    """floor(x * 10^places + 0.5) / 10^places, as the products round."""
    return F.floor(x * 10**places + 0.5) / F.lit(float(10**places))


def microprice(bid: Column, ask: Column, bid_size: Column, ask_size: Column) -> Column:
    total = bid_size + ask_size
    mid = F.when(total > 0, (bid * ask_size + ask * bid_size) / F.nullif(total, F.lit(0.0))).otherwise((bid + ask) / 2)
    return F.when((bid > 0) & (ask > 0) & (bid < ask), clamp(mid))


def taker_fee(p: Column) -> Column:
    return TAKER_FEE * clamp(p) * (1 - clamp(p))


def slippage(p: Column) -> Column:
    return SLIPPAGE * clamp(p)


def gross_ev(p_true: Column, p_market: Column) -> Column:
    t, m = clamp(p_true), clamp(p_market)
    return t * (1 - m) - (1 - t) * m


def kelly(p_true: Column, p_market: Column, share: float = KELLY) -> Column:
    t, m = clamp(p_true), clamp(p_market)
    b = (1 - m) / m
    full = F.when(b > PROB_EPS, (t * b - (1 - t)) / b).otherwise(0.0)
    return F.least(F.greatest(full * share, F.lit(0.0)), F.lit(1.0))


def resting_mid(bid: Column, ask: Column, mid: Column) -> Column:
    return F.when((bid > 0) & (ask > 0) & (bid < ask), (bid + ask) / 2).otherwise(mid)


def liquidity_weight(bid: Column, ask: Column, mid: Column) -> Column:
    spread = F.when(bid.isNotNull() & ask.isNotNull(), F.greatest(ask - bid, F.lit(0.001))).otherwise(0.05)
    return F.coalesce(resting_mid(bid, ask, mid) * (1 / spread), F.lit(0.0))


def ev_percent(paid: Column, fair: Column) -> Column:
    return F.when(paid > 0, (fair - paid) / paid * 100)


def american_odds(odds: Column) -> Column:
    return F.when(odds > 0, 100 / (odds + 100)).when(odds < 0, F.abs(odds) / (F.abs(odds) + 100))


def normal_cdf(x: Column) -> Column:
    """The normal distribution by the polynomial 26.2.17 of Abramowitz and Stegun's handbook; its coefficients are fixed values."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    tail = 0.3989423 * F.exp(-x * x / 2) * t * (0.3193815 + t * (-0.3565638 + t * (1.781478 + t * (-1.821256 + t * 1.330274))))
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def poisson_over(rate: Column, line: Column) -> Column:
    """Probability of more than line events: 1 minus the terms below floor(line + 0.5)."""
    steps = F.sequence(F.lit(0), F.floor(line + 0.5).cast("int"))
    start = F.struct(F.exp(-rate).alias("term"), F.lit(0.0).alias("sum"))
    top = F.floor(line + 0.5)
    summed = F.aggregate(steps, start, lambda s, k: F.struct((s["term"] * rate / (k + 1)).alias("term"), F.when(k < top, s["sum"] + s["term"]).otherwise(s["sum"]).alias("sum")))
    return clamp(1 - summed["sum"])


def poisson_rate(line: Column, over: Column) -> Column:
    """The rate whose chance of more than line events is over: 64 halvings of [0.05, 40]."""
    target = clamp(over)
    start = F.struct(F.lit(0.05).alias("lo"), F.lit(40.0).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        high = poisson_over(mid, line) > target
        return F.struct(F.when(high, s["lo"]).otherwise(mid).alias("lo"), F.when(high, mid).otherwise(s["hi"]).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, halve)
    return (found["lo"] + found["hi"]) / 2


def js_divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence of two coins."""
    p, q = clamp(p, JS_EPS), clamp(q, JS_EPS)
    m = 0.5 * (p + q)
    kl = lambda x: x * F.ln(x / m) + (1 - x) * F.ln((1 - x) / (1 - m))
    return 0.5 * kl(p) + 0.5 * kl(q)


def shifted(prior: Column, impact: Column, confidence: Column) -> Column:
    p = clamp(prior, JS_EPS)
    return clamp(1 / (1 + F.exp(-(F.ln(p / (1 - p)) + LOGIT_SCALE * impact * confidence))), JS_EPS)


def box_cost(a: Column, b: Column) -> Column:
    return half_up(a + b, 4)
