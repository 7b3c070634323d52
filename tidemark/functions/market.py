"""Scalar expressions on quotes, trades and options."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the double-precision rational approximation of the normal
# distribution (Hart 1968, in the form of West 2005), highest power first.
CDF_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
CDF_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def mid(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2.0


def microprice(bid: Column, ask: Column, bid_sz: Column, ask_sz: Column) -> Column:
    """Size-weighted price leaning to the thinner side; the mid for an empty book."""
    total = bid_sz + ask_sz
    return F.when(total <= 0, mid(bid, ask)).otherwise((ask * bid_sz + bid * ask_sz) / total)


def book_imbalance(bid_sz: Column, ask_sz: Column) -> Column:
    total = bid_sz + ask_sz
    return F.when(total <= 0, 0.0).otherwise((bid_sz - ask_sz) / total)


def log_ratio(now: Column, then: Column) -> Column:
    """ln(now / then), 0 if either is missing or not positive."""
    return F.when((now > 0) & (then > 0), F.log(now / then)).otherwise(0.0)


def _polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, absolute error under 1e-14."""
    a = F.abs(z)
    e = F.exp(-a * a / 2.0)
    near = e * _polynomial(CDF_TOP, a) / _polynomial(CDF_BOTTOM, a)
    far = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        far = a + F.lit(k) / far
    tail = F.when(a > 37, 0.0).when(a < 7.07106781186547, near).otherwise(e / far / 2.506628274631)
    return F.when(z > 0, 1.0 - tail).otherwise(tail)


def call_value(s: Column, k: Column, tau: Column, sigma: Column) -> dict[str, Column]:
    """Black-Scholes price, delta, gamma and vega of a call without rates; sigma >= 1e-6, tau >= 1e-8."""
    root = F.greatest(sigma, F.lit(1e-6)) * F.sqrt(F.greatest(tau, F.lit(1e-8)))
    d1 = F.log(s / k) / root + root / 2.0
    density = F.exp(-d1 * d1 / 2.0) / 2.5066282746310002
    return {
        "price": s * normal_cdf(d1) - k * normal_cdf(d1 - root),
        "delta": normal_cdf(d1),
        "gamma": density / (s * root),
        "vega": s * density * F.sqrt(F.greatest(tau, F.lit(1e-8))),
    }


def quotes_around(fair: Column, inventory: Column, sigma: Column, *, gamma: float, kappa: float, horizon: float = 1.0, tick: float = 0.01, limit: int = 100, drift: Column | None = None, toxicity: Column | None = None) -> dict[str, Column]:
    """Reservation price and bid/ask around it, on ticks; a full inventory pulls one side to infinity."""
    risk = F.lit(gamma * max(horizon, 1e-9)) * sigma * sigma
    reservation = fair + (drift if drift is not None else 0.0) - inventory * risk
    half = (risk / 2.0 + F.log(F.lit(1.0 + gamma / kappa)) / gamma) * (1.0 + (toxicity if toxicity is not None else 0.0))
    bid = F.floor((reservation - half) / tick) * tick
    ask = F.ceil((reservation + half) / tick) * tick
    return {
        "reservation": reservation,
        "half_spread": half,
        "bid": F.when(inventory >= limit, F.lit(float("-inf"))).otherwise(bid),
        "ask": F.when(inventory <= -limit, F.lit(float("inf"))).otherwise(ask),
    }


def gamma_cap_scale(minute: Column, start: int = 300, end: int = 385, floor: float = 0.10) -> Column:
    """1 before ``start``, ``floor`` from ``end`` on, linear between."""
    between = 1.0 - (1.0 - floor) * (minute - start) / float(end - start)
    return F.when(minute < start, 1.0).when(minute >= end, floor).otherwise(between)


def aggressor_sign(maker_side: Column) -> Column:
    """The taker is on the other side: a resting bid was sold into."""
    return F.when(F.lower(maker_side).startswith("b"), -1).otherwise(1)


def close_weight(minute: Column, scale: float = 90.0, close_minute: int = 20 * 60) -> Column:
    """exp(-minutes to the close / scale), by UTC minute of day."""
    return F.exp(-F.greatest(F.lit(close_minute) - minute, F.lit(0)) / scale)


def risk_budget_weight(mu: Column, sigma: Column, budget: Column, equity: Column, floor: Column, slope: Column, aversion: float) -> Column:
    """Mean-variance weight of one instrument, clipped by a budget and by the equity above a floor."""
    cap = F.least(budget, F.greatest(equity - floor, F.lit(0.0)) / slope)
    return F.greatest(-cap, F.least(cap, mu / (aversion * sigma * sigma)))
