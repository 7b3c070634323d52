"""Queries on positions, margin, gates and option prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import market
from ..operators import pricing, risk
from . import views as v
from .registry import query
from .views import cdf_sql, sql

CAPS = {"gross_cap": 4e8, "delta_dollar_cap": 1e8, "vega_cap": 2e6, "gamma_dollar_cap": 2e8, "per_symbol_cap": 49.0, "equity_buffer_pct": 0.95, "pin_dist_cap": 1e-3, "pin_score_block": 70.0}
EXP = """e AS (SELECT account, sum(abs(qty) * 100 * spot) AS gross, sum(abs(qty) * 100 * abs(delta) * spot) AS delta_dollars, sum(abs(qty) * 100 * abs(vega)) AS vega, sum(abs(qty) * 100 * abs(gamma) * spot * spot) AS gamma_dollars, max(abs(qty)) AS max_qty FROM positions GROUP BY 1),
 m AS (SELECT *, greatest(0.05 * gross + 0.15 * delta_dollars + 1.2 * vega + 0.001 * gamma_dollars, 500.0) AS required FROM e)"""


def margins(spark, sf_dir):
    return risk.required_margin(risk.exposures(v.positions(spark, sf_dir), ["account"]))


def r2(*names: str):
    return [F.round(c, 2).alias(c) for c in names]


@query(sql("positions", f"WITH {EXP} SELECT account, round(gross, 2) AS gross, round(delta_dollars, 2) AS delta_dollars, round(vega, 2) AS vega, round(gamma_dollars, 2) AS gamma_dollars, round(required, 2) AS required FROM m"))
def a19_margin(spark, sf_dir):
    """Exposures and required margin per account."""
    return margins(spark, sf_dir).select("account", *r2("gross", "delta_dollars", "vega", "gamma_dollars", "required"))


@query(sql("positions", """WITH c AS (SELECT * FROM positions UNION ALL SELECT account, 0, 10.0, 1000.0, 0.5, 0.01, 1.0 FROM (SELECT DISTINCT account FROM positions)),
 e AS (SELECT account, greatest(0.05 * sum(abs(qty) * 100 * spot) + 0.15 * sum(abs(qty) * 100 * abs(delta) * spot) + 1.2 * sum(abs(qty) * 100 * abs(vega)) + 0.001 * sum(abs(qty) * 100 * abs(gamma) * spot * spot), 500.0) AS required FROM c GROUP BY 1)
SELECT account, round(required, 2) AS required, CAST(30000000.0 + account * 10000 AS DOUBLE) AS equity, 30000000.0 + account * 10000 >= required AS allowed FROM e"""))
def a20_can_place(spark, sf_dir):
    """Margin with a candidate order added."""
    p = v.positions(spark, sf_dir)
    accounts = p.select("account").distinct()
    new = accounts.select("account", F.lit(0).cast("long").alias("contract"), F.lit(10.0).alias("qty"), F.lit(1000.0).alias("spot"), F.lit(0.5).alias("delta"), F.lit(0.01).alias("gamma"), F.lit(1.0).alias("vega"))
    equity = accounts.select("account", (30000000.0 + F.col("account") * 10000).cast("double").alias("equity"))
    return risk.can_place(p, new, equity, "account").select("account", *r2("required"), "equity", "allowed")


@query(sql("positions", f"""WITH {EXP}, g AS (SELECT *, 5e7 + account * 1e5 AS equity, CAST(account % 390 AS INTEGER) AS minute FROM m),
 s AS (SELECT *, CASE WHEN minute < 300 THEN 1.0 WHEN minute >= 385 THEN 0.1 ELSE 1.0 - 0.9 * (minute - 300) / 85.0 END AS scale FROM g)
SELECT account, concat_ws(',', CASE WHEN gross > 4e8 THEN 'gross_cap' END, CASE WHEN delta_dollars > 1e8 THEN 'delta_dollar_cap' END, CASE WHEN vega > 2e6 THEN 'vega_cap' END, CASE WHEN gamma_dollars > 2e8 * scale THEN 'gamma_dollar_cap_eod' END, CASE WHEN max_qty > 49 THEN 'per_symbol_cap' END, CASE WHEN required > equity * 0.95 THEN 'margin_buffer' END) AS failed FROM s"""))
def a21_gates(spark, sf_dir):
    """The gates that an account fails, with the gamma cap tightening to the close."""
    rows = margins(spark, sf_dir).withColumns({"equity": 5e7 + F.col("account") * 1e5, "minute": (F.col("account") % 390).cast("int")})
    return risk.gates(rows, CAPS).select("account", F.array_join("failed", ",").alias("failed"))


@query(sql("options", """
SELECT contract % 50 AS leg, round(CASE WHEN max(contract % 50 * 3) > 120 OR sum(10 + contract % 90) <= 0 THEN 0.0 ELSE least(100.0, 100.0 * sum(exp(-abs(k - s) / greatest(s * 0.001, 1e-6)) * (10 + contract % 90)) / sum(10 + contract % 90) * (1 + (120 - least(max(contract % 50 * 3), 120.0)) / 120)) END, 6) AS pin_score FROM options GROUP BY 1"""))
def a22_pin_score(spark, sf_dir):
    """Open interest near the spot before expiry."""
    o = v.options(spark, sf_dir).select((F.col("contract") % 50).alias("leg"), F.col("s").alias("spot"), F.col("k").alias("strike"), (10 + F.col("contract") % 90).alias("open_interest"), (F.col("contract") % 50 * 3).cast("double").alias("minutes_to_expiry"))
    return risk.pin_score(o, ["leg"]).select("leg", F.round("pin_score", 6).alias("pin_score"))


@query(sql("positions", """WITH t AS (SELECT account % 3 AS underlying, account % 2 AS bucket, CASE WHEN account % 5 = 0 THEN 'crisis' ELSE 'calm' END AS regime, account, account * 7 % 390 AS minute FROM (SELECT DISTINCT account FROM positions)),
 k AS (SELECT *, CASE WHEN underlying = 0 AND bucket = 0 AND regime = 'crisis' THEN 0.005 WHEN underlying = 0 AND bucket = 0 THEN 0.0025 WHEN underlying = 1 THEN 0.002 ELSE 0.001 END AS k_gamma,
   CASE WHEN underlying = 0 AND bucket = 0 AND regime = 'crisis' THEN 2.5 ELSE 1.2 END AS k_vega, CASE WHEN minute >= 360 THEN 1.5 WHEN minute >= 330 THEN 1.2 ELSE 1.0 END AS tod FROM t)
SELECT account, round(CAST(k_gamma * tod AS DOUBLE), 8) AS k_gamma, round(CAST(k_vega * tod AS DOUBLE), 8) AS k_vega, 500.0::DOUBLE AS floor_dollars FROM k"""))
def j11_margin_table(spark, sf_dir):
    """Margin coefficients by inheritance and time of day."""
    rows = v.positions(spark, sf_dir).select("account").distinct().select("account", (F.col("account") % 3).cast("string").alias("underlying"), (F.col("account") % 2).cast("string").alias("bucket"), F.when(F.col("account") % 5 == 0, "crisis").otherwise("calm").alias("regime"), (F.col("account") * 7 % 390).alias("minute"))
    table = spark.createDataFrame([("0", "0", None, 0.0025, None), ("0", "0", "crisis", 0.005, 2.5), ("1", None, None, 0.002, None), (None, None, None, 0.001, 1.2)], "underlying string, bucket string, regime string, k_gamma double, k_vega double")
    return risk.resolve_margin(rows, table).select("account", F.round("k_gamma", 8).alias("k_gamma"), F.round("k_vega", 8).alias("k_vega"), "floor_dollars")


@query(sql("ticks", """
SELECT product, seq, sum(bid_sz * bid_px) OVER m AS notional_1m, count(*) OVER s AS orders_1s, sum(bid_sz * bid_px) OVER m <= 20000 AS velocity_ok, count(*) OVER s <= 3 AS rate_ok FROM ticks
WINDOW m AS (PARTITION BY product ORDER BY ms RANGE BETWEEN 21600000 PRECEDING AND CURRENT ROW), s AS (PARTITION BY product ORDER BY ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW)"""))
def w26_order_rates(spark, sf_dir):
    """Trailing notional and order counts against caps."""
    rows = v.ticks(spark, sf_dir).withColumn("notional", F.col("bid_sz") * F.col("bid_px"))
    return risk.order_rates(rows, "product", 20000.0, 3, 21_600_000, 3_600_000).select("product", "seq", "notional_1m", "orders_1s", "velocity_ok", "rate_ok")


@query(sql("ticks", "SELECT product, seq, sum(bid_sz) OVER (PARTITION BY product ORDER BY ms, seq ROWS UNBOUNDED PRECEDING) AS running_cost, CASE WHEN sum(bid_sz) OVER (PARTITION BY product ORDER BY ms, seq ROWS UNBOUNDED PRECEDING) <= 1000 THEN 'OK' ELSE 'OVER' END AS status FROM ticks"))
def w25_budget(spark, sf_dir):
    """Running cost against a budget."""
    return risk.budget_prefix(v.ticks(spark, sf_dir), "ms", "seq", "bid_sz", 1000.0, "product").select("product", "seq", "running_cost", "status")


@query(sql("positions", """WITH w AS (SELECT account, contract, sum(qty) / 50 AS x FROM positions GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER o AS nth, sum(abs(x)) OVER (PARTITION BY account ORDER BY abs(x) DESC, contract ROWS UNBOUNDED PRECEDING) AS s, sum(abs(x)) OVER (PARTITION BY account) AS norm FROM w WINDOW o AS (PARTITION BY account ORDER BY abs(x) DESC, contract)),
 t AS (SELECT account, arg_max((s - 5) / nth, nth) AS theta FROM r WHERE abs(x) > (s - 5) / nth GROUP BY 1)
SELECT account, contract, round(CASE WHEN norm <= 5 THEN x ELSE sign(x) * greatest(abs(x) - theta, 0) END, 6) AS projected FROM r JOIN t USING (account)"""))
def w27_l1_projection(spark, sf_dir):
    """Weights projected onto an L1 ball per account."""
    w = v.positions(spark, sf_dir).groupBy("account", "contract").agg((F.sum("qty") / 50).alias("x"))
    return risk.l1_projection(w, "account", "contract", "x", 5.0).select("account", "contract", F.round("projected", 6).alias("projected"))


@query(sql("positions", """SELECT account, contract, side, order_qty FROM (SELECT account, contract, abs(qty) AS order_qty, CASE WHEN qty > 0 AND 0.5 - delta / 3 <= 0.4 THEN 'sell' WHEN qty < 0 AND 0.5 <= 0.4 THEN 'buy' END AS side FROM positions WHERE abs(qty) >= 1e-9 AND delta > 0) WHERE side IS NOT NULL"""))
def p15_penny_closes(spark, sf_dir):
    """Positions to flatten as their quotes collapse."""
    b = v.positions(spark, sf_dir).withColumns({"bid": F.col("delta") / 3, "ask": F.lit(0.5)})
    return risk.penny_closes(b, 0.4).select("account", "contract", "side", "order_qty")


D1 = "(ln(s / k) / (sigma * sqrt(tau)) + sigma * sqrt(tau) / 2)"
D2 = "(ln(s / k) / (sigma * sqrt(tau)) - sigma * sqrt(tau) / 2)"


@query(sql("options", f"""SELECT contract, round(s * {cdf_sql("d1")} - k * {cdf_sql("d2")}, 5) AS price, round({cdf_sql("d1")}, 6) AS delta, round(exp(-d1 * d1 / 2) / 2.5066282746310002 / (s * sigma * sqrt(tau)), 6) AS gamma, round(s * exp(-d1 * d1 / 2) / 2.5066282746310002 * sqrt(tau), 5) AS vega
FROM (SELECT *, {D1} AS d1, {D2} AS d2 FROM options)"""))
def f7_option_values(spark, sf_dir):
    """Call price and greeks."""
    o = v.options(spark, sf_dir)
    c = market.call_value(F.col("s"), F.col("k"), F.col("tau"), F.col("sigma"))
    return o.select("contract", F.round(c["price"], 5).alias("price"), F.round(c["delta"], 6).alias("delta"), F.round(c["gamma"], 6).alias("gamma"), F.round(c["vega"], 5).alias("vega"))


@query(sql("options", "SELECT contract, round(greatest(-least(2.0, greatest(s * 10 - 5000, 0) / 2000), least(least(2.0, greatest(s * 10 - 5000, 0) / 2000), (0.001 * (contract % 11 - 5)) / (2.0 * sigma * sigma))), 6) AS weight FROM options"))
def f25_risk_budget(spark, sf_dir):
    """mean-variance weight of one instrument inside its budgets."""
    o = v.options(spark, sf_dir)
    w = market.risk_budget_weight(0.001 * (F.col("contract") % 11 - 5), F.col("sigma"), F.lit(2.0), F.col("s") * 10, F.lit(5000.0), F.lit(2000.0), 2.0)
    return o.select("contract", F.round(w, 6).alias("weight"))


GRID = """g AS (SELECT p.s, p.s * (0.97 + 0.06 * i / 6.0::DOUBLE) AS k, (0.5 + 71.5 * j / 4.0::DOUBLE) / 8760.0::DOUBLE AS tau, sg AS sigma FROM (SELECT max(s) AS s FROM options) p, range(0, 7) a(i), range(0, 5) b(j), (VALUES (0.1::DOUBLE), (0.2), (0.4)) c(sg))"""


@query(sql("options", f"WITH {GRID} SELECT round(k, 6) AS k, round(tau, 9) AS tau, sigma FROM g"))
def j16_grid(spark, sf_dir):
    """An evaluation grid of moneyness, time and volatility around the highest spot."""
    return pricing.grid(v.options(spark, sf_dir).agg(F.max("s").alias("s")), 7, 5, [0.1, 0.2, 0.4]).select(F.round("k", 6).alias("k"), F.round("tau", 9).alias("tau"), "sigma")


ERR = f"""WITH q AS (SELECT contract, s, {cdf_sql(D1)} AS delta, exp(-{D1} * {D1} / 2) / 2.5066282746310002 / (s * sigma * sqrt(tau)) AS gamma FROM options),
 e AS (SELECT contract, abs(0.001 * (contract % 7)) / greatest(abs(delta), 0.01) AS delta_err, abs(gamma * 0.01 * (contract % 5)) / greatest(abs(gamma), 0.01 * max(abs(gamma)) OVER ()) AS gamma_err FROM q)"""


@query(sql("options", f"{ERR} SELECT round(quantile_cont(delta_err, 0.5), 6) AS delta_median, round(quantile_cont(delta_err, 0.95), 6) AS delta_p95, round(max(delta_err), 6) AS delta_max, round(avg(delta_err), 6) AS delta_mean, round(quantile_cont(gamma_err, 0.5), 6) AS gamma_median, round(quantile_cont(gamma_err, 0.95), 6) AS gamma_p95, round(max(gamma_err), 6) AS gamma_max, round(avg(gamma_err), 6) AS gamma_mean FROM e"))
def a25_greek_errors(spark, sf_dir):
    """Distribution of normalised errors of estimated greeks."""
    o = v.options(spark, sf_dir)
    c = market.call_value(F.col("s"), F.col("k"), F.col("tau"), F.col("sigma"))
    rows = o.withColumns({"delta": c["delta"], "gamma": c["gamma"]}).withColumns({"delta_est": F.col("delta") + 0.001 * (F.col("contract") % 7), "gamma_est": F.col("gamma") * (1 + 0.01 * (F.col("contract") % 5))})
    rows = pricing.normalised_errors(rows)
    return pricing.error_summary(rows, ["delta", "gamma"])


@query(sql("options", "WITH d AS (SELECT contract % 4 AS grp, 0.01 * (contract % 13) - 0.05 AS gain FROM options) SELECT grp, round(avg(CASE WHEN gain > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_share, round(avg(gain), 6) AS mean_gain, round(avg(gain) / (stddev_samp(gain) / sqrt(count(*))), 6) AS t FROM d GROUP BY 1"))
def a24_paired_gain(spark, sf_dir):
    """Win share, mean gain and t of paired differences."""
    d = v.options(spark, sf_dir).select((F.col("contract") % 4).alias("grp"), (0.01 * (F.col("contract") % 13) - 0.05).alias("gain"))
    return pricing.paired_gain(d, "grp", "gain")
