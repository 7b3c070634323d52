"""Queries that build training corpora and check data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus, quality
from . import ticks as tk
from . import views as v
from .registry import query
from .views import sql

TOK = "tok AS (SELECT inst, ms, seq, [CAST(bid_px AS INTEGER) % 64, CAST(ask_px AS INTEGER) % 64, CAST(bid_sz AS INTEGER) % 64] AS tokens FROM ticks)"


def token_rows(spark, sf_dir):
    code = lambda c: (F.col(c).cast("int") % 64).cast("int")
    return v.ticks(spark, sf_dir).select("inst", "ms", "seq", F.array(code("bid_px"), code("ask_px"), code("bid_sz")).alias("tokens"))


@query(sql("ticks", f"WITH {TOK}, h AS (SELECT inst, seq, flatten(list(tokens) OVER w) AS history, count(*) OVER w AS n FROM tok WINDOW w AS (PARTITION BY inst ORDER BY ms, seq ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING)) SELECT inst, seq, history FROM h WHERE n = 16"))
def w19_history(spark, sf_dir):
    """The 16 token rows before each row, per instrument."""
    return corpus.history_windows(token_rows(spark, sf_dir), "inst").select("inst", "seq", "history")


@query(sql("ticks", "WITH r AS (SELECT inst, bid_px, ms, seq, row_number() OVER (PARTITION BY inst ORDER BY ms, seq) - 1 AS start, count(*) OVER (PARTITION BY inst) AS n, list(bid_px) OVER (PARTITION BY inst ORDER BY ms, seq ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS \"window\" FROM ticks) SELECT inst, start, \"window\" FROM r WHERE start < n - 8"))
def w20_sliding(spark, sf_dir):
    """All runs of eight values but the last."""
    return corpus.sliding_windows(v.ticks(spark, sf_dir), "inst", "bid_px", 8).select("inst", F.col("start").cast("long").alias("start"), "window")


@query(sql("ticks", f"""WITH {TOK}, n AS (SELECT inst, tokens, row_number() OVER (PARTITION BY inst ORDER BY ms, seq) - 1 AS nth FROM tok), f AS (SELECT inst, nth * 3 + i - 1 AS pos, tokens[i] AS token FROM n, range(1, 4) t(i)),
 c AS (SELECT inst, pos // 32 AS block, pos, token FROM f UNION ALL SELECT inst, pos // 32 - 1, pos, token FROM f WHERE pos % 32 = 0 AND pos > 0)
SELECT inst, block, CAST(block * 32 % 3 AS INTEGER) AS feature_offset, list(token ORDER BY pos) AS tokens FROM c GROUP BY 1, 2 HAVING count(*) = 33"""))
def w21_contexts(spark, sf_dir):
    """Contexts of 33 tokens with stride 32 in time order."""
    return corpus.pack_contexts(token_rows(spark, sf_dir), "inst", 32, 3).select("inst", "block", "feature_offset", "tokens")


WEIGHT = """b AS (SELECT product, inst, seq, ms, (bid_px + ask_px) / 2 AS mid, trade_sz AS last_sz, CASE WHEN seq % 7 = 0 THEN NULL ELSE 0.1 + (seq % 13) / 100.0::DOUBLE END AS iv FROM ticks),
 d AS (SELECT *, coalesce(abs(mid - lag(mid) OVER (PARTITION BY product ORDER BY ms, seq)), 0) AS d FROM b),
 s AS (SELECT product, quantile_cont(iv, 0.5) AS m, max(last_sz) AS x, stddev_pop(d) AS sd FROM d GROUP BY 1),
 f AS (SELECT d.*, coalesce(iv, m) AS ivf, m, x, sd FROM d JOIN s USING (product)), g AS (SELECT product, stddev_samp(ivf) AS ivsd FROM f GROUP BY 1),
 w AS (SELECT f.*, (1 + exp(-greatest(1200 - ms // 60000 % 1440, 0) / 90.0::DOUBLE)) * (1 + 0.5 * greatest(0, least(3, (ivf - m) / (ivsd + 1e-9)))) * (1 + ln(1 + last_sz) / ln(1 + x + 1)) * (CASE WHEN sd > 0 THEN 1 + 0.75 * least(3, d / sd) ELSE 1 END) AS w FROM f JOIN g USING (product)),
 q AS (SELECT product, seq, w / sum(w) OVER (PARTITION BY product) AS weight FROM w)"""


def weighted(spark, sf_dir):
    t = v.ticks(spark, sf_dir)
    iv = F.when(F.col("seq") % 7 != 0, 0.1 + (F.col("seq") % 13) / 100.0)
    return corpus.quality_weights(t.select("product", "seq", "ms", ((F.col("bid_px") + F.col("ask_px")) / 2).alias("mid"), F.col("trade_sz").alias("last_sz"), iv.alias("iv")), "product")


@query(sql("ticks", f"WITH {WEIGHT} SELECT product, seq, round(weight, 8) AS weight FROM q"))
def w22_quality_weights(spark, sf_dir):
    """Sampling weights of rows, summing to 1 per shard."""
    return weighted(spark, sf_dir).select("product", "seq", F.round("weight", 8).alias("weight"))


@query(sql("ticks", f"WITH {WEIGHT}, r AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY weight DESC, seq) AS nth, count(*) OVER (PARTITION BY product) AS n FROM q) SELECT product, round(sum(weight), 6) AS top_mass FROM r WHERE nth <= ceil(n * 0.1) GROUP BY 1"))
def a33_concentration(spark, sf_dir):
    """Weight in the heaviest tenth of a shard."""
    return corpus.mass_concentration(weighted(spark, sf_dir), "product").select("product", F.round("top_mass", 6).alias("top_mass"))


@query()
def w23_weighted_order(spark, sf_dir):
    """A weighted draw without replacement as an order of rows."""
    return corpus.weighted_order(weighted(spark, sf_dir), "product", "seq").select("product", "seq", F.round("draw", 6).alias("draw"))


@query(sql("ticks picks", "SELECT inst, seq FROM ticks WHERE ms // 86400000 IN (SELECT day FROM picks WHERE split = 'eval')"))
def j13_picked_days(spark, sf_dir):
    """Ticks of picked days."""
    t = v.ticks(spark, sf_dir).withColumn("day", F.expr("ms div 86400000L"))
    return corpus.pick_days(t, v.day_picks(spark, sf_dir).where("split = 'eval'")).select("inst", "seq")


@query(sql("ticks picks", "SELECT coalesce(split, 'total') AS split, coalesce(CAST(regime AS VARCHAR), 'all') AS regime, count(*) AS n FROM picks GROUP BY ROLLUP (split, regime)"))
def a38_split_counts(spark, sf_dir):
    """Counts per split and regime with totals."""
    d = v.day_picks(spark, sf_dir).rollup("split", "regime").agg(F.count("*").alias("n"))
    return d.select(F.coalesce("split", F.lit("total")).alias("split"), F.coalesce(F.col("regime").cast("string"), F.lit("all")).alias("regime"), "n")


JOBS = """q AS (SELECT o_orderkey AS id, 'd' || (o_orderkey % 3) AS dataset, 's' || (o_custkey % 2) AS schema, concat_ws(',', 'A' || (o_orderkey % 4), 'B' || (o_custkey % 3)) AS symbols, strftime(o_orderdate, '%Y-%m-%d') AS start FROM orders)"""


@query(sql("", f"""WITH {JOBS}, k AS (SELECT *, array_to_string(list_sort(list_distinct(string_split(symbols, ','))), ',') AS ks FROM q)
SELECT r.id, CASE WHEN EXISTS (SELECT 1 FROM k j WHERE j.id % 2 = 1 AND j.dataset = r.dataset AND j.schema = r.schema AND j.ks = r.ks AND j.start = r.start) THEN 'reuse' ELSE 'new' END AS action FROM k r WHERE r.id % 2 = 0"""))
def j14_reuse_jobs(spark, sf_dir):
    """Requests that an existing job with the same symbol set covers."""
    o = v.table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    a, b = F.concat(F.lit("A"), (F.col("o_orderkey") % 4).cast("string")), F.concat(F.lit("B"), (F.col("o_custkey") % 3).cast("string"))
    rows = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("d"), (F.col("o_orderkey") % 3).cast("string")).alias("dataset"), F.concat(F.lit("s"), (F.col("o_custkey") % 2).cast("string")).alias("schema"), a.alias("a"), b.alias("b"), day.alias("start"), day.alias("end"))
    requests = rows.where("id % 2 = 0").withColumn("symbols", F.concat_ws(",", "a", "b"))
    jobs = rows.where("id % 2 = 1").withColumn("symbols", F.concat_ws(", ", "b", "a"))  # the same set in another order
    reuse, new = corpus.reusable_jobs(requests, jobs)
    return reuse.select("id", F.lit("reuse").alias("action")).unionByName(new.select("id", F.lit("new").alias("action")))


@query(sql("ticks", "WITH c AS (SELECT quantile_cont(ms, 0.8) AS cut FROM ticks) SELECT inst, seq, CASE WHEN ms <= cut THEN 'train' ELSE 'eval' END AS split FROM ticks, c"))
def p12_time_split(spark, sf_dir):
    """Train before a time quantile, eval after."""
    return corpus.time_split(v.ticks(spark, sf_dir)).select("inst", "seq", "split")


@query(sql("ticks", "SELECT inst, seq, CASE WHEN product = 3 THEN 'eval' ELSE 'train' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY ms, seq) AS nth FROM ticks) WHERE nth <= 300"))
def p11_held_out_job(spark, sf_dir):
    """One job held out, rows capped per job (the cap is the feature)."""
    from ..operators.windows import by

    t = v.ticks(spark, sf_dir).withColumn("nth", F.row_number().over(by("product", "ms", "seq"))).where("nth <= 300")
    return t.select("inst", "seq", F.when(F.col("product") == 3, "eval").otherwise("train").alias("split"))


@query(sql("ticks", "SELECT day FROM (SELECT CAST(unnest(generate_series(min(ts)::DATE, max(ts)::DATE - 1, INTERVAL 1 DAY)) AS DATE) AS day FROM ticks) WHERE isodow(day) < 6"))
def p8_trading_days(spark, sf_dir):
    """Weekdays between the first and the last day of the ticks."""
    a = v.ticks(spark, sf_dir).agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b")).first()
    return corpus.trading_days(spark, str(a["a"]), str(a["b"]))


@query()
def u5_shard_slices(spark, sf_dir):
    """Disjoint slices of shards per rank."""
    days = v.ticks(spark, sf_dir).select(F.expr("ms div 86400000L").alias("day")).distinct()
    return corpus.shard_slices(days, "day", 4)


TF = """t AS (SELECT *, CASE WHEN lag(ms) OVER (PARTITION BY inst ORDER BY seq) > ms THEN 1 ELSE 0 END AS late, CASE WHEN ms // 3600000 % 24 < 12 OR ms // 3600000 % 24 >= 22 THEN 1 ELSE 0 END AS outside FROM ticks),
 a AS (SELECT sum(late) AS late, avg(outside) AS outside, count(*) FILTER (bid_px > ask_px) AS crossed, count(*) FILTER (ask_px <= 0) AS zero_ask, avg(CASE WHEN trade_sz > 0 THEN 1.0 ELSE 0.0 END) AS trades FROM t)"""


@query(sql("ticks", f"""WITH {TF} SELECT 'out_of_order' AS name, late <= 50 AS ok, 'fail' AS severity FROM a UNION ALL SELECT 'session_hours', outside < 0.05, 'warn' FROM a UNION ALL SELECT 'crossed', crossed <= 100, 'fail' FROM a
UNION ALL SELECT 'zero_ask', zero_ask = 0, 'warn' FROM a UNION ALL SELECT 'trade_share', trades BETWEEN 1e-5 AND 0.1, 'warn' FROM a"""))
def a15_tick_findings(spark, sf_dir):
    """Findings on raw ticks."""
    return quality.tick_findings(v.ticks(spark, sf_dir), "inst").select("name", "ok", "severity")


@query(sql("ticks", f"""WITH {TF} SELECT late <= 50 AND crossed <= 100 AS passed, CAST(late > 50 AS BIGINT) + CAST(outside >= 0.05 AS BIGINT) + CAST(crossed > 100 AS BIGINT) + CAST(zero_ask <> 0 AS BIGINT) + CAST(NOT trades BETWEEN 1e-5 AND 0.1 AS BIGINT) AS n_failed FROM a"""))
def a18_passes(spark, sf_dir):
    """Whether findings let a table pass."""
    return quality.passes(quality.tick_findings(v.ticks(spark, sf_dir), "inst"))


@query(sql("ticks", "SELECT event_type AS root, count(*) AS n, event_type NOT IN ('view', 'click', 'purchase') AS unexpected FROM ticks GROUP BY 1"))
def a15_roots(spark, sf_dir):
    """Distribution of a root column and unexpected roots."""
    return v.ticks(spark, sf_dir).groupBy(F.col("event_type").alias("root")).agg(F.count("*").alias("n")).withColumn("unexpected", ~F.col("root").isin("view", "click", "purchase"))


@query(sql("ticks", f"""WITH {TOK}, a AS (SELECT count(*) AS n, min(len(tokens)) AS least, max(len(tokens)) AS most, count(*) FILTER (strftime(make_timestamp(ms * 1000), '%Y-%m-%d') = '2024-01-01') AS there FROM tok)
SELECT 'exists' AS name, true AS ok, '' AS detail, 'fail' AS severity UNION ALL SELECT 'schema', true, '', 'fail' UNION ALL SELECT 'rows' AS name, n > 0 AS ok, CAST(n AS VARCHAR) AS detail, 'fail' AS severity FROM a UNION ALL SELECT 'token_length', least = 3 AND most = 3, concat_ws('-', least, most), 'fail' FROM a
UNION ALL SELECT 'day_coverage', there > 0, CASE WHEN there > 0 THEN '' ELSE '2024-01-01' END, 'warn' FROM a"""))
def a16_shard_findings(spark, sf_dir):
    """Findings on a token table."""
    rows = token_rows(spark, sf_dir).withColumn("day", F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd"))
    return quality.shard_findings(rows, 3, ["2024-01-01"])


@query(sql("", """
WITH r AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY o_orderkey) AS step FROM (SELECT CASE WHEN o_orderkey <= 4 THEN 20 ELSE o_custkey % 20 END AS k, o_orderkey FROM orders)),
 m AS (SELECT CAST(k AS VARCHAR) AS run, step, 5.0 - (step % 400) * 0.01 * (k % 3) / 2 AS val_loss, 4.9 - (step % 400) * 0.01 - CASE WHEN k = 7 THEN 3 ELSE 0 END AS train_loss, 0.5 + (k % 5) * 0.02 AS accuracy FROM r),
 w AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS nth, lead(val_loss) OVER (PARTITION BY run ORDER BY step DESC) AS older, count(*) OVER (PARTITION BY run) AS steps FROM m),
 l AS (SELECT run, max(steps) AS steps, bool_and(CASE WHEN nth < 5 THEN val_loss < older ELSE true END) AS falls, regr_slope(val_loss::DOUBLE, step::DOUBLE) AS slope, avg(val_loss) AS mean, arg_max(train_loss, step) AS tr, arg_max(val_loss, step) AS va, arg_max(accuracy, step) AS acc FROM w WHERE nth <= 5 GROUP BY 1)
SELECT run, concat_ws(',', CASE WHEN steps < 6 THEN 'too_few_steps' END, CASE WHEN NOT falls OR -slope / mean < 1e-3 THEN 'not_falling' END, CASE WHEN abs(va - tr) > 1 THEN 'gap' END, CASE WHEN acc < 0.53 OR acc >= 0.99 THEN 'accuracy' END) AS reasons FROM l"""))
def a36_metric_gate(spark, sf_dir):
    """Reasons against going on with a run."""
    from ..operators.windows import numbered

    run = F.when(F.col("o_orderkey") <= 4, 20).otherwise(F.col("o_custkey") % 20).cast("int")
    orders = v.table(spark, sf_dir, "orders").select(run.alias("k"), "o_orderkey")
    r = numbered(orders, "k", "o_orderkey", "o_orderkey", "step", 1 << 17).withColumn("step", F.col("step") + 1)
    down = (F.col("step") % 400) * 0.01
    m = r.select(F.col("k").cast("string").alias("run"), "step", (5.0 - down * (F.col("k") % 3) / 2).alias("val_loss"), (4.9 - down - F.when(F.col("k") == 7, 3).otherwise(0)).alias("train_loss"), (0.5 + (F.col("k") % 5) * 0.02).alias("accuracy"))
    return quality.metric_gate(m).select("run", F.array_join("reasons", ",").alias("reasons"))


@query(sql("ticks", f"WITH {tk.FEAT} SELECT inst, round(avg(ret), 6) AS mean_ret, count(*) AS n FROM feat GROUP BY 1 HAVING count(*) >= 60"))
def p9_minimum_history(spark, sf_dir):
    """Instruments with enough history."""
    rows = tk.feature_table(spark, sf_dir).groupBy("inst").agg(F.round(F.avg("ret"), 6).alias("mean_ret"), F.count("*").alias("n"))
    return rows.where("n >= 60")
