"""Data-quality findings, prediction scoring and metric gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .windows import previous


def finding(name: str, ok: Column, detail: Column, severity: str) -> Column:
    return F.struct(F.lit(name).alias("name"), F.coalesce(ok, F.lit(False)).alias("ok"), detail.cast("string").alias("detail"), F.lit(severity).alias("severity"))


def tick_findings(ticks: DataFrame, key: str) -> DataFrame:
    """Findings on raw ticks: order of arrival, session hours, crossed and zero quotes, share of trades."""
    late = F.when(F.col("prev_ms") > F.col("ms"), 1).otherwise(0)
    hour = F.expr("(ms div 3600000L) % 24")
    rows = previous(ticks, key, "seq", "seq", ["ms"], 1 << 17).withColumns({"late": late, "outside": F.when((hour < 12) | (hour >= 22), 1).otherwise(0)})
    a = rows.agg(
        F.sum("late").alias("late"), F.avg("outside").alias("outside"), F.count(F.when(F.col("bid_px") > F.col("ask_px"), 1)).alias("crossed"),
        F.count(F.when(F.col("ask_px") <= 0, 1)).alias("zero_ask"), F.avg(F.when(F.col("trade_sz") > 0, 1.0).otherwise(0.0)).alias("trades"),
    )
    c = F.col
    found = F.array(
        finding("out_of_order", c("late") <= 50, c("late"), "fail"),
        finding("session_hours", c("outside") < 0.05, F.round("outside", 6), "warn"),
        finding("crossed", c("crossed") <= 100, c("crossed"), "fail"),
        finding("zero_ask", c("zero_ask") == 0, c("zero_ask"), "warn"),
        finding("trade_share", c("trades").between(1e-5, 0.1), F.round("trades", 6), "warn"),
    )
    return a.select(F.explode(found).alias("f")).select("f.*")


def shard_findings(tokens: DataFrame | None, features: int, days: list[str], columns: list[str] = ("day", "tokens")) -> DataFrame:
    """Findings on a token table: whether it exists (None does not) and has all ``columns``, length of token rows, no empty table, all expected days present.

    What a missing table or column leaves unknown is a failed finding, not an error.
    """
    have = [] if tokens is None else [c for c in columns if c in tokens.columns]
    lost = [c for c in columns if c not in have]
    know = lambda c, value: value if c in have else F.lit(None)
    if tokens is None:
        tokens = SparkSession.active().range(0)
    size = know("tokens", F.size("tokens")).cast("int")
    a = tokens.agg(F.min(size).alias("least"), F.max(size).alias("most"), F.sort_array(F.collect_set(know("day", F.col("day")).cast("string"))).alias("days"), F.count("*").alias("n"))
    missing = F.array_except(F.array(*[F.lit(d) for d in days]), F.col("days"))
    true = lambda x: F.coalesce(x, F.lit(False))
    found = F.array(
        finding("exists", F.lit(bool(have)), F.lit("" if have else "missing"), "fail"),
        finding("schema", F.lit(not lost), F.lit(",".join(lost)), "fail"),
        finding("rows", F.col("n") > 0, F.col("n"), "fail"),
        finding("token_length", true((F.col("least") == features) & (F.col("most") == features)), F.concat_ws("-", "least", "most"), "fail"),
        finding("day_coverage", F.size(missing) == 0, F.array_join(missing, ","), "warn"),
    )
    return a.select(F.explode(found).alias("f")).select("f.*")


def passes(findings: DataFrame) -> DataFrame:
    """One row: whether no failed finding is of severity ``fail``."""
    return findings.agg(F.bool_and(F.col("ok") | (F.col("severity") != "fail")).alias("passed"), F.count(F.when(~F.col("ok"), 1)).alias("n_failed"))


def score_predictions(rows: DataFrame) -> DataFrame:
    """top1, top5, cross-entropy and directional accuracy against the median target (the neutral token excluded).

    The median is the lower middle element. All scores are sums over rows, so parts can be merged.
    """
    n = rows.groupBy("target").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("target"))  # one row per token of the vocabulary
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    median = n.withColumns({"upto": upto, "total": total}).where(F.col("upto") >= F.floor((F.col("total") + 1) / 2)).agg(F.min("target").alias("median"))
    m = rows.join(F.broadcast(median))
    up = lambda c: F.signum((F.col(c) - F.col("median")).cast("double"))
    hit = F.when(F.col("target") != F.col("median"), (up("pred") == up("target")).cast("double"))
    return m.agg(
        F.avg((F.col("pred") == F.col("target")).cast("double")).alias("top1"), F.avg(F.array_contains("top5", F.col("target")).cast("double")).alias("top5"),
        (-F.avg("logprob")).alias("ce"), F.avg(hit).alias("direction"), F.avg(F.when(F.col("feature_index") == 0, hit)).alias("direction_feature0"), F.count("*").alias("n"),
    )


def probe_verdict(rows: DataFrame) -> DataFrame:
    """Accuracy of (y, pred, momentum) with base rate, z against a coin, baselines and a verdict."""
    acc, n = F.avg((F.col("y") == F.col("pred")).cast("double")), F.count("*")
    a = rows.agg(acc.alias("accuracy"), F.avg(F.col("y").cast("double")).alias("always_up"), F.avg((F.col("y") == F.col("momentum")).cast("double")).alias("momentum_accuracy"), n.alias("n"))
    z = (F.col("accuracy") - 0.5) / F.sqrt(0.25 / F.col("n"))
    verdict = F.when(F.col("accuracy") >= 0.53, "signal").when(F.col("accuracy") >= 0.51, "weak").otherwise("none")
    return a.withColumns({"z": z, "base_rate": F.greatest("always_up", 1 - F.col("always_up")), "verdict": verdict})


def metric_gate(metrics: DataFrame) -> DataFrame:
    """Per run (step, train_loss, val_loss, accuracy): reasons against going on, and ok.

    Over the last five steps the validation loss must fall every time and by 0.1 % of its mean a
    step; six steps at least; train and validation at most 1 apart; accuracy in [0.53, 0.99).
    """
    back = Window.partitionBy("run").orderBy(F.col("step").desc())
    steps = metrics.groupBy("run").agg(F.count("*").alias("steps"))
    # the last six steps of a run, which Spark finds before it shuffles; the sixth is only compared with
    rows = metrics.withColumn("nth", F.row_number().over(back)).where("nth <= 6").join(steps, "run")
    rows = rows.withColumn("older", F.lead("val_loss").over(back))
    last = rows.where("nth <= 5").groupBy("run").agg(
        F.max("steps").alias("steps"), F.bool_and(F.when(F.col("nth") < 5, F.col("val_loss") < F.col("older")).otherwise(True)).alias("falls"),
        F.regr_slope("val_loss", F.col("step").cast("double")).alias("slope"), F.avg("val_loss").alias("mean"),
        F.max_by("train_loss", "step").alias("train"), F.max_by("val_loss", "step").alias("val"), F.max_by("accuracy", "step").alias("accuracy"),
    )
    c = F.col
    reasons = [
        ("too_few_steps", c("steps") < 6),
        ("not_falling", ~c("falls") | (-c("slope") / c("mean") < 1e-3)),
        ("gap", F.abs(c("val") - c("train")) > 1.0),
        ("accuracy", (c("accuracy") < 0.53) | (c("accuracy") >= 0.99)),
    ]
    found = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in reasons]))
    return last.select("run", found.alias("reasons")).withColumn("ok", F.size("reasons") == 0)
