"""Bin edges and token codes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .windows import by

FLOOR = 1e-9
#: Distinct values of a span, which one task puts in order; spans that a larger one is cut into.
SPAN, MARKS = 1 << 20, 128
#: Rows up to which a table is sent to all executors.
SENT_ROWS = 20_000


def _steps(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n))


def pad_edges(quantiles: Column, n: int) -> Column:
    """n + 1 increasing edges from quantiles: distinct ones, padded by equal steps to last + 1, ends infinite."""
    distinct = F.array_distinct(quantiles)
    missing = n + 1 - F.size(distinct)
    last = F.element_at(distinct, -1)
    pad = F.transform(F.sequence(F.lit(1), F.greatest(missing, F.lit(1))), lambda i: last + i / missing)
    full = F.when(missing > 0, F.concat(distinct, pad)).otherwise(distinct)
    return F.transform(full, lambda e, i: F.when(i == 0, F.lit(-math.inf)).when(i == n, F.lit(math.inf)).otherwise(e))


def long_features(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """(keep.., feature, value) of finite values."""
    parts = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]))
    return df.select(*keep, parts.alias("p")).select(*keep, "p.*").where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < math.inf))


def _spans(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``counts`` (keys.., _v, _n) with ``_low``, the lower end of a span of values, none of which holds over ``SPAN`` rows.

    A group is one span at first; spans that are too large are cut by a sketch of their values into
    ``MARKS`` again and again, so a group of any size falls into spans of bounded size.
    """
    rows = counts.withColumn("_low", F.lit(-math.inf))
    while True:
        large = rows.groupBy(*keys, "_low").agg(F.count("*").alias("_many")).where(F.col("_many") > SPAN)
        n = large.count()
        if not n:
            return rows
        cut = rows.join(large, [*keys, "_low"], "left_semi").groupBy(*keys, "_low").agg(F.percentile_approx("_v", [i / MARKS for i in range(1, MARKS)], 10 * MARKS).alias("_marks"))
        cut = written(cut)
        side = F.broadcast(cut) if n <= SENT_ROWS else cut
        last = F.array_max(F.filter("_marks", lambda m: m <= F.col("_v")))
        rows = written(rows.join(side, [*keys, "_low"], "left").withColumn("_low", F.coalesce(last, "_low")).drop("_marks"))


def _near(lower: Column, upto: Column, rows: Column, levels: list[float]) -> Column:
    """Whether a rank of ``levels`` may lie in lower..upto - 1, a row more at each end: compiled comparisons that spare most values the exact look."""
    ordered, width = sorted(levels), F.greatest(rows - 1, F.lit(1))
    below = lambda x: _reached(x / width, ordered, True, 0, len(ordered))
    return below(upto + 1) > below(lower - 2)


def exact_quantiles(rows: DataFrame, keys: list[str], levels: list[float | Column], value: str = "value", weight: str | None = None) -> DataFrame:
    """(keys.., q, rows): quantiles at ``levels``, linear between ranks, and the number of values, per group.

    Equal values are counted first. If no group has more than ``SPAN`` distinct values, each is put in
    order by one task. Otherwise they are cut into spans of values; ranks are sums inside a span plus the
    counts of the spans before, so no task holds a group. The cuts only balance the work, the quantiles
    are exact. Values that are null or NaN and rows with a null key take no part. A level may be a column
    over ``rows``, the place of a value in the order (from 0). With ``weight`` a row stands for so many equal ones.
    """
    for key in keys:
        rows = rows.where(F.col(key).isNotNull())
    counts = written(rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg((F.sum(weight) if weight else F.count("*")).alias("_n")))
    h = [p.cast("double") if isinstance(p, Column) else F.lit(p) * (F.col("rows") - 1) for p in levels]
    ranks = F.array_distinct(F.concat(F.array(*[F.floor(x) for x in h]), F.array(*[F.ceil(x) for x in h])))
    most = counts.groupBy(*keys).agg(F.count("*").alias("_many")).agg(F.max("_many")).first()[0]
    if (most or 0) <= SPAN:
        whole = Window.partitionBy(*keys)
        placed = counts.withColumns({"_upto": F.sum("_n").over(whole.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)), "rows": F.sum("_n").over(whole)})
        spare = not any(isinstance(p, Column) for p in levels)
    else:
        placed, ranks, spare = _placed(_spans(counts, keys), keys, ranks), F.col("_ranks"), False  # few ranks a span
    if spare:
        placed = placed.where(_near(F.col("_upto") - F.col("_n"), F.col("_upto"), F.col("rows"), levels))
    mine = F.filter(ranks, lambda r: (r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_n")))
    picked = placed.select(*keys, "rows", "_v", F.explode(mine).alias("_rank"))
    found = picked.groupBy(*keys, "rows").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))  # two values a level
    at = lambda r: F.element_at("_at", r)
    # between equal values lies that value, not one that differs in its last bit
    q = [(F.when(at(F.ceil(x)) != at(F.floor(x)), (F.ceil(x) - x) * at(F.floor(x)) + (x - F.floor(x)) * at(F.ceil(x))).otherwise(at(F.floor(x)))) for x in h]
    return found.select(*keys, F.array(*q).alias("q"), "rows")


def _placed(spans: DataFrame, keys: list[str], ranks: Column) -> DataFrame:
    """Values of those spans that hold one of ``ranks``, with those as ``_ranks``, ``_upto``, the rows up to a value, and ``rows`` of the group."""
    sums = written(spans.groupBy(*keys, "_low").agg(F.sum("_n").alias("_all")))
    totals = sums.groupBy(*keys).agg(F.sum("_all").alias("rows")).withColumn("_ranks", ranks)
    before = F.sum("_all").over(by(keys, "_low").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(*keys, "_low", "_all", F.coalesce(before, F.lit(0)).alias("_before"))
    offsets = offsets.join(totals, keys) if keys else offsets.crossJoin(F.broadcast(totals))  # without keys: one row
    inside = F.filter("_ranks", lambda r: (r < F.col("_before") + F.col("_all")) & (r >= F.col("_before")))
    asked = offsets.select(*keys, "_low", "rows", "_before", inside.alias("_ranks")).where(F.size("_ranks") > 0)
    side = F.broadcast(asked) if sums.count() <= SENT_ROWS else asked  # at most one row a span
    upto = F.sum("_n").over(by([*keys, "_low"], "_v").rowsBetween(Window.unboundedPreceding, 0))
    return spans.join(side, [*keys, "_low"]).withColumn("_upto", upto + F.col("_before"))


def quantile_edges(df: DataFrame, features: list[str], n: int, keys: list[str] | None = None, least: int | None = None, exact: bool = True) -> DataFrame:
    """Edges (feature, edges) by quantiles, per key if given; features with too few values are left out.

    ``exact=False`` uses a mergeable sketch: one pass with a fixed error of rank.
    """
    keys = keys or []
    levels = [i / n for i in range(n + 1)]
    least = max(2 * n, 50) if least is None else least
    rows = long_features(df, features, keys)
    if exact:
        got = exact_quantiles(rows, [*keys, "feature"], levels)
    else:
        got = rows.groupBy(*keys, "feature").agg(F.percentile_approx("value", levels, 100_000).alias("q"), F.count("*").alias("rows"))
    return got.where(F.col("rows") >= least).select(*keys, "feature", F.lit("quantile").alias("kind"), pad_edges(F.col("q"), n).alias("edges"))


def sketches(df: DataFrame, features: list[str], keys: list[str] | None = None, size: int = 4096) -> DataFrame:
    """(keys.., feature, sketch): mergeable quantile sketches as binary columns, which any table can keep."""
    return long_features(df, features, keys or []).groupBy(*(keys or []), "feature").agg(F.kll_sketch_agg_double("value", F.lit(size)).alias("sketch"))


def merged_sketches(parts: DataFrame, keys: list[str] | None = None, size: int = 4096) -> DataFrame:
    """One sketch for each group from sketches of its parts."""
    return parts.groupBy(*(keys or []), "feature").agg(F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"))


def sketch_edges(parts: DataFrame, n: int) -> DataFrame:
    """Quantile edges (feature, kind, edges) from sketches; ranks are off by about 3 / size."""
    q = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(i / n) for i in range(n + 1)]))
    return parts.select("feature", F.lit("quantile").alias("kind"), pad_edges(q, n).alias("edges"))


def log_edges(df: DataFrame, features: list[str], n: int, robust: bool = False) -> DataFrame:
    """Edges in equal steps of the logarithm of abs(value) + FLOOR; ends 0 and infinity.

    ``robust`` spans the 0.01 and 99.99 percentiles, at least a factor of ten.
    """
    rows = long_features(df, features, []).withColumn("value", F.abs("value") + FLOOR)
    if robust:
        ends = exact_quantiles(rows, ["feature"], [0.0001, 0.9999])
        low = F.greatest(F.col("q")[0], F.lit(FLOOR))
        ends = ends.select("feature", low.alias("low"), F.greatest(F.col("q")[1], low * 10).alias("high"))
    else:
        ends = rows.groupBy("feature").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    lo = F.log("low")
    span = F.when(F.log("high") - lo < 1e-9, 1.0).otherwise(F.log("high") - lo)
    edges = F.transform(_steps(n), lambda i: F.when(i == 0, 0.0).when(i == n, F.lit(math.inf)).otherwise(F.exp(lo + span * i / n)))
    return ends.select("feature", F.lit("log").alias("kind"), edges.alias("edges"))


def collect_edges(edges: DataFrame) -> dict[str, tuple[str, list[float]]]:
    """The bin model on the driver: features times buckets, a fixed size."""
    return {r["feature"]: (r["kind"], list(r["edges"])) for r in edges.select("feature", "kind", "edges").collect()}


def _reached(x: Column, edges: list[float], left: bool, low: int, high: int) -> Column:
    """Number of ``edges``, in order, at or below x (below it if ``left``): a balanced tree of comparisons over edges low..high."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    reached = x > edges[middle] if left else x >= edges[middle]
    return F.when(reached, _reached(x, edges, left, middle + 1, high)).otherwise(_reached(x, edges, left, low, middle))


def bucket(value: Column, edges: list[float] | Column, kind: str = "quantile", left: bool = False) -> Column:
    """Number of interior edges at or below the value (below it if ``left``); NaN goes to the last bucket."""
    x = F.abs(value) + FLOOR if kind == "log" else value
    if isinstance(edges, list):
        interior, last = sorted(map(float, edges[1:-1])), F.lit(len(edges) - 2)
        found = _reached(x.cast("double"), interior, left, 0, len(interior))
    else:
        interior, last = F.slice(edges, F.lit(2), F.size(edges) - 2), F.size(edges) - 2
        found = F.size(F.filter(interior, (lambda e: e < x) if left else (lambda e: e <= x)))
    return F.when(F.isnan(x) | x.isNull(), last).otherwise(found)


def midpoint(code: Column, edges: Column) -> Column:
    """Middle of a bucket; the outer ones extend by the width of their neighbour."""
    i = code + 1
    low, high = F.element_at(edges, i), F.element_at(edges, i + 1)
    n = F.size(edges) - 1
    first = high - (F.try_element_at(edges, i + 2) - high)
    last = low + (low - F.try_element_at(edges, F.greatest(i - 1, F.lit(1))))
    return F.when(F.abs(low) == math.inf, first).when(i == n, last).otherwise((low + high) / 2.0)


def tokens(df: DataFrame, model: dict[str, tuple[str, list[float]]], order: list[str]) -> DataFrame:
    """Append ``tokens``, the row's bucket numbers in feature order as shorts."""
    return df.withColumn("tokens", F.array(*[bucket(F.col(f), model[f][1], model[f][0]).cast("short") for f in order]))


def degenerate(edges: DataFrame) -> DataFrame:
    """Whether a feature's edges carry too little: under two interior edges, or half of them repeats."""
    interior = F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0)))
    n, distinct = F.size(interior), F.size(F.array_distinct(interior))
    return edges.select("feature", n.alias("n_interior"), distinct.alias("n_distinct"), ((n < 2) | (distinct < n * 0.5)).alias("degenerate"))


def edges_json(edges: DataFrame) -> DataFrame:
    """(feature, payload): edges as JSON with infinities as strings, and back by ``edges_from_json``."""
    text = F.transform("edges", lambda e: F.when(e == math.inf, "inf").when(e == -math.inf, "-inf").otherwise(e.cast("string")))
    return edges.select("feature", "kind", F.to_json(F.struct("feature", "kind", text.alias("edges"))).alias("payload"))


def edges_from_json(df: DataFrame) -> DataFrame:
    parsed = F.from_json("payload", "feature string, kind string, edges array<string>")
    number = lambda e: F.when(e == "inf", F.lit(math.inf)).when(e == "-inf", F.lit(-math.inf)).otherwise(e.try_cast("double"))
    return df.select(parsed.alias("p")).select("p.feature", "p.kind", F.transform("p.edges", number).alias("edges"))


def model_hash(edges: DataFrame) -> DataFrame:
    """One row: the first 16 hex digits of the SHA-256 of all edges in feature order (rounded to 6 places)."""
    line = F.concat(F.col("feature"), F.lit(":"), F.array_join(F.transform("edges", lambda e: F.when(F.abs(e) == math.inf, F.lit("inf")).otherwise(F.format_string("%.6f", e))), ","))
    whole = F.array_join(F.array_sort(F.collect_list(line)), ";")
    return edges.agg(F.substring(F.sha2(whole.cast("binary"), 256), 1, 16).alias("model_hash"))


def uniform_sample(df: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """``size`` rows, the same for every run, each equally likely: the smallest by a hash of the key."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(size)
