"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Among all document rates r with 0 <= r <= ``cap`` that give every source s its share of words,
sum(r * size) = target(s), the one closest to "every document once" in relative entropy is
r = min(cap, exp(lambda(s) * size / mean size)). The multipliers minimise a convex dual, one
coordinate per source; Newton steps, kept inside a bracket, find them. Each step is one aggregation
over the table of (source, size) counts, which is exact and far smaller than the corpus.

Rates become whole copies by systematic rounding over documents in order of size, so that each
rounding error is paid back by a document of nearly the same size; what still lacks a source's
target is then made up by single copies of its smallest documents. Equal rows are counted first and
rounded as one, then share what they got, so no window grows with the repeats of a row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import free_name, word_count, written

#: Rates are counted in units of 2**-20, so that sums do not depend on their order.
UNIT = 20
#: Newton stops when every source is this close to its target, or after so many steps.
TOLERANCE, MOST_STEPS = 1e-7, 60
#: Runs that the documents of one source and of about one size are cut into, whatever the corpus's size.
RUNS = 1024
#: Equal rows that one window numbers.
SHARED_ROWS = 10_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Per source: idx (order by code point, null last), source, source_size, mean_size, target.

    ``sizes`` has source, size and n (documents of that size). Sources weigh ``weights`` in turn and
    share all words. A target stops at ``cap`` times its source's size; with the sources ordered by
    size over weight, those that stop form a prefix, so the common level is found by running sums.
    The windows here run over one row per source.
    """
    total = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("sized"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    order = total.withColumn("idx", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("idx") % len(weights) + 1).cast("int"))
    order = order.withColumn("weight", weight).withColumn("stop", F.lit(cap) * F.col("source_size"))
    full = Window.partitionBy(F.lit(0)).orderBy(F.col("stop") / F.col("weight"), "idx")
    everything = Window.partitionBy(F.lit(0))
    before, rest = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    order = order.withColumn("level", level)
    level = F.min(F.when(F.col("stop") / F.col("weight") >= F.col("level"), F.struct(F.col("stop") / F.col("weight"), F.col("idx"), F.col("level").alias("level")))).over(everything)["level"]
    target = F.least(F.col("stop"), F.coalesce(level, F.lit(math.inf)) * F.col("weight"))
    return order.select("idx", "source", "source_size", (F.col("source_size") / F.greatest(F.col("sized"), F.lit(1))).alias("mean_size"), "stop", target.alias("target"))


def _rate(size: Column, mean: Column, tilt: Column, cap: float) -> Column:
    return F.least(F.lit(cap), F.exp(F.least(tilt * size / mean, F.lit(700.0))))


def balance(sizes: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """Newton on the dual: idx and tilt (lambda), from counts (idx, size, n) and targets.

    A source whose target is its stop gets no tilt (null: every rate is the cap).
    """
    state = targets.where((F.col("target") > 0) & (F.col("target") < F.col("stop") * (1 - 1e-9))).select(
        "idx", "mean_size", "target", F.lit(0.0).alias("tilt"), F.lit(-math.inf).alias("low"), F.lit(math.inf).alias("high"), F.lit(math.inf).alias("error")
    )
    state = written(state)
    sizes = sizes.where(F.col("size") > 0)
    for _ in range(MOST_STEPS):
        x = F.col("size") / F.col("mean_size")
        rate = _rate(F.col("size"), F.col("mean_size"), F.col("tilt"), cap)
        mass = F.col("n") * F.col("size") * rate
        sums = sizes.join(state.select("idx", "mean_size", "tilt"), "idx").groupBy("idx").agg(F.sum(mass).alias("mass"), F.sum(F.when(rate < cap, mass * x).otherwise(0.0)).alias("slope"))
        gap = F.log(F.col("mass") / F.col("target"))
        low = F.when(gap < 0, F.greatest("low", "tilt")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.least("high", "tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - gap * F.col("mass") / F.col("slope")
        halved = F.when(F.col("low") == -math.inf, F.col("high") * 2 - 1).when(F.col("high") == math.inf, F.col("low") * 2 + 1).otherwise((F.col("low") + F.col("high")) / 2)
        nxt = state.join(sums, "idx").withColumns({"low": low, "high": high, "error": F.abs(gap)})
        inside = (F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        step = F.when(F.col("error") < TOLERANCE, F.col("tilt")).when(inside, newton).otherwise(halved)
        state = written(nxt.select("idx", "mean_size", "target", step.alias("tilt"), "low", "high", "error"))
        worst = state.agg(F.max("error")).first()[0]
        if worst is None or worst < TOLERANCE:
            break
    # six places: the last bits of a distributed sum may differ between runs, the result must not
    return state.select("idx", F.round("tilt", 6).alias("tilt"))


def _content(df: DataFrame, columns: list[str]) -> Column:
    """A hash of the columns in which a null is not the same as no column; it only orders rows."""
    return F.xxhash64(*[part for c in columns for part in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())])


def _shared(groups: DataFrame) -> DataFrame:
    """Rows with ``copies``: ``all_copies`` of a group of ``m`` equal rows, dealt out evenly, the first rows getting one more."""
    single = groups.where("m = 1").withColumn("copies", F.col("all_copies"))
    same = ["idx", "size", "id", "row_key", "salt"]
    many = groups.where("m > 1").withColumn("salt", F.pmod(F.xxhash64("row_id"), F.ceil(F.col("m") / SHARED_ROWS)))
    before = Window.partitionBy(*same[:-1]).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = many.groupBy(*same).agg(F.count("*").alias("own")).withColumn("before", F.coalesce(F.sum("own").over(before), F.lit(0))).select(F.col("id").alias("g_id"), *[c for c in same if c != "id"], "before")
    many = many.withColumn("nth", F.row_number().over(Window.partitionBy(*same).orderBy("row_id")))
    many = many.join(counts, (many["id"].eqNullSafe(counts["g_id"])) & _equal(many, counts, ["idx", "size", "row_key", "salt"])).select(many["*"], "before")
    more = F.when(F.col("nth") + F.col("before") <= F.pmod("all_copies", "m"), 1).otherwise(0)
    return single.unionByName(many.withColumn("copies", F.expr("all_copies div m") + more).drop("salt", "before", "nth"))


def _offsets(rows: DataFrame, value: Column, bins: Column) -> DataFrame:
    """Per run (idx, bin, part) the sum of ``value`` over the runs before it: the bins before (a few hundred a source) and the parts before in its bin."""
    sums = rows.groupBy("idx", "bin", "part").agg(F.sum(value).alias("all"))
    over = lambda w: F.coalesce(F.sum("all").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = sums.groupBy("idx", "bin").agg(F.sum("all").alias("all")).select("idx", "bin", over(Window.partitionBy("idx").orderBy(bins)).alias("before"))
    parts = sums.withColumn("inside", over(Window.partitionBy("idx", "bin").orderBy("part")))
    return parts.join(whole, ["idx", "bin"]).select("idx", "bin", "part", (F.col("before") + F.col("inside")).alias("offset"))


def _equal(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & (left[c] == right[c])
    return out


def mix_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, row_col: str | None = None) -> DataFrame:
    """One row per row of ``df``: id, row_id, size, source_size, target, rate, copies, taken.

    size is the number of words (null text: 0) and taken = copies * size, at most ``cap`` times the
    size. A null source is a source of its own, the last. Documents without words keep one copy and
    take 0 words. Repeated rows are rows of their own; which of several equal rows gets a copy more is
    open, the multiset of results is not. An empty table gives an empty table. row_id is ``row_col``,
    a unique long, or made here; it tells rows apart and decides nothing else.
    """
    content = [c for c, kind in df.dtypes if c != row_col and "map<" not in kind]
    row_id = F.monotonically_increasing_id() if row_col is None else F.col(f"`{row_col}`")
    col = lambda c: F.col(f"`{c}`")
    rows = written(df.select(col(id_col).alias("id"), col(source_col).cast("string").alias("source"), word_count(col(text_col)).alias("size"), _content(df, content).alias("row_key"), row_id.alias("row_id")))
    sizes = written(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    targets = written(source_targets(sizes, weights, cap))
    named = targets.select("idx", F.col("source").alias("s"))
    same = F.col("source").eqNullSafe(F.col("s"))
    sizes = written(sizes.join(named, same).select("idx", "size", "n"))
    tilts = balance(sizes, targets, cap)

    # runs: a source's documents by size, in bins of about a tenth, each cut by a hash
    bin_of = F.when(F.col("size") > 0, F.floor(F.log(F.col("size").cast("double")) * 10)).otherwise(-1).cast("int")
    rate = F.when(F.col("target") <= 0, 0.0).when(F.col("tilt").isNull(), float(cap)).otherwise(_rate(F.col("size"), F.col("mean_size"), F.col("tilt"), float(cap)))
    per_source = targets.join(tilts, "idx", "left").select("idx", F.col("source").alias("s"), "mean_size", "target", "tilt")
    groups = rows.groupBy("source", "size", "id", "row_key").agg(F.count("*").alias("m"))
    part = F.pmod(F.xxhash64("row_key"), F.lit(RUNS)).cast("int")
    units = F.when(F.col("size") > 0, F.round(rate * (1 << UNIT))).otherwise(0).cast("long")
    placed = groups.join(per_source, same).select("idx", bin_of.alias("bin"), part.alias("part"), "id", "row_key", "size", "m", units.alias("rate"))
    run = ["idx", "bin", "part"]
    inside = Window.partitionBy(*run).orderBy(F.col("size").desc(), "id", "row_key").rowsBetween(Window.unboundedPreceding, 0)
    offsets = _offsets(placed, F.col("rate") * F.col("m"), F.col("bin").desc())
    whole = lambda c: F.shiftright(c + (1 << UNIT - 1), UNIT)
    rounded = placed.withColumn("upto", F.sum(F.col("rate") * F.col("m")).over(inside)).join(offsets, run).withColumn("upto", F.col("upto") + F.col("offset"))
    copies = F.when(F.col("size") > 0, whole(F.col("upto")) - whole(F.col("upto") - F.col("rate") * F.col("m"))).otherwise(F.col("m"))
    rounded = written(rounded.select(*run, "id", "row_key", "size", "m", "rate", copies.alias("copies")))

    # what a source still lacks or has too much, made up by its smallest documents, one copy each
    taken = rounded.groupBy("idx").agg(F.sum(F.col("size") * F.col("copies")).alias("has"))
    lack = targets.join(taken, "idx").select("idx", "source_size", "target", (F.round("target").cast("long") - F.col("has")).alias("lack"))
    able = F.when(F.col("size") == 0, 0).when(F.col("lack") > 0, F.least("m", F.col("m") * cap - F.col("copies"))).when(F.col("lack") < 0, F.least("m", "copies")).otherwise(0)
    open_ = rounded.join(F.broadcast(lack) if targets.count() <= 10_000 else lack, "idx").withColumn("able", able.cast("long")).withColumn("fits", F.col("able") * F.col("size"))
    offsets = _offsets(open_, F.col("fits"), F.col("bin"))
    inside = Window.partitionBy(*run).orderBy("size", "id", "row_key").rowsBetween(Window.unboundedPreceding, 0)
    final = open_.withColumn("upto", F.sum("fits").over(inside)).join(offsets, run)
    left = F.abs("lack") - (F.col("upto") + F.col("offset") - F.col("fits"))
    some = F.greatest(F.lit(0), F.least(F.col("able"), F.floor(left / F.greatest("size", F.lit(1))))) * F.signum("lack").cast("int")
    final = final.select(F.col("idx"), F.col("id").alias("g_id"), F.col("size").alias("g_size"), F.col("row_key").alias("g_key"), "source_size", "target", "rate", "m", (F.col("copies") + some).alias("all_copies"))
    final = final.join(named.select(F.col("idx").alias("i"), "s"), F.col("idx") == F.col("i"))
    matched = (F.col("row_key") == F.col("g_key")) & (F.col("size") == F.col("g_size")) & F.col("id").eqNullSafe(F.col("g_id")) & same
    dealt = _shared(written(rows.join(final, matched).select("idx", "row_id", "id", "row_key", "size", "source_size", "target", "rate", "m", "all_copies")))
    return dealt.select(
        F.col("id").alias(id_col), "row_id", "size", "source_size", "target", (F.col("rate") / (1 << UNIT)).alias("rate"), F.col("copies").cast("int").alias("copies"), (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """The mix itself: the rows of ``df``, each as often as ``mix_table`` says, with the columns of ``df``.

    Rows are told apart by a number that is written with them, so equal rows and rows that differ in
    any column are all kept, each with its own copies. A null text has no words; such rows, and empty
    texts, stay once. An empty table stays empty. Columns that have the names used inside are kept.
    """
    row_id, copies = free_name(df, "row_id"), free_name(df, "row_copies")
    rows = written(df.withColumn(row_id, F.monotonically_increasing_id()))
    table = mix_table(rows, id_col, text_col, source_col, weights, cap, row_id).where("copies > 0").select(F.col("row_id").alias(row_id), F.col("copies").alias(copies))
    rows = rows.join(table, row_id)
    return rows.withColumn(copies, F.explode(F.array_repeat(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in df.columns])
