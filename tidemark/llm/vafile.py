"""Exact top-k by inner product with a vector-approximation file (Weber, Schek and Blott, 1998).

Every component is cut into cells of equal width; a vector's approximation is its row of cell
numbers. Queries first scan approximations only: the cells bound each inner product from both
sides, and a candidate whose upper bound lies under the k-th best lower bound of all blocks is out.
The exact vectors of the rest are then read in order of their upper bounds, in rounds, until the k-th
result is certain.

Equal vectors are one class: it is searched once, as query and as candidate, and is represented by
its k + 1 smallest ids, which is all that any query can need of it. Classes are dealt into blocks
of bounded size and every block of query classes meets every block of candidate classes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import written

#: Bits of a cell number; classes in a block; salts over which a class's ids are first cut down.
CELL_BITS, QUERY_BLOCK, CANDIDATE_BLOCK, SALTS = 6, 4096, 32768, 32
#: Times k + 1 exact vectors of a query that are read before a floor is taken from them.
FIRST = 2


def scaled(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component, x as double, as long; null if the vector takes no part.

    A vector takes no part if it is null or empty or has a null, NaN or infinite component.
    """
    sound = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(math.inf)))
    most = float(1 << 61)
    return F.when(sound, F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), x.cast("double") * factor))).cast("long")))


def _smallest_ids(rows: DataFrame, k: int) -> DataFrame:
    """Per class (v) its k + 1 smallest ids, first within salts so that no task sees a whole class."""
    salted = Window.partitionBy("v", "salt").orderBy("vec_id")
    some = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).withColumn("nth", F.row_number().over(salted)).where(F.col("nth") <= k + 1)
    whole = Window.partitionBy("v").orderBy("vec_id")
    some = some.drop("nth", "salt").withColumn("nth", F.row_number().over(whole)).where(F.col("nth") <= k + 1)
    return some.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # at most k + 1


def _edges(low: np.ndarray, width: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = low + cells * width
    return first, first + width - 1


def scan(k: int):
    """One block of query classes (exact) against one block of candidate approximations.

    What can still be among the block's own k + 1 best leaves with both bounds; ``best`` marks the
    rows that hold its k + 1 best lower bounds.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"q_class": [], "c_class": [], "copies": [], "upper": [], "lower": [], "best": []}
        if left.num_rows and right.num_rows:
            dim = len(left["q_v"][0])
            matrix = lambda t, c: t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
            query, cells, low, width = matrix(left, "q_v"), matrix(right, "cells"), matrix(right.slice(0, 1), "low"), matrix(right.slice(0, 1), "width")
            q_class, c_class = left["q_class"].to_numpy(), right["class"].to_numpy()
            copies = np.minimum(right["many"].to_numpy(), k + 1)
            first, last = _edges(low, width, cells)
            step = max(1, (4 << 20) // len(cells))  # bounds of at most so many pairs at once
            for at in range(0, len(query), step):
                part = query[at : at + step]
                plus, minus = np.maximum(part, 0), np.minimum(part, 0)
                # float64 sums are exact for usual vectors; for huge components the bounds give way by their rounding error
                slack = np.abs(part) @ np.maximum(np.abs(first), np.abs(last)).T * (dim * 2.0**-52)
                slack[slack < 0.25] = 0.0
                upper = plus @ last.T + minus @ first.T + slack
                lower = plus @ first.T + minus @ last.T - slack
                for i in range(len(part)):
                    # k + 1 rows are enough for every query of the class, whichever its own row is
                    best = np.argpartition(-lower[i], min(k, len(cells) - 1))[: k + 1]
                    order = best[np.argsort(-lower[i][best], kind="stable")]
                    enough = np.searchsorted(np.cumsum(copies[order]), k + 1)
                    floor = lower[i][order[enough]] if enough < len(order) else -np.inf
                    near = np.flatnonzero(upper[i] >= floor)
                    rows = {"q_class": np.full(len(near), q_class[at + i]), "c_class": c_class[near], "copies": copies[near], "upper": upper[i][near], "lower": lower[i][near], "best": np.isin(near, order[: enough + 1])}
                    for c, x in rows.items():
                        out[c].append(x)
        kinds = {"upper": pa.float64(), "lower": pa.float64(), "best": pa.bool_()}
        return pa.table({c: pa.array(np.concatenate(x) if x else [], kinds.get(c, pa.int64())) for c, x in out.items()})

    return run


def _floors(rows: DataFrame, value: str, k: int) -> DataFrame:
    """(q_class, floor): per query the greatest ``value`` that k + 1 rows reach, copies counted; none where there are fewer."""
    upto = Window.partitionBy("q_class").orderBy(F.desc(value), "c_class").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("have", F.sum("copies").over(upto)).where(F.col("have") > k).groupBy("q_class").agg(F.max(value).alias("floor"))


def _hopeful(rows: DataFrame, floors: DataFrame) -> DataFrame:
    return rows.join(floors, "q_class", "left").where("floor is null or upper >= floor").drop("floor")


def _exact(left: Column, right: Column) -> Column:
    """Inner products of integer vectors, at the ends of a long if they are beyond it."""

    @F.pandas_udf("long")
    def product(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(a), np.int64)
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            x, y = np.asarray(x, np.int64), np.asarray(y, np.int64)
            if float(np.abs(x.astype(float)).max()) * float(np.abs(y.astype(float)).max()) * len(x) < 2.0**62:
                out[i] = x @ y
            else:
                out[i] = max(-(2**63), min(2**63 - 1, sum(int(p) * int(q) for p, q in zip(x, y, strict=True))))
        return pd.Series(out)

    return product(left, right)


def survivors(classes: DataFrame, k: int) -> DataFrame:
    """(q_class, c_class, copies, upper, lower) of what can be among a query's k + 1 best by the bounds alone.

    Each block's best lower bounds give one floor a query over all blocks, so what survives does not
    grow with their number.
    """
    # the grid of each dimension
    grid = classes.select("dim", F.posexplode("v").alias("pos", "x")).groupBy("dim", "pos").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    grid = grid.withColumn("width", F.expr(f"greatest(1L, (high - low + {2**CELL_BITS}) div {2**CELL_BITS})"))
    by_pos = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda x: x[c])
    grid = grid.groupBy("dim").agg(by_pos("low").alias("low"), by_pos("width").alias("width"))
    coded = classes.join(grid, "dim").withColumn("cells", F.expr("transform(v, (x, i) -> cast((x - low[i]) div width[i] as smallint))"))
    sums = classes.groupBy("dim").agg(F.ceil(F.count("*") / CANDIDATE_BLOCK).cast("int").alias("c_blocks"), F.greatest(F.lit(1), F.ceil(F.sum("asks") / QUERY_BLOCK).cast("int")).alias("q_blocks"))
    spread = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    right = coded.join(sums, "dim").select("dim", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("qb"), spread("c_blocks").alias("cb"), "class", "many", "cells", "low", "width")
    left = classes.where("asks = 1").join(sums, "dim").select("dim", spread("q_blocks").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("c_blocks") - 1)).alias("cb"), "class", "v")
    left = left.toDF("q_dim", "q_qb", "q_cb", "q_class", "q_v")  # names of its own: both sides come from one table
    near = left.groupBy("q_dim", "q_qb", "q_cb").cogroup(right.groupBy("dim", "qb", "cb")).applyInArrow(scan(k), "q_class long, c_class long, copies long, upper double, lower double, best boolean")
    near = written(near)
    return _hopeful(near, _floors(near.where("best"), "lower", k)).drop("best")


def read_exact(near: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(q_class, c_class, score) with the k + 1 best of every query: exact vectors are read by upper bound, in two rounds.

    The first reads each query's ``FIRST`` greatest upper bounds; its scores give a floor, and the
    second reads whatever can still reach that.
    """
    exact = classes.select(F.col("class").alias("c_class"), F.col("v").alias("w"))
    asking = classes.where("asks = 1").select(F.col("class").alias("q_class"), "v")
    score = lambda rows: rows.join(exact, "c_class").join(asking, "q_class").select("q_class", "c_class", "copies", _exact(F.col("v"), F.col("w")).alias("score"))
    by_upper = Window.partitionBy("q_class").orderBy(F.desc("upper"), "c_class")
    near = written(near.withColumn("nth", F.row_number().over(by_upper)))
    first = written(score(near.where(F.col("nth") <= FIRST * (k + 1))))
    rest = _hopeful(near.where(F.col("nth") > FIRST * (k + 1)), _floors(first, "score", k))
    read = written(first.unionByName(score(rest)))
    return read.join(_floors(read, "score", k), "q_class", "left").where("floor is null or score >= floor").select("q_class", "c_class", "score")


def top_k(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best rows of every query, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``; candidates are all other rows. Only
    vectors of equal dimension meet. A row without id, and a vector that ``scaled`` refuses, takes
    no part. Repeated rows (equal id and vector) count once; a query's own id is never its result.
    Components stop at 2**61 either way after scaling, scores at the ends of a long.
    """
    rows = df.select(F.col(id_col).alias("vec_id"), scaled(F.col(vector_col), factor).alias("v")).where("vec_id is not null and v is not null").distinct()
    rows = written(rows)
    classes = _smallest_ids(rows, k)
    counts = rows.groupBy("v").agg(F.count("*").alias("many"), F.max((F.col("vec_id") % every == 0).cast("int")).alias("asks"))
    classes = classes.join(counts, "v").withColumn("class", F.element_at("ids", 1)).withColumn("dim", F.size("v"))
    # an id with two vectors could name two classes; the position among equal names tells them apart
    named = Window.partitionBy("class").orderBy("v")
    classes = classes.withColumn("class", F.xxhash64("class", F.row_number().over(named)))
    classes = written(classes)
    read = read_exact(survivors(classes, k), classes, k)
    found = read.join(classes.select(F.col("class").alias("c_class"), F.explode("ids").alias("vec_id")), "c_class")
    best = Window.partitionBy("q_class").orderBy(F.col("score").desc(), "vec_id")
    found = found.withColumn("nth", F.row_number().over(best)).select("q_class", "vec_id", "score", "nth")
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v").join(classes.select("v", F.col("class").alias("q_class")), "v").select("query_id", "q_class")
    # k + 1 rows of the class and, where an id has several vectors, those of its own id
    out = queries.join(found, "q_class").where("query_id <> vec_id")
    ranked = Window.partitionBy("query_id", "q_class").orderBy(F.col("score").desc(), "vec_id")
    return out.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast("long").alias("score"))
