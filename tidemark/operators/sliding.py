"""Order statistics of the last rows, and the most frequent value of a group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..sources.shared import written
from .windows import by, in_blocks

#: Values that a group's sketch keeps; a value that it lost is rarer than ``LOST`` / TRACKED of the group.
TRACKED, LOST = 1024, 3.5


class RankTree:
    """A Fenwick tree of counts over ranks: a rank comes, goes and is found by its place in logarithmic time."""

    def __init__(self, ranks: int):
        self.tree, self.top, self.size = [0] * (ranks + 1), 1 << max(0, ranks.bit_length() - 1), 0

    def add(self, rank: int, n: int) -> None:
        self.size += n
        at, tree = rank + 1, self.tree
        while at < len(tree):
            tree[at] += n
            at += at & -at

    def find(self, place: int) -> int:
        """The rank in that place of the order (from 0)."""
        at, step, tree = 0, self.top, self.tree
        while step:
            to = at + step
            if to < len(tree) and tree[to] <= place:
                at, place = to, place - tree[to]
            step >>= 1
        return at


def sliding_quantiles(values: np.ndarray, frame: int, levels: list[float]) -> np.ndarray:
    """Per row the quantiles of the last ``frame`` rows, linear between places; NaN takes no part and is the result of none."""
    distinct, rank = np.unique(values, return_inverse=True)
    tree, out, known = RankTree(len(distinct)), np.full((len(values), len(levels)), np.nan), ~np.isnan(values)
    ranks = rank.tolist()
    for i, r in enumerate(ranks):
        if known[i]:
            tree.add(r, 1)
        if i >= frame and known[i - frame]:
            tree.add(ranks[i - frame], -1)
        for k, level in enumerate(levels if tree.size else []):
            place = level * (tree.size - 1)
            low = distinct[tree.find(int(place))]
            part = place - int(place)
            out[i, k] = low + part * (distinct[tree.find(int(place) + 1)] - low) if part else low
    return out


def rolling_percentiles(df: DataFrame, key: str, ms: str, seq: str, value: str, levels: dict[str, float], frame: int = 2000) -> DataFrame:
    """Append percentiles of ``value`` over the key's last ``frame`` rows, by name."""
    names = list(levels)

    def append(rows: DataFrame, _) -> DataFrame:
        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("_pos")
            found = sliding_quantiles(table[value].cast(pa.float64()).to_numpy(zero_copy_only=False), frame, list(levels.values()))
            for k, name in enumerate(names):
                table = table.append_column(name, pa.array(found[:, k], pa.float64(), from_pandas=True))
            return table

        schema = StructType([*rows.schema.fields, *[StructField(n, DoubleType()) for n in names]])
        return rows.groupBy(key, "_block").applyInArrow(run, schema)

    return in_blocks(df, key, ms, seq, append, back=frame)


def last_percentiles(df: DataFrame, key: str, ms: str, seq: str, value: str, levels: dict[str, float], rows: int = 2000) -> DataFrame:
    """One row per key: percentiles of ``value`` over its last ``rows`` rows."""
    newest = df.withColumn("_nth", F.row_number().over(by(key, F.desc(ms), F.desc(seq)))).where(F.col("_nth") <= rows)
    return newest.groupBy(key).agg(*[F.percentile(value, p).alias(name) for name, p in levels.items()])


def most_frequent(df: DataFrame, keys: list[str], value: str, tracked: int = TRACKED) -> DataFrame:
    """(keys.., value, n): each group's most frequent value, ties to the smallest; nulls are no value.

    A mergeable sketch names candidates, which are then counted exactly. What a sketch of ``tracked``
    values may have lost is rarer than ``LOST / tracked`` of the group; where the best candidate is not
    over that, the group's values are all counted. A hot value is added up before it is shuffled. Rows
    with a null key are left out.
    """
    rows = df.dropna(subset=[*keys, value]).select(*keys, value)
    sketch = F.call_function("approx_top_k", F.col(value), F.lit(min(tracked, 32)), F.lit(tracked))
    groups = written(rows.groupBy(*keys).agg(sketch.alias("top"), F.count("*").alias("all")))
    named = groups.select(*keys, "all", F.explode("top.item").alias(value))
    exact = rows.join(named, [*keys, value]).groupBy(*keys, "all", value).agg(F.count("*").alias("n"))
    first = lambda x: x.withColumn("_nth", F.row_number().over(by(keys, F.desc("n"), value))).where("_nth = 1").drop("_nth")
    best = written(first(exact))
    sure = F.col("n") > F.col("all") * (LOST / tracked)
    open_ = groups.select(*keys).join(best.where(sure).select(*keys), keys, "left_anti")  # a sketch may also have lost all
    whole = rows.join(open_, keys, "left_semi").groupBy(*keys, value).agg(F.count("*").alias("n"))
    return best.where(sure).select(*keys, value, "n").unionByName(first(whole))
