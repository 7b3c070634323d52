"""Near-duplicate vectors by random-hyperplane sign hashing (Charikar, 2002), verified exactly.

Equal vectors are one class. Each class gets, in several tables, the signs of its products with
random directions as a key; classes that share a key in any table are compared by their exact
cosine. Keys are longer the more classes there are, so that a key that random vectors share has a
bounded number of them, and there are as many tables as the recall at the least cosine asks for.

A pair that several tables find is counted in the first of them only, which both sides know from
their keys. Keys that many classes share are compared in blocks of bounded size. What leaves a block
is one row per class: how many vectors it links with there, and the root of its links; never pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .util import written

#: Classes of a block of a large key; classes of the small keys that are compared together.
BLOCK, TOGETHER = 1024, 4096
#: Classes that share a key and are compared pair by pair, among others.
SMALL = 64
#: Bits of a key beyond the logarithm of the number of classes: one random vector in four shares it.
EXTRA_BITS = 2
#: Chance that a pair at exactly the least cosine is found; closer pairs are found more surely.
RECALL = 0.99


def plan(classes: int, least: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for a number of classes: a pair at cosine ``least`` shares a key with chance ``recall``."""
    bits = min(62, max(4, math.ceil(math.log2(max(2, classes))) + EXTRA_BITS))
    agree = (1 - math.acos(least) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree))) if agree < 1 else 1


def takes_part(vector: Column) -> Column:
    """Whether a vector can link: not null or empty, all components finite, one of them not zero."""
    sound = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(math.inf)))
    return F.coalesce((F.size(vector) > 0) & sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def _units(column) -> np.ndarray:
    """Vectors of one dimension in rows, as doubles, by their lengths."""
    rows = np.array(column.to_pylist() if hasattr(column, "to_pylist") else list(column), np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)  # squares stay finite
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def sign_keys(vector: Column, bits: int, tables: int, seed: int) -> Column:
    """Per table a long with one bit a hyperplane, set on its positive side."""

    @F.pandas_udf("array<long>")
    def keys(vectors: pd.Series) -> pd.Series:
        out, dims = np.empty(len(vectors), object), vectors.map(len).to_numpy()
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            planes = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), tables * bits))
            above = (_units(vectors.iloc[at]) @ planes > 0).reshape(len(at), tables, bits)
            codes = (above * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)
            out[at] = list(codes)
        return pd.Series(out)

    return keys(vector)


def _pairs(unit: np.ndarray, keys: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, least: float, rough: bool) -> np.ndarray:
    """Which of the pairs (a, b) of rows have the cosine and don't share a key of an earlier table.

    Pairs that are nearly all near (``rough``) are first asked for earlier tables, which is the cheaper test.
    """
    keep = np.empty(len(a), bool)
    for at in range(0, len(a), 1 << 16):
        i, j = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
        left = np.ones(len(i), bool)
        for test in ("table", "cosine") if rough else ("cosine", "table"):
            at_left = np.flatnonzero(left)
            x, y = i[at_left], j[at_left]
            if test == "cosine":
                left[at_left] = np.einsum("ij,ij->i", unit[x], unit[y]) >= least
            else:
                earlier = (keys[x] == keys[y]) & (np.arange(keys.shape[1]) < table[x][:, None])
                left[at_left] = ~earlier.any(axis=1)
        keep[at : at + len(left)] = left
    return keep


def _compare(least: float):
    def run(rows: pa.Table) -> pa.Table:
        of = lambda c: rows[c].to_numpy()
        order = np.lexsort((of("class"), of("key"), of("table")))
        rows = rows.take(pa.array(order))
        key, table, name, copies, part = of("key"), of("table"), of("class"), of("copies"), of("part")
        unit = _units(rows["v"])
        keys = np.array(rows["keys"].to_pylist(), np.int64)
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (table[1:] != table[:-1])])
        many = np.diff(np.r_[starts, len(key)])
        links, total = [np.empty((2, 0), np.int64)], np.zeros(len(key), np.int64)
        size, nth = np.repeat(many, many), np.arange(len(key)) - np.repeat(starts, many)
        apart = rows["i"][0].as_py() != rows["j"][0].as_py()  # two parts of a large key meet

        def take(a: np.ndarray, b: np.ndarray, rough: bool = False) -> None:
            if apart:
                other = part[a] != part[b]
                a, b = a[other], b[other]
            near = _pairs(unit, keys, table, a, b, least, rough)
            a, b = a[near], b[near]
            np.add.at(total, a, copies[b])
            np.add.at(total, b, copies[a])
            star = np.unique(np.stack([a, b]), axis=1) if len(a) < 1 << 12 else _forest(a, b, len(key))
            links.append(star)

        for d in range(1, int(min(SMALL, many.max()))):
            a = np.flatnonzero((size <= SMALL) & (nth + d < size))
            take(a, a + d)
        for start, n in zip(starts[many > SMALL], many[many > SMALL], strict=True):
            for at in range(start, start + n, 64):
                end = min(at + 64, start + n)
                # a rough product first; the pairs near or past the bound are computed like all others
                i, j = np.nonzero(unit[at:end] @ unit[at : start + n].T >= least - 1e-9)
                ahead = j > i
                take(i[ahead] + at, j[ahead] + at, True)
        a, b = np.concatenate(links, axis=1)
        label = _labels(a, b, len(key))
        has = np.flatnonzero(total > 0)
        return pa.table({"class": pa.array(name[has], pa.int64()), "n": pa.array(total[has], pa.int64()), "root": pa.array(name[label[has]], pa.int64())})

    return run


def _labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    label = np.arange(n)
    while len(a):
        last = label.copy()
        np.minimum.at(label, b, last[a])
        np.minimum.at(label, a, last[b])
        label = label[label]
        if (label == last).all():
            break
    return label


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    label = _labels(a, b, n)
    at = np.flatnonzero(label != np.arange(n))
    return np.stack([label[at], at])


def near_vectors(df: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """One row per row of ``df``: vec_id, n_links, component_id, kept.

    Vectors link at a cosine of ``least`` or more; n_links counts a row's links with other rows,
    copies among them, and component_id is the smallest id reachable through links. There are no
    false links; a pair at exactly ``least`` is missed with a chance of ``1 - recall``, nearer ones
    less. Vectors that are null, empty or zero or have null or non-finite components link with
    nothing, and only equal dimensions link. Repeated rows are rows of their own. A null id is never
    a component's id unless all are null, and is never kept. An empty table stays empty; other
    columns are not read.
    """
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).withColumn("part", takes_part(F.col("v")))
    sound = rows.where("part").drop("part")
    classes = sound.groupBy("v").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()))  # names that hold once they are written
    bits, tables = plan(classes.count(), least, recall)
    coded = written(classes.select("class", "copies", "v", F.size("v").alias("dim"), sign_keys(F.col("v"), bits, tables, seed).alias("keys")))
    # keys first, without vectors: only what shares a key goes on
    keyed = coded.select("class", "dim", F.posexplode("keys").alias("table", "key"))
    shared = keyed.groupBy("dim", "table", "key").agg(F.count("*").alias("many")).where("many > 1")
    keyed = written(keyed.join(shared, ["dim", "table", "key"]))
    groups = F.greatest(F.lit(1), F.ceil(F.lit(max(1, keyed.count())) / TOGETHER)).cast("int")
    parts = F.when(F.col("many") > SMALL, F.ceil(F.col("many") / block)).otherwise(1).cast("int")
    # small keys are dealt into groups, every large one is a group, in blocks i <= j of its parts
    group = F.when(F.col("many") > SMALL, F.xxhash64("table", "key")).otherwise(F.pmod(F.xxhash64("table", "key"), groups).cast("long"))
    keyed = keyed.withColumns({"parts": parts, "group": group, "large": F.col("many") > SMALL}).withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    keyed = keyed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keyed = keyed.select("class", "dim", "table", "key", "large", "group", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    met = keyed.join(coded.drop("dim"), "class").groupBy("dim", "large", "group", "i", "j").applyInArrow(_compare(least), "class long, n long, root long")
    met = written(met)
    counts = met.groupBy("class").agg(F.sum("n").alias("n"))
    roots = components(met.select(F.col("class").alias("a"), F.col("root").alias("b")).where("a <> b"))
    named = classes.select("class", "low", "copies", "v").join(counts, "class", "left").join(roots.withColumnRenamed("node", "class"), "class", "left")
    named = written(named.select("v", "low", "copies", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "class").alias("root")))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(lows, "root").select("v", (F.col("copies") - 1 + F.col("n")).alias("n_links"), "component_id")
    out = sound.join(named, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where("not part").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
