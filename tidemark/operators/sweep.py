"""First crossings of quotes and orders, without pairs of rows.

What happens to a quote within a horizon needs the rows of its key in two spans of time as long as
that horizon, so later rows go to two spans at most and earlier rows to one. In a span the later rows
are swept in chunks of bounded size; a chunk's sizes stand in a tree over prices and times, which
answers for many quotes at once how much volume came at or through a price before a time, and at which
row it reaches what a quote needs. Work and rows are linear in both sides but for the depth of the tree.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Later rows whose tree is built at once.
CHUNK = 1 << 17


class PriceTree:
    """Weights of rows in time order by price: a wavelet matrix of row numbers in order of prices.

    ``weights`` are any number of arrays; the last one that every tree has counts rows.
    """

    def __init__(self, price: np.ndarray, *weights: np.ndarray):
        order = np.argsort(price, kind="stable")
        self.price, self.bits = price[order], max(1, int(len(price) - 1).bit_length())
        weights = (*weights, np.ones(len(price)))
        self.sums = [np.r_[0.0, np.cumsum(w[order])] for w in weights]
        self.levels = []
        for bit in range(self.bits - 1, -1, -1):
            low = (order >> bit) & 1 == 0
            zeros = np.r_[0, np.cumsum(low)]
            self.levels.append((bit, zeros, [np.r_[0.0, np.cumsum(np.where(low, w[order], 0.0))] for w in weights]))
            order = np.r_[order[low], order[~low]]

    def upto(self, price: np.ndarray) -> np.ndarray:
        """Number of rows at or under each price; a missing price has none."""
        return np.where(np.isnan(price), 0, np.searchsorted(self.price, price, "right"))

    def total(self, rank: np.ndarray, weight: int) -> np.ndarray:
        return self.sums[weight][rank]

    def before(self, rank: np.ndarray, row: np.ndarray, weight: int) -> np.ndarray:
        """Sum over the first ``rank`` rows by price of those before ``row``."""
        left, right, total = np.zeros_like(rank), rank.copy(), np.zeros(len(rank))
        for bit, zeros, sums in self.levels:
            up = (row >> bit) & 1 == 1
            total += np.where(up, sums[weight][right] - sums[weight][left], 0.0)
            left, right = (np.where(up, zeros[-1] + x - zeros[x], zeros[x]) for x in (left, right))
        return np.where(row >= 1 << self.bits, self.sums[weight][rank], total)

    def first(self, rank: np.ndarray, target: np.ndarray, weight: int) -> np.ndarray:
        """First row at which the sum over the first ``rank`` rows by price reaches ``target`` (over 0), or a row behind the last."""
        left, right, done, row = np.zeros_like(rank), rank.copy(), np.zeros(len(rank)), np.zeros_like(rank)
        for bit, zeros, sums in self.levels:
            low = sums[weight][right] - sums[weight][left]
            up = done + low < target
            done += np.where(up, low, 0.0)
            row |= up.astype(row.dtype) << bit
            left, right = (np.where(up, zeros[-1] + x - zeros[x], zeros[x]) for x in (left, right))
        return np.where(self.sums[weight][rank] >= target, row, len(self.price))


def floats(table: pa.Table, name: str) -> np.ndarray:
    return table[name].cast(pa.float64()).to_numpy(zero_copy_only=False)


def in_time(table: pa.Table, ms: str, seq: str) -> pa.Table:
    table = table.filter(pa.compute.is_valid(table[ms]))
    return table.take(pa.compute.sort_indices(table, sort_keys=[(ms, "ascending"), (seq, "ascending")]))


def in_spans_of(left: DataFrame, right: DataFrame, key: str, horizon_ms: int, ms: str, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run(left, right)`` for every key and span of ``horizon_ms``, with all right rows that a left row's horizon reaches."""
    span = F.expr(f"{ms} div {horizon_ms}L")
    l_rows = left.withColumn("_span", span)
    r_rows = right.withColumn("_span", F.explode(F.array(span, span - 1)))
    drop = lambda t: t.drop_columns(["_span"])
    return l_rows.groupBy(key, "_span").cogroup(r_rows.groupBy(key, "_span")).applyInArrow(lambda a, b: run(drop(a), drop(b)), schema)


def first_fills(ms: np.ndarray, price: np.ndarray, size: np.ndarray, since: np.ndarray, limit: np.ndarray, need: np.ndarray, horizon_ms: int) -> np.ndarray:
    """Per quote the first row (in time order) at which sizes at or under its limit sum up to what it needs, or -1.

    Rows count from the quote's time on for ``horizon_ms``. A need of zero or less is met by the first
    row at or under the limit.
    """
    out, rest = np.full(len(since), -1), need.astype(float)
    begin, end = np.searchsorted(ms, since, "left"), np.searchsorted(ms, since + horizon_ms, "right")
    alive = (begin < end) & ~np.isnan(limit) & ~np.isnan(need)
    for start in range(0, len(ms), CHUNK):
        stop = min(len(ms), start + CHUNK)
        at = np.flatnonzero(alive & (begin < stop) & (end > start))
        if not len(at):
            continue
        tree = PriceTree(price[start:stop], size[start:stop])
        rank, first = tree.upto(limit[at]), np.maximum(begin[at] - start, 0)
        row, gone = np.empty(len(at), np.int64), np.zeros(len(at))
        for weight, mine in ((0, need[at] > 0), (1, need[at] <= 0)):
            had = tree.before(rank[mine], first[mine], weight)
            row[mine] = tree.first(rank[mine], had + (rest[at][mine] if weight == 0 else 1.0), weight)
            if weight == 0:
                gone[mine] = tree.total(rank[mine], 0) - had
        hit = row < np.minimum(end[at], stop) - start
        out[at[hit]] = start + row[hit]
        rest[at] -= gone
        alive[at[hit]] = False
    return out


def order_fills(ms: np.ndarray, price: np.ndarray, size: np.ndarray, since: np.ndarray, limit: np.ndarray, quantity: np.ndarray, horizon_ms: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, row, quantity) of every fill of orders on the rows at or under their limits.

    A row offers max(1, ``share`` of its size), or all that is open if its size is 0 or less.
    """
    cap = np.where(size > 0, np.maximum(1.0, size * share), 0.0)
    given = np.zeros(len(since))
    begin, end = np.searchsorted(ms, since, "left"), np.searchsorted(ms, since + horizon_ms, "right")
    alive = (begin < end) & (quantity > 0)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for start in range(0, len(ms), CHUNK):
        stop = min(len(ms), start + CHUNK)
        at = np.flatnonzero(alive & (begin < stop) & (end > start))
        if not len(at):
            continue
        tree = PriceTree(price[start:stop], cap[start:stop], (size[start:stop] <= 0).astype(float))
        rank = np.where(np.isposinf(limit[at]), stop - start, tree.upto(limit[at]))
        first, last = np.maximum(begin[at] - start, 0), np.minimum(end[at], stop) - start
        enough = tree.first(rank, tree.before(rank, first, 0) + quantity[at] - given[at], 0)
        empty = tree.first(rank, tree.before(rank, first, 1) + 1.0, 1)
        until = np.minimum(np.minimum(enough, empty) + 1, last)
        had = tree.before(rank, first, 2)
        # one row more than the sums say: sums in another order may be off in their last digits
        rows = np.minimum(tree.before(rank, until, 2) + 1, tree.before(rank, last, 2)) - had
        for nth in range(int(rows.max(initial=0))):
            going = np.flatnonzero((rows > nth) & (quantity[at] > given[at]))
            if not len(going):
                break
            own = at[going]
            row = start + tree.first(rank[going], had[going] + nth + 1.0, 2)
            offered = np.where(size[row] > 0, cap[row], quantity[own])
            found.append((own, row, np.minimum(offered, quantity[own] - given[own])))
            given[own] += offered
        alive[at] = quantity[at] > given[at]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
