"""Stateful stream operators on rows in event time.

Spark hands a key's rows of a micro-batch over in no order, in frames of bounded size. ``InOrder``
keeps them in state, in spans of event time, until the watermark has passed them, and a timer, one a
key, then takes them out span by span, sorted. So an operator sees every key's rows in order over all
micro-batches, a worker holds one span and not a key's micro-batch, and rows behind the watermark
(the newest event time less the allowed delay) are late and dropped, wherever micro-batches end.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator
from itertools import chain
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State of keyed processors lives in RocksDB, so it may exceed memory.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TOB = "product_id string, ms long, seq long, bid_px double, bid_sz double, ask_px double, ask_sz double"
OFI = "product string, ms long, seq long, ofi double, micro double, first_tick boolean"
GATE = "account string, ms long, seq long, notional double, approved boolean, notional_1m double, orders_1s long"
FILLS = "product string, order_id long, kind string, ms long, seq long, fill_qty double, fill_px double, open_qty double"
#: Rows held before they go to state; rows of a span at first; the delay of the watermark.
HELD, SPAN_ROWS, LATE = 1 << 17, 4096, "0 seconds"
#: Blocks of pairs: runs of ``n`` of the trades ``t_id`` from place ``first`` on; what stands for a null id.
BLOCKS, NO_ID = "q_id array<long>, first array<int>, n array<int>, t_id array<long>", -(1 << 63)
#: Rows of a side that are kept together and that stand in a block (a reader lays open one block at a time); horizons of a span.
PART_ROWS, BLOCK_ROWS, HORIZONS = 4096, 128, 8


class InOrder(StatefulProcessor):
    """A key's rows in the order of ``order`` (``ms`` first) once the watermark has passed them.

    Subclasses read their state in ``load``, turn sorted rows into output in ``advance``, which is
    called once a span, and write their state in ``save``. A span is as wide as holds about
    ``SPAN_ROWS`` rows when the buffer starts to fill.
    """

    order = ["ms", "seq"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.width = handle.getValueState("width", "ms long")
        self.parts = handle.getMapState("parts", "span long", "n int")
        self.rows = handle.getMapState("rows", "span long, nth int", "rows binary")
        self.timer = handle.getValueState("timer", "ms long")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None: ...

    def load(self, key: Any) -> None: ...

    def advance(self, key: Any, frame: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def passed(self, key: Any, watermark: int) -> pd.DataFrame | None:
        """Output that is due at the watermark even if no row came."""

    def later(self) -> int | None:
        """When ``passed`` is due next."""

    def save(self) -> None: ...

    def _wake(self, ms: int) -> None:
        """Have the key's one timer expire at ``ms`` or before."""
        set_to = self.timer.get()[0] if self.timer.exists() else None
        if set_to is None or ms < set_to:
            if set_to is not None:
                self.handle.deleteTimer(set_to)
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def _keep(self, frames: list[pd.DataFrame]) -> None:
        frame = pd.concat(frames, ignore_index=True)
        ms = frame["ms"].to_numpy()
        if not self.width.exists():
            self.width.update((max(1, int(ms.max() - ms.min()) * SPAN_ROWS // len(ms)),))
        span = ms // self.width.get()[0]
        for at in np.split(np.argsort(span, kind="stable"), np.flatnonzero(np.diff(np.sort(span))) + 1):
            self._put(int(span[at[0]]), frame.iloc[at])
        self._wake(int(ms.min()))

    def _put(self, span: int, frame: pd.DataFrame) -> None:
        n = self.parts.getValue((span,))[0] if self.parts.containsKey((span,)) else 0
        batch = pa.RecordBatch.from_pandas(frame, preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        self.rows.updateValue((span, n), (sink.getvalue().to_pybytes(),))
        self.parts.updateValue((span,), (n + 1,))

    def _take(self, span: int, n: int) -> pd.DataFrame:
        tables = []
        for nth in range(n):
            tables.append(pa.ipc.open_stream(bytes(self.rows.getValue((span, nth))[0])).read_all())
            self.rows.removeKey((span, nth))
        self.parts.removeKey((span,))
        return pa.concat_tables(tables, promote_options="permissive").to_pandas()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for frame in rows:
            frame = frame.drop(columns="event_time")
            held.append(frame)
            n += len(frame)
            if n >= HELD:
                self._keep(held)
                held, n = [], 0
        if n:
            self._keep(held)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        self.load(key)
        wake = []
        if self.width.exists():
            width = self.width.get()[0]
            spans = sorted((span, n) for (span,), (n,) in self.parts.iterator())
            left = len(spans)
            for span, n in spans:
                if span * width > now:
                    wake.append(span * width)
                    break
                frame = self._take(span, n).sort_values(self.order, kind="stable", ignore_index=True)
                early = int(np.searchsorted(frame["ms"].to_numpy(), now, "right"))
                if early < len(frame):
                    self._put(span, frame.iloc[early:])
                    wake.append(int(frame["ms"].iloc[early]))
                else:
                    left -= 1
                if early:
                    yield self.advance(key, frame.iloc[:early])
            if not left:
                self.width.clear()
        due = self.passed(key, now)
        if due is not None:
            yield due
        self.save()
        later = self.later()
        if later is not None:
            wake.append(max(later, now + 1))
        if wake:
            self._wake(min(wake))

    def close(self) -> None: ...


class BookProcessor(InOrder):
    """Price levels of one product; a size of 0 deletes, a snapshot after a reconnect replaces all levels.

    Emits the touch after each message with both sides. State holds the live levels; the best ones are
    at the top of heaps, from which dead prices are dropped when they come up.
    """

    order = ["ms", "seq", "event_no", "update_no"]
    sign = {"bid": -1.0, "offer": 1.0}

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.levels = handle.getMapState("levels", "side string, price double", "size double")

    def load(self, key: Any) -> None:
        self.book: dict[str, dict[float, float]] = {"bid": {}, "offer": {}}
        for (side, price), (size,) in self.levels.iterator():
            self.book[side][price] = size
        self.before = {(side, price): size for side, own in self.book.items() for price, size in own.items()}
        self.heaps = {side: [p * self.sign[side] for p in own] for side, own in self.book.items()}
        for heap in self.heaps.values():
            heapq.heapify(heap)

    def best(self, side: str) -> float:
        heap, sign = self.heaps[side], self.sign[side]
        while heap[0] * sign not in self.book[side]:
            heapq.heappop(heap)
        return heap[0] * sign

    def advance(self, key: Any, frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        frame = frame.dropna(subset=["ms", "seq", "event_no"])
        ident = frame[["ms", "seq", "event_no"]].to_numpy()
        starts = np.flatnonzero(np.r_[True, (ident[1:] != ident[:-1]).any(axis=1)]) if len(frame) else np.zeros(0, int)
        fresh = np.logical_or.reduceat((frame["event_type"] == "snapshot").to_numpy(bool), starts) if len(frame) else []
        sides = np.where(frame["side"].astype(str).str.lower().str.startswith("b"), "bid", "offer").tolist()
        prices, sizes, times, numbers = (frame[c].tolist() for c in ("price", "size", "ms", "seq"))
        for first, end, snapshot in zip(starts.tolist(), [*starts[1:].tolist(), len(frame)], fresh, strict=True):
            ms, seq = times[first], numbers[first]
            if snapshot:
                for side in self.book:
                    self.book[side].clear()
                    self.heaps[side].clear()
            for side, price, size in zip(sides[first:end], prices[first:end], sizes[first:end], strict=True):
                if not size:
                    self.book[side].pop(price, None)
                    continue
                if price not in self.book[side]:
                    heapq.heappush(self.heaps[side], price * self.sign[side])
                self.book[side][price] = size
            if self.book["bid"] and self.book["offer"]:
                bid, ask = self.best("bid"), self.best("offer")
                out.append((key[0], int(ms), int(seq), bid, self.book["bid"][bid], ask, self.book["offer"][ask]))
        return pd.DataFrame(out, columns=["product_id", "ms", "seq", "bid_px", "bid_sz", "ask_px", "ask_sz"])

    def save(self) -> None:
        after = {(side, price): size for side, own in self.book.items() for price, size in own.items()}
        for level in self.before.keys() - after.keys():
            self.levels.removeKey(level)
        for level, size in after.items():
            if self.before.get(level) != size:
                self.levels.updateValue((level[0], float(level[1])), (float(size),))


class OfiProcessor(InOrder):
    """Order-flow imbalance and microprice with the last quote as state."""

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "bid_px double, bid_sz double, ask_px double, ask_sz double")

    def load(self, key: Any) -> None:
        self.last = list(self.state.get()) if self.state.exists() else None

    def advance(self, key: Any, frame: pd.DataFrame) -> pd.DataFrame:
        now = frame[["bid_px", "bid_sz", "ask_px", "ask_sz"]].astype(float).reset_index(drop=True)
        old = now.shift(1)
        if self.last is not None:
            old.iloc[0] = self.last
        first = old["bid_px"].isna()
        bid = now.bid_sz.where(now.bid_px > old.bid_px, (now.bid_sz - old.bid_sz).where(now.bid_px == old.bid_px, -old.bid_sz))
        ask = now.ask_sz.where(now.ask_px < old.ask_px, (now.ask_sz - old.ask_sz).where(now.ask_px == old.ask_px, -old.ask_sz))
        total = now.bid_sz + now.ask_sz
        micro = ((now.ask_px * now.bid_sz + now.bid_px * now.ask_sz) / total).where(total > 0, (now.bid_px + now.ask_px) / 2)
        self.last = [float(x) for x in now.iloc[-1]]
        return pd.DataFrame({"product": key[0], "ms": frame["ms"].to_numpy(), "seq": frame["seq"].to_numpy(), "ofi": (bid - ask).where(~first, 0.0), "micro": micro, "first_tick": first})

    def save(self) -> None:
        if self.last is not None:
            self.state.update(tuple(self.last))


class OrderGate(InOrder):
    """Approves an order if the approved notional of the last minute and the approved orders of the
    last second stay under their caps; rejected orders do not count. State holds one minute."""

    notional_cap, rate_cap = 1e6, 20

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("recent", "ms long, notional double")

    def load(self, key: Any) -> None:
        self.recent = deque(self.state.get() if self.state.exists() else [])
        self.second = deque(t for t, _ in self.recent)
        self.total = sum(n for _, n in self.recent)

    def advance(self, key: Any, frame: pd.DataFrame) -> pd.DataFrame:
        recent, second, out = self.recent, self.second, []
        for ms, seq, notional in zip(*(frame[c].tolist() for c in ("ms", "seq", "notional")), strict=True):
            gone = False
            while recent and ms - recent[0][0] > 60_000:
                recent.popleft()
                gone = True
            if gone:  # added up again from the oldest on, as a difference would be another double
                self.total = sum(n for _, n in recent)
            while second and ms - second[0] > 1_000:
                second.popleft()
            total, orders = self.total + notional, len(second)  # a minute of approved orders, within the cap
            approved = total <= self.notional_cap and orders < self.rate_cap
            if approved:
                recent.append((int(ms), float(notional)))
                self.total += float(notional)
                second.append(int(ms))
            out.append((key[0], int(ms), int(seq), float(notional), bool(approved), float(total), int(orders)))
        return pd.DataFrame(out, columns=["account", "ms", "seq", "notional", "approved", "notional_1m", "orders_1s"])

    def save(self) -> None:
        recent = list(self.recent)
        self.state.put(recent) if recent else self.state.clear()


class TokenContext(InOrder):
    """The last ``length`` tokens of an underlying whenever the watermark has passed new rows."""

    length = 256

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("context", "token int")

    def load(self, key: Any) -> None:
        self.context = deque((t for (t,) in self.state.get()) if self.state.exists() else (), self.length)
        self.newest = None

    def advance(self, key: Any, frame: pd.DataFrame) -> pd.DataFrame:
        rows, n = [], 0
        for row in reversed(frame["tokens"].tolist()):  # as many of the last rows as fill it
            rows.append(row)
            n += len(row)
            if n >= self.length:
                break
        for row in reversed(rows):
            self.context.extend(int(t) for t in row)
        self.newest = int(frame["ms"].iloc[-1])
        return pd.DataFrame({"product": pd.Series(dtype=str), "ms": pd.Series(dtype="int64"), "context": pd.Series(dtype=object)})

    def passed(self, key: Any, watermark: int) -> pd.DataFrame | None:
        return None if self.newest is None else pd.DataFrame({"product": [key[0]], "ms": [self.newest], "context": [list(self.context)]})

    def save(self) -> None:
        if self.newest is not None:
            self.state.put([(t,) for t in self.context])


class EveryNth(InOrder):
    """Every ``n``-th update once ``least`` have come, with the mean of the last ``length`` values; state is a buffer of that length and a count."""

    n, least, length = 5, 20, 2048

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("seen", "n long")
        self.values = handle.getListState("buffer", "value double")

    def load(self, key: Any) -> None:
        self.seen = self.count.get()[0] if self.count.exists() else 0
        self.buffer = np.array([v for (v,) in self.values.get()] if self.values.exists() else [], float)

    def advance(self, key: Any, frame: pd.DataFrame) -> pd.DataFrame:
        held = np.concatenate([self.buffer, frame["value"].to_numpy(float)])
        nth = np.arange(self.seen + 1, self.seen + len(frame) + 1)
        at = np.flatnonzero((nth >= self.least) & (nth % self.n == 0))
        ends = len(self.buffer) + at + 1
        means = [float(held[max(0, end - self.length) : end].mean()) for end in ends.tolist()]
        self.seen += len(frame)
        self.buffer = held[-self.length :]
        return pd.DataFrame({"product": key[0], "ms": frame["ms"].to_numpy()[at], "seq": frame["seq"].to_numpy()[at], "nth": nth[at], "mean": np.array(means, float)})

    def save(self) -> None:
        if self.seen:
            self.count.update((self.seen,))
            self.values.put([(v,) for v in self.buffer.tolist()])


class PaperBroker(InOrder):
    """Open orders of a product, filled tick by tick and closed by age.

    Rows are orders (side not null: order_id, side, qty, limit_px) and ticks (bid_px, ask_px, bid_sz,
    ask_sz). A tick offers max(1, ``share`` of the far side's size), all that is open if that is 0, to
    every order that it crosses, up to ``max_age_ms`` after the order. Orders at a tick's time come
    before it. The timer is set to the last moment of the oldest order, so orders expire though no tick
    follows. State holds the open orders.
    """

    order = ["ms", "rank", "seq"]

    def __init__(self, max_age_ms: int, share: float = 0.10):
        self.max_age_ms, self.share = max_age_ms, share

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("open", "order_id long, buy boolean, qty double, limit_px double, ms long, given double")

    def load(self, key: Any) -> None:
        self.orders = {row[0]: list(row) for row in self.state.get()} if self.state.exists() else {}
        # best limits first; an order that is closed is dropped when it comes up
        self.heaps: dict[bool, list] = {True: [], False: []}
        self.ages: list = []
        for row in self.orders.values():
            self._stand(row)

    def _stand(self, row: list) -> None:
        heapq.heappush(self.heaps[row[1]], (-row[3] if row[1] else row[3], row[0]))
        heapq.heappush(self.ages, (row[4], row[0]))

    def _expired(self, now: int, out: list, product: str) -> None:
        """Close what is older than ``max_age_ms`` at ``now``."""
        while self.ages and self.ages[0][0] + self.max_age_ms < now:
            row = self.orders.pop(heapq.heappop(self.ages)[1], None)
            if row:
                out.append((product, row[0], "expired", row[4] + self.max_age_ms, None, None, None, row[2] - row[5]))

    def advance(self, key: Any, frame: pd.DataFrame) -> pd.DataFrame:
        out: list = []
        names = ["ms", "seq", "order_id", "side", "qty", "limit_px", "bid_px", "ask_px", "bid_sz", "ask_sz"]
        for ms, seq, order_id, side, qty, limit, bid, ask, bid_sz, ask_sz in zip(*(frame[c].tolist() for c in names), strict=True):
            self._expired(ms, out, key[0])
            if isinstance(side, str):
                buy = side == "buy"
                none = float("inf") if buy else -float("inf")
                row = [int(order_id), buy, float(qty), none if pd.isna(limit) else float(limit), int(ms), 0.0]
                self.orders[row[0]] = row
                self._stand(row)
                continue
            for buy, px, size in ((True, ask, ask_sz), (False, bid, bid_sz)):
                heap, level, again = self.heaps[buy], -px if buy else px, []
                while heap and heap[0][0] <= level:
                    entry = heapq.heappop(heap)
                    row = self.orders.get(entry[1])
                    if row is None:
                        continue
                    cap = max(1.0, size * self.share) if size > 0 else row[2]
                    filled = min(cap, row[2] - row[5])
                    row[5] += cap
                    rest = max(0.0, row[2] - row[5])
                    out.append((key[0], row[0], "fill", int(ms), int(seq), filled, float(px), rest))
                    if rest > 0:
                        again.append(entry)
                    else:
                        del self.orders[row[0]]
                for entry in again:
                    heapq.heappush(heap, entry)
        return self._frame(out)

    def passed(self, key: Any, watermark: int) -> pd.DataFrame | None:
        out: list = []
        self._expired(watermark, out, key[0])
        return self._frame(out) if out else None

    def later(self) -> int | None:
        while self.ages and self.ages[0][1] not in self.orders:
            heapq.heappop(self.ages)
        return self.ages[0][0] + self.max_age_ms + 1 if self.ages else None

    @staticmethod
    def _frame(out: list) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["product", "order_id", "kind", "ms", "seq", "fill_qty", "fill_px", "open_qty"])
        return frame.astype({"order_id": "Int64", "ms": "Int64", "seq": "Int64", "fill_qty": "float64", "fill_px": "float64", "open_qty": "float64"})

    def save(self) -> None:
        rows = [tuple(row) for row in self.orders.values()]
        self.state.put(rows) if rows else self.state.clear()


class PairBlocks(StatefulProcessor):
    """Quotes and trades of one key and span of time, met in blocks.

    Rows are kept in parts of at most ``part_rows``, sorted by time, until the watermark has passed the
    span. New parts meet those of the other side, new and kept, once. A block has up to ``block_rows``
    rows of each side: quotes, for each the run of trades that it meets, and the trades. It is what a
    reader lays open at once, and a block stands for as many pairs as the square of its rows.
    """

    def __init__(self, horizon_us: int, size_us: int, part_rows: int = PART_ROWS, block_rows: int = BLOCK_ROWS):
        self.horizon_us, self.size_us, self.part_rows, self.block_rows = horizon_us, size_us, part_rows, block_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "quotes int, quotes_left int, trades int, trades_left int")
        self.parts = handle.getMapState("parts", "side int, nth int", "rows binary")

    def _kept(self, side: int, n: int) -> Iterator[np.ndarray]:
        return (self._part(side, nth) for nth in range(n))

    def _part(self, side: int, nth: int) -> np.ndarray:
        """Times and ids."""
        return np.frombuffer(bytes(self.parts.getValue((side, nth))[0]), np.int64).reshape(2, -1)

    def _blocks(self, quotes: np.ndarray, trades: np.ndarray) -> Iterator[tuple]:
        first = np.searchsorted(trades[0], quotes[0], "left")
        end = np.searchsorted(trades[0], quotes[0] + self.horizon_us, "right")
        for at in range(0, len(first), self.block_rows):
            own, a, b = quotes[1][at : at + self.block_rows], first[at : at + self.block_rows], end[at : at + self.block_rows]
            for low in range(int(a.min()), int(b.max()), self.block_rows):
                high = min(low + self.block_rows, int(b.max()))
                since, upto = a.clip(low, high), b.clip(low, high)
                met = np.flatnonzero(upto > since)
                if len(met):
                    yield own[met], (since[met] - low + 1).astype(np.int32), (upto - since)[met].astype(np.int32), trades[1][low:high]

    def _framed(self, quotes: list[np.ndarray], trades: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        blocks = [block for q in quotes for t in trades for block in self._blocks(q, t)]
        if blocks:
            yield pd.DataFrame(blocks, columns=["q_id", "first", "n", "t_id"])

    def _meet(self, frames: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat(frames, ignore_index=True).sort_values("us", kind="stable")
        sides = [np.stack([own["us"].to_numpy(np.int64), own["id"].to_numpy(np.int64)]) for own in (frame[frame["trade"] == 0], frame[frame["trade"] == 1])]
        new = [[own[:, at : at + self.part_rows] for at in range(0, own.shape[1], self.part_rows)] for own in sides]
        counts = list(self.counts.get()) if self.counts.exists() else [0, 0, 0, 0]
        if new[0]:
            for trades in chain(new[1], self._kept(1, counts[2])):
                yield from self._framed(new[0], [trades])
        if new[1]:
            for quotes in self._kept(0, counts[0]):
                yield from self._framed([quotes], new[1])
        for side in (0, 1):
            for own in new[side]:
                n, left = counts[2 * side : 2 * side + 2]
                if left >= own.shape[1]:  # the last part has room
                    n -= 1
                    own = np.concatenate([self._part(side, n), own], axis=1)
                    own = own[:, np.argsort(own[0], kind="stable")]
                self.parts.updateValue((side, n), (own.tobytes(),))
                counts[2 * side : 2 * side + 2] = n + 1, self.part_rows - own.shape[1]
        self.counts.update(tuple(counts))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if not self.counts.exists():
            self.handle.registerTimer(-(-(key[1] + self.size_us) // 1000))
        held, n = [], 0
        for frame in rows:
            held.append(frame[["us", "id", "trade"]])
            n += len(frame)
            if n >= HELD:
                yield from self._meet(held)
                held, n = [], 0
        if n:
            yield from self._meet(held)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.counts.clear()
        self.parts.clear()
        yield from ()

    def close(self) -> None: ...


def _keyed(df: DataFrame, key: str, processor: StatefulProcessor, schema: str, late: str) -> DataFrame:
    timed = df.where("ms is not null").withColumn("event_time", F.timestamp_millis("ms")).withWatermark("event_time", late)
    return timed.groupBy(key).transformWithStateInPandas(processor, schema, "append", "EventTime")


def stream_book(updates: DataFrame, late: str = LATE) -> DataFrame:
    """Top of book from a stream of updates (product_id, ms, seq, event_type, event_no, update_no, side, price, size)."""
    return _keyed(updates, "product_id", BookProcessor(), TOB, late)


def stream_order_flow(quotes: DataFrame, late: str = LATE) -> DataFrame:
    return _keyed(quotes, "product", OfiProcessor(), OFI, late)


def stream_gate(orders: DataFrame, late: str = LATE) -> DataFrame:
    return _keyed(orders, "account", OrderGate(), GATE, late)


def stream_context(tokens: DataFrame, late: str = LATE) -> DataFrame:
    return _keyed(tokens, "product", TokenContext(), "product string, ms long, context array<int>", late)


def stream_every_nth(values: DataFrame, late: str = LATE) -> DataFrame:
    """(product, ms, seq, value) to every n-th update."""
    return _keyed(values, "product", EveryNth(), "product string, ms long, seq long, nth long, mean double", late)


def stream_fills(orders: DataFrame, ticks: DataFrame, max_age_ms: int, share: float = 0.10, late: str = LATE) -> DataFrame:
    """Fills and expiries of a stream of orders (product, order_id, ms, side, qty, limit_px) on a stream of ticks
    (product, ms, seq, bid_px, ask_px, bid_sz, ask_sz); equals ``fills.replay_orders`` where kind is ``fill``."""
    placed = orders.select("product", "ms", F.col("order_id").alias("seq"), F.lit(0).alias("rank"), "order_id", "side", "qty", "limit_px")
    shown = ticks.select("product", "ms", "seq", F.lit(1).alias("rank"), "bid_px", "ask_px", "bid_sz", "ask_sz")
    return _keyed(placed.unionByName(shown, allowMissingColumns=True), "product", PaperBroker(max_age_ms, share), FILLS, late)


def stream_pair_blocks(quotes: DataFrame, trades: DataFrame, key: str, horizon_ms: int, quote_id: str, trade_id: str, late: str = "1 hour", part_rows: int = PART_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Trades within ``horizon_ms`` after each quote of the same key, both streams with a watermark on ``ts``, as blocks for ``pairs_of``.

    Sides meet by key and span of time, ``HORIZONS`` times the horizon: a trade stands in its own span, a
    quote in its own and in that where its horizon ends. What comes behind the watermark is dropped, and
    state is kept until it has passed the span.
    """
    horizon, us = horizon_ms * 1000, F.unix_micros("ts")
    size = horizon * HORIZONS
    span = lambda at: at - F.pmod(at, F.lit(size))

    def side(df: DataFrame, ident: str, trade: int, spans) -> DataFrame:
        rows = df.withWatermark("ts", late).where(F.col(key).isNotNull() & F.col("ts").isNotNull())
        return rows.select(key, "ts", F.explode(spans).alias("span"), us.alias("us"), F.coalesce(F.col(ident), F.lit(NO_ID)).alias("id"), F.lit(trade).alias("trade"))

    both = side(quotes, quote_id, 0, F.array_distinct(F.array(span(us), span(us + horizon)))).union(side(trades, trade_id, 1, F.array(span(us))))
    return both.groupBy(key, "span").transformWithStateInPandas(PairBlocks(horizon, size, part_rows, block_rows), BLOCKS, "append", "EventTime")


def pairs_of(blocks: DataFrame, quote_id: str, trade_id: str) -> DataFrame:
    """The pairs that blocks stand for, one row each; they are laid open where they are read and nowhere kept."""
    one = blocks.select("first", "n", "t_id", F.posexplode("q_id").alias("at", "q"))
    run = F.slice("t_id", F.get("first", F.col("at")), F.get("n", F.col("at")))
    return one.select("q", F.explode(run).alias("t")).select(F.nullif("q", F.lit(NO_ID)).alias(quote_id), F.nullif("t", F.lit(NO_ID)).alias(trade_id))
