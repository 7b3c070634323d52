"""Stream processors against plain loops over the same rows, over several micro-batches."""

import collections
import datetime
import json
import os
import random

import pandas as pd
import pytest

from tidemark.operators import fills
from tidemark.sources.readers import book_messages
from tidemark.streaming import queries as sq
from tidemark.streaming import stateful


def replayed(spark, tmp_path, df, files, order="ms"):
    """``df`` as a stream of ``files`` micro-batches in order of ``order``."""
    rows = sorted(df.collect(), key=lambda r: r[order])
    step = -(-len(rows) // files)
    for k in range(files):
        part = spark.createDataFrame(rows[k * step : (k + 1) * step], df.schema)
        part.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{k:03d}")
        for f in (tmp_path / "in" / f"{k:03d}").glob("*.parquet"):  # the source reads older files first
            os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")


def finished(spark, tmp_path, stream):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.STATE_STORE)
    return sq.finished(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/state").collect()


def test_books_follow_updates_deletes_and_snapshots(spark, tmp_path):
    rng = random.Random(5)
    messages = []
    for seq in range(120):
        product = rng.choice("AB")
        updates = [{"side": rng.choice(["bid", "offer"]), "price_level": str(rng.randint(1, 12)), "new_quantity": str(rng.choice([0, 1, 2, 5]))} for _ in range(rng.randint(1, 4))]
        kind = "snapshot" if seq % 37 == 36 else "update"
        messages.append((1000 + seq * 10, seq, json.dumps({"channel": "l2_data", "events": [{"type": kind, "product_id": product, "updates": updates}]})))
    raw = spark.createDataFrame(messages, "ms long, seq long, value string")
    updates = book_messages(replayed(spark, tmp_path, raw, 4)).select("product_id", "ms", "seq", "event_type", "event_no", "update_no", "side", "price", "size")
    got = {(r["product_id"], r["seq"]): (r["bid_px"], r["bid_sz"], r["ask_px"], r["ask_sz"]) for r in finished(spark, tmp_path, stateful.stream_book(updates))}
    want, books = {}, collections.defaultdict(lambda: {"bid": {}, "offer": {}})
    for _, seq, value in messages:
        event = json.loads(value)["events"][0]
        book = books[event["product_id"]]
        if event["type"] == "snapshot":
            book["bid"].clear()
            book["offer"].clear()
        for u in event["updates"]:
            price, size = float(u["price_level"]), float(u["new_quantity"])
            if size:
                book[u["side"]][price] = size
            else:
                book[u["side"]].pop(price, None)
        if book["bid"] and book["offer"]:
            b, a = max(book["bid"]), min(book["offer"])
            want[event["product_id"], seq] = (b, book["bid"][b], a, book["offer"][a])
    assert got == want and len(want) > 60


def test_the_order_gate_counts_what_it_approved(spark, tmp_path):
    rng = random.Random(6)
    orders = sorted((rng.choice("xy"), 1 + seq * 1000 + rng.randint(0, 999), seq, float(rng.choice([20_000, 90_000, 300_000]))) for seq in range(400))
    orders += [("x", 500_000 + k, 1000 + k, 1.0) for k in range(40)]  # a burst within one second
    df = spark.createDataFrame(orders, "account string, ms long, seq long, notional double")
    got = {r["seq"]: (r["approved"], r["notional_1m"], r["orders_1s"]) for r in finished(spark, tmp_path, stateful.stream_gate(replayed(spark, tmp_path, df, 5)))}
    want, past = {}, collections.defaultdict(list)
    for account, ms, seq, notional in sorted(orders, key=lambda o: (o[1], o[2])):
        own = past[account]
        total, last = sum(n for t, n in own if ms - t <= 60_000) + notional, sum(ms - t <= 1_000 for t, _ in own)
        ok = total <= stateful.OrderGate.notional_cap and last < stateful.OrderGate.rate_cap
        if ok:
            own.append((ms, notional))
        want[seq] = (ok, total, last)
    assert got == want and {w[0] for w in want.values()} == {True, False}


def test_buffers_and_contexts_go_over_micro_batches(spark, tmp_path):
    rows = [("p", 1 + k * 5, k, float(k % 17), [k, k + 1, k + 2]) for k in range(300)] + [("q", 3, 7, 1.0, [9])]
    df = spark.createDataFrame(rows, "product string, ms long, seq long, value double, tokens array<int>")
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    got = finished(spark, tmp_path / "a", stateful.stream_every_nth(replayed(spark, tmp_path / "a", df, 3).drop("tokens")))
    assert sorted((r["nth"], r["seq"]) for r in got) == [(n, n - 1) for n in range(20, 301, 5)]
    assert all(r["mean"] == pytest.approx(sum(k % 17 for k in range(r["nth"])) / r["nth"]) for r in got)
    contexts = finished(spark, tmp_path / "b", stateful.stream_context(replayed(spark, tmp_path / "b", df, 3).drop("value")))
    last = max((r for r in contexts if r["product"] == "p"), key=lambda r: r["ms"])
    assert last["context"] == [t for k in range(300) for t in (k, k + 1, k + 2)][-256:]


def test_rows_come_in_order_over_batches_and_late_rows_go(spark, tmp_path):
    """Spans of a batch that grows tenfold stay as small; rows within the delay wait for their place."""
    rows = [("p", 1 + k, k, 1.0) for k in range(1, 4000)]
    shuffled = sorted(rows, key=lambda r: (r[1] // 200, hash((r[2], 3)) % 1000))  # out of order by up to 200 ms
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(shuffled)], "product string, ms long, seq long, value double, at long")
    stream = replayed(spark, tmp_path, df, 6, "at").drop("at")
    got = finished(spark, tmp_path, stateful.stream_every_nth(stream, "300 milliseconds"))
    passed = 4000 - 300
    assert sorted((r["nth"], r["seq"]) for r in got) == [(n, n) for n in range(20, passed + 1, 5) if 1 + n <= passed]

    class Spans(stateful.EveryNth):
        def advance(self, key, frame):
            super().advance(key, frame)
            return pd.DataFrame({"product": ["p"], "ms": [0], "seq": [0], "nth": [len(frame)], "mean": [0.0]})

    most = []
    for n, many in enumerate((3_000, 30_000)):
        (tmp_path / f"s{n}").mkdir()
        df = spark.createDataFrame([("p", 1 + k, k, 1.0) for k in range(many)], "product string, ms long, seq long, value double")
        out = stateful._keyed(replayed(spark, tmp_path / f"s{n}", df, 1), "product", Spans(), "product string, ms long, seq long, nth long, mean double", "0 seconds")
        most.append(max(r["nth"] for r in finished(spark, tmp_path / f"s{n}", out)))
    assert max(most) <= 2 * stateful.SPAN_ROWS


def test_late_rows_are_dropped(spark, tmp_path):
    rows = [("p", 10_000 + k, k, 0) for k in range(100)] + [("p", 5_000, 500, 1)] + [("p", 20_000 + k, 600 + k, 1) for k in range(100)]
    df = spark.createDataFrame([(p, ms, seq, 1.0, batch) for p, ms, seq, batch in rows], "product string, ms long, seq long, value double, at long")
    stream = replayed(spark, tmp_path, df, 2, "at").drop("at")
    got = finished(spark, tmp_path, stateful.stream_every_nth(stream))
    assert 500 not in {r["seq"] for r in got} and max(r["nth"] for r in got) == 200


def test_orders_expire_without_a_tick(spark, tmp_path):
    """Fills equal the batch replay; an order of product q is closed by its timer although no tick follows it."""
    rng = random.Random(3)
    ticks = [("p", 1000 + 10 * k, k, float(rng.randint(90, 100)), float(rng.randint(101, 110)), float(rng.choice([0, 5, 30])), float(rng.choice([0, 5, 30]))) for k in range(400)]
    orders = [(rng.choice("ppp"), 1000 + rng.randint(0, 3500), 10_000 + k, rng.choice(["buy", "sell"]), float(rng.randint(1, 40)), rng.choice([None, 99.0, 102.0, 105.0])) for k in range(80)]
    orders.append(("q", 1500, 20_000, "buy", 5.0, 50.0))
    tick = spark.createDataFrame(ticks, "product string, ms long, seq long, bid_px double, ask_px double, bid_sz double, ask_sz double")
    order = spark.createDataFrame(orders, "product string, ms long, order_id long, side string, qty double, limit_px double")
    want = {(r["order_id"], r["seq"]): (r["fill_qty"], r["fill_px"]) for r in fills.replay_orders(order, tick, "product", 300).collect()}
    (tmp_path / "t").mkdir(), (tmp_path / "o").mkdir()
    stream = stateful.stream_fills(replayed(spark, tmp_path / "o", order, 3), replayed(spark, tmp_path / "t", tick, 3), 300, late="5 seconds")
    end = spark.createDataFrame([("z", 20_000, 1, 1.0, 2.0, 1.0, 1.0)], tick.schema)  # the watermark goes on without a tick of q
    end.write.mode("append").parquet(f"file://{tmp_path}/t/in/end")
    got = finished(spark, tmp_path, stream)
    filled = {(r["order_id"], r["seq"]): (r["fill_qty"], r["fill_px"]) for r in got if r["kind"] == "fill"}
    assert filled.keys() == want.keys() and all(filled[k] == pytest.approx(want[k]) for k in want) and len(want) > 100
    expired = {r["order_id"]: (r["ms"], r["open_qty"]) for r in got if r["kind"] == "expired"}
    assert expired[20_000] == (1800, 5.0)
    done = {k for k, _ in want if sum(q for (o, _), (q, _) in want.items() if o == k) >= next(o[4] for o in orders if o[2] == k) - 1e-9}
    assert expired.keys() == {o[2] for o in orders} - done


def test_refits_look_back_over_batches(spark, tmp_path):
    rows = [(k * 1000, float(k)) for k in range(100)]
    stream = replayed(spark, tmp_path, spark.createDataFrame(rows, "ms long, x double"), 4)
    seen = {}
    sq.refit_edges(stream, ["x"], 4, 40_000, lambda e, n: seen.update({n: e.first()["edges"]}), f"file://{tmp_path}/state", f"file://{tmp_path}/log").awaitTermination()
    assert sorted(seen) == [0, 1, 2, 3]
    for n, edges in seen.items():  # the batch ends at row 25 n + 24; 40 seconds reach back over the one before
        newest = 25 * n + 24
        inside = [k for k in range(max(0, newest - 40), newest + 1)]
        assert edges[2] == pytest.approx((inside[0] + inside[-1]) / 2)


def test_kinds(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "ms long, kind string")
    for kind, part in sq.by_kind(df, ["a", "b"]).items():
        assert {r["kind"] for r in part.collect()} == {kind}


SIDES = "kind string, product string, ts timestamp, id long"


def blocks_of(df, late, part_rows=stateful.PART_ROWS, block_rows=stateful.BLOCK_ROWS):
    sides = (df.where(f"kind = '{kind}'").select("product", "ts", "id") for kind in ("quote", "trade"))
    return stateful.stream_pair_blocks(*sides, "product", 3_600_000, "id", "id", late, part_rows, block_rows)


@pytest.mark.parametrize(("order", "late", "files"), [("id", "30 days", 5), ("ts", "0 seconds", 6), ("ts", "0 seconds", 1)])
def test_blocks_hold_every_pair_once(spark, tmp_path, order, late, files):
    """in any order while nothing is late, and in order of time while state is dropped behind the watermark."""
    rng = random.Random(files)
    start = datetime.datetime(2024, 1, 5)
    seconds = rng.sample(range(40 * 3600), 1200) if order == "ts" else [rng.choice([0, 1, 1800, 3599, 3600, 3601]) + 3600 * rng.randint(0, 30) for _ in range(1200)]
    rows = [(rng.choice(["quote", "trade", "trade"]), rng.choice("AB") if k % 50 else None, start + datetime.timedelta(seconds=s), k if k % 77 else None) for k, s in enumerate(seconds)]
    df = spark.createDataFrame(rows, SIDES) if order == "ts" else spark.createDataFrame(rows, SIDES).fillna(-1)
    found = finished(spark, tmp_path, blocks_of(replayed(spark, tmp_path, df, files, order), late, 16, 8))
    blocks = spark.createDataFrame(found, stateful.BLOCKS)
    got = collections.Counter((r["q"], r["t"]) for r in stateful.pairs_of(blocks, "q", "t").collect())
    rows = [tuple(r) for r in df.collect()]
    hour = datetime.timedelta(hours=1)
    want = collections.Counter((q[3], t[3]) for q in rows for t in rows if q[0] == "quote" and t[0] == "trade" and q[1] and q[1] == t[1] and q[2] <= t[2] <= q[2] + hour)
    assert got == want and len(want) > 3000
    assert max(max(len(r["q_id"]), len(r["t_id"])) for r in found) <= 8


def test_what_a_stream_writes_of_pairs_grows_with_its_rows(spark, tmp_path):
    """1,440,000 pairs in about a hundred rows."""
    start = datetime.datetime(2024, 1, 5)
    df = spark.createDataFrame([("quote" if k % 2 else "trade", "A", start + datetime.timedelta(seconds=k // 2 + 1800 * (k % 2 == 0)), k) for k in range(2400)], SIDES)
    found = finished(spark, tmp_path, blocks_of(replayed(spark, tmp_path, df, 1, "ts"), "1 hour"))
    assert len(found) <= 120 and sum(sum(r["n"]) for r in found) == 1_440_000


def test_late_rows_make_no_pairs(spark, tmp_path):
    start = datetime.datetime(2024, 1, 5)
    at = [("trade", 0), ("trade", 50_000), ("quote", 50_000), ("quote", 49_000), ("quote", 0)]  # the last quote comes 50,000 s after its time
    df = spark.createDataFrame([(kind, "A", start + datetime.timedelta(seconds=s), k) for k, (kind, s) in enumerate(at)], SIDES)
    found = finished(spark, tmp_path, blocks_of(replayed(spark, tmp_path, df, 5, "id"), "1 hour"))
    assert sorted((r["q"], r["t"]) for r in stateful.pairs_of(spark.createDataFrame(found, stateful.BLOCKS), "q", "t").collect()) == [(2, 1), (3, 1)]
