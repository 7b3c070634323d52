"""Queries against their SQL on rows that only larger tables hold: long keys, equal times, ties of a rounding, equal values."""

import datetime
import random

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidemark.functions import text
from tidemark.operators import bins, risk
from tidemark.streaming import queries, stateful

from .test_queries import table

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


#: (event_id, value, k) of ten times sf0.1 whose reservation price ends half way between two sixth places.
ROUNDED = [(355668, 8.43, 50), (378884, 7.88, 38), (771554, 0.4, 48)]


def both(spark, path, name):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for file in path.glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file if file.is_file() else f"{file}/*.parquet"}'")
    return table(entry.queries()[name](spark, str(path)).toPandas()), table(con.sql(entry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", ["f10_option_symbols", "p1_vendor_symbols"])
def test_strikes_of_more_than_eight_digits(spark, tmp_path, name):
    """Part keys from 200,000 on."""
    spark.createDataFrame([(k,) for k in (1, 199_999, 200_000, 200_002, 7_200_001)], "p_partkey long").write.parquet(f"file://{tmp_path}/part.parquet")
    got, want = both(spark, tmp_path, name)
    assert got == want and len(got[1]) >= 4


def test_symbols_keep_the_digits_of_their_strike(spark, tmp_path):
    """strikes of more than eight digits are whole; a symbol of 21 characters is read as before, whatever follows it."""
    keys = [1, 199_999, 200_000, 200_002, 7_200_001]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"file://{tmp_path}/part.parquet")
    got = entry.queries()["f10_option_symbols"](spark, str(tmp_path)).collect()
    assert {r["contract"]: r["strike"] for r in got} == {k: k / 2 for k in keys}
    symbols = ["SPX   240119C04500000", "SPX   240119C04500000 x", "SPX   240119C0450x0001", "SPX   240119C45", "SPX   240119C", "SPX", "", None]
    df = spark.createDataFrame([(n, x) for n, x in enumerate(symbols)], "n int, s string")
    assert [r["strike"] for r in df.select("n", text.option_symbol(df["s"])["strike"].alias("strike")).orderBy("n").collect()] == [4500.0, 4500.0, None, 0.045, None, None, None, None]


def events(spark, path, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"file://{path}/events.parquet")


def test_quotes_that_end_in_a_five(spark, tmp_path):
    """a reservation price half way between two sixth places."""
    day = datetime.datetime(2024, 1, 5)
    events(spark, tmp_path, [(k, day, 3, "view", value, f'{{"k": {n}}}') for k, value, n in ROUNDED])
    got, want = both(spark, tmp_path, "f4_quotes")
    assert got == want and len(got[1]) == len(ROUNDED)


def test_every_quote_half_way_between_two_places(spark, tmp_path):
    """sizes of 128 in all, the only ones whose prices can end in a five at the seventh place, with every remainder of the number."""
    day = datetime.datetime(2024, 1, 5)
    events(spark, tmp_path, [(n, day, 3, "view", float(n // 2100), f'{{"k": {126 - n * 7 % 100}}}') for n in range(21_000) if 126 - n * 7 % 100 <= 99])
    got, want = both(spark, tmp_path, "f4_quotes")
    assert got == want and len(got[1]) == 15_330


@pytest.mark.parametrize("name", ["j6_markout_time", "a11_post_trade"])
def test_fills_at_the_same_time(spark, tmp_path, name):
    """of several fills at one time the first by number gives the later mid."""
    rng = random.Random(4)
    start = datetime.datetime(2024, 1, 5)
    rows = [(k, start + datetime.timedelta(minutes=30 * (k * 7 % 40)), k % 20, rng.choice(["purchase", "click"]), float(rng.randint(1, 400)), '{"k": 5}') for k in range(800)]
    rng.shuffle(rows)
    events(spark, tmp_path, rows)
    got, want = both(spark, tmp_path, name)
    assert got == want


def test_a_quantile_between_equal_values_is_that_value(spark):
    """Else the value itself falls into the bucket below its edge, or above the one edge cut in two."""
    rng = random.Random(8)
    values = [rng.uniform(-1, 1) for _ in range(50)]
    df = spark.createDataFrame([(v, v) for v in values for _ in range(8)], "k double, value double")
    got = bins.exact_quantiles(df, ["k"], [i / 16 + 0.001 for i in range(16)]).collect()
    assert len(got) == 50 and all(set(r["q"]) == {r["k"]} for r in got)


def test_trailing_sums_do_not_look_at_their_rows(spark):
    """sums over ranges of time as SQL has them, without a sliding frame in the plan."""
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randint(-300, 300), k, float(rng.randint(0, 50)) if k % 9 else None) for k in range(600)] + [("c", 99, 601, None)]
    df = spark.createDataFrame(rows, "k string, ms long, seq long, notional double")
    out = risk.order_rates(df, "k", 500.0, 5, 70, 10)
    got = {r["seq"]: (r["notional_1m"], r["orders_1s"]) for r in out.collect()}
    frame = [(s, [(m, x) for g, m, _, x in rows if g == k and at - 70 <= m <= at], at) for k, at, s, _ in rows]
    want = {s: (sum(x for _, x in own if x is not None) if any(x is not None for _, x in own) else None, sum(m >= at - 10 for m, _ in own)) for s, own, at in frame}
    assert got == want
    assert "RangeFrame, -70" not in out._jdf.queryExecution().toString()


def test_pairs_meet_in_spans_of_time(spark, tmp_path):
    """trades up to an hour after a quote, both ends included; the join has a span of time among its keys."""
    start = datetime.datetime(2024, 1, 5)
    rng = random.Random(6)
    seconds = [rng.choice([0, 1, 1800, 3599, 3600, 3601]) + 3600 * rng.randint(0, 4) for _ in range(160)]
    events(spark, tmp_path / "rows", [(k, start + datetime.timedelta(seconds=s), k % 3, rng.choice(["view", "purchase", "click"]), 5.0, '{"k": 5}') for k, s in enumerate(seconds)])
    next((tmp_path / "rows" / "events.parquet").glob("*.parquet")).rename(tmp_path / "events.parquet")  # the stream reads files of that name
    got, want = both(spark, tmp_path, "st10_quote_trade_pairs")
    assert got == want and len(got[1]) > 100
    side = spark.readStream.schema("ts timestamp, product long").parquet(f"file://{tmp_path}/events.parquet")
    plan = queries.quote_trade_pairs(side, side, "product", "1 hour")._jdf.queryExecution().logical().toString()
    assert plan.count("_span") >= 4


@pytest.mark.parametrize("late", ["0 seconds", "1 second"])
def test_a_key_has_one_timer(spark, tmp_path, late):
    """State is read and written once a micro-batch, not once for each span or order."""

    class Counted(stateful.EveryNth):
        def save(self):
            super().save()
            self.saves = getattr(self, "saves", 0) + 1

        def passed(self, key, watermark):
            return pd.DataFrame({"product": key[0], "ms": [getattr(self, "saves", 0)], "seq": [0], "nth": [-1], "mean": [0.0]})

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.STATE_STORE)
    df = spark.createDataFrame([("p", 1 + k * 7 % 30_000, k, 1.0) for k in range(30_000)], "product string, ms long, seq long, value double")
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    out = stateful._keyed(stream, "product", Counted(), "product string, ms long, seq long, nth long, mean double", late)
    rows = queries.finished(out, f"file://{tmp_path}/out", f"file://{tmp_path}/state").collect()
    assert sum(r["nth"] == -1 for r in rows) == 1
    passed = 30_000 - (1000 if late == "1 second" else 0)
    assert max(r["nth"] for r in rows) == passed - passed % 5
