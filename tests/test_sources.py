"""Bar store, messages and log files."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import filters
from tickloom.sources import bars as store
from tickloom.sources import messages


def bars_of(spark, starts, product="p", close=1.0):
    df = spark.createDataFrame([(product, s, close, close, close, close, 1.0) for s in starts], "product_id string, s long, open double, high double, low double, close double, volume double")
    return df.select("product_id", F.timestamp_seconds("s").alias("start"), "open", "high", "low", "close", "volume")


def test_store_round_trip_and_top_up(spark, tmp_path):
    path = str(tmp_path / "bars")
    assert store.read_bars(spark, path).count() == 0
    first = bars_of(spark, [0, 3600, 7200])
    store.write_bars(first, path, "ONE_HOUR")
    store.write_bars(bars_of(spark, [0, 300], close=9.0), path, "FIVE_MINUTE")
    incoming = bars_of(spark, [7200, 10_800], close=2.0).unionByName(bars_of(spark, [86_400 * 3], "q"))
    report = {r.product_id: (r.new_bars, r.total_bars) for r in store.backfill_report(store.read_bars(spark, path), incoming).collect()}
    assert report == {"p": (1, 4), "q": (1, 1)}
    store.write_bars(store.new_bars(store.read_bars(spark, path), incoming), path, "ONE_HOUR")
    got = {(r.product_id, int(r.start.timestamp())): r.close for r in store.read_bars(spark, path).collect()}
    assert got == {("p", 0): 1.0, ("p", 3600): 1.0, ("p", 7200): 1.0, ("p", 10_800): 2.0, ("q", 86_400 * 3): 1.0}
    assert store.read_bars(spark, path, "FIVE_MINUTE", ["p"]).count() == 2
    assert store.read_bars(spark, path, "ONE_HOUR", ["z"]).count() == 0
    plan = store.read_bars(spark, path, "FIVE_MINUTE", ["p"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(granularity" in plan and "PushedFilters" in plan and "product_id" in plan


def test_writer_leaves_other_bars_and_keeps_the_last_arrival(spark, tmp_path):
    path = str(tmp_path / "bars")
    store.write_bars(bars_of(spark, [0, 3600]).unionByName(bars_of(spark, [0, 3600, 86_400], "q")), path, "ONE_HOUR")
    late = bars_of(spark, [3600], "q", 7.0).withColumn("n", F.lit(2)).unionByName(bars_of(spark, [3600, 7200], "q", 8.0).withColumn("n", F.lit(1)))
    for _ in range(2):  # a rerun changes nothing
        store.write_bars(late, path, "ONE_HOUR", "n")
        got = sorted((r.product_id, int(r.start.timestamp()), r.close) for r in store.read_bars(spark, path).collect())
        assert got == [("p", 0, 1.0), ("p", 3600, 1.0), ("q", 0, 1.0), ("q", 3600, 7.0), ("q", 7200, 8.0), ("q", 86_400, 1.0)]
    store.write_bars(late.where("n > 9"), path, "ONE_HOUR", "n")
    assert store.read_bars(spark, path).count() == 6


def test_dedupe_keeps_first_or_last(spark):
    df = bars_of(spark, [0, 0, 60]).withColumn("n", F.monotonically_increasing_id()).withColumn("close", F.col("n").cast("double"))
    ordered = sorted(r.n for r in df.where(F.unix_seconds("start") == 0).collect())
    for keep, want in (("first", ordered[0]), ("last", ordered[1])):
        assert store.dedupe_bars(df, "n", keep).where(F.unix_seconds("start") == 0).first().close == float(want)


def test_time_bars_pick_open_and_close_by_time_then_sequence(spark):
    rows = [("p", 10, 2, 5.0, 1.0), ("p", 10, 1, 4.0, 1.0), ("p", 50, 3, 9.0, 1.0), ("p", 50, 4, 6.0, 1.0), ("p", 60, 5, 1.0, 2.0)]
    t = spark.createDataFrame(rows, "product_id string, s long, seq long, price double, volume double").withColumn("ts", F.timestamp_seconds("s"))
    first, second = store.time_bars(t, "ONE_MINUTE").orderBy("start").collect()
    assert (first.open, first.high, first.low, first.close, first.volume) == (4.0, 9.0, 4.0, 6.0, 4.0)
    assert (second.open, second.close) == (1.0, 1.0)


def test_gaps_and_last_bars(spark):
    starts = [0, 3600, 4 * 3600, 86_400 * 45]
    df = bars_of(spark, starts)
    gaps = sorted((int(r.gap_start.timestamp()), r.missing_bars) for r in store.gap_report(df, "ONE_HOUR").collect())
    assert gaps == [(7200, 2), (5 * 3600, 45 * 24 - 5)]
    assert store.missing_bars(df, "ONE_HOUR").count() == 2 + 45 * 24 - 5
    assert sorted(int(r.start.timestamp()) for r in store.last_bars(df, 3).collect()) == starts[1:]


def test_log_files_with_continuation_lines(spark, tmp_path):
    rng = random.Random(1)
    want, lines, current = [], ["orphan line"], None
    for i in range(400):
        if rng.random() < 0.6:
            level = rng.choice(["DEBUG", "INFO", "WARNING", "ERROR"])
            lines.append(f"2026-04-11 19:00:{i % 60:02d} [{level}] a.b: m{i}")
            current = [level, f"m{i}"]
            want.append(current)
        else:
            lines.append(f"  trace {i}")
            if current:
                current[1] += f"\n  trace {i}"
    (tmp_path / "app.log").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        recs = messages.log_records(messages.read_log_lines(spark, str(tmp_path / "app.log")), "WARNING").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.level, r.message) for r in recs) == sorted((l, m) for l, m in map(tuple, want) if l in ("WARNING", "ERROR"))


def test_ticker_price_of_zero_is_a_price(spark):
    entries = ['{"product_id": "p", "price": "0.0"}', '{"product_id": "q", "close": "0"}', '{"product_id": "r", "price": ""}', '{"price": "1.0"}']
    df = spark.createDataFrame([('{"channel": "ticker", "events": [{"tickers": [' + ", ".join(entries) + "]}]}",)], "value string")
    assert sorted((r.product_id, r.price) for r in messages.ticker_updates(df).collect()) == [("p", 0.0), ("q", 0.0)]


def test_bad_json_and_book_edges(spark):
    df = spark.createDataFrame([('{"a": {"size": 1.5, "avg_price": 2.0}}',), ("{oops",), (None,)], "j string")
    assert [len(r.m) for r in df.select(messages.decode_positions("j").alias("m")).collect()] == [1, 0, 0]
    book = spark.createDataFrame([([(10.0, 3.0)], [(11.0, 1.0)]), ([], [(11.0, 1.0)])], "bids array<struct<price:double,size:double>>, asks array<struct<price:double,size:double>>")
    got = book.select(*[c.alias(n) for n, c in messages.book_imbalance().items()]).collect()
    assert [tuple(r) for r in got] == [(3.0, 1.0, 0.5), (0.0, 0.0, 0.0)]
    shown = messages.book_display(book).collect()
    assert shown[0].spread == 1.0 and shown[1].spread is None


@pytest.mark.parametrize("prefix, start, end", [
    ("2026", "2026-01-01", "2027-01-01"), ("2026-12", "2026-12-01", "2027-01-01"), ("2026-04-11", "2026-04-11", "2026-04-12"),
    ("2026-04-11T19", "2026-04-11T19:00", "2026-04-11T20:00"), ("2026-04-11T19:05", "2026-04-11T19:05", "2026-04-11T19:06"),
])
def test_iso_prefixes_become_ranges(prefix, start, end):
    import datetime as dt

    assert filters.iso_prefix_range(prefix) == (dt.datetime.fromisoformat(start), dt.datetime.fromisoformat(end))


def test_scan_table_sorts_nulls_as_minus_999(spark):
    df = spark.createDataFrame([("BTC-USD", None, 1), ("ETH-USD", -5.0, 2), ("XRP-USD", -1000.0, 3)], "product_id string, model_prob double, seq long")
    assert [r.seq for r in filters.scan_table(df).collect()] == [2, 1, 3]
    assert [r.seq for r in filters.scan_table(df, text="btc").collect()] == [1]
