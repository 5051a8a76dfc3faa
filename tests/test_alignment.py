"""As-of and band joins on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from tickloom.operators.alignment import asof_join, asof_scan, band_join, latest_n_per_key, latest_per_key, marked_to_market, nearest, with_live_price


def frame(spark, rows, value="v"):
    return spark.createDataFrame(rows, f"k string, s long, {value} double").withColumn("t", F.timestamp_seconds("s")).drop("s")


@pytest.fixture()
def left(spark):
    return frame(spark, [("a", s, float(s)) for s in (0, 99, 100, 150, 1000, 5000)] + [("b", 10, 1.0)])


def matched(df):
    return {(r.k, r.v): r.x for r in df.collect()}


@pytest.mark.parametrize("bucket", [50, 1000, 100_000])
def test_asof_any_bucket_width(spark, left, bucket):
    ref = frame(spark, [("a", 100, 1.0), ("a", 160, 2.0), ("a", 4000, 3.0)], "x").withColumnRenamed("t", "rt")
    got = matched(asof_join(left, ref, ["k"], "t", "rt", ["x"], bucket))
    assert got == {("a", 0.0): None, ("a", 99.0): None, ("a", 100.0): 1.0, ("a", 150.0): 1.0, ("a", 1000.0): 2.0, ("a", 5000.0): 3.0, ("b", 1.0): None}


def test_asof_seed_strict_and_age(spark, left):
    ref = frame(spark, [("a", 100, 1.0), ("a", 160, 2.0)], "x").withColumnRenamed("t", "rt")
    seeded = matched(asof_join(left, ref, ["k"], "t", "rt", ["x"], 500, seed_first=True))
    assert seeded[("a", 0.0)] == 1.0 and seeded[("b", 1.0)] is None
    strict = matched(asof_join(left, ref, ["k"], "t", "rt", ["x"], 500, strict=True))
    assert strict[("a", 100.0)] is None and strict[("a", 150.0)] == 1.0
    aged = matched(asof_join(left, ref, ["k"], "t", "rt", ["x"], 500, max_age_seconds=840))
    assert aged[("a", 1000.0)] == 2.0 and aged[("a", 5000.0)] is None


@pytest.mark.parametrize("options", [{}, {"strict": True}, {"max_age_seconds": 840}])
@pytest.mark.parametrize("on", [["k"], []])
def test_scan_and_join_agree(spark, left, on, options):
    ref = frame(spark, [("a", 100, 1.0), ("a", 160, 2.0), ("a", 4000, 3.0)], "x").withColumnRenamed("t", "rt")
    ref = ref if on else ref.drop("k")
    joined = asof_join(left, ref, on, "t", "rt", ["x"], 500, **options)
    for width in (30, 100_000):
        assert matched(asof_scan(left, ref, on, "t", "rt", ["x"], width, **options)) == matched(joined)


def test_asof_without_keys_and_with_empty_reference(spark, left):
    ref = frame(spark, [("z", 50, 7.0)], "x").withColumnRenamed("t", "rt").drop("k")
    got = matched(asof_join(left, ref, [], "t", "rt", ["x"], 60))
    assert got[("a", 5000.0)] == 7.0 and got[("b", 1.0)] is None
    empty = matched(asof_join(left, ref.where("x < 0"), [], "t", "rt", ["x"], 60, seed_first=True))
    assert set(empty.values()) == {None} and len(empty) == 7


def test_band_join_is_strict_and_meets_each_pair_once(spark):
    trades = frame(spark, [("a", 1000, 1.0), ("a", 1119, 2.0)], "trade").withColumnRenamed("t", "opened")
    scans = frame(spark, [("a", s, float(s)) for s in (880, 881, 1000, 1119, 1120, 1238, 1239)] + [("b", 1000, 0.0)], "scan").withColumnRenamed("t", "scanned")
    pairs = band_join(trades, scans, ["k"], "opened", "scanned", 120)
    got = sorted((r.trade, r.scan) for r in pairs.collect())
    assert got == [(1.0, 881.0), (1.0, 1000.0), (1.0, 1119.0), (2.0, 1000.0), (2.0, 1119.0), (2.0, 1120.0), (2.0, 1238.0)]
    best = {r.trade: r.scan for r in nearest(pairs, ["trade"], "opened", "scanned", "scan").collect()}
    assert best == {1.0: 1000.0, 2.0: 1119.0}


def test_latest_rows(spark):
    df = frame(spark, [("a", 1, 1.0), ("a", 3, 3.0), ("a", 2, 2.0), ("b", 9, 9.0)])
    assert {r.k: r.v for r in latest_per_key(df, ["k"], ["t"]).collect()} == {"a": 3.0, "b": 9.0}
    assert sorted((r.k, r.v, r["rank"]) for r in latest_n_per_key(df, ["k"], ["t"], 2).collect()) == [("a", 2.0, 2), ("a", 3.0, 1), ("b", 9.0, 1)]


def test_live_price_and_marking(spark):
    products = spark.createDataFrame([("a", 5.0), ("b", 6.0), ("c", 7.0)], "product_id string, price double")
    live = spark.createDataFrame([("a", 8.0), ("b", 0.0)], "product_id string, price double")
    assert {r.product_id: r.price for r in with_live_price(products, live).collect()} == {"a": 8.0, "b": 6.0, "c": 7.0}
    held = spark.createDataFrame([("a", 2.0, 4.0), ("b", 1.0, 1.0), ("c", 1.0, 0.0)], "product_id string, size double, avg_price double")
    got = {r.product_id: (r.unrealized_pnl, r.unrealized_pct, r.entry_corrupt) for r in marked_to_market(held, live).collect()}
    assert got == {"a": (8.0, 100.0, False), "b": (None, None, False), "c": (None, None, True)}
