"""The stored window dataset: top-ups against full builds."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import features
from tickloom.sources import bars as store
from tickloom.sources import window_store as ws

BASE = 1_700_006_400


def series(spark, product, n, step, seed, gap=0):
    rng, rows, c = random.Random(seed), [], 50.0
    for i in range(n):
        prev, c = c, max(1.0, c * (1 + rng.gauss(0, 0.01)))
        rows.append((product, BASE + step * (i + (i // 40) * gap), prev, max(prev, c) * 1.001, min(prev, c) * 0.999, c, float(rng.randint(0, 500))))
    df = spark.createDataFrame(rows, "product_id string, s long, open double, high double, low double, close double, volume double")
    return df.withColumn("start", F.timestamp_seconds("s")).drop("s").withColumn("day", F.to_date("start"))


@pytest.fixture(scope="module")
def tables(spark):
    hourly = series(spark, "a", 640, 3600, 1).unionByName(series(spark, "b", 200, 3600, 2, gap=3)).unionByName(series(spark, "c", 64, 3600, 3))
    fives = series(spark, "a", 3000, 300, 4).unionByName(series(spark, "b", 900, 300, 5, gap=7))
    funding = spark.createDataFrame([(p, (BASE + 28_800 * i) * 1000, 0.0001 * i) for p in "ab" for i in range(1, 70)], "product_id string, funding_time_ms long, rate double")
    return hourly.cache(), fives.cache(), funding.cache()


def until(tables, hours):
    """Everything known when ``hours`` hours have passed."""
    end = F.timestamp_seconds(F.lit(BASE + 3600 * hours))
    hourly, fives, funding = tables
    hourly, fives = hourly.where(F.col("start") < end), fives.where(F.col("start") < end)
    return hourly, hourly.where("product_id = 'a'"), funding.where(F.timestamp_millis("funding_time_ms") < end), fives


def rows_of(df):
    return {(r.product_id, r.idx): (r.start, r.label, round(r.weight, 9), [[round(x, 9) for x in c] for c in r.channels]) for r in df.collect()}


def full(inputs):
    """A build from nothing; product c is too short for the store at all times."""
    hourly, reference, funding, fives = (x.drop("day") for x in inputs)
    return rows_of(features.dataset(hourly.where("product_id <> 'c'"), reference, funding, fives, precision="double"))


def test_top_ups_equal_full_builds(spark, tables, tmp_path):
    path, seen = str(tmp_path / "w"), []
    for hours in (100, 101, 101, 150, 400, 800):
        now = until(tables, hours)
        status = ws.top_up_windows(spark, path, *now, precision="double")
        seen.append({r.product_id: r.status for r in status.collect()})
        assert rows_of(ws.read_windows(spark, path)) == full(now), hours
    assert seen[0] == {"a": "rebuild", "b": "rebuild", "c": "skip"}
    assert seen[1]["a"] == "append" and set(seen[2].values()) <= {"hit", "skip"} and seen[5]["a"] == "append"


def test_changed_history_is_rebuilt(spark, tables, tmp_path):
    path, now = str(tmp_path / "w"), until(tables, 300)
    ws.top_up_windows(spark, path, *now, precision="double")
    late = now[0].where("NOT (product_id = 'a' AND hour(start) = 5 AND day = '2023-11-16')")
    status = {r.product_id: r.status for r in ws.top_up_windows(spark, path, late, *now[1:], precision="double").collect()}
    assert status["a"] == "rebuild" and status["b"] == "hit"
    assert rows_of(ws.read_windows(spark, path)) == full((late, *now[1:]))
    # A product whose history shrinks to a few days leaves no windows behind.
    short = now[0].where("product_id <> 'a' OR start < timestamp_seconds(1700006400 + 3600 * 90)")
    ws.top_up_windows(spark, path, short, *now[1:], precision="double")
    assert rows_of(ws.read_windows(spark, path)) == full((short, *now[1:]))


def test_untouched_days_keep_their_files(spark, tables, tmp_path):
    path = tmp_path / "w"
    ws.top_up_windows(spark, str(path), *until(tables, 500), precision="double")
    before = {f: f.stat().st_mtime_ns for f in path.glob("windows/day=*/*.parquet")}
    ws.top_up_windows(spark, str(path), *until(tables, 520), precision="double")
    after = {f: f.stat().st_mtime_ns for f in path.glob("windows/day=*/*.parquet")}
    changed = {f.parent.name for f in before.keys() ^ after.keys()}
    assert len({f.parent.name for f in before}) > 15 and len(changed) <= 3


def test_tail_reads_prune_days(spark, tables, tmp_path):
    path = str(tmp_path / "bars")
    store.write_bars(tables[0].drop("day"), path, "ONE_HOUR")
    low = tables[0].agg(F.max("start")).first()[0]
    plan = ws.since(store.read_bars(spark, path, with_day=True), low)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in text and "day#" in text.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert len(plan.inputFiles()) > 0 and plan.count() == 1
