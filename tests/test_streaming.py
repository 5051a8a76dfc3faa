"""Streams over several micro-batches give the batch answer."""

import pickle
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import ledger, signals
from tickloom.sources.bars import time_bars
from tickloom.streaming import stateful, windows

SCHEMA = "product_id string, ts timestamp, seq long, price double, volume double"


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """Ticks in six files, each later than the one before."""
    rng, folder = random.Random(9), tmp_path_factory.mktemp("ticks")
    t, rows = 1_700_000_000, []
    for i in range(900):
        t += rng.randint(1, 300)
        rows.append((rng.choice("pqr"), t, i, round(rng.uniform(90, 110), 2), float(rng.randint(0, 99))))
    for k in range(6):
        df = spark.createDataFrame(rows[150 * k: 150 * k + 150], "product_id string, s long, seq long, price double, volume double")
        df.select("product_id", F.timestamp_seconds("s").alias("ts"), "seq", "price", "volume").coalesce(1).write.parquet(str(folder / f"part{k}"))
    return str(folder)


@pytest.fixture(scope="module")
def batch(spark, source):
    return spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(source).cache()


def stream(spark, source):
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(source)


@pytest.fixture(scope="module")
def shuffled(spark, batch, tmp_path_factory):
    """The same ticks up to 50 minutes late, in ten files that overlap in time and are shuffled inside."""
    rng, folder = random.Random(10), tmp_path_factory.mktemp("late")
    ticks = sorted(batch.collect(), key=lambda r: r.ts.timestamp() + rng.uniform(0, 3000))
    for k in range(10):
        part = ticks[90 * k: 90 * k + 90]
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(folder / f"part{k}"))
    return str(folder)


def late(spark, folder):
    return stream(spark, folder).withWatermark("ts", "1 hour")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def side():
    return F.when(F.col("price") > 97, "BUY").otherwise("SELL")


def released(batch, delay=3600):
    """Ticks that the last watermark has passed."""
    last = batch.agg(F.max("ts")).first()[0]
    return batch.where(F.unix_millis("ts") <= F.unix_millis(F.lit(last)) - 1000 * delay)


def test_suppression(spark, shuffled, batch):
    got = windows.drain(stateful.run(late(spark, shuffled).withColumn("side", side()), ["product_id"], stateful.Suppress(900)))
    want = signals.suppress_repeats(released(batch).withColumn("side", side()), "ts", "seq", 900)
    assert rows(got.select("seq", "side")) == rows(want.select("seq", "side"))


def test_drawdown(spark, shuffled, batch):
    def balances(df):
        return df.select(F.col("product_id").alias("agent"), "ts", "seq", F.col("price").alias("balance"))

    got = windows.drain(stateful.run(balances(late(spark, shuffled)), ["agent"], stateful.Drawdown()))
    want = ledger.drawdown(balances(released(batch)))
    columns = ["seq", "halted", F.round("day_drawdown", 9), F.round("week_drawdown", 9)]
    assert rows(got.select(*columns)) == rows(want.select(*columns))


def test_cached_values_live_for_their_time(spark, tmp_path):
    """Served until the time to live in event time, across batches, and for an older look-up of a later batch only what was there."""
    schema = "cache string, name string, ts timestamp, seq long, value double"
    batches = [[("a", "x", 100, None, 1.0), ("a", "x", 160, 1, None), ("a", "y", 160, 2, None)], [("a", "x", 700, 3, None), ("a", "x", 701, 4, None), ("b", "x", 150, 5, None)],
               [("a", "x", 720, 6, None), ("a", "x", 710, None, 7.0), ("a", "x", 1310, 7, None), ("a", "x", 1311, 8, None)], [("a", "x", 705, 9, None)]]
    for i, rows_ in enumerate(batches):
        df = spark.createDataFrame(rows_, schema.replace("ts timestamp", "s long")).withColumn("ts", F.timestamp_seconds("s"))
        df.select("cache", "name", "ts", "seq", "value").coalesce(1).write.parquet(str(tmp_path / f"in/part{i}"))
    source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = windows.drain(stateful.run(source, ["cache"], stateful.CachedValues(600, 50.0, 3600), "ProcessingTime"), idle_batches=False)
    assert {r.seq: r.value for r in got.collect()} == {1: 1.0, 2: 50.0, 3: 1.0, 4: 50.0, 5: 50.0, 6: 7.0, 7: 7.0, 8: 50.0, 9: 7.0}


def test_cached_values_of_a_batch_in_any_order(spark, tmp_path):
    """A batch reaches the processor in many frames of no order; its rows are served in time order all the same."""
    rng, rows_ = random.Random(4), []
    for i in range(3000):
        refresh = i % 5 == 0
        rows_.append(("a", "x", 1000 + 7 * i, None if refresh else i, float(i) if refresh else None))
    rng.shuffle(rows_)
    df = spark.createDataFrame(rows_, "cache string, name string, s long, seq long, value double").withColumn("ts", F.timestamp_seconds("s"))
    df.select("cache", "name", "ts", "seq", "value").repartition(4).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("cache string, name string, ts timestamp, seq long, value double").parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = windows.drain(stateful.run(source, ["cache"], stateful.CachedValues(20, 50.0, 3600), "ProcessingTime"), idle_batches=False)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r.seq: r.value for r in got.collect()} == {i: float(i - i % 5) if i % 5 <= 2 else 50.0 for i in range(3000) if i % 5}


class _Map(dict):
    """Map state in memory that counts its writes."""

    writes = 0
    iterator = dict.items

    def updateValue(self, key, value):
        self.writes += 1
        self[key] = value

    getValue = dict.__getitem__
    removeKey = dict.pop


def test_waiting_rows_are_stored_by_hour(spark):
    """200 000 rows of ten hours are a few writes, and come out sorted up to the limit, the rest later."""
    class Handle:
        made = []

        def getMapState(self, *_):
            self.made.append(_Map())
            return self.made[-1]

    n = 200_000
    at = np.random.default_rng(5).permutation(n) * 180
    frame = pd.DataFrame({"ts": pd.to_datetime(at, unit="ms"), "seq": np.arange(n), "side": "BUY"})
    waiting = stateful._Waiting(Handle(), stateful.Suppress.INPUT)
    assert waiting.add(iter([frame[i: i + 2000] for i in range(0, n, 2000)])) == 0
    assert sum(m.writes for m in Handle.made) <= 40
    early = pd.concat(list(waiting.take(5_000_000)))
    assert early["ts"].is_monotonic_increasing and len(early) == 5_000_000 // 180 + 1 and waiting.first() == len(early) * 180
    rest = pd.concat(list(waiting.take()))
    assert rest["ts"].is_monotonic_increasing and len(rest) + len(early) == n and waiting.first() is None


def test_state_forgets_after_its_time_to_live(spark, tmp_path):
    """A value survives a restart from the checkpoint, but not its time to live in the store."""
    schema = "cache string, name string, ts timestamp, seq long, value double"
    seen = []

    def run(i, row):
        df = spark.createDataFrame([row], schema.replace("ts timestamp", "s long")).withColumn("ts", F.timestamp_seconds("s"))
        df.select("cache", "name", "ts", "seq", "value").coalesce(1).write.parquet(str(tmp_path / f"in/part{i}"))
        source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        out = stateful.run(source, ["cache"], stateful.CachedValues(1e6, 50.0, state_ttl_seconds=25), "ProcessingTime")
        query = out.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda b, _: seen.extend(map(tuple, b.collect())))
        with windows.without_idle_batches(spark):
            started = query.start()
        assert started.awaitTermination(60)

    begin = time.time()
    run(0, ("a", "x", 100, None, 1.0))
    run(1, ("a", "x", 101, 1, None))
    served = time.time() - begin < 25
    time.sleep(max(0.0, 27 - (time.time() - begin)))
    run(2, ("a", "x", 102, 2, None))
    assert dict((seq, value) for seq, _, value in seen)[2] == 50.0
    assert not served or dict((seq, value) for seq, _, value in seen)[1] == 1.0


def test_bars_and_late_ticks(spark, source, batch):
    got = windows.drain(windows.streaming_bars(stream(spark, source)))
    last = batch.agg(F.max("ts")).first()[0]
    want = time_bars(batch, "ONE_HOUR").where(F.col("start") + F.expr("interval 70 minutes") <= F.lit(last))
    assert rows(got.select("product_id", "start", "open", "close")) == rows(want.select("product_id", "start", "open", "close"))


def test_latest_ticks_in_update_mode(spark, source, batch):
    got = windows.drain(windows.latest_ticks(stream(spark, source)), "update", windows.newest_batch(["product_id"]))
    want = batch.groupBy("product_id").agg(F.max("seq").alias("seq"))
    assert rows(got.select("product_id", "seq")) == rows(want)


def test_outcome_timers(spark, source, batch):
    def events(df):
        signal = F.col("seq") % 4 == 0
        return df.select("product_id", "ts", "seq", F.when(signal, side()).alias("side"), F.when(signal, F.col("price")).alias("entry_price"), F.when(~signal, F.col("price")).alias("close"))

    got = windows.drain(stateful.run(events(stream(spark, source)).withWatermark("ts", "1 minute"), ["product_id"], stateful.ResolveOutcomes(), "EventTime"))
    ticks = [tuple(r) for r in batch.orderBy("ts").select("product_id", F.unix_seconds("ts"), "seq", "price", side()).collect()]
    end, want = ticks[-1][1] - 60, []
    for p, s, seq, price, sd in ticks:
        if seq % 4 == 0 and s + 14_400 <= end:
            exit_ = [x for q, t, n, x, _ in ticks if q == p and n % 4 and t <= s + 14_400][-1]
            change = (exit_ - price) / price * (-1 if sd == "SELL" else 1)
            want.append((seq, exit_, "WIN" if change > 0.005 else "LOSS" if change < -0.005 else "NEUTRAL"))
    assert rows(got.select("seq", "exit_price", "outcome")) == sorted(want)


def test_outcomes_take_the_last_of_equal_times(spark, tmp_path):
    """Of the closes in one millisecond the last by time and number counts, not the highest, whatever the order of the files."""
    rows_ = [(0, 1, 100.0, None), (14_000_000_100, 2, None, 130.0), (14_400_000_300, 3, None, 90.0), (14_400_000_300, 4, None, 80.0),
             (14_400_000_900, 5, None, 70.0), (14_400_001_000, 6, None, 140.0), (15_600_000_000, 7, None, 150.0)]
    for k, part in enumerate((rows_[::-1][1:], rows_[-1:])):
        df = spark.createDataFrame([("p", *r) for r in part], "product_id string, us long, seq long, entry_price double, close double")
        df = df.select("product_id", F.timestamp_micros(F.col("us") + 10**15).alias("ts"), "seq", F.when(F.col("entry_price").isNotNull(), "BUY").alias("side"), "entry_price", "close")
        df.coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
    source = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = windows.drain(stateful.run(source.withWatermark("ts", "1 minute"), ["product_id"], stateful.ResolveOutcomes(), "EventTime"))
    assert rows(got.select("seq", "exit_price", "outcome")) == [(1, 70.0, "LOSS")]


def test_outcomes_keep_rows_by_hour(spark):
    """100 000 rows of 30 hours in one batch wait by the hour; the value of a key holds the signals of one horizon, no closes."""
    class Value:
        value, largest = None, 0

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value, self.largest = value, max(self.largest, len(pickle.dumps(value)))

    class Handle:
        def __init__(self):
            self.state, self.maps = Value(), []

        def getValueState(self, *_):
            return self.state

        def getMapState(self, *_):
            self.maps.append(_Map())
            return self.maps[-1]

        def registerTimer(self, at):
            pass

    class Now:
        def __init__(self, at):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: at

    n, step = 100_000, 1080
    price = np.round(np.random.default_rng(6).uniform(90, 110, n), 2)
    signal = np.arange(n) % 100 == 0
    frame = pd.DataFrame({
        "ts": pd.to_datetime(np.arange(1, n + 1) * step, unit="ms"), "seq": np.arange(n), "side": np.where(signal, "BUY", None),
        "entry_price": np.where(signal, price, np.nan), "close": np.where(signal, np.nan, price)})
    mixed = frame.sample(frac=1, random_state=1)
    handle, resolver = Handle(), stateful.ResolveOutcomes()
    resolver.init(handle)
    found = [*resolver.handleInputRows(("p",), iter([mixed[i: i + 2000] for i in range(0, n, 2000)]), Now(0))]
    ends = [5_000_000, 50_000_000, n * step - 600_000]
    for end in ends:
        found += resolver.handleExpiredTimer(("p",), Now(end), Now(end))
    got = pd.concat(found).set_index("seq")["exit_price"].to_dict()
    ahead = 14_400_000 // step  # the price of the tick at the horizon or just before it, which no signal is
    want = {i: price[k - 1 if k % 100 == 0 else k] for i in range(0, n, 100) if (i + 1) * step + 14_400_000 <= ends[-1] for k in [i + ahead]}
    assert got == want and handle.state.largest < 50_000


def test_book_over_micro_batches(spark, shuffled, batch):
    def fills(df):
        return df.select(
            (F.col("seq") % 2).cast("string").alias("agent"), "ts", "seq", "product_id", F.when(F.col("volume") < 50, "BUY").otherwise("SELL").alias("side"),
            "price", F.col("volume").cast("double").alias("usd"))

    got = windows.drain(stateful.run(fills(late(spark, shuffled)), ["agent", "product_id"], stateful.OpenPositions()))
    want = {r.seq: (r.action, r.size, r.avg_price, r.pnl) for r in ledger.average_cost_book(fills(released(batch))).collect()}
    found = {r.seq: r for r in got.collect()}
    assert found.keys() == want.keys() and len(want) > 20
    for seq, (action, size, avg, pnl) in want.items():
        r = found[seq]
        assert r.action == action and (r.size, r.avg_price) == pytest.approx((size, avg))
        assert pnl is None or r.pnl == pytest.approx(pnl)


def test_share_book_over_micro_batches(spark, shuffled, batch):
    """An agent's cash couples its products, also across batches."""
    from tickloom.operators import shares

    def fills(df):
        return df.select(
            (F.col("seq") % 2).cast("string").alias("agent"), "ts", "seq", "product_id", F.when(F.col("volume") < 50, "BUY").otherwise("SELL").alias("side"),
            "price", (F.col("volume") / 100).cast("double").alias("frac"))

    got = {r.seq: r for r in windows.drain(stateful.run(fills(late(spark, shuffled)), ["agent"], stateful.ShareBook())).collect()}
    want = {r.seq: r for r in shares.share_book(fills(released(batch)), rows=16).collect()}
    assert got.keys() == want.keys() and len(want) > 20
    for seq, r in want.items():
        assert got[seq].action == r.action
        assert (got[seq].log_size, got[seq].log_balance, got[seq].realized_share) == pytest.approx((r.log_size, r.log_balance, r.realized_share))
