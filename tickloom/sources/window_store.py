"""A stored dataset of feature windows, partitioned by day, that is topped up from the newest bars."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import features
from tickloom.operators.alignment import asof_join
from tickloom.operators.blocks import halo, index_bars
from tickloom.session import materialize
from tickloom.sources.bars import exists

C = F.col
_MARKS = "product_id string, first_start timestamp, last_start timestamp, last_n long"


def since(bars: DataFrame, at: dt.datetime | None) -> DataFrame:
    """Rows from a time on; a ``day`` column, where the table has one, prunes its partitions."""
    if at is None:
        return bars.where(F.lit(False))
    rows = bars.where(C("start") >= F.lit(at))
    return rows.where(C("day") >= F.lit(at.date() - dt.timedelta(days=1))) if "day" in bars.columns else rows


def _state(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """The newest committed version of a state table."""
    folder = f"{path}/state/{name}"
    if not exists(spark, folder):
        return None
    table = spark.read.parquet(folder)
    newest = table.agg(F.max("version")).first()[0]
    return table.where(C("version") == newest).drop("version")


def _put_state(spark: SparkSession, path: str, name: str, rows: DataFrame, version: int) -> None:
    rows.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(f"{path}/state/{name}")


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/windows").drop("day")


def window_status(bars: DataFrame, marks: DataFrame, seq_len: int, horizon: int) -> DataFrame:
    """Per product: skip, hit, append or rebuild, with its counts and the first index to build.

    Reads two narrow columns of the history. A product whose stored part no longer has the bars it was built from is
    rebuilt. An append begins two horizons before the old end: labels look one horizon ahead, and weights count the labels one more ahead.
    """
    held = F.count(F.when(C("start") <= C("last_start"), 1))
    df = bars.select("product_id", "start").join(marks, "product_id", "left").groupBy("product_id", "first_start", "last_start", "last_n").agg(
        F.count("*").alias("n"), F.min("start").alias("first_now"), F.max("start").alias("last_now"), held.alias("held"))
    same = (C("first_start") == C("first_now")) & (C("held") == C("last_n"))
    status = (
        F.when(C("n") < seq_len + horizon + 1, "skip").when(~F.coalesce(same, F.lit(False)), "rebuild").when(C("n") == C("last_n"), "hit").otherwise("append")
    )
    begin = F.when(status == "append", F.greatest(F.lit(seq_len - 1), C("last_n") - 2 * horizon)).when(status == "rebuild", F.lit(0))
    return df.select("product_id", "n", "first_now", "last_now", "last_start", "last_n", status.alias("status"), begin.cast("long").alias("from_idx"))


def _of(rows: DataFrame, status: DataFrame, name: str, *columns: str) -> DataFrame:
    return rows.join(status.where(C("status") == name).select("product_id", *columns), "product_id")


def _numbered(rows: DataFrame, count: str) -> DataFrame:
    """Index of rows that follow ``count`` earlier ones of their product."""
    return index_bars(rows).withColumn("idx", C("idx") + C(count))


def _carried(target: DataFrame, tail: DataFrame, column: str) -> DataFrame:
    """The value in force at the end of the stored tail, where nothing newer is."""
    last = tail.groupBy("product_id").agg(F.max_by(column, "idx").alias("__carried"))
    return target.join(last, "product_id", "left").withColumn(column, F.coalesce(column, "__carried")).drop("__carried")


def top_up_windows(
    spark: SparkSession, path: str, bars: DataFrame, reference: DataFrame | None = None, funding: DataFrame | None = None, bars_5m: DataFrame | None = None,
    seq_len: int = features.WINDOW, horizon: int = 4, dead_zone: float = 0.003, precision: str = "float",
) -> DataFrame:
    """Bring the store at ``path`` up to the given bars; returns every product's status.

    Beside the windows the store keeps, per product, its high-water marks and the tail of its indexed and aligned input rows (one window and
    two horizons) and of its 5-minute bars. A top-up takes the halo of its new windows from that tail and reads only bars newer than
    the marks: with a ``day`` column (``read_bars(with_day=True)``) the scans prune all earlier days. It replaces the windows from two
    horizons before the old end on, in the days they lie in; all other windows stay untouched. The result equals a full build, as
    long as inputs only grow at their end: late reference, funding or 5-minute rows inside the stored time are not seen. Changed or older bars rebuild their product.

    Windows are written before marks, and both replace by key, so a failed top-up is repaired by the next one. One writer at a time.
    """
    marks = _state(spark, path, "marks")
    marks = spark.createDataFrame([], _MARKS) if marks is None else marks
    status = materialize(window_status(bars, marks, seq_len, horizon))
    counts = {r["status"]: (r["n"], r["low"]) for r in status.groupBy("status").agg(F.count("*").alias("n"), F.min("last_start").alias("low")).collect()}
    if not {"append", "rebuild"} & set(counts):
        return status
    inputs, fast_tail = [], []
    drop_day = lambda df: None if df is None else df.drop("day")

    if "rebuild" in counts:
        own = drop_day(_of(bars, status, "rebuild"))
        fives = None if bars_5m is None else materialize(index_bars(drop_day(_of(bars_5m, status, "rebuild"))))
        df = features.feature_inputs(own, drop_day(reference), funding)
        if fives is not None:
            df = features.with_fast_features(df, features.fast_states(halo(fives, features.FAST_LOOKBACK)))
            fast_tail.append(fives)
        inputs.append(df)

    if "append" in counts:
        low = counts["append"][1]
        tail = _of(_state(spark, path, "tail"), status, "append")
        new = _of(since(bars, low), status, "append", "last_start", "last_n").where(C("start") > C("last_start")).drop("day", "last_start")
        new = _numbered(new, "last_n").drop("last_n")
        if reference is not None:
            ref = since(reference, low).select(C("start").alias("ref_start"), C("close").alias("ref_close"))
            new = _carried(asof_join(new, ref, [], "start", "ref_start", ["ref_close"], 86_400 * 7).drop("ref_start_matched"), tail, "ref_close")
        if funding is not None:
            events = funding.select("product_id", F.timestamp_millis("funding_time_ms").alias("funding_at"), C("rate").alias("funding_rate")).where(C("funding_at") >= F.lit(low))
            new = asof_join(new, events, ["product_id"], "start", "funding_at", ["funding_rate"], 86_400 * 30).drop("funding_at_matched")
            new = _carried(new, tail, "funding_rate")
        if bars_5m is not None:
            held = _of(_state(spark, path, "fast"), status, "append")
            ends = held.groupBy("product_id").agg(F.max("start").alias("__last"), (F.max("idx") + 1).alias("__n"))
            oldest = held.groupBy("product_id").agg(F.max("start").alias("s")).agg(F.min("s")).first()[0]
            fresh = bars_5m if oldest is None else since(bars_5m, min(oldest, low))
            fresh = _of(fresh, status, "append").drop("day").join(ends, "product_id", "left").where(C("__last").isNull() | (C("start") > C("__last")))
            fresh = _numbered(fresh.withColumn("__n", F.coalesce("__n", F.lit(0))), "__n").drop("__n", "__last")
            fives = materialize(held.unionByName(fresh))
            states = features.fast_states(halo(fives, features.FAST_LOOKBACK)).join(ends, "product_id", "left")
            states = states.where(C("__last").isNull() | (C("fast_start") >= C("__last"))).drop("__last", "__n")
            new = features.with_fast_features(new, states)
            fast_tail.append(fives)
        inputs.append(tail.unionByName(new.select(*tail.columns)))

    rows = inputs[0]
    for more in inputs[1:]:
        rows = rows.unionByName(more.select(*rows.columns))
    rows = materialize(rows)
    begin = status.where(C("from_idx").isNotNull()).select("product_id", "from_idx")
    windows = features.dataset_of(rows, seq_len, horizon, dead_zone, precision).join(begin, "product_id").where(C("idx") >= C("from_idx")).drop("from_idx")
    windows = materialize(windows.withColumn("day", F.to_date("start")))
    _replace(spark, f"{path}/windows", windows, begin)

    version = int(dt.datetime.now(dt.timezone.utc).timestamp() * 1_000_000)
    done = status.where(C("status").isin("append", "rebuild"))

    def kept(old: DataFrame | None, fresh: DataFrame) -> DataFrame:
        if old is None:
            return fresh
        return old.join(done.select("product_id"), "product_id", "left_anti").select(*fresh.columns).unionByName(fresh)

    near = _last(rows, seq_len + 2 * horizon)
    _put_state(spark, path, "tail", kept(_state(spark, path, "tail"), near), version)
    if fast_tail:
        five = fast_tail[0]
        for more in fast_tail[1:]:
            five = five.unionByName(more.select(*five.columns))
        _put_state(spark, path, "fast", kept(_state(spark, path, "fast"), _last(five, features.FAST_LOOKBACK + 1)), version)
    now = done.select("product_id", C("first_now").alias("first_start"), C("last_now").alias("last_start"), C("n").alias("last_n"))
    _put_state(spark, path, "marks", kept(marks, now), version)
    return status


def _last(rows: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rows of every product by index."""
    ends = rows.groupBy("product_id").agg(F.max("idx").alias("__end"))
    return rows.join(ends, "product_id").where(C("idx") > C("__end") - n).drop("__end")


def _replace(spark: SparkSession, path: str, windows: DataFrame, begin: DataFrame) -> None:
    """Put windows in the place of their products' stored ones from ``from_idx`` on; only days that change are read and written."""
    days = {r["day"] for r in windows.select("day").distinct().collect()}  # at most one a calendar day
    merged = windows
    if exists(spark, path):
        stored = spark.read.parquet(path)
        changed = stored.select("product_id", "idx", "day").join(begin, "product_id").where(C("idx") >= C("from_idx"))
        first = windows.agg(F.min("day")).first()[0]
        if first is not None and begin.where(C("from_idx") == 0).isEmpty():
            changed = changed.where(C("day") >= F.lit(first - dt.timedelta(days=1)))  # nothing is rebuilt: older days keep their windows
        days |= {r["day"] for r in changed.select("day").distinct().collect()}
        held = stored.where(C("day").isin(sorted(days))).join(begin, "product_id", "left").where(C("from_idx").isNull() | (C("idx") < C("from_idx")))
        merged = materialize(held.select(*windows.columns).unionByName(windows))
        for day in days - {r["day"] for r in merged.select("day").distinct().collect()}:
            place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/day={day}")
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    (
        merged.repartitionByRange("day", "product_id", "idx").sortWithinPartitions("day", "product_id", "idx")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    )
