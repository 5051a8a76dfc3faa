"""Bars: building them from ticks, storing, topping up, and reporting on the store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.session import materialize

# Bar granularities and their length in seconds.
GRANULARITY_SECONDS = {
    "ONE_MINUTE": 60, "FIVE_MINUTE": 300, "FIFTEEN_MINUTE": 900, "THIRTY_MINUTE": 1800,
    "ONE_HOUR": 3600, "TWO_HOUR": 7200, "SIX_HOUR": 21600, "ONE_DAY": 86400,
}


def time_bars(ticks: DataFrame, granularity: str | int = "ONE_HOUR", keys: Sequence[str] = ("product_id",)) -> DataFrame:
    """Ticks to OHLCV bars of a named granularity or a number of seconds.

    Works on batch and (with a watermark) on streaming input.

    One shuffle; open and close are picked by ``(ts, seq)`` so map-side combine reduces each
    partition to one row per key and bar before anything moves.
    """
    seconds = granularity if isinstance(granularity, int) else GRANULARITY_SECONDS[granularity]
    when = F.struct("ts", "seq")
    return (
        ticks.groupBy(*keys, F.window("ts", f"{seconds} seconds").alias("__w"))
        .agg(
            F.min_by("price", when).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", when).alias("close"),
            F.sum("volume").alias("volume"),
        )
        .select(*keys, F.col("__w.start").alias("start"), "open", "high", "low", "close", "volume")
    )


def dedupe_bars(bars: DataFrame, arrival: str, keep: str = "last") -> DataFrame:
    """One bar per ``(product_id, start)``: the first or the last to arrive."""
    pick = F.max_by if keep == "last" else F.min_by
    payload = F.struct(*[c for c in bars.columns if c not in ("product_id", "start", arrival)])
    return (
        bars.groupBy("product_id", "start")
        .agg(pick(payload, F.col(arrival)).alias("__bar"))
        .select("product_id", "start", "__bar.*")
    )


def write_bars(bars: DataFrame, path: str, granularity: str, arrival: str | None = None) -> None:
    """Add bars to the store, by granularity and day, sorted by product and time inside each file.

    The store keeps one bar per ``(product_id, start)``: a new bar replaces a stored one, and of several new ones the last
    by ``arrival`` stays (without it, the greatest by its values, so reruns agree). The days that ``bars`` touches are read,
    merged and written to a reliable checkpoint before they are replaced, so all other bars of those days stay. One writer at a time.
    """
    spark, values = bars.sparkSession, [c for c in schemas.BAR.fieldNames() if c not in ("product_id", "start")]
    bar = F.struct(*values)
    newest = F.struct(F.col(arrival), bar) if arrival else bar
    fresh = bars.groupBy("product_id", "start").agg(F.max_by(bar, newest).alias("bar"), F.lit(1).alias("side"))
    fresh = materialize(fresh.withColumn("day", F.to_date("start")))
    days = [r.day for r in fresh.select("day").distinct().collect()]  # at most one a calendar day
    stored = _stored(spark, path, granularity).where(F.col("day").isin(days)) if days else _stored(spark, path, granularity)
    held = stored.select("product_id", "start", bar.alias("bar"), F.lit(0).alias("side"), "day")
    merged = held.unionByName(fresh).groupBy("product_id", "start", "day").agg(F.max_by("bar", "side").alias("bar"))
    (
        materialize(merged.select("product_id", "start", "bar.*", "day"))
        .withColumn("granularity", F.lit(granularity))
        .repartitionByRange("day", "product_id", "start")
        .sortWithinPartitions("day", "product_id", "start")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "snappy")
        .partitionBy("granularity", "day")
        .parquet(path)
    )


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def _stored(spark: SparkSession, path: str, granularity: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.BAR_TABLE)
    return spark.read.schema(schemas.BAR_TABLE).parquet(path).where(F.col("granularity") == granularity)


def read_bars(spark: SparkSession, path: str, granularity: str = "ONE_HOUR", products: Sequence[str] | None = None, with_day: bool = False) -> DataFrame:
    """Stored bars of one granularity; a store that does not exist yet reads as empty.

    ``with_day`` keeps the column the store is partitioned by, so that readers can prune days.
    """
    bars = _stored(spark, path, granularity)
    if products is not None:
        bars = bars.where(F.col("product_id").isin(list(products)))
    return bars.select(*schemas.BAR.fieldNames(), *(["day"] if with_day else []))


def new_bars(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming bars whose start the store does not hold yet."""
    return incoming.join(existing.select("product_id", "start"), ["product_id", "start"], "left_anti")


def merge_history(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Union in which the existing side wins on equal ``(product_id, start)``."""
    return existing.unionByName(new_bars(existing, incoming))


def backfill_report(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Per product: bars added, bars held afterwards and the oldest start, for all products at once."""
    both = existing.withColumn("is_new", F.lit(0)).unionByName(new_bars(existing, incoming).withColumn("is_new", F.lit(1)))
    return both.groupBy("product_id").agg(
        F.sum("is_new").alias("new_bars"), F.count("*").alias("total_bars"), F.min("start").alias("oldest"),
    )


def backfill_summary(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count("*").alias("products"),
        F.sum("new_bars").alias("new_bars"),
        F.sum("total_bars").alias("total_bars"),
    )


def products_without_history(products: DataFrame, bars: DataFrame) -> DataFrame:
    return products.join(bars.select("product_id").distinct(), "product_id", "left_anti")


def history_status(bars: DataFrame) -> DataFrame:
    return bars.groupBy("product_id").agg(
        F.count("*").alias("bars"), F.min("start").alias("oldest"), F.max("start").alias("newest"),
    )


def gap_report(bars: DataFrame, granularity: str) -> DataFrame:
    """Missing stretches per product: each run of absent bars with its first start and length.

    Neighbouring starts are compared inside month buckets; the last start of the earlier bucket
    is carried in, so no product is sorted as a whole and the full grid is never generated.
    """
    from tickloom.operators.blocks import running

    seconds = GRANULARITY_SECONDS[granularity]
    starts = bars.select(
        "product_id", F.unix_seconds("start").alias("s"), F.floor(F.unix_seconds("start") / (86400 * 30)).alias("__b"))
    stepped = running(starts, ["product_id"], ["__b"], ["s"], {"prev": ("last", F.col("s"))}, inclusive=False)
    return stepped.where(F.col("s") - F.col("prev") > seconds).select(
        "product_id",
        F.timestamp_seconds(F.col("prev") + seconds).alias("gap_start"),
        ((F.col("s") - F.col("prev")) / seconds - 1).cast("long").alias("missing_bars"),
    )


def missing_bars(bars: DataFrame, granularity: str) -> DataFrame:
    """Every absent bar start, expanded from the gap report."""
    seconds = GRANULARITY_SECONDS[granularity]
    last = F.col("gap_start") + F.make_interval(secs=(F.col("missing_bars") - 1) * seconds)
    return gap_report(bars, granularity).select(
        "product_id", F.explode(F.sequence("gap_start", last, F.expr(f"interval {seconds} seconds"))).alias("start"))


def last_bars(bars: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` bars of every product.

    The cut-off start per product comes from counts per day; only days at or after the
    cut-off day reach the ranking window.
    """
    per_day = bars.groupBy("product_id", F.to_date("start").alias("day")).agg(F.count("*").alias("n"))
    newer = Window.partitionBy("product_id").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    needed = per_day.withColumn("newer", F.coalesce(F.sum("n").over(newer), F.lit(0))).where(F.col("newer") < n)
    candidates = bars.withColumn("day", F.to_date("start")).join(needed.select("product_id", "day"), ["product_id", "day"], "left_semi")
    rank = F.row_number().over(Window.partitionBy("product_id").orderBy(F.desc("start")))
    return candidates.withColumn("__rn", rank).where(F.col("__rn") <= n).drop("__rn", "day")


def bar_counts(bars: DataFrame) -> DataFrame:
    return bars.groupBy("product_id").agg(F.count("*").alias("bars"))
