"""Streaming forms that need no custom state: bars, latest ticks, price patches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.session import shared_dir
from tickloom.sources.bars import time_bars

C = F.col


def streaming_bars(ticks: DataFrame, granularity: str | int = "ONE_HOUR", delay: str = "10 minutes") -> DataFrame:
    """Closed bars from a tick stream (append mode); ticks later than ``delay`` are dropped."""
    return time_bars(ticks.withWatermark("ts", delay), granularity)


def latest_ticks(ticks: DataFrame) -> DataFrame:
    """Newest tick per product (update mode); state is one row per product."""
    payload = F.struct("price", "volume", "seq")
    return ticks.groupBy("product_id").agg(
        F.max_by(payload, F.struct("ts", "seq")).alias("t"), F.max("ts").alias("ts")).select("product_id", "ts", "t.*")


def price_patches(ticks: DataFrame, products: DataFrame) -> DataFrame:
    """Stream-static join: each tick as a price change of a known product."""
    stored = products.select("product_id", C("price").alias("stored_price"))
    return ticks.join(stored, "product_id").withColumn("change", C("price") - C("stored_price"))


@contextmanager
def without_idle_batches(spark: SparkSession) -> Iterator[None]:
    """Queries started inside run no batch without data: in processing-time mode Spark would go on with them for ever.

    A query keeps the setting it started with, so the session has its own one back afterwards.
    """
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drain(stream: DataFrame, mode: str = "append", fold: Callable[[DataFrame], DataFrame] | None = None, idle_batches: bool = True) -> DataFrame:
    """Run a stream over all available input into a table of the shared folder and read it back.

    Every batch lands under its own id, so a batch repeated after a failure replaces itself.
    ``fold`` turns the changes of an update-mode stream into the final state. Without ``idle_batches`` the stream ends with its data.
    """
    spark: SparkSession = stream.sparkSession
    folder = shared_dir(spark)
    if folder is None:
        raise ValueError("a stream needs spark.checkpoint.dir to name a shared folder")
    base = f"{folder}/stream-{uuid.uuid4().hex}"

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    with nullcontext() if idle_batches else without_idle_batches(spark):
        run = (
            stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state")
            .trigger(availableNow=True).foreachBatch(save).start()
        )
    run.awaitTermination()
    stored = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.IntegerType())])
    out = spark.read.schema(stored).option("basePath", f"{base}/out").option("recursiveFileLookup", "true").parquet(f"{base}/out")
    return fold(out) if fold else out.drop("batch_id")


def newest_batch(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Fold update-mode changes to the last change per key."""

    def fold(changes: DataFrame) -> DataFrame:
        payload = F.struct(*[c for c in changes.columns if c not in keys])
        return changes.groupBy(*keys).agg(F.max_by(payload, "batch_id").alias("p")).select(*keys, "p.*").drop("batch_id")

    return fold
