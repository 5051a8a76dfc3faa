"""The given tables read as domain tables (ticks, bars, trades, scans, products, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import reports
from tickloom.operators.alignment import with_known
from tickloom.operators.blocks import running
from tickloom.session import joins_as_dealt
from tickloom.sources.bars import time_bars

TRADE_ORDER = ["closed_at", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str, key: str = "event_type") -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col(key).cast("string").alias("product_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("volume"),
    )


def bars(spark: SparkSession, sf_dir: str, granularity: str | int = "ONE_HOUR", key: str = "event_type") -> DataFrame:
    return time_bars(ticks(spark, sf_dir, key), granularity)


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades: one per order line shipped on or after its order date."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    pnl = F.col("l_extendedprice") * (F.col("l_discount") - 0.05)
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .where(F.col("l_shipdate") >= F.col("o_orderdate"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            F.col("l_returnflag").alias("agent"),
            F.concat("l_linestatus", "p_brand").alias("product_id"),
            F.col("o_orderdate").cast("timestamp").alias("opened_at"),
            F.col("l_shipdate").cast("timestamp").alias("closed_at"),
            F.col("l_quantity").alias("size"),
            F.col("l_extendedprice").alias("usd_open"),
            pnl.alias("pnl"),
            (pnl / F.col("l_extendedprice") * 100).alias("pct_pnl"),
            F.col("o_orderpriority").alias("trigger_close"),
        )
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with the agent's balance after each close."""
    return with_balance(trades(spark, sf_dir))


def dealt_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the reports read of ``trades``, dealt by ``__range``, a range of 65 536 order keys; to be computed inside ``joins_as_dealt``.

    Lines and orders are dealt by the range only, in which the reports' buckets lie too, so a line moves once.
    """
    of = F.shiftright(F.col("l_orderkey"), 16)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    orders = orders.repartition(of).withColumn("__range", of)
    lines = with_known(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"), "l_partkey", "p_partkey")
    pnl = F.col("l_extendedprice") * (F.col("l_discount") - 0.05)
    lines = lines.select(
        *TRADE_ORDER[1:], F.col("l_returnflag").alias("agent"), "l_shipdate", pnl.alias("pnl"), (pnl / F.col("l_extendedprice") * 100).alias("pct_pnl"))
    lines = lines.repartition(of).withColumn("__range", of)
    joined = lines.hint("merge").join(orders, ["__range", "l_orderkey"]).where(F.col("l_shipdate") >= F.col("o_orderdate"))
    return joined.select(*TRADE_ORDER[1:], "agent", F.col("l_shipdate").cast("timestamp").alias("closed_at"), "__range", "pnl", "pct_pnl")


def ledger_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger reduced to one row per agent, close day and range of the order key."""
    with joins_as_dealt(spark):
        return reports.balance_parts(dealt_trades(spark, sf_dir), TRADE_ORDER, ["closed_at", "__range"], dealt=True)


def with_balance(closed: DataFrame, opening: float = 1000.0) -> DataFrame:
    """Opening balance plus running P&L per agent.

    The scan is cut by close day and, inside a day, by ranges of the order key, so neither a
    hot agent nor a hot day is sorted in one task.
    """
    cut = closed.withColumn("__range", F.shiftright("l_orderkey", 16))
    out = running(cut, ["agent"], ["closed_at", "__range"], TRADE_ORDER, {"balance_after": ("sum", F.col("pnl"))})
    return out.withColumn("balance_after", F.col("balance_after") + opening).drop("__range")


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan log: every tick seen as one scored scan of its product."""
    return ticks(spark, sf_dir).select(
        "product_id", F.col("ts").alias("scanned_at"), "seq", "price",
        (F.col("volume") / 100).alias("model_prob"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue: parts with traded volume; a line status stands in for the quote currency."""
    part = table(spark, sf_dir, "part")
    volume = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("volume_24h"))
    return part.join(volume, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_brand").alias("base"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_size") % 3 == 0, "EUR").otherwise("USD").alias("quote"),
        F.when(F.col("p_size") % 7 == 0, "delisted").otherwise("online").alias("status"),
        (F.col("p_size") % 11 == 0).alias("is_disabled"),
        F.col("p_retailprice").alias("price"),
        F.coalesce("volume_24h", F.lit(0.0)).alias("volume_24h"),
    )


def funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Funding events every eight hours: a hundredth of the bar's return."""
    from tickloom.operators.blocks import blocked, core_rows
    from tickloom.operators.layers import Indicator, lag, with_indicators

    previous = Indicator({"before": "__pc"}, [{"__pc": lag("close", 1, ("product_id",))}])
    df = core_rows(with_indicators(blocked(bars(spark, sf_dir, 28_800), 1), [previous]))
    return df.where("before IS NOT NULL").select(
        "product_id", (F.unix_seconds("start") * 1000).alias("funding_time_ms"),
        ((F.col("close") - F.col("before")) / F.col("before") / 100).alias("rate"),
    )
