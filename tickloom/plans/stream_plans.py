"""Streaming queries over the tick table read as a stream; each equals its batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.columns import rounded
from tickloom.plans import domain, sqlparts as q
from tickloom.plans.ledger_plans import book_columns, fills_of
from tickloom.plans.registry import ORACLE, query
from tickloom.plans.source_plans import OHLCV
from tickloom.sources import messages
from tickloom.streaming import stateful, windows

C = F.col
T, B = q.ticks(), q.bars()


def tick_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = domain.table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxBytesPerTrigger", 64 << 20).parquet(sf_dir)
    return raw.select(
        C("event_type").alias("product_id"), C("ts").cast("timestamp").alias("ts"), C("event_id").alias("seq"), C("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("volume"))


@query("st1_latest_ticks", f"WITH {T} SELECT product_id, max(s) AS ts, arg_max(price, (ts, seq)) AS price FROM ticks GROUP BY 1")
def latest_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = windows.drain(windows.latest_ticks(tick_stream(spark, sf_dir)), "update", windows.newest_batch(["product_id"]))
    return df.select("product_id", F.unix_seconds("ts").alias("ts"), "price")


@query("st7_streaming_bars", f"WITH {T}, {B} SELECT product_id, start, {q.cols(**{c: c for c in OHLCV})} FROM bars WHERE start + 3600 <= (SELECT max(epoch_us(ts)) / 1000000.0 FROM ticks) - 600")
def streaming_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars closed by the watermark; the open tail stays in state."""
    df = windows.drain(windows.streaming_bars(tick_stream(spark, sf_dir)))
    return df.select("product_id", F.unix_seconds("start").alias("start"), *[rounded(C(c)).alias(c) for c in OHLCV])


@query("st4_price_patches", f"WITH {T}, st AS (SELECT product_id, min(price) AS p0 FROM ticks WHERE product_id <> 'view' GROUP BY 1) SELECT seq, ticks.product_id, {q.r('price - p0')} AS change FROM ticks JOIN st ON ticks.product_id = st.product_id")
def price_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = domain.ticks(spark, sf_dir).where(C("product_id") != "view").groupBy("product_id").agg(F.min("price").alias("price"))
    df = windows.drain(windows.price_patches(tick_stream(spark, sf_dir), stored))
    return df.select("seq", "product_id", rounded(C("change")).alias("change"))


@query("src12_streaming_ticker_updates", f"WITH {T} SELECT product_id, {q.r('price')} AS price FROM ticks WHERE volume >= 50")
def streaming_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw messages parsed on the stream."""
    entry = F.struct("product_id", C("price").cast("string").alias("price"))
    channel = F.when(C("volume") >= 50, "ticker").otherwise("heartbeats")
    body = F.struct(channel.alias("channel"), F.array(F.struct(F.array(entry).alias("tickers"))).alias("events"))
    raw = tick_stream(spark, sf_dir).select(F.to_json(body).alias("value"))
    return windows.drain(messages.ticker_updates(raw)).select("product_id", rounded(C("price")).alias("price"))


def _released(sql: str) -> str:
    """Rows of a result that the watermark has passed; the tail of the stream still waits in state."""
    return f"SELECT z.* FROM ({sql}) z JOIN events w ON w.event_id = z.seq WHERE epoch_us(w.ts) // 1000 <= (SELECT max(epoch_us(ts)) // 1000 - 600000 FROM events)"


@query("sig2_streaming_suppress", _released(ORACLE["sig2_suppress_repeats"]))
def streaming_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = tick_stream(spark, sf_dir).withColumn("side", F.when(C("price") >= 50, "BUY").otherwise("SELL")).withWatermark("ts", "10 minutes")
    df = windows.drain(stateful.run(signals, ["product_id"], stateful.Suppress(3600)))
    return df.select("product_id", F.unix_seconds("ts").alias("ts"), "seq", "side")


@query("pos9_streaming_drawdown", _released(ORACLE["pos9_drawdown"]))
def streaming_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    balances = tick_stream(spark, sf_dir).select(C("product_id").alias("agent"), "ts", "seq", (C("price") + 900).alias("balance")).withWatermark("ts", "10 minutes")
    df = windows.drain(stateful.run(balances, ["agent"], stateful.Drawdown()))
    return df.select("agent", "seq", "halted", *[rounded(C(c)).alias(c) for c in ("day_drawdown", "week_drawdown")])


@query("pos1_streaming_book", _released(ORACLE["pos1_average_cost_book"]))
def streaming_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = domain.table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxBytesPerTrigger", 64 << 20).parquet(sf_dir)
    return book_columns(windows.drain(stateful.run(fills_of(raw).withWatermark("ts", "10 minutes"), ["agent"], stateful.ShareBook())))


@query("pos1_streaming_fixed_amounts", f"SELECT agent, seq, product_id, action, size, avg_price, pnl FROM ({_released(ORACLE['pos1_fixed_amounts'])})")
def streaming_fixed_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = domain.table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxBytesPerTrigger", 64 << 20).parquet(sf_dir)
    df = windows.drain(stateful.run(fills_of(raw).withWatermark("ts", "10 minutes"), ["agent", "product_id"], stateful.OpenPositions()))
    df = df.withColumn("pnl", F.nanvl("pnl", F.lit(None).cast("double")))
    return df.select("agent", "seq", "product_id", "action", *[rounded(C(c)).alias(c) for c in ("size", "avg_price", "pnl")])


@query("st5_streaming_ttl", ORACLE["st5_ttl_lookup"])
def streaming_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of one type refresh a cached value, all others look it up; it lives for 600 seconds."""
    refresh = C("product_id") == "error"
    rows = tick_stream(spark, sf_dir).select(
        F.lit("sentiment").alias("cache"), F.lit("fear_greed").alias("name"), "ts", F.when(~refresh, C("seq")).alias("seq"), F.when(refresh, C("price")).alias("value"))
    # The store may keep values longer than event time does, so that replaying history does not depend on the wall clock.
    cache = stateful.CachedValues(600, 50.0, state_ttl_seconds=86_400)
    return windows.drain(stateful.run(rows, ["cache"], cache, "ProcessingTime"), idle_batches=False).select("seq", "value")


_OUT_SQL = f"""WITH {T}, mx AS (SELECT max(epoch_us(ts)) // 1000 - 600000 AS wm FROM ticks),
 sg AS (SELECT product_id, seq, epoch_us(ts) // 1000 + 14400000 AS due, CASE WHEN volume >= 50 THEN 'BUY' ELSE 'SELL' END AS side, price AS entry FROM ticks WHERE seq % 5 = 0),
 cl AS (SELECT product_id, epoch_us(ts) // 1000 AS ms, price AS close FROM ticks WHERE seq % 5 <> 0),
 j AS (SELECT sg.*, close, (close - entry) / greatest(entry, 1e-9) AS raw FROM sg ASOF JOIN cl ON sg.product_id = cl.product_id AND sg.due >= cl.ms),
 z AS (SELECT *, CASE WHEN side = 'SELL' THEN -raw ELSE raw END AS chg FROM j, mx WHERE due <= wm)
 SELECT product_id, seq, side, close AS exit_price, {q.r('chg')} AS pct_change, CASE WHEN chg > 0.005 THEN 'WIN' WHEN chg < -0.005 THEN 'LOSS' ELSE 'NEUTRAL' END AS outcome FROM z"""


@query("out2_streaming_outcomes", _OUT_SQL)
def streaming_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth tick is a signal, the others set the price; timers resolve after four hours."""
    signal = C("seq") % 5 == 0
    rows = tick_stream(spark, sf_dir).select(
        "product_id", "ts", "seq", F.when(signal, F.when(C("volume") >= 50, "BUY").otherwise("SELL")).alias("side"),
        F.when(signal, C("price")).alias("entry_price"), F.when(~signal, C("price")).alias("close")).withWatermark("ts", "10 minutes")
    df = windows.drain(stateful.run(rows, ["product_id"], stateful.ResolveOutcomes(), "EventTime"))
    return df.select("product_id", "seq", "side", "exit_price", rounded(C("pct_change")).alias("pct_change"), "outcome")
