"""Semi-structured inputs: ticker messages, log files, reasoning text, JSON maps, order books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom import schemas
from tickloom.operators.blocks import running

C = F.col


def _number(value: Column) -> Column:
    return F.when(value != "", value).try_cast("double")


def ticker_updates(messages: DataFrame, payload: str = "value") -> DataFrame:
    """Flatten raw ticker messages; entries without id or price are dropped, a price of zero is one. Batch or streaming."""
    parsed = messages.withColumn("m", F.from_json(payload, schemas.TICKER_MESSAGE)).where(C("m.channel") == "ticker")
    flat = parsed.select("m.timestamp", F.explode("m.events").alias("e")).select("timestamp", F.explode("e.tickers").alias("t"))
    price = F.coalesce(_number(C("t.price")), _number(C("t.close")))
    return flat.select(
        C("t.product_id").alias("product_id"), C("timestamp").alias("ts"), price.alias("price"),
        _number(C("t.best_bid")).alias("bid"), _number(C("t.best_ask")).alias("ask"),
        F.coalesce(_number(C("t.volume_24_h")), F.lit(0.0)).alias("volume_24h"),
        F.coalesce(_number(C("t.price_percent_chg_24_h")), F.lit(0.0)).alias("pct_change"),
    ).where((C("product_id") != "") & C("price").isNotNull())


# Severity of the log levels.
LEVELS = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}
LOG_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) \[(\w+)\] ([\w.]+): (.+)$"


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Log lines with an order: file, split inside the file, and line inside the split."""
    return spark.read.text(path).select(
        C("_metadata.file_path").alias("file"), C("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"), C("value").alias("text"))


def log_records(lines: DataFrame, min_level: str = "DEBUG") -> DataFrame:
    """Log records from ``file, split, line, text``; lines without a header extend the record above.

    The header a line belongs to is a running last value per split, so a file of any size is
    read in parallel. Continuation lines of dropped records are dropped with them.
    """
    header = C("text").rlike(LOG_LINE)
    df = running(lines, ["file"], ["split"], ["line"], {"head": ("last", F.when(header, F.struct("split", "line")))})
    grouped = df.where(C("head").isNotNull()).groupBy("file", "head").agg(
        F.array_sort(F.collect_list(F.struct("split", "line", "text"))).alias("lines"))
    first = C("lines")[0]["text"]

    def part(i: int) -> Column:
        return F.regexp_extract(first, LOG_LINE, i)

    more = F.transform(F.slice("lines", 2, F.greatest(F.size("lines"), F.lit(1))), lambda x: x["text"])
    records = grouped.select(
        "file", "head", F.to_timestamp(part(1)).alias("ts"), part(2).alias("level"), part(3).alias("logger"),
        F.array_join(F.concat(F.array(part(4)), more), "\n").alias("message"))
    rank = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    return records.where(F.try_element_at(rank, C("level")) >= LEVELS[min_level])


def log_search(records: DataFrame, text: str) -> DataFrame:
    needle = text.lower()
    return records.where(F.lower("message").contains(needle) | F.lower("logger").contains(needle))


def log_level_counts(records: DataFrame) -> DataFrame:
    return records.agg(
        F.sum((C("level").isin("ERROR", "CRITICAL")).cast("long")).alias("errors"),
        F.sum((C("level") == "WARNING").cast("long")).alias("warnings"), F.count("*").alias("records"))


# Labelled numbers in reasoning text.
SIGNAL_FIELDS = {
    "cnn_prob": r"cnn_prob=([\d.]+)", "llm_prob": r"llm_prob=([\d.]+)", "model_prob": r"model_prob=([\d.]+)",
    "rsi": r"RSI:\s*([\d.]+)", "macd_hist": r"MACD hist:\s*([+-]?[\d.]+)", "bb_pos": r"Bollinger pos:\s*([\d.]+)",
    "ob_imbalance": r"OB imbalance:\s*([+-]?[\d.]+)",
}
INDICATOR_FIELDS = {
    "RSI": r"(?i)RSI[=:\s]+([\d.]+)", "ADX": r"(?i)ADX[=:\s]+([\d.]+)", "MFI": r"(?i)MFI[=:\s]+([\d.]+)",
    "BB": r"(?i)BB[=:\s]+([+-]?[\d.]+)", "MACD": r"(?i)MACD[=:\s]+([+-]?[\d.]+)", "Stoch": r"(?i)stoch[=:\s]+([\d.]+)",
    "ROC": r"(?i)ROC[=:\s]+([+-]?[\d.]+)", "Mom": r"(?i)mom[=:\s]+([+-]?[\d.]+)", "VWMom": r"(?i)vwm[=:\s]+([+-]?[\d.]+)",
}


def reasoning_numbers(df: DataFrame, text: str, fields: dict[str, str] = SIGNAL_FIELDS) -> DataFrame:
    """One nullable number column per labelled field found in free text."""
    return df.withColumns({n: F.regexp_extract(C(text), p, 1).try_cast("double") for n, p in fields.items()})


def decode_positions(column: str) -> Column:
    """JSON map of positions; bad JSON becomes an empty map."""
    return F.coalesce(F.from_json(column, schemas.POSITIONS), F.from_json(F.lit("{}"), schemas.POSITIONS))


def decode_numbers(column: str) -> Column:
    kind = T.MapType(T.StringType(), T.StringType())
    return F.coalesce(F.from_json(column, kind), F.from_json(F.lit("{}"), kind))


# product_id, futures symbol, sentiment symbol, options currency.
VENUES = [
    ("BTC-USD", "BTCUSDT", "BTCUSDT", "BTC"),
    ("ETH-USD", "ETHUSDT", "ETHUSDT", "ETH"),
    ("SOL-USD", "SOLUSDT", "SOLUSDT", None),
    ("XRP-USD", "XRPUSDT", "XRPUSDT", None),
    ("BNB-USD", "BNBUSDT", "BNBUSDT", None),
    ("ADA-USD", "ADAUSDT", "ADAUSDT", None),
    ("AVAX-USD", "AVAXUSDT", "AVAXUSDT", None),
    ("LINK-USD", "LINKUSDT", "LINKUSDT", None),
    ("DOT-USD", "DOTUSDT", "DOTUSDT", None),
    ("MATIC-USD", "MATICUSDT", "MATICUSDT", None),
    ("DOGE-USD", "DOGEUSDT", None, None),
    ("LTC-USD", "LTCUSDT", None, None),
    ("ATOM-USD", "ATOMUSDT", None, None),
    ("FIL-USD", "FILUSDT", None, None),
    ("NEAR-USD", "NEARUSDT", None, None),
    ("APT-USD", "APTUSDT", None, None),
    ("INJ-USD", "INJUSDT", None, None),
    ("ARB-USD", "ARBUSDT", None, None),
    ("OP-USD", "OPUSDT", None, None),
    ("TIA-USD", "TIAUSDT", None, None),
    ("SEI-USD", "SEIUSDT", None, None),
    ("SUI-USD", "SUIUSDT", None, None),
    ("RNDR-USD", "RNDRUSDT", None, None),
    ("FET-USD", "FETUSDT", None, None),
    ("AAVE-USD", "AAVEUSDT", None, None),
    ("UNI-USD", "UNIUSDT", None, None),
]


def venue_symbols(spark: SparkSession) -> DataFrame:
    """Dimension of listed products: futures symbol, sentiment symbol and options currency."""
    return spark.createDataFrame(VENUES, "product_id string, futures_symbol string, sentiment_symbol string, options_currency string")


def with_venue_symbols(df: DataFrame) -> DataFrame:
    """Left join with the venue dimension (26 rows, so broadcast); unlisted products get nulls."""
    return df.join(F.broadcast(venue_symbols(df.sparkSession)), "product_id", "left")


def plain_symbol(product_id: Column) -> Column:
    """Symbol by string replacement, for products outside the listing."""
    return F.replace(F.replace(product_id, F.lit("-"), F.lit("")), F.lit("USD"), F.lit("USDT"))


def depth(levels: str) -> Column:
    return F.aggregate(levels, F.lit(0.0), lambda s, x: s + x["size"])


def book_imbalance(bids: str = "bids", asks: str = "asks") -> dict[str, Column]:
    """Depth per side and their imbalance; zero where either side is empty."""
    both = (F.size(bids) > 0) & (F.size(asks) > 0)
    b, a = F.when(both, depth(bids)), F.when(both, depth(asks))
    return {
        "bid_depth": F.coalesce(b, F.lit(0.0)), "ask_depth": F.coalesce(a, F.lit(0.0)),
        "imbalance": F.coalesce(F.try_divide(b - a, b + a), F.lit(0.0)),
    }


def book_display(df: DataFrame, levels: int = 15) -> DataFrame:
    """Top levels per side, spread and the largest size shown per side."""
    top = df.withColumns({"bids": F.slice("bids", 1, levels), "asks": F.slice("asks", 1, levels)})

    def largest(side: str) -> Column:
        return F.array_max(F.transform(side, lambda x: x["size"]))

    return top.withColumns({
        "spread": F.get("asks", F.lit(0))["price"] - F.get("bids", F.lit(0))["price"],
        "max_bid_size": largest("bids"), "max_ask_size": largest("asks"),
    })
