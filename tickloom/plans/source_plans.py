"""Source, selection and look-up queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.columns import rounded
from tickloom.functions import scoring as S
from tickloom.operators import alignment, filters
from tickloom.plans import domain, sqlparts as q
from tickloom.plans.registry import query
from tickloom.sources import bars as store
from tickloom.session import shared_dir
from tickloom.sources import messages

C = F.col
T, B = q.ticks(), q.bars()
OHLCV = ("open", "high", "low", "close", "volume")


def _start(name: str = "start", alias: str = "start") -> Column:
    return F.unix_seconds(name).alias(alias)


# -- bars ----------------------------------------------------------------------------------

for _name, _seconds in store.GRANULARITY_SECONDS.items():
    def _bars(spark: SparkSession, sf_dir: str, name: str = _name) -> DataFrame:
        return domain.bars(spark, sf_dir, name).select("product_id", _start(), *[rounded(C(c)).alias(c) for c in OHLCV])

    query(f"src8_time_bars_{_name.lower()}", f"WITH {T}, {q.bars(_seconds)} SELECT product_id, start, {q.cols(**{c: c for c in OHLCV})} FROM bars")(_bars)


@query("src8_time_bars_by_user", f"WITH {q.ticks('user_id')}, {B} SELECT product_id, start, {q.cols(**{c: c for c in OHLCV})} FROM bars")
def bars_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.bars(spark, sf_dir, key="user_id").select("product_id", _start(), *[rounded(C(c)).alias(c) for c in OHLCV])


# Arriving bar versions: the hourly bar as it looks after each tick of the hour.
_ARRIVALS = f"{T}, arr AS (SELECT product_id, s // 3600 * 3600 AS start, price AS close, volume, seq FROM ticks)"


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = domain.ticks(spark, sf_dir)
    return t.select("product_id", F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 3600) * 3600).alias("start"), C("price").alias("close"), "volume", "seq")


for _keep, _fn, _id in (("last", "arg_max", "src3_dedupe_last_wins"), ("first", "arg_min", "src11_dedupe_first_wins")):
    def _dedupe(spark: SparkSession, sf_dir: str, keep: str = _keep) -> DataFrame:
        df = store.dedupe_bars(arrivals(spark, sf_dir), "seq", keep)
        return df.select("product_id", _start(), "close", "volume")

    query(_id, f"WITH {_ARRIVALS} SELECT product_id, start, {_fn}(close, seq) AS close, {_fn}(volume, seq) AS volume FROM arr GROUP BY 1, 2")(_dedupe)


# Stored history: the first three weeks; incoming: everything from the second week on.
_SPLIT = f"{T}, {B}, lim AS (SELECT min(start) AS t0 FROM bars), ex AS (SELECT * FROM bars, lim WHERE start < t0 + 1814400), inc AS (SELECT * FROM bars, lim WHERE start >= t0 + 604800)"


def history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = domain.bars(spark, sf_dir)
    begin = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    return b.where(C("start") < begin + F.expr("interval 21 days")), b.where(C("start") >= begin + F.expr("interval 7 days"))


@query("src4_backfill_report", f"WITH {_SPLIT}, nw AS (SELECT i.* FROM inc i ANTI JOIN ex e ON i.product_id = e.product_id AND i.start = e.start), "
       "al AS (SELECT product_id, start, 0 AS f FROM ex UNION ALL SELECT product_id, start, 1 FROM nw) "
       "SELECT product_id, sum(f)::BIGINT AS new_bars, count(*) AS total_bars, min(start) AS oldest FROM al GROUP BY 1")
def backfill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing, incoming = history(spark, sf_dir)
    return store.backfill_report(existing, incoming).select("product_id", "new_bars", "total_bars", _start("oldest", "oldest"))


def top_up(spark: SparkSession, sf_dir: str) -> str:
    """A store of the first three weeks, topped up with everything from the second week on, every other product one dearer."""
    existing, incoming = history(spark, sf_dir)
    path = f"{shared_dir(spark)}/bars-{uuid.uuid4().hex}"
    store.write_bars(existing, path, "ONE_HOUR")
    dearer = incoming.where(C("product_id").isin("click", "error", "view"))
    store.write_bars(dearer.withColumn("close", C("close") + 1), path, "ONE_HOUR")
    store.write_bars(store.new_bars(store.read_bars(spark, path), incoming), path, "ONE_HOUR")
    return path


_TOPPED = f"{_SPLIT}, up AS (SELECT product_id, start, open, high, low, close + CASE WHEN product_id IN ('click', 'error', 'view') AND start >= t0 + 604800 THEN 1 ELSE 0 END AS close, volume FROM bars, lim)"


@query("src1_src3_src4_store_top_up", f"WITH {_TOPPED} SELECT product_id, start, {q.cols(**{c: c for c in OHLCV})} FROM up")
def store_top_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = store.read_bars(spark, top_up(spark, sf_dir), "ONE_HOUR")
    return bars.select("product_id", _start(), *[rounded(C(c)).alias(c) for c in OHLCV])


@query("src2_stored_products", f"WITH {_TOPPED} SELECT product_id, start, {q.cols(close='close')} FROM up WHERE product_id IN ('click', 'signup')")
def stored_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = store.read_bars(spark, top_up(spark, sf_dir), "ONE_HOUR", ["click", "signup"])
    return bars.select("product_id", _start(), rounded(C("close")).alias("close"))


@query("src5_backfill_summary", f"WITH {_SPLIT}, u AS (SELECT product_id, start FROM ex UNION SELECT product_id, start FROM inc) "
       "SELECT count(DISTINCT product_id) AS products, (count(*) - (SELECT count(*) FROM ex))::BIGINT AS new_bars, count(*)::BIGINT AS total_bars FROM u")
def backfill_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.backfill_summary(store.backfill_report(*history(spark, sf_dir)))


@query("join5_history_union_live", f"WITH {_SPLIT} SELECT product_id, start, close, 'history' AS origin FROM ex UNION ALL "
       "SELECT i.product_id, i.start, i.close, 'live' FROM inc i ANTI JOIN ex e ON i.product_id = e.product_id AND i.start = e.start")
def history_union_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing, incoming = history(spark, sf_dir)
    df = store.merge_history(existing.withColumn("origin", F.lit("history")), incoming.withColumn("origin", F.lit("live")))
    return df.select("product_id", _start(), "close", "origin")


@query("src6_products_without_history", "SELECT c_custkey AS product_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def without_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = domain.table(spark, sf_dir, "customer").select(C("c_custkey").alias("product_id"))
    seen = domain.table(spark, sf_dir, "orders").where(C("o_orderpriority") == "1-URGENT").select(C("o_custkey").alias("product_id"))
    return store.products_without_history(products, seen)


@query("src7_history_status", f"WITH {T}, {B} SELECT product_id, count(*) AS bars, min(start) AS oldest, max(start) AS newest FROM bars GROUP BY 1")
def history_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.history_status(domain.bars(spark, sf_dir)).select("product_id", "bars", _start("oldest", "oldest"), _start("newest", "newest"))


_GAPS = f"{T}, {B}, gp AS (SELECT product_id, start, lag(start) OVER (PARTITION BY product_id ORDER BY start) AS p FROM bars)"


@query("src9_gap_report", f"WITH {_GAPS} SELECT product_id, p + 3600 AS gap_start, (start - p) // 3600 - 1 AS missing_bars FROM gp WHERE start - p > 3600")
def gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.gap_report(domain.bars(spark, sf_dir), "ONE_HOUR").select("product_id", _start("gap_start", "gap_start"), "missing_bars")


@query("src9_missing_bars", f"WITH {_GAPS} SELECT product_id, unnest(range(p + 3600, start, 3600)) AS start FROM gp WHERE start - p > 3600")
def missing_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.missing_bars(domain.bars(spark, sf_dir), "ONE_HOUR").select("product_id", _start())


@query("src10_last_bars", f"WITH {q.ticks('user_id')}, {B} SELECT product_id, start, close FROM bars QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY start DESC) <= 24")
def last_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.last_bars(domain.bars(spark, sf_dir, key="user_id"), 24).select("product_id", _start(), "close")


@query("src1_src2_bars_of_product", f"WITH {T}, {B}, {q.bars(300, 'bars5')} SELECT 'ONE_HOUR' AS granularity, start, close FROM bars WHERE product_id = 'purchase' "
       "UNION ALL SELECT 'FIVE_MINUTE', start, close FROM bars5 WHERE product_id = 'purchase'")
def bars_of_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [domain.bars(spark, sf_dir, g).where(C("product_id") == "purchase").select(F.lit(g).alias("granularity"), _start(), "close") for g in ("ONE_HOUR", "FIVE_MINUTE")]
    return parts[0].unionByName(parts[1])


@query("fil22_bar_counts", f"WITH {T}, {B} SELECT product_id, count(*) AS bars FROM bars GROUP BY 1")
def bar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.bar_counts(domain.bars(spark, sf_dir))


# -- messages ------------------------------------------------------------------------------

def ticker_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tick rows wrapped as raw exchange messages; some lack a price or an id."""
    t = domain.ticks(spark, sf_dir)
    entry = F.struct(
        F.when(C("seq") % 13 != 0, C("product_id")).alias("product_id"),
        F.when(C("seq") % 3 != 0, C("price").cast("string")).alias("price"),
        F.when(C("seq") % 7 != 0, C("price").cast("string")).alias("close"),
        F.when(C("seq") % 2 == 0, (C("price") - 0.5).cast("string")).alias("best_bid"),
        F.when(C("seq") % 5 != 0, (C("price") + 0.5).cast("string")).alias("best_ask"),
        C("volume").cast("string").alias("volume_24_h"),
    )
    channel = F.when(C("seq") % 11 == 0, "heartbeats").otherwise("ticker")
    body = F.struct(
        channel.alias("channel"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.array(F.struct(F.lit("update").alias("type"), F.array(entry).alias("tickers"))).alias("events"))
    return t.select(F.to_json(body).alias("value"))


@query("src12_ticker_updates", f"WITH {T} SELECT product_id, s AS ts, {q.cols(price='price', volume_24h='volume')}, "
       "CASE WHEN seq % 2 = 0 THEN round(price - 0.5, 6) END AS bid, CASE WHEN seq % 5 <> 0 THEN round(price + 0.5, 6) END AS ask "
       "FROM ticks WHERE seq % 11 <> 0 AND seq % 13 <> 0 AND (seq % 3 <> 0 OR seq % 7 <> 0)")
def ticker_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = messages.ticker_updates(ticker_messages(spark, sf_dir))
    return df.select("product_id", _start("ts", "ts"), *[rounded(C(c)).alias(c) for c in ("price", "volume_24h")], *[F.round(c, 6).alias(c) for c in ("bid", "ask")])


@query("src19_mid_price", f"WITH {T}, b AS (SELECT seq, CASE WHEN seq % 2 = 0 THEN price - 0.5 END AS bid, CASE WHEN seq % 5 <> 0 THEN price + 0.5 END AS ask FROM ticks) "
       f"SELECT seq, {q.r('coalesce((bid + ask) / 2, bid, ask)')} AS mid FROM b")
def mid_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = domain.ticks(spark, sf_dir)
    bid, ask = F.when(C("seq") % 2 == 0, C("price") - 0.5), F.when(C("seq") % 5 != 0, C("price") + 0.5)
    return t.select("seq", rounded(filters.mid_price(bid, ask)).alias("mid"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks written as a log: a header line each, and a continuation line after every third."""
    t = domain.ticks(spark, sf_dir)
    level = F.element_at(F.array(*[F.lit(x) for x in ("DEBUG", "INFO", "WARNING", "ERROR")]), (C("seq") % 4 + 1).cast("int"))
    head = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" ["), level, F.lit("] agents."), "product_id", F.lit(": price "), C("seq").cast("string"))
    texts = F.when(C("seq") % 3 == 0, F.array(head, F.concat(F.lit("  at level "), level))).otherwise(F.array(head))
    return t.select("seq", F.posexplode(texts).alias("p", "text")).select(
        F.lit("app.log").alias("file"), F.floor(C("seq") / 1000).alias("split"), (C("seq") * 2 + C("p")).alias("line"), "text")


_LOG = f"WITH {T}, lg AS (SELECT *, ['DEBUG', 'INFO', 'WARNING', 'ERROR'][seq % 4 + 1] AS level FROM ticks)"


@query("src13_log_records", f"{_LOG} SELECT s AS ts, level, 'agents.' || product_id AS logger, 'price ' || seq || CASE WHEN seq % 3 = 0 THEN chr(10) || '  at level ' || level ELSE '' END AS message FROM lg WHERE level IN ('WARNING', 'ERROR')")
def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.log_records(log_lines(spark, sf_dir), "WARNING").select(_start("ts", "ts"), "level", "logger", "message")


@query("fil18_log_search", f"{_LOG} SELECT sum((level = 'ERROR')::INT)::BIGINT AS errors, sum((level = 'WARNING')::INT)::BIGINT AS warnings, count(*) AS records FROM lg WHERE contains('agents.' || product_id, 'pur') OR contains('price ' || seq, 'pur')")
def log_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.log_level_counts(messages.log_search(messages.log_records(log_lines(spark, sf_dir)), "PUR"))


@query("src14_reasoning_numbers", f"WITH {T} SELECT seq, round(price, 2) AS rsi, CASE WHEN seq % 2 = 0 THEN round(-price, 2) END AS macd_hist, round(volume / 100, 2) AS bb_pos, NULL::DOUBLE AS cnn_prob FROM ticks")
def reasoning_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = domain.ticks(spark, sf_dir)
    text = F.concat(
        F.lit("RSI: "), F.round("price", 2).cast("string"), F.when(C("seq") % 2 == 0, F.concat(F.lit(" | MACD hist: -"), F.format_string("%.2f", C("price")))).otherwise(""),
        F.lit("\nBollinger pos: "), F.format_string("%.2f", C("volume") / 100))
    df = messages.reasoning_numbers(t.select("seq", text.alias("reasoning")), "reasoning")
    return df.select("seq", "rsi", "macd_hist", "bb_pos", "cnn_prob")


@query("src15_json_maps", f"WITH {T} SELECT seq, CASE WHEN seq % 9 = 0 THEN 0 ELSE 1 END::INT AS entries, CASE WHEN seq % 9 <> 0 THEN price END AS avg_price FROM ticks")
def json_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions encoded to JSON and decoded again; every ninth row is damaged on the way."""
    t = domain.ticks(spark, sf_dir)
    position = F.create_map("product_id", F.struct(C("volume").alias("size"), C("price").alias("avg_price")))
    text = F.when(C("seq") % 9 == 0, F.lit("{broken")).otherwise(F.to_json(position))
    df = t.select("seq", "product_id", text.alias("j")).withColumn("m", messages.decode_positions("j"))
    return df.select("seq", F.size("m").alias("entries"), F.try_element_at("m", C("product_id"))["avg_price"].alias("avg_price"))


_ASSETS = [row[0].removesuffix("-USD") for row in messages.VENUES] + ["ZZZ"]
_ASSET_SQL = "[" + ", ".join(f"'{a}'" for a in _ASSETS) + "]"


@query("src16_venue_symbols", f"WITH a AS (SELECT p_partkey, p_partkey % 27 AS i, {_ASSET_SQL}[p_partkey % 27 + 1] AS asset FROM part) "
       "SELECT p_partkey AS part, asset || '-USD' AS product_id, CASE WHEN i < 26 THEN asset || 'USDT' END AS futures_symbol, CASE WHEN i < 10 THEN asset || 'USDT' END AS sentiment_symbol, "
       "CASE WHEN i < 2 THEN asset END AS options_currency, asset || 'USDT' AS plain FROM a")
def venue_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(a) for a in _ASSETS])
    part = domain.table(spark, sf_dir, "part").select(
        C("p_partkey").alias("part"), F.concat(F.element_at(names, (C("p_partkey") % 27 + 1).cast("int")), F.lit("-USD")).alias("product_id"))
    return messages.with_venue_symbols(part).withColumn("plain", messages.plain_symbol(C("product_id")))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order book per hourly bar, some of them empty: levels step away from the close, sizes from the volume."""
    b = domain.bars(spark, sf_dir)

    def side(sign: str) -> Column:
        return F.expr(f"transform(filter(sequence(0, CAST(volume AS INT) % 20), i -> i > 0), i -> named_struct('price', close {sign} i * 0.25D, 'size', volume * (i % 5 + 1) {'' if sign == '-' else '+ i'}))")

    return b.withColumns({"bids": side("-"), "asks": side("+")})


_BOOKS = (
    f"WITH {T}, {B}, n AS (SELECT product_id, start, close, volume, volume::INT % 20 AS n FROM bars), "
    "bk AS (SELECT *, list_transform(range(1, n + 1), lambda i: volume * (i % 5 + 1)) AS bs, list_transform(range(1, n + 1), lambda i: volume * (i % 5 + 1) + i) AS sz FROM n)"
)


@query("src17_book_imbalance", f"{_BOOKS} SELECT product_id, start, {q.cols(bid_depth='coalesce(list_sum(bs), 0)', ask_depth='coalesce(list_sum(sz), 0)', imbalance='coalesce((list_sum(bs) - list_sum(sz)) / nullif(list_sum(bs) + list_sum(sz), 0), 0)')} FROM bk")
def book_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = books(spark, sf_dir).withColumns(messages.book_imbalance())
    return df.select("product_id", _start(), *[rounded(C(c)).alias(c) for c in ("bid_depth", "ask_depth", "imbalance")])


@query("src18_book_display", f"{_BOOKS} SELECT product_id, start, least(n, 15)::INT AS levels, CASE WHEN n > 0 THEN 0.5::DOUBLE END AS spread, list_max(bs[1:15])::DOUBLE AS max_bid_size, list_max(sz[1:15])::DOUBLE AS max_ask_size FROM bk")
def book_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = messages.book_display(books(spark, sf_dir))
    return df.select("product_id", _start(), F.size("bids").alias("levels"), rounded(C("spread")).alias("spread"), "max_bid_size", "max_ask_size")


# -- selections ----------------------------------------------------------------------------

P = q.PRODUCTS
_OK = "quote = 'USD' AND status = 'online' AND NOT is_disabled AND price >= 0.01 AND volume_24h * price >= 500000"


@query("fil1_universe", f"WITH {P} SELECT product_id, base, price, volume_24h FROM products WHERE {_OK} ORDER BY volume_24h * price DESC, product_id LIMIT 100")
def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen(spark, sf_dir).select("product_id", "base", "price", "volume_24h")


@query("fil1_universe_by_base_volume", f"WITH {P} SELECT product_id, volume_24h FROM products WHERE {_OK} ORDER BY volume_24h DESC, product_id LIMIT 100")
def universe_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.universe(domain.products(spark, sf_dir), min_notional=5e5, order_by="base").select("product_id", "volume_24h")


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.universe(domain.products(spark, sf_dir), min_notional=5e5)


@query("fil2_untracked", f"WITH {P}, u AS (SELECT product_id FROM products WHERE {_OK} ORDER BY volume_24h * price DESC, product_id LIMIT 100) SELECT product_id, false AS is_tracked FROM products WHERE base = 'Brand#2' AND product_id NOT IN (SELECT product_id FROM u)")
def untracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracked = domain.products(spark, sf_dir).where(C("base") == "Brand#2").select("product_id")
    return filters.untracked(tracked, chosen(spark, sf_dir))


@query("fil3_refreshed_products", f"WITH {T}, {B}, lt AS (SELECT product_id, arg_max(price, (ts, seq)) - 0.123 AS bid, arg_max(price, (ts, seq)) + 0.2 AS ask FROM ticks GROUP BY 1), "
       "x AS (SELECT product_id, max(high) AS high_24h, min(low) AS low_24h FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY start DESC) <= 24) GROUP BY 1) "
       f"SELECT x.product_id, {q.cols(bid='bid', ask='ask', spread='round(ask - bid, 4)')}, high_24h, low_24h FROM x JOIN lt ON x.product_id = lt.product_id")
def refreshed_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = domain.ticks(spark, sf_dir)
    latest = alignment.latest_per_key(t, ["product_id"], ["ts", "seq"])
    quotes = latest.select("product_id", (C("price") - 0.123).alias("bid"), (C("price") + 0.2).alias("ask"))
    extremes = store.last_bars(domain.bars(spark, sf_dir), 24).groupBy("product_id").agg(F.max("high").alias("high_24h"), F.min("low").alias("low_24h"))
    df = filters.refreshed_products(latest.select("product_id"), quotes, extremes)
    return df.select("product_id", *[rounded(C(c)).alias(c) for c in ("bid", "ask", "spread")], "high_24h", "low_24h")


@query("fil4_tracked_products", f"WITH {P} SELECT product_id, volume_24h FROM products WHERE status = 'online' ORDER BY volume_24h DESC, product_id LIMIT 50")
def tracked_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = domain.products(spark, sf_dir).where(C("status") == "online")
    return df.orderBy(F.desc("volume_24h"), "product_id").limit(50).select("product_id", "volume_24h")


@query("fil5_point_lookup", "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_partkey = 77")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.table(spark, sf_dir, "part").where(C("p_partkey") == 77).select("p_partkey", "p_name", "p_retailprice")


_SIGNALS = f"{T}, sg AS (SELECT seq, product_id, ts AS created_at, s, CASE WHEN price >= 50 THEN 'TA_BUY' WHEN price < 20 THEN 'ML_SELL' ELSE 'TA_SELL' END AS signal_type, price FROM ticks)"


def tick_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(C("price") >= 50, "TA_BUY").when(C("price") < 20, "ML_SELL").otherwise("TA_SELL")
    return domain.ticks(spark, sf_dir).select("seq", "product_id", C("ts").alias("created_at"), kind.alias("signal_type"), "price")


@query("fil6_signals_by_prefix", f"WITH {_SIGNALS} SELECT seq, product_id, signal_type, price FROM sg WHERE starts_with(signal_type, 'TA_') ORDER BY created_at DESC, seq DESC LIMIT 50")
def signals_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.signals_like(tick_signals(spark, sf_dir), "TA_").select("seq", "product_id", "signal_type", "price")


@query("fil7_orders_by_status", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def orders_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = filters.newest(domain.table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", 50, C("o_orderstatus") == "P")
    return df.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("fil8_scans_by_time_prefix", f"WITH {q.SCANS} SELECT seq, product_id, {q.cols(model_prob='model_prob')} FROM scans WHERE product_id = 'click' AND strftime(scanned_at, '%Y-%m-%dT%H') LIKE '2024-01-11T1%'")
def scans_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = domain.scans(spark, sf_dir).where(C("product_id") == "click")
    hit = F.lit(False)
    for hour in range(10, 20):
        hit = hit | filters.in_iso_prefix("scanned_at", f"2024-01-11T{hour}")
    return s.where(hit).select("seq", "product_id", rounded(C("model_prob")).alias("model_prob"))


_DEC = f"{T}, dc AS (SELECT seq, product_id, ts, CASE WHEN seq % 3 = 0 THEN 'TECH' ELSE 'CNN' END AS agent, CASE WHEN price > 70 THEN 'BUY' WHEN price < 10 THEN 'SELL' ELSE 'HOLD' END AS side, price FROM ticks)"


def tick_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(C("price") > 70, "BUY").when(C("price") < 10, "SELL").otherwise("HOLD")
    return domain.ticks(spark, sf_dir).select("seq", "product_id", "ts", F.when(C("seq") % 3 == 0, "TECH").otherwise("CNN").alias("agent"), side.alias("side"), "price")


@query("fil9_decisions", f"WITH {_DEC} SELECT seq, side, price FROM dc WHERE product_id = 'view' AND agent = 'TECH' AND side <> 'HOLD'")
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.decisions(tick_decisions(spark, sf_dir), "view", "TECH", True).select("seq", "side", "price")


@query("fil10_trades", f"WITH {q.TRADES} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {q.cols(pnl='pnl')} FROM trades WHERE agent = 'A' AND product_id = 'FBrand#2'")
def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = filters.trades(domain.trades(spark, sf_dir), "A", "FBrand#2", closed_only=True)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rounded(C("pnl")).alias("pnl"))


@query("fil14_retention", f"WITH {_DEC} SELECT count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-24 00:00:00') AS purged FROM dc")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.purge_count(tick_decisions(spark, sf_dir), "ts", F.to_timestamp(F.lit("2024-01-31 00:00:00")), 7)


@query("fil15_scan_table", f"WITH {q.SCANS} SELECT seq, product_id, {q.cols(model_prob='model_prob')} FROM scans WHERE contains(product_id, 'i')")
def scan_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.scan_table(domain.scans(spark, sf_dir), "I").select("seq", "product_id", rounded(C("model_prob")).alias("model_prob"))


@query("fil16_product_search", f"WITH {P} SELECT product_id, base, name FROM products WHERE contains(product_id::VARCHAR, '19') OR contains(lower(base), '19') OR contains(lower(name), '19')")
def product_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.product_search(domain.products(spark, sf_dir), "19").select("product_id", "base", "name")


@query("fil17_view_filters", f"WITH {q.TRADES} SELECT agent, trigger_close, count(*) AS n FROM trades WHERE agent = 'R' GROUP BY ALL")
def view_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.trades(domain.trades(spark, sf_dir), "R", closed_only=True).groupBy("agent", "trigger_close").agg(F.count("*").alias("n"))


@query("fil20_signals_by_strength", f"WITH {_SIGNALS} SELECT seq, {q.cols(strength='abs(price - 50) / 100')} FROM sg WHERE signal_type <> 'ML_SELL' ORDER BY abs(price - 50) DESC, seq LIMIT 200")
def by_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tick_signals(spark, sf_dir).where(C("signal_type") != "ML_SELL").withColumn("strength", F.abs(C("price") - 50) / 100)
    return df.orderBy(F.abs(C("price") - 50).desc(), "seq").limit(200).select("seq", rounded(C("strength")).alias("strength"))


@query("fil21_price_guard", f"WITH {T} SELECT product_id, count(*) AS usable FROM ticks WHERE price >= 0.05 GROUP BY 1")
def price_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.ticks(spark, sf_dir).where(filters.usable_price(C("price"), 0.05)).groupBy("product_id").agg(F.count("*").alias("usable"))


# -- joins on the latest row ---------------------------------------------------------------

@query("join6_live_price", f"WITH {T}, lt AS (SELECT product_id, arg_max(price, (ts, seq)) AS lp FROM ticks WHERE product_id <> 'view' GROUP BY 1), "
       "st AS (SELECT product_id, min(price) AS price FROM ticks GROUP BY 1) SELECT st.product_id, coalesce(CASE WHEN lp > 0 THEN lp END, price) AS price FROM st LEFT JOIN lt ON st.product_id = lt.product_id")
def live_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = domain.ticks(spark, sf_dir)
    latest = alignment.latest_per_key(t.where(C("product_id") != "view"), ["product_id"], ["ts", "seq"])
    return alignment.with_live_price(t.groupBy("product_id").agg(F.min("price").alias("price")), latest).select("product_id", "price")


@query("join7_mark_to_market", f"WITH {q.ticks('user_id')}, lt AS (SELECT product_id, arg_max(price, (ts, seq)) AS lp, avg(price) AS ap, sum(volume) AS sz FROM ticks GROUP BY 1), "
       "ps AS (SELECT product_id, lp, sz, CASE WHEN product_id::BIGINT % 10 = 0 THEN 0.0 ELSE ap END AS avg_price FROM lt) "
       f"SELECT product_id, avg_price <= 0 AS entry_corrupt, {q.cols(pnl='CASE WHEN lp > 0 AND avg_price > 0 THEN (lp - avg_price) * sz END', pct='CASE WHEN lp > 0 AND avg_price > 0 THEN (lp - avg_price) / avg_price * 100 END')} FROM ps")
def mark_to_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = domain.ticks(spark, sf_dir, "user_id")
    latest = alignment.latest_per_key(t, ["product_id"], ["ts", "seq"])
    positions = t.groupBy("product_id").agg(F.sum("volume").alias("size"), F.avg("price").alias("ap")).withColumn(
        "avg_price", F.when(C("product_id").cast("long") % 10 == 0, 0.0).otherwise(C("ap")))
    df = alignment.marked_to_market(positions, latest)
    return df.select("product_id", "entry_corrupt", rounded(C("unrealized_pnl")).alias("pnl"), rounded(C("unrealized_pct")).alias("pct"))


@query("join8_latest_decision", f"WITH {_DEC} SELECT product_id, agent, arg_max(side, (ts, seq)) AS side, max(ts) IS NOT NULL AS known FROM dc GROUP BY 1, 2")
def latest_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = alignment.latest_per_key(tick_decisions(spark, sf_dir), ["product_id", "agent"], ["ts", "seq"])
    return df.select("product_id", "agent", "side", C("ts").isNotNull().alias("known"))


@query("join9_last_two_decisions", f"WITH {_DEC} SELECT product_id, seq, side, row_number() OVER (PARTITION BY product_id ORDER BY ts DESC, seq DESC)::INT AS rank FROM dc QUALIFY rank <= 2")
def last_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.latest_n_per_key(tick_decisions(spark, sf_dir), ["product_id"], ["ts", "seq"], 2).select("product_id", "seq", "side", "rank")


_BAND_SQL = f"""WITH {q.SCANS}, tr AS (SELECT product_id, ts AS opened_at, s AS os, seq AS trade, price - 50 AS pnl FROM ticks WHERE volume >= 50),
 bs AS (SELECT * FROM scans WHERE model_prob < 0.5)"""


def band_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = domain.ticks(spark, sf_dir)
    trades_ = t.where(C("volume") >= 50).select("product_id", C("ts").alias("opened_at"), C("seq").alias("trade"), (C("price") - 50).alias("pnl"))
    return trades_, domain.scans(spark, sf_dir).where(C("model_prob") < 0.5).select("product_id", "scanned_at", "seq", "model_prob")


@query("join1_band_join", _BAND_SQL + f""" SELECT t.product_id, t.trade, b.seq, hour(t.opened_at)::INT AS hour_of_day, dayofweek(t.opened_at)::INT AS day_of_week, {q.cols(pnl='t.pnl', model_prob='b.model_prob')}
 FROM tr t JOIN bs b ON t.product_id = b.product_id AND abs(t.os - b.s) < 120""")
def band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = alignment.band_join(*band_sides(spark, sf_dir), ["product_id"], "opened_at", "scanned_at", 120)
    return df.select(
        "product_id", "trade", "seq", F.hour("opened_at").alias("hour_of_day"), (F.dayofweek("opened_at") - 1).alias("day_of_week"),
        rounded(C("pnl")).alias("pnl"), rounded(C("model_prob")).alias("model_prob"))


@query("join1_band_join_nearest", _BAND_SQL + " SELECT t.trade, arg_min(b.seq, (abs(epoch_us(t.opened_at) - epoch_us(b.scanned_at)), b.seq)) AS seq FROM tr t JOIN bs b ON t.product_id = b.product_id AND abs(t.os - b.s) < 120 GROUP BY 1")
def band_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = alignment.band_join(*band_sides(spark, sf_dir), ["product_id"], "opened_at", "scanned_at", 120)
    return alignment.nearest(pairs, ["trade"], "opened_at", "scanned_at", "seq").select("trade", "seq")


@query("ind29_venue_premium", f"WITH {T}, pa AS (SELECT s, seq, ts, price FROM ticks WHERE product_id = 'click'), pb AS (SELECT ts AS bts, price AS bp FROM ticks WHERE product_id = 'view'), "
       "j AS (SELECT pa.*, bp, bts FROM pa ASOF LEFT JOIN pb ON pa.ts >= pb.bts) "
       f"SELECT seq, {q.r('CASE WHEN epoch_us(ts) - epoch_us(bts) <= 3600000000 THEN (price - bp) / bp END')} AS premium FROM j")
def venue_premium(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price gap to the other venue's latest quote, ignored when older than an hour."""
    t = domain.ticks(spark, sf_dir)
    other = t.where(C("product_id") == "view").select(C("ts").alias("other_ts"), C("price").alias("other"))
    df = alignment.asof_scan(t.where(C("product_id") == "click"), other, [], "ts", "other_ts", ["other"], max_age_seconds=3600)
    return df.select("seq", rounded(S.premium(C("price"), C("other"))).alias("premium"))


@query("st5_ttl_lookup", f"WITH {T}, m AS (SELECT product_id, s, ts, seq, price FROM ticks WHERE product_id <> 'error'), r AS (SELECT ts AS rt, price AS rp FROM ticks WHERE product_id = 'error'), "
       "j AS (SELECT m.*, rp, rt FROM m ASOF LEFT JOIN r ON m.ts >= r.rt) SELECT seq, coalesce(CASE WHEN epoch_us(ts) - epoch_us(rt) <= 600000000 THEN rp END, 50.0) AS value FROM j")
def ttl_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached value with a 600-second time to live; the neutral 50 where it has expired."""
    t = domain.ticks(spark, sf_dir)
    ref = t.where(C("product_id") == "error").select(C("ts").alias("rt"), C("price").alias("value"))
    df = alignment.asof_scan(t.where(C("product_id") != "error"), ref, [], "ts", "rt", ["value"], max_age_seconds=600)
    return df.select("seq", F.coalesce("value", F.lit(50.0)).alias("value"))
