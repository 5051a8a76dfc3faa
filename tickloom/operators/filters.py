"""Selections the trading tables are read with: universe, look-ups, newest-first lists, searches."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col

# Sort order that makes equal keys deterministic is always part of the query.
SCAN_SORT_NULL = -999.0


def universe(products: DataFrame, quote: str = "USD", min_price: float = 0.01, min_notional: float = 1e6, top: int = 100, order_by: str = "notional") -> DataFrame:
    """Tradable products by volume. ``order_by="base"`` ranks on base units instead of value."""
    notional = C("volume_24h") * C("price")
    rank = notional if order_by == "notional" else C("volume_24h")
    return (
        products.where(
            (C("quote") == quote) & (C("status") == "online") & ~C("is_disabled") & (C("price") >= min_price) & (notional >= min_notional))
        .orderBy(rank.desc(), "product_id").limit(top)
    )


def untracked(tracked: DataFrame, chosen: DataFrame) -> DataFrame:
    """Tracked products missing from the new universe, flagged as no longer tracked."""
    return tracked.join(chosen.select("product_id"), "product_id", "left_anti").withColumn("is_tracked", F.lit(False))


def refreshed_products(catalogue: DataFrame, quotes: DataFrame, extremes: DataFrame) -> DataFrame:
    """Catalogue with best bid/ask, spread and the 24-bar high and low computed first."""
    return (
        catalogue.join(quotes, "product_id", "left").join(extremes, "product_id", "left")
        .withColumn("spread", F.when(C("bid").isNotNull() & C("ask").isNotNull(), F.round(C("ask") - C("bid"), 4)))
    )


def mid_price(bid: Column, ask: Column) -> Column:
    return F.coalesce((bid + ask) / 2, bid, ask)


def newest(df: DataFrame, ts: str, tie: str, limit: int | None = None, where: Column | None = None) -> DataFrame:
    """Newest-first list, optionally filtered and cut (a top-k, not a full sort, when cut)."""
    if where is not None:
        df = df.where(where)
    df = df.orderBy(F.desc(ts), F.desc(tie))
    return df if limit is None else df.limit(limit)


def signals_like(df: DataFrame, prefix: str | None = None, limit: int = 50) -> DataFrame:
    return newest(df, "created_at", "seq", limit, C("signal_type").startswith(prefix) if prefix else None)


def iso_prefix_range(prefix: str) -> tuple[dt.datetime, dt.datetime]:
    """Half-open time range of an ISO time prefix such as ``2026-04-11T19``."""
    text = prefix.replace(" ", "T").rstrip("Z")
    if len(text) <= 4:
        year = int(text)
        return dt.datetime(year, 1, 1), dt.datetime(year + 1, 1, 1)
    if len(text) <= 7:
        year, month = int(text[:4]), int(text[5:7])
        return dt.datetime(year, month, 1), dt.datetime(year + month // 12, month % 12 + 1, 1)
    steps = {10: dt.timedelta(days=1), 13: dt.timedelta(hours=1), 16: dt.timedelta(minutes=1), 19: dt.timedelta(seconds=1)}
    start = dt.datetime.fromisoformat(text if len(text) != 13 else text + ":00")
    return start, start + steps[len(text)]


def in_iso_prefix(ts: str, prefix: str) -> Column:
    """Range predicate for a time prefix; unlike a string match it prunes files and partitions."""
    start, end = (t.strftime("%Y-%m-%d %H:%M:%S") for t in iso_prefix_range(prefix))
    return (C(ts) >= F.to_timestamp(F.lit(start))) & (C(ts) < F.to_timestamp(F.lit(end)))


def decisions(df: DataFrame, product: str | None = None, agent: str | None = None, signals_only: bool = False) -> DataFrame:
    if product:
        df = df.where(C("product_id") == product)
    if agent:
        df = df.where(C("agent") == agent)
    return df.where(C("side") != "HOLD") if signals_only else df


def trades(df: DataFrame, agent: str | None = None, product: str | None = None, open_only: bool = False, closed_only: bool = False) -> DataFrame:
    if agent:
        df = df.where(C("agent") == agent)
    if product:
        df = df.where(C("product_id") == product)
    if open_only:
        df = df.where(C("closed_at").isNull())
    return df.where(C("closed_at").isNotNull()) if closed_only else df


def scan_table(df: DataFrame, text: str = "", side: str | None = None, signals_only: bool = False, sort: str = "model_prob", descending: bool = True, tie: str = "seq") -> DataFrame:
    """Scan view: substring on the id, side and signal filters, any sort key with nulls as -999."""
    if text:
        df = df.where(F.lower("product_id").contains(text.lower()))
    if side:
        df = df.where(C("side") == side)
    if signals_only:
        df = df.where(C("side") != "HOLD")
    numeric = dict(df.dtypes)[sort] != "string"
    key = F.coalesce(C(sort), F.lit(SCAN_SORT_NULL)) if numeric else C(sort)
    return df.orderBy(key.desc() if descending else key.asc(), tie)


def product_search(df: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring over id, base and name."""
    needle = text.lower()
    hit = F.lit(False)
    for column in ("product_id", "base", "name"):
        hit = hit | F.lower(C(column).cast("string")).contains(needle)
    return df.where(hit)


def held(positions: DataFrame) -> DataFrame:
    return positions.where(C("size") > 0).orderBy(C("current_value").desc(), "product_id")


def pending_outcomes(df: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Unresolved outcomes that are due, oldest first."""
    due = df.where(C("outcome").isNull() & (C("check_after") <= now)).orderBy("check_after", "seq")
    return due if limit is None else due.limit(limit)


def retained(df: DataFrame, ts: str, now: Column, days: int = 7) -> DataFrame:
    return df.where(C(ts) >= now - F.make_dt_interval(days=F.lit(days)))


def purge_count(df: DataFrame, ts: str, now: Column, days: int = 7) -> DataFrame:
    return df.where(C(ts) < now - F.make_dt_interval(days=F.lit(days))).agg(F.count("*").alias("purged"))


def usable_price(price: Column, floor: float = 0.01) -> Column:
    """Guard against missing, zero and micro prices."""
    return price.isNotNull() & (price >= floor)
