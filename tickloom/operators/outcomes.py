"""Signal outcomes: record, resolve at the horizon, word the lesson."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import fixed, two_decimals
from tickloom.functions.scoring import indicator_summary
from tickloom.operators.alignment import asof_join, latest_n_per_key

C = F.col
HORIZON = 4 * 3600


def record(signals: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Pending outcomes of ``source, product_id, side, confidence, price, created_at, indicators``."""
    return signals.withColumns({
        "confidence": F.round("confidence", 4), "entry_price": F.round("price", 6),
        "check_after": C("created_at") + F.make_interval(secs=F.lit(horizon)),
    })


def signed_change(entry: Column, exit_: Column, side: Column) -> Column:
    raw = (exit_ - entry) / F.greatest(entry, F.lit(1e-9))
    return F.when(side == "SELL", -raw).otherwise(raw)


def verdict(change: Column, win: float = 0.005, loss: float = 0.005) -> Column:
    return F.when(change > win, "WIN").when(change < -loss, "LOSS").otherwise("NEUTRAL")


def exit_prices(pending: DataFrame, bars: DataFrame, products: DataFrame | None = None, bucket_seconds: int = 86_400 * 7, bar_seconds: int = 3600) -> DataFrame:
    """Close of the latest bar that has ended at ``check_after``, else the stored price, else none."""
    ended = C("start") + F.make_dt_interval(secs=F.lit(bar_seconds))
    ref = bars.select("product_id", ended.alias("bar_start"), C("close").alias("exit_price"))
    df = asof_join(pending, ref, ["product_id"], "check_after", "bar_start", ["exit_price"], bucket_seconds).drop("bar_start_matched")
    if products is not None:
        stored = products.select("product_id", C("price").alias("__stored"))
        df = df.join(stored, "product_id", "left").withColumn("exit_price", F.coalesce("exit_price", "__stored")).drop("__stored")
    return df


def resolve(pending: DataFrame, bars: DataFrame, now: Column | None = None, products: DataFrame | None = None) -> DataFrame:
    """Outcome and lesson of every due signal with a known exit price."""
    due = pending if now is None else pending.where(C("check_after") <= now)
    df = exit_prices(due, bars, products).where(C("exit_price").isNotNull())
    change = signed_change(C("entry_price"), C("exit_price"), C("side"))
    df = df.withColumn("__change", change).withColumn("outcome", verdict(C("__change")))
    return df.withColumn("lesson", lesson()).withColumn("pct_change", F.round("__change", 6)).drop("__change")


def lesson() -> Column:
    """One line: source, side, confidence, indicators, unsigned move and verdict."""
    raw = (C("exit_price") - C("entry_price")) / F.greatest(C("entry_price"), F.lit(1e-9)) * 100
    return F.format_string("%s %s conf=%s %s → %s%% after 4h [%s]", "source", "side", two_decimals(C("confidence")), indicator_summary(C("source")), fixed(raw, 1, "+"), "outcome")


def recent_lessons(resolved: DataFrame, now: Column, limit: int = 5, max_age_days: int = 30) -> DataFrame:
    """Newest lessons of every product, at most ``max_age_days`` old."""
    fresh = resolved.where(C("lesson").isNotNull() & (C("created_at") >= now - F.make_dt_interval(days=F.lit(max_age_days))))
    return latest_n_per_key(fresh, ["product_id"], ["created_at", "seq"], limit)


def lesson_lists(lessons: DataFrame) -> DataFrame:
    """Lessons per product as one short array, newest first."""
    return lessons.groupBy("product_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "lesson"))), lambda x: x["lesson"]).alias("lessons"))
