"""Fills to positions, trades and balances; exits, drawdown limits and order states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import ratio, rounded
from tickloom.operators.alignment import with_scalar
from tickloom.operators.blocks import TICK_BUCKET, running
from tickloom.session import materialize

C = F.col
DAY = 86_400


def average_cost_book(fills: DataFrame, opening: float = 1000.0) -> DataFrame:
    """Positions at average cost over fills ``agent, ts, seq, product_id, side, price, usd``, and each agent's cash.

    A buy of ``usd`` adds ``usd / price`` to the position, a sell closes all of it. The sells of a product cut its fills into episodes, inside
    which size and cost are running sums; nothing else of a position lives on. So three prefix scans give every
    fill's position, profit and the agent's balance, and no agent or product is one task. Buys without a positive price or amount
    and sells of an empty position change nothing and are left out.

    Returns ``agent, ts, seq, product_id, action, size, avg_price, spent, pnl, balance, realized_pnl``; a sell shows the size and average
    price it closes.
    """
    order, minute = ["ts", "seq"], ["__minute"]
    bought = (C("side") == "BUY") & (C("price") > 0) & (C("usd") > 0)
    df = fills.where(bought | (C("side") == "SELL")).withColumn("__minute", F.floor(F.unix_seconds("ts") / TICK_BUCKET))
    df = materialize(running(df, ["agent", "product_id"], minute, order, {"__episode": ("count", F.when(C("side") == "SELL", 1))}, inclusive=False))
    spent = F.when(C("side") == "BUY", C("usd"))
    df = running(df, ["agent", "product_id", "__episode"], minute, order, {"__cost": ("sum", spent), "__size": ("sum", spent / C("price"))})
    df = df.where(C("__size") > 0).withColumn("__pnl", F.when(C("side") == "SELL", C("__size") * C("price") - C("__cost")))
    flow = F.when(C("side") == "SELL", C("__size") * C("price")).otherwise(-C("usd"))
    df = running(materialize(df), ["agent"], minute, order, {"__flow": ("sum", flow), "__realized": ("sum", C("__pnl"))})
    return df.select(
        "agent", "ts", "seq", "product_id", C("side").alias("action"), C("__size").alias("size"), (C("__cost") / C("__size")).alias("avg_price"),
        F.coalesce(spent, F.lit(0.0)).alias("spent"), C("__pnl").alias("pnl"), (C("__flow") + opening).alias("balance"), C("__realized").alias("realized_pnl"))


def pair_trades(events: DataFrame, keys: Sequence[str] = ("agent", "product_id")) -> DataFrame:
    """Open and close events to trades: a close takes the newest open before it that is free.

    ``events``: keys, ``ts, seq, kind`` (OPEN/CLOSE), ``price, size, usd, pnl, trigger, balance``.
    Opens and closes nest like brackets, so the running depth (opens minus closes, floored at
    zero by its running minimum) tells which open a close belongs to; both are prefix scans. A
    close without an open becomes a closed row that opened when, where and as large as it closed, of unknown trigger and without a holding time.
    """
    keys = list(keys)
    order, minute = ["ts", "seq"], F.floor(F.unix_seconds("ts") / TICK_BUCKET)
    step = F.when(C("kind") == "OPEN", 1).otherwise(-1)
    df = materialize(running(events.withColumn("__minute", minute), keys, ["__minute"], order, {"__sum": ("sum", step)}))
    df = running(df, keys, ["__minute"], order, {"__low": ("min", C("__sum"))}, inclusive=False)
    # A close that pushes the running minimum lower meets an empty book.
    low_before = F.least(F.coalesce("__low", F.lit(0)), F.lit(0))
    depth = C("__sum") - F.least(low_before, C("__sum"))
    orphan = (C("kind") == "CLOSE") & (C("__sum") < low_before)
    level = F.when(orphan, F.lit(None)).when(C("kind") == "OPEN", depth).otherwise(depth + 1)
    df = materialize(df.withColumn("__level", level))
    # At one depth opens and closes alternate, so the n-th open pairs with the n-th close.
    df = running(df, [*keys, "__level"], ["__minute"], order, {"__n": ("sum", F.when(C("kind") == "OPEN", 1).otherwise(0))})
    df = df.withColumn("__pair", F.coalesce(F.concat("__level", F.lit("-"), "__n"), F.concat(F.lit("x-"), C("seq").cast("string"))))

    def side(kind: str, column: str) -> Column:
        return F.max(F.when(C("kind") == kind, C(column)))

    trades = df.groupBy(*keys, "__pair").agg(
        side("OPEN", "ts").alias("opened_at"), side("CLOSE", "ts").alias("closed_at"),
        side("OPEN", "price").alias("entry_price"), side("CLOSE", "price").alias("exit_price"),
        F.coalesce(side("OPEN", "size"), side("CLOSE", "size")).alias("size"),
        side("OPEN", "usd").alias("usd_open"), side("CLOSE", "usd").alias("usd_close"), side("CLOSE", "pnl").alias("pnl"),
        F.coalesce(side("OPEN", "trigger"), F.lit("UNKNOWN")).alias("trigger_open"), side("CLOSE", "trigger").alias("trigger_close"),
        F.coalesce(side("CLOSE", "balance"), side("OPEN", "balance")).alias("balance_after"),
        side("OPEN", "seq").alias("open_seq"), side("CLOSE", "seq").alias("close_seq"),
    ).drop("__pair")
    cost = C("usd_close") - C("pnl")
    orphan = C("open_seq").isNull()
    return trades.withColumns({
        "pct_pnl": F.when(cost > 0, C("pnl") / cost * 100).when(C("close_seq").isNotNull(), 0.0),
        "hold_secs": F.unix_seconds("closed_at") - F.unix_seconds("opened_at"),
    }).withColumns({
        own: F.when(orphan, C(other)).otherwise(C(own)) for own, other in (("opened_at", "closed_at"), ("entry_price", "exit_price"), ("usd_open", "usd_close"))
    })


def ghost_trades(open_trades: DataFrame, positions: DataFrame, trade_id: str = "trade_id") -> DataFrame:
    """Open trades to force-close: product not held, or not the newest open row of the product."""
    held = positions.select("product_id").distinct().withColumn("held", F.lit(True))
    newest = open_trades.groupBy("agent", "product_id").agg(F.max(trade_id).alias("__keep"))
    df = open_trades.join(held, "product_id", "left").join(newest, ["agent", "product_id"])
    return df.where(C("held").isNull() | (C(trade_id) != C("__keep"))).drop("held", "__keep").withColumns(
        {"pnl": F.lit(0.0), "trigger_close": F.lit("STARTUP_CLEANUP")})


def average_cost(orders: DataFrame) -> DataFrame:
    """Mean fill price of the filled buys per product."""
    filled = orders.where((C("side") == "BUY") & C("avg_fill_price").isNotNull())
    return filled.groupBy("product_id").agg(
        F.try_divide(F.sum(C("avg_fill_price") * C("filled_size")), F.sum("filled_size")).alias("avg_price"))


STABLE = ("USD", "USDC", "USDT")


def positions_from_balances(accounts: DataFrame, prices: DataFrame, costs: DataFrame) -> DataFrame:
    """Account balances to valued positions; stable coins and empty balances are left out."""
    df = accounts.where(~C("currency").isin(*STABLE)).withColumns({
        "product_id": F.concat("currency", F.lit("-USD")), "size": C("available") + F.coalesce("hold", F.lit(0.0))})
    df = df.where(C("size") > 0).join(prices, "product_id").join(costs, "product_id", "left")
    return valued(df.withColumn("avg_price", F.coalesce("avg_price", "price")))


def valued(positions: DataFrame) -> DataFrame:
    """Initial and current value with P&L in currency and percent."""
    df = positions.withColumns({"initial_value": C("size") * C("avg_price"), "current_value": C("size") * C("price")})
    return df.withColumn("cash_pnl", C("current_value") - C("initial_value")).withColumn(
        "pct_pnl", F.when(C("initial_value") > 0, C("cash_pnl") / C("initial_value") * 100).otherwise(0.0))


def not_corrupt(positions: DataFrame) -> DataFrame:
    return positions.where(F.coalesce("avg_price", F.lit(0.0)) != 0)


def latest_order_state(changes: DataFrame, order: Sequence[str]) -> DataFrame:
    """Order change log to the latest state of every order."""
    payload = F.struct(*[c for c in changes.columns if c != "order_id"])
    return changes.groupBy("order_id").agg(F.max_by(payload, F.struct(*order)).alias("s")).select("order_id", "s.*")


def orders_for_signals(signals: DataFrame, quote_size: Column) -> DataFrame:
    return signals.withColumns({"quote_size": quote_size, "base_size": rounded(ratio(quote_size, C("price")), 8)})


def acted(signals: DataFrame, orders: DataFrame, key: str = "signal_id") -> DataFrame:
    done = orders.select(key).distinct().withColumn("__acted", F.lit(True))
    return signals.join(done, key, "left").withColumn("acted", F.coalesce("__acted", F.lit(False))).drop("__acted")


def preflight(requests: DataFrame, positions: DataFrame, balance: Column, cap: float = 5000.0) -> DataFrame:
    """Reject a request over the balance or the exposure cap (exposure is one aggregated row)."""
    exposure = positions.agg(F.coalesce(F.sum("current_value"), F.lit(0.0)).alias("exposure"))
    df = with_scalar(requests, exposure)
    reason = F.when(balance < C("quote_size"), "insufficient balance").when(C("exposure") + C("quote_size") > cap, "exposure cap")
    return df.withColumn("reject_reason", reason)


# -- exits -----------------------------------------------------------------------------------

def tick_exits(
    ticks: DataFrame, arm_usd: float = 1.0, giveback_usd: float = 0.25, take_profit: float = 0.06,
    default_stop: float = 0.015, sell_threshold: float = 0.55, episode: Sequence[str] = ("episode",),
) -> DataFrame:
    """First tick of each position episode at which an exit rule holds.

    ``ticks``: episode keys, ``ts, seq, price, avg_price, size`` and optionally ``sell_score``
    and ``atr_stop``. Rules in order: sell score, stop, trailing giveback, take profit. The peak
    P&L is a running maximum from zero, a prefix scan over the episode's minutes.
    """
    episode = list(episode)
    score = C("sell_score") if "sell_score" in ticks.columns else F.lit(None).cast("double")
    stop = F.coalesce("atr_stop", F.lit(default_stop)) if "atr_stop" in ticks.columns else F.lit(default_stop)
    df = ticks.withColumns({
        "pnl_usd": (C("price") - C("avg_price")) * C("size"),
        "pct": F.try_divide(C("price") - C("avg_price"), C("avg_price")),
        "__minute": F.floor(F.unix_seconds("ts") / TICK_BUCKET),
    })
    df = running(df, episode, ["__minute"], ["ts", "seq"], {"__peak": ("max", C("pnl_usd"))})
    df = df.withColumn("peak_pnl_usd", F.greatest(F.lit(0.0), "__peak"))
    trigger = (
        F.when(score >= sell_threshold, "TICK_SIGNAL").when(C("pct") < -stop, "TICK_STOP")
        .when((C("peak_pnl_usd") >= arm_usd) & (C("peak_pnl_usd") - C("pnl_usd") >= giveback_usd), "TICK_TRAIL")
        .when(C("pct") > take_profit, "TICK_PROFIT")
    )
    return _first_exit(df.withColumn("trigger", trigger), episode, ["price", "pnl_usd", "peak_pnl_usd", "trigger"])


def scan_exits(
    scans: DataFrame, stop_loss: float = 0.08, max_hold_secs: int = 7 * DAY, min_trail: float = 0.03,
    episode: Sequence[str] = ("episode",),
) -> DataFrame:
    """First scan of each episode at which a risk exit holds: stop, trail from peak, age, legacy.

    ``scans``: episode keys, ``ts, seq, price, avg_price, entry_time`` and optionally ``atr``.
    """
    from tickloom.operators.indicators import atr_trail

    episode = list(episode)
    df = scans.where(C("price") > 0).withColumn("__minute", F.floor(F.unix_seconds("ts") / TICK_BUCKET))
    df = running(df, episode, ["__minute"], ["ts", "seq"], {"__top": ("max", C("price"))})
    df = df.withColumn("peak_price", F.greatest("__top", "avg_price"))
    trail = F.expr(atr_trail("peak_price")) if "atr" in scans.columns else F.lit(min_trail)
    held = F.unix_seconds("ts") - F.unix_seconds("entry_time")
    trigger = (
        F.when(F.try_divide(C("price") - C("avg_price"), C("avg_price")) <= -stop_loss, "STOP_LOSS")
        .when(F.try_divide(C("price") - C("peak_price"), C("peak_price")) <= -trail, "TRAIL_STOP")
        .when(held >= max_hold_secs, "MAX_HOLD")
        .when(C("entry_time").isNull(), "LEGACY_EXIT")
    )
    return _first_exit(df.withColumn("trigger", trigger), episode, ["price", "peak_price", "trigger"])


def _first_exit(df: DataFrame, episode: list[str], columns: list[str]) -> DataFrame:
    found = F.min_by(F.struct("ts", "seq", *columns), F.struct("ts", "seq"))
    return df.where(C("trigger").isNotNull()).groupBy(*episode).agg(found.alias("__x")).select(*episode, "__x.*")


def tick_entries(ticks: DataFrame, threshold: float = 0.55, cap: float = 0.15, keys: Sequence[str] = ("product_id", "score_ts")) -> DataFrame:
    """Entries from cached scan scores: the first tick after a passing score consumes it.

    ``ticks`` carry the scan in force (``score_ts, buy_score``, joined as-of) and ``holding``.
    """
    from tickloom.functions.scoring import kelly_fraction

    live = ticks.where((C("buy_score") >= threshold) & ~C("holding"))
    first = F.min_by(F.struct("ts", "seq", "price", "buy_score"), F.struct("ts", "seq"))
    df = live.groupBy(*keys).agg(first.alias("__x")).select(*keys, "__x.*")
    return df.withColumn("fraction", F.least(kelly_fraction(C("buy_score")), F.lit(cap)))


# -- drawdown --------------------------------------------------------------------------------

def drawdown(balances: DataFrame, daily: float = 0.05, weekly: float = 0.10, keys: Sequence[str] = ("agent",), order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Daily and weekly drawdown against the window's first balance; halted until it ends.

    The baseline of a window is one ``min_by`` per window; the halt flag is a running maximum of
    the breaches inside the window, scanned over minute buckets.
    """
    keys, order = list(keys), list(order)
    df = materialize(balances)
    for name, seconds, limit in (("day", DAY, daily), ("week", 7 * DAY, weekly)):
        slot = f"{name}_slot"
        df = df.withColumn(slot, F.floor(F.unix_seconds("ts") / seconds))
        base = df.groupBy(*keys, slot).agg(F.min_by("balance", F.struct(*order)).alias(f"{name}_start_balance"))
        df = df.join(base, [*keys, slot])
        start = C(f"{name}_start_balance")
        df = materialize(df).withColumn(f"{name}_drawdown", (start - C("balance")) / F.greatest(start, F.lit(1.0)))
        df = df.withColumn("__minute", F.floor(F.unix_seconds("ts") / TICK_BUCKET))
        df = running(df, [*keys, slot], ["__minute"], order, {f"{name}_halted": ("max", C(f"{name}_drawdown") >= limit)})
    halted = C("day_halted") | C("week_halted")
    return df.withColumn("halted", halted).drop("__minute", "day_slot", "week_slot")


def window_elapsed(ts: Column, seconds: int) -> Column:
    """Elapsed share of the tumbling window a time falls in."""
    return (F.unix_seconds(ts) % seconds) / F.lit(float(seconds))
