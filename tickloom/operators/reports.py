"""Performance, portfolio and model-quality reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col


def _order(columns: Sequence[str]) -> Column:
    return F.struct(*columns)


def _wins() -> Column:
    return F.sum(F.when(C("pnl") > 0, 1).otherwise(0))


def _share(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.coalesce(F.round(F.try_divide(part, whole) * 100, digits), F.lit(0.0))


def monthly_performance(closed: DataFrame, order: Sequence[str], by_agent: bool = False, zero_is_loss: bool = True) -> DataFrame:
    """Per month: counts, P&L, averages and the balance range, opening and closing.

    One hash aggregate; first and last balance by ``min_by``/``max_by`` on the close order.
    """
    keys = (["agent"] if by_agent else []) + ["month"]
    lost = C("pnl") <= 0 if zero_is_loss else C("pnl") < 0
    return (
        closed.withColumn("month", F.date_format("closed_at", "yyyy-MM")).groupBy(*keys).agg(
            F.count("*").alias("trades"),
            _wins().alias("wins"),
            F.sum(F.when(lost, 1).otherwise(0)).alias("losses"),
            F.sum("pnl").alias("total_pnl"),
            F.avg("pct_pnl").alias("avg_pct_pnl"),
            F.avg(F.when(C("pnl") > 0, C("pnl"))).alias("avg_win"),
            F.avg(F.when(lost, C("pnl"))).alias("avg_loss"),
            F.min("balance_after").alias("low_balance"),
            F.max("balance_after").alias("high_balance"),
            F.min_by("balance_after", _order(order)).alias("open_balance"),
            F.max_by("balance_after", _order(order)).alias("close_balance"),
        )
    )


def balance_parts(closed: DataFrame, order: Sequence[str], buckets: Sequence[str], opening: float = 1000.0, zero_is_loss: bool = True, dealt: bool = False) -> DataFrame:
    """Closed trades reduced to one row per agent and bucket: counts, sums and the balance's range, first and last value.

    The trades are dealt once (not at all if they are ``dealt`` by a bucket column); what the reports below join and scan is these rows.
    ``buckets`` start with ``closed_at``.
    """
    from tickloom.operators.blocks import summarized

    won, lost = C("pnl") > 0, (C("pnl") <= 0 if zero_is_loss else C("pnl") < 0)
    at = _order(order)
    rows = summarized(closed, ["agent"], buckets, order, "__run", C("pnl"), {
        "trades": F.count("*"), "wins": F.sum(won.cast("int")), "losses": F.sum(lost.cast("int")), "pnl": F.sum("pnl"),
        "pct": F.sum("pct_pnl"), "n_pct": F.count("pct_pnl"), "won": F.sum(F.when(won, C("pnl"))), "lost": F.sum(F.when(lost, C("pnl"))),
        "low": F.min("__run"), "high": F.max("__run"), "first": F.min_by("__run", at), "last": F.max_by("__run", at), "first_at": F.min(at), "last_at": F.max(at)}, dealt=dealt)
    return rows.withColumns({c: C("__run") + C(c) + opening for c in ("low", "high", "first", "last")}).drop("__run")


def monthly_of_parts(parts: DataFrame, by_agent: bool = False) -> DataFrame:
    """``monthly_performance`` from ``balance_parts``."""
    keys = (["agent"] if by_agent else []) + ["month"]
    return parts.withColumn("month", F.date_format("closed_at", "yyyy-MM")).groupBy(*keys).agg(
        F.sum("trades").alias("trades"), F.sum("wins").alias("wins"), F.sum("losses").alias("losses"), F.sum("pnl").alias("total_pnl"),
        F.try_divide(F.sum("pct"), F.sum("n_pct")).alias("avg_pct_pnl"),
        F.try_divide(F.sum("won"), F.sum("wins")).alias("avg_win"), F.try_divide(F.sum("lost"), F.sum("losses")).alias("avg_loss"),
        F.min("low").alias("low_balance"), F.max("high").alias("high_balance"),
        F.min_by("first", "first_at").alias("open_balance"), F.max_by("last", "last_at").alias("close_balance"))


def trailing_of_parts(parts: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """``trailing_performance`` from ``balance_parts``."""
    recent = parts.where((C("closed_at") >= as_of - F.make_dt_interval(days=F.lit(days))) & (C("closed_at") <= as_of))
    return recent.agg(
        F.coalesce(F.sum("trades"), F.lit(0)).alias("trades"), F.coalesce(F.sum("wins"), F.lit(0)).alias("wins"), F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("total_pnl"),
        F.min_by("first", "first_at").alias("first_balance"), F.max_by("last", "last_at").alias("last_balance"),
    ).withColumns({
        "return_pct": F.when(C("first_balance") > 0, C("total_pnl") / C("first_balance") * 100).otherwise(0.0),
        "win_rate": F.coalesce(F.try_divide(C("wins") * 100.0, C("trades")), F.lit(0.0)),
    })


def overall_of_parts(parts: DataFrame) -> DataFrame:
    """``overall_performance`` from ``balance_parts``."""
    return parts.agg(
        F.coalesce(F.sum("trades"), F.lit(0)).alias("trades"), F.sum("wins").alias("wins"), F.sum("pnl").alias("total_pnl"),
        F.min("low").alias("low_balance"), F.max("high").alias("peak_balance"),
        F.min_by("first", "first_at").alias("first_balance"), F.max_by("last", "last_at").alias("current_balance"))


def monthly_ratios(monthly: DataFrame) -> DataFrame:
    """Win rate in percent, expectancy in currency and return on the opening balance."""
    rate = F.coalesce(F.try_divide(C("wins"), C("wins") + C("losses")), F.lit(0.0))
    gain, loss = F.coalesce("avg_win", F.lit(0.0)), F.coalesce("avg_loss", F.lit(0.0))
    return monthly.withColumns({
        "win_rate": rate * 100,
        "expectancy": rate * gain + (1 - rate) * loss,
        "return_pct": F.when(C("open_balance") > 0, C("total_pnl") / C("open_balance") * 100).otherwise(0.0),
    })


def _span(df: DataFrame, order: Sequence[str]) -> DataFrame:
    return df.agg(
        F.count("*").alias("trades"), F.coalesce(_wins(), F.lit(0)).alias("wins"), F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("total_pnl"),
        F.min_by("balance_after", _order(order)).alias("first_balance"),
        F.max_by("balance_after", _order(order)).alias("last_balance"),
    )


def trailing_performance(closed: DataFrame, as_of: Column, order: Sequence[str], days: int = 30) -> DataFrame:
    """The last ``days`` days: one filtered aggregate, pushed down as a time range."""
    recent = closed.where((C("closed_at") >= as_of - F.make_dt_interval(days=F.lit(days))) & (C("closed_at") <= as_of))
    return _span(recent, order).withColumns({
        "return_pct": F.when(C("first_balance") > 0, C("total_pnl") / C("first_balance") * 100).otherwise(0.0),
        "win_rate": F.coalesce(F.try_divide(C("wins") * 100.0, C("trades")), F.lit(0.0)),
    })


def daily_trailing(closed: DataFrame, days: int = 30) -> DataFrame:
    """Trades, wins and P&L of the trailing window for every agent and day.

    Trades are first reduced to one row per agent and day, so the window runs over days.
    """
    daily = closed.groupBy("agent", F.to_date("closed_at").alias("day")).agg(
        F.count("*").alias("n"), _wins().alias("w"), F.sum("pnl").alias("p"))
    from pyspark.sql import Window

    span = Window.partitionBy("agent").orderBy(F.unix_date("day")).rangeBetween(-(days - 1), 0)
    return daily.select("agent", "day", *[F.sum(s).over(span).alias(n) for s, n in (("n", "trades"), ("w", "wins"), ("p", "total_pnl"))])


def overall_performance(closed: DataFrame, order: Sequence[str]) -> DataFrame:
    return closed.agg(
        F.count("*").alias("trades"), _wins().alias("wins"), F.sum("pnl").alias("total_pnl"),
        F.min("balance_after").alias("low_balance"), F.max("balance_after").alias("peak_balance"),
        F.min_by("balance_after", _order(order)).alias("first_balance"),
        F.max_by("balance_after", _order(order)).alias("current_balance"),
    )


def months_to_goal(balance: Column, monthly_rate: Column, goal: float = 50_000.0, limit: int = 600) -> Column:
    """Months of compounding until a year of monthly gains reaches ``goal``; null if never."""
    raw = F.ceil(F.log(F.try_divide(F.lit(goal), 12 * balance * monthly_rate)) / F.log(1 + monthly_rate))
    months = F.greatest(F.lit(1).cast("long"), raw)
    return F.when((monthly_rate > 0) & (balance > 0), F.when(months < limit, months))


def portfolio_summary(positions: DataFrame) -> DataFrame:
    total = {n: F.coalesce(F.sum(c), F.lit(0.0)) for n, c in (("value", "current_value"), ("cost", "initial_value"), ("pnl", "cash_pnl"))}
    return positions.where(C("size") > 0).agg(F.count("*").alias("positions"), *[c.alias(n) for n, c in total.items()]).withColumn(
        "pnl_pct", F.coalesce(F.try_divide(C("pnl"), C("cost")) * 100, F.lit(0.0)))


def exit_statistics(closed: DataFrame, zero_is_loss: bool = True) -> DataFrame:
    lost = C("pnl") <= 0 if zero_is_loss else C("pnl") < 0
    return closed.groupBy("trigger_close").agg(
        _wins().alias("wins"), F.sum(F.when(lost, 1).otherwise(0)).alias("losses"), F.sum("pnl").alias("total_pnl"),
    ).withColumn("win_rate", _share(C("wins"), C("wins") + C("losses")))


def agent_expectancy(closed: DataFrame) -> DataFrame:
    """Win rate and expectancy in percent terms; zero P&L counts on neither side."""
    up, down = C("pnl") > 0, C("pnl") < 0
    df = closed.groupBy("agent").agg(
        F.sum(up.cast("int")).alias("wins"), F.sum(down.cast("int")).alias("losses"),
        F.avg(F.when(up, C("pct_pnl"))).alias("avg_win_pct"), F.avg(F.when(down, F.abs("pct_pnl"))).alias("avg_loss_pct"),
    )
    rate = F.coalesce(F.try_divide(C("wins"), C("wins") + C("losses")), F.lit(0.0))
    return df.withColumns({
        "win_rate": rate,
        "expectancy_pct": rate * F.coalesce("avg_win_pct", F.lit(0.0)) - (1 - rate) * F.coalesce("avg_loss_pct", F.lit(0.0)),
    })


def scan_checkin(scans: DataFrame, since: Column, prob: str = "model_prob") -> DataFrame:
    return scans.where(C("scanned_at") >= since).agg(
        F.count("*").alias("scans"), F.sum((C(prob) >= 0.5).cast("int")).alias("bullish"),
        F.sum(C("second_prob").isNotNull().cast("int")).alias("second_opinions"),
    )


def histogram(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    out = df.groupBy(column).agg(F.count("*").alias("n"))
    return out if top is None else out.orderBy(F.desc("n"), column).limit(top)


def recent_streak(closed: DataFrame, order: Sequence[str], n: int = 10, since: Column | None = None) -> DataFrame:
    """Wins, losses and P&L of the last ``n`` closed trades (a distributed top-k, then one row)."""
    recent = closed if since is None else closed.where(C("closed_at") >= since)
    last = recent.orderBy(*[F.desc(c) for c in order]).limit(n)
    return last.agg(F.count("*").alias("trades"), _wins().alias("wins"), F.sum((C("pnl") < 0).cast("int")).alias("losses"), F.sum("pnl").alias("total_pnl"))


def win_streaks(closed: DataFrame, keys: Sequence[str], buckets: Sequence[str], order: Sequence[str], dealt: bool = False) -> DataFrame:
    """Longest run of wins per key and its start: islands of an unbroken loss count."""
    from tickloom.operators.blocks import summarized

    keys, won = list(keys), C("pnl") > 0
    df = summarized(closed, keys, buckets, order, "__losses", F.when(won, 0).otherwise(1), {"streak": F.sum(won.cast("int"))}, inside=["__losses"], dealt=dealt)
    islands = df.where(C("streak") > 0).groupBy(*keys, (C("__losses") + C("__in___losses")).alias("__run")).agg(F.sum("streak").alias("streak"))
    return islands.groupBy(*keys).agg(F.max("streak").alias("longest"), F.count("*").alias("runs"))


def volume_share(tickers: DataFrame, prefix: str, symbol: str = "symbol", volume: str = "quote_volume") -> DataFrame:
    """Share of the total volume in symbols with a prefix, in percent; 50 without volume."""
    total = F.sum(volume)
    part = F.sum(F.when(C(symbol).startswith(prefix), C(volume)).otherwise(0.0))
    return tickers.agg(F.when(total > 0, F.try_divide(part, total) * 100).otherwise(50.0).alias("share_pct"))


def nearest_strike_iv(options: DataFrame, spot: str = "spot", keys: Sequence[str] = ("currency",)) -> DataFrame:
    """IV of the call whose strike is nearest the spot price, as a fraction; ties go to the lower strike, then the lower IV."""
    strike = F.try_element_at(F.split("instrument", "-"), F.lit(3)).try_cast("double")
    calls = options.where(C("instrument").endswith("-C") & C("mark_iv").isNotNull()).withColumn("strike", strike)
    return calls.where(C("strike").isNotNull()).groupBy(*keys).agg(
        (F.min_by("mark_iv", F.struct(F.abs(C("strike") - C(spot)), C("strike"), C("mark_iv"))) / 100).alias("atm_iv"))


def regime_metrics(scored: DataFrame, key: str = "regime") -> DataFrame:
    """Per regime: count, accuracy at 0.5, mean log loss (clamped) and positive rate."""
    eps = 1e-12

    def log_of(p: Column) -> Column:
        return F.log(F.greatest(F.least(p, F.lit(1.0 - eps)), F.lit(eps)))

    y, p = C("label"), C("prob")
    loss = -(y * log_of(p) + (1 - y) * log_of(1 - p))
    return scored.groupBy(key).agg(
        F.count("*").alias("n"), F.avg(((p >= 0.5) == (y >= 0.5)).cast("double")).alias("acc"),
        F.avg(loss).alias("loss"), F.avg((y >= 0.5).cast("double")).alias("pos_rate"),
    )


def precision_recall(scored: DataFrame, threshold: float = 0.60) -> DataFrame:
    """Precision and recall of ``prob > threshold``; null where undefined."""
    positive, predicted = C("label") >= 0.5, C("prob") > threshold
    return scored.agg(
        F.sum((positive & predicted).cast("long")).alias("tp"), F.sum(predicted.cast("long")).alias("predicted"), F.sum(positive.cast("long")).alias("positives"),
    ).select(F.try_divide("tp", "predicted").alias("precision"), F.try_divide("tp", "positives").alias("recall"))


def roc_auc(scored: DataFrame, bins: int = 65_536) -> DataFrame:
    """Exact area under the ROC curve with ties counted half.

    Scores are reduced to counts per distinct value; the rank sum needs only running negative
    counts, taken within and across score ranges so that no single task sees all values.
    """
    from tickloom.operators.blocks import running

    counts = scored.groupBy("prob").agg(
        F.sum(F.when(C("label") >= 0.5, 1).otherwise(0)).alias("pos"), F.sum(F.when(C("label") < 0.5, 1).otherwise(0)).alias("neg"))
    cut = counts.withColumns({"__k": F.lit(0), "__b": F.floor(C("prob") * bins)})
    below = running(cut, ["__k"], ["__b"], ["prob"], {"less": ("sum", C("neg"))}, inclusive=False)
    return below.agg(
        F.sum(C("pos") * (C("less") + C("neg") / 2)).alias("u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
    ).select(F.try_divide(C("u"), C("n_pos") * C("n_neg")).alias("auc"), "n_pos", "n_neg")


def fit_status(first_train_loss: Column, train_loss: Column, val_loss: Column) -> Column:
    """UNDERFIT (high loss that barely moved), OVERFIT (validation far above training) or OK."""
    gap = (val_loss - train_loss) / F.greatest(train_loss, F.lit(1e-9))
    return F.when((train_loss > 0.65) & (first_train_loss - train_loss < 0.02), "UNDERFIT").when(gap > 0.20, "OVERFIT").otherwise("OK")


def firing_counters(decided: DataFrame, keys: Sequence[str] = ("agent",)) -> DataFrame:
    return decided.groupBy(*keys).agg(
        F.count("*").alias("scans"), F.sum((C("side") != "HOLD").cast("int")).alias("signals"),
        F.sum((C("side") == "BUY").cast("int")).alias("buys"), F.sum((C("side") == "SELL").cast("int")).alias("sells"),
    )


def label_summary(samples: DataFrame) -> DataFrame:
    return samples.agg(F.count("*").alias("samples"), (F.avg("label") * 100).alias("positive_pct"))
