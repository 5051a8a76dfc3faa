"""Ledger, exit, outcome and report queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import scoring as S
from tickloom.functions.columns import rounded, single
from tickloom.operators import filters, ledger, outcomes, reports, shares, trades
from tickloom.operators import indicators as ind
from tickloom.operators.alignment import asof_scan
from tickloom.operators.blocks import blocked, core_rows
from tickloom.plans import domain, sqlparts as q
from tickloom.plans.indicator_plans import VALUE, base
from tickloom.plans.registry import query
from tickloom.plans.signal_plans import TA_SIGNALS_SQL
from tickloom.session import joins_as_dealt
from tickloom.operators import signals as sig

C = F.col
T, B = q.ticks(), q.bars()
ORDER = domain.TRADE_ORDER
_ORD = "(closed_at, l_orderkey, l_linenumber, l_partkey, l_suppkey)"


def _ts(text: str) -> Column:
    return F.to_timestamp(F.lit(text))


# Means and ratios of decimal amounts can sit exactly between two decimal roundings, where the
# last bit decides; they are reported in single precision instead.
_MEANS = {"avg_pct_pnl", "avg_win", "avg_loss", "win_rate", "expectancy", "return_pct", "expectancy_pct", "avg_price", "share_pct", "pnl_pct", "pct_pnl"}


def _round(df: DataFrame, keep: list[str], *numbers: str, digits: int = 4) -> DataFrame:
    return df.select(*keep, *[
        (C(c).cast("float").cast("double") if c in _MEANS else rounded(C(c), digits)).alias(c) for c in numbers])


def _r(*names: str, digits: int = 4, **exprs: str) -> str:
    return ", ".join(
        (f"({e})::FLOAT::DOUBLE" if n in _MEANS else q.r(e, digits)) + f" AS {n}" for n, e in {**{n: n for n in names}, **exprs}.items())


# -- performance ---------------------------------------------------------------------------

_MONTH = f"""WITH {q.LEDGER}, mo AS (SELECT strftime(closed_at, '%Y-%m') AS month, count(*) AS trades, sum((pnl > 0)::INT)::BIGINT AS wins, sum((pnl <= 0)::INT)::BIGINT AS losses,
 sum(pnl) AS total_pnl, avg(pct_pnl) AS avg_pct_pnl, avg(CASE WHEN pnl > 0 THEN pnl END) AS avg_win, avg(CASE WHEN pnl <= 0 THEN pnl END) AS avg_loss,
 min(balance_after) AS low_balance, max(balance_after) AS high_balance, arg_min(balance_after, {_ORD}) AS open_balance, arg_max(balance_after, {_ORD}) AS close_balance FROM ledger GROUP BY 1)"""
_MONEY = ("total_pnl", "avg_pct_pnl", "avg_win", "avg_loss", "low_balance", "high_balance", "open_balance", "close_balance")


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The month order must not depend on the agent, so ties are broken by the full trade key.
    return reports.monthly_of_parts(domain.ledger_parts(spark, sf_dir))


@query("agg1_monthly_performance", f"{_MONTH} SELECT month, trades, wins, losses, {_r(*_MONEY)} FROM mo")
def monthly_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(monthly(spark, sf_dir), ["month", "trades", "wins", "losses"], *_MONEY)


@query("ind30_agg1_monthly_by_agent", f"WITH {q.LEDGER} SELECT agent, strftime(closed_at, '%Y-%m') AS month, count(*) AS trades, {_r(open_balance=f'arg_min(balance_after, {_ORD})', close_balance=f'arg_max(balance_after, {_ORD})')} FROM ledger GROUP BY 1, 2")
def monthly_by_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = reports.monthly_of_parts(domain.ledger_parts(spark, sf_dir), by_agent=True)
    return _round(df, ["agent", "month", "trades"], "open_balance", "close_balance")


_RATE = "(wins::DOUBLE / (wins + losses))"


@query("agg2_monthly_ratios", f"{_MONTH} SELECT month, {_r(win_rate=f'{_RATE} * 100', expectancy=f'{_RATE} * coalesce(avg_win, 0) + (1 - {_RATE}) * coalesce(avg_loss, 0)', return_pct='CASE WHEN open_balance > 0 THEN total_pnl / open_balance * 100 ELSE 0 END')} FROM mo")
def monthly_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(reports.monthly_ratios(monthly(spark, sf_dir)), ["month"], "win_rate", "expectancy", "return_pct")


_AS_OF = "2001-06-01 00:00:00"
_TRAIL = f"""WITH {q.LEDGER}, t30 AS (SELECT count(*) AS trades, sum((pnl > 0)::INT)::BIGINT AS wins, sum(pnl) AS total_pnl, arg_min(balance_after, {_ORD}) AS first_balance, arg_max(balance_after, {_ORD}) AS last_balance
 FROM ledger WHERE closed_at >= TIMESTAMP '{_AS_OF}' - INTERVAL 30 DAY AND closed_at <= TIMESTAMP '{_AS_OF}')"""


@query("agg3_trailing_30_days", f"{_TRAIL} SELECT trades, wins, {_r('total_pnl', 'first_balance', 'last_balance', return_pct='CASE WHEN first_balance > 0 THEN total_pnl / first_balance * 100 ELSE 0 END', win_rate='wins * 100.0 / trades')} FROM t30")
def trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = reports.trailing_of_parts(domain.ledger_parts(spark, sf_dir), _ts(_AS_OF))
    return _round(df, ["trades", "wins"], "total_pnl", "first_balance", "last_balance", "return_pct", "win_rate")


@query("agg3_trailing_by_day", f"WITH {q.TRADES}, dl AS (SELECT agent, closed_at::DATE AS day, count(*) AS n, sum((pnl > 0)::INT) AS w, sum(pnl) AS p FROM trades GROUP BY 1, 2) "
       f"SELECT agent, strftime(day, '%Y-%m-%d') AS day, (sum(n) OVER v)::BIGINT AS trades, (sum(w) OVER v)::BIGINT AS wins, {_r(total_pnl='sum(p) OVER v')} FROM dl WINDOW v AS (PARTITION BY agent ORDER BY day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)")
def trailing_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = reports.daily_trailing(domain.trades(spark, sf_dir)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    return _round(df, ["agent", "day", "trades", "wins"], "total_pnl")


@query("agg4_overall", f"WITH {q.LEDGER} SELECT count(*) AS trades, sum((pnl > 0)::INT)::BIGINT AS wins, {_r(total_pnl='sum(pnl)', low_balance='min(balance_after)', peak_balance='max(balance_after)', first_balance=f'arg_min(balance_after, {_ORD})', current_balance=f'arg_max(balance_after, {_ORD})')} FROM ledger")
def overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = reports.overall_of_parts(domain.ledger_parts(spark, sf_dir))
    return _round(df, ["trades", "wins"], "total_pnl", "low_balance", "peak_balance", "first_balance", "current_balance")


# Balance and monthly rate per customer: the account balance, and its last two digits as percent.
_GOAL = """WITH RECURSIVE c AS (SELECT c_custkey AS id, c_acctbal AS b, (c_custkey % 21 - 5) / 100.0::DOUBLE AS r FROM customer),
 g AS (SELECT id, b, r, 0 AS n, b AS bal FROM c WHERE r > 0 AND b > 0 UNION ALL SELECT id, b, r, n + 1, bal * (1 + r) FROM g WHERE n < 599 AND (n = 0 OR 12 * bal * r < 50000))
 SELECT c.id, x.m::BIGINT AS months FROM c LEFT JOIN (SELECT id, min(n) AS m FROM g WHERE n >= 1 AND 12 * bal * r >= 50000 GROUP BY 1) x ON c.id = x.id"""


@query("agg5_months_to_goal", _GOAL)
def months_to_goal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = (C("c_custkey") % 21 - 5) / F.lit(100.0)
    df = domain.table(spark, sf_dir, "customer")
    return df.select(C("c_custkey").alias("id"), reports.months_to_goal(C("c_acctbal"), rate).alias("months"))


_POSITIONS = (
    f"{T}, lt AS (SELECT product_id, arg_max(price, (ts, seq)) AS price, avg(price) AS avg_price, sum(volume) AS size FROM ticks GROUP BY 1), "
    "ps AS (SELECT *, size * avg_price AS initial_value, size * price AS current_value, size * price - size * avg_price AS cash_pnl FROM lt)"
)


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A position per product: all volume bought at the mean price, valued at the last."""
    df = domain.ticks(spark, sf_dir, "user_id").groupBy("product_id").agg(
        F.max_by("price", F.struct("ts", "seq")).alias("price"), F.avg("price").alias("avg_price"), F.sum("volume").alias("size"))
    return ledger.valued(df)


_POSITIONS_U = _POSITIONS.replace(T, q.ticks("user_id"))


@query("agg6_portfolio_summary", f"WITH {_POSITIONS_U} SELECT count(*) AS positions, {_r(value='sum(current_value)', cost='sum(initial_value)', pnl='sum(cash_pnl)', pnl_pct='sum(cash_pnl) / sum(initial_value) * 100')} FROM ps WHERE size > 0")
def portfolio_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(reports.portfolio_summary(positions(spark, sf_dir)), ["positions"], "value", "cost", "pnl", "pnl_pct")


@query("pos11_valuation", f"WITH {_POSITIONS_U} SELECT product_id, {_r('initial_value', 'current_value', 'cash_pnl', pct_pnl='CASE WHEN initial_value > 0 THEN cash_pnl / initial_value * 100 ELSE 0 END')} FROM ps")
def valuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(positions(spark, sf_dir), ["product_id"], "initial_value", "current_value", "cash_pnl", "pct_pnl")


@query("fil11_held_positions", f"WITH {_POSITIONS_U} SELECT product_id, {_r('current_value')} FROM ps WHERE size > 0 ORDER BY current_value DESC")
def held_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(filters.held(positions(spark, sf_dir)), ["product_id"], "current_value")


@query("agg12_open_positions", f"WITH {_POSITIONS_U} SELECT product_id, {_r('size', 'avg_price', 'price')} FROM ps WHERE size > 0")
def open_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(positions(spark, sf_dir).where("size > 0"), ["product_id"], "size", "avg_price", "price")


@query("pos8_drop_corrupt", f"WITH {_POSITIONS_U} SELECT product_id, {_r('size')} FROM ps WHERE product_id::BIGINT % 4 <> 0")
def drop_corrupt(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = F.when(C("product_id").cast("long") % 4 != 0, C("avg_price")).otherwise(0.0)
    return _round(ledger.not_corrupt(positions(spark, sf_dir).withColumn("avg_price", damaged)), ["product_id"], "size")


@query("agg7_exit_statistics", f"WITH {q.TRADES} SELECT trigger_close, sum((pnl > 0)::INT)::BIGINT AS wins, sum((pnl <= 0)::INT)::BIGINT AS losses, {_r(total_pnl='sum(pnl)')}, round(sum((pnl > 0)::INT) * 100.0::DOUBLE / count(*), 1) AS win_rate FROM trades GROUP BY 1")
def exit_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(reports.exit_statistics(domain.trades(spark, sf_dir)), ["trigger_close", "wins", "losses", "win_rate"], "total_pnl")


_UP, _DN = "avg(CASE WHEN pnl > 0 THEN pct_pnl END)", "avg(CASE WHEN pnl < 0 THEN abs(pct_pnl) END)"
_WR = "(sum((pnl > 0)::INT)::DOUBLE / sum((pnl <> 0)::INT))"


@query("agg8_agent_expectancy", f"WITH {q.TRADES} SELECT agent, sum((pnl > 0)::INT)::BIGINT AS wins, sum((pnl < 0)::INT)::BIGINT AS losses, {_r(win_rate=_WR, expectancy_pct=f'{_WR} * {_UP} - (1 - {_WR}) * {_DN}')} FROM trades GROUP BY 1")
def agent_expectancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(reports.agent_expectancy(domain.trades(spark, sf_dir)), ["agent", "wins", "losses"], "win_rate", "expectancy_pct")


def scan_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = domain.scans(spark, sf_dir)
    side, _ = S.side_and_strength(C("model_prob"))
    return s.withColumns({"side": side, "second_prob": F.when(C("seq") % 4 == 0, C("model_prob"))})


_SIDE = "CASE WHEN model_prob > 0.60 THEN 'BUY' WHEN model_prob < 0.40 THEN 'SELL' ELSE 'HOLD' END"
_CHECKIN = "TIMESTAMP '2024-01-20 00:00:00'"


@query("agg9_scan_checkin", f"WITH {q.SCANS} SELECT count(*) AS scans, sum((model_prob >= 0.5)::INT)::BIGINT AS bullish, sum((seq % 4 = 0)::INT)::BIGINT AS second_opinions FROM scans WHERE scanned_at >= {_CHECKIN}")
def scan_checkin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.scan_checkin(scan_log(spark, sf_dir), _ts("2024-01-20 00:00:00"))


@query("agg9_scan_histogram", f"WITH {q.SCANS}, x AS (SELECT {_SIDE} AS side FROM scans WHERE scanned_at >= {_CHECKIN}) SELECT side, count(*) AS n FROM x GROUP BY 1 ORDER BY n DESC, side LIMIT 5")
def scan_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.histogram(scan_log(spark, sf_dir).where(C("scanned_at") >= _ts("2024-01-20 00:00:00")), "side", 5)


@query("agg11_recent_streak", f"WITH {q.TRADES}, x AS (SELECT * FROM trades ORDER BY closed_at DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC LIMIT 10) "
       f"SELECT count(*) AS trades, sum((pnl > 0)::INT)::BIGINT AS wins, sum((pnl < 0)::INT)::BIGINT AS losses, {_r(total_pnl='sum(pnl)')} FROM x")
def recent_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(reports.recent_streak(domain.trades(spark, sf_dir), ORDER), ["trades", "wins", "losses"], "total_pnl")


@query("agg11_win_streaks", f"WITH {q.TRADES}, x AS (SELECT agent, pnl, sum((pnl <= 0)::INT) OVER (PARTITION BY agent ORDER BY closed_at, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS g FROM trades), "
       "i AS (SELECT agent, g, count(*) AS n FROM x WHERE pnl > 0 GROUP BY 1, 2) SELECT agent, max(n) AS longest, count(*) AS runs FROM i GROUP BY 1")
def win_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    with joins_as_dealt(spark):
        return reports.win_streaks(domain.dealt_trades(spark, sf_dir), ["agent"], ["closed_at", "__range"], ORDER, dealt=True)


@query("agg13_volume_share", f"SELECT {_r(share_pct='sum(CASE WHEN starts_with(l_returnflag || l_linestatus, chr(82)) THEN l_extendedprice ELSE 0 END) / sum(l_extendedprice) * 100')} FROM lineitem")
def volume_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = domain.table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("symbol"), C("l_extendedprice").alias("quote_volume"))
    return _round(reports.volume_share(t, "R"), [], "share_pct")


@query("agg14_nearest_strike_iv", "WITH o AS (SELECT p_brand AS currency, p_partkey, p_size * 100 AS strike, p_retailprice / 20 AS iv, CASE WHEN p_partkey % 3 = 0 THEN 'P' ELSE 'C' END AS kind FROM part), "
       "x AS (SELECT currency, strike, iv FROM o WHERE kind = 'C' AND iv IS NOT NULL) "
       f"SELECT currency, {_r(atm_iv='arg_min(iv, (abs(strike - 2025), strike, iv)) / 100', digits=6)} FROM x GROUP BY 1")
def nearest_strike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option chain from parts: strikes from sizes, IV from prices, a third of them puts."""
    part = domain.table(spark, sf_dir, "part")
    name = F.concat_ws("-", "p_brand", F.lit("27DEC"), (C("p_size") * 100).cast("string"), F.when(C("p_partkey") % 3 == 0, "P").otherwise("C"))
    chain = part.select(C("p_brand").alias("currency"), name.alias("instrument"), (C("p_retailprice") / 20).alias("mark_iv"), F.lit(2025.0).alias("spot"))
    return _round(reports.nearest_strike_iv(chain), ["currency"], "atm_iv", digits=6)


# -- model quality -------------------------------------------------------------------------

_SCORED = "sc AS (SELECT event_type AS regime, round(value / 500, 3) AS prob, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) >= 50 THEN 1.0 ELSE 0.0 END::DOUBLE AS label FROM events)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.ticks(spark, sf_dir).select(
        C("product_id").alias("regime"), F.round(C("price") / 500, 3).alias("prob"), F.when(C("volume") >= 50, 1.0).otherwise(0.0).alias("label"))


_LL = "-(label * ln(greatest(least(prob, 1 - 1e-12), 1e-12)) + (1 - label) * ln(greatest(least(1 - prob, 1 - 1e-12), 1e-12)))"


@query("agg16_regime_metrics", f"WITH {_SCORED} SELECT regime, count(*) AS n, {_r(acc='avg(((prob >= 0.5) = (label >= 0.5))::INT)', loss=f'avg({_LL})', pos_rate='avg((label >= 0.5)::INT)', digits=6)} FROM sc GROUP BY 1")
def regime_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(reports.regime_metrics(scored(spark, sf_dir)), ["regime", "n"], "acc", "loss", "pos_rate", digits=6)


@query("agg17_precision_recall", f"WITH {_SCORED} SELECT {_r(precision='sum((prob > 0.2 AND label = 1)::INT)::DOUBLE / nullif(sum((prob > 0.2)::INT), 0)', recall='sum((prob > 0.2 AND label = 1)::INT)::DOUBLE / nullif(sum(label), 0)', digits=6)} FROM sc")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(reports.precision_recall(scored(spark, sf_dir), 0.2), [], "precision", "recall", digits=6)


@query("agg18_roc_auc", f"WITH {_SCORED}, rk AS (SELECT label, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0::DOUBLE AS r FROM sc), "
       "s AS (SELECT sum(CASE WHEN label = 1 THEN r END) AS rs, sum(label) AS p, sum(1 - label) AS n FROM rk) "
       f"SELECT {_r(auc='(rs - p * (p + 1) / 2) / (p * n)', digits=6)}, p::BIGINT AS n_pos, n::BIGINT AS n_neg FROM s")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(reports.roc_auc(scored(spark, sf_dir)), ["n_pos", "n_neg"], "auc", digits=6)


@query("agg19_fit_status", "SELECT p_partkey AS run, CASE WHEN p_size / 50.0 > 0.65 AND 0.9 - p_size / 50.0 < 0.02 THEN 'UNDERFIT' WHEN (p_retailprice / 1500 - p_size / 50.0) / (p_size / 50.0) > 0.20 THEN 'OVERFIT' ELSE 'OK' END AS status FROM part")
def fit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training runs from parts: losses from size and price."""
    train, val = C("p_size") / 50.0, C("p_retailprice") / 1500
    return domain.table(spark, sf_dir, "part").select(C("p_partkey").alias("run"), reports.fit_status(F.lit(0.9), train, val).alias("status"))


@query("agg20_firing_counters", f"WITH {q.SCANS}, x AS (SELECT product_id AS agent, {_SIDE} AS side FROM scans) SELECT agent, count(*) AS scans, sum((side <> 'HOLD')::INT)::BIGINT AS signals, sum((side = 'BUY')::INT)::BIGINT AS buys, sum((side = 'SELL')::INT)::BIGINT AS sells FROM x GROUP BY 1")
def firing_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.firing_counters(scan_log(spark, sf_dir).withColumn("agent", C("product_id")))


# -- books and trades ----------------------------------------------------------------------

def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One agent per event type trading ten products; volume decides the side."""
    return fills_of(domain.table(spark, sf_dir, "events"))


def fills_of(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        C("event_type").alias("agent"), C("ts").cast("timestamp").alias("ts"), C("event_id").alias("seq"), (C("user_id") % 10).cast("string").alias("product_id"),
        F.when(k >= 50, "BUY").otherwise("SELL").alias("side"), C("value").alias("price"), F.when(k >= 50, k % 7 * F.lit(20.0)).alias("usd"), F.when(k >= 50, k % 7 / F.lit(20.0)).alias("frac"))


_AMOUNTS = f"""WITH fl AS (SELECT event_type AS agent, ts, event_id AS seq, (user_id % 10)::INT AS p, CAST(json_extract_string(props, '$.k') AS INT) AS k, value AS price FROM events),
 f1 AS (SELECT *, k >= 50 AS buy, CASE WHEN k >= 50 THEN k % 7 * 20.0::DOUBLE END AS usd FROM fl WHERE k < 50 OR (k % 7 > 0 AND price > 0)),
 f2 AS (SELECT *, count(*) FILTER (WHERE NOT buy) OVER (PARTITION BY agent, p ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS episode FROM f1),
 f3 AS (SELECT *, coalesce(sum(usd) OVER w, 0) AS cost, coalesce(sum(usd / price) OVER w, 0) AS size FROM f2 WINDOW w AS (PARTITION BY agent, p, episode ORDER BY ts, seq)),
 f4 AS (SELECT *, CASE WHEN NOT buy THEN size * price - cost END AS pnl, CASE WHEN buy THEN -usd ELSE size * price END AS flow FROM f3 WHERE size > 0)
 SELECT agent, seq, p::VARCHAR AS product_id, CASE WHEN buy THEN 'BUY' ELSE 'SELL' END AS action, {q.r('size')} AS size, {q.r('cost / size')} AS avg_price, {q.r('pnl')} AS pnl,
   {q.r('1000 + sum(flow) OVER g', 4)} AS balance, {q.r('coalesce(sum(pnl) OVER g, 0)', 4)} AS realized_pnl FROM f4 WINDOW g AS (PARTITION BY agent ORDER BY ts, seq)"""


#: Amounts of an agent's state are scaled by 2**-300 whenever its balance passes 1e100; ``e`` counts that.
_W = "CASE WHEN acc.b > 1e100::DOUBLE THEN pow(2::DOUBLE, -300) ELSE 1::DOUBLE END"
_LN_E = "(acc.e + CASE WHEN acc.b > 1e100::DOUBLE THEN 300 ELSE 0 END) * ln(2::DOUBLE)"
_OPEN = "(acc.b * least(e.frac, 0.95::DOUBLE) > 0 AND ln(acc.b * least(e.frac, 0.95::DOUBLE)) + acc.e * ln(2::DOUBLE) >= 0)"
_SPENT, _SIZE, _COST, _CASH, _WON = f"(acc.b * ({_W}) * least(e.frac, 0.95::DOUBLE))", f"(acc.z[e.p + 1] * ({_W}))", f"(acc.c[e.p + 1] * ({_W}))", f"(acc.b * ({_W}))", f"(acc.r * ({_W}))"


def _held(field: str, changed: str) -> str:
    return f"list_transform(range(10), lambda i: CASE WHEN i = e.p THEN {changed} ELSE acc.{field}[i + 1] * ({_W}) END)"


def _shown(action: str, size: str, cost: str, spent: str, gain: str, cash: str, won: str) -> str:
    """A row of the result: the position, what was spent or gained, and the agent's cash behind it."""
    return (f"{{'seq': e.seq, 'p': e.p, 'x': '{action}', 'z': ln({size}) + {_LN_E}, 'v': {cost} / {size}, 'u': {spent}, 'g': {gain}, 'b': ln({cash}) + {_LN_E}, 'r': {won} / {cash}}}")


_BOOK = f"""WITH fl AS (SELECT event_type AS agent, ts, event_id AS seq, (user_id % 10)::INT AS p, CAST(json_extract_string(props, '$.k') AS INT) AS k, value AS price FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL),
 fs AS (SELECT agent, list({{'seq': seq, 'p': p, 'buy': k >= 50, 'price': price, 'frac': (k % 7 / 20.0)::DOUBLE}} ORDER BY ts, seq) AS es FROM fl GROUP BY 1),
 fd AS (SELECT agent, list_reduce(es, lambda acc, e:
   CASE WHEN e.buy AND e.price > 0 AND {_OPEN} THEN {{'b': {_CASH} - {_SPENT}, 'r': {_WON}, 'e': acc.e + CASE WHEN acc.b > 1e100::DOUBLE THEN 300 ELSE 0 END,
      'z': {_held('z', f'{_SIZE} + {_SPENT} / e.price')}, 'c': {_held('c', f'{_COST} + {_SPENT}')},
      'o': list_append(acc.o, {_shown('BUY', f'({_SIZE} + {_SPENT} / e.price)', f'({_COST} + {_SPENT})', f'ln({_SPENT}) + {_LN_E}', 'NULL::DOUBLE', f'({_CASH} - {_SPENT})', _WON)})}}
   WHEN NOT e.buy AND acc.z[e.p + 1] > 0 THEN {{'b': {_CASH} + {_SIZE} * e.price, 'r': {_WON} + ({_SIZE} * e.price - {_COST}), 'e': acc.e + CASE WHEN acc.b > 1e100::DOUBLE THEN 300 ELSE 0 END,
      'z': {_held('z', '0.0::DOUBLE')}, 'c': {_held('c', '0.0::DOUBLE')},
      'o': list_append(acc.o, {_shown('SELL', _SIZE, _COST, 'NULL::DOUBLE', f'{_SIZE} * e.price / {_COST} - 1', f'({_CASH} + {_SIZE} * e.price)', f'({_WON} + ({_SIZE} * e.price - {_COST}))')})}}
   ELSE acc END,
   {{'b': 1000.0::DOUBLE, 'r': 0.0::DOUBLE, 'e': 0::INT, 'z': list_transform(range(10), lambda i: 0.0::DOUBLE), 'c': list_transform(range(10), lambda i: 0.0::DOUBLE),
     'o': []::STRUCT(seq BIGINT, p INT, x VARCHAR, z DOUBLE, v DOUBLE, u DOUBLE, g DOUBLE, b DOUBLE, r DOUBLE)[]}}).o AS o FROM fs),
 un AS (SELECT agent, unnest(o) AS u FROM fd)
 SELECT agent, u.seq AS seq, u.p::VARCHAR AS product_id, u.x AS action, {q.r('u.z')} AS log_size, {q.r('u.v')} AS avg_price, {q.r('u.u')} AS log_spent, {q.single('u.g')} AS gain,
   {q.r('u.b')} AS log_balance, {q.r('u.r')} AS realized_share FROM un"""


def book_columns(df: DataFrame) -> DataFrame:
    """Rounded for comparison; ratios of two prices often lie between two roundings of six decimals."""
    known = {c: F.nanvl(c, F.lit(None).cast("double")) for c in ("log_size", "avg_price", "log_spent", "gain", "log_balance", "realized_share")}
    return df.select("agent", "seq", "product_id", "action", *[(single(v) if c == "gain" else rounded(v)).alias(c) for c, v in known.items()])


@query("pos1_average_cost_book", _BOOK)
def share_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buys spend a share of the agent's cash of the moment, so all fills of an agent depend on each other."""
    df = shares.share_book(fills(spark, sf_dir))
    return book_columns(df)


@query("pos1_fixed_amounts", _AMOUNTS)
def average_cost_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ledger.average_cost_book(fills(spark, sf_dir))
    return df.select(
        "agent", "seq", "product_id", "action", *[rounded(C(c)).alias(c) for c in ("size", "avg_price", "pnl")],
        rounded(C("balance"), 4).alias("balance"), rounded(F.coalesce("realized_pnl", F.lit(0.0)), 4).alias("realized_pnl"))


# Open and close events from ticks: every tick opens or closes a trade of its user.
_EVENTS = f"{q.ticks('user_id')}, ev AS (SELECT CASE WHEN seq % 2 = 0 THEN 'A' ELSE 'B' END AS agent, product_id, ts, s, seq, CASE WHEN volume < 55 THEN 'OPEN' ELSE 'CLOSE' END AS kind, price FROM ticks)"
_PAIR = f"""WITH {_EVENTS}, gs AS (SELECT agent, product_id, list({{'seq': seq, 'open': kind = 'OPEN'}} ORDER BY ts, seq) AS es FROM ev GROUP BY 1, 2),
 fd AS (SELECT agent, product_id, list_reduce(es, lambda acc, e:
   CASE WHEN e.open THEN {{'st': list_append(acc.st, e.seq), 'o': acc.o}}
   WHEN len(acc.st) > 0 THEN {{'st': acc.st[:-2], 'o': list_append(acc.o, {{'a': acc.st[-1], 'z': e.seq}})}}
   ELSE {{'st': acc.st, 'o': list_append(acc.o, {{'a': NULL::BIGINT, 'z': e.seq}})}} END,
   {{'st': []::BIGINT[], 'o': []::STRUCT(a BIGINT, z BIGINT)[]}}) AS f FROM gs),
 pr AS (SELECT agent, product_id, u.a AS open_seq, u.z AS close_seq FROM (SELECT agent, product_id, unnest(f.o) AS u FROM fd) UNION ALL SELECT agent, product_id, unnest(f.st), NULL FROM fd)"""


def trade_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = domain.ticks(spark, sf_dir, "user_id")
    return t.select(
        F.when(C("seq") % 2 == 0, "A").otherwise("B").alias("agent"), "product_id", "ts", "seq", F.when(C("volume") < 55, "OPEN").otherwise("CLOSE").alias("kind"),
        "price", F.lit(1.0).alias("size"), C("price").alias("usd"), (C("price") - 50).alias("pnl"),
        F.lit("SCAN").alias("trigger"), C("price").alias("balance"))


@query("pos2_pos3_pair_trades", f"{_PAIR} SELECT p.agent, p.product_id, p.open_seq, p.close_seq, coalesce(a.price, z.price) AS entry_price, z.price AS exit_price, z.s - a.s AS hold_secs, CASE WHEN p.open_seq IS NULL THEN 'UNKNOWN' ELSE 'SCAN' END AS trigger_open, "
       f"{q.r('(z.price - 50) / nullif(z.price - (z.price - 50), 0) * 100')} AS pct_pnl FROM pr p LEFT JOIN ev a ON p.open_seq = a.seq LEFT JOIN ev z ON p.close_seq = z.seq")
def pair_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ledger.pair_trades(trade_events(spark, sf_dir))
    return df.select("agent", "product_id", "open_seq", "close_seq", "entry_price", "exit_price", "hold_secs", "trigger_open", rounded(C("pct_pnl")).alias("pct_pnl"))


@query("join10_pos4_ghost_trades", f"WITH {q.ticks('user_id')}, op AS (SELECT seq AS trade_id, CASE WHEN seq % 2 = 0 THEN 'A' ELSE 'B' END AS agent, product_id FROM ticks WHERE volume >= 80) "
       "SELECT trade_id, agent, product_id, 0.0::DOUBLE AS pnl, 'STARTUP_CLEANUP' AS trigger_close FROM op WHERE product_id::BIGINT % 3 = 0 OR trade_id <> (SELECT max(trade_id) FROM op o WHERE o.agent = op.agent AND o.product_id = op.product_id)")
def ghost_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = domain.ticks(spark, sf_dir, "user_id")
    open_ = t.where("volume >= 80").select(C("seq").alias("trade_id"), F.when(C("seq") % 2 == 0, "A").otherwise("B").alias("agent"), "product_id")
    held = t.select("product_id").distinct().where(C("product_id").cast("long") % 3 != 0)
    return ledger.ghost_trades(open_, held).select("trade_id", "agent", "product_id", "pnl", "trigger_close")


@query("join11_average_cost", f"SELECT l_partkey AS product_id, {_r(avg_price='sum(l_extendedprice / l_quantity * l_quantity) / sum(l_quantity)')} FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1")
def average_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = domain.table(spark, sf_dir, "lineitem").select(
        C("l_partkey").alias("product_id"), F.when(C("l_returnflag") == "N", "BUY").otherwise("SELL").alias("side"),
        (C("l_extendedprice") / C("l_quantity")).alias("avg_fill_price"), C("l_quantity").alias("filled_size"))
    return _round(ledger.average_cost(o), ["product_id"], "avg_price")


@query("join12_positions_from_balances", "WITH ac AS (SELECT CASE WHEN c_custkey % 50 = 0 THEN 'USDC' ELSE 'C' || c_custkey END AS currency, greatest(c_acctbal, 0) AS available, CASE WHEN c_custkey % 2 = 0 THEN 5.0 END AS hold FROM customer), "
       "pr AS (SELECT 'C' || p_partkey || '-USD' AS product_id, p_retailprice AS price FROM part), ps AS (SELECT currency || '-USD' AS product_id, available + coalesce(hold, 0) AS size FROM ac WHERE currency <> 'USDC'), "
       "co AS (SELECT 'C' || l_partkey || '-USD' AS product_id, sum(l_extendedprice) / sum(l_quantity) AS avg_price FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) "
       f"SELECT ps.product_id, {_r('size', current_value='size * price', cash_pnl='size * price - size * coalesce(avg_price, price)')} FROM ps JOIN pr ON ps.product_id = pr.product_id LEFT JOIN co ON ps.product_id = co.product_id WHERE size > 0")
def positions_from_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    accounts = domain.table(spark, sf_dir, "customer").select(
        F.when(C("c_custkey") % 50 == 0, "USDC").otherwise(F.concat(F.lit("C"), C("c_custkey").cast("string"))).alias("currency"),
        F.greatest(C("c_acctbal"), F.lit(0.0)).alias("available"), F.when(C("c_custkey") % 2 == 0, 5.0).alias("hold"))
    prices = domain.table(spark, sf_dir, "part").select(F.concat(F.lit("C"), C("p_partkey").cast("string"), F.lit("-USD")).alias("product_id"), C("p_retailprice").alias("price"))
    fills = domain.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("C"), C("l_partkey").cast("string"), F.lit("-USD")).alias("product_id"), F.when(C("l_returnflag") == "N", "BUY").otherwise("SELL").alias("side"),
        (C("l_extendedprice") / C("l_quantity")).alias("avg_fill_price"), C("l_quantity").alias("filled_size"))
    costs = ledger.average_cost(fills)
    return _round(ledger.positions_from_balances(accounts, prices, costs), ["product_id"], "size", "current_value", "cash_pnl")


@query("pos13_latest_order_state", "SELECT l_orderkey AS order_id, arg_max(l_linestatus, (l_shipdate, l_linenumber, l_partkey, l_suppkey)) AS status, arg_max(l_quantity, (l_shipdate, l_linenumber, l_partkey, l_suppkey)) AS filled FROM lineitem GROUP BY 1")
def latest_order_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = domain.table(spark, sf_dir, "lineitem").select(
        C("l_orderkey").alias("order_id"), C("l_linestatus").alias("status"), C("l_quantity").alias("filled"), "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    return ledger.latest_order_state(log, ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"]).select("order_id", "status", "filled")


@query("pos12_orders_for_signals", f"WITH {T} SELECT seq AS signal_id, {q.r('100 / price', 8)} AS base_size, seq % 5 = 0 AS acted FROM ticks")
def orders_for_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = domain.ticks(spark, sf_dir).withColumnRenamed("seq", "signal_id")
    placed = t.where("signal_id % 5 = 0").select("signal_id")
    df = ledger.acted(ledger.orders_for_signals(t, F.lit(100.0)), placed)
    return df.select("signal_id", "base_size", "acted")


@query("sig21_preflight", "WITH x AS (SELECT sum(l_extendedprice / 1e6) AS e FROM lineitem) SELECT o_orderkey AS id, CASE WHEN 400000 < o_totalprice THEN 'insufficient balance' WHEN e + o_totalprice > 5000 THEN 'exposure cap' END AS reject_reason FROM orders, x")
def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals against a balance and an exposure cap."""
    requests = domain.table(spark, sf_dir, "orders").select(C("o_orderkey").alias("id"), C("o_totalprice").alias("quote_size"))
    held = domain.table(spark, sf_dir, "lineitem").select((C("l_extendedprice") / 1e6).alias("current_value"))
    return ledger.preflight(requests, held, F.lit(400_000.0), 5_000.0).select("id", "reject_reason")


# -- exits ---------------------------------------------------------------------------------

# Episodes: each product's day is one position, entered at the day's first tick.
_EPI = f"{T}, en AS (SELECT product_id, s // 86400 AS day, arg_min(price, (ts, seq)) AS avg_price, min(ts) AS entry_time FROM ticks GROUP BY 1, 2), ep AS (SELECT t.*, day, avg_price, entry_time FROM ticks t JOIN en ON t.product_id = en.product_id AND t.s // 86400 = en.day)"


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = domain.ticks(spark, sf_dir).withColumn("day", F.floor(F.unix_seconds("ts") / 86400))
    entry = t.groupBy("product_id", "day").agg(F.min_by("price", F.struct("ts", "seq")).alias("avg_price"), F.min("ts").alias("entry_time"))
    return t.join(entry, ["product_id", "day"])


@query("pos5_tick_exits", f"WITH {_EPI}, pk AS (SELECT *, (price - avg_price) * 0.1 AS pnl_usd, (price - avg_price) / avg_price AS pct, greatest(0, max((price - avg_price) * 0.1) OVER (PARTITION BY product_id, day ORDER BY ts, seq)) AS peak FROM ep), "
       "tg AS (SELECT *, CASE WHEN pct < -0.3 THEN 'TICK_STOP' WHEN peak >= 1 AND peak - pnl_usd >= 0.25 THEN 'TICK_TRAIL' WHEN pct > 0.06 THEN 'TICK_PROFIT' END AS trigger FROM pk) "
       f"SELECT product_id, day, arg_min(seq, (ts, seq)) AS seq, arg_min(trigger, (ts, seq)) AS trigger, {_r(peak_pnl_usd='arg_min(peak, (ts, seq))')} FROM tg WHERE trigger IS NOT NULL GROUP BY 1, 2")
def tick_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = episodes(spark, sf_dir).withColumn("size", F.lit(0.1))
    out = ledger.tick_exits(df, default_stop=0.3, episode=["product_id", "day"])
    return _round(out, ["product_id", "day", "seq", "trigger"], "peak_pnl_usd")


@query("pos7_scan_exits", f"WITH {_EPI}, pk AS (SELECT *, greatest(avg_price, max(price) OVER (PARTITION BY product_id, day ORDER BY ts, seq)) AS peak FROM ep), "
       "tg AS (SELECT *, CASE WHEN (price - avg_price) / avg_price <= -0.9 THEN 'STOP_LOSS' WHEN (price - peak) / peak <= -0.95 THEN 'TRAIL_STOP' WHEN s - epoch_us(entry_time) // 1000000 >= 28800 THEN 'MAX_HOLD' END AS trigger FROM pk) "
       f"SELECT product_id, day, arg_min(seq, (ts, seq)) AS seq, arg_min(trigger, (ts, seq)) AS trigger, {_r(peak_price='arg_min(peak, (ts, seq))')} FROM tg WHERE trigger IS NOT NULL GROUP BY 1, 2")
def scan_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ledger.scan_exits(episodes(spark, sf_dir), 0.9, 28_800, 0.95, ["product_id", "day"])
    return _round(out, ["product_id", "day", "seq", "trigger"], "peak_price")


@query("ind25_atr_trail", f"{base(20)} SELECT product_id, start, {q.cols(atr_trail=f'CASE WHEN ({VALUE['atr']}) > 0 THEN least(0.15, greatest(0.03, ({VALUE['atr']}) * 2 / (close * 1.1))) ELSE 0.03 END')} FROM k")
def atr_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing distance from a peak ten percent above the close, ATR over the last 20 bars."""
    df = core_rows(ind.with_indicators(blocked(domain.bars(spark, sf_dir), 19), [ind.atr(20)])).withColumn("peak", C("close") * 1.1)
    return df.select("product_id", F.unix_seconds("start").alias("start"), rounded(F.expr(ind.atr_trail("peak"))).alias("atr_trail"))


@query("pos6_tick_entries", f"WITH {T}, sc AS (SELECT product_id, ts AS score_ts, volume / 100 AS buy_score, seq AS sq FROM ticks WHERE seq % 3 = 0), tk AS (SELECT * FROM ticks WHERE seq % 3 <> 0), "
       "j AS (SELECT tk.*, sc.score_ts, sc.buy_score FROM tk ASOF JOIN sc ON tk.product_id = sc.product_id AND tk.ts >= sc.score_ts) "
       f"SELECT product_id, min(seq) AS seq, {_r(buy_score='min(buy_score)', fraction='least(0.15, least(0.25, greatest(0, 2 * min(buy_score) - 1)))')} FROM (SELECT * FROM j WHERE buy_score >= 0.55 AND seq % 7 >= 3 QUALIFY row_number() OVER (PARTITION BY product_id, score_ts ORDER BY ts, seq) = 1) GROUP BY product_id, score_ts")
def tick_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = domain.ticks(spark, sf_dir)
    scores = t.where("seq % 3 = 0").select("product_id", C("ts").alias("score_ts"), (C("volume") / 100).alias("buy_score"))
    live = asof_scan(t.where("seq % 3 <> 0"), scores, ["product_id"], "ts", "score_ts", ["buy_score"])
    live = live.withColumnRenamed("score_ts_matched", "score_ts").withColumn("holding", C("seq") % 7 < 3)
    return _round(ledger.tick_entries(live), ["product_id", "seq"], "buy_score", "fraction")


def _trades_sql(stop: str) -> str:
    """The trader as a fold over each product's ticks; ``stop`` is the scan's stop distance."""
    gain = "((e.p - acc.a) * acc.z)"
    peak = f"greatest(acc.k, {gain})"
    return f"""WITH {T}, gs AS (SELECT product_id, list({{'seq': seq, 'scan': seq % 3 = 0, 'p': price, 'v': volume / 100, 'st': {stop}}} ORDER BY ts, seq) AS es FROM ticks GROUP BY 1),
 fd AS (SELECT product_id, list_reduce(es, lambda acc, e:
   CASE WHEN e.scan THEN {{'z': acc.z, 'a': acc.a, 'k': acc.k, 'b': e.v, 's': 1 - e.v, 'n': e.st, 'd': acc.d, 'o': acc.o}}
   WHEN acc.z = 0 AND acc.b >= 0.55 AND e.p > 0 THEN {{'z': 100.0 / e.p, 'a': e.p, 'k': 0.0::DOUBLE, 'b': 0.0::DOUBLE, 's': acc.s, 'n': acc.n, 'd': acc.n, 'o': list_append(acc.o, {{'seq': e.seq, 't': 'TICK_SIGNAL', 'x': 'BUY'}})}}
   WHEN acc.z = 0 THEN acc
   WHEN acc.s >= 0.55 OR (e.p - acc.a) / acc.a < -acc.d OR ({peak} >= 1 AND {peak} - {gain} >= 0.25) OR (e.p - acc.a) / acc.a > 0.06
     THEN {{'z': 0.0::DOUBLE, 'a': acc.a, 'k': acc.k, 'b': 0.0::DOUBLE, 's': 0.0::DOUBLE, 'n': acc.n, 'd': acc.d, 'o': list_append(acc.o, {{'seq': e.seq, 't':
       CASE WHEN acc.s >= 0.55 THEN 'TICK_SIGNAL' WHEN (e.p - acc.a) / acc.a < -acc.d THEN 'TICK_STOP'
            WHEN {peak} >= 1 AND {peak} - {gain} >= 0.25 THEN 'TICK_TRAIL' ELSE 'TICK_PROFIT' END, 'x': 'SELL'}})}}
   ELSE {{'z': acc.z, 'a': acc.a, 'k': {peak}, 'b': acc.b, 's': acc.s, 'n': acc.n, 'd': acc.d, 'o': acc.o}} END,
   {{'z': 0.0::DOUBLE, 'a': 0.0::DOUBLE, 'k': 0.0::DOUBLE, 'b': 0.0::DOUBLE, 's': 0.0::DOUBLE, 'n': 0.0::DOUBLE, 'd': 0.0::DOUBLE, 'o': []::STRUCT(seq BIGINT, t VARCHAR, x VARCHAR)[]}}).o AS o FROM gs)
 SELECT product_id, u.seq AS seq, u.x AS action, u.t AS trigger FROM (SELECT product_id, unnest(o) AS u FROM fd)"""


def _actions(found: DataFrame) -> DataFrame:
    """Entries and exits as rows of their own."""
    entry = F.struct(C("entry_seq").alias("seq"), F.lit("BUY").alias("action"), F.lit("TICK_SIGNAL").alias("trigger"))
    exit_ = F.struct(C("exit_seq").alias("seq"), F.lit("SELL").alias("action"), "trigger")
    return found.select("product_id", F.inline(F.array(entry, exit_))).where(C("seq").isNotNull())


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third tick is a scan with scores, the others trade."""
    scan = C("seq") % 3 == 0
    return domain.ticks(spark, sf_dir).withColumns({"buy_score": F.when(scan, C("volume") / 100), "sell_score": F.when(scan, 1 - C("volume") / 100)})


@query("pos5_pos6_tick_trades", _trades_sql("0.015::DOUBLE"))
def tick_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries and exits of all products: sell score, stop, giveback and profit with one common stop."""
    return _actions(trades.tick_trades(_scanned(spark, sf_dir)))


@query("pos5_pos6_atr_stops", _trades_sql("CASE WHEN volume >= 60 THEN (0.02 + volume % 10 / 50)::DOUBLE ELSE 0.015::DOUBLE END"))
def atr_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a stop of its own for every entry; scans without one leave the default."""
    stop = F.when(C("volume") >= 60, 0.02 + C("volume") % 10 / 50)
    return _actions(trades.tick_trades(_scanned(spark, sf_dir).withColumn("atr_stop", stop)))


_BAL = f"{T}, bl AS (SELECT product_id AS agent, ts, s, seq, 900 + price AS balance FROM ticks)"


@query("pos9_drawdown", f"WITH {_BAL}, b2 AS (SELECT *, arg_min(balance, (ts, seq)) OVER (PARTITION BY agent, s // 86400) AS d0, arg_min(balance, (ts, seq)) OVER (PARTITION BY agent, s // 604800) AS w0 FROM bl), "
       "b3 AS (SELECT *, (d0 - balance) / greatest(d0, 1) AS dd, (w0 - balance) / greatest(w0, 1) AS wd FROM b2) "
       f"SELECT agent, seq, {_r(day_drawdown='dd', week_drawdown='wd', digits=6)}, bool_or(dd >= 0.05) OVER (PARTITION BY agent, s // 86400 ORDER BY ts, seq) OR bool_or(wd >= 0.10) OVER (PARTITION BY agent, s // 604800 ORDER BY ts, seq) AS halted FROM b3")
def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = domain.ticks(spark, sf_dir).select(C("product_id").alias("agent"), "ts", "seq", (C("price") + 900).alias("balance"))
    return _round(ledger.drawdown(df), ["agent", "seq", "halted"], "day_drawdown", "week_drawdown", digits=6)


@query("pos10_window_elapsed", f"WITH {T} SELECT seq, {q.r('(s % 86400) / 86400.0', 9)} AS day_elapsed, {q.r('(s % 604800) / 604800.0', 9)} AS week_elapsed FROM ticks")
def window_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = domain.ticks(spark, sf_dir)
    return t.select("seq", rounded(ledger.window_elapsed(C("ts"), 86400), 9).alias("day_elapsed"), rounded(ledger.window_elapsed(C("ts"), 604800), 9).alias("week_elapsed"))


# -- outcomes ------------------------------------------------------------------------------

def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pending outcome per technical signal."""
    s = sig.ta_signals(domain.bars(spark, sf_dir))
    numbers = F.create_map(F.lit("rsi"), C("rsi").cast("string"), F.lit("bb_pos"), C("bb_pos").cast("string"), F.lit("macd_h"), C("macd_hist").cast("string"))
    return outcomes.record(s.select(
        F.lit("TECH").alias("source"), "product_id", "side", C("strength").alias("confidence"), C("close").alias("price"),
        (C("start") + F.expr("interval 1 hour")).alias("created_at"), C("idx").alias("seq"), numbers.alias("indicators")))


_PEND = TA_SIGNALS_SQL + ", pd AS (SELECT product_id, side, round(strength, 4) AS confidence, close AS entry, start + 3600 AS created, start + 3600 + 14400 AS check_after, idx, rsi, bb_pos, macd_hist FROM ta WHERE strength >= 0.20)"
_RESOLVE = _PEND + (
    ", rs AS (SELECT pd.*, b.close AS exit_price, (b.close - entry) / greatest(entry, 1e-9) AS raw FROM pd ASOF JOIN bars b ON pd.product_id = b.product_id AND pd.check_after - 3600 >= b.start), "
    "ou AS (SELECT *, CASE WHEN side = 'SELL' THEN -raw ELSE raw END AS chg FROM rs), "
    "oc AS (SELECT *, CASE WHEN chg > 0.005 THEN 'WIN' WHEN chg < -0.005 THEN 'LOSS' ELSE 'NEUTRAL' END AS outcome FROM ou)"
)


@query("out1_record_outcomes", f"{_PEND} SELECT product_id, idx, {q.cols(confidence='confidence', entry_price='entry')}, check_after FROM pd")
def record_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pending(spark, sf_dir)
    return df.select("product_id", C("seq").alias("idx"), rounded(C("confidence")).alias("confidence"), rounded(C("entry_price")).alias("entry_price"), F.unix_seconds("check_after").alias("check_after"))


@query("out2_join13_resolve_outcomes", f"{_RESOLVE} SELECT product_id, idx, side, {q.cols(exit_price='exit_price', pct_change='chg')}, outcome FROM oc")
def resolve_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = outcomes.resolve(pending(spark, sf_dir), domain.bars(spark, sf_dir))
    return df.select("product_id", C("seq").alias("idx"), "side", rounded(C("exit_price")).alias("exit_price"), rounded(C("pct_change")).alias("pct_change"), "outcome")


_LESSON = "'TECH ' || side || ' conf=' || printf('%.2f', confidence) || ' RSI=' || printf('%.0f', rsi) || ' BB=' || printf('%.2f', bb_pos) || ' MACD=' || CASE WHEN macd_hist > 0 THEN 'bull' ELSE 'bear' END || ' → ' || printf('%+.1f', raw * 100) || '% after 4h [' || outcome || ']'"


@query("out3_lesson_text", f"{_RESOLVE} SELECT product_id, idx, {_LESSON} AS lesson FROM oc")
def lesson_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.resolve(pending(spark, sf_dir), domain.bars(spark, sf_dir)).select("product_id", C("seq").alias("idx"), "lesson")


@query("fil12_pending_outcomes", f"{_PEND} SELECT product_id, idx FROM pd WHERE check_after <= 1705000000 ORDER BY check_after, idx")
def pending_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pending(spark, sf_dir).withColumn("outcome", F.lit(None).cast("string"))
    return filters.pending_outcomes(df, F.timestamp_seconds(F.lit(1705000000))).select("product_id", C("seq").alias("idx"))


@query("fil13_out4_recent_lessons", f"{_RESOLVE} SELECT product_id, idx, row_number() OVER (PARTITION BY product_id ORDER BY created DESC, idx DESC)::INT AS rank, outcome FROM oc WHERE created >= 1706659200 - 30 * 86400 QUALIFY rank <= 5")
def recent_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = outcomes.resolve(pending(spark, sf_dir), domain.bars(spark, sf_dir))
    return outcomes.recent_lessons(df, F.timestamp_seconds(F.lit(1706659200))).select("product_id", C("seq").alias("idx"), "rank", "outcome")


@query("agg10_outcome_histogram", f"{_RESOLVE} SELECT outcome, count(*) AS n FROM oc WHERE created >= 1705000000 GROUP BY 1")
def outcome_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = outcomes.resolve(pending(spark, sf_dir), domain.bars(spark, sf_dir))
    return reports.histogram(df.where(F.unix_seconds("created_at") >= 1705000000), "outcome")
