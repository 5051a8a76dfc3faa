"""Indicator queries over hourly bars of the tick table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.columns import rounded
from tickloom.operators import indicators as ind
from tickloom.operators.blocks import blocked, core_rows
from tickloom.operators.layers import Indicator
from tickloom.operators.nested import NESTED, nested_indicators
from tickloom.plans import domain, sqlparts as q
from tickloom.plans.registry import query

LOOKBACK = 100
_L = LOOKBACK


def report(df: DataFrame, columns: list[str], *passed: str) -> DataFrame:
    """Report edge: epoch-second start and rounded values."""
    return df.select(
        "product_id", F.unix_seconds("start").alias("start"), *passed,
        *[rounded(F.col(c)).alias(c) for c in columns],
    )


def _mean(n: int) -> str:
    return q.over("avg(close)", n)


def slope_sql(values: str, n: int) -> str:
    """OLS slope of a list of n values against 0..n-1."""
    mid, den = (n - 1) / 2, sum((i - (n - 1) / 2) ** 2 for i in range(n))
    return f"list_sum(list_transform(list_zip({values}, range({n})), lambda z: (z[2] - {mid}::DOUBLE) * z[1])) / {den}"


def lists(lookback: int) -> str:
    """CTEs ``f`` (slices), ``g`` (paths along each slice) and ``h`` (values) per bar."""
    sd20, m20 = q.over("stddev_pop(close)", 20), _mean(20)
    pos = q.over("sum(CASE WHEN tp > ptp THEN tp * volume ELSE 0 END)", 14)
    neg = q.over("sum(CASE WHEN tp <= ptp THEN tp * volume ELSE 0 END)", 14)
    lo, hi = q.over("min(low)", 14), q.over("max(high)", 14)
    log_return = "CASE WHEN pc > 0 AND close > 0 THEN ln(close / pc) END"
    columns = {
        "ml": f"CASE WHEN len(c) >= 16 THEN {q.line_list()} END",
        "mlp": f"CASE WHEN len(c) >= 17 THEN {q.line_list('c[:-2]')} END",
        "rp": f"CASE WHEN len(c) >= 15 THEN list_transform(list_zip({q.path(q.gains(), 14, 1 / 14)}, {q.path(q.losses(), 14, 1 / 14)}), "
              "lambda z: CASE WHEN z[2] = 0 THEN 100.0 ELSE 100 - 100 / (1 + z[1] / z[2]) END) END",
        "dx": f"CASE WHEN len(c) >= 29 THEN list_transform(list_zip({q.path('trs', 14, 1 / 14)}, {q.path('dps', 14, 1 / 14)}, {q.path('dms', 14, 1 / 14)}), "
              "lambda z: CASE WHEN z[1] > 0 AND z[2] + z[3] > 0 THEN abs(z[2] - z[3]) / (z[2] + z[3]) * 100 ELSE 0.0 END) END",
        "obv": "list_reduce(svs[2:], lambda acc, x: {'e': acc.e + x, 'o': list_append(acc.o, acc.e + x)}, {'e': 0.0::DOUBLE, 'o': [0.0::DOUBLE]}).o",
        "rl": "CASE WHEN len(c) >= 21 THEN list_transform(list_zip(c[-20:], c[-21:-2]), lambda z: ln(z[1] / z[2])) END",
        "m20": m20, "sd20": sd20, "pos14": pos, "neg14": neg, "v20": q.over("sum(volume)", 20),
        "tv20": q.over("sum(tp * volume)", 20), "m14": _mean(14), "vsma": q.over("avg(volume)", 20),
        "rv20": q.over(f"stddev_samp({log_return})", 20), "rv60": q.over(f"stddev_samp({log_return})", 60),
        "k14": f"CASE WHEN idx + 1 >= 14 THEN 100.0 * (close - {lo}) / greatest({hi} - {lo}, 1e-9) ELSE 50.0 END",
        "hi24": q.over("max(high)", 24), "lo24": q.over("min(low)", 24),
    }
    g = "g AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + " FROM f)"
    stoch = (
        "CASE WHEN len(c) >= 28 THEN list_transform(range(14, len(rp) + 1), lambda i: CASE WHEN list_max(rp[i-13:i]) > list_min(rp[i-13:i]) "
        "THEN (rp[i] - list_min(rp[i-13:i])) / (list_max(rp[i-13:i]) - list_min(rp[i-13:i])) * 100 ELSE 50.0 END) END"
    )
    v = "(PARTITION BY product_id ORDER BY start)"
    h = (
        f"h AS (SELECT *, {stoch} AS st, list_transform(rl, lambda x: least(floor((x - list_min(rl)) / ((list_max(rl) - list_min(rl)) / 10)), 9)) AS eb, "
        f"coalesce(lag(k14) OVER {v}, 50.0) AS k14p, (k14 + coalesce(lag(k14, 1) OVER {v}, 50.0) + coalesce(lag(k14, 2) OVER {v}, 50.0)) / 3 AS d14 FROM g), "
        f"k AS (SELECT *, CASE WHEN len(st) < 3 THEN st ELSE {q.path('st', 3, 0.5)} END AS ks FROM h)"
    )
    return f"{q.frames(lookback)}, {g}, {h}"


def share_sql(i: int) -> str:
    n = f"len(list_filter(eb, lambda x: x = {i}))"
    return f"CASE WHEN {n} > 0 THEN -({n} / 20.0::DOUBLE) * log2({n} / 20.0::DOUBLE) ELSE 0.0 END"


_CROSS = f"({q.ema_end('c', 9)} - {q.ema_end('c', 21)}) / (({q.ema_end('c', 9)} + {q.ema_end('c', 21)}) / 2)"
_VW = "idx + 1 >= 20 AND v20 <> 0"

# Indicator values as SQL over the CTE ``k``.
VALUE = {
    "rsi": q.rsi(),
    "ema9": f"CASE WHEN idx + 1 < 9 THEN close ELSE {q.ema_end('c', 9)} END",
    "ema21": f"CASE WHEN idx + 1 < 21 THEN close ELSE {q.ema_end('c', 21)} END",
    "ema_cross": f"CASE WHEN idx + 1 >= 22 THEN {_CROSS} ELSE 0.0 END",
    "macd_line": "CASE WHEN idx + 1 >= 16 THEN ml[-1] ELSE 0.0 END",
    "macd_signal": f"CASE WHEN idx + 1 >= 16 THEN {q.ema_end('ml', 3)} ELSE 0.0 END",
    "macd_hist": f"CASE WHEN idx + 1 >= 16 THEN ml[-1] - {q.ema_end('ml', 3)} ELSE 0.0 END",
    "macd_hist_prev": f"CASE WHEN idx + 1 >= 17 THEN mlp[-1] - {q.ema_end('mlp', 3)} ELSE 0.0 END",
    "bb_mid": "CASE WHEN idx + 1 < 20 THEN close ELSE m20 END",
    "bb_upper": "CASE WHEN idx + 1 < 20 THEN close ELSE m20 + 2 * sd20 END",
    "bb_lower": "CASE WHEN idx + 1 < 20 THEN close ELSE m20 - 2 * sd20 END",
    "bb_pos": "CASE WHEN idx + 1 < 20 OR sd20 = 0 THEN 0.5 ELSE least(1, greatest(0, (close - (m20 - 2 * sd20)) / (4 * sd20))) END",
    "atr": f"CASE WHEN idx + 1 >= 15 THEN {q.wilder_end('trs', 14)} ELSE 0.0 END",
    "adx": f"CASE WHEN idx + 1 < 29 THEN 20.0 ELSE {q.wilder_end('dx', 14)} END",
    "di_plus": f"CASE WHEN idx + 1 < 29 THEN 0.0 ELSE 100 * {q.wilder_end('dps', 14)} / {q.wilder_end('trs', 14)} END",
    "di_minus": f"CASE WHEN idx + 1 < 29 THEN 0.0 ELSE 100 * {q.wilder_end('dms', 14)} / {q.wilder_end('trs', 14)} END",
    "mfi": "CASE WHEN idx + 1 < 15 THEN 50.0 WHEN neg14 = 0 THEN 100.0 ELSE 100 - 100 / (1 + pos14 / neg14) END",
    "obv_slope": f"CASE WHEN idx + 1 < 11 THEN 0.0 ELSE least(1, greatest(-1, {slope_sql('obv[-10:]', 10)} * 10 / greatest(abs(list_avg(obv[-10:])), 1))) END",
    "vwap": f"CASE WHEN {_VW} THEN tv20 / v20 ELSE close END",
    "vwap_dist": f"CASE WHEN {_VW} THEN least(1, greatest(-1, (close - tv20 / v20) / (tv20 / v20) / 0.05)) ELSE 0.0 END",
    "dissimilarity": "CASE WHEN idx + 1 >= 14 THEN abs(close - m14) / m14 * 100 ELSE 0.0 END",
    "realized_vol": "CASE WHEN idx + 1 >= 21 THEN rv20 * sqrt(365) ELSE 0.0 END",
    "realized_vol_60": "CASE WHEN idx + 1 >= 61 THEN rv60 * sqrt(365) ELSE 0.0 END",
    "entropy": "CASE WHEN idx + 1 < 21 THEN 0.5 ELSE round((" + " + ".join(share_sql(i) for i in range(10)) + ") / log2(10), 4) END",
    "stoch_rsi_k": "CASE WHEN idx + 1 < 28 THEN 50.0 ELSE ks[-1] END",
    "stoch_rsi_d": f"CASE WHEN idx + 1 < 28 THEN 50.0 WHEN len(ks) < 3 OR len(st) < 3 THEN ks[-1] ELSE {q.ema_end('ks', 3)} END",
    "stoch_k": "k14", "stoch_d": "CASE WHEN idx + 1 >= 14 THEN d14 ELSE 50.0 END", "stoch_k_prev": "k14p",
    "vol_sma": "vsma", "high_24h": "hi24", "low_24h": "lo24",
}
FLAG = {
    "vol_spike": "vsma > 0 AND volume > vsma * 1.2",
    "obv_rising": "idx + 1 >= 8 AND obv[-1] > obv[-7]",
    "price_rising": "idx + 1 >= 8 AND close > c[-7]",
}


def base(lookback: int = LOOKBACK, seconds: int = 3600, key: str = "event_type") -> str:
    return f"WITH {q.ticks(key)}, {q.bars(seconds)}, {lists(lookback)} "


def values_cte(names: list[str], lookback: int = LOOKBACK) -> str:
    """``WITH ... v AS (...)``: the named indicator values per bar, unrounded."""
    exprs = {n: VALUE.get(n) or FLAG[n] for n in names}
    return f"{base(lookback)}, v AS (SELECT product_id, start, idx, close, volume, " + ", ".join(f"{e} AS {n}" for n, e in exprs.items()) + " FROM k)"


def hourly(spark: SparkSession, sf_dir: str, before: int = LOOKBACK - 1) -> DataFrame:
    return blocked(domain.bars(spark, sf_dir), before)


def _register(name: str, make: Callable[[], list[Indicator]], numeric: dict[str, str] | list[str], passed: dict[str, str] | None = None, before: int = LOOKBACK - 1) -> None:
    passed = passed or {}
    numeric = numeric if isinstance(numeric, dict) else {n: VALUE[n] for n in numeric}
    select = ["product_id", "start", *[f"{e} AS {n}" for n, e in passed.items()]]
    if numeric:
        select.append(q.cols(**numeric))

    @query(name, f"{base()} SELECT {', '.join(select)} FROM k")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = ind.with_indicators(hourly(spark, sf_dir, before), make())
        return report(core_rows(df), list(numeric), *passed)


def _register_nested(name: str, kind: str, with_sql: bool = True) -> None:
    columns = list(NESTED[kind])

    @query(name, f"{base()} SELECT product_id, start, {q.cols(**{c: VALUE[c] for c in columns})} FROM k" if with_sql else None)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return report(core_rows(nested_indicators(hourly(spark, sf_dir), [kind], LOOKBACK)), columns)


def _multi_rsi_sql() -> tuple[dict[str, str], dict[str, str]]:
    values = {f"rsi{p}": q.rsi(p) for p in (6, 12, 24)}

    def votes(test: str) -> str:
        return "(CASE WHEN idx + 1 >= 25 THEN " + " + ".join(f"(({e}) {test})::INT" for e in values.values()) + " ELSE 0 END)::INT"

    shown = {n: f"CASE WHEN idx + 1 >= 25 THEN round({e}, 1) ELSE 50.0 END" for n, e in values.items()}
    return shown, {"buy_votes": votes("< 30"), "sell_votes": votes("> 70")}


_register("ind1_rsi", lambda: [ind.rsi(_L)], ["rsi"])
_register("ind2_ema", lambda: [ind.ema(_L, 9), ind.ema(_L, 21)], ["ema9", "ema21"])
_register("ind3_macd", lambda: [ind.macd(_L), ind.macd_previous(_L)], ["macd_line", "macd_signal", "macd_hist", "macd_hist_prev"])
_register("ind4_bollinger", lambda: [ind.bollinger()], ["bb_mid", "bb_upper", "bb_lower", "bb_pos"], before=19)
_register("ind5_ema_cross", lambda: [ind.ema_cross(_L)], ["ema_cross"])
_register("ind6_atr", lambda: [ind.atr(_L)], ["atr"])
_register_nested("ind7_adx", "adx")
_register("ind8_mfi", lambda: [ind.mfi()], ["mfi"], before=15)
_register("ind9_obv_slope", lambda: [ind.obv_slope(_L)], ["obv_slope"])
_register("ind10_vwap", lambda: [ind.vwap()], ["vwap", "vwap_dist"], before=19)
_register("ind12_multi_rsi", lambda: [ind.multi_rsi(_L)], *_multi_rsi_sql())
_register("ind13_dissimilarity", lambda: [ind.dissimilarity()], ["dissimilarity"], before=13)
_register("ind14_realized_vol", lambda: [ind.realized_vol(), ind.realized_vol(60, name="realized_vol_60")], ["realized_vol", "realized_vol_60"], before=60)
_register("ind15_entropy", lambda: [ind.shannon_entropy()], ["entropy"], before=20)
_register_nested("ind16_stoch_rsi", "stoch_rsi")
_register("ind17_stochastic", lambda: [ind.stochastic()], ["stoch_k", "stoch_d", "stoch_k_prev"], before=16)
_register("ind18_obv_state", lambda: [ind.obv_state()], [], {n: FLAG[n] for n in ("obv_rising", "price_rising")}, before=7)
_register("ind19_volume_sma", lambda: [ind.volume_sma()], ["vol_sma"], {"vol_spike": FLAG["vol_spike"]}, before=19)
_register("ind26_high_low", lambda: [ind.high_low()], ["high_24h", "low_24h"], before=23)


def _hurst_sql() -> str:
    """R/S regression over four nested suffixes of the slice."""
    n = "len(c)"
    lags = [f"greatest({m}, {n} // {d})" for m, d in ((2, 8), (4, 4), (8, 2))] + [n]

    def point(lag: str) -> str:
        sub = f"c[-({lag}):]"
        dev = f"list_transform({sub}, lambda x: x - list_avg({sub}))"
        return f"{{'lag': {lag}, 'dev': {dev}}}"

    pts = "[" + ", ".join(point(x) for x in lags) + "]"
    return (
        f"{base()}, p0 AS (SELECT product_id, start, idx, unnest(CASE WHEN len(c) >= 50 THEN {pts} ELSE [] END) AS p FROM k), "
        "p1 AS (SELECT product_id, start, ln(p.lag) AS x, sqrt(list_avg(list_transform(p.dev, lambda d: d * d))) AS sd, "
        "list_reduce(p.dev, lambda s, d: {'e': s.e + d, 'hi': greatest(s.hi, s.e + d), 'lo': least(s.lo, s.e + d)}, "
        "{'e': 0.0::DOUBLE, 'hi': -1e300::DOUBLE, 'lo': 1e300::DOUBLE}) AS rr FROM p0 WHERE len(p.dev) >= 4), "
        "p2 AS (SELECT product_id, start, regr_slope(ln((rr.hi - rr.lo) / sd), x) AS h, count(*) AS n FROM p1 WHERE sd > 0 GROUP BY 1, 2) "
        f"SELECT k.product_id, k.start, {q.r('CASE WHEN n >= 2 THEN least(1, greatest(0, h)) ELSE 0.5 END')} AS hurst "
        "FROM k LEFT JOIN p2 ON k.product_id = p2.product_id AND k.start = p2.start"
    )


@query("ind11_hurst", _hurst_sql())
def hurst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(core_rows(nested_indicators(hourly(spark, sf_dir), ["hurst"], LOOKBACK)), ["hurst"])
