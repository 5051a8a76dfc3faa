"""Technical indicators over halo blocks.

Every function returns an ``Indicator`` (Spark SQL expressions); apply any number of them to a
blocked frame (``blocks.blocked``) with ``with_indicators``. The look-back is a parameter because
recursive indicators are seeded at the first bar of the slice. Rows with too little history get
the documented default.
"""

from __future__ import annotations

from collections.abc import Sequence

from tickloom.operators.layers import Indicator, Layer, clip, d, lag, merge_layers, rows, since_start, with_indicators
from tickloom.operators.smoothing import ema_rate, last_positive, macd_parts, smoothed, wilder_rate

__all__ = [
    "with_indicators", "rsi", "ema", "ema_cross", "macd", "macd_previous", "atr", "multi_rsi", "bollinger", "mfi",
    "obv_slope", "vwap", "dissimilarity", "realized_vol", "shannon_entropy", "stochastic", "obv_state",
    "volume_sma", "return_correlation", "velocity", "volume_zscore", "high_low", "atr_stop", "atr_trail",
]

KEYS = ("product_id",)
TYPICAL = "((high + low + close) / 3)"
LOG_RETURN = "CASE WHEN __pc > 0 AND close > 0 THEN ln(try_divide(close, __pc)) END"


def _when(condition: str, value: str, otherwise: str) -> str:
    return f"CASE WHEN {condition} THEN {value} ELSE {otherwise} END"


def _bars(n: int) -> str:
    """At least ``n`` bars exist up to and including this row."""
    return f"idx + 1 >= {n}"


def _previous_close(keys: Sequence[str]) -> Layer:
    return {"__pc": lag("close", 1, keys)}


def _slice_start(lookback: int) -> str:
    return f"greatest(idx - {lookback - 1}, 0)"


# -- recursive indicators ------------------------------------------------------------------

def _rsi(lookback: int, period: int, keys: Sequence[str]) -> tuple[list[Layer], str]:
    diff, rate = "(close - __pc)", wilder_rate(period)
    gain = smoothed("gain", f"greatest({diff}, 0D)", period, rate, lookback - 1, 1, keys)
    loss = smoothed("loss", f"greatest(-{diff}, 0D)", period, rate, lookback - 1, 1, keys)
    # greatest() skips nulls, so the first bar counts as no gain and no loss; means start after it.
    no_loss = f"__fell IS NULL OR __fell <= {_slice_start(lookback)}"
    strength = f"greatest({gain.value}, 0D) / greatest({loss.value}, 1e-300D)"
    value = f"CASE WHEN idx < {period} THEN 50D WHEN {no_loss} THEN 100D ELSE 100 - 100 / (1 + {strength}) END"
    layers = [_previous_close(keys), {**gain.early, **loss.early, "__fell": last_positive(f"-{diff}", keys)}, {**gain.late, **loss.late}]
    return layers, value


def rsi(lookback: int, period: int = 14, name: str = "rsi", keys: Sequence[str] = KEYS) -> Indicator:
    """Wilder RSI; 50 below ``period + 1`` bars, 100 where the slice has no loss."""
    layers, value = _rsi(lookback, period, keys)
    return Indicator({name: value}, layers)


def multi_rsi(lookback: int, periods: Sequence[int] = (6, 12, 24), oversold: float = 30.0, overbought: float = 70.0, keys: Sequence[str] = KEYS) -> Indicator:
    """RSI at several periods with oversold and overbought vote counts."""
    parts = {p: _rsi(lookback, p, keys) for p in periods}
    layers = merge_layers(*[part[0] for part in parts.values()], [{}, {}, {}, {f"__rsi{p}": v for p, (_, v) in parts.items()}])
    enough = _bars(max(periods) + 1)

    def votes(test: str) -> str:
        return _when(enough, " + ".join(f"CAST(__rsi{p} {test} AS INT)" for p in periods), "0")

    return Indicator({
        **{f"rsi{p}": _when(enough, f"round(__rsi{p}, 1)", "50D") for p in periods},
        "buy_votes": votes(f"< {d(oversold)}"),
        "sell_votes": votes(f"> {d(overbought)}"),
    }, layers)


def _ema(lookback: int, period: int, keys: Sequence[str]) -> tuple[list[Layer], str]:
    s = smoothed("close", "close", period, ema_rate(period), lookback, keys=keys)
    return [s.early, s.late], f"coalesce({s.value}, close)"


def ema(lookback: int, period: int, name: str | None = None, keys: Sequence[str] = KEYS) -> Indicator:
    """Seeded EMA of the close; the close itself below ``period`` bars."""
    layers, value = _ema(lookback, period, keys)
    return Indicator({name or f"ema{period}": value}, layers)


def ema_cross(lookback: int, keys: Sequence[str] = KEYS) -> Indicator:
    """``(ema9 - ema21) / mid``; 0 below 22 bars."""
    (short_layers, short), (long_layers, long) = _ema(lookback, 9, keys), _ema(lookback, 21, keys)
    value = f"CASE WHEN {_bars(22)} THEN try_divide({short} - {long}, ({short} + {long}) / 2) END"
    return Indicator({"ema_cross": f"coalesce({value}, 0D)"}, merge_layers(short_layers, long_layers))


def macd(lookback: int, keys: Sequence[str] = KEYS) -> Indicator:
    """MACD(5, 13, 3): line, signal and histogram; zeros below 16 bars."""
    m = macd_parts("close", lookback, keys=keys)
    return Indicator({"macd_line": m.line, "macd_signal": m.signal, "macd_hist": f"({m.line}) - ({m.signal})"}, m.layers)


def macd_previous(lookback: int, keys: Sequence[str] = KEYS) -> Indicator:
    """Histogram of the same slice without its last bar (the seed does not move)."""
    m = macd_parts("close", lookback - 1, keys=keys)
    layers = [*m.layers, {"__pmh": lag(f"({m.line}) - ({m.signal})", 1, keys)}]
    return Indicator({"macd_hist_prev": "coalesce(__pmh, 0D)"}, layers)


def atr(lookback: int, period: int = 14, name: str = "atr", keys: Sequence[str] = KEYS) -> Indicator:
    """Wilder ATR; 0 below ``period + 1`` bars."""
    tr = "CASE WHEN __pc IS NOT NULL THEN greatest(high - low, abs(high - __pc), abs(low - __pc)) END"
    s = smoothed("tr", f"({tr})", period, wilder_rate(period), lookback - 1, 1, keys)
    value = _when(f"{_bars(period + 1)} AND __moved > {_slice_start(lookback)}", f"greatest({s.value}, 0D)", "0D")
    return Indicator({name: value}, [_previous_close(keys), {**s.early, "__moved": last_positive(f"({tr})", keys)}, s.late])


def atr_stop(price: str = "close", multiplier: float = 3.0, low: float = 0.015, high: float = 0.12) -> str:
    """SQL of the stop distance as a fraction of the entry price, from an ``atr`` column."""
    raw = f"CASE WHEN atr > 0 AND {price} > 0 THEN atr * {d(multiplier)} / {price} END"
    return f"coalesce({clip(raw, low, high)}, {d(low)})"


def atr_trail(peak: str, multiplier: float = 2.0, low: float = 0.03, high: float = 0.15) -> str:
    """SQL of the trailing distance as a fraction of the peak price, from an ``atr`` column."""
    return atr_stop(peak, multiplier, low, high)


# -- frame indicators ----------------------------------------------------------------------

def bollinger(period: int = 20, mult: float = 2.0, keys: Sequence[str] = KEYS) -> Indicator:
    """Bands with population deviation and the clipped position of the close (0.5 if flat or short)."""
    layer = {
        "__bm": rows("avg(close)", period, keys), "__bh": f"{d(mult)} * " + rows("stddev_pop(close)", period, keys),
        "__bflat": rows("max(close)", period, keys) + " = " + rows("min(close)", period, keys),
    }
    enough = _bars(period)
    pos = clip("try_divide(close - (__bm - __bh), 2 * __bh)", 0, 1)
    return Indicator({
        "bb_mid": _when(enough, "__bm", "close"),
        "bb_upper": _when(enough, "__bm + __bh", "close"),
        "bb_lower": _when(enough, "__bm - __bh", "close"),
        "bb_pos": _when(f"{enough} AND NOT __bflat", pos, "0.5D"),
    }, [layer])


def mfi(period: int = 14, keys: Sequence[str] = KEYS) -> Indicator:
    """Money flow index; an unchanged typical price counts as outflow."""
    flow = f"{TYPICAL} * volume"
    layers = [{"__ptp": lag(TYPICAL, 1, keys)}, {
        "__inflow": rows(f"sum({_when(f'{TYPICAL} > __ptp', flow, '0D')})", period, keys),
        "__outflow": rows(f"sum({_when(f'{TYPICAL} <= __ptp', flow, '0D')})", period, keys),
    }]
    value = f"CASE WHEN idx < {period} THEN 50D WHEN __outflow = 0 THEN 100D ELSE 100 - 100 / (1 + try_divide(__inflow, __outflow)) END"
    return Indicator({"mfi": value}, layers)


def _obv_layers(keys: Sequence[str]) -> list[Layer]:
    """OBV up to a constant per block; the indicators use only differences of it."""
    signed = "CASE WHEN close > __pc THEN volume WHEN close < __pc THEN -volume ELSE 0D END"
    return [_previous_close(keys), {"__obv": since_start(f"sum({signed})", keys)}]


def obv_slope(lookback: int, points: int = 10, scale: int = 10, name: str = "obv_slope", keys: Sequence[str] = KEYS) -> Indicator:
    """Slope of the last ``points`` OBV values, scaled by their mean level since the slice start."""
    layers = [*_obv_layers(keys), {
        f"__oslope{points}": rows("regr_slope(__obv, CAST(pos AS DOUBLE))", points, keys),
        f"__omean{points}": rows("avg(__obv)", points, keys),
        f"__ostart{lookback}": lag("__obv", lookback - 1, keys),
        "__ofirst": since_start("first(CASE WHEN idx = 0 THEN __obv END, true)", keys),
    }]
    level = f"greatest(abs(__omean{points} - {_when(_bars(lookback), f'__ostart{lookback}', '__ofirst')}), 1D)"
    value = clip(f"__oslope{points} * {scale} / {level}", -1, 1)
    return Indicator({name: _when(_bars(points + 1), value, "0D")}, layers)


def vwap(period: int = 20, keys: Sequence[str] = KEYS) -> Indicator:
    """Rolling VWAP and the close's distance from it, clipped at 5 % and scaled to [-1, 1]."""
    layer = {"__vv": rows("sum(volume)", period, keys), "__vtv": rows(f"sum({TYPICAL} * volume)", period, keys)}
    price = _when(f"{_bars(period)} AND __vv <> 0", "try_divide(__vtv, __vv)", "close")
    dist = clip(f"try_divide(close - ({price}), {price}) / 0.05D", -1, 1)
    return Indicator({"vwap": price, "vwap_dist": f"coalesce({_when(_bars(period), dist, '0D')}, 0D)"}, [layer])


def dissimilarity(period: int = 14, keys: Sequence[str] = KEYS) -> Indicator:
    """Distance of the close from its SMA in percent; 0 if short."""
    value = _when(_bars(period), "try_divide(abs(close - __sma), __sma) * 100", "0D")
    return Indicator({"dissimilarity": f"coalesce({value}, 0D)"}, [{"__sma": rows("avg(close)", period, keys)}])


def realized_vol(window: int = 20, bars_per_year: int = 365, name: str = "realized_vol", keys: Sequence[str] = KEYS) -> Indicator:
    """Sample deviation of the last ``window`` log returns times sqrt(bars_per_year)."""
    sd, n = f"__rvsd{window}", f"__rvn{window}"
    layers = [_previous_close(keys), {sd: rows(f"stddev_samp({LOG_RETURN})", window, keys), n: rows(f"count({LOG_RETURN})", window, keys)}]
    return Indicator({name: _when(f"{_bars(window + 1)} AND {n} >= 2", f"{sd} * {d(bars_per_year ** 0.5)}", "0D")}, layers)


def shannon_entropy(window: int = 20, bins: int = 10, keys: Sequence[str] = KEYS) -> Indicator:
    """Entropy of the last ``window`` log returns in equal-width bins, as a share of the maximum."""
    width = f"((__ehi - __elo) / {bins})"
    layers = [
        _previous_close(keys),
        {n: rows(f"{f}({LOG_RETURN})", window, keys) for n, f in (("__ers", "collect_list"), ("__elo", "min"), ("__ehi", "max"))},
        {"__ebins": f"transform(__ers, x -> least(floor(try_divide(x - __elo, {width})), {bins - 1}L))"},
        {"__eshares": f"transform(sequence(0L, {bins - 1}L), i -> size(filter(__ebins, b -> b = i)) / CAST(greatest(size(__ers), 1) AS DOUBLE))"},
    ]
    total = "aggregate(__eshares, 0D, (acc, p) -> acc + CASE WHEN p > 0 THEN -p * log2(p) ELSE 0D END)"
    value = _when("__ehi = __elo", "0D", f"round({total} / log2({d(bins)}), 4)")
    return Indicator({"entropy": _when(f"{_bars(window + 1)} AND size(__ers) >= 4", value, "0.5D")}, layers)


def stochastic(k_period: int = 14, d_period: int = 3, keys: Sequence[str] = KEYS) -> Indicator:
    """Price %K with its previous value and %D, the mean of the last ``d_period`` %K (50 where short)."""
    k = _when(_bars(k_period), "100 * (close - __klo) / greatest(__khi - __klo, 1e-9D)", "50D")
    lags = {f"__k{i}": f"coalesce({lag(k, i, keys)}, 50D)" for i in range(1, d_period)}
    mean = f"(({k}) + {' + '.join(lags)}) / {d_period}"
    return Indicator(
        {"stoch_k": k, "stoch_d": _when(_bars(k_period), mean, "50D"), "stoch_k_prev": "__k1"},
        [{"__klo": rows("min(low)", k_period, keys), "__khi": rows("max(high)", k_period, keys)}, lags],
    )


def obv_state(lookback: int = 6, keys: Sequence[str] = KEYS) -> Indicator:
    """Is OBV, and is the close, above its value ``lookback`` bars ago?"""
    layers = [*_obv_layers(keys), {"__obvback": lag("__obv", lookback, keys), "__closeback": lag("close", lookback, keys)}]
    enough = _bars(lookback + 2)
    return Indicator({
        "obv_rising": f"coalesce({enough} AND __obv > __obvback, false)",
        "price_rising": f"coalesce({enough} AND close > __closeback, false)",
    }, layers)


def volume_sma(period: int = 20, spike: float = 1.2, keys: Sequence[str] = KEYS) -> Indicator:
    """Mean volume of the last ``period`` bars (fewer at the start) and the spike flag."""
    return Indicator(
        {"vol_sma": "__vsma", "vol_spike": f"__vsma > 0 AND volume > __vsma * {d(spike)}"},
        [{"__vsma": rows("avg(volume)", period, keys)}],
    )


def return_correlation(reference: str, window: int = 20, minimum: int = 5, name: str = "ref_corr", keys: Sequence[str] = KEYS) -> Indicator:
    """Correlation of one-bar returns with an aligned reference close, clipped; 0 without variance."""
    own = "((close - __pc) / greatest(__pc, 1e-9D))"
    ref = f"(({reference} - __pref) / greatest(__pref, 1e-9D))"
    a, b = f"CASE WHEN __pref IS NOT NULL AND __pc IS NOT NULL THEN {own} END", f"CASE WHEN __pref IS NOT NULL AND __pc IS NOT NULL THEN {ref} END"
    layers = [{**_previous_close(keys), "__pref": lag(reference, 1, keys)}, {
        "__cn": rows(f"count({a})", window, keys), "__ccov": rows(f"covar_pop({a}, {b})", window, keys),
        "__csd": rows(f"stddev_pop({a})", window, keys) + " * " + rows(f"stddev_pop({b})", window, keys),
        "__cvar": " AND ".join(f"{rows(f'max({x})', window, keys)} > {rows(f'min({x})', window, keys)}" for x in (a, b)),
    }]
    value = f"CASE WHEN __cvar AND __cn >= {minimum} THEN {clip('try_divide(__ccov, __csd)', -1, 1)} END"
    return Indicator({name: f"coalesce({value}, 0D)"}, layers)


def velocity(bars: int = 12, scale: float = 0.005, name: str = "velocity", keys: Sequence[str] = KEYS) -> Indicator:
    """Mean change per bar over the last ``bars`` bars, scaled and clipped to [-1, 1]."""
    back = f"__c{bars}"
    value = clip(f"(close - {back}) / greatest({back}, 1e-9D) / {bars} / {d(scale)}", -1, 1)
    return Indicator({name: f"coalesce({value}, 0D)"}, [{back: lag("close", bars, keys)}])


def volume_zscore(window: int = 60, name: str = "volume_z", keys: Sequence[str] = KEYS) -> Indicator:
    """Volume against the mean of the last ``window`` bars in units of three deviations, clipped."""
    m, s = f"__zm{window}", f"__zs{window}"
    layer = {m: rows("avg(volume)", window, keys), s: rows("stddev_pop(volume)", window, keys)}
    return Indicator({name: clip(f"(volume - {m}) / greatest({s}, 1e-9D) / 3", -1, 1)}, [layer])


def high_low(bars: int = 24, keys: Sequence[str] = KEYS) -> Indicator:
    """Highest high and lowest low of the last ``bars`` bars."""
    return Indicator({"high_24h": "__hi24", "low_24h": "__lo24"}, [{"__hi24": rows("max(high)", bars, keys), "__lo24": rows("min(low)", bars, keys)}])
