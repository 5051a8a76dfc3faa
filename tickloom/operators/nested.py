"""Indicators that nest one recursion in another: ADX, stochastic RSI and the Hurst exponent.

These are not linear in the prices, so window sums cannot express them. Spark cuts the series
into halo blocks; each block (a bounded number of rows) is handed to numpy as one Arrow table
and all its slices advance together, one vector step per bar of look-back.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

NESTED = {
    "adx": ("adx", "di_plus", "di_minus"),
    "stoch_rsi": ("stoch_rsi_k", "stoch_rsi_d"),
    "hurst": ("hurst",),
}


def wilder_path(x: np.ndarray, period: int) -> np.ndarray:
    """Wilder smoothing along axis 1; column ``j`` is the value after ``period + j`` inputs."""
    out = np.empty((x.shape[0], x.shape[1] - period + 1))
    out[:, 0] = x[:, :period].mean(axis=1)
    for j in range(1, out.shape[1]):
        out[:, j] = (out[:, j - 1] * (period - 1) + x[:, period + j - 1]) / period
    return out


def ema_path(x: np.ndarray, period: int) -> np.ndarray:
    k = 2.0 / (period + 1)
    out = np.empty((x.shape[0], x.shape[1] - period + 1))
    out[:, 0] = x[:, :period].mean(axis=1)
    for j in range(1, out.shape[1]):
        out[:, j] = x[:, period + j - 1] * k + out[:, j - 1] * (1 - k)
    return out


def _ratio(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    return np.divide(top, bottom, out=np.zeros_like(top), where=bottom > 0)


def rsi_path(close: np.ndarray, period: int = 14) -> np.ndarray:
    """RSI of every prefix of each slice, from ``period + 1`` bars on."""
    diff = np.diff(close, axis=1)
    gain, loss = wilder_path(np.maximum(diff, 0), period), wilder_path(np.maximum(-diff, 0), period)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(loss == 0, 100.0, 100 - 100 / (1 + gain / loss))


def adx_path(high: np.ndarray, low: np.ndarray, close: np.ndarray, period: int = 14) -> np.ndarray:
    """(3, slices, bars) ADX, +DI, -DI of every prefix; (20, 0, 0) below ``2 * period + 1`` bars."""
    k, m = close.shape
    out = np.zeros((3, k, m))
    out[0] = 20.0
    if m < 2 * period + 1:
        return out
    up, down = np.diff(high, axis=1), -np.diff(low, axis=1)
    tr = np.maximum(high[:, 1:] - low[:, 1:], np.maximum(np.abs(high[:, 1:] - close[:, :-1]), np.abs(low[:, 1:] - close[:, :-1])))
    smooth_tr = wilder_path(tr, period)
    plus = 100 * _ratio(wilder_path(np.where(up > down, np.maximum(up, 0), 0.0), period), smooth_tr)
    minus = 100 * _ratio(wilder_path(np.where(down > up, np.maximum(down, 0), 0.0), period), smooth_tr)
    dx = 100 * _ratio(np.abs(plus - minus), plus + minus)
    first = 2 * period
    out[0, :, first:] = wilder_path(dx, period)[:, 1:]
    out[1, :, first:] = plus[:, first - period:]
    out[2, :, first:] = minus[:, first - period:]
    return out


def stoch_rsi_path(close: np.ndarray, period: int = 14, k_smooth: int = 3, d_smooth: int = 3) -> np.ndarray:
    """(2, slices, bars) K and D of every prefix; 50 below ``2 * period`` bars."""
    k, m = close.shape
    out = np.full((2, k, m), 50.0)
    first = 2 * period - 1
    if m <= first:
        return out
    series = rsi_path(close, period)
    win = np.lib.stride_tricks.sliding_window_view(series, period, axis=1)
    lo, hi = win.min(axis=2), win.max(axis=2)
    stoch = np.where(hi > lo, 100 * np.divide(series[:, period - 1:] - lo, hi - lo, out=np.zeros_like(lo), where=hi > lo), 50.0)
    out[:, :, first:] = stoch
    if stoch.shape[1] >= k_smooth:
        ks = ema_path(stoch, k_smooth)
        out[:, :, first + k_smooth - 1:] = ks
        if ks.shape[1] >= d_smooth:
            out[1, :, first + k_smooth + d_smooth - 2:] = ema_path(ks, d_smooth)
    return out


def hurst(close: np.ndarray, minimum: int = 50) -> np.ndarray:
    """R/S exponent of each slice over four nested suffixes, clipped to [0, 1]."""
    k, n = close.shape
    if n < minimum:
        return np.full(k, 0.5)
    xs, ys, used = [], [], []
    for lag in (max(2, n // 8), max(4, n // 4), max(8, n // 2), n):
        sub = close[:, -lag:]
        if sub.shape[1] < 4:
            continue
        dev = sub - sub.mean(axis=1, keepdims=True)
        cum = dev.cumsum(axis=1)
        spread, sd = cum.max(axis=1) - cum.min(axis=1), np.sqrt((dev ** 2).mean(axis=1))
        ok = (sd > 0) & (sub.max(axis=1) > sub.min(axis=1))
        ys.append(np.log(np.where(ok, spread / np.where(ok, sd, 1), 1)))
        xs.append(np.full(k, np.log(lag)))
        used.append(ok)
    x, y, u = np.array(xs), np.array(ys), np.array(used)
    count = u.sum(axis=0)
    safe = np.maximum(count, 1)
    dx = np.where(u, x - (x * u).sum(axis=0) / safe, 0)
    dy = np.where(u, y - (y * u).sum(axis=0) / safe, 0)
    den = (dx ** 2).sum(axis=0)
    slope = np.divide((dx * dy).sum(axis=0), den, out=np.full(k, 0.5), where=den > 0)
    return np.where(count >= 2, np.clip(slope, 0, 1), 0.5)


def _last(path: Callable[..., np.ndarray], width: int, lookback: int, first: int, *series: np.ndarray) -> np.ndarray:
    """Value at the end of every row's slice. Rows nearer the start than ``lookback`` share one
    growing slice, so a single pass over it yields all their values."""
    n = len(series[0])
    out = np.full((width, n), np.nan)
    if first == 0:
        head = min(n, lookback - 1)
        if head:
            out[:, :head] = path(*[s[None, :head] for s in series])[:, 0, :]
    if n >= lookback:
        views = [np.lib.stride_tricks.sliding_window_view(s, lookback) for s in series]
        out[:, lookback - 1:] = path(*views)[:, :, -1]
    return out


def compute(names: Sequence[str], lookback: int, first: int, high: np.ndarray, low: np.ndarray, close: np.ndarray) -> dict[str, np.ndarray]:
    """All requested indicators for one block whose rows start at series position ``first``."""
    out: dict[str, np.ndarray] = {}
    if "adx" in names:
        out.update(zip(NESTED["adx"], _last(adx_path, 3, lookback, first, high, low, close)))
    if "stoch_rsi" in names:
        out.update(zip(NESTED["stoch_rsi"], _last(stoch_rsi_path, 2, lookback, first, close)))
    if "hurst" in names:
        h = np.full(len(close), 0.5)
        if first == 0:
            for j in range(50, min(len(close), lookback - 1) + 1):
                h[j - 1] = hurst(close[None, :j])[0]
        if len(close) >= lookback:
            h[lookback - 1:] = hurst(np.lib.stride_tricks.sliding_window_view(close, lookback))
        out["hurst"] = h
    return out


def nested_indicators(df: DataFrame, names: Sequence[str], lookback: int, keys: Sequence[str] = ("product_id",)) -> DataFrame:
    """Add the columns of ``NESTED[name]`` for each name to a blocked frame.

    Grouping by the block keys re-uses the exchange the window indicators need anyway.
    Halo rows that lack their own full slice come out null; they are dropped with the block.
    """
    added = [c for n in names for c in NESTED[n]]
    schema = T.StructType(df.schema.fields + [T.StructField(c, T.DoubleType()) for c in added])
    wanted = tuple(names)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        series = [table.column(c).to_numpy() for c in ("high", "low", "close")]
        values = compute(wanted, lookback, table.column("idx")[0].as_py(), *series)
        for c in added:
            table = table.append_column(c, pa.array(values[c]))
        return table

    return df.groupBy(*keys, "block").applyInArrow(run, schema)
