"""The 27-channel window features and the dataset built from them.

Per-bar channels are window expressions; channels whose recursion starts at the first bar of
the window are advanced for all windows of a block together in one Arrow call per block.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators import indicators as ind
from tickloom.operators.alignment import asof_join
from tickloom.operators.blocks import blocked, core_rows, halo, index_bars
from tickloom.operators.labels import label_blocks
from tickloom.operators.layers import clip
from tickloom.operators.nested import adx_path, ema_path, rsi_path, stoch_rsi_path

C = F.col
WINDOW, CHANNELS = 60, 27
FAST_LOOKBACK = 59

# Channels with no history in training data (order book, funding, spreads, sentiment).
MASKED = (10, 11, 20, 24, 25, 26)


def fast_features(bars_5m: DataFrame) -> DataFrame:
    """Fast RSI, velocity and volume z-score at every 5-minute bar; neutral below 14 bars."""
    return fast_states(blocked(bars_5m, FAST_LOOKBACK))


def fast_states(blocks: DataFrame) -> DataFrame:
    """``fast_features`` of indexed bars in blocks with ``FAST_LOOKBACK`` rows before them."""
    df = core_rows(ind.with_indicators(blocks, [
        ind.rsi(15, 12, "fast_rsi"), ind.velocity(12), ind.volume_zscore(60),
    ]))
    enough = C("idx") + 1 >= 14
    return df.select(
        "product_id", C("start").alias("fast_start"),
        F.when(enough, C("fast_rsi") / 100).otherwise(0.5).alias("fast_rsi"),
        F.when(enough, C("velocity")).otherwise(0.0).alias("velocity"),
        F.when(enough, C("volume_z")).otherwise(0.0).alias("volume_z"),
    )


def aligned_closes(target: DataFrame, reference: DataFrame, bucket_seconds: int = 86_400 * 7) -> DataFrame:
    """Reference close in force at each target bar; bars before the first one take its value."""
    ref = reference.select(C("start").alias("ref_start"), C("close").alias("ref_close"))
    return asof_join(target, ref, [], "start", "ref_start", ["ref_close"], bucket_seconds, seed_first=True).drop("ref_start_matched")


def aligned_funding(target: DataFrame, funding: DataFrame, bucket_seconds: int = 86_400 * 30) -> DataFrame:
    """Funding rate in force at each bar from events ``(product_id, funding_time_ms, rate)``."""
    events = funding.select("product_id", F.timestamp_millis("funding_time_ms").alias("funding_at"), C("rate").alias("funding_rate"))
    return asof_join(target, events, ["product_id"], "start", "funding_at", ["funding_rate"], bucket_seconds, seed_first=True).drop("funding_at_matched")


def with_fast_features(target: DataFrame, fast: DataFrame, bar_seconds: int = 3600, bucket_seconds: int = 21_600) -> DataFrame:
    """State of the 5-minute series just before each bar closes."""
    target = target.withColumn("__end", C("start") + F.make_interval(secs=F.lit(bar_seconds)))
    df = asof_join(target, fast, ["product_id"], "__end", "fast_start", ["fast_rsi", "velocity", "volume_z"], bucket_seconds, strict=True)
    return df.drop("__end", "fast_start_matched").fillna({"fast_rsi": 0.5, "velocity": 0.0, "volume_z": 0.0})


EXOGENOUS = {
    "ref_close": None, "fast_rsi": 0.5, "velocity": 0.0, "volume_z": 0.0, "funding_rate": 0.0, "bid_depth": 0.0,
    "ask_depth": 0.0, "iv_rv20": 0.0, "iv_rv60": 0.0, "ls_sentiment": 0.0,
}

# Channel -> SQL, for channels that do not depend on where the window starts (or only through
# a warm-up that is masked afterwards).
PER_BAR = {
    1: "log10(greatest(volume, 1D)) / 10",
    2: "(high - low) / greatest(close, 1e-9D)",
    3: clip("(close - open) / greatest(abs(open), 1e-9D)", -1, 1),
    4: "rsi21 / 100",
    8: "bb_pos",
    9: clip("(close - pc) / greatest(pc, 1e-9D)", -0.1, 0.1) + " / 0.1D",
    10: "log10(greatest(bid_depth, 1D)) / 8",
    11: "log10(greatest(ask_depth, 1D)) / 8",
    12: "mfi / 100",
    16: "vwap_dist",
    17: "fast_rsi", 18: "velocity", 19: "volume_z",
    20: clip("funding_rate / 0.01D", -1, 1),
    21: "ref_corr",
    22: "sin(hour(start) * 2 * pi() / 24)",
    23: "cos(hour(start) * 2 * pi() / 24)",
    24: "iv_rv20", 25: "iv_rv60", 26: "ls_sentiment",
}
# Position in the window before which a channel still warms up, and its value there.
WARM_UP = {8: (19, 0.5), 9: (1, 0.0), 12: (14, 0.5), 16: (19, 0.0), 21: (20, 0.0)}
# Channels that hold the value of the last bar at every position.
BROADCAST = (10, 11, 17, 18, 19, 20, 24, 25, 26)
# Helpers of the OBV channel.
OBV_POINTS = 11


def per_bar_channels(df: DataFrame) -> DataFrame:
    """Add ``ch<i>`` columns for the per-bar channels, and the OBV helpers, to a blocked frame."""
    missing = {n: F.lit(v).cast("double") for n, v in EXOGENOUS.items() if n not in df.columns}
    df = df.withColumns(missing) if missing else df
    obv = ind.obv_slope(WINDOW, OBV_POINTS)
    extra = ind.Indicator(
        {"pc": "__pc", "obv": "__obv", "obv_fit": f"__oslope{OBV_POINTS}", "obv_mean": f"__omean{OBV_POINTS}"}, obv.layers)
    df = ind.with_indicators(df, [
        ind.rsi(21, name="rsi21"), ind.bollinger(), ind.mfi(), ind.vwap(), ind.return_correlation("ref_close"), extra,
    ])
    keep = ["product_id", "start", "idx", "block", "is_core", "pos", "high", "low", "close", "obv", "obv_fit", "obv_mean"]
    labels = [c for c in ("label", "weight", "is_sample") if c in df.columns]
    return df.selectExpr(*keep, *labels, *[f"CAST({e} AS DOUBLE) AS ch{i}" for i, e in PER_BAR.items()])


def window_channels(cols: dict[str, np.ndarray]) -> np.ndarray:
    """(windows, 27, bars) from per-bar columns shaped (windows, bars)."""
    close, high, low = cols["close"], cols["high"], cols["low"]
    k, m = close.shape
    out = np.zeros((k, CHANNELS, m))
    for i in PER_BAR:
        x = cols[f"ch{i}"]
        out[:, i] = x[:, -1:] if i in BROADCAST else x
        if i in WARM_UP:
            until, value = WARM_UP[i]
            out[:, i, :until] = value
    lo, hi = close.min(axis=1, keepdims=True), close.max(axis=1, keepdims=True)
    out[:, 0] = (close - lo) / np.where(hi > lo, hi - lo, 1.0)
    # RSI over at most 21 closes: clipped to the window near its start.
    out[:, 4, :14] = 0.5
    if m > 14:
        head = rsi_path(close[:, :min(m, 20)]) / 100
        out[:, 4, 14:14 + head.shape[1]] = head
    if m >= 16:
        fast, slow = ema_path(close, 5), ema_path(close, 13)
        line = fast[:, 8:] - slow
        hist = line[:, 3:] - ema_path(line, 3)[:, 1:]
        out[:, 5, 15:] = np.clip(hist / np.maximum(np.abs(close[:, 15:]), 1) * 1000, -1, 1)
    if m >= 21:
        for channel, period in ((6, 9), (7, 21)):
            at = close[:, period - 1:]
            gap = (ema_path(close, period) - at) / np.maximum(at, 1e-9)
            out[:, channel, period - 1:] = np.clip(gap, -0.1, 0.1) / 0.1
    level = np.abs(cols["obv_mean"] - cols["obv"][:, :1])
    slope = np.clip(cols["obv_fit"] * 10 / np.maximum(level, 1.0), -1, 1)
    out[:, 13, 10:] = slope[:, 10:]
    out[:, 14] = 0.5
    if m > 28:
        out[:, 14, 28:] = stoch_rsi_path(close)[0, :, 28:] / 100
    out[:, 15] = adx_path(high, low, close)[0, :, -1:] / 100
    return out


def _nested(values: np.ndarray, precision: str) -> pa.Array:
    """(rows, channels, bars) as a nested list Arrow array without copying per row."""
    n, c, t = values.shape
    flat = pa.array(values.astype(np.float64 if precision == "double" else np.float32).reshape(-1))
    inner = pa.ListArray.from_arrays(pa.array(np.arange(0, n * c * t + 1, t, dtype=np.int32)), flat)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * c + 1, c, dtype=np.int32)), inner)


def assemble(df: DataFrame, window: int = WINDOW, samples_only: bool = True, pad_short: bool = False, precision: str = "float") -> DataFrame:
    """One row per window with ``channels`` (27 lists of ``window`` floats, oldest first).

    With ``pad_short`` windows of fewer bars at the series start are left-padded with zeros.
    """
    passed = [c for c in ("label", "weight") if c in df.columns]
    keep = ["product_id", "start", "idx", *passed]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("channels", T.ArrayType(T.ArrayType(T.DoubleType() if precision == "double" else T.FloatType())))])
    inputs = ["close", "high", "low", "obv", "obv_fit", "obv_mean", *[f"ch{i}" for i in PER_BAR]]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        n, first = table.num_rows, table.column("idx")[0].as_py()
        wanted = table.column("is_core").to_numpy(zero_copy_only=False).astype(bool)
        if samples_only:
            wanted &= pc.fill_null(table.column("is_sample"), False).to_numpy(zero_copy_only=False).astype(bool)
        cols = {c: np.nan_to_num(table.column(c).to_numpy(zero_copy_only=False).astype(float)) for c in inputs}
        picked, blocks = [], []
        if pad_short and first == 0:
            for j in np.flatnonzero(wanted[:window - 1]):
                part = window_channels({c: x[None, :j + 1] for c, x in cols.items()})
                blocks.append(np.concatenate([np.zeros((1, CHANNELS, window - j - 1)), part], axis=2))
                picked.append(j)
        ends = np.flatnonzero(wanted[window - 1:]) if n >= window else np.array([], dtype=int)
        if len(ends):
            views = {c: np.lib.stride_tricks.sliding_window_view(x, window)[ends] for c, x in cols.items()}
            blocks.append(window_channels(views))
            picked.extend(ends + window - 1)
        values = np.concatenate(blocks) if blocks else np.zeros((0, CHANNELS, window))
        rows = table.select(keep).take(pa.array(np.array(picked, dtype=np.int64)))
        return rows.append_column("channels", _nested(values, precision))

    return df.groupBy("product_id", "block").applyInArrow(run, schema)


def feature_inputs(bars: DataFrame, reference: DataFrame | None = None, funding: DataFrame | None = None, bars_5m: DataFrame | None = None) -> DataFrame:
    """Indexed bars with the aligned reference, funding and 5-minute columns."""
    df = index_bars(bars)
    if reference is not None:
        df = aligned_closes(df, reference)
    if funding is not None:
        df = aligned_funding(df, funding)
    if bars_5m is not None:
        df = with_fast_features(df, fast_features(bars_5m))
    return df


def _dealt(blocks: DataFrame) -> DataFrame:
    """Dealt by product and block: the as-of joins leave rows dealt by product alone, which would satisfy all later windows."""
    return blocks.repartition(C("product_id"), C("block"))


def dataset(
    bars: DataFrame, reference: DataFrame | None = None, funding: DataFrame | None = None, bars_5m: DataFrame | None = None,
    seq_len: int = WINDOW, horizon: int = 4, dead_zone: float = 0.003, precision: str = "float",
) -> DataFrame:
    """Windows, labels and weights of every sample: features look back, labels look ahead."""
    return dataset_of(feature_inputs(bars, reference, funding, bars_5m), seq_len, horizon, dead_zone, precision)


def dataset_of(inputs: DataFrame, seq_len: int = WINDOW, horizon: int = 4, dead_zone: float = 0.003, precision: str = "float") -> DataFrame:
    """``dataset`` of indexed and aligned bars (``feature_inputs``); they may start anywhere in a series."""
    df = _dealt(halo(inputs, before=seq_len, after=2 * horizon))
    return assemble(per_bar_channels(label_blocks(df, seq_len, horizon, dead_zone=dead_zone)), seq_len, precision=precision)


def feature_windows(bars: DataFrame, reference: DataFrame | None = None, funding: DataFrame | None = None, bars_5m: DataFrame | None = None, pad_short: bool = False) -> DataFrame:
    """Windows at every bar (for scoring)."""
    df = _dealt(halo(feature_inputs(bars, reference, funding, bars_5m), before=WINDOW))
    return assemble(per_bar_channels(df), samples_only=False, pad_short=pad_short)


def masked(df: DataFrame, channels: Sequence[int] = MASKED) -> DataFrame:
    """Zero the given channels."""
    listed = ", ".join(str(c) for c in channels)
    kind = df.schema["channels"].dataType.elementType.elementType.simpleString()
    return df.withColumn("channels", F.expr(
        f"transform(channels, (c, i) -> CASE WHEN i IN ({listed}) THEN transform(c, x -> CAST(0 AS {kind})) ELSE c END)"))


# -- incremental build ---------------------------------------------------------------------

def dataset_status(bars: DataFrame, marks: DataFrame, seq_len: int = WINDOW, horizon: int = 4) -> DataFrame:
    """Per product: skip, hit, append or rebuild, and the first sample index to (re)build.

    ``marks`` holds ``product_id, first_start, last_n`` of the stored dataset.
    """
    now = bars.groupBy("product_id").agg(F.count("*").alias("n"), F.min("start").alias("first_now"))
    df = now.join(marks, "product_id", "left")
    rebuild = C("last_n").isNull() | (C("first_start") != C("first_now")) | (C("last_n") > C("n"))
    status = (
        F.when(C("n") < seq_len + horizon + 1, "skip").when(rebuild, "rebuild")
        .when(C("last_n") == C("n"), "hit").otherwise("append")
    )
    begin = F.when(C("status") == "append", F.greatest(F.lit(seq_len - 1), C("last_n") - horizon)).when(C("status") == "rebuild", F.lit(seq_len - 1))
    return df.withColumn("status", status).withColumn("from_idx", begin.cast("long")).select("product_id", "n", C("first_now").alias("first_start"), "status", "from_idx")


def incremental_samples(labelled_bars: DataFrame, status: DataFrame) -> DataFrame:
    """Only the samples that the stored dataset lacks."""
    todo = status.where(C("from_idx").isNotNull()).select("product_id", "from_idx")
    return labelled_bars.join(todo, "product_id").where(C("is_sample") & (C("idx") >= C("from_idx"))).drop("from_idx")
