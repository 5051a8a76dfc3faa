"""From indicator columns to signals and decisions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions import scoring as S
from tickloom.operators import indicators as ind
from tickloom.operators.blocks import blocked, core_rows
from tickloom.operators.nested import nested_indicators
from tickloom.operators.scans import FAN, carried_states, cogrouped
from tickloom.session import materialize

C = F.col

def ta_indicators(bars: DataFrame, lookback: int = 100) -> DataFrame:
    """All inputs of the technical score, one exchange for the lot."""
    df = ind.with_indicators(blocked(bars, lookback - 1), [
        ind.rsi(lookback), ind.ema_cross(lookback), ind.macd(lookback), ind.bollinger(), ind.mfi(),
        ind.obv_slope(lookback), ind.atr(lookback),
    ])
    return core_rows(nested_indicators(df, ["adx", "stoch_rsi"], lookback))


def ta_signals(bars: DataFrame, lookback: int = 100, min_bars: int = 30, min_strength: float = S.MIN_STRENGTH) -> DataFrame:
    """Scored technical signals at every bar: side is the larger score, ties buy."""
    buy, sell = S.ta_scores()
    df = ta_indicators(bars, lookback).where((C("idx") + 1 >= min_bars) & (C("close") > 0))
    df = df.withColumns({"__buy": buy, "__sell": sell})
    b, s = S.ta_boosted("__buy", "__sell")
    df = df.withColumns({"buy_score": b, "sell_score": s})
    df = df.withColumns({
        "side": F.when(C("buy_score") >= C("sell_score"), "BUY").otherwise("SELL"),
        "strength": F.greatest("buy_score", "sell_score"),
        "reasons": S.ta_reasons(),
    })
    return df.where(C("strength") >= min_strength).withColumn("signal_type", F.concat(F.lit("TA_"), "side")).drop("__buy", "__sell")


def tech_indicators(bars: DataFrame, lookback: int = 80) -> DataFrame:
    df = blocked(bars, lookback - 1)
    return core_rows(ind.with_indicators(df, [
        ind.rsi(lookback), ind.macd(lookback), ind.macd_previous(lookback), ind.bollinger(), ind.volume_sma(),
        ind.stochastic(), ind.obv_state(), ind.atr(lookback),
    ]))


def tech_scored(bars: DataFrame, lookback: int = 80, min_bars: int = 35, min_price: float = 0.01) -> DataFrame:
    """Scan-agent scores and reasons at every bar with enough history and a usable price."""
    buy, sell = S.tech_scores()
    buy_why, sell_why = S.tech_reasons()
    df = tech_indicators(bars, lookback).where((C("idx") + 1 >= min_bars) & (C("close") >= min_price))
    return df.withColumns({
        "buy_score": buy, "sell_score": sell, "buy_reasons": buy_why, "sell_reasons": sell_why,
        "atr_stop": F.expr(ind.atr_stop("close")),
    })


def decide(scored: DataFrame, order: Sequence[str], buckets: Sequence[str], keys: Sequence[str] = ("product_id",), threshold: float = 0.55) -> DataFrame:
    """BUY when flat and the buy score passes, SELL when holding and the sell score passes.

    Whether a product is held depends on all earlier rows, but each row only sets the state (one side passes) or flips it
    (both pass). What any stretch of rows does is then "the last set value, if any, and the flips since": windows find it for
    every row of a bucket, the buckets' own ones are scanned, and the two are joined. One exchange, read back once for each use.
    """
    keys, buckets = list(keys), list(buckets)
    b, s = C("adj_buy") >= threshold, C("adj_sell") >= threshold
    both, one = F.coalesce(b & s, F.lit(False)), F.when(b & ~F.coalesce(s, F.lit(False)), 1).when(s & ~F.coalesce(b, F.lit(False)), 0)
    rows = Window.partitionBy(*keys, *buckets).orderBy(*order)
    so_far = rows.rowsBetween(Window.unboundedPreceding, 0)
    df = scored.repartition(*[C(c) for c in (*keys, *buckets)]).withColumn("__flips", F.sum(both.cast("int")).over(so_far))
    df = df.withColumn("__set", F.last(F.when(one.isNotNull(), F.struct(one.alias("v"), C("__flips").alias("f"))), ignorenulls=True).over(so_far))
    after = F.struct(C("__set.v").alias("v"), (C("__flips") - F.coalesce(C("__set.f"), F.lit(0))).alias("f"))
    df = materialize(df.withColumn("__after", after).withColumn("__before", F.lag("__after").over(rows)).drop("__flips", "__set"))

    totals = df.groupBy(*keys, *buckets).agg(F.max_by("__after", F.struct(*order)).alias("t"))
    earlier = Window.partitionBy(*keys).orderBy(*buckets)
    upto, until = earlier.rowsBetween(Window.unboundedPreceding, 0), earlier.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__flips", F.sum("t.f").over(upto))
    known = F.when(C("t.v").isNotNull(), F.struct((C("t.v") + C("t.f")).alias("v"), C("__flips").alias("f")))
    carry = totals.withColumn("__known", F.last(known, ignorenulls=True).over(until)).withColumn("__passed", F.sum("t.f").over(until))
    came = F.coalesce(C("__known.v"), F.lit(0)) + F.coalesce("__passed", F.lit(0)) - F.coalesce(C("__known.f"), F.lit(0))
    df = df.join(carry.select(*keys, *buckets, came.alias("__came")), [*keys, *buckets])
    held = (F.coalesce(C("__before.v"), C("__came")) + F.coalesce(C("__before.f"), F.lit(0))) % 2 == 1
    side = F.when(b & ~held, "BUY").when(s & held, "SELL").otherwise("HOLD")
    return df.withColumns({"holding": held, "side": side}).withColumn(
        "confidence",
        F.when(C("side") == "BUY", C("adj_buy")).when(C("side") == "SELL", C("adj_sell")).otherwise(F.greatest("adj_buy", "adj_sell")),
    ).drop("__after", "__before", "__came")


_NEVER = -(2**62)


def emissions(t: np.ndarray, side: np.ndarray, last: int, before: object, cooldown: int) -> np.ndarray:
    """Which of the signals, in order, are emitted after an emission of side ``before`` at second ``last``.

    All runs of equal sides advance together, one emission a round.
    """
    keep = np.zeros(len(t), bool)
    at = np.flatnonzero(np.r_[True, side[1:] != side[:-1]][: len(t)])
    ends = np.r_[at[1:], len(t)][: len(at)]
    if len(t) and before == side[0]:  # the first run goes on from before
        at[0] = min(int(np.searchsorted(t, last + cooldown)), int(ends[0]))
    while True:
        on = at < ends
        if not on.any():
            return keep
        at, ends = at[on], ends[on]
        keep[at] = True
        at = np.minimum(np.searchsorted(t, t[at] + cooldown), ends)


def _last_emission(t: np.ndarray, since: np.ndarray, cooldown: int) -> np.ndarray:
    """Last emission in one run of equal sides for every time of the last emission before it."""
    last = np.array(since)
    while True:
        at = np.searchsorted(t, last + cooldown)
        on = at < len(t)
        if not on.any():
            return last
        last[on] = t[at[on]]


def _suppression_map(t: np.ndarray, side: np.ndarray, start: int, cooldown: int) -> bytes:
    """Time of the last emission before a block to the one after it, as a table.

    Entries: block start, first and last side, result when the side before differs, and results for an emission 1 to
    ``cooldown`` seconds before the start (oldest first) and for one before that.
    """
    changed = np.flatnonzero(side[1:] != side[:-1]) + 1
    if len(changed):  # the last change emits, whatever came before
        end = _last_emission(t[changed[-1]:], np.array([_NEVER]), cooldown)[0]
        same, other = np.full(cooldown + 1, end), end
    else:
        same = _last_emission(t, np.r_[np.arange(start - cooldown, start), _NEVER], cooldown)
        other = same[-1]
    return np.r_[start, side[0], side[-1], other, same].astype(np.int64).tobytes()


def _after(e: np.ndarray, side: int, m: np.ndarray) -> np.ndarray:
    """Last emissions ``e`` of one side, taken through a map."""
    cooldown = len(m) - 5
    return np.where(side == m[1], m[4 + np.where(e >= m[0] - cooldown, e - (m[0] - cooldown), cooldown)], m[3])


def _suppress_compose(first: bytes, second: bytes, block: int) -> bytes:
    a, b = np.frombuffer(first, np.int64), np.frombuffer(second, np.int64)
    return np.r_[a[0], a[1], b[2], _after(a[3:], a[2], b)].tobytes()


def _suppress_step(state: bytes, packed: bytes, block: int) -> bytes:
    (last, side), m = np.frombuffer(state, np.int64), np.frombuffer(packed, np.int64)
    return np.array([_after(np.array([last]), side, m)[0], m[2]], np.int64).tobytes()


def suppress_repeats(
    signals: DataFrame, ts: str, seq: str, cooldown: int = 300, keys: Sequence[str] = ("product_id",), block_seconds: int | None = None, fan: int = FAN,
) -> DataFrame:
    """Drop a signal that repeats the side of the last emitted one within ``cooldown`` seconds.

    Which signals are emitted depends on all earlier ones, but only through the time and side of the last emission. So a block of
    ``block_seconds`` (six cool-downs) is a map from the last emission before it to the last one inside it, a table over the seconds of one
    cool-down, as an older emission no longer matters. The maps are composed and scanned over the series, and every block then marks its
    own emissions. An unbroken run of any length spreads over its blocks; no task holds more than one block of a key.
    """
    keys = list(keys)
    width = block_seconds or 6 * cooldown
    df = signals.withColumns({"__s": F.unix_seconds(C(ts)), "__side": F.xxhash64("side")}).withColumn("__block", F.floor(C("__s") / width))
    by, columns = [*keys, "__block"], signals.columns
    narrow = df.select(*by, "__s", C(seq).alias("__q"), "__side")
    fields = [df.schema[k] for k in keys] + [T.StructField("block", T.LongType()), T.StructField("map", T.BinaryType())]

    def summary(table: pa.Table) -> pa.Table:
        table = table.sort_by([("__s", "ascending"), ("__q", "ascending")])
        block = table.column("__block")[0].as_py()
        packed = _suppression_map(table.column("__s").to_numpy(), table.column("__side").to_numpy(), block * width, cooldown)
        return table.slice(0, 1).select(keys).append_column("block", pa.array([block])).append_column("map", pa.array([packed], pa.binary()))

    maps = materialize(narrow.groupBy(*by).applyInArrow(summary, T.StructType(fields)))
    start = np.array([_NEVER, 0], np.int64).tobytes()
    carry = carried_states(maps, keys, _suppress_compose, _suppress_step, start, fan).withColumnRenamed("block", "__block")

    def emitted(table: pa.Table, states: pa.Table) -> pa.Table:
        table = table.sort_by([("__s", "ascending"), (seq, "ascending")])
        last, before = np.frombuffer(states.column("state")[0].as_py(), np.int64)
        keep = emissions(table.column("__s").to_numpy(), table.column("__side").to_numpy(), last, before, cooldown)
        return table.select(columns).filter(pa.array(keep))

    return cogrouped(df, carry, by, emitted, signals.schema)
