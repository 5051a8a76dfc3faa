"""Streaming twins of the order-dependent operators, on ``transformWithStateInPandas``.

Each processor keeps a few numbers per key in the state store, and the rows the watermark has not passed yet. The stream
needs a watermark on ``ts`` and event-time mode (``run``). The state store must be RocksDB (``STATE_STORE``).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.operators import shares
from tickloom.operators.signals import emissions

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(*STATE_STORE)


#: Event time of one slot of waiting rows, in milliseconds.
SLOT = 3_600_000
#: Rows gathered before they are stored, and before they are handed on.
GATHERED = 100_000
_ARROW = {"timestamp": pa.timestamp("us"), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}


class _Waiting:
    """The waiting rows of a key: Arrow batches in the state store by hour of event time.

    A store call moves thousands of rows, and only the hour in hand is in memory. ``take`` hands the rows out in time order.
    """

    def __init__(self, handle: StatefulProcessorHandle, schema: T.StructType):
        slot = T.StructType().add("slot", "long")
        self.slots = handle.getMapState("slots", slot, T.StructType().add("parts", "long").add("first", "long"))
        self.rows = handle.getMapState("waiting", T.StructType().add("slot", "long").add("part", "long"), T.StructType().add("batch", "binary"))
        self.schema = pa.schema([(f.name, _ARROW[f.dataType.simpleString()]) for f in schema])

    def _index(self) -> dict[int, tuple[int, int]]:
        return {key[0]: tuple(value) for key, value in self.slots.iterator()}

    def _save(self, slot: int, part: int, batch: pa.RecordBatch) -> None:
        self.rows.updateValue((slot, part), (batch.serialize().to_pybytes(),))

    def add(self, frames: Iterator[pd.DataFrame]) -> int | None:
        """Store the rows; returns the earliest of their times."""
        index, first, held, n = self._index(), None, [], 0
        touched: set[int] = set()

        def flush() -> None:
            nonlocal first
            frame = pd.concat(held, ignore_index=True)
            at = _millis_of(frame["ts"])
            order = np.argsort(at, kind="stable")
            at, batch = at[order], pa.RecordBatch.from_pandas(frame.iloc[order], self.schema, preserve_index=False)
            slots = at // SLOT
            starts = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]])
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(at)]):
                slot = int(slots[start])
                parts, earliest = index.get(slot, (0, 2**62))
                self._save(slot, parts, batch.slice(start, end - start))
                index[slot] = (parts + 1, min(earliest, int(at[start])))
                touched.add(slot)
            first = int(at[0]) if first is None else min(first, int(at[0]))

        for frame in frames:
            if len(frame):
                held.append(frame[self.schema.names])
                n += len(frame)
            if n >= GATHERED:
                flush()
                held, n = [], 0
        if held:
            flush()
        for slot in touched:
            self.slots.updateValue((slot,), index[slot])
        return first

    def take(self, limit: int = 2**62) -> Iterator[pd.DataFrame]:
        """Remove the rows up to ``limit``, sorted by time and, where it is equal, by ``seq`` with null first."""
        index, held, n = self._index(), [], 0
        for slot in sorted(s for s in index if index[s][1] <= limit):
            names = [(slot, i) for i in range(index[slot][0])]
            rows = pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(bytes(self.rows.getValue(k)[0])), self.schema) for k in names])
            for k in names:
                self.rows.removeKey(k)
            frame = rows.to_pandas()
            late = _millis_of(frame["ts"]) > limit
            if late.any():
                later = frame[late]
                self._save(slot, 0, pa.RecordBatch.from_pandas(later, self.schema, preserve_index=False))
                self.slots.updateValue((slot,), (1, int(_millis_of(later["ts"]).min())))
                frame = frame[~late]
            else:
                self.slots.removeKey((slot,))
            held.append(frame.sort_values(["ts", "seq"], na_position="first", ignore_index=True))
            n += len(frame)
            if n >= GATHERED:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
        if held:
            yield pd.concat(held, ignore_index=True)

    def first(self) -> int | None:
        return min((first for _, first in self._index().values()), default=None)


class _OneValue(StatefulProcessor):
    """A processor that sees the rows of a key in time order and keeps one row of ``STATE``.

    Rows wait in the state store until the watermark has passed them; then ``step`` gets all that are due, sorted by ``(ts, seq)``, in
    pieces. So files and rows may come in any order within the watermark's delay, and the output is that of the batch form up to the
    watermark. What a key holds is the rows of one delay. ``INPUT`` are the columns that wait, with ``ts`` and ``seq`` among them.
    """

    INPUT: T.StructType
    STATE: T.StructType

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.STATE)
        self.waiting = _Waiting(handle, self.INPUT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = self.waiting.add(rows)
        if first is not None:
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        state = before = self.state.get() if self.state.exists() else None
        for due in self.waiting.take(limit):
            out, state = self.step(key, due, state)
            state = tuple(state)
            if len(out):
                yield out
        if state is not before:
            self.state.update(state)
            later = self.waiting.first()
            if later is not None:
                self.handle.registerTimer(later)

    def close(self) -> None:
        pass


def _micros(ts: pd.Series) -> np.ndarray:
    return ts.to_numpy("datetime64[us]").astype(np.int64)


def _millis_of(ts: pd.Series) -> np.ndarray:
    return _micros(ts) // 1000


def _seconds(ts: pd.Series) -> np.ndarray:
    return _micros(ts) // 1_000_000


class Suppress(_OneValue):
    """Drops a signal repeating the side of the last emitted one within the cool-down."""

    INPUT = T.StructType().add("ts", "timestamp").add("seq", "long").add("side", "string")
    STATE = T.StructType().add("at", "long").add("side", "string")
    OUTPUT = T.StructType().add("product_id", "string").add("ts", "timestamp").add("seq", "long").add("side", "string")

    def __init__(self, cooldown: int = 300):
        self.cooldown = cooldown

    def step(self, key, frame, state):
        at, side = state if state else (-(10**12), "")
        t, sides = _seconds(frame["ts"]), frame["side"].to_numpy()
        keep = emissions(t, sides, at, side, self.cooldown)
        found = frame[keep]
        if len(found):
            at, side = int(t[keep][-1]), sides[keep][-1]
        return found.assign(product_id=key[0])[self.OUTPUT.fieldNames()], (at, side)


class Drawdown(_OneValue):
    """Daily and weekly drawdown against the window's first balance, halted to the window's end."""

    INPUT = T.StructType().add("ts", "timestamp").add("seq", "long").add("balance", "double")
    STATE = (
        T.StructType().add("day", "long").add("day_start", "double").add("day_halt", "boolean")
        .add("week", "long").add("week_start", "double").add("week_halt", "boolean")
    )
    OUTPUT = T.StructType().add("agent", "string").add("seq", "long").add("halted", "boolean").add("day_drawdown", "double").add("week_drawdown", "double")

    def __init__(self, daily: float = 0.05, weekly: float = 0.10):
        self.limits = (daily, weekly)

    def step(self, key, frame, state):
        windows = [state[:3], state[3:]] if state else [(-1, 0.0, False)] * 2
        second, balance, falls, halts, left = _seconds(frame["ts"]), frame["balance"], [], [], []
        for (slot, start, halted), length, limit in zip(windows, (86_400, 604_800), self.limits):
            own = pd.Series(second // length)
            known = (own == slot).to_numpy()
            base = np.where(known, start, balance.groupby(own).transform("first"))
            fall = (base - balance.to_numpy()) / np.maximum(base, 1.0)
            halt = pd.Series(fall >= limit).groupby(own).cummax().to_numpy() | (known & halted)
            falls.append(fall)
            halts.append(halt)
            left += [int(own.iloc[-1]), float(base[-1]), bool(halt[-1])]
        out = pd.DataFrame({"agent": key[0], "seq": frame["seq"], "halted": halts[0] | halts[1], "day_drawdown": falls[0], "week_drawdown": falls[1]})
        return out, left


class OpenPositions(_OneValue):
    """Size and cost of one agent's position in one product; a sell closes all of it (``ledger.average_cost_book``)."""

    INPUT = T.StructType().add("ts", "timestamp").add("seq", "long").add("side", "string").add("price", "double").add("usd", "double")
    STATE = T.StructType().add("size", "double").add("cost", "double")
    OUTPUT = (
        T.StructType().add("agent", "string").add("product_id", "string").add("seq", "long").add("action", "string")
        .add("size", "double").add("avg_price", "double").add("pnl", "double")
    )

    def step(self, key, frame, state):
        """A batch is cut at its sells; inside an episode size and cost are running sums, the first one goes on from the state."""
        price, usd = frame["price"].to_numpy(float), frame["usd"].to_numpy(float)
        sells = (frame["side"] == "SELL").to_numpy()
        buys = (frame["side"] == "BUY").to_numpy() & (price > 0) & (usd > 0)
        cost = np.where(buys, usd, 0.0)
        both = np.stack([np.divide(cost, price, out=np.zeros_like(cost), where=buys), cost])
        episode = np.cumsum(sells) - sells
        # Sums inside the episodes; differences of sums over all of them would lose digits.
        known = np.concatenate([np.array(state if state else (0.0, 0.0))[:, None], both], axis=1)
        sums = pd.DataFrame(known.T).groupby(np.r_[0, episode]).cumsum().to_numpy()[1:]
        size, paid = sums.T
        shown = np.flatnonzero((buys | sells) & (size > 0) & np.where(sells, paid > 0, True))
        pnl = np.where(sells, size * price - paid, np.nan)
        seq, side = frame["seq"].to_numpy(), frame["side"].to_numpy()
        found = (seq[shown], side[shown], size[shown], paid[shown] / size[shown], pnl[shown])
        out = pd.DataFrame(dict(zip(self.OUTPUT.fieldNames(), (key[0], key[1], *found))))
        ended = len(sells) and sells[-1]
        left = (0.0, 0.0) if ended or not len(size) else (float(size[-1]), float(paid[-1]))
        return out, left


class ShareBook(_OneValue):
    """Cash and open positions of an agent whose buys spend a share of its cash (``shares.share_book``)."""

    INPUT = T.StructType().add("ts", "timestamp").add("seq", "long").add("product_id", "string").add("side", "string").add("price", "double").add("frac", "double")
    STATE = T.StructType().add("book", "binary")
    OUTPUT = T.StructType([f for f in shares.BOOK if f.name != "ts"])

    def __init__(self, opening: float = 1000.0):
        self.opening = opening

    def step(self, key, frame, state):
        book = pickle.loads(bytes(state[0])) if state else shares.opened(self.opening)
        known = frame[np.isfinite(frame["price"].to_numpy(float)) & frame["product_id"].notna()].reset_index(drop=True)
        out, book = shares.walk(known.fillna({"frac": 0.0}), book)
        return shares.rows_of(known.assign(agent=key[0]), out)[self.OUTPUT.fieldNames()], (pickle.dumps(book),)


class ResolveOutcomes(_OneValue):
    """Resolves pending signals at ``check_after`` with the last close known for that time, of several in one millisecond the last by ``(ts, seq)``.

    Rows are signals (``side``, ``entry_price`` set) or bar closes (``close`` set), both with event time ``ts``. They wait until the watermark has
    passed them, so late bars inside the watermark are still honoured, and are then walked in pieces. State per key: the rows of one delay, the signals
    of one horizon as one Arrow batch, and the last close. A signal before the first close has no outcome.
    """

    INPUT = T.StructType().add("ts", "timestamp").add("seq", "long").add("side", "string").add("entry_price", "double").add("close", "double")
    STATE = T.StructType().add("at", "long").add("close", "double").add("first_due", "long").add("pending", "binary")
    PENDING = pa.schema([("due", pa.int64()), ("seq", pa.int64()), ("side", pa.string()), ("entry_price", pa.float64())])
    OUTPUT = (
        T.StructType().add("product_id", "string").add("seq", "long").add("side", "string").add("exit_price", "double")
        .add("pct_change", "double").add("outcome", "string")
    )

    def __init__(self, horizon: int = 14_400, win: float = 0.005, loss: float = 0.005):
        self.horizon, self.win, self.loss = horizon, win, loss

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        before = self.state.get() if self.state.exists() else None
        last, pending = (before[:2], self._loaded(before[3])) if before else ((-(2**62), np.nan), self.PENDING.empty_table().to_pandas())
        due = before is not None and before[2] <= limit
        for piece in self.waiting.take(limit):
            due = True
            # What is due before the piece ends is known with it; ``take`` never parts the rows of one millisecond.
            out, last, pending = self.step(key, piece, (last, pending), int(_millis_of(piece["ts"]).max()))
            if len(out):
                yield out
        if due:
            out, last, pending = self.step(key, None, (last, pending), limit)
            if len(out):
                yield out
            first = int(pending["due"].min()) if len(pending) else 2**62
            self.state.update((*last, first, pa.RecordBatch.from_pandas(pending, self.PENDING, preserve_index=False).serialize().to_pybytes()))
            later = self.waiting.first()
            later = first if later is None else min(first, later)
            if later < 2**62:
                self.handle.registerTimer(later)

    def _loaded(self, batch) -> pd.DataFrame:
        return pa.ipc.read_record_batch(pa.py_buffer(bytes(batch)), self.PENDING).to_pandas()

    def step(self, key, frame, state, limit):
        """The outcomes of the signals due up to ``limit``, when ``frame`` has all further rows up to it in time order."""
        (last_at, last), pending = state
        at, close = np.array([last_at], np.int64), np.array([last])
        if frame is not None:
            millis, closes = _millis_of(frame["ts"]), frame["close"].notna().to_numpy()
            at, close = np.r_[at, millis[closes]], np.r_[close, frame["close"].to_numpy(float)[closes]]
            new = frame["entry_price"].notna().to_numpy()
            added = frame.loc[new, ["seq", "side", "entry_price"]].assign(due=millis[new] + self.horizon * 1000)
            pending = pd.concat([pending, added[pending.columns]], ignore_index=True) if len(pending) else added[pending.columns]
        now = (pending["due"] <= limit).to_numpy()
        found, pending = pending[now], pending[~now]
        i = np.searchsorted(at, found["due"].to_numpy(), side="right") - 1
        found, exit_ = found[at[i] > -(2**62)], close[i[at[i] > -(2**62)]]
        entry, side = found["entry_price"].to_numpy(float), found["side"].to_numpy()
        raw = (exit_ - entry) / np.maximum(entry, 1e-9)
        change = np.where(side == "SELL", -raw, raw)
        verdict = np.select([change > self.win, change < -self.loss], ["WIN", "LOSS"], "NEUTRAL")
        columns = (key[0], found["seq"].to_numpy(np.int64), side, exit_, change, verdict)
        return pd.DataFrame(dict(zip(self.OUTPUT.fieldNames(), columns))), (int(at[-1]), float(close[-1])), pending


class CachedValues(StatefulProcessor):
    """Values under names, each served until its time to live has passed, else a default.

    Rows of two streams, united: refreshes (``value`` set) and look-ups (``seq`` set) of one ``name`` and key. The map state has the time to live
    as Spark's own state TTL, so forgotten names leave the store without any timer; the age in event time is
    checked as well, as a late look-up must not see a value that was stale by its own time.
    """

    STATE = T.StructType().add("value", "double").add("at", "long")
    NAME = T.StructType().add("name", "string")
    INPUT = T.StructType().add("name", "string").add("ts", "timestamp").add("seq", "long").add("value", "double")
    OUTPUT = T.StructType().add("seq", "long").add("name", "string").add("value", "double")

    def __init__(self, ttl_seconds: float = 600, default: float = 50.0, state_ttl_seconds: float | None = None):
        self.ttl, self.default, self.state_ttl = int(ttl_seconds * 1_000_000), default, state_ttl_seconds if state_ttl_seconds is not None else ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cache = handle.getMapState("cache", self.NAME, self.STATE, int(self.state_ttl * 1000))
        self.waiting = _Waiting(handle, self.INPUT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """All rows of a batch are first stored and then read in time order, as they come in frames of any order."""
        self.waiting.add(rows)
        held, last = {}, {}
        for frame in self.waiting.take():
            for name, own in frame.groupby("name", sort=False):
                if name not in last:
                    last[name] = held[name] = tuple(self.cache.getValue((name,))) if self.cache.containsKey((name,)) else (np.nan, -(2**62))
                at = _micros(own["ts"])
                value, refresh = own["value"].to_numpy(float), own["value"].notna().to_numpy()
                what = np.r_[last[name][0], value[refresh]]
                when = np.r_[last[name][1], at[refresh]]
                place = np.cumsum(refresh)[~refresh]
                asked = own[~refresh]
                fresh = at[~refresh] - when[place] <= self.ttl
                last[name] = (float(what[-1]), int(when[-1]))
                if len(asked):
                    yield pd.DataFrame({"seq": asked["seq"].to_numpy(np.int64), "name": name, "value": np.where(fresh, what[place], self.default)})
        for name, (value, at) in last.items():
            if (value, at) != held[name] and at >= held[name][1]:
                self.cache.updateValue((name,), (value, at))

    def close(self) -> None:
        pass


def run(stream: DataFrame, keys: list[str], processor, time_mode: str = "EventTime") -> DataFrame:
    """Attach a processor to a keyed stream."""
    use_rocksdb(stream.sparkSession)
    return stream.groupBy(*keys).transformWithStateInPandas(processor, processor.OUTPUT, "Append", time_mode)
