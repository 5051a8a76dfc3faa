"""Trades from ticks and cached scores: every entry that could be taken, where each would end, and which ones are taken.

Whether a tick opens a trade depends on all earlier trades, but what a trade does once it is open does not. So the exit of *every* possible
entry is found first, in parallel; an entry then points to the first one that may follow its exit, and the trades
taken are the chain of these pointers from the series' first entry.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.blocks import TICK_BUCKET, row_index, running
from tickloom.operators.scans import cogrouped
from tickloom.session import materialize

C = F.col
#: Ticks of a block and blocks of a group of block summaries.
BLOCK, GROUP = 2048, 512
_RULES = ("TICK_SIGNAL", "TICK_STOP", "TICK_TRAIL", "TICK_PROFIT")


class ExitRules:
    """Limits of an open trade, tested in the order of ``_RULES``: sell score, stop, giveback after a peak, profit."""

    def __init__(self, usd: float = 100.0, arm: float = 1.0, giveback: float = 0.25, take_profit: float = 0.06):
        self.usd, self.arm, self.giveback, self.take_profit = usd, arm, giveback, take_profit

    def first(self, price: np.ndarray, sell: np.ndarray, entry: float, stop: float, peak: float) -> tuple[int, str | None, float]:
        """Position and rule of the first tick that ends the trade (or the length and None), and the peak profit up to it."""
        at, step = 0, 16
        while at < len(price):
            p, s = price[at: at + step], sell[at: at + step]
            gain, share = (p - entry) * (self.usd / entry), (p - entry) / entry
            peaks = np.maximum.accumulate(np.maximum(gain, peak))
            hits = np.stack([s, share < -stop, (peaks >= self.arm) & (peaks - gain >= self.giveback), share > self.take_profit])
            ends = np.flatnonzero(hits.any(axis=0))
            if len(ends):
                j = int(ends[0])
                return at + j, _RULES[int(hits[:, j].argmax())], float(peaks[j])
            peak, at, step = float(peaks[-1]), at + len(p), step * 4
        return len(price), None, peak

    def suspects(self, low: np.ndarray, high: np.ndarray, sell: np.ndarray, entry: float, stop: float, peak: float) -> tuple[int, float]:
        """First block whose summary does not rule out an exit (or their number), and the peak profit before it."""
        slack = 1e-9
        gain_high, gain_low = (high - entry) * (self.usd / entry), (low - entry) * (self.usd / entry)
        peaks = np.maximum.accumulate(np.maximum(gain_high, peak))
        maybe = sell | ((low - entry) / entry < -stop + slack) | ((high - entry) / entry > self.take_profit - slack)
        maybe |= (peaks >= self.arm - slack) & (peaks - gain_low >= self.giveback - slack)
        found = np.flatnonzero(maybe)
        j = int(found[0]) if len(found) else len(low)
        return j, float(peaks[j - 1]) if j else peak


def _exits(ticks: DataFrame, entries: DataFrame, keys: list[str], rules: ExitRules, block: int, group: int) -> DataFrame:
    """Exit of every entry: ``keys, entry, exit_pos, trigger``; entries that nothing ends are left out.

    ``ticks``: keys, ``pos`` (rising), ``price, sell``. ``entries``: keys, ``entry`` (position), ``price, stop``. Most entries
    end in their own block. The others skip, by the blocks' lowest and highest prices, to the next block that can end them; a
    round takes all of them one such block further and reads only the blocks that are asked for.
    """
    kf = [ticks.schema[k] for k in keys]
    blocked = materialize(ticks.select(*keys, "pos", "price", "sell", F.floor(C("pos") / block).alias("block")))
    summary = blocked.groupBy(*keys, "block").agg(F.min("price").alias("low"), F.max("price").alias("high"), F.bool_or("sell").alias("sell"))
    summary = materialize(summary.withColumn("__group", F.floor(C("block") / group)))
    ends = summary.groupBy(*keys).agg(F.max("block").alias("__last"))
    waiting = entries.select(
        *keys, "entry", "price", "stop", F.lit(0.0).alias("peak"), F.floor(C("entry") / block).alias("block"), F.lit(None).cast("long").alias("exit_pos"), F.lit(None).cast("string").alias("trigger"))
    state = T.StructType([*kf, *waiting.schema.fields[len(keys):]])
    columns = state.fieldNames()

    def put(table: pa.Table, **changed: list) -> pa.Table:
        for name, values in changed.items():
            at = table.schema.get_field_index(name)
            table = table.set_column(at, name, pa.array(values, table.schema.field(name).type))
        return table.select(columns)

    def search(asked: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        pos, price, sell = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("pos", "price", "sell"))
        out = []
        for entry, paid, stop, peak in zip(*(asked.column(c).to_pylist() for c in ("entry", "price", "stop", "peak"))):
            begin = int(np.searchsorted(pos, entry, "right"))
            j, rule, peak = rules.first(price[begin:], sell[begin:], paid, stop, peak)
            out.append((None if rule is None else int(pos[begin + j]), rule, peak))
        at, rule, peak = zip(*out) if out else ((), (), ())
        return put(asked, block=[b + 1 for b in asked.column("block").to_pylist()], exit_pos=list(at), trigger=list(rule), peak=list(peak))

    def skip(asked: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block")
        blocks, low, high, sell = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("block", "low", "high", "sell"))
        to, peaks = [], []
        for own, paid, stop, peak in zip(*(asked.column(c).to_pylist() for c in ("block", "price", "stop", "peak"))):
            begin = int(np.searchsorted(blocks, own))
            j, peak = rules.suspects(low[begin:], high[begin:], sell[begin:], paid, stop, peak)
            to.append(int(blocks[begin + j]) if begin + j < len(blocks) else (own // group + 1) * group)
            peaks.append(peak)
        return put(asked, block=to, peak=peaks)

    done = None
    while True:
        by = [*keys, "block"]
        wanted = blocked.join(waiting.select(*by).distinct(), by, "left_semi")
        found = materialize(cogrouped(waiting, wanted, by, search, state))
        ended = found.where(C("exit_pos").isNotNull())
        done = ended if done is None else done.unionByName(ended)
        # What is still open goes to the next block that may end it, or to the first one of the next group of summaries.
        left = found.where(C("exit_pos").isNull()).join(ends, keys).where(C("block") <= C("__last")).drop("__last")
        by = [*keys, "__group"]
        left = left.withColumn("__group", F.floor(C("block") / group))
        waiting = materialize(cogrouped(left, summary, by, skip, state).join(ends, keys).where(C("block") <= C("__last")).drop("__last"))
        if waiting.isEmpty():
            return done.select(*keys, "entry", "exit_pos", "trigger")


def _taken(nodes: DataFrame, keys: list[str], width: int = 1024) -> DataFrame:
    """Nodes on the chain that starts at a key's first node: ``keys, i``.

    ``nodes``: keys, ``i`` (0, 1, 2, ... per key) and ``next`` (greater than ``i``, or beyond the last node). A block of ``width`` nodes is entered at most
    once. Every node's way out of its own block is followed at once; the few nodes that blocks can be entered at
    form a smaller chain of the same kind, solved the same way, and every block then marks its nodes from where it is entered.
    """
    fields = [nodes.schema[k] for k in keys]
    marked = T.StructType([*fields, T.StructField("i", T.LongType())])

    def walk(table: pa.Table, entered: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        i, to = table.column("i").to_numpy(), table.column("next").to_numpy()
        at, keep = int(entered.column("i")[0].as_py()) - int(i[0]) if entered.num_rows and len(i) else len(i), []
        while at < len(i):
            keep.append(at)
            at = int(to[at] - i[0])
        return table.take(pa.array(keep, pa.int64())).select([*keys, "i"])

    top = nodes.agg(F.max("i")).first()[0]
    if top is None or top < width:
        starts = nodes.select(*keys).distinct().withColumn("i", F.lit(0).cast("long"))
        return cogrouped(nodes, starts, keys, walk, marked)

    def leave(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        i, to = table.column("i").to_numpy(), table.column("next").to_numpy().copy()
        for at in range(len(i) - 1, -1, -1):
            inside = to[at] - i[0]
            if inside < len(i):
                to[at] = to[inside]
        return table.select([*keys, "i"]).append_column("leave", pa.array(to))

    nodes = nodes.withColumn("__block", F.floor(C("i") / width))
    by = [*keys, "__block"]
    left = materialize(nodes.groupBy(*by).applyInArrow(leave, T.StructType([*marked.fields, T.StructField("leave", T.LongType())])))
    doors = left.select(*keys, C("leave").alias("i")).unionByName(left.select(*keys, F.lit(0).cast("long").alias("i"))).distinct()
    doors = left.join(doors, [*keys, "i"]).withColumn("__bucket", F.floor(C("i") / 65_536))
    doors = materialize(row_index(doors, keys, ["__bucket"], ["i"], "k").drop("__bucket"))
    beyond = F.lit(2**62)
    onward = doors.select(*keys, C("i").alias("leave"), C("k").alias("__to"))
    upper = doors.join(onward, [*keys, "leave"], "left").select(*keys, C("k").alias("i"), F.coalesce("__to", beyond).alias("next"))
    entered = _taken(materialize(upper), keys, width).withColumnRenamed("i", "k").join(doors, [*keys, "k"])
    entered = entered.select(*keys, "i", F.floor(C("i") / width).alias("__block"))
    return cogrouped(nodes, entered, by, walk, marked)


def tick_trades(
    rows: DataFrame, threshold: float = 0.55, default_stop: float = 0.015, rules: ExitRules | None = None, keys: Sequence[str] = ("product_id",),
    block: int = BLOCK, group: int = GROUP, width: int = 1024,
) -> DataFrame:
    """Trades that a series of ticks and scan scores makes: ``keys, entry_ts, entry_seq, entry_price, exit_ts, exit_seq, exit_price, trigger``.

    ``rows``: keys, ``ts, seq, price, buy_score, sell_score`` and optionally ``atr_stop``; a row with a buy score is a scan, all
    others are ticks. While nothing is held, the first tick with a price above zero after a scan whose buy score passes opens a trade, and the score is used up; a scan from
    before a trade's exit opens nothing. The trade ends at the first later tick at which a rule holds: the sell score in force passes,
    the loss exceeds the stop (the scan's ``atr_stop``, or ``default_stop``), the profit falls back from its peak, or the profit is large enough. A trade that
    nothing ends has no exit.
    """
    keys, rules = list(keys), rules or ExitRules()
    stop = F.coalesce("atr_stop", F.lit(default_stop)) if "atr_stop" in rows.columns else F.lit(default_stop)
    scan = F.when(C("buy_score").isNotNull(), F.struct(C("ts").alias("t"), C("seq").alias("q"), C("buy_score").alias("buy"), C("sell_score").alias("sell"), stop.alias("stop")))
    minute = F.floor(F.unix_seconds("ts") / TICK_BUCKET)
    df = running(rows.withColumn("__minute", minute), keys, ["__minute"], ["ts", "seq"], {"pos": ("count", F.lit(1)), "scan": ("last", scan)})
    df = materialize(df.select(*keys, "ts", "seq", "price", "buy_score", C("pos").cast("long").alias("pos"), "scan"))
    ticks = df.where(C("buy_score").isNull()).withColumn("sell", F.coalesce(C("scan.sell") >= threshold, F.lit(False)))
    fresh = ticks.where((C("scan.buy") >= threshold) & (C("price") > 0)).groupBy(*keys, C("scan.t").alias("t"), C("scan.q").alias("q"))
    fresh = fresh.agg(F.min_by(F.struct(C("pos").alias("entry"), "ts", "seq", "price", C("scan.stop").alias("stop")), "pos").alias("e"))
    scans = df.where(C("buy_score").isNotNull()).select(*keys, C("ts").alias("t"), C("seq").alias("q"), C("pos").alias("scan_pos"))
    entries = fresh.join(scans, [*keys, "t", "q"]).select(*keys, "scan_pos", "e.*").withColumn("__bucket", F.floor(C("entry") / 65_536))
    entries = materialize(row_index(entries, keys, ["__bucket"], ["entry"], "i").drop("__bucket"))
    exits = _exits(ticks, entries, keys, rules, block, group)

    # The next entry after an exit: as many entries lie before it as scans up to the exit opened.
    opened = entries.select(*keys, C("scan_pos").alias("at"), F.lit(1).alias("one"), F.lit(None).cast("long").alias("entry"))
    closed = exits.select(*keys, C("exit_pos").alias("at"), F.lit(0).alias("one"), "entry")
    both = opened.unionByName(closed).withColumn("__bucket", F.floor(C("at") / 65_536))
    after = running(both, keys, ["__bucket"], ["at", "one", "entry"], {"next": ("sum", C("one"))}).where(C("entry").isNotNull()).select(*keys, "entry", "next")
    nodes = entries.join(after, [*keys, "entry"], "left").select(*keys, "i", F.coalesce(C("next").cast("long"), F.lit(2**62)).alias("next"))
    chain = _taken(materialize(nodes), keys, width)
    exit_rows = ticks.select(*keys, C("pos").alias("exit_pos"), C("ts").alias("exit_ts"), C("seq").alias("exit_seq"), C("price").alias("exit_price"))
    trades = entries.join(chain, [*keys, "i"]).join(exits, [*keys, "entry"], "left").join(exit_rows, [*keys, "exit_pos"], "left")
    return trades.select(
        *keys, C("ts").alias("entry_ts"), C("seq").alias("entry_seq"), C("price").alias("entry_price"), "exit_ts", "exit_seq", "exit_price", "trigger")
