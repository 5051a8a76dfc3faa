"""Average-cost books whose buys spend a share of the cash in hand.

Cash couples all products of an agent, so a fill depends on every fill before it. But while no buy falls below the least amount, cash, sizes
and costs after a fill are sums of those before it with fixed weights: a block of fills is a matrix, matrices are composed in a tree
(``scans.carried_states``), and every block starts from its exact state. With each matrix goes a lower bound of what its buys spend; where the
bound does not reach the least amount the state before a block is open, and the agent's blocks are walked in order instead.

Cash that compounds leaves the doubles, so amounts carry an exponent of their own.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.blocks import TICK_BUCKET, running
from tickloom.operators.scans import FAN, carried_states
from tickloom.session import materialize

C = F.col
#: Fills of a block, the most products of a matrix, the largest share and the least amount of a buy.
ROWS, PRODUCTS, LARGEST, LEAST = 128, 200, 0.95, 1.0
LN2 = math.log(2)
BOOK = (
    T.StructType().add("agent", "string").add("ts", "timestamp").add("seq", "long").add("product_id", "string").add("action", "string").add("log_size", "double")
    .add("avg_price", "double").add("log_spent", "double").add("gain", "double").add("log_balance", "double").add("realized_share", "double"))

#: Cash, realised profit and their exponent of two; size, cost and exponent of every open position.
State = tuple[float, float, int, dict[str, tuple[float, float, int]]]


def opened(cash: float) -> State:
    return cash, 0.0, 0, {}


def walk(fills: pd.DataFrame, state: State) -> tuple[list[tuple], State]:
    """Fills in time order: ``position in fills, log_size, avg_price, log_spent, gain, log_balance, realized_share`` of those that change something, and the state after."""
    cash, won, e, held = *state[:3], dict(state[3])
    out = []
    for i, (product, side, price, frac) in enumerate(zip(fills["product_id"], fills["side"], fills["price"], fills["frac"])):
        size, cost, own = held.get(product, (0.0, 0.0, e))
        spent = gain = None
        if side == "BUY":
            spent = cash * min(frac, LARGEST)
            if not price > 0 or not spent > 0 or math.log(spent) + e * LN2 < math.log(LEAST):
                continue
            cash -= spent
            size, cost, own = math.ldexp(size, own - e) + spent / price, math.ldexp(cost, own - e) + spent, e
            held[product] = size, cost, own
        elif side == "SELL" and product in held:
            del held[product]
            if own > e + 200:
                cash, won, e = math.ldexp(cash, e - own), math.ldexp(won, e - own), own
            gain = size * price / cost - 1
            cash, won = cash + math.ldexp(size * price, own - e), won + math.ldexp(size * price - cost, own - e)
        else:
            continue
        out.append((i, math.log(size) + own * LN2, cost / size, math.log(spent) + e * LN2 if spent else None, gain, math.log(cash) + e * LN2 if cash > 0 else None, won / cash if cash else None))
        if not 2.0**-200 < cash < 2.0**200 and cash:
            cash, more = math.frexp(cash)
            won, e = math.ldexp(won, -more), e + more
    return out, (cash, won, e, held)


# -- matrices: rows and columns are cash, realised profit, sizes and costs of the products, every row with an exponent -----------

Map = tuple[list[str], np.ndarray, np.ndarray, np.ndarray] | None


def matrix(fills: pd.DataFrame) -> Map:
    """``products, weights, exponents, bound``; a buy spends at least ``bound`` times the state. None if the block has no such form."""
    names, p = np.unique(fills["product_id"].to_numpy(str), return_inverse=True)
    n, price = len(names), fills["price"].to_numpy(float)
    if n > PRODUCTS or (price < 0).any():
        return None
    w, bound = np.eye(2 + 2 * n), np.full(2 + 2 * n, 1e300)
    bound[1] = 0
    for at, buy, x, frac in zip(p.tolist(), (fills["side"] == "BUY").tolist(), price.tolist(), fills["frac"].tolist()):
        size, cost = 2 + at, 2 + n + at
        if buy:
            spent = w[0] * min(frac, LARGEST)
            bound = np.minimum(bound, spent)
            w[0] -= spent
            w[size] += spent / x
            w[cost] += spent
        else:
            w[0] += w[size] * x
            w[1] += w[size] * x - w[cost]
            w[size] = w[cost] = 0
    return (names.tolist(), *_scaled(w, np.zeros(len(w), np.int64)), bound) if np.isfinite(w).all() else None


def _scaled(w: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    more = np.frexp(np.abs(w).max(1))[1].astype(np.int64)
    return np.ldexp(w, -more[:, None]), e + more


def _times(w: np.ndarray, e: np.ndarray, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Product of two matrices whose rows have exponents; terms far below a row's largest vanish."""
    terms = e[:, None] + own[None]
    top = np.where((w != 0) & (np.abs(x).max(1) > 0)[None], terms, -(2**40)).max(1)
    top = np.where(top == -(2**40), 0, top)
    return _scaled(np.ldexp(w, np.clip(terms - top[:, None], -2000, 0)) @ x, top)


def _widened(m: Map, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    place = {name: i for i, name in enumerate(names)}
    at = np.array([place[x] for x in m[0]], np.int64)
    at = np.r_[0, 1, 2 + at, 2 + len(names) + at]
    w, e, bound = np.eye(2 + 2 * len(names)), np.zeros(2 + 2 * len(names), np.int64), np.zeros(2 + 2 * len(names))
    w[np.ix_(at, at)], e[at], bound[at] = m[1], m[2], m[3]
    return w, e, bound


def compose(first: bytes, second: bytes, _: int) -> bytes:
    a, b = pickle.loads(first), pickle.loads(second)
    names = sorted({*a[0], *b[0]}) if a and b else []
    if not a or not b or len(names) > PRODUCTS:
        return pickle.dumps(None)
    (wa, ea, la), (wb, eb, lb) = _widened(a, names), _widened(b, names)
    w, e = _times(wb, eb, wa, ea)
    later, by = _times(lb[None], np.zeros(1, np.int64), wa, ea)
    bound = np.minimum(la, np.ldexp(later[0], np.clip(by[0], -2000, 900)))
    return pickle.dumps((names, w, e, np.clip(bound, 0, 1e300)))


def step(state: bytes, packed: bytes, _: int) -> bytes:
    """The state behind a block; empty, as all after it, where a buy of the block may fall below the least amount."""
    m = pickle.loads(packed) if state else None
    if m is None:
        return b""
    names, w, e, bound = m
    cash, won, own, held = pickle.loads(state)
    at = [held.get(name, (0.0, 0.0, 0)) for name in names]
    x = np.array([cash, won, *[s for s, _, _ in at], *[c for _, c, _ in at]])
    exps = np.array([own, own, *[k for _, _, k in at] * 2], np.int64)
    with np.errstate(over="ignore"):
        if not (bound * np.ldexp(x, np.clip(exps, -2000, 900)))[[0, *range(2, 2 + len(names))]].sum() > LEAST * (1 + 1e-9):
            return b""
    y, k = _times(w, e, x[:, None], exps)
    y, n = y[:, 0], len(names)
    held = {name: position for name, position in held.items() if name not in set(names)}
    for i, name in enumerate(names):
        if y[2 + i] > 0:
            own = int(k[2 + n + i])
            held[name] = math.ldexp(float(y[2 + i]), int(k[2 + i]) - own), float(y[2 + n + i]), own
    return pickle.dumps((float(y[0]), math.ldexp(float(y[1]), int(k[1] - k[0])), int(k[0]), held))


def rows_of(fills: pd.DataFrame, out: list[tuple]) -> pd.DataFrame:
    at = [r[0] for r in out]
    base = fills[["agent", "ts", "seq", "product_id", "side"]].iloc[at].reset_index(drop=True).rename(columns={"side": "action"})
    for i, name in enumerate(("log_size", "avg_price", "log_spent", "gain", "log_balance", "realized_share"), 1):
        base[name] = np.array([r[i] for r in out], float)
    return base[BOOK.fieldNames()]


def share_book(fills: DataFrame, opening: float = 1000.0, rows: int = ROWS, fan: int = FAN) -> DataFrame:
    """Positions at average cost and cash over fills ``agent, ts, seq, product_id, side, price, frac``.

    A buy spends ``frac`` of the cash, at most ``LARGEST`` of it, and nothing below ``LEAST`` or without a positive price; a sell closes all of its
    product's position. Fills that change nothing are left out; so are rows without a price, a side or a product. Returns ``BOOK``: sizes, amounts spent and balances as natural
    logarithms, ``gain`` as the profit of a sell over its cost, ``realized_share`` as the realised profit over the balance; a sell shows the position it closes.
    """
    buys = (C("side") == "BUY") & (C("price") > 0) & (C("frac") > 0)
    df = fills.where((buys | (C("side") == "SELL")) & C("product_id").isNotNull() & C("price").isNotNull() & ~F.isnan("price") & (F.abs("price") != float("inf")))
    df = df.select("agent", "ts", "seq", "product_id", "side", C("price").cast("double").alias("price"), F.coalesce(C("frac").cast("double"), F.lit(0.0)).alias("frac"))
    df = df.withColumn("__minute", F.floor(F.unix_seconds("ts") / TICK_BUCKET))
    df = running(df, ["agent"], ["__minute"], ["ts", "seq"], {"__n": ("count", F.lit(1))})
    df = materialize(df.withColumn("block", F.floor((C("__n") - 1) / rows).cast("long")).drop("__minute", "__n"))

    def mapped(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"agent": [key[0]], "block": [key[1]], "map": [pickle.dumps(matrix(frame.sort_values(["ts", "seq"])))]})

    maps = materialize(df.groupBy("agent", "block").applyInPandas(mapped, "agent string, block long, map binary"))
    states = materialize(carried_states(maps, ["agent"], compose, step, pickle.dumps(opened(opening)), fan))

    def settled(frame: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ts", "seq"], ignore_index=True)
        return rows_of(frame, walk(frame, pickle.loads(state["state"].iloc[0]))[0] if len(frame) and len(state) else [])

    def chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        agent, state = None, opened(opening)
        for frame in batches:
            for name, part in frame.groupby("agent", sort=False):
                state = state if name == agent else opened(opening)
                agent = name
                part = part.reset_index(drop=True)
                out, state = walk(part, state)
                yield rows_of(part, out)

    open_ = states.where(F.length("state") == 0).select("agent").distinct()
    known = states.join(open_, "agent", "left_anti")
    left = df.join(open_, "agent", "left_anti")
    found = left.groupBy("agent", "block").cogroup(known.groupBy("agent", "block")).applyInPandas(settled, BOOK)
    # Dealt by a hash: dealing by the join's own key would be left to the join, which may turn out to be a broadcast.
    rest = df.join(open_, "agent", "left_semi").drop("block").repartition(F.xxhash64("agent")).sortWithinPartitions("agent", "ts", "seq")
    return found.unionByName(rest.mapInPandas(chained, BOOK))
