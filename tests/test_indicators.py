"""Block-parallel indicators against plain loops over each row's own slice."""

import random

import pytest
from pyspark.sql import functions as F

from tests import plain
from tickloom.operators import indicators as I
from tickloom.operators.blocks import blocked, core_rows
from tickloom.operators.nested import nested_indicators

LOOKBACK = 40


def series(kind, n, seed=7):
    rng = random.Random(seed)
    rows, c = [], 100.0
    for i in range(n):
        if kind == "walk":
            c = max(1.0, c + rng.gauss(0, 1))
        elif kind == "flat":
            c = 100.0 if i > 30 else 100.0 + (i % 3)
        elif kind == "up":
            c = 100.0 + 0.5 * i
        h, l = c + rng.random(), c - rng.random()
        if kind == "flat" and i > 32:
            h = l = c
        rows.append((h, l, c, float(rng.randint(0, 90))))
    return rows


@pytest.fixture(scope="module")
def data():
    return {"walk": series("walk", 150), "flat": series("flat", 110), "up": series("up", 45), "short": series("walk", 9, 3)}


@pytest.fixture(scope="module")
def result(spark, data):
    rows = [(p, 1_700_000_000 + 3600 * i + (3600 * 5 if i > 60 else 0), c, h, l, c, v)
            for p, xs in data.items() for i, (h, l, c, v) in enumerate(xs)]
    bars = spark.createDataFrame(rows, "product_id string, s long, open double, high double, low double, close double, volume double")
    bars = bars.withColumn("start", F.timestamp_seconds("s")).drop("s")
    df = blocked(bars, LOOKBACK - 1, block_rows=48)
    df = I.with_indicators(df, [
        I.rsi(LOOKBACK), I.ema(LOOKBACK, 9), I.ema_cross(LOOKBACK), I.macd(LOOKBACK), I.macd_previous(LOOKBACK),
        I.atr(LOOKBACK), I.multi_rsi(LOOKBACK), I.bollinger(), I.mfi(), I.obv_slope(LOOKBACK), I.shannon_entropy(),
    ])
    df = nested_indicators(df, ["adx", "stoch_rsi", "hurst"], LOOKBACK)
    got = {}
    for r in core_rows(df).collect():
        got.setdefault(r.product_id, {})[r.idx] = r
    return got


def test_every_row_once(result, data):
    assert {p: len(v) for p, v in result.items()} == {p: len(v) for p, v in data.items()}


@pytest.mark.parametrize("product", ["walk", "flat", "up", "short"])
def test_matches_plain_loops(result, data, product):
    xs = data[product]
    for i in range(len(xs)):
        h, l, c, v = (list(t) for t in zip(*xs[max(0, i - LOOKBACK + 1): i + 1]))
        r = result[product][i]
        line, sig, hist = plain.macd(c)
        cross = 0.0
        if len(c) >= 22:
            a, b = plain.ema(c, 9)[-1], plain.ema(c, 21)[-1]
            cross = (a - b) / ((a + b) / 2)
        expect = {
            "rsi": plain.rsi(c), "ema9": plain.ema(c, 9)[-1], "ema_cross": cross,
            "macd_line": line, "macd_signal": sig, "macd_hist": hist,
            "macd_hist_prev": plain.macd(c[:-1])[2] if len(c) > 1 else 0.0,
            "atr": plain.atr(h, l, c), "mfi": plain.mfi(h, l, c, v),
            "obv_slope": plain.obv_slope(c, v), "entropy": plain.entropy(c), "hurst": plain.hurst(c),
        }
        expect.update(zip(("adx", "di_plus", "di_minus"), plain.adx(h, l, c)))
        expect.update(zip(("stoch_rsi_k", "stoch_rsi_d"), plain.stoch_rsi(c)))
        for name, value in expect.items():
            tol = 1e-6 if name.startswith("stoch_rsi") else 1e-8
            if name.startswith("stoch_rsi") and product != "walk":
                continue  # min-max of a constant RSI amplifies rounding noise
            assert r[name] == pytest.approx(value, abs=tol), (product, i, name)
        if len(c) >= 20:
            m = plain.mean(c[-20:])
            sd = plain.mean([(x - m) ** 2 for x in c[-20:]]) ** 0.5
            pos = 0.5 if sd == 0 else min(1, max(0, (c[-1] - (m - 2 * sd)) / (4 * sd)))
            assert r.bb_pos == pytest.approx(pos, abs=1e-8)
        if len(c) >= 25:
            assert r.rsi6 == pytest.approx(plain.rsi(c, 6), abs=0.0500001)
            assert r.buy_votes == sum(plain.rsi(c, p) < 30 for p in (6, 12, 24))
