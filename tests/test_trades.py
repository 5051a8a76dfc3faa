"""Trades by exit pointers against a loop over the ticks."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import trades

SCHEMA = "product_id string, s long, seq long, price double, buy_score double, sell_score double, atr_stop double"


def make(seed, n, calm):
    rng, out, price = random.Random(seed), [], {p: 100.0 for p in "pqr"}
    for i in range(n):
        p = rng.choice("ppppqr")
        if rng.random() < 0.15:
            score = rng.random()
            out.append((p, 7 * (i // 3), i, 0.0, score, rng.choice([None, 0.2, 0.54, 0.55 if rng.random() < 0.2 else 0.1]), rng.choice([None, 0.05, 0.004])))
            continue
        price[p] *= 1 + rng.gauss(0, calm)
        out.append((p, 7 * (i // 3), i, 0.0 if rng.random() < 0.01 and calm > 0.001 else price[p], None, None, None))
    return out


def loop(rows, with_stop=True, usd=100.0, arm=1.0, giveback=0.25, profit=0.06):
    out, states = [], {}
    for p, _, seq, price, buy, sell, stop in rows:
        st = states.setdefault(p, {"buy": 0.0, "sell": 0.0, "stop": 0.015, "open": None})
        if buy is not None:
            st.update(buy=buy, sell=sell or 0.0, stop=stop if with_stop and stop is not None else 0.015)
        elif st["open"] is None:
            if st["buy"] >= 0.55 and price > 0:
                st.update(open=[seq, price, 0.0, st["stop"]], buy=0.0)
        else:
            entry, paid, peak, limit = st["open"]
            gain, share = (price - paid) * (usd / paid), (price - paid) / paid
            peak = st["open"][2] = max(peak, gain)
            why = ("TICK_SIGNAL" if st["sell"] >= 0.55 else "TICK_STOP" if share < -limit else
                   "TICK_TRAIL" if peak >= arm and peak - gain >= giveback else "TICK_PROFIT" if share > profit else None)
            if why:
                out.append((p, entry, seq, why))
                st.update(open=None, buy=0.0, sell=0.0)
    return sorted(out + [(p, st["open"][0], None, None) for p, st in states.items() if st["open"]], key=str)


@pytest.mark.parametrize("seed,n,calm,block,group,width", [(1, 900, 0.01, 2048, 512, 1024), (2, 900, 0.01, 16, 4, 4), (3, 1200, 0.0005, 8, 3, 2), (4, 700, 0.03, 64, 2, 8)])
def test_trades_match_a_loop(spark, seed, n, calm, block, group, width):
    rows = make(seed, n, calm)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("s")).drop("s").repartition(5)
    got = trades.tick_trades(df, block=block, group=group, width=width).collect()
    want = loop(rows)
    assert sorted(((r.product_id, r.entry_seq, r.exit_seq, r.trigger) for r in got), key=str) == want
    assert len({w[3] for w in want}) >= 3


def test_trades_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA).withColumn("ts", F.timestamp_seconds("s")).drop("s")
    assert trades.tick_trades(empty).count() == 0
    rows = [("p", 0, 0, 100.0, None, None, None), ("p", 60, 1, 0.0, 0.9, 0.1, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("s")).drop("s")
    assert trades.tick_trades(df).count() == 0
