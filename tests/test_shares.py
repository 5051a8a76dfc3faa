"""Books that spend a share of the balance, against a loop in exact fractions."""

import math
import random
from fractions import Fraction

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import shares

FILLS = "agent string, s long, seq long, product_id string, side string, price double, frac double"


def log(x):
    return math.log(x.numerator) - math.log(x.denominator)


def loop(rows, opening=1000):
    """``seq: (action, log_size, avg_price, gain, log_balance, realized_share)``."""
    cash, won, held, out = {}, {}, {}, {}
    for agent, _, seq, product, side, price, frac in rows:
        b, r = cash.get(agent, Fraction(opening)), won.get(agent, Fraction(0))
        size, cost = held.get((agent, product), (Fraction(0), Fraction(0)))
        gain = None
        if side == "BUY":
            spent = b * min(Fraction(frac or 0), Fraction(0.95))
            if spent < 1 or not price > 0:
                continue
            b, size, cost = b - spent, size + spent / Fraction(price), cost + spent
            held[agent, product] = size, cost
        elif size:
            del held[agent, product]
            b, r, gain = b + size * Fraction(price), r + size * Fraction(price) - cost, float(size * Fraction(price) / cost - 1)
        else:
            continue
        cash[agent], won[agent] = b, r
        out[seq] = (side, log(size), float(cost / size), gain, log(b), float(r / b))
    return out


def fill_rows(n, low, high, seed=5, agents="xy"):
    rng = random.Random(seed)
    return [(rng.choice(agents), 37 * i, i, rng.choice("pqr"), rng.choice(["BUY", "BUY", "SELL"]), rng.choice([rng.uniform(low, high)] * 9 + [0.0]), rng.choice([None, 0.0, 0.05, 0.3, 1.0])) for i in range(n)]


def same(df, want):
    got = {r.seq: r for r in df.collect()}
    assert got.keys() == want.keys()
    for seq, (action, size, avg, gain, balance, share) in want.items():
        r = got[seq]
        assert r.action == action and (r.gain is None or math.isnan(r.gain)) == (gain is None)
        assert (r.log_size, r.avg_price, r.log_balance, r.realized_share) == pytest.approx((size, avg, balance, share), rel=1e-9, abs=1e-9)
        assert gain is None or r.gain == pytest.approx(gain, rel=1e-9, abs=1e-9)


def spread(spark, rows):
    return spark.createDataFrame(rows, FILLS).withColumn("ts", F.timestamp_seconds("s")).drop("s")


def test_buys_depend_on_the_balance_of_the_moment(spark):
    """A fill's amount is a share of what earlier fills of other products left; the doubles end at 1e308."""
    rows = [("a", i, i, "pq"[i // 2 % 2], "SELL" if i % 2 else "BUY", 1.0 + 9 * (i % 2), 0.9) for i in range(800)]
    want = loop(rows)
    assert max(w[4] for w in want.values()) > math.log(1e308)
    same(shares.share_book(spread(spark, rows), rows=16, fan=4), want)


@pytest.mark.parametrize("low,high,fan", [(1, 60, 4), (9, 11, 4), (9, 11, 512)])
def test_share_book_matches_a_loop(spark, low, high, fan):
    """Also where buys fall below the least amount, so that the agent's blocks are walked in order."""
    rows = fill_rows(900, low, high)
    want = loop(rows)
    assert len(want) > 100
    same(shares.share_book(spread(spark, rows), rows=16, fan=fan), want)


def test_blocks_composed_in_a_tree_carry_the_state():
    """Matrices joined pairwise lead to the state of a walk, and say so when a buy may be too small."""
    import pickle

    rows = [r for r in fill_rows(300, 20, 90, agents="x") if r[5] > 0 and (r[4] == "SELL" or r[6])]
    frame = pd.DataFrame(rows, columns=["agent", "s", "seq", "product_id", "side", "price", "frac"])
    frame["frac"] = frame["frac"].fillna(0.0).clip(upper=0.3)
    start = 1e9, 0.0, 0, {}
    blocks = [pickle.dumps(shares.matrix(frame.iloc[i: i + 10])) for i in range(0, len(frame), 10)]
    whole = blocks[0]
    for block in blocks[1:]:
        whole = shares.compose(whole, block, 0)
    cash, won, e, held = pickle.loads(shares.step(pickle.dumps(start), whole, 0))
    _, (cash2, won2, e2, held2) = shares.walk(frame, start)
    assert (math.log(cash) + e * shares.LN2, won / cash) == pytest.approx((math.log(cash2) + e2 * shares.LN2, won2 / cash2), rel=1e-9)
    assert held.keys() == held2.keys()
    assert shares.step(pickle.dumps((1.0, 0.0, 0, {})), whole, 0) == b""
