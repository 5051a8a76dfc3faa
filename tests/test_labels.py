"""Labels, weights and folds on hand-made bars and against loops."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import labels


def bars_of(spark, rows, product="p"):
    data = [(product, 1_700_000_000 + 3600 * i, *map(float, ohlc), 1.0) for i, ohlc in enumerate(rows)]
    df = spark.createDataFrame(data, "product_id string, s long, open double, high double, low double, close double, volume double")
    return df.withColumn("start", F.timestamp_seconds("s")).drop("s")


FLAT = (100.0, 100.1, 99.9, 100.0)


@pytest.mark.parametrize("after, expected", [
    ([(100, 101.5, 100, 101.2), FLAT, FLAT, FLAT], 1.0),                      # upper barrier first
    ([FLAT, (100, 100.2, 98.5, 99.0), FLAT, FLAT], 0.0),                      # lower barrier first
    ([(100, 102, 98, 100.5), FLAT, FLAT, FLAT], 1.0),                         # both in one bar, close above
    ([(100, 102, 98, 99.5), FLAT, FLAT, FLAT], 0.0),                          # both in one bar, close below
    ([(100, 102, 98, 100.0), (100, 103, 100, 102), FLAT, FLAT], None),        # both in one bar, tie stays unlabelled
    ([FLAT, FLAT, FLAT, (100, 100.8, 100, 100.7)], 1.0),                      # time barrier up
    ([FLAT, FLAT, FLAT, (100, 100, 99.2, 99.4)], 0.0),                        # time barrier down
    ([FLAT, FLAT, FLAT, (100, 100.3, 99.9, 100.2)], None),                    # inside the dead zone
    ([FLAT, (100, 100.8, 99.9, 100.5)], 1.0),                                 # series ends before the horizon
    ([], None),
])
def test_triple_barrier_cases(spark, after, expected):
    df = labels.labelled(bars_of(spark, [FLAT, *after]), seq_len=1)
    assert df.where("idx = 0").first().label == expected


def test_flat_entry_price_is_unlabelled(spark):
    df = labels.labelled(bars_of(spark, [(0.0, 0.0, 0.0, 0.0), FLAT, FLAT]), seq_len=1)
    assert df.where("idx = 0").first().label is None


def plain_uniqueness(idx, h, n, first):
    cover = [0] * n
    for i in idx:
        for t in range(i + first, i + h + 1):
            if t < n:
                cover[t] += 1
    return {i: (lambda ts: sum(1 / cover[t] for t in ts) / len(ts) if ts else 0.0)([t for t in range(i + first, i + h + 1) if t < n]) for i in idx}


@pytest.mark.parametrize("include_entry", [False, True])
def test_uniqueness_matches_the_definition(spark, include_entry):
    rng = random.Random(5)
    rows, c = [], 100.0
    for _ in range(700):
        c *= 1 + rng.gauss(0, 0.004)
        rows.append((c, c * 1.002, c * 0.998, c))
    got = {r.idx: r.weight for r in labels.labelled(bars_of(spark, rows), seq_len=20, include_entry=include_entry).where("is_sample").collect()}
    want = plain_uniqueness(sorted(got), 4, 700, 0 if include_entry else 1)
    assert len(got) > 300
    for i, w in want.items():
        assert got[i] == pytest.approx(w, abs=1e-12)


def plain_folds(idx, k, h, embargo):
    n, half = len(idx), len(idx) // 2
    size = max(1, (n - half) // k)
    blocks = [(half + j * size, n if j == k - 1 else half + (j + 1) * size) for j in range(k)]
    out = set()
    for f, (lo, hi) in enumerate(blocks):
        if lo >= min(hi, n):
            continue
        out |= {(idx[p], f, "val") for p in range(lo, hi)}
        for p in range(lo):
            if idx[p] + h >= idx[lo]:
                continue
            if any(idx[b - 1] < idx[p] <= idx[b - 1] + embargo for _, b in blocks[:f]):
                continue
            out.add((idx[p], f, "train"))
    return out


@pytest.mark.parametrize("idx", [list(range(100)), list(range(0, 240, 3)), [1, 5, 9, 30, 31, 32, 60]])
def test_walk_forward_matches_a_loop(spark, idx):
    df = spark.createDataFrame([("p", i) for i in idx], "product_id string, idx long")
    placed = labels.sample_positions(df, width=16)
    got = {(r.idx, r.fold, r.role) for r in labels.walk_forward(placed, 3, 4, 4).collect()}
    assert got == plain_folds(idx, 3, 4, 4)


def test_split_balance_and_smoothing(spark):
    df = spark.createDataFrame([(i, float(i % 4 == 0)) for i in range(100)], "i long, label double").withColumn("start", F.timestamp_seconds("i"))
    split = labels.time_split(df, "start")
    assert split.where("split = 'val'").agg(F.min("i"), F.count("*")).first()[:] == (80, 20)
    balance = labels.class_balance(df).first()
    assert (balance.n_pos, balance.n_neg, balance.pos_weight) == (25, 75, 3.0)
    assert labels.class_balance(df.where("label = 1")).first().pos_weight == 1.0


def test_fingerprint_changes_with_data_and_parameters(spark):
    a = bars_of(spark, [FLAT] * 5)
    b = bars_of(spark, [FLAT] * 4 + [(100, 101, 99, 100.5)])
    prints = [labels.fingerprint(x, seq_len=s).first()[0] for x, s in ((a, 60), (a, 60), (b, 60), (a, 61))]
    assert prints[0] == prints[1] and len(set(prints)) == 3
