"""The 27-channel windows against a plain-Python build of each window."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests import plain
from tickloom.operators import features

T = 60


def clip(x, lo, hi):
    return max(lo, min(hi, x))


def bollinger(cs):
    if len(cs) < 20:
        return 0.5
    w = cs[-20:]
    m = plain.mean(w)
    sd = math.sqrt(plain.mean([(x - m) ** 2 for x in w]))
    return clip((cs[-1] - (m - 2 * sd)) / (4 * sd), 0, 1) if sd > 0 else 0.5


def window(bars, ref, fast, funding):
    """27 lists of len(bars) values for one window of (start, o, h, l, c, v) bars."""
    n = len(bars)
    s, o, h, l, c, v = (list(x) for x in zip(*bars))
    lo, hi = min(c), max(c)
    ch = {i: [0.0] * n for i in range(27)}
    ch[0] = [(x - lo) / ((hi - lo) or 1.0) for x in c]
    ch[1] = [math.log10(max(x, 1.0)) / 10 for x in v]
    ch[2] = [(a - b) / max(x, 1e-9) for a, b, x in zip(h, l, c)]
    ch[3] = [clip((x - y) / max(abs(y), 1e-9), -1, 1) for x, y in zip(c, o)]
    ob = plain.obv(c, v)
    e9, e21 = plain.ema(c, 9), plain.ema(c, 21)
    for i in range(n):
        ch[4][i] = plain.rsi(c[max(0, i - 20): i + 1]) / 100
        if i >= 15:
            ch[5][i] = clip(plain.macd(c[: i + 1])[2] / max(abs(c[i]), 1) * 1000, -1, 1)
        if n >= 21 and i >= 8:
            ch[6][i] = clip((e9[i - 8] - c[i]) / c[i], -0.1, 0.1) / 0.1
        if n >= 21 and i >= 20:
            ch[7][i] = clip((e21[i - 20] - c[i]) / c[i], -0.1, 0.1) / 0.1
        ch[8][i] = bollinger(c[max(0, i - 22): i + 1])
        if i:
            ch[9][i] = clip((c[i] - c[i - 1]) / c[i - 1], -0.1, 0.1) / 0.1
        k = slice(max(0, i - 20), i + 1)
        ch[12][i] = plain.mfi(h[k], l[k], c[k], v[k]) / 100
        if i >= 10:
            w = ob[i - 10: i + 1]
            ch[13][i] = clip(plain.slope(w) * 10 / max(abs(plain.mean(w)), 1.0), -1, 1)
        ch[14][i] = plain.stoch_rsi(c[: i + 1])[0] / 100 if i >= 28 else 0.5
        if i >= 19:
            k = slice(i - 19, i + 1)
            vol = sum(v[k])
            tp = [(a + b + x) / 3 for a, b, x in zip(h[k], l[k], c[k])]
            vw = sum(a * b for a, b in zip(tp, v[k])) / vol if vol else c[i]
            ch[16][i] = clip((c[i] - vw) / vw / 0.05, -1, 1)
        if i >= 20:
            ra = [(c[j] - c[j - 1]) / c[j - 1] for j in range(i - 19, i + 1)]
            rb = [(ref[j] - ref[j - 1]) / ref[j - 1] for j in range(i - 19, i + 1)]
            ma, mb = plain.mean(ra), plain.mean(rb)
            da, db = math.sqrt(sum((x - ma) ** 2 for x in ra)), math.sqrt(sum((x - mb) ** 2 for x in rb))
            ch[21][i] = clip(sum((x - ma) * (y - mb) for x, y in zip(ra, rb)) / (da * db), -1, 1) if da and db else 0.0
        hour = s[i] // 3600 % 24
        ch[22][i], ch[23][i] = math.sin(hour * math.pi / 12), math.cos(hour * math.pi / 12)
    ch[15] = [plain.adx(h, l, c)[0] / 100] * n
    for i, x in zip((17, 18, 19), fast):
        ch[i] = [x] * n
    ch[20] = [clip(funding / 0.01, -1, 1)] * n
    return [[0.0] * (T - n) + ch[i] for i in range(27)]


def make(seed, n, base):
    rng = random.Random(seed)
    rows, c = [], base
    for i in range(n):
        prev, c = c, max(1.0, c * (1 + rng.gauss(0, 0.01)))
        rows.append((1_700_006_400 + 3600 * i, prev, max(prev, c) * 1.001, min(prev, c) * 0.999, c, float(rng.randint(0, 500))))
    return rows


def to_df(spark, product, rows):
    df = spark.createDataFrame([(product, *r) for r in rows], "product_id string, s long, open double, high double, low double, close double, volume double")
    return df.withColumn("start", F.timestamp_seconds("s")).drop("s")


@pytest.fixture(scope="module")
def data():
    return {"a": make(1, 620, 100.0), "b": make(2, 90, 3.0)}


@pytest.fixture(scope="module")
def inputs(spark, data):
    bars = to_df(spark, "a", data["a"]).unionByName(to_df(spark, "b", data["b"]))
    funding = spark.createDataFrame([(p, (1_700_006_400 + 28_800 * i) * 1000, 0.0001 * i) for p in "ab" for i in range(1, 60)], "product_id string, funding_time_ms long, rate double")
    return bars, to_df(spark, "ref", data["a"]), funding


def expected(data, product, i, size=T):
    rows = data[product][max(0, i - size + 1): i + 1]
    ref = [r[4] for r in data["a"]][max(0, i - size + 1): i + 1]
    return window(rows, ref, (0.5, 0.0, 0.0), 0.0001 * min(59, max(1, i // 8)))


def test_dataset_windows(spark, data, inputs):
    got = {(r.product_id, r.idx): r for r in features.dataset(*inputs, precision="double").collect()}
    assert len(got) > 400 and all(59 <= i for _, i in got)
    # Samples around the block edge at 512 and at both ends of the series.
    picks = [k for k in got if k[1] in range(505, 520) or k[1] < 63 or k[1] > 610 or k[0] == "b"]
    assert len(picks) > 20
    for key in picks:
        want = expected(data, *key)
        for c in range(27):
            assert got[key].channels[c] == pytest.approx(want[c], abs=1e-7), (key, c)


def test_short_windows_are_left_padded(spark, data, inputs):
    bars, ref, funding = inputs
    out = features.feature_windows(bars, ref, funding, pad_short=True).where("idx < 60 and product_id = 'b'")
    got = {r.idx: r.channels for r in out.collect()}
    assert sorted(got) == list(range(60))
    for i in (0, 5, 14, 15, 20, 21, 28, 29, 45, 58, 59):
        want = expected(data, "b", i)
        for c in range(27):
            assert got[i][c] == pytest.approx(want[c], abs=1e-5), (i, c)


def test_masking_and_incremental_status(spark, data, inputs):
    rows = features.masked(features.dataset(*inputs).limit(3)).collect()
    assert all(not any(r.channels[c]) for r in rows for c in features.MASKED) and any(rows[0].channels[0])
    marks = spark.createDataFrame([("a", data["a"][0][0], 600)], "product_id string, s long, last_n long").withColumn("first_start", F.timestamp_seconds("s")).drop("s")
    got = {r.product_id: (r.status, r.from_idx) for r in features.dataset_status(inputs[0], marks).collect()}
    assert got == {"a": ("append", 596), "b": ("rebuild", 59)}
    short = features.dataset_status(inputs[0].where("product_id = 'b'").limit(50), marks).first()
    assert (short.status, short.from_idx) == ("skip", None)


def test_fast_features_need_fourteen_bars(spark, data):
    rows = [(s - i * 3300, *rest) for i, (s, *rest) in enumerate(data["b"])]
    got = features.fast_features(to_df(spark, "b", rows)).orderBy("fast_start").collect()
    assert all((r.fast_rsi, r.velocity, r.volume_z) == (0.5, 0.0, 0.0) for r in got[:13])
    c, v = [r[4] for r in rows], [r[5] for r in rows]
    for i in (13, 14, 40, 80):
        assert got[i].fast_rsi == pytest.approx(plain.rsi(c[max(0, i - 14): i + 1], 12) / 100)
        assert got[i].velocity == pytest.approx(clip((c[i] - c[i - 12]) / c[i - 12] / 12 / 0.005, -1, 1))
        w = v[max(0, i - 59): i + 1]
        sd = math.sqrt(plain.mean([(x - plain.mean(w)) ** 2 for x in w]))
        assert got[i].volume_z == pytest.approx(clip((v[i] - plain.mean(w)) / sd / 3, -1, 1))
