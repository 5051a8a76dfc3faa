"""Plain-Python definitions used as brute-force truth in the tests."""

import math


def mean(xs):
    return sum(xs) / len(xs)


def ema(xs, p):
    if len(xs) < p:
        return [xs[-1]] * len(xs)
    out = [mean(xs[:p])]
    for x in xs[p:]:
        out.append(out[-1] + 2 / (p + 1) * (x - out[-1]))
    return out


def wilder(xs, p):
    out = [mean(xs[:p])]
    for x in xs[p:]:
        out.append(out[-1] + (x - out[-1]) / p)
    return out


def rsi(cs, p=14):
    if len(cs) <= p:
        return 50.0
    d = [b - a for a, b in zip(cs, cs[1:])]
    g, l = wilder([max(x, 0) for x in d], p)[-1], wilder([max(-x, 0) for x in d], p)[-1]
    return 100.0 if l == 0 else 100 * g / (g + l)


def macd(cs, f=5, s=13, g=3):
    if len(cs) < s + g:
        return 0.0, 0.0, 0.0
    a, b = ema(cs, f), ema(cs, s)
    line = [x - y for x, y in zip(a[-len(b):], b)]
    sig = ema(line, g)[-1]
    return line[-1], sig, line[-1] - sig


def true_ranges(h, l, c):
    return [max(h[i] - l[i], abs(h[i] - c[i - 1]), abs(l[i] - c[i - 1])) for i in range(1, len(c))]


def atr(h, l, c, p=14):
    return wilder(true_ranges(h, l, c), p)[-1] if len(c) > p else 0.0


def adx(h, l, c, p=14):
    if len(c) < 2 * p + 1:
        return 20.0, 0.0, 0.0
    up = [b - a for a, b in zip(h, h[1:])]
    dn = [a - b for a, b in zip(l, l[1:])]
    tr = wilder(true_ranges(h, l, c), p)
    pl = wilder([u if u > d and u > 0 else 0.0 for u, d in zip(up, dn)], p)
    mi = wilder([d if d > u and d > 0 else 0.0 for u, d in zip(up, dn)], p)
    pd = [100 * x / t if t > 0 else 0.0 for x, t in zip(pl, tr)]
    md = [100 * x / t if t > 0 else 0.0 for x, t in zip(mi, tr)]
    dx = [100 * abs(x - y) / (x + y) if x + y > 0 else 0.0 for x, y in zip(pd, md)]
    return wilder(dx, p)[-1], pd[-1], md[-1]


def stoch_rsi(cs, p=14):
    if len(cs) < 2 * p:
        return 50.0, 50.0
    rs = [rsi(cs[: i + 1], p) for i in range(p, len(cs))]
    st = []
    for i in range(p - 1, len(rs)):
        w = rs[i - p + 1: i + 1]
        st.append(100 * (rs[i] - min(w)) / (max(w) - min(w)) if max(w) > min(w) else 50.0)
    k = ema(st, 3) if len(st) >= 3 else st
    d = ema(k, 3) if len(k) >= 3 else k
    return k[-1], d[-1]


def hurst(cs):
    n = len(cs)
    if n < 50:
        return 0.5
    pts = []
    for lag in (max(2, n // 8), max(4, n // 4), max(8, n // 2), n):
        sub = cs[-lag:]
        m = mean(sub)
        acc, path = 0.0, []
        for x in sub:
            acc += x - m
            path.append(acc)
        sd = math.sqrt(mean([(x - m) ** 2 for x in sub]))
        if len(sub) >= 4 and sd > 0:
            pts.append((math.log(lag), math.log((max(path) - min(path)) / sd)))
    if len(pts) < 2:
        return 0.5
    mx, my = mean([p[0] for p in pts]), mean([p[1] for p in pts])
    slope = sum((x - mx) * (y - my) for x, y in pts) / sum((x - mx) ** 2 for x, _ in pts)
    return min(1.0, max(0.0, slope))


def obv(cs, vs):
    out = [0.0]
    for i in range(1, len(cs)):
        out.append(out[-1] + (vs[i] if cs[i] > cs[i - 1] else -vs[i] if cs[i] < cs[i - 1] else 0.0))
    return out


def slope(ys):
    n = len(ys)
    mx, my = (n - 1) / 2, mean(ys)
    return sum((i - mx) * (y - my) for i, y in enumerate(ys)) / sum((i - mx) ** 2 for i in range(n))


def obv_slope(cs, vs, points=10):
    if len(cs) < points + 1:
        return 0.0
    w = obv(cs, vs)[-points:]
    return max(-1.0, min(1.0, slope(w) * 10 / max(abs(mean(w)), 1.0)))


def entropy(cs, window=20, bins=10):
    if len(cs) < window + 1:
        return 0.5
    r = [math.log(b / a) for a, b in zip(cs[-window - 1:], cs[-window:])]
    lo, hi = min(r), max(r)
    if lo == hi:
        return 0.0
    counts = [0] * bins
    for x in r:
        counts[min(int((x - lo) / ((hi - lo) / bins)), bins - 1)] += 1
    h = -sum(c / window * math.log2(c / window) for c in counts if c)
    return round(h / math.log2(bins), 4)


def mfi(h, l, c, v, p=14):
    if len(c) < p + 1:
        return 50.0
    tp = [(a + b + x) / 3 for a, b, x in zip(h, l, c)]
    pos = sum(tp[i] * v[i] for i in range(len(c) - p, len(c)) if tp[i] > tp[i - 1])
    neg = sum(tp[i] * v[i] for i in range(len(c) - p, len(c)) if tp[i] <= tp[i - 1])
    return 100.0 if neg == 0 else 100 - 100 / (1 + pos / neg)
