"""Shared pieces of the SQL equivalents: domain tables as common table expressions."""

from __future__ import annotations


def r(expr: str, digits: int = 6) -> str:
    """Report rounding without negative zero."""
    return f"CASE WHEN abs({expr}) < {0.5 * 10.0 ** -digits!r} THEN 0.0::DOUBLE ELSE round(({expr})::DOUBLE, {digits}) END"


def single(expr: str) -> str:
    """Single precision without negative zero, for values that may sit between two roundings."""
    return f"CASE WHEN abs({expr}) < 5e-10 THEN 0.0::DOUBLE ELSE ({expr})::FLOAT::DOUBLE END"


def cols(**exprs: str) -> str:
    return ", ".join(f"{r(e)} AS {n}" for n, e in exprs.items())


def ticks(key: str = "event_type") -> str:
    return (
        f"ticks AS (SELECT CAST({key} AS VARCHAR) AS product_id, ts, event_id AS seq, value AS price, "
        "CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume, epoch_us(ts) // 1000000 AS s FROM events)"
    )


def bars(seconds: int = 3600, name: str = "bars") -> str:
    return (
        f"{name} AS (SELECT product_id, s // {seconds} * {seconds} AS start, arg_min(price, (ts, seq)) AS open, "
        "max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close, sum(volume) AS volume "
        "FROM ticks GROUP BY ALL)"
    )


TRADES = """trades AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag AS agent, l_linestatus || p_brand AS product_id,
         o_orderdate AS opened_at, l_shipdate AS closed_at, l_quantity AS size, l_extendedprice AS usd_open,
         l_extendedprice * (l_discount - 0.05::DOUBLE) AS pnl,
         l_extendedprice * (l_discount - 0.05::DOUBLE) / l_extendedprice * 100 AS pct_pnl,
         o_orderpriority AS trigger_close
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  WHERE l_shipdate >= o_orderdate)"""

LEDGER = TRADES + """, ledger AS (
  SELECT *, 1000 + sum(pnl) OVER (PARTITION BY agent ORDER BY closed_at, l_orderkey, l_linenumber, l_partkey, l_suppkey
                                  ROWS UNBOUNDED PRECEDING) AS balance_after FROM trades)"""

SCANS = ticks() + ", scans AS (SELECT product_id, ts AS scanned_at, seq, s, price, volume / 100 AS model_prob FROM ticks)"

PRODUCTS = """products AS (
  SELECT p_partkey AS product_id, p_brand AS base, p_name AS name,
         CASE WHEN p_size % 3 = 0 THEN 'EUR' ELSE 'USD' END AS quote,
         CASE WHEN p_size % 7 = 0 THEN 'delisted' ELSE 'online' END AS status,
         p_size % 11 = 0 AS is_disabled, p_retailprice AS price, coalesce(v, 0.0) AS volume_24h
  FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS v FROM lineitem GROUP BY 1) ON p_partkey = l_partkey)"""


def frames(lookback: int) -> str:
    """Per bar: position, neighbours, and the slice each recursive indicator is seeded on."""

    def lst(col: str, n: int, name: str) -> str:
        return f"list({col}) FILTER (WHERE {col} IS NOT NULL) OVER (v ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS {name}"

    return (
        "s0 AS (SELECT *, row_number() OVER v - 1 AS idx, lag(close) OVER v AS pc, close - lag(close) OVER v AS diff, "
        "high - lag(high) OVER v AS up, lag(low) OVER v - low AS dn, (high + low + close) / 3 AS tp, "
        "CASE WHEN lag(close) OVER v IS NULL THEN NULL ELSE greatest(high - low, abs(high - lag(close) OVER v), abs(low - lag(close) OVER v)) END AS tr "
        "FROM bars WINDOW v AS (PARTITION BY product_id ORDER BY start)), "
        "s1 AS (SELECT *, CASE WHEN up > dn THEN greatest(up, 0) WHEN up IS NOT NULL THEN 0.0 END AS dmp, "
        "CASE WHEN dn > up THEN greatest(dn, 0) WHEN up IS NOT NULL THEN 0.0 END AS dmm, lag(tp) OVER v AS ptp, "
        "CASE WHEN close > pc THEN volume WHEN close < pc THEN -volume ELSE 0.0 END AS sv "
        "FROM s0 WINDOW v AS (PARTITION BY product_id ORDER BY start)), "
        "f AS (SELECT *, " + ", ".join([
            lst("close", lookback, "c"), lst("diff", lookback - 1, "d"), lst("tr", lookback - 1, "trs"),
            lst("dmp", lookback - 1, "dps"), lst("dmm", lookback - 1, "dms"), lst("sv", lookback, "svs"),
        ]) + " FROM s1 WINDOW v AS (PARTITION BY product_id ORDER BY start))"
    )


def ema_end(a: str, n: int) -> str:
    k = 2.0 / (n + 1)
    return f"list_reduce({a}[{n + 1}:], lambda e, x: x * {k!r}::DOUBLE + e * {1 - k!r}::DOUBLE, list_avg({a}[1:{n}]))"


def path(a: str, n: int, gain: float) -> str:
    """Trajectory of the seeded smoothing of list ``a``."""
    return (
        f"list_reduce({a}[{n + 1}:], lambda acc, x: {{'e': x * {gain!r}::DOUBLE + acc.e * {1 - gain!r}::DOUBLE, "
        f"'o': list_append(acc.o, x * {gain!r}::DOUBLE + acc.e * {1 - gain!r}::DOUBLE)}}, "
        f"{{'e': list_avg({a}[1:{n}]), 'o': [list_avg({a}[1:{n}])]}}).o"
    )


def wilder_end(a: str, n: int) -> str:
    return f"list_reduce({a}[{n + 1}:], lambda e, x: (e * {n - 1} + x) / {n}, list_avg({a}[1:{n}]))"


def gains(a: str = "d") -> str:
    return f"list_transform({a}, lambda x: greatest(x, 0.0))"


def losses(a: str = "d") -> str:
    return f"list_transform({a}, lambda x: greatest(-x, 0.0))"


def rsi(n: int = 14, d: str = "d", bars_seen: str = "idx + 1") -> str:
    g, l = wilder_end(gains(d), n), wilder_end(losses(d), n)
    return f"CASE WHEN {bars_seen} < {n + 1} THEN 50.0 WHEN {l} = 0 THEN 100.0 ELSE 100 - 100 / (1 + {g} / {l}) END"


def over(expr: str, n: int) -> str:
    return f"{expr} OVER (PARTITION BY product_id ORDER BY start ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def line_list(c: str = "c") -> str:
    """MACD line of the slice as a list."""
    return f"list_transform(list_zip(({path(c, 5, 2 / 6)})[9:], {path(c, 13, 2 / 14)}), lambda z: z[1] - z[2])"
