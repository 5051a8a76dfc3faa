"""Declared schemas of the domain tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _L, _TS, _B, _I = (
    T.StringType(), T.DoubleType(), T.LongType(), T.TimestampType(), T.BooleanType(), T.IntegerType(),
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


BAR = _struct(product_id=_S, start=_TS, open=_D, high=_D, low=_D, close=_D, volume=_D)
BAR_TABLE = T.StructType(BAR.fields + [T.StructField("granularity", _S), T.StructField("day", T.DateType())])
TICK = _struct(product_id=_S, ts=_TS, seq=_L, price=_D, volume=_D)
LEVELS = T.ArrayType(_struct(price=_D, size=_D))
ORDER_BOOK = _struct(product_id=_S, bids=LEVELS, asks=LEVELS)
TICKER_MESSAGE = _struct(
    channel=_S,
    timestamp=_TS,
    events=T.ArrayType(_struct(
        type=_S,
        tickers=T.ArrayType(_struct(
            product_id=_S, price=_S, close=_S, best_bid=_S, best_ask=_S,
            volume_24_h=_S, price_percent_chg_24_h=_S,
        )),
    )),
)
TRADE = _struct(
    trade_id=_L, agent=_S, product_id=_S, entry_price=_D, exit_price=_D, size=_D, usd_open=_D,
    usd_close=_D, pnl=_D, pct_pnl=_D, hold_secs=_L, trigger_open=_S, trigger_close=_S,
    balance_after=_D, opened_at=_TS, closed_at=_TS,
)
MACRO = _struct(
    ts=_TS, funding_rate=_D, ls_ratio=_D, oi_usd=_D, oi_trend=_D, btc_dominance=_D,
    premium=_D, fetch_ok=_B,
)
FILL = _struct(agent=_S, ts=_TS, seq=_L, product_id=_S, side=_S, price=_D, frac=_D, trigger=_S)
POSITION = _struct(size=_D, avg_price=_D, peak_pnl_usd=_D, atr_stop=_D, entry_time=_D, peak_price=_D)
POSITIONS = T.MapType(_S, POSITION)
