"""Fusing windowed columns.

An ``Indicator`` lists its intermediate columns in layers of SQL expressions: a layer may look
(through windows) at columns of earlier layers. ``with_indicators`` adds the layers of many
indicators side by side, so any number of them costs as many ``Window`` nodes as the deepest one
(four), over a single exchange and sort. Equal intermediate names mean equal expressions and are
computed once.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

Layer = dict[str, str]


@dataclass
class Indicator:
    outputs: Layer
    layers: list[Layer] = field(default_factory=list)


def d(value: float) -> str:
    """Double literal."""
    return f"{float(value)!r}D"


def clip(expr: str, low: float, high: float) -> str:
    """Bound an expression; null stays null."""
    return f"CASE WHEN ({expr}) IS NOT NULL THEN greatest({d(low)}, least({expr}, {d(high)})) END"


def _spec(keys: Sequence[str]) -> str:
    return f"PARTITION BY {', '.join(keys)}, block ORDER BY idx"


def rows(call: str, n: int, keys: Sequence[str]) -> str:
    """``call`` over the last ``n`` rows of the block."""
    return f"{call} OVER ({_spec(keys)} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def since_start(call: str, keys: Sequence[str]) -> str:
    """``call`` over the block up to the current row."""
    return f"{call} OVER ({_spec(keys)} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def lag(expr: str, n: int, keys: Sequence[str]) -> str:
    return f"lag({expr}, {n}) OVER ({_spec(keys)})"


def merge_layers(*parts: list[Layer]) -> list[Layer]:
    merged: list[Layer] = [{} for _ in range(max((len(p) for p in parts), default=0))]
    for part in parts:
        for depth, columns in enumerate(part):
            merged[depth].update(columns)
    return merged


def with_indicators(df: DataFrame, indicators: Iterable[Indicator]) -> DataFrame:
    indicators = list(indicators)
    own = df.columns
    known = set(own)
    for layer in merge_layers(*[i.layers for i in indicators]):
        fresh = {name: e for name, e in layer.items() if name not in known}
        if fresh:
            df = df.selectExpr("*", *[f"{e} AS {name}" for name, e in fresh.items()])
        known.update(fresh)
    outputs: Layer = {}
    for indicator in indicators:
        outputs.update(indicator.outputs)
    return df.selectExpr(*[c for c in own if c not in outputs], *[f"{e} AS {name}" for name, e in outputs.items()])
