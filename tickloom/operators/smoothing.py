"""Seeded exponential smoothing over a bounded look-back as plain window sums.

The indicators smooth with ``s_i = a*s_{i-1} + g*x_i`` seeded by the mean of the first ``p``
values of an ``L``-row slice. Written as a fold that costs O(L) per row. The recursion is
linear, so with ``E`` any running solution of the same recursion inside the block,

    slice value = E[n] + a**d * (mean_p[n-d] - E[n-d]),    d = slice length - p

which is exact and needs one running sum, one ``lag`` and no array. ``E`` itself is
``g * a**pos * sum(x * a**-pos)``: terms grow towards the current row, so the sum keeps full
relative precision, and blocks of ``BLOCK_ROWS`` keep ``a**-pos`` inside the double range.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from tickloom.operators.layers import Layer, d, lag, rows, since_start


def ema_rate(period: int) -> float:
    return 2.0 / (period + 1)


def wilder_rate(period: int) -> float:
    return 1.0 / period


@dataclass
class Smoothed:
    """SQL of one smoothing: ``early`` feeds ``late``; ``value`` is null below ``period``."""

    early: Layer
    late: Layer
    running: str
    correction: str
    value: str


def smoothed(
    tag: str, x: str, period: int, gain: float, lookback: int,
    first_idx: int = 0, keys: Sequence[str] = ("product_id",),
) -> Smoothed:
    """Smooth ``x`` (named ``tag``) over slices of ``lookback`` of its values.

    ``first_idx`` is the series position of the first value: 1 for series of differences.
    """
    decay = d(1.0 - gain)
    base = f"__{tag}_{period}_{round(1 / gain * 2)}"
    seen = f"(idx - {first_idx} + 1)"
    running = f"({d(gain)} * pow({decay}, pos) * {base}_s)"
    gap = f"({base}_m - {running})"
    correction = f"CASE WHEN {seen} >= {lookback} THEN {base}_l{lookback} ELSE {base}_f END"
    return Smoothed(
        early={
            f"{base}_s": since_start(f"sum({x} * pow({decay}, -pos))", keys),
            f"{base}_m": rows(f"avg({x})", period, keys),
        },
        late={
            f"{base}_l{lookback}": lag(gap, lookback - period, keys),
            f"{base}_f": since_start(f"first(CASE WHEN {seen} = {period} THEN {gap} END, true)", keys),
        },
        running=running,
        correction=f"({correction})",
        value=f"CASE WHEN {seen} >= {period} THEN {running} + pow({decay}, least({seen}, {lookback}) - {period}) * ({correction}) END",
    )


def last_positive(x: str, keys: Sequence[str]) -> str:
    """Position of the latest row with ``x > 0`` (tells an exact zero from rounding noise)."""
    return since_start(f"last(CASE WHEN {x} > 0 THEN idx END, true)", keys)


def geometric_response(decay: float, offset: int, count: int, period: int, gain: float) -> list[float]:
    """Seeded smoothing of ``decay**(offset+0), decay**(offset+1), ...`` after 1..count values."""
    out: list[float] = []
    for j in range(count):
        v = decay ** (offset + j)
        if j < period:
            out.append((out[-1] * j if out else 0.0) / (j + 1) + v / (j + 1))
        else:
            out.append(out[-1] * (1 - gain) + v * gain)
    return out


@dataclass
class Macd:
    layers: list[Layer]
    line: str
    signal: str


def macd_parts(
    price: str, lookback: int, fast: int = 5, slow: int = 13, signal: int = 3,
    keys: Sequence[str] = ("product_id",),
) -> Macd:
    """MACD line and signal of a ``lookback``-bar slice; zeros below slow+signal bars.

    The line is the difference of two seeded EMAs; the signal line is a seeded EMA of it. By
    linearity it is the signal EMA of the running difference plus the response to the two
    seed corrections, a fixed function of the slice length.
    """
    kf, ks, kg = ema_rate(fast), ema_rate(slow), ema_rate(signal)
    f = smoothed("close", price, fast, kf, lookback, keys=keys)
    s = smoothed("close", price, slow, ks, lookback, keys=keys)
    # The line exists from bar ``slow`` on, so its own look-back is shorter by slow - 1.
    g = smoothed("macd", f"({f.running} - {s.running})", signal, kg, lookback - slow + 1, first_idx=slow - 1, keys=keys)
    count = lookback - slow + 1

    def response(decay: float, offset: int) -> str:
        values = geometric_response(decay, offset, count, signal, kg)
        return f"element_at(array({', '.join(d(v) for v in values)}), CAST(least(idx + 1, {lookback}) - {slow - 1} AS INT))"

    enough = f"idx + 1 >= {slow + signal}"
    return Macd(
        layers=[{**f.early, **s.early}, {**f.late, **s.late, **g.early}, g.late],
        line=f"CASE WHEN {enough} THEN ({f.value}) - ({s.value}) ELSE 0D END",
        signal=(
            f"CASE WHEN {enough} THEN ({g.value}) + {response(1 - kf, slow - fast)} * {f.correction} "
            f"- {response(1 - ks, 0)} * {s.correction} ELSE 0D END"
        ),
    )
