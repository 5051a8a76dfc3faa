"""Scans of composed state maps: what state a long series is in before each of its blocks.

A block of a series turns the state before it into the state after it. When such maps can be composed into maps of the same size, a
series needs no walk from its start: every block gives its map, maps are composed in groups of ``fan``, groups of groups
again, and the states come back down the same tree. No task holds more than ``fan`` maps of a key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.session import materialize

C = F.col
FAN = 512


def cogrouped(left: DataFrame, right: DataFrame, by: Sequence[str], run: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType) -> DataFrame:
    """Groups of two frames side by side, also where one is derived from the other."""
    a, b = (df.select(*[C(c).alias(c) for c in df.columns]).groupBy(*by) for df in (left, right))
    return a.cogroup(b).applyInArrow(run, schema)


def carried_states(
    maps: DataFrame, keys: Sequence[str], compose: Callable[[bytes, bytes, int], bytes], step: Callable[[bytes, bytes, int], bytes], start: bytes,
    fan: int = FAN, backward: bool = False,
) -> DataFrame:
    """``keys, block, state``: the state before every block, or after it when states run ``backward``.

    ``maps``: keys, ``block`` (long, rising along the series, gaps allowed) and ``map`` (binary). ``step(state, map, block)`` applies a map,
    ``compose(first, second, block)`` joins the map of a block and what comes after it, ``block`` being the second one's number on its
    own level of the tree. ``start`` is the state at the series' open end.
    """
    keys = list(keys)
    fields = [maps.schema[k] for k in keys] + [T.StructField("block", T.LongType())]
    states = T.StructType(fields + [T.StructField("state", T.BinaryType())])

    def walk(table: pa.Table, state: bytes) -> pa.Table:
        order = np.argsort(table.column("block").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        rows = list(zip(table.column("block").to_pylist(), table.column("map").to_pylist()))
        found = []
        for block, packed in reversed(rows) if backward else rows:
            found.append(state)
            state = step(state, packed, block)
        return table.select([*keys, "block"]).append_column("state", pa.array(found[::-1] if backward else found, pa.binary()))

    low, high = maps.agg(F.min("block"), F.max("block")).first()
    if low is None or high - low < fan:
        return maps.groupBy(*keys).applyInArrow(lambda table: walk(table, start), states)

    def joined(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        rows = list(zip(table.column("block").to_pylist(), table.column("map").to_pylist()))
        whole = rows[0][1]
        for block, packed in rows[1:]:
            whole = compose(whole, packed, block)
        first = table.slice(0, 1)
        return first.select(keys).append_column("block", first.column("__group")).append_column("map", pa.array([whole], pa.binary()))

    grouped = maps.withColumn("__group", F.floor(C("block") / fan))
    upper = grouped.groupBy(*keys, "__group").applyInArrow(joined, T.StructType(fields + [T.StructField("map", T.BinaryType())]))
    above = carried_states(materialize(upper), keys, compose, step, start, fan, backward)
    above = above.select(*keys, C("block").alias("__group"), "state")

    def below(rows: pa.Table, carry: pa.Table) -> pa.Table:
        return walk(rows, carry.column("state")[0].as_py())

    by = [*keys, "__group"]
    return cogrouped(grouped, above, by, below, states)
