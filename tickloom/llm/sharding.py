"""Sharding by histogram sort: exact byte counts below probe keys, refined until the splitters fit, then one exchange."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import staged, table, text_or_empty
from tickloom.llm.registry import query

C = F.col
LOW, HIGH = -(2**63), 2**63
#: Probes of one round over all open splitters, and the most for one of them.
PROBES, PROBES_EACH = 65536, 256


@dataclass
class Splitter:
    """A boundary key (h1, h2) below which ``target`` bytes should lie; the bracket that holds it, with what lies below its ends."""

    target: float
    tolerance: float
    low: tuple[int, int] = (LOW, LOW)
    high: tuple[int, int] = (HIGH, LOW)
    low_below: tuple[int, int] = (0, 0)  # bytes, rows
    high_below: tuple[int, int] = (0, 0)
    done: bool = False

    def settle(self) -> None:
        """Done if an end of the bracket is near enough, or the bracket cannot be cut further."""
        one_row = self.high_below[1] - self.low_below[1] <= 1
        closed = self.low[0] == self.high[0] and self.high[1] - self.low[1] <= 1
        self.done = one_row or closed or min(abs(self.target - self.low_below[0]), abs(self.high_below[0] - self.target)) <= self.tolerance

    def probes(self, n: int) -> list[tuple[int, int]]:
        """Evenly spaced keys in the bracket: over h1 until a single h1 is left, then over that group's h2."""
        (a, b), (c, d) = self.low, self.high
        if c - a > 1:
            step = max(1, -(-(c - a) // n))
            return [(x, LOW) for x in range(a + step, c, step)]
        if c != a:  # bracket is the group of h1 = a, up to the next h1
            d = HIGH
        step = max(1, -(-(d - b) // n))
        return [(a, x) for x in range(b + step, d, step)]

    def boundary(self) -> tuple[tuple[int, int], int]:
        near = abs(self.target - self.low_below[0]) <= abs(self.high_below[0] - self.target)
        return (self.low, self.low_below[1]) if near else (self.high, self.high_below[1])


def _place(h1: np.ndarray, h2: np.ndarray, keys: list[tuple[int, int]]) -> np.ndarray:
    """How many of the sorted ``keys`` are <= each row's (h1, h2)."""
    first = np.array([min(k[0], HIGH - 1) for k in keys], np.int64)
    second = np.array([min(k[1], HIGH - 1) for k in keys], np.int64)
    lo, hi = np.searchsorted(first, h1, "left"), np.searchsorted(first, h1, "right")
    tied = np.flatnonzero(lo < hi)
    for a, b in np.unique(np.stack([lo[tied], hi[tied]], 1), axis=0) if len(tied) else []:
        own = tied[(lo[tied] == a) & (hi[tied] == b)]
        lo[own] = a + np.searchsorted(second[a:b], h2[own], "right")
    return lo


def _histogram(keyed: DataFrame, probes: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows below every probe; each task sends one row a bucket it has."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for frame in batches:
            at = _place(frame["h1"].to_numpy(), frame["h2"].to_numpy(), probes)
            np.add.at(size, at, frame["size"].to_numpy())
            rows += np.bincount(at, minlength=len(rows))
        full = np.flatnonzero(rows)
        yield pd.DataFrame({"bucket": full, "bytes": size[full], "rows": rows[full]})

    found = keyed.select("h1", "h2", "size").mapInPandas(count, "bucket long, bytes long, rows long")
    size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for r in found.groupBy("bucket").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).collect():
        size[r["bucket"]], rows[r["bucket"]] = r["bytes"], r["rows"]
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


def find_splitters(keyed: DataFrame, targets: list[tuple[float, float]], total: tuple[int, int]) -> list[Splitter]:
    """Refine one bracket a (target, tolerance) until every splitter is near enough or cannot be cut further."""
    splitters = [Splitter(t, tol, high_below=total) for t, tol in targets]
    for s in splitters:
        s.settle()
    while still := [s for s in splitters if not s.done]:
        each = max(2, min(PROBES_EACH, PROBES // len(still)))
        probes = sorted({p for s in still for p in s.probes(each)})
        size, rows = _histogram(keyed, probes)
        for s in still:
            below = np.searchsorted(size, s.target, "right")  # probes with at most the target below them
            before = (s.low, s.high)
            if below > 0 and probes[below - 1] > s.low:
                s.low, s.low_below = probes[below - 1], (int(size[below - 1]), int(rows[below - 1]))
            if below < len(probes) and probes[below] < s.high:
                s.high, s.high_below = probes[below], (int(size[below]), int(rows[below]))
            s.settle()
            s.done |= before == (s.low, s.high)
    return splitters


def shard(docs: DataFrame, shards: int = 8, tolerance: float = 0.0025, part_bytes: int = 64 << 20, part_rows: int = 250_000) -> DataFrame:
    """Put every document into one of ``shards`` of near-equal bytes, equal texts side by side.

    Returns ``doc_id, size, text_crc32, shard, part, slot``. Size is the text's UTF-8 bytes (null: none) plus 1. Documents are
    sorted by a key of two hashes, of the text and of doc_id, so copies of a text are neighbours; a shard boundary cuts a group
    of copies only if no boundary between groups is near enough. Every boundary lies within ``tolerance`` of a shard's bytes, or half
    a document, of its even place. Each shard is cut by further splitters into parts that one task can
    sort; a group of copies of any size is split over parts by the second hash.

    Null doc_ids hash alike; rows equal in doc_id and text stay together. An empty table gives no rows.
    """
    text = text_or_empty()
    keyed = staged(docs.select(
        C("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h1"), F.xxhash64("doc_id").alias("h2")), "keyed")
    total = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    size, rows = int(total[0]), int(total[1])
    parts = max(1, -(-size // (shards * part_bytes)), -(-rows // (shards * part_rows)))
    n, share = shards * parts, size / shards
    # Boundaries inside a shard only balance tasks, so they may lie a tenth of a part off.
    targets = [(size * j / n, share * (tolerance if j % parts == 0 else max(tolerance, 0.1 / parts))) for j in range(1, n)]
    ends = [s.boundary() for s in find_splitters(keyed, targets, (size, rows))]
    keys, below = [k for k, _ in ends], [0, *(r for _, r in ends)]
    for j in range(1, len(keys)):  # loose inner boundaries never pass the next one
        if keys[j] < keys[j - 1]:
            keys[j], below[j + 1] = keys[j - 1], below[j]
    first = [below[j] - below[j // parts * parts] for j in range(n)]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            part = _place(frame["h1"].to_numpy(), frame["h2"].to_numpy(), keys) if keys else np.zeros(len(frame), np.int64)
            yield frame.assign(part=part, shard=part // parts, start=np.asarray(first, np.int64)[part])

    placed = keyed.mapInPandas(place, "doc_id long, size long, text_crc32 long, h1 long, h2 long, part int, shard int, start long")
    order = Window.partitionBy("part").orderBy("h1", "h2", "doc_id")
    return placed.select("doc_id", "size", "text_crc32", "shard", "part", (C("start") + F.row_number().over(order) - 1).alias("slot"))


@query("op5_sharding")
def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
