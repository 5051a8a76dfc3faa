"""Whitening of embeddings: blockwise QR of the centred rows, then a bidiagonal qd solver on the triangle that is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.bidiagonal import leading_directions
from tickloom.llm.common import staged, table
from tickloom.llm.registry import query

C = F.col
#: Triangles that one task reduces to one.
FAN_IN = 16
_LARGE = float(2**61)


def _entries(batch: pa.RecordBatch, dims: int, scale: float, offset: int) -> np.ndarray:
    """floor(scale * c) + offset of a batch's vectors as 64-bit integers."""
    lists = batch.column("vector")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    sizes = np.diff(lists.offsets.to_numpy())
    if len(flat) == len(sizes) * dims and (sizes == dims).all():
        c = flat.reshape(len(sizes), dims)
    else:
        c = np.zeros((len(sizes), dims))
        c[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes])] = flat
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * c), -_LARGE, _LARGE).astype(np.int64) + offset


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, offset: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Every usable vector on the ``components`` leading directions of the vectors' covariance, each scaled to variance one.

    Returns ``vec_id, n, deviation, whitened`` (array), ``explained`` (array, share of the whole variance per component) and
    ``identity_error``. Entries become integers ``x = floor(scale * c) + offset``, so sums, means and deviations are exact; ``deviation`` is the
    sum of ``(n * x - S)^2`` over the dimensions, null where it passes 64 bits.

    Vectors that are null or hold a null or non-finite entry are left out. Shorter vectors are filled up with zeros to the longest;
    scaled entries beyond +-2^61 count as that. Repeated rows, shared or null ids stay separate rows. An empty table gives no rows, a component
    without variance (fewer distinct vectors than components) whitened values and a share of zero, and it does not count for ``identity_error``.

    One pass sums the entries. A second reduces every partition's centred rows, batch by batch, to one triangle R, and triangles meet in
    groups of ``FAN_IN`` until one is left: nothing larger than a few d x d matrices is ever in one place, for d dimensions. Householder
    reflections bidiagonalise R, qd transforms find its singular values, twisted factorisations its right singular vectors. A
    third pass projects all rows, and their covariance gives ``identity_error``.
    """
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.select(C(id_col).cast("long").alias("vec_id"), C(vector_col).cast("array<double>").alias("vector"))
    rows = staged(rows.where(C("vector").isNotNull() & F.coalesce(finite, F.lit(False))), "whitening-rows")
    n, dims = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not n or not dims:
        return rows.select("vec_id", F.lit(n).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened"),
                           F.array().cast("array<double>").alias("explained"), F.lit(0.0).alias("identity_error"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            x = _entries(batch, dims, scale, offset)
            high += (x >> 31).sum(0)
            low += (x & (2**31 - 1)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(high), pa.array(low)], names=["dim", "high", "low"])

    totals = rows.select("vector").mapInArrow(sums, "dim int, high long, low long").groupBy("dim").agg(
        F.sum(C("high").cast("decimal(38,0)")).alias("high"), F.sum(C("low").cast("decimal(38,0)")).alias("low")).orderBy("dim").collect()
    whole = [(int(t["high"]) << 31) + int(t["low"]) for t in totals]
    # S / n = base + rest / n, both integers.
    base = np.array([s // n for s in whole], np.int64)
    rest = np.array([s % n for s in whole], np.int64)
    mean_rest = rest / n

    def triangle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = np.zeros((0, dims))
        for batch in batches:
            centred = (_entries(batch, dims, scale, offset) - base) - mean_rest
            r = np.linalg.qr(np.vstack([r, centred]), "r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["part", "r"])

    def meet(parts: pa.Table) -> pa.Table:
        order = np.argsort(parts.column("part").to_numpy())
        blocks = [np.frombuffer(parts.column("r")[int(i)].as_py()).reshape(-1, dims) for i in order]
        r = np.linalg.qr(np.vstack(blocks), "r")
        return pa.table({"part": pa.array([parts.column("part")[int(order[0])].as_py() // FAN_IN], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    triangles = staged(rows.select("vector").mapInArrow(triangle, "part long, r binary"), "triangles")
    while triangles.agg(F.count("*")).first()[0] > 1:
        grouped = triangles.groupBy(F.floor(C("part") / FAN_IN).alias("__group"))
        triangles = staged(grouped.applyInArrow(meet, "part long, r binary"), "triangles")
    last = np.frombuffer(bytes(triangles.first()["r"])).reshape(-1, dims)
    r = np.zeros((dims, dims))
    r[: len(last)] = last
    k = min(components, dims)
    squares, directions = leading_directions(r, k)
    values = squares[:k] / n
    live = directions.any(0)
    scaled = directions / np.sqrt(np.where(live, values, 1.0))
    trace = squares.sum()
    explained = [float(v / trace) if on else 0.0 for v, on in zip(squares[:k], live)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gap = _entries(batch, dims, scale, offset) - base
            reach = (int(np.abs(gap).max(initial=0)) + 1) * n
            if reach * reach * dims < 2**63:
                deviation = pa.array(((gap * n - rest) ** 2).sum(1))
            else:
                exact = ((gap.astype(object) * n - rest.astype(object)) ** 2).sum(1)
                deviation = pa.array([v if v < 2**63 else None for v in exact], pa.int64())
            w = (gap - mean_rest) @ scaled
            ends = pa.array(np.arange(0, w.size + 1, k, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), deviation, pa.ListArray.from_arrays(ends, pa.array(w.reshape(-1)))], names=["vec_id", "deviation", "whitened"])

    projected = staged(rows.mapInArrow(project, "vec_id long, deviation long, whitened array<double>"), "whitened")
    on = [i for i in range(k) if live[i]]
    pairs = [F.abs(F.covar_pop(C("whitened")[i], C("whitened")[j]) - float(i == j)) for a, i in enumerate(on) for j in on[a:]]
    error = max(projected.agg(*pairs).first()) if pairs else 0.0
    return projected.select(
        "vec_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.array(*[F.lit(v) for v in explained]).alias("explained"), F.lit(float(error)).alias("identity_error"))


@query("op13_whitening")
def whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten(table(spark, sf_dir, "embeddings"))
    one = rows.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("pos", "c"))
    return one.select("vec_id", (C("pos") + 1).alias("component"), "n", "deviation", C("c.whitened").alias("whitened"), C("c.explained").alias("explained"), "identity_error")
