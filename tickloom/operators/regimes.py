"""Market regimes: a hidden Markov model of returns and volatility, fitted and decoded by scans over blocks of matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.scans import carried_states, cogrouped
from tickloom.session import materialize

C = F.col

STATES = 3
STATE_NAMES = ("RANGING", "TRENDING", "CHAOTIC")  # by rising volatility
COLUMNS = ("log_ret", "vol")
#: Observations of a block and blocks of a task's group.
WIDTH, GROUP = 256, 64


class RegimeModel:
    """Three Gaussian states with diagonal covariance and a transition matrix, ordered by mean volatility."""

    def __init__(self, means: np.ndarray, variances: np.ndarray, start: np.ndarray, transition: np.ndarray, floor: float = 1e-12):
        order = np.argsort(means[:, 1], kind="stable")
        self.means, self.variances = means[order], np.maximum(variances[order], floor)
        self.start, self.transition = start[order], transition[np.ix_(order, order)]

    def distinct(self) -> bool:
        return bool(self.means[-1, 1] - self.means[0, 1] >= 1e-6)

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """Of every row in every state; a row with a null or non-finite entry tells nothing and gets zeros."""
        z = (x[:, None, :] - self.means) ** 2 / self.variances
        found = -0.5 * (z + np.log(2 * np.pi * self.variances)).sum(axis=2)
        return np.where(np.isfinite(x).all(axis=1)[:, None], found, 0.0)


class _Blocks:
    """Observations of a group of one series, laid out as blocks x positions; positions without a row change nothing."""

    def __init__(self, table: pa.Table, model: RegimeModel, width: int):
        idx = table.column("idx").to_numpy()
        self.x = np.column_stack([table.column(c).to_numpy(zero_copy_only=False).astype(float) for c in COLUMNS])
        self.blocks, self.row = np.unique(idx // width, return_inverse=True)
        self.at = idx % width
        shape = (len(self.blocks), width)
        logs = np.zeros((*shape, STATES))
        logs[self.row, self.at] = model.log_density(self.x)
        self.live, self.first = np.zeros(shape, bool), np.zeros(shape, bool)
        self.live[self.row, self.at] = True
        self.first[self.row, self.at] = table.column("is_first").to_numpy(zero_copy_only=False)
        self.top = logs.max(axis=2)
        with np.errstate(divide="ignore"):
            log_a, log_start = np.log(model.transition), np.log(model.start)
        # One matrix a position: from each state before it to each state at it. A series' first row forgets what came before.
        from_first, dead = self.first[..., None, None], ~self.live[..., None, None]
        self.log_step = np.where(from_first, log_start, log_a) + logs[:, :, None, :]
        self.log_step = np.where(dead, np.where(np.eye(STATES, dtype=bool), 0.0, -np.inf), self.log_step)
        self.step = np.where(dead, np.eye(STATES), np.where(from_first, model.start, model.transition) * np.exp(logs - self.top[..., None])[:, :, None, :])
        self.width = width

    def summaries(self) -> np.ndarray:
        """Per block the scaled sum-product matrix and the max-plus matrix of all its positions."""
        m = len(self.blocks)
        total = np.broadcast_to(np.eye(STATES), (m, STATES, STATES)).copy()
        best = np.broadcast_to(np.where(np.eye(STATES, dtype=bool), 0.0, -np.inf), (m, STATES, STATES)).copy()
        for t in range(self.width):
            total = total @ self.step[:, t]
            total /= total.max(axis=(1, 2), keepdims=True)
            best = (best[:, :, :, None] + self.log_step[:, t, None]).max(axis=2)
            best -= best.max(axis=(1, 2), keepdims=True)
        return np.stack([total, best], axis=1)


def _compose(first: bytes, second: bytes, block: int) -> bytes:
    (a, x), (b, y) = (np.frombuffer(m).reshape(2, STATES, STATES) for m in (first, second))
    total, best = a @ b, (x[:, :, None] + y[None]).max(axis=1)
    return np.stack([total / total.max(), best - best.max()]).tobytes()


def _forward(state: bytes, packed: bytes, block: int) -> bytes:
    (alpha, score), (total, best) = np.frombuffer(state).reshape(2, STATES), np.frombuffer(packed).reshape(2, STATES, STATES)
    alpha, score = alpha @ total, (score[:, None] + best).max(axis=0)
    return np.stack([alpha / alpha.sum(), score - score.max()]).tobytes()


def _backward(state: bytes, packed: bytes, block: int) -> bytes:
    beta = np.frombuffer(packed).reshape(2, STATES, STATES)[0] @ np.frombuffer(state)
    return (beta / beta.sum()).tobytes()


_BEFORE = np.stack([np.full(STATES, 1 / STATES), np.zeros(STATES)]).tobytes()
_AFTER = np.full(STATES, 1 / STATES).tobytes()


def prepared(observations: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows with their group and whether they open their series."""
    first = observations.groupBy("product_id").agg(F.min("idx").alias("__first"))
    rows = observations.join(first, "product_id").withColumn("is_first", C("idx") == C("__first")).drop("__first")
    return rows.withColumn("__group", F.floor(C("idx") / (width * GROUP)))


def _maps(rows: DataFrame, model: RegimeModel, width: int) -> DataFrame:
    schema = T.StructType([rows.schema["product_id"], T.StructField("block", T.LongType()), T.StructField("map", T.BinaryType())])

    def run(table: pa.Table) -> pa.Table:
        b = _Blocks(table, model, width)
        product = table.column("product_id").take(pa.array(np.zeros(len(b.blocks), np.int64)))
        return pa.table({"product_id": product, "block": pa.array(b.blocks), "map": pa.array([m.tobytes() for m in b.summaries()], pa.binary())})

    return materialize(rows.select("product_id", "__group", "idx", "is_first", *COLUMNS).groupBy("product_id", "__group").applyInArrow(run, schema))


def _carry(states: DataFrame, width: int) -> DataFrame:
    return states.withColumn("__group", F.floor(C("block") / GROUP))


def decode_regimes(model: RegimeModel | None, observations: DataFrame, width: int = WIDTH, fan: int = 512) -> DataFrame:
    """Regime and confidence at every observation, given all of its series up to it: adds ``regime, confidence``.

    The regime is the last state of the most likely path so far (max-plus), the confidence that state's probability so far (sum-product).
    Each block of ``width`` observations becomes one matrix of either kind; the matrices are scanned over the series, and
    every block starts from the exact state before it. The result does not depend on ``width`` and equals one walk from the series' start.
    """
    if model is None:
        return observations.withColumns({"regime": F.lit("UNKNOWN"), "confidence": F.lit(0.5)})
    rows = materialize(prepared(observations, width))
    carry = _carry(carried_states(_maps(rows, model, width), ["product_id"], _compose, _forward, _BEFORE, fan), width)
    kept = observations.columns
    schema = T.StructType([*observations.schema.fields, T.StructField("regime", T.StringType()), T.StructField("confidence", T.DoubleType())])

    def run(table: pa.Table, states: pa.Table) -> pa.Table:
        b = _Blocks(table, model, width)
        by_block = dict(zip(states.column("block").to_pylist(), states.column("state").to_pylist()))
        now = np.stack([np.frombuffer(by_block[k]).reshape(2, STATES) for k in b.blocks.tolist()])
        alpha, score = now[:, 0], now[:, 1]
        state, confidence = np.zeros(b.live.shape, np.int64), np.zeros(b.live.shape)
        for t in range(width):
            alpha = (alpha[:, None, :] @ b.step[:, t])[:, 0]
            alpha /= alpha.sum(axis=1, keepdims=True)
            score = (score[:, :, None] + b.log_step[:, t]).max(axis=1)
            score -= score.max(axis=1, keepdims=True)
            state[:, t] = score.argmax(axis=1)
            confidence[:, t] = np.take_along_axis(alpha, state[:, t, None], axis=1)[:, 0]
        names = pa.array([STATE_NAMES[s] for s in state[b.row, b.at]])
        return table.select(kept).append_column("regime", names).append_column("confidence", pa.array(confidence[b.row, b.at]))

    by = ["product_id", "__group"]
    return cogrouped(rows, carry, by, run, schema)


# -- fitting -------------------------------------------------------------------------------

_STATS = ["loglik", *(f"start{i}" for i in range(STATES)), *(f"move{i}{j}" for i in range(STATES) for j in range(STATES)),
          *(f"{k}{i}" for k in ("weight", "ret", "vol", "ret2_", "vol2_") for i in range(STATES))]


def expected_counts(model: RegimeModel, rows: DataFrame, width: int = WIDTH, fan: int = 512) -> dict[str, float]:
    """Log-likelihood and expected counts of starts, moves and emissions under ``model``, over all series (28 sums).

    ``rows`` come from ``prepared``. Forward and backward probabilities enter each block from scans of the block matrices.
    """
    maps = _maps(rows, model, width)
    keys = ["product_id"]
    ahead = carried_states(maps, keys, _compose, _forward, _BEFORE, fan)
    behind = carried_states(maps, keys, _compose, _backward, _AFTER, fan, backward=True).withColumnRenamed("state", "after")
    carry = _carry(ahead.join(behind, [*keys, "block"]), width)
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in _STATS])

    def run(table: pa.Table, states: pa.Table) -> pa.Table:
        b = _Blocks(table, model, width)
        before = dict(zip(states.column("block").to_pylist(), states.column("state").to_pylist()))
        after = dict(zip(states.column("block").to_pylist(), states.column("after").to_pylist()))
        alphas = np.empty((width + 1, len(b.blocks), STATES))
        alphas[0] = np.stack([np.frombuffer(before[k]).reshape(2, STATES)[0] for k in b.blocks.tolist()])
        loglik = float(b.top[b.live].sum())
        for t in range(width):
            alpha = (alphas[t][:, None, :] @ b.step[:, t])[:, 0]
            scale = alpha.sum(axis=1, keepdims=True)
            loglik += float(np.log(scale[b.live[:, t]]).sum())
            alphas[t + 1] = alpha / scale
        beta = np.stack([np.frombuffer(after[k]) for k in b.blocks.tolist()])
        gamma = np.zeros((*b.live.shape, STATES))
        moves = np.zeros((STATES, STATES))
        for t in range(width - 1, -1, -1):
            joint = alphas[t + 1] * beta
            gamma[:, t] = joint / joint.sum(axis=1, keepdims=True)
            pair = alphas[t][:, :, None] * b.step[:, t] * beta[:, None, :]
            counted = b.live[:, t] & ~b.first[:, t]
            moves += (pair / pair.sum(axis=(1, 2), keepdims=True))[counted].sum(axis=0)
            beta = (b.step[:, t] @ beta[:, :, None])[:, :, 0]
            beta /= beta.sum(axis=1, keepdims=True)
        own = gamma[b.row, b.at]
        told = np.isfinite(b.x).all(axis=1)
        g, x = own[told], b.x[told]
        values = [loglik, *gamma[b.first].sum(axis=0), *moves.reshape(-1), *g.sum(axis=0), *(g.T @ x).T.reshape(-1), *(g.T @ (x * x)).T.reshape(-1)]
        return pa.table({n: pa.array([float(v)]) for n, v in zip(_STATS, values)})

    by = ["product_id", "__group"]
    found = cogrouped(rows, carry, by, run, schema)
    return found.agg(*[F.sum(n).alias(n) for n in _STATS]).first().asDict()


def _from_counts(counts: dict[str, float], old: RegimeModel) -> RegimeModel:
    start = np.array([counts[f"start{i}"] for i in range(STATES)])
    moves = np.array([[counts[f"move{i}{j}"] for j in range(STATES)] for i in range(STATES)])
    weight = np.array([counts[f"weight{i}"] for i in range(STATES)])
    seen, left = weight > 1e-9, moves.sum(axis=1) > 1e-9
    per = np.where(seen, weight, 1.0)[:, None]
    means = np.array([[counts[f"{c}{i}"] for c in ("ret", "vol")] for i in range(STATES)]) / per
    squares = np.array([[counts[f"{c}2_{i}"] for c in ("ret", "vol")] for i in range(STATES)]) / per
    transition = np.where(left[:, None], moves / np.where(left, moves.sum(axis=1), 1.0)[:, None], old.transition)
    return RegimeModel(
        np.where(seen[:, None], means, old.means), np.where(seen[:, None], squares - means**2, old.variances), start / start.sum(), transition, floor=1e-6)


def fit_regimes(
    observations: DataFrame, minimum: int = 60, rounds: int = 40, tolerance: float = 1e-4, windows: tuple[int | None, ...] = (None, 500, 200),
    width: int = WIDTH, log: list[float] | None = None,
) -> RegimeModel | None:
    """Fit the model jointly to all series by expectation maximisation (Baum-Welch), every product being one series.

    A round is two passes: the blocks' matrices, then the expected counts from the scanned carries, summed by one aggregate. It
    stops after ``rounds`` or when the log-likelihood per observation gains less than ``tolerance``; ``log`` receives it per round. States begin as thirds of the volatility. Fewer than ``minimum`` rows
    give no model; where states do not differ in volatility, the last 500, then the last 200 observations of each product are tried.
    """
    for window in windows:
        rows = observations
        if window is not None:
            last = observations.groupBy("product_id").agg(F.max("idx").alias("__last"))
            rows = observations.join(last, "product_id").where(C("idx") > C("__last") - window).drop("__last")
        model = _fitted(rows, minimum, rounds, tolerance, width, log)
        if model is not None and model.distinct():
            return model
    return None


def _fitted(observations: DataFrame, minimum: int, rounds: int, tolerance: float, width: int, log: list[float] | None) -> RegimeModel | None:
    usable = observations.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < double('inf')" for c in COLUMNS))
    seen = usable.agg(F.count("*"), *[f(c) for c in COLUMNS for f in (F.avg, F.stddev_pop)], F.percentile_approx("vol", F.array(F.lit(1 / 3), F.lit(2 / 3)), 10_000)).first()
    if seen[0] < minimum:
        return None
    n, shift, unit = seen[0], np.array([seen[1], seen[3]]), np.array([seen[2] or 1.0, seen[4] or 1.0])
    third = F.when(C("vol") <= seen[5][0], 0).when(C("vol") <= seen[5][1], 1).otherwise(2)
    parts = {r[0]: r for r in usable.groupBy(third).agg(*[f(c) for c in COLUMNS for f in (F.avg, F.var_pop)]).collect()}  # three rows
    overall = [0, seen[1], unit[0] ** 2, seen[3], unit[1] ** 2]
    own = [parts.get(i, overall) for i in range(STATES)]
    means = (np.array([[p[1], p[3]] for p in own]) - shift) / unit
    variances = np.array([[p[2], p[4]] for p in own]) / unit**2
    scaled = observations.withColumns({c: (C(c) - float(s)) / float(u) for c, s, u in zip(COLUMNS, shift, unit)})
    rows = materialize(prepared(scaled.select("product_id", "idx", *COLUMNS), width))
    transition = np.full((STATES, STATES), 0.1) + np.eye(STATES) * (1 - 0.1 * STATES)
    model = RegimeModel(means, variances, np.full(STATES, 1 / STATES), transition, floor=1e-3)
    before = -np.inf
    for _ in range(rounds):
        counts = expected_counts(model, rows, width)
        if log is not None:
            log.append(counts["loglik"])
        if counts["loglik"] - before < tolerance * n:
            break
        before, model = counts["loglik"], _from_counts(counts, model)
    return RegimeModel(model.means * unit + shift, model.variances * unit**2, model.start, model.transition)
