"""Regimes by block scans against one walk through each series, and the fit."""

import numpy as np
import pytest

from tickloom.operators import regimes

SCHEMA = "product_id string, idx long, log_ret double, vol double, note string"
MODEL = regimes.RegimeModel(
    np.array([[0.0, 0.2], [0.3, 1.0], [-0.2, 3.0]]), np.array([[0.5, 0.05], [0.6, 0.3], [2.0, 1.0]]),
    np.array([0.6, 0.3, 0.1]), np.array([[0.95, 0.04, 0.01], [0.05, 0.9, 0.05], [0.02, 0.08, 0.9]]))


def simulate(n, seed, model=MODEL):
    rng = np.random.default_rng(seed)
    states = [int(rng.choice(3, p=model.start))]
    while len(states) < n:
        states.append(int(rng.choice(3, p=model.transition[states[-1]])))
    return model.means[states] + rng.standard_normal((n, 2)) * np.sqrt(model.variances[states])


def walk(model, x):
    """State of the best path and its probability after every observation, one after the other."""
    out, log_b = [], model.log_density(x)
    for i, lb in enumerate(log_b):
        if i == 0:
            score, alpha = np.log(model.start) + lb, model.start * np.exp(lb - lb.max())
        else:
            score, alpha = (score[:, None] + np.log(model.transition)).max(axis=0) + lb, (alpha @ model.transition) * np.exp(lb - lb.max())
        alpha = alpha / alpha.sum()
        out.append((regimes.STATE_NAMES[int(score.argmax())], float(alpha[int(score.argmax())])))
    return out


@pytest.fixture(scope="module")
def series():
    return {"a": simulate(1500, 1), "b": simulate(37, 2), "c": simulate(1, 3)}


@pytest.fixture(scope="module")
def observations(spark, series):
    rows = [(p, i + 11, float(r), float(v), "x") for p, x in series.items() for i, (r, v) in enumerate(x)]
    return spark.createDataFrame(rows, SCHEMA).repartition(7)


@pytest.mark.parametrize("width,fan", [(256, 512), (7, 4), (64, 2)])
def test_decoding_equals_one_walk(observations, series, width, fan):
    got = regimes.decode_regimes(MODEL, observations, width, fan)
    assert got.columns == [*observations.columns, "regime", "confidence"]
    by = {p: sorted((r["idx"], r["regime"], r["confidence"]) for r in got.where(f"product_id = '{p}'").collect()) for p in series}
    for p, x in series.items():
        want = walk(MODEL, x)
        assert [r[1] for r in by[p]] == [w[0] for w in want]
        assert np.allclose([r[2] for r in by[p]], [w[1] for w in want], atol=1e-9)


def test_rows_that_tell_nothing(spark):
    """Null and infinite entries keep their row; the state moves on by the transitions alone."""
    rows = [("a", 0, 0.0, 0.2, "x"), ("a", 1, None, 1.0, "x"), ("a", 2, float("inf"), 1.0, "x")]
    got = regimes.decode_regimes(MODEL, spark.createDataFrame(rows, SCHEMA)).orderBy("idx").collect()
    b = np.exp(MODEL.log_density(np.array([[0.0, 0.2]])))[0] * MODEL.start
    after = b / b.sum() @ MODEL.transition @ MODEL.transition
    assert abs(got[2]["confidence"] - after[0]) < 1e-9
    assert regimes.decode_regimes(MODEL, spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r["regime"] for r in regimes.decode_regimes(None, spark.createDataFrame(rows, SCHEMA)).collect()] == ["UNKNOWN"] * 3


def test_expected_counts_equal_forward_backward(observations, series):
    got = regimes.expected_counts(MODEL, regimes.prepared(observations, 16), 16, 3)
    want = dict.fromkeys(got, 0.0)
    for x in series.values():
        b, a = np.exp(MODEL.log_density(x)), MODEL.transition
        alpha, scale = np.empty((len(x), 3)), np.empty(len(x))
        for t in range(len(x)):
            alpha[t] = (MODEL.start if t == 0 else alpha[t - 1] @ a) * b[t]
            scale[t] = alpha[t].sum()
            alpha[t] /= scale[t]
        beta = np.ones((len(x), 3))
        for t in range(len(x) - 2, -1, -1):
            beta[t] = a @ (b[t + 1] * beta[t + 1]) / scale[t + 1]
        gamma = alpha * beta
        want["loglik"] += np.log(scale).sum()
        for i in range(3):
            want[f"start{i}"] += gamma[0, i]
            want[f"weight{i}"] += gamma[:, i].sum()
            for c, k in enumerate(("ret", "vol")):
                want[f"{k}{i}"] += gamma[:, i] @ x[:, c]
                want[f"{k}2_{i}"] += gamma[:, i] @ x[:, c] ** 2
            for j in range(3):
                want[f"move{i}{j}"] += sum(alpha[t, i] * a[i, j] * b[t + 1, j] * beta[t + 1, j] / scale[t + 1] for t in range(len(x) - 1))
    assert all(abs(got[k] - want[k]) < 1e-6 * max(1, abs(want[k])) for k in want), (got, want)


def test_fit_recovers_planted_parameters(spark):
    rows = [(p, i, float(r), float(v), "x") for p, seed in (("a", 5), ("b", 6)) for i, (r, v) in enumerate(simulate(6000, seed))]
    log = []
    model = regimes.fit_regimes(spark.createDataFrame(rows, SCHEMA), rounds=25, log=log)
    assert len(log) > 3 and all(b >= a - 1e-6 * abs(a) for a, b in zip(log, log[1:]))
    assert np.abs(model.means - MODEL.means).max() < 0.15
    assert np.abs(model.variances - MODEL.variances).max() < 0.25
    assert np.abs(model.transition - MODEL.transition).max() < 0.04


def test_no_model_without_rows_or_different_states(spark):
    assert regimes.fit_regimes(spark.createDataFrame([("a", i, 0.1, 0.2, "x") for i in range(59)], SCHEMA)) is None
    assert regimes.fit_regimes(spark.createDataFrame([("a", i, 0.1 * (i % 3), 0.2, "x") for i in range(300)], SCHEMA)) is None
    assert regimes.fit_regimes(spark.createDataFrame([], SCHEMA)) is None
