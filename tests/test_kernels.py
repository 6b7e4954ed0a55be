"""Kernels and accounting: identities and known cases."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from tideline.kernels import garch, hmm, matrix
from tideline.operators import accounting


def simulated(n=900, seed=3):
    rng = np.random.default_rng(seed)
    state = np.zeros(n, int)
    for t in range(1, n):
        state[t] = state[t - 1] if rng.random() < 0.97 else 1 - state[t - 1]
    return np.stack([rng.normal(0, np.where(state, 2.0, 0.6)), np.where(state, 1.5, -0.5) + rng.normal(0, 0.4, n)], axis=1), state


def test_hmm_recovers_states_and_endpoint():
    x, state = simulated()
    results = hmm.fit(hmm.standardize(x), 2, [0, 1, 2])
    model = hmm.select(results)
    f, g = hmm.posteriors(model, hmm.standardize(x))
    assert np.allclose(f[-1], g[-1]) and np.allclose(g.sum(axis=1), 1)
    agree = (g.argmax(axis=1) == state).mean()
    assert max(agree, 1 - agree) > 0.97
    assert hmm.select([{**results[0], "converged": False}]) is None


def test_hmm_expected_transitions_are_exact():
    rng = np.random.default_rng(0)
    logb, pi = np.log(rng.random((1, 4, 2))), np.array([[0.3, 0.7]])
    p = np.array([[[0.9, 0.1], [0.4, 0.6]]])
    _, _, xi, ll = hmm.forward_backward(logb, pi, p)
    total, want = 0.0, np.zeros((2, 2))
    for k in range(16):
        y = [(k >> i) & 1 for i in range(4)]
        w = pi[0, y[0]] * np.prod([np.exp(logb[0, t, y[t]]) for t in range(4)]) * np.prod([p[0, y[t], y[t + 1]] for t in range(3)])
        total += w
        for t in range(3):
            want[y[t], y[t + 1]] += w
    assert np.isclose(ll[0], np.log(total)) and np.allclose(xi[0], want / total)


def test_garch_on_simulated_returns():
    rng = np.random.default_rng(5)
    h, r = 1e-4, []
    for _ in range(2500):
        x = rng.normal() * h**0.5
        r.append(x)
        h = 2e-6 + 0.08 * x * x + 0.90 * h
    value, ok = garch.forecast(np.array(r), 21)
    path, total = h, 0.0
    for _ in range(21):
        total += path
        path = 2e-6 + 0.98 * path
    assert ok and 0.6 < value / total < 1.6
    assert garch.forecast(np.zeros(10), 5)[1] is False


@pytest.mark.parametrize("cap", [1.0, 0.4, 0.25])
def test_min_variance_beats_random_weights(cap):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(5, 5))
    cov = a @ a.T / 100
    w = matrix.min_variance(cov, cap)
    assert abs(w.sum() - 1) < 1e-12 and w.min() >= 0 and w.max() <= cap + 1e-9
    assert np.allclose(matrix.min_variance(cov * 1e-6, cap), w)
    for v in rng.dirichlet(np.ones(5), 4000):
        if v.max() <= cap:
            assert v @ cov @ v >= w @ cov @ w - 1e-12


def test_gate():
    assert matrix.min_variance(np.eye(3), 0.3) is None
    assert matrix.gate(np.eye(3))[1] == "ok" and matrix.gate(np.diag([1.0, -0.1]))[1] == "failed" and matrix.gate(np.diag([1.0, 0.0]))[1] == "clipped"
    assert matrix.conditions(np.diag([4.0, 1.0])) == (4.0, 1.0) and matrix.conditions(np.zeros((2, 2)))[1] == float("inf")


def test_ten_percent_transfer(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(6)]
    returns = spark.createDataFrame([(d, a, 0.0) for d in days for a in "XYZ"], "date date, asset string, r double")
    targets = spark.createDataFrame([("s", days[1], a, w) for a, w in zip("XYZ", (0.5, 0.5, 0.0))] + [("s", days[3], a, w) for a, w in zip("XYZ", (0.4, 0.6, 0.0))], "strategy string, date date, asset string, weight double")
    _, events = accounting.simulate(returns, targets)
    net = {r.date: r for r in accounting.net_returns(events, (10.0,)).collect()}
    assert min(net) == days[1] and net[days[1]].full_trade_sum == 1.0
    assert abs(net[days[3]].full_trade_sum - 0.2) < 1e-12 and abs(net[days[3]].cost_fraction - 2e-4) < 1e-15


def test_drift_equals_the_recurrence(spark):
    rng = np.random.default_rng(8)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(120)]
    r = rng.normal(0.0004, 0.01, (120, 3))
    plan = {0: None, 5: (0.2, 0.3, 0.5), 25: None, 60: (0.1, 0.1, 0.7), 90: (1.0, 0.0, 0.0)}
    returns = spark.createDataFrame([(days[t], a, float(r[t, i])) for t in range(120) for i, a in enumerate("XYZ")], "date date, asset string, r double")
    targets = spark.createDataFrame([("s", days[t], a, None if w is None else w[i]) for t, w in plan.items() for i, a in enumerate("XYZ")], "strategy string, date date, asset string, weight double")
    weights, events = accounting.simulate(returns, targets)
    got, path = {x.date: x for x in events.collect()}, {(x.date, x.asset): x for x in weights.collect()}
    w = np.zeros(3)
    for t in range(120):
        grown = w * (1 + r[t])
        gross = grown.sum() - w.sum() if w.sum() > 0 else 0.0
        pre = grown / grown.sum() if grown.sum() > 0 else w
        target = plan.get(t)
        post = np.array(target) if target is not None else pre
        assert abs(got[days[t]].gross_return - gross) < 1e-14 and abs(got[days[t]].full_trade_sum - (np.abs(post - pre).sum() if target else 0)) < 1e-13
        assert all(abs(path[days[t], a].post - post[i]) < 1e-13 for i, a in enumerate("XYZ"))
        w = post
