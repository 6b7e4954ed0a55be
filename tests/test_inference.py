"""The whole-series bootstrap against a step-by-step version."""

from __future__ import annotations

import datetime as dt
import hashlib

import numpy as np
import pytest

from tideline.operators import inference, portfolio
from tideline.plans import study
from tideline.sources import durable

N, REPS = 700, 30


def uniform(rep: int, pos: int, stream: str) -> float:
    return int(hashlib.md5(f"12345-{rep}-{pos}-{stream}".encode()).hexdigest()[:13], 16) / 2**52


def sharpe(x: np.ndarray) -> float:
    return x.mean() / x.std(ddof=1) * 252**0.5


def metrics(x: np.ndarray, net: np.ndarray) -> dict[str, float]:
    wealth = np.cumprod(1 + net)
    down = (wealth / np.maximum.accumulate(wealth) - 1).min()
    growth = wealth[-1] ** (252 / len(net)) - 1
    return {"sharpe": sharpe(x), "sortino": x.mean() / np.sqrt((np.minimum(x, 0) ** 2).mean()) * 252**0.5, "ann_vol": net.std(ddof=1) * 252**0.5, "cagr": growth, "max_drawdown": down, "calmar": growth / abs(down)}


def sources(block: int, n: int, reps: int) -> dict[int, list[int]]:
    out = {}
    for rep in range(reps):
        src, at = [], 0
        for pos in range(n):
            at = int(uniform(rep, pos, "at") * n) if pos == 0 or uniform(rep, pos, "new") < 1 / block else (at + 1) % n
            src.append(at)
        out[rep] = src
    return out


def test_every_day_and_replicate(spark, monkeypatch):
    rng = np.random.default_rng(21)
    a, b = rng.normal(0.0003, 0.01, N), rng.normal(0.0005, 0.012, N)
    b[500:] += 0.01
    na, nb = a + 0.0002, b + 0.0001
    day = dt.date(2020, 1, 1)
    pairs = spark.createDataFrame([(day + dt.timedelta(i), *map(float, (a[i], b[i], na[i], nb[i]))) for i in range(N)], "date date, a double, b double, net_a double, net_b double").repartition(3)
    assert study.DRAWS == 10_000
    monkeypatch.setattr(study, "paired", lambda spark, d: pairs)
    monkeypatch.setattr(study, "DRAWS", REPS)
    src = sources(21, N, REPS)
    of = lambda i: {m: y - x for (m, x), y in zip(metrics(a[i], na[i]).items(), metrics(b[i], nb[i]).values(), strict=True)}
    want = {(rep, m): v for rep, i in src.items() for m, v in of(i).items()}
    digests = {(r.rep, r.n, r.total, r.weighted, r.days) for r in study.QUERIES["bootstrap_indices"](spark, "").collect()}
    assert digests == {(rep, N, sum(i), sum(p * x for p, x in enumerate(i)), len(set(i))) for rep, i in src.items()}
    got = {(r.rep, r.metric): r.value for r in study.QUERIES["bootstrap_draws"](spark, "").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-5 for k in want)
    seen = of(np.arange(N))
    for row in study.QUERIES["bootstrap_intervals"](spark, "").collect():
        values = np.array([want[r, row.metric] for r in range(REPS)])
        assert row.n_draws == REPS and abs(row.observed - seen[row.metric]) < 2e-5
        assert np.allclose([row.ci_low, row.ci_high], np.quantile(values, [0.025, 0.975]), atol=2e-5)
    block = {r.mean_block_days: r for r in study.QUERIES["block_sensitivity"](spark, "").collect()}
    assert set(block) == {21, 10, 42, 63} and block[21].role == "primary"
    for k in (10, 63):
        values = [sharpe(b[i]) - sharpe(a[i]) for i in sources(k, N, REPS).values()]
        assert abs(block[k].bootstrap_sd - np.std(values, ddof=1)) < 1e-5


def test_the_days_are_broadcast_not_the_draws(spark):
    """A series that Spark takes for larger than the draws, which number reps * n all the same."""
    day = dt.date(2020, 1, 1)
    rows = spark.sparkContext.parallelize([(c, day + dt.timedelta(i), 0.01 * i, 0.02 * i, 0.01, 0.02) for c in "xy" for i in range(9)], 2).toDF("comparison string, date date, a double, b double, net_a double, net_b double")
    for out in (inference.sharpe_draws(rows, 3, 40, 9), inference.draws(rows.filter("comparison = 'x'"), 3, 40, 9)):
        plan = out._jdf.queryExecution().sparkPlan().toString()
        joins = [line for line in plan.splitlines() if "Join" in line]
        assert len(joins) == 1 and "BroadcastHashJoin" in joins[0] and "BuildRight" in joins[0], joins
    assert inference.sharpe_draws(rows, 3, 40, 9).count() == 80


@pytest.fixture
def legs(spark, monkeypatch):
    """Net returns of every strategy, cost and specification on 60 days, for queries that start from them; keeps a list of what they write down."""
    rng, day = np.random.default_rng(8), dt.date(2020, 1, 1)
    days = [day + dt.timedelta(i) for i in range(60)]
    x = {(spec.name, s): rng.normal(0.001, 0.01, 60) for spec in portfolio.GRID for s in ("window_lw", "regime_mixture")}
    y = {(s, c): rng.normal(0.001, 0.01, 60) for s in portfolio.STRATEGIES for c in study.COSTS}
    grid = spark.createDataFrame([(n, s, t, float(v[i])) for (n, s), v in x.items() for i, t in enumerate(days)], "specification string, strategy string, date date, net_return double")
    ladder = spark.createDataFrame([(s, c, t, float(v[i])) for (s, c), v in y.items() for i, t in enumerate(days)], "strategy string, cost_bps double, date date, net_return double")
    monkeypatch.setattr(study, "grid_net", lambda spark, d: grid)
    monkeypatch.setattr(study, "ladder_net", lambda spark, d, costs: ladder)
    monkeypatch.setattr(study, "rf", lambda spark, d: spark.createDataFrame([(t, 0.0) for t in days], "date date, rf double"))
    monkeypatch.setattr(study, "DRAWS", REPS)
    kept, keep = [], durable.keep
    monkeypatch.setattr(durable, "keep", lambda df: kept.append(df) or keep(df))
    return x, y, kept


def drawn_side(kept) -> set[str]:
    """Which side of their joins with the days the kept draws broadcast."""
    plans = [df._jdf.queryExecution().sparkPlan().toString() for df in kept if "rep" in df.columns]
    return {line.split(", ")[-2] for plan in plans for line in plan.splitlines() if "BroadcastHashJoin [src" in line}

def test_closing_checks_read_the_tests_once(spark, legs, monkeypatch):
    kept, make, made = legs[2], study.grid_tests, spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    def counting(spark, d):
        rows = make(spark, d)
        return rows.mapInArrow(counted, rows.schema)

    monkeypatch.setattr(study, "grid_tests", counting)
    checks = study.QUERIES["closing_checks"](spark, "").collect()
    assert len(checks) == 12 and {r.check for r in checks if not r.ok} == {"one_comparator"}  # the legs here are drawn apart
    assert made.value == 13 and drawn_side(kept) == {"BuildRight"}

def test_comparison_family_broadcasts_the_days(spark, legs):
    _, y, kept = legs
    got = {r.comparison: r.observed for r in study.QUERIES["comparison_family"](spark, "").collect()}
    assert drawn_side(kept) == {"BuildRight"}
    want = {f"{s} minus rolling_lw @{int(c)}": sharpe(v) - sharpe(y["rolling_lw", c]) for (s, c), v in y.items() if (c == 10) == (s != "regime_aware") and s != "rolling_lw" and (c == 10 or s == "regime_aware")}
    assert got.keys() == want.keys() and len(got) == 7 and all(abs(got[k] - want[k]) < 2e-5 for k in want)

def test_robustness_forest_broadcasts_the_days(spark, legs):
    x, _, kept = legs
    got = {r.ordinal: r for r in study.QUERIES["robustness_forest"](spark, "").collect()}
    assert drawn_side(kept) == {"BuildRight"} and [got[i].specification for i in range(13)] == [s.name for s in portfolio.GRID]
    i = list(sources(study.BLOCK, 60, REPS).values())
    for row in got.values():
        a, b = x[row.specification, "window_lw"], x[row.specification, "regime_mixture"]
        assert np.allclose([row.ci_low, row.ci_high], np.quantile([sharpe(b[k]) - sharpe(a[k]) for k in i], [0.025, 0.975]), atol=2e-5)

def test_grid_tests_broadcast_the_days(spark, legs):
    x, _, kept = legs
    got = {r.specification: r for r in study.QUERIES["grid_tests"](spark, "").collect()}
    assert drawn_side(kept) == {"BuildRight"} and len(got) == 13
    i = sources(study.BLOCK, 60, REPS).values()
    for name, row in got.items():
        a, b = x[name, "window_lw"], x[name, "regime_mixture"]
        assert abs(row.observed - (sharpe(b) - sharpe(a))) < 2e-5 and row.n_evaluation_days == 60
        assert abs(row.bootstrap_sd - np.std([sharpe(b[k]) - sharpe(a[k]) for k in i], ddof=1)) < 2e-5
