"""Origins and starts of the study, and the robustness grid."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from tideline.kernels import matrix
from tideline.operators import portfolio, regimes
from tideline.plans import core, study

SF = "/root/testdata/sf0.001"


def test_every_month_end_and_start(spark):
    assert study.SEEDS == tuple(range(42, 58))
    assert study.origins(spark, SF).count() == core.ends(spark, SF).count()


def market(spark, n=420):
    rng = np.random.default_rng(3)
    day = dt.date(2015, 1, 1)
    vol = np.where((np.arange(n) // 70) % 2, 0.03, 0.008)
    x = np.column_stack([rng.normal(0, vol), vol + rng.normal(0, 0.001, n), np.log(15 + 400 * vol) + rng.normal(0, 0.05, n), rng.normal(0, 0.1, n).cumsum()])
    days = [day + dt.timedelta(i) for i in range(n)]
    rows = spark.createDataFrame([(d, *map(float, v)) for d, v in zip(days, x, strict=True)], ["date", *regimes.FEATURES])
    r = {"A": x[:, 0], "N": rng.normal(0, 0.01, n) + 0.3 * x[:, 0], "R": rng.normal(0, 0.012, n)}
    returns = spark.createDataFrame([(d, a, float(v[i])) for a, v in r.items() for i, d in enumerate(days)], "date date, asset string, r double")
    return days, rows, r, returns


def test_thirteen_specifications(spark):
    assert len({s.name for s in portfolio.GRID}) == 13
    days, rows, _, returns = market(spark)
    out = portfolio.grid(spark.createDataFrame([(days[300],), (days[-1],)], "date date"), rows, returns, starts=4).toPandas()
    totals = out.groupby(["specification", "strategy", "date"])["weight"].sum()
    assert len(totals) == 13 * 2 * 2 and np.allclose(totals, 1)
    by = {k: v.set_index("asset")["weight"] for k, v in out[out["date"] == days[-1]].groupby(["specification", "strategy"])}
    assert set(by["core_universe", "regime_mixture"].index) == {"A", "N"} and by["cap_40", "window_lw"].max() <= 0.4 + 1e-9
    lw = by["primary", "window_lw"]
    assert all(np.allclose(by[s.name, "window_lw"], lw) for s in portfolio.GRID if s.cap == 0.6 and not s.universe)
    assert not np.allclose(by["primary", "regime_mixture"], by["neff_kappa_120", "regime_mixture"], atol=1e-9)


def test_covariance_panel_ladder_and_audit(spark):
    """Nine estimators against numpy, the consumed matrix, six strategies and their audit."""
    days, rows, r, returns = market(spark)
    origins = spark.createDataFrame([(days[300],), (days[-1],)], "date date")
    panel = portfolio.covariance_panel(origins, rows, returns, seeds=range(4))
    panel = spark.createDataFrame(panel.collect(), panel.schema)
    pdf = panel.toPandas()
    names = {"sample", "ewma", "ledoit_wolf", "state_0_raw", "state_0_shrunk", "state_1_raw", "state_1_shrunk", "regime_mixture", "consumed"}
    assert set(pdf["estimator"]) == names and len(pdf) == 2 * 9 * 9
    last = pdf[pdf["origin"] == days[-1]]
    of = lambda name: last[last["estimator"] == name].pivot(index="asset_i", columns="asset_j", values="covariance").to_numpy()
    x = np.column_stack([r[a] for a in "ANR"])
    assert np.allclose(of("sample"), np.cov(x.T)) and np.allclose(of("ledoit_wolf"), matrix.ledoit_wolf(x)[0])
    about = last.drop_duplicates("estimator").set_index("estimator")
    for k in (0, 1):
        alpha = about["n_eff"][f"state_{k}_raw"] / (about["n_eff"][f"state_{k}_raw"] + 60)
        assert np.allclose(of(f"state_{k}_shrunk"), alpha * of(f"state_{k}_raw") + (1 - alpha) * of("ledoit_wolf"))
    p = about["p_bar_high"]["regime_mixture"]
    assert np.allclose(of("regime_mixture"), (1 - p) * of("state_0_shrunk") + p * of("state_1_shrunk"))
    used = "ledoit_wolf" if about["fallback_used"]["consumed"] else "regime_mixture"
    assert np.allclose(of("consumed"), of(used)) and (about["between_norm"].notna() == (about.index == "regime_mixture")).all()
    assert of("state_1_raw")[0, 0] > of("state_0_raw")[0, 0]

    weights = portfolio.ladder(panel, returns)
    weights = spark.createDataFrame(weights.collect(), weights.schema)
    w = weights.toPandas()
    assert set(w["strategy"]) == set(portfolio.STRATEGIES) and np.allclose(w.groupby(["strategy", "date"])["weight"].sum(), 1)
    mine = w[(w["strategy"] == "regime_aware") & (w["date"] == days[-1])].sort_values("asset")["weight"].to_numpy()
    assert np.allclose(mine, matrix.min_variance(of("consumed"), 0.6))
    audit = portfolio.optimizer_audit(panel, weights.filter("strategy <> 'ewma_scaled'")).toPandas()
    assert len(audit) == 12 and (audit["fallback_requested"] == (audit["strategy"] == "ewma_scaled")).all()
    assert audit["constraint_violation"].fillna(0).max() < 1e-9 and audit["matrix_hash"].notna().sum() == 4
    assert portfolio.optimizer_summary(portfolio.optimizer_audit(panel, weights)).filter("n_fallback > 0").count() == 0
    assert portfolio.conditioning_summary(panel).count() == 9


def test_fallback_consumes_ledoit_wolf():
    rng = np.random.default_rng(1)
    x, gamma = rng.normal(size=(300, 3)), rng.dirichlet([1, 1, 1], 300)
    p = rng.dirichlet([5, 1, 1], 3)
    for fallback in (True, False):
        made, weight, norm = matrix.estimators(x, gamma, gamma[-1], p, fallback)
        assert np.allclose(made["consumed"][0], made["ledoit_wolf" if fallback else "regime_mixture"][0]) and norm > 0
    steps = [gamma[-1] @ np.linalg.matrix_power(p, h) for h in range(1, 22)]
    assert np.allclose(weight, np.mean(steps, axis=0))
    wider = matrix.estimators(x, gamma, gamma[-1], p, False, between=True)[0]["regime_mixture"][0]
    assert np.linalg.eigvalsh(wider - made["regime_mixture"][0])[0] > -1e-12
    with pytest.raises(ValueError):
        matrix.ahead(gamma[-1], p, 0)


def test_family_and_closing_checks(spark):
    specs = [s.name for s in portfolio.GRID]
    rows = spark.createDataFrame([(n, 0.01 * (i - 3), 0.1, -0.2, 0.3, 0.01 * (i + 1), 250) for i, n in enumerate(specs)], "comparison string, observed double, bootstrap_sd double, ci_low double, ci_high double, p_one_sided double, n_evaluation_days long")
    family = portfolio.grid_family(rows)
    got = {r.specification: r for r in family.collect()}
    assert got["primary"].p_holm is None and abs(got["hmm_3_states"].p_holm - 12 * 0.02) < 1e-12
    assert got["cap_40"].sign_matches_primary is False and got["drop_vix"].sign_matches_primary
    day = dt.date(2020, 1, 1)
    net = spark.createDataFrame([(n, s, day, 0.01) for n in specs for s in ("window_lw", "regime_mixture")], "specification string, strategy string, date date, net_return double")
    checks = {r.check: r.ok for r in portfolio.closing_checks(family, net).collect()}
    assert len(checks) == 12 and all(checks.values())
    bad = portfolio.closing_checks(family.filter("specification <> 'cap_40'"), net.filter("specification <> 'primary' or strategy = 'window_lw'"))
    assert {r.check for r in bad.collect() if not r.ok} == {"all_specifications", "legs_share_days"}
