"""Regime features, expanding-window hidden Markov fits, their routing and diagnostics.

The panel of one market is small (a row a day), its fits are not: the work is spread over origins,
each group holding one origin's window, with every start of a fit in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..kernels import garch, hmm
from .align import expanding_windows, read_off

FEATURES = ("mkt_log_return", "realized_vol_21d", "log_vix_lag1", "yield_slope_lag1")
#: Partitions over which the fits of a panel are spread.
GROUPS = 64
FITS = "origin date, n_obs long, seed long, loglik double, converged boolean, n_iter long, selected boolean, within_tol boolean"
STATES = (
    "origin date, n_obs long, selected_seed long, p_high double, persistence array<double>, occupancy array<double>, n_eff array<double>, duration array<double>, mean_vol array<double>, min_eigenvalue array<double>, "
    "mu array<array<double>>, transition array<array<double>>, fallback_used boolean, fallback_reason string, guard_triggered boolean"
)
PATHS = "origin date, date date, filtered double, smoothed double"


def features(market: DataFrame, macro: DataFrame) -> DataFrame:
    """market: date, price. macro: date, vix, long_rate, short_rate on the same days. Macro values are lagged a day; incomplete rows go."""
    w = Window.orderBy("date")
    m = market.withColumn("mkt_log_return", F.log("price") - F.log(F.lag("price").over(w)))
    n = F.count("mkt_log_return").over(w.rowsBetween(-20, 0))
    m = m.withColumn("realized_vol_21d", F.when(n == 21, F.stddev_samp("mkt_log_return").over(w.rowsBetween(-20, 0))))
    x = macro.select("date", F.lag(F.log("vix")).over(w).alias("log_vix_lag1"), F.lag(F.col("long_rate") - F.col("short_rate")).over(w).alias("yield_slope_lag1"))
    return m.join(x, "date").select("date", *FEATURES).dropna()


def expanding_scores(origins: DataFrame, rows: DataFrame, names: Sequence[str] = FEATURES) -> DataFrame:
    """Each origin's last row standardised over its window, by running moments read off at the origins; a constant column is only centred."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    moments = {f"{t}_{n}": f(n).over(w) for n in names for t, f in (("m", F.avg), ("s", F.stddev_samp))}
    out = read_off(rows.select("date", *names).withColumns(moments | {"n_obs": F.count(F.lit(1)).over(w)}), origins)
    return out.select("origin", "n_obs", *[((F.col(n) - F.col(f"m_{n}")) / F.when(F.col(f"s_{n}") > 0, F.col(f"s_{n}")).otherwise(1.0)).alias(n) for n in names])


def threshold_rule(rows: DataFrame, value: str = "realized_vol_21d", min_obs: int = 252) -> DataFrame:
    """date, high: the value is above its expanding median, from min_obs rows on."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select("date", F.col(value).alias("v")).withColumns({"median": F.percentile("v", 0.5).over(w), "k": F.count("v").over(w)})
    return out.filter(F.col("k") >= min_obs).select("date", "median", (F.col("v") > F.col("median")).alias("high"))


def _windows(origins: DataFrame, rows: DataFrame, names: Sequence[str], min_obs: int) -> DataFrame:
    win = expanding_windows(origins, rows).select("origin", "date", *names)
    # a few rows but long fits: a fixed count of partitions keeps adaptive execution from putting them in one task
    win = win.repartition(GROUPS, "origin")
    return win.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("origin"))).filter(F.col("n") >= min_obs).drop("n")


def _fit(pdf: pd.DataFrame, names: Sequence[str], k: int, seeds: Sequence[int], label_by: str, n_iter: int):
    pdf = pdf.sort_values("date")
    raw = pdf[list(names)].to_numpy(float)
    x = hmm.standardize(raw)
    results = hmm.fit(x, k, list(seeds), n_iter)
    # where every start runs to the limit those count as converged, as in the study's library
    model = hmm.select(results) or hmm.select([r | {"converged": r["n_iter"] == n_iter} for r in results])
    if model is None:
        raise RuntimeError(f"no start converged at {pdf['origin'].iloc[0]}")
    _, gamma = hmm.posteriors(model, x)
    series = pdf[label_by].to_numpy(float) if label_by in pdf else np.abs(raw[:, 0])
    order = np.argsort((gamma * series[:, None]).sum(axis=0) / np.maximum(gamma.sum(axis=0), 1e-300), kind="stable")
    model = hmm.permute(model, order)
    filtered, gamma = hmm.posteriors(model, x)
    return pdf, results, model, filtered, gamma


def weighted_means(gamma: np.ndarray, series: pd.Series) -> list[float]:
    """The raw series' mean by each state's responsibilities."""
    return ((gamma * series.to_numpy(float)[:, None]).sum(axis=0) / np.maximum(gamma.sum(axis=0), 1e-300)).tolist()


def fit_starts(origins: DataFrame, rows: DataFrame, names: Sequence[str] = FEATURES, k: int = 2, seeds: Sequence[int] = tuple(range(16)), min_obs: int = 252, n_iter: int = 200) -> DataFrame:
    """Every start of every origin with its likelihood, and which was selected."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        results = hmm.fit(hmm.standardize(pdf.sort_values("date")[list(names)].to_numpy(float)), k, list(seeds), n_iter)
        return pd.DataFrame([{"origin": pdf["origin"].iloc[0], "n_obs": len(pdf), **{c: r[c] for c in ("seed", "loglik", "converged", "n_iter")}, "selected": False, "within_tol": False} for r in results])

    raw = _windows(origins, rows, names, min_obs).groupBy("origin").applyInPandas(run, FITS)
    return select_starts(raw.drop("selected", "within_tol"))


def select_starts(starts: DataFrame, rel: float = 1e-10) -> DataFrame:
    """Marks, per origin, the lowest seed among converged starts within the tolerance of the best likelihood."""
    w = Window.partitionBy("origin")
    ok = F.col("converged") & ~F.isnan("loglik") & F.col("loglik").isNotNull()
    best = F.max(F.when(ok, F.col("loglik"))).over(w)
    marked = starts.withColumn("within_tol", F.coalesce(ok & (F.col("loglik") >= best - rel * F.greatest(F.lit(1.0), F.abs(best))), F.lit(False)))
    return marked.withColumn("selected", F.col("within_tol") & (F.col("seed") == F.min(F.when(F.col("within_tol"), F.col("seed"))).over(w)))


def fit_states(origins: DataFrame, rows: DataFrame, names: Sequence[str] = FEATURES, k: int = 2, seeds: Sequence[int] = tuple(range(16)), min_obs: int = 252, label_by: str = "realized_vol_21d", n_iter: int = 200) -> DataFrame:
    """Per origin: the selected model in canonical order (last state most volatile), its endpoint probability and diagnostics."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, _, model, filtered, gamma = _fit(pdf, names, k, seeds, label_by, n_iter)
        d = hmm.diagnose(model, gamma)
        return pd.DataFrame([{"origin": pdf["origin"].iloc[0], "n_obs": len(pdf), "selected_seed": model["seed"], "p_high": float(filtered[-1, -1]), "mu": model["mu"].tolist(), "transition": model["p"].tolist(), "mean_vol": weighted_means(gamma, pdf[label_by] if label_by in pdf else pdf[names[0]].abs()), **d}])[[c.split()[0] for c in STATES.split(", ")]]

    return _windows(origins, rows, names, min_obs).groupBy("origin").applyInPandas(run, STATES)


def state_paths(origins: DataFrame, rows: DataFrame, names: Sequence[str] = FEATURES, k: int = 2, seeds: Sequence[int] = tuple(range(16)), min_obs: int = 252, label_by: str = "realized_vol_21d", n_iter: int = 200) -> DataFrame:
    """Filtered and smoothed probability of the most volatile state on every date of each origin's window."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, _, _, filtered, gamma = _fit(pdf, names, k, seeds, label_by, n_iter)
        return pd.DataFrame({"origin": pdf["origin"], "date": pdf["date"], "filtered": filtered[:, -1], "smoothed": gamma[:, -1]})

    return _windows(origins, rows, names, min_obs).groupBy("origin").applyInPandas(run, PATHS)


def monthly_changes(states: DataFrame) -> DataFrame:
    """Classification, change of probability and of class since the origin before (false at the first)."""
    w = Window.orderBy("origin")
    out = states.withColumn("high", F.col("p_high") > 0.5)
    return out.withColumns({"p_change": F.col("p_high") - F.lag("p_high").over(w), "class_changed": F.coalesce(F.col("high") != F.lag("high").over(w), F.lit(False))})


def revisions(paths: DataFrame) -> DataFrame:
    """How an origin's smoothed path differs from the one before, on the dates both have."""
    order = paths.select("origin").distinct().withColumn("before", F.lag("origin").over(Window.orderBy("origin"))).filter("before is not null")
    now = paths.join(order, "origin").select("origin", "before", "date", F.col("smoothed").alias("x"))
    then = paths.select(F.col("origin").alias("before"), "date", F.col("smoothed").alias("y"))
    both = now.join(then, ["before", "date"])
    d = F.abs(F.col("x") - F.col("y"))
    return both.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_abs"), F.max(d).alias("max_abs"), F.corr("x", "y").alias("correlation"), F.avg(((F.col("x") > 0.5) == (F.col("y") > 0.5)).cast("double")).alias("agreement"))


def routing(flags: DataFrame) -> DataFrame:
    """fallback_reason (in fixed order) and fallback_used from the flags absorbing, degenerate and singular."""
    reason = F.concat_ws(";", F.when(F.col("absorbing"), "absorbing_state"), F.when(F.col("degenerate"), "degenerate_occupancy"), F.when(F.col("singular"), "singular_covariance"))
    return flags.withColumn("fallback_reason", reason).withColumn("fallback_used", F.col("fallback_reason") != "")


def garch_forecasts(ends: DataFrame, returns: DataFrame, horizons: DataFrame, fit: Callable[[np.ndarray, int], tuple[float, bool]] = garch.forecast) -> DataFrame:
    """date, asset, forecast_ivar, converged of a GARCH(1,1), or another ``fit`` of returns and days, on all returns up to each origin; horizons: date, asset, horizon_days."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        value, ok = fit(pdf["r"].to_numpy(float), int(pdf["horizon_days"].iloc[0]))
        return pd.DataFrame([{"date": pdf["origin"].iloc[0], "asset": pdf["asset"].iloc[0], "forecast_ivar": value if np.isfinite(value) else None, "converged": ok}])

    win = expanding_windows(ends, returns.filter("r is not null")).join(horizons.select(F.col("date").alias("origin"), "asset", "horizon_days"), ["origin", "asset"])
    return win.repartition(GROUPS, "origin", "asset").groupBy("origin", "asset").applyInPandas(run, "date date, asset string, forecast_ivar double, converged boolean")


def summary(states: DataFrame) -> DataFrame:
    """One row for each state of the fits: origins, fallbacks by kind, least occupancy and effective size, mean persistence, and whether the ordering by volatility holds."""
    each = states.select("origin", "fallback_reason", "guard_triggered", F.posexplode(F.arrays_zip("occupancy", "n_eff", "persistence", "mean_vol")).alias("state", "x")).select("origin", "fallback_reason", "guard_triggered", "state", "x.*")
    has = lambda reason: F.sum(F.col("fallback_reason").contains(reason).cast("long"))
    out = each.groupBy("state").agg(
        F.count(F.lit(1)).alias("n_origins"), has("absorbing").alias("n_absorbing"), has("occupancy").alias("n_degenerate"), has("singular").alias("n_singular"), F.sum(F.col("guard_triggered").cast("long")).alias("n_guard_triggered"),
        F.min("occupancy").alias("min_occupancy"), F.avg("occupancy").alias("mean_occupancy"), F.min("n_eff").alias("min_n_eff"), F.avg("persistence").alias("mean_persistence"), F.avg("mean_vol").alias("mean_realized_vol"),
    )
    w = Window.orderBy("state")  # one row for each state
    return out.withColumn("ordered", F.coalesce(F.col("mean_realized_vol") > F.lag("mean_realized_vol").over(w), F.lit(True)))


def transitions(states: DataFrame) -> DataFrame:
    """origin, from_state, to_state, probability of every fit."""
    rows = states.select("origin", F.posexplode("transition").alias("from_state", "row"))
    return rows.select("origin", "from_state", F.posexplode("row").alias("to_state", "probability"))


def parameter_revisions(states: DataFrame) -> DataFrame:
    """How an origin's parameters differ from those of the one before: L2 norm of the means' change, L1 norm of the transitions', and whether another seed was selected."""
    w = Window.orderBy("origin")  # one row for each origin
    flat = lambda c: F.flatten(F.col(c))
    rows = states.select("origin", flat("mu").alias("mu"), flat("transition").alias("p"), "selected_seed")
    rows = rows.withColumns({f"before_{c}": F.lag(c).over(w) for c in ("mu", "p", "selected_seed")}).filter("before_mu is not null")
    gaps = lambda c: F.zip_with(c, f"before_{c}", lambda x, y: x - y)
    total = lambda xs, f: F.aggregate(F.transform(xs, f), F.lit(0.0), lambda acc, x: acc + x)
    return rows.select("origin", F.sqrt(total(gaps("mu"), lambda x: x * x)).alias("mean_norm"), total(gaps("p"), F.abs).alias("transition_norm"), (F.col("selected_seed") != F.col("before_selected_seed")).alias("seed_changed"))
