"""Volatility forecasts and their scores; covariances, shrinkage and regime mixtures, as long entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .align import holding_days

LAMBDA, SEED_OBS, FLOOR = 0.94, 63, 1e-8


def ewma_variance_closed(returns: DataFrame, value: str = "r", lam: float = LAMBDA, seed_obs: int = SEED_OBS, block: int = 250) -> DataFrame:
    """v_n = lam * v_(n-1) + (1 - lam) * r_n**2 from observation seed_obs on, started from the sample variance of the first seed_obs (whose last
    is then applied too), as running sums: within blocks of rows lam**-k stays small, and blocks chain by their last value."""
    w = C.by("asset")
    rows = returns.filter(F.col(value).isNotNull()).withColumn("k", F.row_number().over(w))
    seed = rows.filter(F.col("k") <= seed_obs).groupBy("asset").agg(F.when(F.count(F.lit(1)) == seed_obs, F.var_samp(value)).alias("seed"))
    rows = rows.join(seed, "asset").filter("seed is not null").filter(F.col("k") >= seed_obs)
    rows = rows.withColumns({"block": F.floor((F.col("k") - seed_obs) / block), "i": (F.col("k") - seed_obs) % block + 1})
    inner = Window.partitionBy("asset", "block").orderBy("i")
    rows = rows.withColumn("own", F.pow(F.lit(lam), F.col("i")) * F.sum((1 - lam) * F.col(value) ** 2 * F.pow(F.lit(lam), -F.col("i"))).over(inner))
    last = rows.groupBy("asset", "block").agg(F.max_by("own", "i").alias("own"), F.max("i").alias("n"), F.first("seed").alias("seed"))
    chain = F.collect_list(F.struct("own", "n")).over(Window.partitionBy("asset").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    start = F.aggregate(chain, F.col("seed"), lambda acc, x: acc * F.pow(F.lit(lam), x["n"]) + x["own"])
    starts = last.select("asset", "block", start.alias("start"))
    return rows.drop("seed").join(starts, ["asset", "block"]).select("asset", "date", (F.col("start") * F.pow(F.lit(lam), F.col("i")) + F.col("own")).alias("ewma_variance"))


def realized(ends: DataFrame, returns: DataFrame) -> DataFrame:
    """Sum of squared log returns and days of each holding period."""
    held = holding_days(ends, returns.filter("r is not null"))
    return held.groupBy(F.col("origin").alias("date"), "next_date", "asset").agg(F.sum(F.col("r") ** 2).alias("realized_ivar"), F.count(F.lit(1)).alias("horizon_days"))


def forecasts(ends: DataFrame, returns: DataFrame, garch: DataFrame | None = None, floor: float = FLOOR) -> DataFrame:
    """Integrated variance forecasts of each origin, asset and model; garch: date, asset, forecast_ivar, converged. Where it
    failed or did not converge, the exponentially weighted forecast stands in, flagged."""
    hist = returns.withColumn("v", C.rolling_var("r", 63, "asset")).filter("v is not null").select("date", "asset", "v")
    ewma = ewma_variance_closed(returns).withColumnRenamed("ewma_variance", "v")
    truth = realized(ends, returns)
    flags = {"converged": F.lit(True), "substituted": F.lit(False)}
    both = hist.withColumn("model", F.lit("hist63")).unionByName(ewma.withColumn("model", F.lit("ewma")))
    out = truth.join(both, ["date", "asset"]).withColumn("raw", F.col("v") * F.col("horizon_days")).withColumns(flags).drop("v")
    if garch is not None:
        base = truth.join(ewma, ["date", "asset"]).join(garch, ["date", "asset"], "left")
        good = F.coalesce(F.col("converged"), F.lit(False)) & F.col("forecast_ivar").isNotNull()
        own = base.withColumn("raw", F.when(good, F.col("forecast_ivar")).otherwise(F.col("v") * F.col("horizon_days"))).withColumns({"substituted": ~good, "converged": F.coalesce("converged", F.lit(False))}).withColumn("model", F.lit("garch11"))
        out = out.unionByName(own.select(*out.columns))
    least = F.lit(floor) * F.col("horizon_days")
    return out.withColumns({"forecast_ivar": F.greatest("raw", least), "floored": F.col("raw") < least}).drop("raw")


def losses(fc: DataFrame, oos_start: str) -> DataFrame:
    """Mean QLIKE, absolute and root squared error (times 1e4), of all origins and of those from oos_start on."""
    e, q = F.col("forecast_ivar") - F.col("realized_ivar"), C.qlike(F.col("realized_ivar"), F.col("forecast_ivar"))
    late = F.col("date") >= F.lit(oos_start).cast("date")
    make = lambda tag, on: [F.avg(F.when(on, q)).alias(f"qlike{tag}"), (F.avg(F.when(on, F.abs(e))) * 1e4).alias(f"mae{tag}"), (F.sqrt(F.avg(F.when(on, e * e))) * 1e4).alias(f"rmse{tag}"), F.sum(on.cast("long")).alias(f"n{tag}")]
    return fc.groupBy("asset", "model").agg(*make("", F.lit(True)), *make("_oos", late))


def newey_west(diffs: DataFrame, keys: list[str], value: str, lags: int) -> DataFrame:
    """Mean, its HAC standard error (Bartlett weights) and z, of each key's series in date order."""
    mean = diffs.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    rows = diffs.join(mean, keys).withColumn("e", F.col(value) - F.col("mean"))
    w = C.by(*keys)
    products = [F.sum(F.col("e") * F.col("e")).alias("g0")]
    for j in range(1, lags + 1):
        rows = rows.withColumn(f"e{j}", F.lag("e", j).over(w))
        products.append(F.coalesce(F.sum(F.col("e") * F.col(f"e{j}")), F.lit(0.0)).alias(f"g{j}"))
    out = rows.groupBy(*keys, "mean", "n").agg(*products)
    total = F.col("g0")
    for j in range(1, lags + 1):
        total = total + 2 * (1 - j / (lags + 1)) * F.col(f"g{j}")
    out = out.withColumn("se", F.sqrt(total) / F.col("n")).withColumn("z", F.try_divide("mean", "se"))
    return out.select(*keys, "mean", "n", "se", "z")


def diebold_mariano(fc: DataFrame, a: str, b: str, lags: int = 3) -> DataFrame:
    """Per asset: mean QLIKE difference of two models with HAC interval and the favoured model."""
    q = fc.withColumn("q", C.qlike(F.col("realized_ivar"), F.col("forecast_ivar")))
    wide = q.groupBy("date", "asset").agg(F.max(F.when(F.col("model") == a, F.col("q"))).alias("qa"), F.max(F.when(F.col("model") == b, F.col("q"))).alias("qb"))
    out = newey_west(wide.withColumn("d", F.col("qa") - F.col("qb")).filter("d is not null"), ["asset"], "d", lags)
    return out.withColumns({"p_value": normal_p(F.col("z")), "ci_low": F.col("mean") - 1.96 * F.col("se"), "ci_high": F.col("mean") + 1.96 * F.col("se"), "favours": F.when(F.col("mean") < 0, a).otherwise(b)})


def normal_p(z):
    """Two-sided normal p-value, by a series of exp and arithmetic good to 1e-7 or so (there is no erf in SQL)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.5 * x)
    # the Chebyshev fit of erfc in Numerical Recipes, section 6.2; fixed values
    c = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(c[-1])
    for k in reversed(c[:-1]):
        poly = poly * t + F.lit(k)
    return t * F.exp(-x * x + poly)


def holm(tests: DataFrame, p: str, *family: str) -> DataFrame:
    """Holm-adjusted p-values within a family."""
    w = Window.partitionBy(*family).orderBy(p, "test")
    m = F.count(F.lit(1)).over(Window.partitionBy(*family))
    step = F.least((m - F.row_number().over(w) + 1) * F.col(p), F.lit(1.0))
    return tests.withColumn("step", step).withColumn("p_holm", F.max("step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("step")


# -- covariances -----------------------------------------------------------------------------------


def pairs(returns: DataFrame, value: str = "r") -> DataFrame:
    i = returns.select("date", F.col("asset").alias("asset_i"), F.col(value).alias("x"))
    return i.join(returns.select("date", F.col("asset").alias("asset_j"), F.col(value).alias("y")), "date")


def sample_covariance(returns: DataFrame) -> DataFrame:
    return pairs(returns).groupBy("asset_i", "asset_j").agg(F.covar_samp("x", "y").alias("covariance"))


def rolling_covariance(returns: DataFrame, n: int) -> DataFrame:
    """Entries of every full window of n dates."""
    w = Window.partitionBy("asset_i", "asset_j").orderBy("date").rowsBetween(1 - n, 0)
    return pairs(returns).withColumns({"covariance": F.covar_samp("x", "y").over(w), "k": F.count(F.lit(1)).over(w)}).filter(F.col("k") == n).select("date", "asset_i", "asset_j", "covariance")


def weighted_covariance(rows: DataFrame, *keys: str) -> DataFrame:
    """Entries around weighted means, of rows date, asset, r, weight (of a date, within the keys)."""
    means = rows.groupBy(*keys, "asset").agg((F.sum(F.col("weight") * F.col("r")) / F.sum("weight")).alias("m"))
    centred = rows.join(means, [*keys, "asset"]).withColumn("c", F.col("r") - F.col("m"))
    i = centred.select(*keys, "date", "weight", F.col("asset").alias("asset_i"), F.col("c").alias("x"))
    j = centred.select(*keys, "date", F.col("asset").alias("asset_j"), F.col("c").alias("y"))
    return i.join(j, [*keys, "date"]).groupBy(*keys, "asset_i", "asset_j").agg((F.sum(F.col("weight") * F.col("x") * F.col("y")) / F.sum("weight")).alias("covariance"))


def ewma_covariance(returns: DataFrame, lam: float = LAMBDA) -> DataFrame:
    newest = Window.partitionBy("asset").orderBy(F.desc("date"))
    return weighted_covariance(returns.withColumn("weight", F.pow(F.lit(lam), F.row_number().over(newest) - 1)))


def effective_sample(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("weight").alias("s"), F.sum(F.col("weight") ** 2).alias("q")).withColumn("n_eff", F.col("s") ** 2 / F.col("q")).drop("s", "q")


def ledoit_wolf(returns: DataFrame) -> DataFrame:
    """Entries shrunk toward the mean variance, and the intensity, from moment sums alone."""
    means = returns.groupBy("asset").agg(F.avg("r").alias("m"))
    x = returns.join(means, "asset").withColumn("c", F.col("r") - F.col("m"))
    entries = pairs(x, "c").groupBy("asset_i", "asset_j").agg(F.avg(F.col("x") * F.col("y")).alias("s"), F.avg(F.col("x") ** 2 * F.col("y") ** 2).alias("f"), F.count(F.lit(1)).alias("n"))
    diagonal = (F.col("asset_i") == F.col("asset_j")).cast("double")
    total = entries.agg(F.sum(F.col("s") * diagonal).alias("trace"), F.sum(diagonal).alias("p"), F.sum(F.col("s") ** 2).alias("ss"), F.sum("f").alias("ff"), F.max("n").alias("nn"))
    total = total.withColumn("mu", F.col("trace") / F.col("p")).withColumn("delta", (F.col("ss") - F.col("p") * F.col("mu") ** 2) / F.col("p"))
    total = total.withColumn("beta", F.least((F.col("ff") - F.col("ss")) / (F.col("p") * F.col("nn")), F.col("delta")))
    total = total.select("mu", F.coalesce(F.try_divide("beta", "delta"), F.lit(0.0)).alias("intensity"), F.lit(1).alias("one"))
    out = entries.withColumn("one", F.lit(1)).join(total, "one")
    return out.select("asset_i", "asset_j", ((1 - F.col("intensity")) * F.col("s") + F.col("intensity") * F.col("mu") * diagonal).alias("covariance"), "intensity")


def ewma_scaled(variances: DataFrame, base: DataFrame) -> DataFrame:
    """Base correlations at the given variances."""
    diagonal = base.filter("asset_i = asset_j").select(F.col("asset_i").alias("asset"), F.col("covariance").alias("d"))
    v = variances.select("asset", F.col("ewma_variance").alias("v")).join(diagonal, "asset")
    out = base.join(v.select(F.col("asset").alias("asset_i"), F.col("v").alias("vi"), F.col("d").alias("di")), "asset_i").join(v.select(F.col("asset").alias("asset_j"), F.col("v").alias("vj"), F.col("d").alias("dj")), "asset_j")
    return out.select("asset_i", "asset_j", (F.sqrt(F.col("vi") * F.col("vj")) * F.col("covariance") / F.sqrt(F.col("di") * F.col("dj"))).alias("covariance"))


def shrink_states(states: DataFrame, pooled: DataFrame, n_eff: DataFrame, strength: float = 60.0) -> DataFrame:
    """Each state's entries pulled to the pooled ones by n_eff / (n_eff + strength)."""
    a = F.col("n_eff") / (F.col("n_eff") + strength)
    out = states.join(n_eff, "state").join(pooled.withColumnRenamed("covariance", "pooled"), ["asset_i", "asset_j"])
    return out.select("state", "asset_i", "asset_j", (a * F.col("covariance") + (1 - a) * F.col("pooled")).alias("covariance"))


def horizon_probabilities(rows: DataFrame, horizon: int) -> DataFrame:
    """Mean over 1..horizon of p * P**h for two states, from columns p0, p00, p11."""
    if horizon < 1:
        raise ValueError("a horizon has at least one day")
    step = lambda acc, _: F.struct((acc["a"] * F.col("p00") + (1 - acc["a"]) * (1 - F.col("p11"))).alias("a"), (acc["s"] + acc["a"] * F.col("p00") + (1 - acc["a"]) * (1 - F.col("p11"))).alias("s"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.struct(F.col("p0").cast("double").alias("a"), F.lit(0.0).alias("s")), step)
    return rows.withColumn("pbar0", done["s"] / horizon).withColumn("pbar1", 1 - F.col("pbar0"))


def mixture(states: DataFrame, weights: DataFrame) -> DataFrame:
    """Sum over states of weight times covariance; weights: state, p."""
    return states.join(weights, "state").groupBy("asset_i", "asset_j").agg(F.sum(F.col("p") * F.col("covariance")).alias("covariance"))


def symmetrized(entries: DataFrame, *keys: str) -> DataFrame:
    """Each entry averaged with its mirror."""
    mirror = entries.select(*keys, F.col("asset_i").alias("asset_j"), F.col("asset_j").alias("asset_i"), F.col("covariance").alias("other"))
    return entries.join(mirror, [*keys, "asset_i", "asset_j"]).select(*keys, "asset_i", "asset_j", ((F.col("covariance") + F.col("other")) / 2).alias("covariance"))


def frobenius(a: DataFrame, b: DataFrame) -> DataFrame:
    """Relative distance of two matrices, and the largest asymmetry of the first."""
    t = a.select(F.col("asset_i").alias("asset_j"), F.col("asset_j").alias("asset_i"), F.col("covariance").alias("t"))
    both = a.join(b.withColumnRenamed("covariance", "c2"), ["asset_i", "asset_j"]).join(t, ["asset_i", "asset_j"])
    return both.agg((F.sqrt(F.sum((F.col("covariance") - F.col("c2")) ** 2)) / F.sqrt(F.sum(F.col("c2") ** 2))).alias("relative_norm"), F.max(F.abs(F.col("covariance") - F.col("t"))).alias("asymmetry"))
