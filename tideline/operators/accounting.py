"""Daily drift, trades and costs of target weights in closed form, and performance metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

DAYS = 252


def simulate(returns: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths of strategies that start in cash at their first execution day, let old holdings earn that day's return
    and trade at its close; a null target is a fallback: no trade. returns: date, asset, r. targets: strategy, date (execution),
    asset, weight. Between executions a holding grows by a running product, so there is no day loop.
    Gives weights (strategy, date, asset, pre, post, trade) and events (strategy, date, gross_return, full_trade_sum, executed)."""
    start = targets.groupBy("strategy").agg(F.min("date").alias("start"))
    grid = returns.select("date", "asset", "r").join(F.broadcast(start), F.col("date") >= F.col("start"))
    rows = grid.join(targets.select("strategy", "date", "asset", F.col("weight").alias("w")), ["strategy", "date", "asset"], "left")
    path = Window.partitionBy("strategy", "asset").orderBy("date")
    day = Window.partitionBy("strategy", "date")
    rows = rows.withColumn("segment", F.count("w").over(path))
    held = Window.partitionBy("strategy", "asset", "segment").orderBy("date")
    growth = F.product(F.when(F.col("w").isNotNull(), F.lit(1.0)).otherwise(1 + F.col("r"))).over(held)
    rows = rows.withColumn("v", F.last("w", ignorenulls=True).over(path) * growth)
    rows = rows.withColumn("post", F.coalesce("w", F.col("v") / F.nullif(F.sum("v").over(day), F.lit(0.0)), F.lit(0.0)))
    rows = rows.withColumn("held", F.coalesce(F.lag("post").over(path), F.lit(0.0))).withColumn("grown", F.col("held") * (1 + F.col("r")))
    rows = rows.withColumns({"before": F.sum("held").over(day), "total": F.sum("grown").over(day)})
    rows = rows.withColumn("pre", F.when((F.col("before") > 0) & (F.col("total") > 0), F.col("grown") / F.col("total")).otherwise(F.col("held")))
    rows = rows.withColumn("trade", F.coalesce(F.col("w") - F.col("pre"), F.lit(0.0)))
    events = rows.groupBy("strategy", "date").agg(
        F.max(F.when(F.col("before") > 0, F.col("total") - F.col("before")).otherwise(0.0)).alias("gross_return"), F.sum(F.abs("trade")).alias("full_trade_sum"), F.max(F.col("w").isNotNull()).alias("executed"),
    )
    return rows.select("strategy", "date", "asset", "pre", "post", "trade"), events


def net_returns(events: DataFrame, costs: tuple[float, ...] = (0.0, 5.0, 10.0, 25.0)) -> DataFrame:
    """Net of proportional costs on the full trade sum, once for each cost in basis points."""
    rows = events.withColumn("cost_bps", F.explode(F.array(*map(F.lit, map(float, costs)))))
    rows = rows.withColumn("cost_fraction", C.from_bps(F.col("cost_bps")) * F.col("full_trade_sum"))
    rows = rows.withColumn("net_return", (1 + F.col("gross_return")) * (1 - F.col("cost_fraction")) - 1)
    return rows.withColumn("wealth", C.wealth("net_return", "strategy", "cost_bps"))


def risk_free(days: DataFrame, rates: DataFrame, value: str = "rate") -> DataFrame:
    """date, rf: yesterday's rate in percent a year over the calendar days since, ACT/360; 0 on the first day. rates is on the same days."""
    w = Window.orderBy("date")
    rows = days.join(rates, "date", "left")
    accrued = F.lag(value).over(w) / 100 * F.datediff("date", F.lag("date").over(w)) / 360
    return rows.select("date", F.coalesce(accrued, F.lit(0.0)).alias("rf"))


def performance(net: DataFrame, rf: DataFrame, *keys: str) -> DataFrame:
    """Growth, volatility, ratios, drawdown, tails and turnover of each key's net returns."""
    rows = net.join(rf, "date", "left").withColumn("x", F.col("net_return") - F.coalesce("rf", F.lit(0.0)))
    rows = rows.withColumn("dd", F.col("wealth") / F.greatest(F.max("wealth").over(C.expanding(*keys)), F.lit(1.0)) - 1)
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_days"), F.max_by("wealth", "date").alias("final_wealth"), F.datediff(F.max("date"), F.min("date")).alias("d"), (F.stddev_samp("net_return") * DAYS**0.5).alias("ann_vol"),
        (F.try_divide(F.avg("x"), F.stddev_samp("x")) * DAYS**0.5).alias("sharpe"), (F.try_divide(F.avg("x"), F.sqrt(F.avg(F.least("x", F.lit(0.0)) ** 2))) * DAYS**0.5).alias("sortino"),
        F.min("dd").alias("max_drawdown"), F.percentile("net_return", 0.05).alias("q05"), F.percentile("net_return", 0.01).alias("q01"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.max("net_return").alias("best_day"), F.min("net_return").alias("worst_day"), (F.avg((F.col("net_return") > 0).cast("double")) * 100).alias("positive_days_pct"), F.sum("full_trade_sum").alias("traded"), F.sum("cost_fraction").alias("paid"),
    )
    below = lambda q: -F.avg(F.when(F.col("net_return") <= F.col(q), F.col("net_return")))
    tail = rows.join(out.select(*keys, "q05", "q01"), list(keys)).groupBy(*keys).agg(below("q05").alias("es95"), below("q01").alias("es99"))
    years = F.col("n_days") / DAYS
    out = out.join(tail, list(keys)).withColumn("cagr", F.when(F.col("d") > 0, F.pow("final_wealth", F.lit(365.25) / F.col("d")) - 1))
    return out.withColumns({"calmar": F.try_divide("cagr", F.abs("max_drawdown")), "var95": -F.col("q05"), "var99": -F.col("q01"), "years": F.col("d") / 365.25, "ann_turnover": F.col("traded") / years, "ann_cost": F.col("paid") / years}).drop("d", "q05", "q01", "traded", "paid")


def safeguards(net: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """Checks on net returns: free trading equals gross, wealth falls with cost, all have the same dates; with a performance summary, its growth is that of the returns."""
    free = net.filter("cost_bps = 0").agg(F.max(F.abs(F.col("net_return") - F.col("gross_return"))).alias("gap")).select(F.lit("zero_cost_equals_gross").alias("check"), (F.col("gap") < 1e-12).alias("ok"))
    ends = net.groupBy("strategy", "cost_bps").agg(F.max_by("wealth", "date").alias("wealth"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("strategy").orderBy("cost_bps")
    falls = ends.withColumn("up", F.col("wealth") > F.lag("wealth").over(w) + 1e-12).agg(F.max(F.coalesce("up", F.lit(False))).alias("up")).select(F.lit("wealth_falls_with_cost").alias("check"), (~F.col("up")).alias("ok"))
    same = ends.agg(F.count_distinct("n").alias("k")).select(F.lit("same_dates").alias("check"), (F.col("k") == 1).alias("ok"))
    out = free.unionByName(falls).unionByName(same)
    if summary is not None:
        days = F.datediff(F.max("date"), F.min("date"))
        own = net.groupBy("strategy", "cost_bps").agg((F.exp(F.sum(F.log1p("net_return")) * F.lit(365.25) / days) - 1).alias("own"))
        gap = summary.join(own, ["strategy", "cost_bps"]).agg(F.max(F.abs(F.col("cagr") - F.col("own"))).alias("gap"))
        out = out.unionByName(gap.select(F.lit("cagr_reconciles").alias("check"), (F.col("gap") < 1e-8).alias("ok")))
    return out


def rolling_sharpe(rows: DataFrame, value: str, n: int, *keys: str) -> DataFrame:
    w = C.trailing(n, *keys)
    ratio = F.try_divide(F.avg(value).over(w), F.stddev_samp(value).over(w)) * DAYS**0.5
    return rows.withColumn("rolling_sharpe", C.full(ratio, F.col(value), n, w))


def concentration(weights: DataFrame) -> DataFrame:
    """Per strategy: mean effective number of holdings and mean largest weight."""
    daily = weights.groupBy("strategy", "date").agg(F.sum(F.col("post") ** 2).alias("h"), F.max("post").alias("top"))
    return daily.groupBy("strategy").agg(F.avg(F.try_divide(F.lit(1.0), F.col("h"))).alias("effective_n"), F.avg("top").alias("mean_max_weight"))


def validate_weights(weights: DataFrame, cap: float, tol: float = 1e-8) -> DataFrame:
    """Per (strategy, date): the worst violation of sum, sign and cap, whether it is clean, and how many weights are at the cap."""
    out = weights.groupBy("strategy", "date").agg(F.abs(F.sum("weight") - 1).alias("a"), F.max(-F.col("weight")).alias("b"), F.max(F.col("weight") - cap).alias("c"), F.sum((F.abs(F.col("weight") - cap) < 1e-6).cast("long")).alias("at_cap"))
    return out.withColumn("violation", F.greatest("a", "b", "c", F.lit(0.0))).withColumn("clean", F.col("violation") <= tol).drop("a", "b", "c")
