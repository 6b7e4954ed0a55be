"""Summaries, data-quality audits and correlations of long panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def summary_statistics(panel: DataFrame) -> DataFrame:
    """Per asset, of daily simple returns: moments, tails, growth, volatility, drawdown, Jarque-Bera."""
    rows = panel.withColumns({"r": C.simple_return("price", "asset"), "dd": C.drawdown("price", "asset")})
    out = rows.groupBy("asset").agg(
        F.count("r").alias("n"), (F.avg("r") * 1e4).alias("mean_bps"), (F.percentile("r", 0.5) * 1e4).alias("median_bps"), (F.stddev_samp("r") * 100).alias("std_pct"),
        F.skewness("r").alias("skew"), F.kurtosis("r").alias("excess_kurtosis"), F.min("r").alias("min_r"), F.max("r").alias("max_r"),
        F.percentile("r", 0.01).alias("q01"), F.percentile("r", 0.05).alias("q05"), F.avg((F.col("r") > 0).cast("double")).alias("share_positive"),
        F.min_by("price", "date").alias("first_price"), F.max_by("price", "date").alias("last_price"), (F.stddev_samp("r") * 252**0.5).alias("ann_vol"), F.min("dd").alias("max_drawdown"),
    )
    jb = F.col("n") / 6 * (F.col("skew") ** 2 + F.col("excess_kurtosis") ** 2 / 4)
    out = out.withColumn("cagr", F.pow(F.col("last_price") / F.col("first_price"), F.lit(252.0) / F.col("n")) - 1)
    return out.withColumn("jarque_bera", jb).withColumn("jarque_bera_p", F.exp(-F.col("jarque_bera") / 2)).drop("first_price", "last_price")


def macro_summary(macro: DataFrame) -> DataFrame:
    has = F.col("value").isNotNull()
    return macro.groupBy("series_id").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.percentile("value", 0.5).alias("median"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.min_by("value", F.when(has, F.col("date"))).alias("first_value"), F.max_by("value", F.when(has, F.col("date"))).alias("last_value"), F.sum((~has).cast("long")).alias("n_missing"),
    )


def missingness(raw: DataFrame, aligned: DataFrame) -> DataFrame:
    """Per series: rows and nulls before and after alignment, and leading nulls after it."""
    first = aligned.groupBy("series_id").agg(F.min(F.when(F.col("value").isNotNull(), F.col("date"))).alias("first"), F.count(F.lit(1)).alias("aligned_rows"), F.sum(F.col("value").isNull().cast("long")).alias("aligned_missing"))
    leading = aligned.join(first.select("series_id", "first"), "series_id").groupBy("series_id").agg(F.sum((F.col("first").isNull() | (F.col("date") < F.col("first"))).cast("long")).alias("leading_missing"))
    before = raw.groupBy("series_id").agg(F.count(F.lit(1)).alias("raw_rows"), F.sum(F.col("value").isNull().cast("long")).alias("raw_missing"))
    return before.join(first.drop("first"), "series_id", "left").join(leading, "series_id", "left")


def staleness(panel: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: the longest run of equal values, and days and share unchanged."""
    w = C.by(key)
    rows = panel.filter(F.col(value).isNotNull()).withColumn("same", F.col(value) == F.lag(value).over(w))
    rows = rows.withColumn("run", F.sum(F.when(F.col("same"), 0).otherwise(1)).over(w))
    runs = rows.groupBy(key, "run").agg(F.count(F.lit(1)).alias("length"), F.sum(F.coalesce(F.col("same").cast("long"), F.lit(0))).alias("unchanged"))
    out = runs.groupBy(key).agg(F.max("length").alias("longest_run"), F.sum("unchanged").alias("unchanged_days"), F.sum("length").alias("n"))
    return out.withColumn("share_unchanged", F.try_divide(F.col("unchanged_days").cast("double"), (F.col("n") - 1).cast("double"))).drop("n")


def calendar_audit(rows: DataFrame, key: str, threshold: int = 4) -> DataFrame:
    """Per key: rows, first and last date, duplicates, weekend rows, the largest gap and gaps over the threshold."""
    dates = rows.groupBy(key, "date").agg(F.count(F.lit(1)).alias("times"))
    dates = dates.withColumn("gap", F.datediff("date", F.lag("date").over(C.by(key))))
    return dates.groupBy(key).agg(
        F.sum("times").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.sum(F.col("times") - 1).alias("duplicates"),
        F.sum(F.when(F.weekday("date") >= 5, F.col("times")).otherwise(0)).alias("weekend_rows"), F.max("gap").cast("long").alias("max_gap"), F.sum(F.coalesce((F.col("gap") > threshold).cast("long"), F.lit(0))).alias("gaps_over"),
    )


def top_gaps(days: DataFrame, n: int = 10) -> DataFrame:
    """The n longest calendar gaps, latest first among equals, as text. A report of a few rows."""
    gaps = days.select("date").distinct().withColumn("gap", F.datediff("date", F.lag("date").over(Window.orderBy("date"))).cast("long")).filter("gap is not null")
    return gaps.orderBy(F.desc("gap"), F.desc("date")).limit(n).withColumn("label", F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit(" ("), F.col("gap").cast("string"), F.lit("d)")))


def asset_pairs(rows: DataFrame, value: str, *extra: str) -> DataFrame:
    """Each date's values of every ordered pair of assets."""
    i = rows.select("date", *extra, F.col("asset").alias("asset_i"), F.col(value).alias("x"))
    j = rows.select("date", *extra, F.col("asset").alias("asset_j"), F.col(value).alias("y"))
    return i.join(j, ["date", *extra])


def correlation_matrix(returns: DataFrame, value: str = "r") -> DataFrame:
    return asset_pairs(returns, value).groupBy("asset_i", "asset_j").agg(F.corr("x", "y").alias("correlation"))


def feature_correlations(levels: DataFrame) -> DataFrame:
    """Correlations of every pair of series, of levels and of first differences; from long (date, asset, value)."""
    both = levels.withColumn("kind", F.lit("level")).unionByName(levels.withColumn("value", F.col("value") - F.lag("value").over(C.by("asset"))).withColumn("kind", F.lit("difference")))
    return asset_pairs(both.filter("value is not null"), "value", "kind").filter("asset_i < asset_j").groupBy("kind", "asset_i", "asset_j").agg(F.corr("x", "y").alias("correlation"), F.count(F.lit(1)).alias("n"))


def subperiods(panel: DataFrame, periods: DataFrame, least: int = 42) -> DataFrame:
    """Per (possibly overlapping) period and asset: growth, volatility and drawdown within it."""
    rows = panel.join(F.broadcast(periods), F.col("date").between(F.col("start"), F.col("stop")))
    rows = rows.withColumns({"r": C.simple_return("price", "period", "asset"), "dd": C.drawdown("price", "period", "asset")})
    out = rows.groupBy("period", "asset").agg(F.count(F.lit(1)).alias("n"), F.min_by("price", "date").alias("p0"), F.max_by("price", "date").alias("p1"), (F.stddev_samp("r") * 252**0.5).alias("ann_vol"), F.min("dd").alias("max_drawdown"))
    return out.filter(F.col("n") >= least).withColumn("cagr", F.pow(F.col("p1") / F.col("p0"), F.lit(252.0) / (F.col("n") - 1)) - 1).drop("p0", "p1")


def histogram(rows: DataFrame, key: str, value: str, bins: int = 120, trim: float = 0.0005) -> DataFrame:
    """Counts by bin between the trim quantiles of each key."""
    edges = rows.groupBy(key).agg(F.percentile(value, trim).alias("low"), F.percentile(value, 1 - trim).alias("high"))
    inside = rows.join(edges, key).filter(F.col(value).between(F.col("low"), F.col("high")) & (F.col("high") > F.col("low")))
    bin_ = F.least(F.floor((F.col(value) - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1)).cast("long")
    return inside.groupBy(key, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def stability(rows: DataFrame, values: list[str]) -> DataFrame:
    """Mean, spread, range and count of non-finite values of each column, long."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])).alias("m")).select("m.*")
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    ok = F.when(finite, F.col("value"))
    return long.groupBy("metric").agg(F.avg(ok).alias("mean"), F.stddev_samp(ok).alias("std"), F.min(ok).alias("min"), F.max(ok).alias("max"), F.sum((~finite).cast("long")).alias("non_finite"))


def agreement(a: DataFrame, b: DataFrame, label: str, probability: str) -> DataFrame:
    """Share of dates on which two paths classify alike, and the correlation of their probabilities."""
    both = a.select("date", F.col(label).alias("la"), F.col(probability).alias("pa")).join(b.select("date", F.col(label).alias("lb"), F.col(probability).alias("pb")), "date")
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("la") == F.col("lb")).cast("double")).alias("agreement"), F.corr("pa", "pb").alias("probability_correlation"))


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two flags and Cohen's kappa."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement"), F.avg(x).alias("pa"), F.avg(y).alias("pb"))
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return out.withColumn("kappa", F.try_divide(F.col("agreement") - chance, 1 - chance)).drop("pa", "pb")


def best_of(rows: DataFrame, group: str, score: str, tie: str) -> DataFrame:
    """Each group's row of highest score, ties to the smaller tie value, with its lead over the second."""
    w = Window.partitionBy(group).orderBy(F.desc(score), tie)
    ranked = rows.withColumns({"rank": F.row_number().over(w), "gap": F.col(score) - F.lead(score).over(w)})
    return ranked.filter("rank = 1").drop("rank")


def compare_runs(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Per column: largest and mean difference, exact equals, and nulls on one side only."""
    pick = lambda df, name: df.select(*keys, F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])).alias("m")).select(*keys, "m.metric", F.col("m.value").alias(name))
    both = pick(a, "x").join(pick(b, "y"), [*keys, "metric"], "full")
    d = F.abs(F.col("x") - F.col("y"))
    return both.groupBy("metric").agg(F.max(d).alias("max_abs"), F.avg(d).alias("mean_abs"), F.sum(F.coalesce((F.col("x") == F.col("y")).cast("long"), F.lit(0))).alias("exact"), F.sum((F.col("x").isNull() != F.col("y").isNull()).cast("long")).alias("one_sided_nulls"))
