"""Paired stationary bootstrap with a counter-based generator, intervals and p-values.

A draw is a digest of (seed, replicate, position, stream), so it depends on neither batches nor partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .risk import newey_west, normal_p

Z95 = 1.959963984540054
#: Blocks of replicates, a task each.
BLOCKS = 64


def uniform(seed: int, rep: Column, pos: Column, stream: str) -> Column:
    """From 0 to 1, by the first 52 bits of a digest."""
    key = F.concat_ws("-", F.lit(str(seed)), rep.cast("string"), pos.cast("string"), F.lit(stream))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def indices(spark, n: int, block: float, reps: int, seed: int = 12345) -> DataFrame:
    """rep, pos, src: circular blocks that go on with probability 1 - 1 / block and otherwise start anywhere.

    Spark takes its reps * n rows for reps ones and would broadcast them: a join names the other side, a row for each day, as the one to broadcast."""
    # replicates are dealt before their positions exist: blocks of replicates, and no position is shuffled
    dealt = spark.range(reps).select(F.col("id").alias("rep")).repartition(min(reps, BLOCKS), "rep")
    grid = dealt.select("rep", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("pos"))
    new = (F.col("pos") == 0) | (uniform(seed, F.col("rep"), F.col("pos"), "new") < 1 / block)
    grid = grid.withColumn("start", F.when(new, F.struct("pos", F.floor(uniform(seed, F.col("rep"), F.col("pos"), "at") * n).alias("at"))))
    w = Window.partitionBy("rep").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("start", ignorenulls=True).over(w)
    return grid.select("rep", "pos", ((last["at"] + F.col("pos") - last["pos"]) % n).cast("bigint").alias("src"))


def sharpe(x: str) -> Column:
    return F.try_divide(F.avg(x), F.stddev_samp(x)) * 252**0.5


def sortino(x: str) -> Column:
    return F.try_divide(F.avg(x), F.sqrt(F.avg(F.least(F.col(x), F.lit(0.0)) ** 2))) * 252**0.5


def volatility(x: str) -> Column:
    return F.stddev_samp(x) * 252**0.5


def cagr(x: str) -> Column:
    return F.exp(F.sum(F.log1p(x)) * F.lit(252.0) / F.count(x)) - 1


#: Each metric with the series it is taken on: excess returns for ratios, net returns for the rest.
METRICS = {"sharpe": ("excess", sharpe), "sortino": ("excess", sortino), "ann_vol": ("net", volatility), "cagr": ("net", cagr), "max_drawdown": ("net", None), "calmar": ("net", None)}


def legs(rows: DataFrame, order: str, *keys: str) -> DataFrame:
    """Each metric of leg b less that of leg a, one row for each key, of rows a, b (excess) and net_a, net_b in the given order.

    Drawdowns follow the path of the (resampled) rows, from its first value on."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    for leg in "ab":
        rows = rows.withColumn(f"w_{leg}", F.exp(F.sum(F.log1p(f"net_{leg}")).over(w)))
        rows = rows.withColumn(f"dd_{leg}", F.col(f"w_{leg}") / F.max(f"w_{leg}").over(w) - 1)
    made = []
    for leg in "ab":
        for name, (series, f) in METRICS.items():
            made.append((F.min(f"dd_{leg}") if f is None else f(leg if series == "excess" else f"net_{leg}")).alias(f"{name}_{leg}"))
    out = rows.groupBy(*keys).agg(*made)
    for leg in "ab":
        out = out.withColumn(f"calmar_{leg}", F.when(F.col(f"max_drawdown_{leg}") < 0, F.col(f"cagr_{leg}") / F.abs(f"max_drawdown_{leg}")))
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(f"{m}_b") - F.col(f"{m}_a")).alias("value")) for m in METRICS])
    return out.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.*")


def draws(paired: DataFrame, block: float, reps: int, n: int, seed: int = 12345) -> DataFrame:
    """rep, metric, value: differences of each metric on the same resampled dates. paired: date, a, b, net_a, net_b with n rows."""
    numbered = paired.select("a", "b", "net_a", "net_b", (F.row_number().over(Window.orderBy("date")) - 1).cast("bigint").alias("src"))
    return legs(indices(paired.sparkSession, n, block, reps, seed).join(F.broadcast(numbered), "src"), "pos", "rep")


def observed(paired: DataFrame) -> DataFrame:
    return legs(paired.withColumn("one", F.lit(1)), "date", "one").select("metric", F.col("value").alias("observed"))


def sharpe_draws(series: DataFrame, block: float, reps: int, n: int, seed: int = 12345) -> DataFrame:
    """comparison, rep, value: differences b - a of Sharpe ratios of many comparisons on the same resampled dates, in one pass.

    series: comparison, date, a, b (excess), each comparison with the same n dates."""
    numbered = series.withColumn("src", (F.dense_rank().over(Window.orderBy("date")) - 1).cast("bigint"))
    by_day = numbered.groupBy("src").agg(F.collect_list(F.struct("comparison", "a", "b")).alias("x"))  # a few comparisons a day
    sampled = indices(series.sparkSession, n, block, reps, seed).join(F.broadcast(by_day), "src").select("rep", F.explode("x").alias("x")).select("rep", "x.*")
    return sampled.groupBy("comparison", "rep").agg((sharpe("b") - sharpe("a")).alias("value"))


def sharpe_tests(series: DataFrame, block: float, reps: int, n: int, kept=lambda df: df, seed: int = 12345) -> DataFrame:
    """Per comparison: observed difference of Sharpe ratios, spread of its draws, percentile interval and centred p-values. ``kept`` may write the draws down."""
    drawn = kept(sharpe_draws(series, block, reps, n, seed)).withColumnRenamed("comparison", "metric")
    seen = series.groupBy(F.col("comparison").alias("metric")).agg((sharpe("b") - sharpe("a")).alias("observed"))
    spread = drawn.groupBy("metric").agg(F.stddev_samp("value").alias("bootstrap_sd"))
    return intervals(drawn, seen).join(spread, "metric").withColumnRenamed("metric", "comparison")


def intervals(drawn: DataFrame, seen: DataFrame, level: float = 0.95) -> DataFrame:
    """Percentile interval and centred p-values (greater, less, two-sided), the null being draws less their mean."""
    finite = drawn.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    centre = finite.groupBy("metric").agg(F.avg("value").alias("centre"))
    rows = finite.join(centre, "metric").join(seen, "metric").withColumn("null", F.col("value") - F.col("centre"))
    tail = (1 - level) / 2
    return rows.groupBy("metric").agg(
        F.first("observed").alias("observed"), F.count(F.lit(1)).alias("n_draws"), F.percentile("value", tail).alias("ci_low"), F.percentile("value", 1 - tail).alias("ci_high"),
        F.avg((F.col("null") >= F.col("observed")).cast("double")).alias("p_greater"), F.avg((F.col("null") <= F.col("observed")).cast("double")).alias("p_less"), F.avg((F.abs("null") >= F.abs("observed")).cast("double")).alias("p_two_sided"),
    )


def hac_difference(paired: DataFrame, lags: int, z: float = Z95) -> DataFrame:
    """Mean of net_b - net_a, annualised, with its HAC interval, statistic and two-sided normal p-value."""
    out = newey_west(paired.select(F.lit("b-a").alias("pair"), "date", (F.col("net_b") - F.col("net_a")).alias("d")), ["pair"], "d", lags)
    return out.select("pair", F.lit(lags).cast("long").alias("lags"), "n", (F.col("mean") * 252).alias("annual_mean"), (F.col("se") * 252).alias("annual_se"), ((F.col("mean") - z * F.col("se")) * 252).alias("ci_low"), ((F.col("mean") + z * F.col("se")) * 252).alias("ci_high"), "z", normal_p(F.col("z")).alias("p_two_sided"))
