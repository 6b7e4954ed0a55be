"""Validation, calendars and alignment of long panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def validate(frame: DataFrame, key: str, value: str, positive: bool = True) -> DataFrame:
    """Per key: rows, duplicate dates, nulls, values not above 0 with the first such date, and whether it is valid."""
    per_date = frame.groupBy(key, "date").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).isNull().cast("long")).alias("nulls"), F.min(value).alias("low"))
    bad = (F.col("low") <= 0) if positive else F.lit(False)
    out = per_date.groupBy(key).agg(
        F.sum("n").alias("rows"), F.sum((F.col("n") > 1).cast("long")).alias("duplicate_dates"), F.sum("nulls").alias("nulls"),
        F.sum(F.coalesce(bad.cast("long"), F.lit(0))).alias("not_positive"), F.min(F.when(bad, F.col("date"))).alias("first_bad_date"),
    )
    return out.withColumn("valid", (F.col("duplicate_dates") == 0) & (F.col("nulls") < F.col("rows")) & (F.col("not_positive") == 0))


def price_panel(prices: DataFrame) -> DataFrame:
    """Only dates on which every asset has a price."""
    prices = prices.filter("price is not null")
    n = prices.agg(F.count_distinct("asset").alias("n_assets"))
    on_date = F.size(F.collect_set("asset").over(Window.partitionBy("date")))
    return prices.withColumn("n", on_date).join(F.broadcast(n), F.col("n") == F.col("n_assets")).drop("n", "n_assets")


def trading_days(panel: DataFrame) -> DataFrame:
    return panel.select("date").distinct()


def fill_to_calendar(macro: DataFrame, days: DataFrame, limit: int = 5) -> DataFrame:
    """Each series on the trading days: forward-filled over at most ``limit`` rows of the union of its dates and the days; nothing is filled backward."""
    series = macro.select("series_id").distinct()
    grid = days.select("date").distinct().withColumn("one", F.lit(1)).join(series.withColumn("one", F.lit(1)), "one").drop("one")
    union = macro.select("series_id", "date").unionByName(grid).distinct()
    filled = union.join(macro, ["series_id", "date"], "left").withColumn("value", C.forward_fill("value", limit, "series_id"))
    return filled.join(days.select("date").distinct(), "date", "left_semi").select("series_id", "date", "value")


def gaps(filled: DataFrame) -> DataFrame:
    """Per series: leading nulls, and nulls after the first value (which an aligned panel must not have)."""
    seen = F.max(F.col("value").isNotNull().cast("int")).over(C.expanding("series_id"))
    marked = filled.withColumn("seen", seen)
    return marked.groupBy("series_id").agg(F.sum((F.col("seen") == 0).cast("long")).alias("leading_missing"), F.sum((F.col("value").isNull() & (F.col("seen") == 1)).cast("long")).alias("internal_missing"))


def signal_lag(frame: DataFrame, value: str, days: int = 1, *keys: str) -> DataFrame:
    if days < 0:
        raise ValueError("a signal can't be lagged by fewer than 0 days")
    return frame.withColumn(f"{value}_lag{days}", F.lag(value, days).over(C.by(*keys)))


def as_of(dates: DataFrame, rates: DataFrame, value: str) -> DataFrame:
    """The last rate on or before each date."""
    both = rates.select("date", value, F.lit(False).alias("asked")).unionByName(dates.select("date", F.lit(None).cast("double").alias(value), F.lit(True).alias("asked")))
    w = Window.orderBy("date", "asked").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).filter("asked").drop("asked")


def month_ends(days: DataFrame, min_obs: int = 252) -> DataFrame:
    """date, position and next_date of every month end with ``min_obs`` days up to it that has a next one."""
    # one row for each day of one calendar
    numbered = days.select("date").distinct().withColumn("position", F.row_number().over(Window.orderBy("date")))
    ends = numbered.groupBy(F.trunc("date", "MM").alias("month")).agg(F.max("date").alias("date"), F.max("position").cast("long").alias("position"))
    ends = ends.withColumn("next_date", F.lead("date").over(Window.orderBy("date"))).drop("month")
    return ends.filter((F.col("position") >= min_obs) & F.col("next_date").isNotNull())


def origins_after(ends: DataFrame, cutoff: str) -> DataFrame:
    """The month ends from the cutoff's month on; an error if there is none."""
    out = ends.filter(F.col("date") >= F.trunc(F.lit(cutoff).cast("date"), "MM"))
    if out.isEmpty():
        raise ValueError(f"no origin from {cutoff} on")
    return out


def holding_days(ends: DataFrame, panel: DataFrame) -> DataFrame:
    """The panel's rows in (date, next_date] of each origin. Periods don't overlap, so a day has one: that of the last origin before it."""
    days = panel.select("date").distinct().select("date", F.lit(0).alias("opens"), F.lit(None).cast("struct<origin:date,next_date:date>").alias("period"))
    opened = ends.select("date", F.lit(1).alias("opens"), F.struct(F.col("date").alias("origin"), "next_date").alias("period"))
    # one row for each day of one calendar; a day comes before the origin of its own date
    last = F.last("period", ignorenulls=True).over(Window.orderBy("date", "opens").rowsBetween(Window.unboundedPreceding, 0))
    of_day = days.unionByName(opened).withColumn("period", last).filter("opens = 0 and date <= period.next_date").select("date", "period.*")
    return panel.join(of_day, "date")


def read_off(running: DataFrame, origins: DataFrame, *keys: str) -> DataFrame:
    """Each key's last row on or before every origin, as ``origin`` and the row's other columns: what running sums are at the origins."""
    names = [c for c in running.columns if c not in ("date", *keys)]
    row = F.struct("date", *names)
    dates = origins.select(F.col("date").alias("origin"))
    keyed = dates.withColumn("one", F.lit(1)).join(running.select(*keys).distinct().withColumn("one", F.lit(1)), "one").drop("one") if keys else dates
    rows = running.select(*keys, "date", F.lit(0).alias("asks"), row.alias("row"))
    asked = keyed.select(*keys, F.col("origin").alias("date"), F.lit(1).alias("asks"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"))
    w = Window.partitionBy(*keys).orderBy("date", "asks").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.unionByName(asked).withColumn("row", F.last("row", ignorenulls=True).over(w)).filter("asks = 1 and row is not null")
    return out.select(F.col("date").alias("origin"), *keys, *[F.col("row")[c].alias(c) for c in names])


def execution_dates(signals: DataFrame, days: DataFrame) -> DataFrame:
    """signal_date and the first trading day strictly after it; signals without one are dropped."""
    both = days.select("date", F.lit(0).alias("signal")).unionByName(signals.select("date", F.lit(1).alias("signal")))
    # the next trading day after a signal of the same date comes after it in this order
    w = Window.orderBy("date", "signal").rowsBetween(1, Window.unboundedFollowing)
    after = F.first(F.when(F.col("signal") == 0, F.col("date")), ignorenulls=True).over(w)
    return both.withColumn("execution_date", after).filter("signal = 1 and execution_date is not null").select(F.col("date").alias("signal_date"), "execution_date")


def trailing_years(origins: DataFrame, panel: DataFrame, years: int = 5) -> DataFrame:
    """Each origin's rows of the last years; the origins are month ends, some hundreds."""
    o = origins.select(F.col("date").alias("origin"))
    return panel.join(F.broadcast(o), (F.col("date") <= F.col("origin")) & (F.col("date") >= F.add_months("origin", -12 * years)))


def expanding_windows(origins: DataFrame, panel: DataFrame) -> DataFrame:
    o = origins.select(F.col("date").alias("origin"))
    return panel.join(F.broadcast(o), F.col("date") <= F.col("origin"))


def uncommon_dates(forecasts: DataFrame) -> DataFrame:
    """(date, asset) that some model lacks or has twice; must be empty."""
    n = forecasts.agg(F.count_distinct("model").alias("n_models"))
    return forecasts.groupBy("date", "asset").agg(F.count_distinct("model").alias("models"), F.count(F.lit(1)).alias("rows")).join(F.broadcast(n), (F.col("models") != F.col("n_models")) | (F.col("rows") != F.col("n_models"))).drop("n_models")


def causal_gap(transform, panel: DataFrame, cutoff: str, keys: list[str], value: str) -> float:
    """Largest difference between the transform of the whole panel, up to the cutoff, and that of the panel cut there; 1 where just one is null."""
    whole = transform(panel).filter(F.col("date") <= F.lit(cutoff).cast("date")).select(*keys, F.col(value).alias("a"))
    cut = transform(panel.filter(F.col("date") <= F.lit(cutoff).cast("date"))).select(*keys, F.col(value).alias("b"))
    diff = F.when(F.col("a").isNull() & F.col("b").isNull(), 0.0).otherwise(F.coalesce(F.abs(F.col("a") - F.col("b")), F.lit(1.0)))
    return whole.join(cut, keys, "full").agg(F.max(diff)).first()[0] or 0.0


def common_days(*frames: DataFrame) -> DataFrame:
    """The dates that all of the frames have."""
    out = frames[0].select("date")
    for f in frames[1:]:
        out = out.intersect(f.select("date"))
    return out.distinct()


def require_valid(report: DataFrame, key: str) -> None:
    """Raises on the first keys that a validation report doesn't find valid."""
    bad = [r[key] for r in report.filter(~F.col("valid")).select(key).limit(10).collect()]
    if bad:
        raise ValueError(f"invalid: {bad}")
