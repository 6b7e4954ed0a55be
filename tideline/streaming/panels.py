"""Streaming counterparts: windowed event counts with late data, and running state per asset."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums by event type and tumbling window; the same plan for a batch or a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: events less than the gap apart."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", gap)
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


def running_ewma(returns: DataFrame, lam: float = 0.94, seed_obs: int = 63) -> DataFrame:
    """The exponentially weighted variance as state of each asset: a stream of (asset, date, r) in date order gives (asset, date, ewma_variance)."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def update(key, batches, state):
        n, mean, m2, v = state.get if state.exists else (0, 0.0, 0.0, None)
        for pdf in batches:
            out = []
            for date, r in pdf.sort_values("date")[["date", "r"]].itertuples(index=False):
                n += 1
                if n <= seed_obs:
                    d = r - mean
                    mean += d / n
                    m2 += d * (r - mean)
                    v = m2 / (n - 1) if n == seed_obs else None
                if v is not None:
                    v = lam * v + (1 - lam) * r * r
                    out.append((key[0], date, v))
            yield pd.DataFrame(out, columns=["asset", "date", "ewma_variance"])
        state.update((n, mean, m2, v))

    return returns.groupBy("asset").applyInPandasWithState(update, "asset string, date date, ewma_variance double", "n long, mean double, m2 double, v double", "append", GroupStateTimeout.NoTimeout)
