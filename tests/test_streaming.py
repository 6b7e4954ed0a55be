"""Streams give what batches give."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import risk
from tideline.plans import core
from tideline.streaming import panels as streams

SF = "/root/testdata/sf0.001"


def test_running_ewma_equals_batch(spark, tmp_path):
    r = core.returns(spark, SF).select("asset", "date", "r")
    r.coalesce(1).sortWithinPartitions("date").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("asset string, date date, r double").parquet(str(tmp_path / "in"))
    q = streams.running_ewma(stream).writeStream.format("memory").queryName("ewma").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("ewma").withColumnRenamed("ewma_variance", "streamed")
    want = risk.ewma_variance_closed(r)
    n, gap = got.join(want, ["asset", "date"]).agg(F.count(F.lit(1)), F.max(F.abs(F.col("streamed") / F.col("ewma_variance") - 1))).first()
    assert n == want.count() > 0 and gap < 1e-9
