"""Panel operators: defined cases and causality."""

from __future__ import annotations

import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from tideline.functions import columns as C
from tideline.operators import align, describe, reports, risk
from tideline.plans import core
from tideline.sources import panels

SF = "/root/testdata/sf0.01"
DAY = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(40)]


def test_incomplete_dates_go(spark):
    rows = [(DAY[i], a, 1.0) for i in range(5) for a in "AB" if not (i == 2 and a == "B")] + [(DAY[4], "C", None)]
    out = align.price_panel(spark.createDataFrame(rows, "date date, asset string, price double"))
    assert {r.date for r in out.collect()} == {DAY[0], DAY[1], DAY[3], DAY[4]}


def test_fill_is_limited_and_never_backward(spark):
    macro = spark.createDataFrame([(DAY[3], "m", 5.0)], "date date, series_id string, value double")
    days = spark.createDataFrame([(d,) for d in DAY[:12]], "date date")
    out = {r.date: r.value for r in align.fill_to_calendar(macro, days).collect()}
    assert [out[d] for d in DAY[:12]] == [None] * 3 + [5.0] * 6 + [None] * 3


def test_execution_is_strictly_after_the_signal(spark):
    days = spark.createDataFrame([(d,) for d in (DAY[0], DAY[3], DAY[4])], "date date")
    signals = spark.createDataFrame([(DAY[0],), (DAY[1],), (DAY[4],)], "date date")
    assert {tuple(r) for r in align.execution_dates(signals, days).collect()} == {(DAY[0], DAY[3]), (DAY[1], DAY[3])}


def test_validation_and_negative_lag(spark):
    rows = spark.createDataFrame([(DAY[0], "a", 1.0), (DAY[0], "a", 2.0), (DAY[1], "a", -1.0), (DAY[0], "b", 1.0)], "date date, asset string, price double")
    out = {r.asset: r for r in align.validate(rows, "asset", "price").collect()}
    assert not out["a"].valid and out["a"].first_bad_date == DAY[1] and out["a"].duplicate_dates == 1 and out["b"].valid
    with pytest.raises(ValueError):
        align.signal_lag(rows, "price", -1, "asset")


@pytest.mark.parametrize("build", [
    lambda p: p.withColumn("x", C.rolling_std("price", 21, "asset")), lambda p: p.withColumn("x", C.drawdown("price", "asset")), lambda p: p.withColumn("x", C.log_return("price", "asset")),
    lambda p: risk.ewma_variance_closed(p.withColumn("r", C.log_return("price", "asset")).filter("r is not null")).withColumnRenamed("ewma_variance", "x"),
])
def test_causality(spark, build):
    panel = core.panel(spark, SF)
    assert align.causal_gap(build, panel, "1997-06-30", ["asset", "date"], "x") < 1e-12


def test_closed_form_is_the_recursion(spark):
    r = core.returns(spark, SF)
    got = {(x.asset, x.date): x.ewma_variance for x in risk.ewma_variance_closed(r).collect()}
    by: dict = {}
    for x in r.orderBy("asset", "date").collect():
        by.setdefault(x.asset, []).append((x.date, x.r))
    want = {}
    for asset, rows in by.items():
        v = statistics.variance(x for _, x in rows[: risk.SEED_OBS])
        for date, x in rows[risk.SEED_OBS - 1 :]:
            v = risk.LAMBDA * v + (1 - risk.LAMBDA) * x * x
            want[asset, date] = v
    assert got.keys() == want.keys() and all(abs(got[k] / v - 1) < 1e-9 for k, v in want.items())


def test_read_off_and_holding_days(spark):
    rows = spark.createDataFrame([(DAY[i], a, float(10 * i)) for i in (0, 2, 3, 7, 8) for a in "AB"], "date date, asset string, price double")
    origins = spark.createDataFrame([(DAY[1], DAY[3]), (DAY[3], DAY[8])], "date date, next_date date")
    out = {(r.origin, r.asset): r.price for r in align.read_off(rows, origins, "asset").collect()}
    assert out == {(DAY[1], a): 0.0 for a in "AB"} | {(DAY[3], a): 30.0 for a in "AB"}
    held = {(r.date, r.origin) for r in align.holding_days(origins, rows).collect()}
    assert held == {(DAY[2], DAY[1]), (DAY[3], DAY[1]), (DAY[7], DAY[3]), (DAY[8], DAY[3])}
    assert [r.date for r in align.common_days(rows, rows.filter("price > 20")).orderBy("date").collect()] == [DAY[3], DAY[7], DAY[8]]


def test_stale_runs(spark):
    rows = spark.createDataFrame([(DAY[i], "a", v) for i, v in enumerate([1.0, 1.0, 2.0, 2.0, 2.0, None, 2.0])], "date date, k string, v double")
    r = describe.staleness(rows, "k", "v").first()
    assert (r.longest_run, r.unchanged_days, r.share_unchanged) == (4, 4, 0.8)


def test_holm_known_case(spark):
    rows = spark.createDataFrame([("a", 0.01, "f"), ("b", 0.04, "f"), ("c", 0.03, "f")], "test string, p double, family string")
    out = {r.test: round(r.p_holm, 12) for r in risk.holm(rows, "p", "family").collect()}
    assert out == {"a": 0.03, "b": 0.06, "c": 0.06}


def test_normal_p(spark):
    z = spark.createDataFrame([(0.0086713,), (3.27274,), (1.959964,)], "z double").select(risk.normal_p(F.col("z"))).collect()
    assert [round(r[0], 6) for r in z] == [0.993081, 0.001065, 0.05]


def test_csv_round_trip_and_text(spark, tmp_path):
    rows = spark.createDataFrame([(DAY[0], 1.0, 1.0, 1.0, 1.0, 0.98, 5, "A"), (DAY[1], 1.0, 1.0, 1.0, 1.0, 0.99, 6, "B")], panels.PRICE_SCHEMA + ", asset string")
    panels.write_by(rows, str(tmp_path / "p"), "asset", fmt="csv")
    back = panels.read_prices_csv(spark, str(tmp_path / "p" / "*"))
    assert {(r.date, r.adj_close, r.asset) for r in back.collect()} == {(DAY[0], 0.98, "A"), (DAY[1], 0.99, "B")}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        panels.read_prices_csv(spark, str(tmp_path / "none")).count()
    text = spark.createDataFrame([("a_b & 5% \\x{y}",)], "t string").select(C.tex_escape(F.col("t"))).first()[0]
    assert text == r"a\_b \& 5\% \textbackslash{}x\{y\}"
    bib = spark.createDataFrame([("@article{k1,\n  title = {A {B}ig Title},\n  author = {Doe, Jane and Roe, R.},\n  year = {2001}\n}",)], "text string")
    r = reports.bibliography(bib).first()
    assert (r.key, r.kind, r.title, r.surnames, r.year) == ("k1", "article", "a big title", ["doe", "roe"], "2001")
