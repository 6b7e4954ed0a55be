"""Configuration, ledgers, labels and the gates of a manuscript."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tideline.functions import columns as C
from tideline.operators import align, regimes, reports
from tideline.sources import config, durable, panels


def test_config(tmp_path):
    good = {"data": dict.fromkeys(config.REQUIRED, "x")}
    path = tmp_path / "c.json"
    path.write_text(json.dumps(good))
    assert config.load(str(path)) == good
    for bad, error in (({}, KeyError), ({"data": {"tickers": "x"}}, KeyError), ({"data": good["data"] | {"tickers": []}}, ValueError)):
        with pytest.raises(error):
            config.checked(bad)


def test_ledger_and_snapshots(spark, tmp_path):
    every = spark.createDataFrame([("a",), ("b",), ("c",)], "specification string")
    ledger = str(tmp_path / "done")
    panels.record(every.filter("specification = 'a'"), ledger)
    panels.record(every.filter("specification = 'c'"), ledger)
    assert [r[0] for r in panels.pending(every, spark.read.parquet(ledger)).collect()] == ["b"]
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "x.txt").write_text("one")
    one = panels.environment_hash(panels.manifest(spark, str(tmp_path / "files")), "seed=1")
    assert len(one) == 16 and one == panels.environment_hash(panels.manifest(spark, str(tmp_path / "files")), "seed=1")
    assert one != panels.environment_hash(panels.manifest(spark, str(tmp_path / "files")), "seed=2")
    assert tuple(panels.coverage(every, "specification").first()) == (3, "a", "c", 1)


def test_landed_once(spark):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    assert durable.once(spark, ("t", "x"), make).count() == durable.once(spark, ("t", "x"), make).count() == 3 and len(made) == 1


def test_unregistered_names_raise(spark):
    rows = spark.createDataFrame([("sharpe", 0.5), ("ann_vol", 0.123)], "metric string, raw_value double")
    assert {r.formatted for r in reports.display_table(rows).collect()} == {"0.5000", "12.30%"}
    with pytest.raises(Exception, match="unregistered metric: other"):
        reports.display_table(rows.withColumn("metric", F.lit("other"))).collect()
    assert [r.label for r in reports.labels(rows, "metric", {"sharpe": "Sharpe", "ann_vol": "Volatility"}).collect()] == ["Sharpe", "Volatility"]
    with pytest.raises(Exception, match="unregistered label: sharpe"):
        reports.labels(rows, "metric", {"ann_vol": "Volatility"}).collect()


def test_symbols_and_patterns(spark):
    row = spark.createDataFrame([("5% − Δσ ≤ {x}",)], "t string").select(C.tex(F.col("t"))).first()[0]
    assert row == r"5\% $-$ $\Delta$$\sigma$ $\leq$ \{x\}"
    texts = {
        "github_token": "ghp_" + "a1" * 10, "slack_token": "xoxb-12345-abcdef", "assignment": "api_key = 'abcdefgh1'", "street_address": "at 12 Long Street", "phone": "(212) 555 1234",
        "private_key": "-----BEGIN RSA PRIVATE KEY-----", "email": "a.b@c.org", "sk_key": "sk-" + "a" * 24,
    }
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts.values())], "doc_id long, text string")
    found = {r.doc_id: r.kind for r in reports.scan_text(docs).collect()}
    assert [found[i] for i in range(len(texts))] == list(texts)


SOURCE = r"""Results \cite{k1, k2} show \primarySharpe{} on 10{,}000 draws % 99 hidden
\input{table3} Eleven of 13 specifications, \unknownMacro and \textbf{4.5}. \vspace{2em}"""


def test_census(spark):
    sources = spark.createDataFrame([(SOURCE,)], "text string")
    found = {r.literal: r.n for r in reports.census_literals(sources).collect()}
    assert found == {"10{,}000": 1, "13": 1, "4.5": 1, "word:eleven": 1}
    macros = spark.createDataFrame([("\\primarySharpe",)], "macro string")
    assert [r.macro for r in reports.macros_used(sources, macros).collect()] == ["\\primarySharpe"]
    assert [r.macro for r in reports.undefined_macros(sources, macros).collect()] == ["\\unknownMacro"]
    blank = ("",) * len(reports.EVIDENCE)
    census = spark.createDataFrame([("13", "sample_or_date", *blank), ("4.5", "empirical_result", *blank), ("word:eleven", "guess", *blank)], "literal string, classification string, " + ", ".join(f"{c} string" for c in reports.EVIDENCE))
    problems = {tuple(r) for r in reports.census_gate(reports.census_literals(sources), census).collect()}
    assert problems == {("unclassified", "10{,}000"), ("unknown_class", "word:eleven"), ("missing_evidence", "4.5"), ("empirical_literal", "4.5")}


def test_citations(spark):
    sources = spark.createDataFrame([(SOURCE,)], "text string")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    audit = spark.createDataFrame([("k1", "verified", "yes", "p. 3"), ("k3", "verified", "no", "TO CHECK p. 4"), ("k4", "pending", "", "")], "key string, status string, metadata_verified string, supporting_location string")
    problems = {tuple(r) for r in reports.citation_gates(reports.cited_keys(sources), keys("k1", "k4", "k5"), audit).collect()}
    assert problems == {("cited_without_entry", "k2"), ("cited_without_audit", "k2"), ("entry_without_audit", "k5"), ("audit_without_entry", "k3"), ("metadata_unverified", "k3"), ("claim_unchecked", "k3")}


def test_errors(spark):
    ends = spark.createDataFrame([("2020-01-31",)], "date string").withColumn("date", F.to_date("date"))
    assert align.origins_after(ends, "2020-01-15").count() == 1
    with pytest.raises(ValueError):
        align.origins_after(ends, "2020-02-01")
    report = spark.createDataFrame([("a", True), ("b", False)], "asset string, valid boolean")
    with pytest.raises(ValueError, match="b"):
        align.require_valid(report, "asset")


def test_parameters_of_fits(spark):
    rows = [("2020-01-31", [[0.0, 1.0], [2.0, 2.0]], [[0.9, 0.1], [0.2, 0.8]], 42), ("2020-02-29", [[0.0, 1.0], [2.0, 5.0]], [[0.8, 0.2], [0.2, 0.8]], 43)]
    states = spark.createDataFrame(rows, "origin string, mu array<array<double>>, transition array<array<double>>, selected_seed long")
    assert regimes.transitions(states).count() == 8
    r = regimes.parameter_revisions(states).first()
    assert (r.mean_norm, round(r.transition_norm, 12), r.seed_changed) == (3.0, 0.2, True)
