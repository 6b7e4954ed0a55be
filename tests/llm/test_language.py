"""Language identification: exact inference, held-out accuracy, switches, defined cases."""

from __future__ import annotations

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import language

SF = "/root/testdata/sf0.01"


def test_forward_backward_is_exact():
    rng = np.random.default_rng(3)
    lengths = np.array([5, 3, 1])
    starts = np.cumsum(lengths) - lengths
    x, pi, a = rng.random((9, 3)) + 0.1, rng.random(3), rng.random((3, 3))
    pairs = np.zeros((3, 3))
    got = language.forward_backward(x, starts, lengths, pi, a, pairs)
    want, want_pairs = np.zeros_like(x), np.zeros((3, 3))
    for s, n in zip(starts, lengths, strict=True):
        total, single, double = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for y in product(range(3), repeat=int(n)):
            w = pi[y[0]] * np.prod([x[s + t, y[t]] for t in range(n)]) * np.prod([a[y[t], y[t + 1]] for t in range(n - 1)])
            total += w
            for t in range(n):
                single[t, y[t]] += w
            for t in range(n - 1):
                double[y[t], y[t + 1]] += w
        want[s : s + n] = single / total
        want_pairs += double / total
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, language.fit(docs)


def test_held_out_accuracy(fitted):
    docs, model = fitted
    out = language.predict(docs, model, ("doc_id", "lang")).filter(language.held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    right, n = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count(F.lit(1))).first()
    assert n > 100 and right > 0.97


def test_switches_and_cases(spark, fitted):
    docs, model = fitted
    by = {lang: [r.text for r in docs.filter((F.col("lang") == lang) & (F.length("text") > 1500)).orderBy("doc_id").limit(1).collect()][0] for lang in model.labels}
    halves = " ".join(by["de"].split()[:80]) + " " + " ".join(by["es"].split()[:80])
    labeller = language.Labeller(model)
    _, post, _ = next(iter(labeller.posteriors([halves])))
    best = [model.labels[i] for i in post.argmax(axis=1)]
    assert best[:70].count("de") >= 60 and best[90:].count("es") >= 60
    rows = [(None, None, "x"), (1, "", "x"), (2, "12 34 !!", "x"), (3, by["fr"] * 20, "x"), (4, by["fr"], "x"), (4, by["fr"], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    out = sorted(((r.doc_id, r.lang_pred, r.score) for r in language.predict(df, model).collect()), key=lambda r: (r[0] is not None, r[0]))
    assert [r[1] for r in out] == ["und", "und", "und", "fr", "fr", "fr"] and all(0 <= r[2] <= 1 for r in out)
    assert language.predict(df.limit(0), model).count() == 0
    none = language.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert none is None and {r.lang_pred for r in language.predict(df, none).collect()} == {"und"}
