"""Exact top-k against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from tideline.llm import topk


def brute(rows, queries, k):
    ok = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in ok:
        if q in queries:
            near = sorted((-int(v @ w), i) for i, w in ok if i != q and len(w) == len(v))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(near)}
    return out


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.3, 24).round(2).astype(np.float32).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(30)] + [(2000 + i, [1.0] * 7) for i in range(4)]
    rows += [(5000, None), (5001, [1.0, None]), (5002, [float("nan")] * 24), (5003, [float("inf")] * 24), (None, rows[0][1]), (5004, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, ids int")
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERIES", 16)
    wanted = {i for i, _ in rows if i is not None and i % 25 == 0}
    got = {tuple(r) for r in topk.top_k(df.repartition(3), df.filter("vec_id % 25 = 0")).collect()}
    assert got == brute(rows, wanted, 5)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_large_components_stay_exact():
    rng = np.random.default_rng(2)
    for bound in (2**25, 2**31, 2**40):
        q, c = rng.integers(-bound, bound, (64, 3)), rng.integers(-bound, bound, (64, 200))
        c[:, 100:] = c[:, :100]
        best = topk.Best(q.astype(float), np.arange(3) + 900, 5)
        best.meet(c[:, :120].astype(float), np.arange(120))
        best.meet(c[:, 120:].astype(float), np.arange(120, 200))
        got = [[(v, -minus) for minus, v in top] for top in best.top]
        for j in range(3):
            s = q[:, j].astype(object) @ c.astype(object)
            assert got[j] == [(int(i), int(s[i])) for i in sorted(range(200), key=lambda i: (-s[i], i))[:5]]


def test_table_with_large_components(spark):
    rows = [(0, [1.0, 2.0]), (1, [300000.0, 1.0]), (2, [0.5, 0.5]), (3, [-3e9, 1.0]), (4, [3e9, 7.0]), (50, [1e4, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in topk.top_k(df, df.filter("vec_id = 0 or vec_id = 50")).collect()}
    assert got == brute(rows, {0, 50}, 5) and (0, 1, 4, 256 * 256 * (3 * 10**9 + 14)) in got
    far = spark.createDataFrame([(0, [1e30]), (1, [1e30]), (2, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="passes a long"):
        topk.top_k(far, far.filter("vec_id = 0")).collect()
