"""SpotSigs: chains, next documents, pairs."""

from __future__ import annotations

import hashlib
import random
from itertools import combinations

from pyspark.sql import functions as F

from tideline.llm import spotsigs
from tideline.llm.common import Scratch


def spots(text: str) -> set[str]:
    words = "".join(" " if c in spotsigs.SIGNS else c for c in text.lower()).split()
    out = set()
    for i, w in enumerate(words):
        if w in spotsigs.ANCHORS:
            chain = []
            for x in words[i + 1 : i + 1 + spotsigs.CHAIN]:
                if x in spotsigs.ANCHORS:
                    break
                chain.append(x)
            if chain:
                out.add(" ".join([w, *chain]))
    return out


def texts(n=40):
    rng = random.Random(2)
    return [" ".join(rng.choice(["the", "of", "und", "las"] if rng.random() < 0.3 else [f"c{rng.randrange(400)}", "theory", "ofen"]) for _ in range(rng.randrange(1, 300))) for _ in range(n)]


def hashed(spark, some: list[str]) -> list[int]:
    return sorted(r.h for r in spark.createDataFrame([(x,) for x in some], "s string").select(F.xxhash64("s").alias("h")).collect())


def test_sets_against_brute_force(spark):
    some = [*texts(), "The cat, sat on THE mat.", "nothing here", "", None, "the the the", "the x " * 30_000]
    df = spark.createDataFrame([(i, t, "x", "mine") for i, t in enumerate(some)], "doc_id long, text string, head string, fingerprint string")
    out = {r.doc_id: r for r in spotsigs.spotsigs(df).collect()}
    for i, t in enumerate(some):
        want = hashed(spark, list(spots(t or "")) or ([t] if (t or "").strip() else []))
        assert out[i].signatures == want and out[i].fingerprint == "mine"
        assert out[i].fingerprint_ == "".join(f"{h & (2**64 - 1):016x}" for h in want)


def test_query_against_brute_force(spark, tmp_path):
    """Every column of the query, over ids with gaps, copies and nulls."""
    some = texts(60)
    rows = [(i * i - 50, t) for i, t in enumerate([*some, some[3], some[3] + " the end", None, "", "é" * 31])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in spotsigs.op5_spotsigs(spark, str(tmp_path)).collect()}
    order = sorted(rows, reverse=True)

    def near(a: str, b: str) -> float:
        x, y = (spots(t) or ({t} if t.strip() else set()) for t in (a, b))
        return len(x & y) / len(x | y) if x | y else 1.0

    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        new = t[: len(t) - half] + following[:half]
        assert out[i].n_chars == len(t) and out[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert abs(out[i].near_edited - near(t, new)) < 1e-12 and abs(out[i].near_next - near(t, following)) < 1e-12
        assert (out[i].fingerprint == out[order[(k + 1) % len(order)][0]].fingerprint) == (near(t, following) == 1)


def test_ranges_follow_any_ids(spark, monkeypatch):
    """Dense, far and hot ids, and nulls: neighbours are right and no range is large."""
    monkeypatch.setattr(spotsigs, "RANGE", 20)
    rng = random.Random(3)
    ids = [*range(200), *[rng.randrange(-(2**62), 2**62) for _ in range(200)], *[77] * 150, *[None] * 150]
    rows = [(i, f"text {k}") for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    keyed = df.select("*", F.coalesce("doc_id", F.lit(-(2**63))).alias("key"), F.xxhash64("text").alias("tie"))
    sizes = keyed.withColumn("range", spotsigs.ranged(keyed)).groupBy("range").count().collect()
    assert len(sizes) > 20 and max(r["count"] for r in sizes) < 70
    tie = {r.text: (r.key, r.tie) for r in keyed.collect()}
    order = sorted((t for _, t in rows), key=tie.get, reverse=True)
    got = {r.text: r.next_text for r in spotsigs.with_next(df, Scratch(spark, "t")).collect()}
    assert got == {t: order[(k + 1) % len(order)] for k, t in enumerate(order)}


def test_next_and_edited(spark):
    rng = random.Random(6)
    ids = rng.sample(range(-3000, 9000), 300)
    rows = [(i, f"t{i} é " * rng.randrange(0, 9)) for i in ids]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.next_text, r.edited) for r in spotsigs.with_next(df, Scratch(spark, "t")).withColumn("edited", spotsigs.edited(F.col("text"), F.col("next_text"))).collect()}
    order, text = sorted(ids, reverse=True), dict(rows)
    for k, i in enumerate(order):
        following, half = text[order[(k + 1) % len(order)]], len(text[i]) // 2
        assert got[i] == (following, text[i][: len(text[i]) - half] + following[:half])
    one = spark.createDataFrame([(5, "alone")], "doc_id long, text string")
    assert [(r.doc_id, r.text, r.next_text) for r in spotsigs.with_next(one, Scratch(spark, "t")).collect()] == [(5, "alone", "alone")]
    odd = spark.createDataFrame([(None, "n"), (1, None), (2, "b"), (2, "b")], "doc_id long, text string")
    assert spotsigs.with_next(odd, Scratch(spark, "t")).count() == 4 and spotsigs.with_next(odd.limit(0), Scratch(spark, "t")).count() == 0


def test_pairs_lose_none(spark):
    rng = random.Random(9)
    base = texts(20)
    rows = []
    for t in base:
        words = t.split()
        rows.append(t)
        for _ in range(4):
            w = list(words)
            for _ in range(rng.randrange(0, 1 + len(w) // 40)):
                w[rng.randrange(len(w))] = "changed"
            rows.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    prints = spotsigs.spotsigs(df).select("doc_id", "signatures", "fingerprint")
    sets = {r.doc_id: (set(r.signatures), r.fingerprint) for r in prints.collect()}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i][1], i)
    ones = sorted(first.values())
    want = {(a, b) for a, b in combinations(ones, 2) if len(sets[a][0] & sets[b][0]) >= 0.8 * len(sets[a][0] | sets[b][0])}
    got = {(r.a, r.b) for r in spotsigs.near_pairs(prints, Scratch(spark, "t")).collect()}
    assert got == want and want
