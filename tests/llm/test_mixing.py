"""Mixing against a step-by-step resharing."""

from __future__ import annotations

from tideline.llm import mixing


def reshare(sizes: dict, share: float = 1.5, most: float = 2.0) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        free -= over
    return target


def test_targets_and_copies(spark):
    rows = [(i, "w " * (1 + i % 7 * (1 + i % 3 * 9)), ["b", "a", "é", None, "Z", "big"][min(i % 11, 5)], i) for i in range(600)]
    rows += [(None, None, "empty", 1), (7000, "", "empty", 2), (1, "same words here", "a", 3), (1, "same words here", "a", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    out = mixing.mix(docs).collect()
    sizes = {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = reshare(sizes)
    for r in out:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert r.copies in {int(r.rate), int(r.rate) + 1} and r.copies <= 2
    assert len(out) == len(rows)
    taken = {}
    for r in out:
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
    assert abs(taken["big"] - want["big"]) < 0.1 * want["big"]
    copies = mixing.copies(docs)
    assert copies.columns == docs.columns and copies.count() == sum(r.copies for r in out)
    assert mixing.mix(docs).orderBy("doc_id", "size").collect() == mixing.mix(docs.repartition(5)).orderBy("doc_id", "size").collect()
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.copies(docs.limit(0)).count() == 0


def test_null_and_tied_sources(spark):
    docs = spark.createDataFrame([(1, "a b", None), (2, "c", "x"), (3, None, "y")], "doc_id long, text string, source string")
    got = {r.source: r.target for r in mixing.mix(docs).collect()}
    assert got == reshare({None: 2, "x": 1, "y": 0})
