"""Near-dedup against brute force."""

from __future__ import annotations

import random
from itertools import combinations

from tideline.llm import minhash
from tideline.llm.common import Scratch


def sets(text: str, k: int = 4) -> set:
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows) -> dict:
    s = [(i, sets(t)) for i, t in rows]
    parent = list(range(len(s)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(s)), 2):
        x, y = s[a][1], s[b][1]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            parent[top(a)] = top(b)
    least = {}
    for k in range(len(s)):
        least[top(k)] = min(least.get(top(k), s[k][0]), s[k][0])
    return {s[k][0]: (len(s[k][1]), least[top(k)]) for k in range(len(s))}


def corpus(seed: int):
    rng = random.Random(seed)
    rows, n = [], 0
    for _ in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 6, 20, 120, 520, 660, 900]))]
        for _ in range(rng.choice([1, 2, 12, 30])):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 30)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
            rows.append((n, " ".join(w).upper() if rng.random() < 0.2 else "  ".join(w)))
            n += 1
    rng.shuffle(rows)
    return rows


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, cls string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_groups(df, Scratch(spark, "t"), 4).collect()}
    assert got == brute(rows)


def test_against_brute_force(spark):
    check(spark, corpus(1))


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BUCKET", 7)
    check(spark, corpus(2))


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, "one two"), (4, "One TWO"), (5, " \n "), (None, "a b c d e"), (6, "a b c d e"), (7, "word " * 100_000), (8, "word " * 5), (9, "q r s t u"), (9, "q r s t u")]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, label string")
    out = minhash.near_groups(df, Scratch(spark, "t"), 4).collect()
    by = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out}
    assert len(out) == len(rows)
    assert by[1] == (0, 1, True) and by[2] == (0, 2, True) and by[3] == (1, 3, True) and by[4] == (1, 3, False)
    assert by[None] == (2, 6, False) and by[6] == (2, 6, True) and by[7] == (1, 7, True) and by[8] == (1, 7, False) and by[9] == (2, 9, True)
    kept = minhash.dedup(df, Scratch(spark, "t"), 4)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 5, 6, 7, 9]
    assert minhash.near_groups(df.limit(0), Scratch(spark, "t")).count() == 0 and minhash.dedup(df.limit(0), Scratch(spark, "t")).count() == 0


def test_unlike_texts_of_one_or_no_doc_id_stay(spark):
    clean = [" ".join(f"t{i}w{k}" for k in range(30)) for i in range(6)]
    rows = [(None, t) for t in clean[:4]] + [(None, clean[0] + " more"), (1, clean[4]), (1, clean[5]), (1, clean[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((str(r.doc_id), r.text[:5]) for r in minhash.dedup(df, Scratch(spark, "t"), 5).collect())
    assert kept == sorted([("None", t[:5]) for t in clean[:4]] + [("1", t[:5]) for t in clean[4:]])


def test_a_text_of_one_shingle_links_to_a_longer_one(spark):
    check(spark, [(1, "a a a a"), (2, "a a a a a"), (3, "b c d e"), (4, "b c d")])
