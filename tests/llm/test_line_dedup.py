"""Line dedup against a step-by-step version."""

from __future__ import annotations

import hashlib
import random

from tideline.llm import line_dedup
from tideline.llm.common import Scratch


def brute(docs: dict[int, str], words: int) -> dict[int, str]:
    """Deletes each line that lies in a run of so many words that stands earlier, without that line, by all pairs of places."""
    full = {d: [(i, x, len(x.split())) for i, x in enumerate(t.split("\n")) if x.split()] for d, t in docs.items()}
    places: dict[str, list] = {}
    for d in sorted(full):
        for k, (_, x, _) in enumerate(full[d]):
            places.setdefault(x, []).append((d, k))
    gone: dict[int, set] = {d: set() for d in docs}
    for at in places.values():
        for j, (d, k) in enumerate(at):
            for e, m in at[:j]:
                a = b = 0
                while k - a > 0 and m - a > 0 and full[d][k - a - 1][1] == full[e][m - a - 1][1]:
                    a += 1
                while (d != e or b + 1 < k - m) and k + b + 1 < len(full[d]) and m + b + 1 < len(full[e]) and full[d][k + b + 1][1] == full[e][m + b + 1][1]:
                    b += 1
                if sum(n for _, _, n in full[d][k - a : k + b + 1]) >= words:
                    gone[d].add(full[d][k][0])
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in docs.items()}


def corpus(seed: int, n: int) -> dict[int, str]:
    rng = random.Random(seed)
    lines = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    docs = {}
    for i in range(n):
        own = [" ".join(f"u{i}x{k}" for k in range(rng.randrange(1, 60))) if rng.random() < 0.4 else rng.choice(lines) for _ in range(rng.randrange(1, 12))]
        for _ in range(rng.randrange(3)):
            a = rng.randrange(50)
            own[1:1] = lines[a : a + rng.randrange(1, 8)]
        if rng.random() < 0.3:
            own.insert(2, "")
        if rng.random() < 0.2:
            own += rng.choice([["z z z"] * rng.randrange(60), ["p q", "r"] * rng.randrange(40), [*own, *own]])
        docs[i] = "\n".join(own)
    return docs


def test_against_brute_force(spark):
    docs = corpus(4, 150)
    run = "\n".join(f"{k} " * n for k, n in (("a", 30), ("b", 30), ("c", 10)))
    docs |= {200: "own\n" + run, 201: run + "\nother", 202: "\n".join(["z z z"] * 45)}
    df = spark.createDataFrame([(k, v, 7) for k, v in docs.items()], "doc_id long, text string, removed_lines int")
    out = line_dedup.dedup(df.repartition(5), Scratch(spark, "t"))
    assert out.columns == ["doc_id", "text", "removed_lines", "removed_lines_"]
    out = out.collect()
    got, want = {r.doc_id: r.text for r in out}, brute(docs, line_dedup.WORDS)
    assert got == want and sum(want[k] != docs[k] for k in docs) > 30
    assert {r.removed_lines for r in out} == {7}
    assert got[201] == "other"  # the tail of under 50 words goes too: the extension's work


def test_fingerprints_are_fewer_than_lines(spark):
    docs = corpus(8, 60)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    marks = line_dedup.marked(df).collect()
    places = {(r.id, r.mark) for r in marks}
    lines = sum(len([x for x in t.split("\n") if x.split()]) for t in docs.values())
    assert len(places) < 0.6 * lines and len(places) < len(marks)
    for r in marks:  # the least hash of the window, the rightmost of equal ones
        own = [hashlib.sha256(x.encode()).digest()[:16] if x.split() else None for x in docs[r.id].split("\n")]
        window = [i for i in range(r.start, r.ranges[0].end + 1) if own[i]]
        assert r.mark == max(i for i in window if own[i] == min(own[j] for j in window)) and bytes(r.hash) == own[r.mark]


def test_cases(spark):
    passage = " ".join(f"w{i}" for i in range(51))
    rows = [(1, passage), (2, "head\n" + passage + "\ntail"), (3, None), (4, ""), (5, "short\nshort"), (6, "short"), (None, "n\n" + passage), (7, "y y\n" * 40), (7, "y y\n" * 40), (8, passage.replace("w", "v") + "\n\nend"), (9, "\n".join([passage] * 3000))]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, row string, id string")
    out = [(r.doc_id, r.text) for r in line_dedup.dedup(df, Scratch(spark, "t")).collect()]
    by = dict(out)
    assert len(out) == len(rows) and by[None] == "n\n" + passage and by[1] == "" and by[2] == "head\ntail"
    assert by[3] is None and by[4] == "" and by[5] == "short\nshort" and by[6] == "short" and by[8] == rows[9][1] and by[9] == ""
    assert {t for i, t in out if i == 7} == {"\n".join(["y y"] * 25) + "\n"}  # the first run of 50 words stays whole
    assert line_dedup.dedup(df.limit(0), Scratch(spark, "t")).count() == 0
