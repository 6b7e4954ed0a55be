"""Token files and packing against the tokenizer and against exact round trips."""

from __future__ import annotations

import random
import unicodedata
import zlib

import numpy as np
import pytest

from tideline.llm import packing, pfor, token_files
from tideline.llm.common import Scratch
from tideline.llm.tokenize import default_path, encoder

TEXTS = ["It's <|endoftext|> don't ..., a.b é́x ΣΑΣ İx a\x01b 12,34 foo, BAR.  z \x1c q r", "", None, "  \n", "Word " * 9000, "naïve Café, café."]


def reference(text):
    return encoder(default_path()).tok.encode(text or "", add_special_tokens=False).ids


def docs(spark, rows=None):
    rows = rows if rows is not None else [(i * 3, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", None), (4, "same", "y"), (4, "same", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_pfor_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.05, rng.integers(0, 2**32, n), rng.integers(7, 900, n)).astype("<u4")
    assert (pfor.decode(pfor.encode(ids)) == ids).all()
    assert (pfor.decode(pfor.encode(np.full(n, 2**32 - 1, "<u4"))) == 2**32 - 1).all()


def test_encoder_equals_library():
    e = encoder(default_path())
    for _ in range(2):  # the second time from the cache
        got = [np.frombuffer(x, "<u4").tolist() for x in e.encode([t or "" for t in TEXTS])]
        assert got == [reference(t) for t in TEXTS]


def test_encoder_equals_library_on_odd_texts():
    """100,000 texts of every category of code points, numbers in letters, and added tokens in all cases."""
    rng = random.Random(1)
    by_category: dict[str, list[str]] = {}
    for c in range(0x30000):
        by_category.setdefault(unicodedata.category(chr(c)), []).append(chr(c))
    by_category.pop("Cs")
    kinds = list(by_category)
    odd = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "<|STARTOFTEXT|>", "m²,", "km².", "x³,", "CO₂,", "H₂O.", "ῌ͂", "ǅ", "ŉ", "Σ", "İ", " ", "\x1c", "'s", "'S", "́", ".", ",", "\n"]

    def some() -> str:
        r = rng.random()
        if r < 0.3:
            return rng.choice(odd)
        if r < 0.6:
            return "".join(rng.choice("abcDEFéÉñüßЖж") for _ in range(rng.randrange(1, 6)))
        return "".join(rng.choice(by_category[rng.choice(kinds)]) for _ in range(rng.randrange(1, 3)))

    texts = ["".join(some() + " " * (rng.random() < 0.3) for _ in range(rng.randrange(1, 12))) for _ in range(100_000)] + odd
    e = encoder(default_path())
    want = e.tok.encode_batch_fast(texts, add_special_tokens=False)
    assert [t for t, g, w in zip(texts, e.encode(texts), want, strict=True) if np.frombuffer(g, "<u4").tolist() != w.ids] == []

def test_files_read_back(spark):
    df = docs(spark)
    out = token_files.read(token_files.write(df, Scratch(spark, "t"), shards=3)).orderBy("start").collect()
    rows = sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    start = 0
    for got, r in zip(out, rows, strict=True):
        ids = np.array([*reference(r.text), 2], "<u4")
        assert (got.doc_id, got.start, got.n_tokens, got.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.read(token_files.write(docs(spark, []), Scratch(spark, "t"), shards=2)).count() == 0


def test_pieces_hold_every_id_once(spark):
    df = docs(spark)
    pieces = packing.pack(df).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    want = {}
    for r in df.collect():
        ids = [*reference(r.text), 1]
        want.setdefault((r.doc_id, len(ids)), []).extend(ids)
    for key, ids in want.items():
        got = sorted(by_doc.pop(key), key=lambda p: (p.start, p.sequence_id))
        assert sorted(np.concatenate([np.frombuffer(p.ids, "<u4") for p in got]).tolist()) == sorted(ids)
    assert not by_doc
    for some in by_sequence.values():
        at = 0
        for p in sorted(some, key=lambda p: p.offset):
            assert p.offset == at
            at += len(p.ids) // 4
        assert at <= packing.LENGTH
    assert packing.pack(docs(spark, [])).count() == 0


def test_digest_names_each_piece(spark):
    df = docs(spark)
    rows = packing.digest(packing.pack(df)).collect()
    whole = [np.array([*reference(r.text), 1], "<u4") for r in df.collect()]
    for p in rows:
        assert any(len(x) == p.doc_tokens and zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for x in whole)
    assert sum(p.length for p in rows) == sum(map(len, whole))


def ids_of(sequences):
    return sorted((d, i) for s in sequences for d, a, n in s for i in range(a, a + n))


@pytest.mark.parametrize("mean", [2, 4, 5, 7])
def test_tiers_are_packed_full(mean):
    rng = random.Random(mean)
    for turn in range(40):
        pieces = [(i, 0, max(1, min(20_000, int(rng.lognormvariate(mean, 1.6))))) for i in range(rng.randrange(0, 400))]
        sizes = {d: n for d, _, n in pieces}
        full, left = packing.fill(pieces, 2048, sizes)
        assert all(sum(p[2] for p in s) == tier and tier in packing.TIERS for tier, s in full)
        assert sum(p[2] for p in left) < 2048
        tail = packing.taper(left)
        assert all((n := sum(p[2] for p in s)) & (n - 1) == 0 for s in tail)
        assert ids_of([*(s for _, s in full), *tail]) == ids_of([[p] for p in pieces])
        # without the tiers, the result is another
        if turn == 0 and mean > 4:
            assert len({tier for tier, _ in full}) > 2


def test_short_documents_stay_whole():
    rng = random.Random(9)
    pieces = [(i, 0, max(1, int(rng.lognormvariate(5.8, 1.0)))) for i in range(3000)]
    sizes = {d: n for d, _, n in pieces}
    full, left = packing.fill(pieces, 2048, sizes)
    times = {}
    for s in [*(s for _, s in full), left]:
        for d, _, _ in s:
            times[d] = times.get(d, 0) + 1
    assert any(n > 2048 for n in sizes.values()) and {t for t, _ in full} == set(packing.TIERS)
    assert [d for d, k in times.items() if k > 1 and sizes[d] <= 2048] == []
    dealt = packing.grouped(full, 2048)
    cost, tokens = {}, {}
    for g, tier, s in dealt:
        cost[g] = cost.get(g, 0) + sum(p[2] ** 2 for p in s)
        tokens[g] = tokens.get(g, 0) + tier
    assert max(cost.values()) < 1.1 * min(cost.values()) and max(tokens.values()) < 1.3 * min(tokens.values())


def test_packing_worker_stays_small(spark, monkeypatch):
    """A task that meets 624,000 words, in a process of its own: it holds no more than a part of them, and gives back what it no longer holds."""
    import multiprocessing
    from pathlib import Path

    import pyarrow as pa

    rows = docs(spark)
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, f, schema: f)
    run = packing.pack(rows)
    letters = "bcdfghklmnprstvz"
    batches = [pa.RecordBatch.from_pydict({"doc_id": [d], "text": [" ".join("".join(letters[i >> 4 * k & 15] for k in range(5)) for i in range(12_000 * d, 12_000 * d + 12_000))]}) for d in range(52)]

    def own(out):
        size = lambda: int(Path("/proc/self/status").read_text().split("RssAnon:")[1].split()[0]) / 1024
        encoder(default_path())
        before, ids, most = size(), 0, 0

        def watched():
            nonlocal most
            for batch in batches:
                yield batch
                most = max(most, size() - before)

        for batch in run(watched()):
            ids += sum(len(x) // 4 for x in batch["ids"].to_pylist())
        out.put((most, size() - before, ids))

    out = multiprocessing.get_context("fork").Queue()
    child = multiprocessing.get_context("fork").Process(target=own, args=(out,))
    child.start()
    most, end, ids = out.get(timeout=120)
    child.join()
    assert most < 70 and end < 50 and ids >= 52 * 12_001, (most, end, ids)
