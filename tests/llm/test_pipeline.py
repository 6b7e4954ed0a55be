"""The pipeline: columns, and each stage on its predecessor's rows."""

from __future__ import annotations

import pytest

import corpus_pipeline


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if i < 4:
            assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0 and counts[4] > 0 and counts[5] > 0
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(docs.columns)
    assert corpus_pipeline.run(spark, sf).count() == counts[5]


def edge_rows():
    english = "The quick brown fox went over the hill and it was not seen by the others that day"
    spanish = "El perro de la casa no fue visto por los otros en el monte que era muy alto"
    passage = " ".join(f"word{i}" for i in range(60))
    texts = [
        (1, f"{english} one\n{passage}"), (2, f"{spanish} dos\n{passage}"), (3, None), (4, ""), (5, " \n "), (6, "12 34 !!"), (7, f"{english} one\n{passage}"), (None, "Nobody had thought that there was anything to be said about it at all"), (None, "Nadie dijo nada de lo que el mundo quiso saber por la tarde"),
        (8, f"{spanish} largo " * 6000), (9, english), (9, english), (9, f"{spanish} mismo id"), (10, passage),
    ]
    return [(i, t, None if k % 3 == 0 else ("es" if "El perro" in (t or "") or "Nadie" in (t or "") else "en"), [None, "a", "b"][k % 3], len(t or ""), "mine", k) for k, (i, t) in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, removed_lines string, row int"


def test_edge_cases(spark):
    """Nulls anywhere, empty and long texts, equal rows and ids, names that the stages use themselves, and empty tables."""
    rows = edge_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    first = corpus_pipeline.identify(spark, docs, "")
    kept = sorted(first.collect(), key=lambda r: r.row)
    assert first.columns == docs.columns
    assert [r.row for r in kept] == [k for k, r in enumerate(rows) if any(c.isalpha() for c in r[1] or "")]
    assert all(r.lang in ("en", "es") and (rows[r.row][2] or r.lang) == r.lang and r.removed_lines == "mine" for r in kept)
    first = spark.createDataFrame(kept, SCHEMA)
    second = corpus_pipeline.drop_lines(spark, first, "")
    by = {r.row: r for r in second.collect()}
    assert second.columns == docs.columns and 13 not in by  # all of its words stand earlier
    assert all(r.n_chars == len(r.text) and r.removed_lines == "mine" for r in by.values())
    assert by[0].text == rows[0][1] and "word1 " not in by[1].text and 6 not in by  # a copy of 0
    second = spark.createDataFrame(list(by.values()), SCHEMA)
    third = corpus_pipeline.drop_near_copies(spark, second, "")
    left = {r.row for r in third.collect()}
    assert third.columns == docs.columns and {7, 8} <= left  # unlike texts without an id
    assert len(left & {10, 11}) <= 1
    third = spark.createDataFrame([r for r in by.values() if r.row in left], SCHEMA)
    fourth = corpus_pipeline.mix_sources(spark, third, "")
    assert fourth.columns == docs.columns and {r.row for r in fourth.collect()} <= left
    pieces = corpus_pipeline.pack_sequences(spark, third, "").collect()
    assert len({(p.doc_id, p.doc_tokens) for p in pieces}) <= len(left) and sum(p.length for p in pieces) > 6000
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
