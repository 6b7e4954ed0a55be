"""The corpus pipeline: language ID, line dedup, near-dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as
the next stage's docs. All stages but the last return the columns of documents; other columns pass through to packing, whatever their names.

Defined cases: a null or empty text, and one without letters, is rejected by the first stage. Null doc_ids, langs and sources pass; a null lang
becomes the predicted one. Rows equal in doc_id and text count as one document up to near-dedup, which keeps one of them; rows alike in
text only are copies of each other. Very long texts are read whole. An empty table gives no rows at any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import language, line_dedup, minhash, mixing, packing
from tideline.llm.common import WORD, Scratch, fresh, table

#: Near-duplicates here are of five-word shingles.
SHINGLE = 5


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of undetermined language, without letters or text; where lang is null, the predicted one takes its place."""
    held = {f"__{i}": c for i, c in enumerate(docs.columns)}  # under names that no result has
    rows = docs.select("text", *[F.col(c).alias(h) for h, c in held.items()])
    kept = language.predict(rows, language.fit(docs), tuple(held)).filter(F.col("lang_pred") != language.UND)
    return kept.select(*[(F.coalesce(h, "lang_pred") if c == "lang" else F.col(h)).alias(c) for h, c in held.items()])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeated runs of lines, and the documents of which no word is left; n_chars follows the text."""
    out = line_dedup.dedup(docs, Scratch(spark, "lines"))
    out = out.filter((F.col(fresh(docs, "removed_lines")) == 0) | F.col("text").rlike(WORD))
    return out.select(*[(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c)) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that of the smallest doc_id; documents without words are copies of none but equal ones."""
    return minhash.dedup(docs, Scratch(spark, "near"), SHINGLE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; null sources are a source of their own, and rows of one doc_id are drawn alike."""
    return mixing.copies(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; a null text would have just its end id."""
    return packing.digest(packing.pack(docs))


STAGES = [
    ("language_id", identify),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A conditional random field and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
