"""Mixing sources to target weights.

Sizes (words) are summed by source; sources in code-point order, null last, weigh 3, 1, 2, repeating,
and share ``share`` times all words, none above ``most`` times its own, the excess going to the others
by weight. That fixed point is ``least(most * size, level * weight)`` for the one level at which the
targets sum to the share, found by running sums over the source table. A document of a source of rate
``target / size`` is taken floor(rate) times, and once more if a hash of its id and the seed, read
as a number from 0 to 1, is under the fraction: an independent Bernoulli draw that reruns repeat.

Null texts have size 0; a source without words has target 0; repeated rows of a doc_id draw alike;
an empty table gives an empty one; other columns pass through ``copies`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, table

SEED = "mix"
SHARE, MOST = 1.5, 2.0
WEIGHTS = (3, 1, 2)


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """From 0 to 1, by the first 32 bits of a digest."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def targets(sized: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target and rate of every source, from rows of source and size."""
    # One row for each source: the windows below run over that table only.
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(every) - 1) % len(WEIGHTS) + 1).cast("int")).cast("double"))
    total = Window.partitionBy()
    by = by.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("all_size", F.sum("source_size").over(total))
    # in the order in which caps bind as the level rises
    rise = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    by = by.withColumn("caps_before", F.sum("cap").over(rise) - F.col("cap")).withColumn("weight_left", F.sum("weight").over(total) - F.sum("weight").over(rise) + F.col("weight"))
    by = by.withColumn("level_here", (F.lit(share) * F.col("all_size") - F.col("caps_before")) / F.col("weight_left"))
    # Taking too few or too many of the caps as binding gives a lower level: the level is the highest of these.
    level = F.max("level_here").over(total)
    by = by.withColumn("target", F.least("cap", level * F.col("weight")))
    return by.select("source", "source_size", "target", F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0)).alias("rate"))


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """Every document's size, its source's size, target and rate, and the copies the mix takes of it."""
    sized = docs.select(docs["doc_id"], docs["source"], size_of(docs["text"]).alias("size"))
    return copies_of(sized, targets(sized), seed)


def copies_of(sized: DataFrame, by: DataFrame, seed: str = SEED) -> DataFrame:
    # The source table has a row for each source; Spark broadcasts it only under its size threshold.
    by = by.withColumnRenamed("source", "of_source")
    joined = sized.join(by, sized["source"].eqNullSafe(by["of_source"]), "left").drop("of_source")
    whole = F.floor("rate")
    extra = F.when(draw(F.col("doc_id"), seed) < F.col("rate") - whole, 1).otherwise(0)
    return joined.withColumn("copies", (whole + extra).cast("long"))


def copies(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The documents as often as the mix takes them, with their own columns."""
    by = targets(docs.select("source", size_of(docs["text"]).alias("size"))).select(F.col("source").alias("of_source"), "rate")
    rows = docs.select(docs["doc_id"].alias("id"), docs["source"].alias("source"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    joined = rows.join(by, F.col("source").eqNullSafe(F.col("of_source")), "left")
    whole = F.floor("rate")
    n = (whole + F.when(draw(F.col("id"), seed) < F.col("rate") - whole, 1).otherwise(0)).cast("int")
    taken = joined.withColumn("copy", F.explode(F.when(n > 0, F.sequence(F.lit(1), n))))
    return taken.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2.0::DOUBLE * source_size AS cap, ([3.0, 1.0, 2.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
      sum(source_size) OVER () AS all_size FROM s),
r AS (SELECT *, sum(cap) OVER o - cap AS caps_before, sum(weight) OVER () - sum(weight) OVER o + weight AS weight_left FROM w
      WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, (1.5::DOUBLE * all_size - caps_before) / weight_left AS level_here FROM r),
t AS (SELECT source, source_size, least(cap, max(level_here) OVER () * weight) AS target FROM l),
x AS (SELECT doc_id, size, source_size, target, coalesce(target / nullif(source_size::DOUBLE, 0), 0) AS rate,
      CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM x
"""
