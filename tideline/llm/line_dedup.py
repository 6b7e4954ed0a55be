"""Line dedup by winnowing over line hashes, in DataFrame functions only.

Lines with words are hashed. At each line a window holds just as many lines as reach ``words`` words, and selects
the position of its least hash, the rightmost of equal ones: the document's fingerprints, fewer than its lines. A run of that many words
that stands in two places holds a whole window, so both places select the same fingerprint at the same line of it.

Fingerprints are joined by hash, and those met in one place only drop out with their windows. A window about a
fingerprint that is met elsewhere is extended line by line over the lines to its right that hold
under ``words`` words after its first line (beyond, a later window takes over; to its left, the windows of earlier lines that selected it or their own fingerprint). Every step of this is a range
of lines around the fingerprint, known by a digest of its lines. The first place of a range, by (doc_id,
text hash, line), stays; in a later place its lines are deleted, but for those that the first place holds too where the two overlap. Ranges
that touch merge into runs. So a line goes just when it lies in a run of ``words`` words or more that stands earlier
without that line: all maximal repeated runs go, with their tails, and no pairs of copies are made. Lines outside them stay byte for byte.

Lines are compared by 128 bits of SHA-256, and ranges by as many of their lines' digests: at 10**12 ranges unlike ones are
taken for equal with a probability under 1e-14.

Defined cases: null text stays null; lines without words stay, in a deleted run too; rows equal in doc_id and text count
as one document, and each keeps what it keeps; null doc_ids are ordered first; an empty table
gives an empty one; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, fresh, table

WORDS = 50
KEY = ["id", "th"]


def keyed(docs: DataFrame) -> DataFrame:
    """KEY and all columns as ``row``, so that no name can clash."""
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(docs["text"]).alias("th"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))


def digest(text):
    """128 bits, in hex."""
    return F.substring(F.sha2(text, 256), 1, 32)


def marked(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Per line that starts a full window: the fingerprint it selects (position and hash), and the window and its
    extensions to the right as ``ranges`` (last line, digest)."""
    lines = keyed(docs).select(*KEY, F.posexplode(F.split("row.text", "\n", -1)).alias("pos", "line"))
    lines = lines.select(*KEY, "pos", F.unhex(digest(F.col("line").cast("binary"))).alias("hash"), F.regexp_count("line", F.lit(WORD)).cast("long").alias("n")).filter("n > 0")
    lines = lines.dropDuplicates([*KEY, "pos"])
    by_doc = Window.partitionBy(*KEY)
    lines = lines.withColumn("after", F.sum("n").over(by_doc.orderBy("pos"))).withColumn("before", F.col("after") - F.col("n"))
    line = F.struct("pos", F.hex("hash").alias("hash"))
    window = by_doc.orderBy("before").rangeBetween(0, words - 1)
    reach = by_doc.orderBy("after").rangeBetween(0, words - 1)
    at = lines.select(
        *KEY,
        "pos",
        F.sum("n").over(window).alias("span_words"),
        F.min(F.struct("hash", (-F.col("pos")).alias("minus"))).over(window).alias("least"),
        F.collect_list(line).over(window).alias("window"),
        F.collect_list(line).over(reach).alias("reach"),
    ).filter(F.col("span_words") >= words)
    # both start at this line, so the longer one holds the other
    long = F.when(F.size("reach") > F.size("window"), F.col("reach")).otherwise(F.col("window"))
    at = at.select(*KEY, "pos", "least", F.size("window").alias("k"), long.alias("long"))
    upto = lambda k: F.array_join(F.transform(F.slice("long", 1, k), lambda x: x["hash"]), "")
    ranges = F.transform(F.sequence("k", F.size("long")), lambda k: F.struct(F.element_at("long", k)["pos"].alias("end"), F.unhex(digest(upto(k).cast("binary"))).alias("digest")))
    return at.select(*KEY, F.col("pos").alias("start"), (-F.col("least.minus")).alias("mark"), F.col("least.hash").alias("hash"), ranges.alias("ranges"))


def repeated_runs(docs: DataFrame, scratch: Scratch, words: int = WORDS) -> DataFrame:
    """Per document with any: its later repeated runs of lines, as KEY and ``runs``."""
    marks = scratch.save(marked(docs, words), "marks")
    mark = F.struct(*KEY, "mark")
    met = scratch.save(marks.groupBy("hash").agg(F.min(mark).alias("x"), F.max(mark).alias("y")).filter("x <> y").select("hash"), "met")
    # both sides of the joins come from files, so that a hot line's or range's partition can be split
    ranges = scratch.save(marks.join(met, "hash", "left_semi").select(*KEY, "start", F.explode("ranges").alias("r")).select(*KEY, "start", "r.*"), "ranges")
    place = F.struct(*KEY, "start", "end")
    first = scratch.save(ranges.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "first")
    own = (F.col("id") == F.col("first.id")) & (F.col("th") == F.col("first.th"))
    later = ranges.join(first, "digest").filter(place > F.col("first"))
    later = later.select(*KEY, F.when(own, F.greatest("start", F.col("first.end") + 1)).otherwise(F.col("start")).alias("a"), F.col("end").alias("b")).filter("a <= b")
    by_doc = Window.partitionBy(*KEY).orderBy("a", "b")
    before = F.max("b").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    runs = later.withColumn("apart", F.coalesce((F.col("a") > before + 1).cast("int"), F.lit(1))).withColumn("run", F.sum("apart").over(by_doc))
    runs = runs.groupBy(*KEY, "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return runs.groupBy(*KEY).agg(F.collect_list(F.struct("a", "b")).alias("runs"))


def dedup(docs: DataFrame, scratch: Scratch, words: int = WORDS) -> DataFrame:
    """The documents with later repeated runs deleted from ``text``, and the count of removed lines, last, as removed_lines
    (with underscores added while the documents have that name)."""
    joined = keyed(docs).join(repeated_runs(docs, scratch, words), KEY, "left")
    lines = F.split("row.text", "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.exists("runs", lambda r: i.between(r["a"], r["b"])) | ~x.rlike(WORD))
    joined = joined.withColumn("kept", F.when(F.col("runs").isNotNull(), kept))
    text = F.when(F.col("runs").isNull(), F.col("row.text")).otherwise(F.array_join("kept", "\n"))
    removed = F.when(F.col("runs").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size("kept")).cast("long")
    return joined.select(*[(text if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns], removed.alias(fresh(docs, "removed_lines")))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs, Scratch(spark, "op4")).select("doc_id", "text", "removed_lines")


#: The same runs by all ranges that start or end at a line, compared by their lines.
ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
n AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l),
a AS (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS after FROM n WHERE n > 0),
b AS (SELECT *, after - n AS before FROM a),
w AS (SELECT doc_id, pos, last(pos) OVER s AS stop, list(line) OVER s AS content, sum(n) OVER s AS span FROM b
      WINDOW s AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)),
v AS (SELECT doc_id, first(pos) OVER s AS pos, pos AS stop, list(line) OVER s AS content, sum(n) OVER s - n AS span FROM b
      WINDOW s AS (PARTITION BY doc_id ORDER BY after RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
u AS (SELECT * FROM w WHERE span >= 50 UNION ALL SELECT * FROM v WHERE span >= 50),
r AS (SELECT doc_id, pos, stop, first(doc_id) OVER o AS first_doc, first(stop) OVER o AS first_stop, row_number() OVER o AS k FROM u WINDOW o AS (PARTITION BY content ORDER BY doc_id, pos)),
gone AS (SELECT DISTINCT b.doc_id, b.pos FROM r JOIN b ON b.doc_id = r.doc_id
         AND b.pos BETWEEN CASE WHEN r.doc_id = r.first_doc THEN greatest(r.pos, r.first_stop + 1) ELSE r.pos END AND r.stop WHERE r.k > 1),
t AS (SELECT l.doc_id, string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos) AS text, count(g.pos) AS removed_lines
      FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text, coalesce(t.removed_lines, 0) AS removed_lines FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id
"""
