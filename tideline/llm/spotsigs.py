"""SpotSigs document fingerprints, in DataFrame functions only.

A spot signature is a common word (an anchor) with the chain of up to ``CHAIN`` content words after
it, up to the next anchor. A document's fingerprint is its set of signatures, as sorted 64-bit hashes;
a text with words but no signature has its whole text as one. The anchors are a fixed list, so that
fingerprints of different tables and of a growing table compare. ``likeness`` is the Jaccard
similarity of two sets, with pruning by set length where a threshold is asked for; ``near_pairs`` deals
documents by ranges of set length and compares those that share a signature of their prefix.

Null texts are empty, with an empty set; two empty sets are alike (1), an empty and another not (0). Repeated rows
have equal fingerprints; an empty table gives an empty one; other columns pass through, whatever their names.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, table, text_of

CHAIN = 3
#: Common words of English, French, German and Spanish.
ANCHORS = tuple(
    "a an and are as at be but by can for from had has have he her his if in is it its not of on or she that the their there they this to was we were which will with you "
    "au aux avec ce dans de des du elle en est et il la le les ne pas pour que qui se sur un une "
    "auf das dem den der die ein eine er es ich im ist mit nicht sich sie und von zu "
    "con del el lo los las más no para por su una y".split()
)
SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
SPACE = r"[\x20\x09-\x0D]"


def trie_pattern(words: tuple[str, ...]) -> str:
    """A regular expression of the words that never tries a letter twice."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        heads.setdefault(w[:1], []).append(w[1:])
    ends = "" in heads
    rest = [re.escape(c) + (trie_pattern(tuple(t)) if t != [""] else "") for c, t in heads.items() if c]
    return f"(?:{'|'.join(rest)}){'?' if ends else ''}" if len(rest) > 1 or ends else rest[0]


def pattern(anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> str:
    anchor = trie_pattern(anchors) + r"(?![^\x20\x09-\x0D])"
    return rf"(?<![^\x20\x09-\x0D]){anchor}(?:{SPACE}++(?!{anchor})[^\x20\x09-\x0D]++){{1,{chain}}}"


def signatures(text: Column) -> Column:
    """Sorted distinct hashes of a text's spot signatures."""
    plain = F.regexp_replace(F.translate(F.lower(text), SIGNS, " " * len(SIGNS)), rf"{SPACE}+", " ")
    spots = F.regexp_extract_all(plain, F.lit(pattern()), F.lit(0))
    whole = F.when(F.trim(text) == "", F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(text)))
    return F.when(F.size(spots) > 0, F.array_sort(F.array_distinct(F.transform(spots, lambda s: F.xxhash64(s))))).otherwise(whole)


def fingerprint(sigs: Column) -> Column:
    """Sixteen hex digits for each signature."""
    return F.lower(F.array_join(F.transform(sigs, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity; 0 without comparing where the lengths alone keep it under ``least``."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    full = common / (F.size(a) + F.size(b) - common)
    return F.when(large == 0, F.lit(1.0)).when(small < F.lit(least) * large, F.lit(0.0)).otherwise(full)


def spotsigs(docs: DataFrame) -> DataFrame:
    """The documents with ``signatures`` and ``fingerprint`` last (with underscores added while the documents have these names)."""
    sigs = fresh(docs, "signatures")
    out = docs.withColumn(sigs, signatures(text_of(docs)))
    return out.withColumn(fresh(docs, "fingerprint"), fingerprint(F.col(sigs)))


def near_pairs(prints: DataFrame, scratch: Scratch, least: float = 0.8) -> DataFrame:
    """a, b (doc_id, a < b) and likeness of the pairs of different sets at ``least`` or more, among representatives
    (smallest doc_id) of equal fingerprints. Sets are dealt by length: one of n signatures can only match lengths from least * n,
    a range spanning two classes of ratio 1 / least at most; and a match shares one of the first n - ceil(least * n) + 1 hashes in
    any one order, here from the rarest on, so that common signatures pair few. Documents without an id take no part."""
    ones = scratch.save(prints.filter("size(signatures) > 0 and doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"), F.first("signatures").alias("signatures")).drop("fingerprint"), "sets")
    n = F.size("signatures")
    cls = F.floor(F.log(n.cast("double")) / F.lit(-math.log(least)) + 1e-9).cast("int")
    each = ones.select("doc_id", F.explode("signatures").alias("h"))
    ranked = each.join(each.groupBy("h").agg(F.count(F.lit(1)).alias("met")), "h").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("met", "h"))).alias("signatures"))
    prefix = ranked.select("doc_id", cls.alias("cls"), F.explode(F.slice("signatures", 1, (n - F.ceil(n * least) + 1).cast("int"))).alias("s")).select("doc_id", "cls", "s.h")
    prefix = scratch.save(prefix, "prefixes")
    probe = prefix.withColumn("cls", F.explode(F.array(F.col("cls"), F.col("cls") + 1)))
    met = probe.alias("p").join(prefix.alias("q"), ["cls", "h"]).filter("p.doc_id <> q.doc_id")
    pairs = met.select(F.least("p.doc_id", "q.doc_id").alias("a"), F.greatest("p.doc_id", "q.doc_id").alias("b")).distinct()
    left = pairs.join(ones.select(F.col("doc_id").alias("a"), F.col("signatures").alias("sa")), "a")
    both = left.join(ones.select(F.col("doc_id").alias("b"), F.col("signatures").alias("sb")), "b")
    return both.withColumn("likeness", likeness(F.col("sa"), F.col("sb"), least)).filter(F.col("likeness") >= least).select("a", "b", "likeness")


# -- the next document ----------------------------------------------------------------------------

#: Rows to a range, and the most ranges.
RANGE, RANGES = 4096, 100_000


def ranged(rows: DataFrame) -> Column:
    """A number that rises with (key, tie), about ``RANGE`` rows each, by quantiles of the whole table's keys. A key that makes up several ranges is split by
    its ties, which are hashes of texts; only rows equal in key and text can't be."""
    n = min(RANGES, rows.count() // RANGE)
    if not n:
        return F.lit(0)
    cuts = rows.agg(F.percentile_approx("key", [(i + 1) / (n + 1) for i in range(n)], max(10_000, 4 * n)).alias("c")).first()["c"]
    known = F.split(F.lit(",".join(map(str, sorted(cuts)))), ",").cast("array<bigint>")  # folded to one literal

    def cuts_where(holds) -> Column:
        """How many of the sorted cuts hold, by binary search."""
        steps = F.array(*[F.lit(1 << b) for b in range(n.bit_length() - 1, -1, -1)])
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(holds(F.get(known, at + step - 1)), F.lit(False)), at + step).otherwise(at))

    low, high = cuts_where(lambda c: c < F.col("key")), cuts_where(lambda c: c <= F.col("key"))
    share = F.col("tie").cast("double") / F.lit(2.0**64) + 0.5
    within = F.least(F.floor(share * (high - low)).cast("int"), high - low - 1) + 1
    return F.when(high - low > 1, low + within).otherwise(high)


def with_next(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, text and signatures ``s`` of every row, and next_text and next_s of the next, by descending doc_id (null last), then descending text hash; the last's next is the first.

    Rows are dealt by ranges of ids; the head of each range is copied to the end of the
    one before it, so that a window over one range sees every neighbour. Signatures are made once for each row."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    rows = rows.withColumns({"key": F.coalesce("doc_id", F.lit(-(2**63))), "tie": F.xxhash64("text")})
    rows = rows.withColumn("range", ranged(rows))
    heads = rows.groupBy("range").agg(F.max(F.struct("key", "tie")).alias("head"))
    # one row for each range, RANGES at most
    down = Window.orderBy(F.desc("range"))
    last = F.min("range").over(Window.partitionBy())
    heads = heads.select(F.coalesce(F.lag("range").over(down), last).alias("range"), F.col("head.key").alias("key"), F.col("head.tie").alias("tie"))
    # read from a file, whose size is known, Spark broadcasts the heads only under its threshold
    heads = scratch.save(heads, "heads")
    tails = rows.drop("range").join(heads, ["key", "tie"]).withColumn("tail", F.lit(1))
    both = [x.withColumn("s", signatures(F.col("text"))) for x in (rows.withColumn("tail", F.lit(0)), tails)]
    order = Window.partitionBy("range").orderBy("tail", F.desc("key"), F.desc("tie"))
    out = both[0].unionByName(both[1]).withColumns({"next_text": F.lead("text").over(order), "next_s": F.lead("s").over(order)})
    return out.filter("tail = 0").select("doc_id", "text", "s", "next_text", "next_s")


def edited(text: Column, following: Column) -> Column:
    """The text with its last half (rounded down) replaced by as many code points of the following."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(following, F.lit(1), half))


def op5_spotsigs(spark, sf_dir: str) -> DataFrame:
    rows = with_next(table(spark, sf_dir, "documents"), Scratch(spark, "op5")).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "s", signatures(F.col("edited")).alias("e"), "next_s")
    return rows.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("s")).alias("fingerprint"), fingerprint(F.col("e")).alias("edited_fingerprint"), likeness(F.col("s"), F.col("e")).alias("near_edited"), likeness(F.col("s"), F.col("next_s")).alias("near_next"))
