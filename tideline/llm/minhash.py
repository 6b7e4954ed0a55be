"""MinHash near-dedup with odd sketches.

Words are lower-cased (A-Z) and shingled; documents of equal shingle sets form a class, and classes
of Jaccard similarity ``LINK`` or more are linked. Candidates come from ``BANDS`` bands of ``ROWS`` MinHash values: a
pair at 0.8 misses all of them with probability (1 - 0.8**4)**32 < 1e-7. Sets of up to ``SMALL / LINK``
shingles have one permutation per value, those of ``SMALL`` or more one value per bin of one permutation; a
size between has both, so that any two sets that can link share a scheme. An odd sketch folds a small
set itself, or ``BINS`` MinHash samples of a large one, into ``BITS`` parities; in a band's bucket the XOR
counts estimate every pair, those five standard errors from a link (for samples, under ``LOW``) are left out, and the rest are confirmed on the full sets.

Buckets are compared in rounds: first a spanning forest of the best estimates, then, between
components that remain apart, the best 8 and at last all pairs not yet compared, each in the first bucket
the two share; so a large group of near copies costs about its size, and no link is lost. A bucket of more than ``BUCKET`` classes is dealt
in blocks, each pair of blocks to one group. Components are found by alternating large and small stars.

Null and empty texts have an empty set, linked with nothing. A null doc_id is no component's name
unless it is alone. Rows equal in doc_id and text share one row of sets; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, held, table, text_of, tidy

WORDS, LINK = 4, 0.8
BANDS, ROWS, SMALL, BINS, BITS = 32, 4, 512, 512, 1024
LOW, BUCKET = 0.70, 512
BEST = (1, 8, None)
U = np.uint64
_rng = np.random.default_rng(20240229)
MULTIPLY = _rng.integers(0, 2**63, BANDS * ROWS, np.int64).astype(U) * U(2) + U(1)
ADD = _rng.integers(0, 2**63, BANDS * ROWS, np.int64).astype(U)


def fmix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    from xxhash import xxh3_64_intdigest

    w = text.encode(errors="surrogatepass").lower().split()
    if len(w) < words:
        return np.array([xxh3_64_intdigest(b" ".join(w), 1)] if w else [], U)
    h = np.fromiter(map(xxh3_64_intdigest, w), U, len(w))
    s = h[: len(h) - words + 1].copy()
    for i in range(1, words):
        s = fmix(s) + h[i : len(h) - words + 1 + i]
    return np.unique(fmix(s))


def minima(s: np.ndarray, bins: int) -> np.ndarray:
    """The least hash of each bin of the range; an empty bin borrows from the next that isn't, marked by the distance."""
    edges = (np.arange(bins, dtype=U) << U(64 - bins.bit_length() + 1)).astype(U)
    at = np.searchsorted(s, edges)
    full = np.append(at[1:], len(s)) > at
    known = np.flatnonzero(full)
    nearest = np.searchsorted(known, np.arange(bins)) % len(known)
    away = (known[nearest] - np.arange(bins)) % bins
    return s[at[known[nearest]]] + away.astype(U) * U(0x9E3779B97F4A7C15)


def parities(h: np.ndarray) -> bytes:
    return np.packbits((np.bincount((fmix(h) % U(BITS)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes()


def banded(values: np.ndarray, scheme: int) -> np.ndarray:
    v = values.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=U) * U(2) + U(scheme)
    for i in range(ROWS):
        key = fmix(key) + v[:, i]
    return (fmix(key) & ~U(1)) | U(scheme)  # the lowest bit names the scheme


def signature(s: np.ndarray) -> tuple[np.ndarray, bytes | None, bytes | None]:
    """Buckets, and the sketches of the two schemes."""
    buckets, small, large = [], None, None
    if len(s) <= SMALL / LINK:
        buckets.append(banded(np.min(s[:, None] * MULTIPLY + ADD, axis=0), 0))
        small = parities(s)
    if len(s) >= SMALL:
        buckets.append(banded(minima(s, BANDS * ROWS), 1))
        large = parities(minima(s, BINS) + np.arange(BINS, dtype=U) * U(0xD6E8FEB86659FD93))
    return np.concatenate(buckets), small, large


def likely(counts: np.ndarray, size: int, sizes: np.ndarray, scheme: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarities from XOR population counts, and which are within the error of a link.

    The parities of d differing values miss twice the coinciding pairs, about d * d / BITS, so an estimate of d is off by
    d * (2 / BITS) ** 0.5 or so; a small set's d is its symmetric difference, a large one's comes from sampled values."""
    apart = -BITS / 2 * np.log1p(-np.minimum(2 * counts / BITS, 0.999))
    if scheme:
        est = 1 - apart / (2 * BINS)
        return est, est >= LOW
    both = size + sizes
    return (both - apart) / (both + apart), apart <= both * (1 - LINK) / (1 + LINK) * (1 + 5 * (2 / BITS) ** 0.5) + 3


def sketch(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Per row: doc_id, key of the row, n_shingles, class (128 bits), buckets and sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        held(("minhash",), None)
        for batch in batches:
            for i in range(0, len(batch), 1024):
                part = batch.slice(i, 1024)
                n, cls, buckets, small, large = [], [], [], [], []
                for text in part["text"].to_pylist():
                    s = shingles(text, words)
                    n.append(len(s))
                    b, x, y = signature(s) if len(s) else (np.array([], U), None, None)
                    cls.append(xxh3_128_digest(s.tobytes()) if len(s) else None)
                    buckets.append(b.view(np.int64))
                    small.append(x)
                    large.append(y)
                flat = np.concatenate(buckets) if buckets else np.array([], np.int64)
                offsets = np.concatenate([[0], np.cumsum([len(b) for b in buckets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["key"], part["th"], pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.ListArray.from_arrays(offsets, flat), pa.array(small, pa.binary()), pa.array(large, pa.binary())], names=["doc_id", "key", "th", "n_shingles", "cls", "buckets", "small", "large"])

    return rows_of(docs).mapInArrow(tidy(run), "doc_id long, key long, th long, n_shingles long, cls binary, buckets array<long>, small binary, large binary")


def rows_of(docs: DataFrame) -> DataFrame:
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return rows.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("key"), F.xxhash64("text").alias("th"), "text")


def pairs_in_bucket(labels: np.ndarray, sketches: np.ndarray, sizes: np.ndarray, scheme: int, best: int | None, bucket: int = 0, buckets: np.ndarray | None = None, own: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of one bucket to confirm: of different labels, likely similar; with ``buckets`` (each member's), only those
    that share no bucket before this one; with ``own``, only those of different blocks."""
    m, found = len(labels), []
    for i in range(m - 1):
        # sizes alone keep some apart: intersection <= the smaller, union >= the larger
        ok = (labels[i + 1 :] != labels[i]) & (np.minimum(sizes[i], sizes[i + 1 :]) >= LINK * np.maximum(sizes[i], sizes[i + 1 :]) - 1e-9)
        if own is not None:
            ok &= own[i + 1 :] != own[i]
        js = np.flatnonzero(ok) + i + 1
        if len(js):
            est, keep = likely(np.bitwise_count(sketches[i] ^ sketches[js]).sum(axis=1, dtype=np.int64), int(sizes[i]), sizes[js], scheme)
            if buckets is not None and keep.any():
                same = buckets[i] == buckets[js[keep]]
                keep[keep] = buckets[i][same.argmax(axis=1)] == bucket
            found.append(np.stack([np.full(keep.sum(), i), js[keep], -est[keep]]))
    if not found:
        return []
    found = np.concatenate(found, axis=1)
    order = np.lexsort((found[1], found[0], found[2]))
    a, b = found[0][order].astype(int), found[1][order].astype(int)
    if best is None:
        return list(zip(a.tolist(), b.tolist(), strict=True))
    out = []
    if best == 1:  # a forest over the labels
        root = {int(x): int(x) for x in labels}

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = top(int(labels[i])), top(int(labels[j]))
            if x != y:
                root[x] = y
                out.append((i, j))
        return out
    taken: dict[tuple[int, int], int] = {}
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        key = (min(int(labels[i]), int(labels[j])), max(int(labels[i]), int(labels[j])))
        if taken.get(key, 0) < best:
            taken[key] = taken.get(key, 0) + 1
            out.append((i, j))
    return out


def candidates(members: DataFrame, classes: DataFrame, labels: DataFrame | None, best: int | None) -> DataFrame:
    """Pairs a < b of classes to confirm in this round."""
    rows = members
    if labels is not None:
        rows = rows.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        open_buckets = rows.groupBy("bucket", "block").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("bucket", "block")
        rows = rows.join(open_buckets, ["bucket", "block"])
    else:
        rows = rows.withColumn("label", F.col("cls"))
    rows = rows.join(classes.select("cls", "n_shingles", "small", "large", "buckets"), "cls")
    scheme = F.col("bucket").bitwiseAND(F.lit(1))
    every = F.col("buckets") if labels is not None else F.lit(None).cast("array<bigint>")
    rows = rows.select("bucket", "block", "cls", "label", "n_shingles", F.when(scheme == 1, F.col("large")).otherwise(F.col("small")).alias("sketch"), "own", "cross", every.alias("buckets"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        out_a: list[bytes] = []
        out_b: list[bytes] = []

        def close() -> None:
            if len(held) > 1:
                number: dict[bytes, int] = {}
                labels = np.array([number.setdefault(r[3], len(number)) for r in held])
                if len(number) > 1:
                    sketches = np.frombuffer(b"".join(r[5] for r in held), U).reshape(len(held), -1)
                    every = None
                    if held[0][8] is not None:
                        every = np.full((len(held), 2 * BANDS), -np.arange(1, len(held) + 1)[:, None] * 2, np.int64)  # no bucket is shared where one has none
                        for k, r in enumerate(held):
                            every[k, (0 if r[8][0] & 1 == 0 else BANDS) : (BANDS if len(r[8]) == BANDS and r[8][0] & 1 == 0 else 2 * BANDS)] = r[8]
                    own = np.array([r[6] for r in held]) if held[0][7] else None
                    for i, j in pairs_in_bucket(labels, sketches, np.array([r[4] for r in held], np.int64), held[0][0] & 1, best, held[0][0], every, own):
                        x, y = sorted((held[i][2], held[j][2]))
                        out_a.append(x)
                        out_b.append(y)
            held.clear()

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], names=["a", "b"])
            out_a.clear()
            out_b.clear()
            return batch

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("bucket", "block", "cls", "label", "n_shingles", "sketch", "own", "cross", "buckets")), strict=True):
                if held and held[0][:2] != row[:2]:
                    close()
                held.append(row)
            if len(out_a) > 10_000:
                yield made()
        close()
        yield made()

    # a group has 2 * BUCKET rows or so at most
    dealt = rows.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "cls")
    return dealt.mapInArrow(tidy(run), "a binary, b binary").distinct()


def confirm(pairs: DataFrame, texts: DataFrame, words: int = WORDS) -> DataFrame:
    """The pairs linked by their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, tuple[str, np.ndarray]] = {}

        def of(side: str, text: str) -> np.ndarray:
            if side not in last or last[side][0] != text:
                last[side] = (text, shingles(text, words))
            return last[side][1]

        for batch in batches:
            keep = []
            for x, y in zip(batch["ta"].to_pylist(), batch["tb"].to_pylist(), strict=True):
                s, t = of("a", x), of("b", y)
                small, large = (s, t) if len(s) < len(t) else (t, s)
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                keep.append(round(100 * both) >= round(100 * LINK) * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(tidy(run), "a binary, b binary").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """cls and label (the least of its component) of every end of an edge, by large and small stars."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e, seen, step = scratch.save(e, f"{name}-0"), None, 0
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u <> v").distinct()
        step += 1
        new = scratch.save(small, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        state = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).cast("string")).first()
        e = new
        if state == seen or not state[0]:
            break
        seen = state
    return e.select(F.col("u").alias("cls"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("cls"), F.col("v").alias("label"))).distinct()


def near_groups(docs: DataFrame, scratch: Scratch, words: int = WORDS) -> DataFrame:
    """Per row of docs: doc_id, key, th, n_shingles, component_id and kept."""
    sigs = scratch.save(sketch(docs, words), "sketches")
    full = sigs.filter("n_shingles > 0")
    each = full.groupBy("cls").agg(F.min(F.struct("key", "th")).alias("rep"), F.min("doc_id").alias("least_doc"))
    each = each.select("cls", "least_doc", F.col("rep.key").alias("key"), F.col("rep.th").alias("th"))
    each = scratch.save(each, "classes")
    spread = full.select("cls", F.explode("buckets").alias("bucket"))
    shared = scratch.save(spread.groupBy("bucket").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).filter("x <> y").select("bucket"), "buckets")
    members = scratch.save(spread.join(shared, "bucket").distinct(), "members")
    # beyond BUCKET classes a bucket is dealt in blocks, and each pair of blocks is a group
    counts = scratch.save(members.groupBy("bucket").count().filter(F.col("count") > BUCKET).withColumn("n", F.ceil(F.col("count") / BUCKET).cast("int") + 1).select("bucket", "n"), "large")
    own = F.pmod(F.xxhash64("cls"), F.col("n")).cast("int")
    groups = F.when(F.col("n").isNull(), F.array(F.struct(F.lit(0).alias("block"), F.lit(False).alias("cross")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1), lambda k: F.struct((F.least(k, own) * F.col("n") + F.greatest(k, own)).alias("block"), (k != own).alias("cross")))
    )
    members = members.join(counts, "bucket", "left").select("bucket", "cls", F.coalesce(own, F.lit(0)).alias("own"), F.explode(groups).alias("g")).select("bucket", "cls", "own", "g.block", "g.cross")
    members = scratch.save(members, "dealt")
    used = members.select("cls").distinct()
    some = used.join(each.select("cls", "key", "th"), "cls")
    sketches = scratch.save(some.join(full.select("cls", "key", "th", "n_shingles", "small", "large", "buckets"), ["cls", "key", "th"]).dropDuplicates(["cls"]).drop("key", "th"), "met")
    texts = scratch.save(rows_of(docs).select("key", "th", "text").join(some, ["key", "th"]).select("cls", "text"), "texts")

    labels, tested, edges = None, None, None
    for i, best in enumerate(BEST):
        pairs = candidates(members, sketches, labels, best)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.save(pairs, f"pairs-{i}")
        if pairs.isEmpty():
            if best is None:
                break
            continue
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = scratch.save(confirm(pairs, texts, words), f"links-{i}")
        edges = found if edges is None else edges.unionByName(found)
        if not found.isEmpty():
            labels = scratch.save(components(edges, scratch, f"stars-{i}"), f"labels-{i}")

    if labels is not None:
        grouped = each.select("cls", "least_doc").join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        least = grouped.groupBy("label").agg(F.min("least_doc").alias("component_id"))
        named = grouped.join(least, "label").select("cls", "label", "component_id")
    else:
        named = each.select("cls", F.col("cls").alias("label"), F.col("least_doc").alias("component_id"))
    named = scratch.save(named, "named")
    out = sigs.select("doc_id", "key", "th", "n_shingles", "cls").join(named, "cls", "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "key", "th", "n_shingles", "label", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def dedup(docs: DataFrame, scratch: Scratch, words: int = WORDS) -> DataFrame:
    """The documents less all but one of each group; of rows equal in doc_id and text one stays."""
    groups = near_groups(docs, scratch, words).filter("kept")
    # rows of one doc_id in one group with different texts: the least text hash stays. Groups go by label: unlike texts can
    # share a doc_id, or have none; texts without words are like no other
    stay = groups.groupBy("key", "label", F.when(F.col("n_shingles") == 0, F.col("th")).alias("own")).agg(F.min("th").alias("th")).select("key", "th").distinct()
    rows = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63))).alias("key"), F.xxhash64(text_of(docs)).alias("th"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    kept = rows.join(scratch.save(stay, "stay"), ["key", "th"], "left_semi").dropDuplicates(["key", "th"])
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), Scratch(spark, "op7")).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
