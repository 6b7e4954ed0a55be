"""Exact top-k search by columnar branch and bound.

Vectors become integers, floor(scale * x), held as doubles (each holds its integer exactly). Candidates lie in blocks of
``BLOCK`` in vertical layout (dimension by dimension); queries in blocks of about ``QUERIES``. The pairs of query
block and candidate block are dealt as a grid: query blocks are copied to as many ways as there are groups of some
``WAY`` candidates, each candidate block goes once to each query block, under its way. The blocks of a cell pass its task one
by one, and each query's best so far are carried from block to block. For each query a block of dimensions
is added at a time; with the Cauchy-Schwarz bound on what remains, the k-th best lower bound (or the k-th best score
met before) is a threshold, and candidates whose upper bound is below it are compacted away. Survivors have
their whole score. The best k of each cell then meet per query, ranked with ties to smaller id.

Where sums could pass 2**53, doubles only bound the scores, with their rounding added to the slack, and survivors are
scored in whole integers; a result's score that no long holds raises an error. Vectors null, empty, or holding
null or non-finite components take no part; null ids neither. Vectors are compared with
those of equal length. A row's own id is no candidate of it; repeated rows are one candidate each and
one query for each id. An empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

BLOCK, QUERIES, STEP = 4096, 8192, 16
#: Candidates to a way, and queries whose first products are held at a time.
WAY, HELD = 16 * BLOCK, 1024
SCALE = 256
EXACT = 2.0**53
HITS = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, dims and the vector of whole numbers as doubles."""

    def whole(x):
        y = F.lit(float(scale)) * x.cast("double")
        # from 2**53 on doubles are whole numbers, and may pass a long
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)

    fits = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < float("inf")))
    ok = vectors.filter("vec_id is not null and embedding is not null and size(embedding) > 0").filter(fits)
    return ok.select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dims"), F.transform("embedding", whole).alias("v"))


def packed(matrix: np.ndarray) -> bytes:
    """Four bytes a component where they hold all of them, else eight."""
    small = matrix.size == 0 or np.abs(matrix).max() < 2**31
    return np.ascontiguousarray(matrix).astype("<i4" if small else "<f8").tobytes()


def unpacked(data: bytes, dims: int, n: int) -> np.ndarray:
    return np.frombuffer(data, "<i4" if len(data) == 4 * dims * n else "<f8").reshape(dims, n).astype(np.float64)


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (part, vec_id, dims, v) of each task into blocks: ids and a dims x n matrix, vertical."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int64()), ("dims", pa.int32()), ("ids", pa.binary()), ("matrix", pa.binary())])
        held: dict[tuple, list] = {}

        def flush(key: tuple) -> pa.RecordBatch:
            ids, flat = (np.concatenate(x) for x in zip(*held.pop(key), strict=True))
            return pa.RecordBatch.from_pylist([{"part": key[0], "dims": key[1], "ids": ids.astype("<i8").tobytes(), "matrix": packed(flat.reshape(len(ids), key[1]).T)}], schema=schema)

        for batch in batches:
            part, dims, ids = (batch[c].to_numpy(zero_copy_only=False) for c in ("part", "dims", "vec_id"))
            flat, ends = batch["v"].flatten().to_numpy(zero_copy_only=False), np.cumsum(dims.astype(np.int64))
            order = np.lexsort((dims, part))
            cuts = np.flatnonzero((np.diff(part[order]) != 0) | (np.diff(dims[order]) != 0)) + 1
            for rows in np.split(order, cuts):
                if not len(rows):
                    continue
                key = (int(part[rows[0]]), int(dims[rows[0]]))
                for i in range(0, len(rows), size):
                    some = rows[i : i + size]
                    at = (ends[some] - key[1])[:, None] + np.arange(key[1])
                    held.setdefault(key, []).append((ids[some], flat[at.ravel()]))
                    if sum(len(x[0]) for x in held[key]) >= size:
                        yield flush(key)
        for key in list(held):
            yield flush(key)

    return rows.select("part", "vec_id", "dims", "v").mapInArrow(run, "part long, dims int, ids binary, matrix binary")


def score(a: np.ndarray, b: np.ndarray) -> int:
    return sum(int(x) * int(y) for x, y in zip(a.tolist(), b.tolist(), strict=True))


class Best:
    """The best k of each query of a block, over the candidate blocks met so far. q is dims x n."""

    def __init__(self, q: np.ndarray, q_ids: np.ndarray, k: int, step: int = STEP):
        self.q, self.q_ids, self.k, self.step = q, q_ids, k, step
        self.left = [np.sqrt((q[a:] ** 2).sum(axis=0)) for a in range(0, len(q), step)] + [np.zeros(q.shape[1])]
        self.top: list[list[tuple[int, int]]] = [[] for _ in q_ids]  # (-score, vec_id), ascending

    def meet(self, c: np.ndarray, c_ids: np.ndarray) -> None:
        dims, n = c.shape
        steps = range(0, dims, self.step)
        exact = np.abs(self.q).max(initial=0) * np.abs(c).max(initial=0) * dims < EXACT  # no sum is rounded
        left = [np.sqrt((c[a:] ** 2).sum(axis=0)) for a in steps] + [np.zeros(n)]
        for at in range(0, len(self.q_ids), HELD):
            first = self.q[: self.step, at : at + HELD].T @ c[: self.step]
            for j in range(at, min(at + HELD, len(self.q_ids))):
                self._one(j, first[j - at], c, c_ids, left, exact)

    def _one(self, j: int, part: np.ndarray, c: np.ndarray, c_ids: np.ndarray, left: list, exact: bool) -> None:
        k, top, dims = self.k, self.top[j], len(c)
        alive = np.flatnonzero(c_ids != self.q_ids[j])
        part = part[alive]
        rounding = 0.0 if exact else dims * 2.0**-50 * self.left[0][j]
        known = None
        if len(top) >= k:
            known = float(-top[k - 1][0])
            known -= abs(known) * 1e-15  # a score beyond 2**53 is rounded here
        for i, a in enumerate(range(0, dims, self.step)):
            if i:
                part = part + self.q[a : a + self.step, j] @ c[a : a + self.step, alive]
            last = a + self.step >= dims
            slack = 0.0 if last and exact else self.left[i + 1][j] * left[i + 1][alive] * (1 + 1e-9) + rounding * left[0][alive] + 1
            least = known
            if len(alive) > k:
                low = part - slack
                least = np.partition(low, len(low) - k)[len(low) - k]
                least = least if known is None else max(least, known)
            if least is not None:
                keep = part + slack >= least
                alive, part = alive[keep], part[keep]
        if exact:
            some = zip((-part).astype(np.int64).tolist(), c_ids[alive].tolist(), strict=True)
        else:
            some = [(-score(self.q[:, j], c[:, x]), int(c_ids[x])) for x in alive.tolist()]
        self.top[j] = sorted([*top, *some])[:k]

    def hits(self) -> Iterator[tuple[int, int, int]]:
        for query, top in zip(self.q_ids.tolist(), self.top, strict=True):
            for minus, vec in top:
                if not -(2**63) <= -minus < 2**63:
                    raise OverflowError(f"the score of vectors {query} and {vec} passes a long")
                yield query, vec, -minus


def ways_of(rows: int, size: int) -> int:
    return max(8, -(-rows // size))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = SCALE) -> DataFrame:
    """query_id, rank from 1, vec_id and score: the k best of ``vectors`` for each row of ``queries``."""
    asked = quantised(queries, scale).dropDuplicates(["vec_id", "dims", "v"])
    n = -(-asked.count() // QUERIES) or 1  # query blocks; only this count and the next come to the driver
    ways = ways_of(vectors.count(), WAY)
    cell = ["part", "way", "dims"]
    q = blocks(asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(n))).repartition(n, "part"), QUERIES)
    q = q.withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1)))).withColumn("asks", F.lit(True))
    c = blocks(quantised(vectors, scale).withColumn("part", F.lit(0).cast("long")), BLOCK)
    c = c.withColumn("way", F.pmod(F.xxhash64("ids"), F.lit(ways)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))).withColumn("asks", F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        here, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            for best in held:
                hits = list(best.hits())
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*hits, strict=True) if hits else ([], [], []))], schema=schema)
            held.clear()

        for batch in batches:
            for i in range(len(batch)):
                row = {x: batch[x][i].as_py() for x in batch.schema.names}
                if here != (place := tuple(row[x] for x in cell)):
                    yield from done()
                    here = place
                ids = np.frombuffer(row["ids"], "<i8")
                if row["asks"]:
                    held.append(Best(unpacked(row["matrix"], row["dims"], len(ids)), ids, k))
                elif held:
                    block = unpacked(row["matrix"], row["dims"], len(ids))
                    for best in held:
                        best.meet(block, ids)
        yield from done()

    # a cell's queries come before its candidates
    dealt = q.unionByName(c).repartition(*cell).sortWithinPartitions(*cell, F.desc("asks"))
    found = dealt.mapInArrow(run, HITS)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
