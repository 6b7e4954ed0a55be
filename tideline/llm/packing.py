"""Hierarchical packing: documents into sequences of several context sizes, in tiers.

Each task packs the documents of its own partition, so nothing is shuffled and no key or source
gathers anywhere. A document goes to the shortest tier that holds it whole; one beyond ``LENGTH`` tokens gives whole windows of
the longest tier and a loose rest. Every tier is packed at its own size, longest first: best fit by descending length, and then the longest documents
of shorter tiers that fit into a window's gap, whole. What gap is left is filled exactly by cutting
loose rests, or else a window of a long document; only where a task has neither is a document cut that a tier holds, those of the
emptiest window of the shortest tier first. So all sequences are full but for what a
task is left with at its end, less than one window of the longest tier, which is cut at powers of two. There is no padding.

Step groups hold about as many tokens as ``GROUP`` windows of ``LENGTH`` do: sequences of every tier are dealt evenly to them
in rounds, the costliest (by the sum of squared piece lengths, as attention costs) to the group that has cost least so far.

Null texts are empty and have just the end id. Repeated rows are packed as often as they come; an
empty table gives an empty one. Other columns are not read. sequence_id is unique over the table and
names its task; rerun over the same files in the same splits it is the same.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_of, tidy
from .tokenize import default_path, encoder

LENGTH = 2048
TIERS = (256, 512, 1024, 2048)
#: Windows of the longest tier that a step group has the tokens of.
GROUP = 8
#: Ids held at a time by a task.
HELD = 1 << 20
SCHEMA = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"

Piece = tuple[int, int, int]  # number of the document, start, length


def tiers_of(length: int) -> tuple[int, ...]:
    return (*[t for t in TIERS if t < length], length)


class Loose:
    """Pieces that may be cut."""

    def __init__(self, pieces: list[Piece], windows: list[list[Piece]]):
        self.pieces, self.windows = pieces, windows

    def take(self, n: int) -> list[Piece]:
        """Up to n ids; a window of a long document is broken up where there are no pieces left."""
        out = []
        while n and (self.pieces or self.windows):
            if not self.pieces:
                self.pieces = self.windows.pop()
            doc, start, k = self.pieces.pop()
            out.append((doc, start, min(n, k)))
            if k > n:
                self.pieces.append((doc, start + n, k - n))
            n -= min(n, k)
        return out


def packed_tier(docs: list[tuple[int, int, int]], size: int, shorter: list[tuple[int, int, int]]) -> list[list]:
    """[room, pieces] of each window of a tier, best fit by descending length; then ``shorter`` (ascending) gives
    each gap the longest documents that fit. Documents are (length, number, start)."""
    rooms: list[tuple[int, int]] = []
    bins: list[list] = []
    for n, doc, start in sorted(docs, key=lambda x: (-x[0], x[1], x[2])):
        k = bisect_left(rooms, (n, -1))
        if k < len(rooms):
            room, b = rooms.pop(k)
            bins[b][1].append((doc, start, n))
            bins[b][0] = room - n
            if room > n:
                insort(rooms, (room - n, b))
        else:
            bins.append([size - n, [(doc, start, n)]])
            if size > n:
                insort(rooms, (size - n, len(bins) - 1))
    for one in bins:
        while one[0] and shorter and shorter[0][0] <= one[0]:
            n, doc, start = shorter.pop(bisect_left(shorter, (one[0] + 1, -1, -1)) - 1)
            one[1].append((doc, start, n))
            one[0] -= n
    return bins


def fill(pieces: list[Piece], length: int, sizes: dict[int, int]) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """(tier, pieces) of full sequences, and what is left, under ``length`` ids; every id of the pieces once. ``sizes`` has each document's."""
    tiers = tiers_of(length)
    routed: dict[int, list] = {t: [] for t in tiers}
    windows, rests = [], []
    for doc, start, n in pieces:
        if n == sizes[doc] <= length:
            routed[min(t for t in tiers if t >= n)].append((n, doc, start))
            continue
        while n >= length:
            windows.append([(doc, start, length)])
            start, n = start + length, n - length
        if n:
            rests.append((doc, start, n))
    rests.sort(key=lambda p: (-p[2], p))
    loose, full, gapped = Loose(rests, windows), [], []
    shorter = sorted(x for t in tiers[:-1] for x in routed[t])
    for tier in reversed(tiers):
        here = set(routed[tier])
        if tier != length:
            here &= set(shorter)  # those that longer tiers have not taken
            shorter = [x for x in shorter if x not in here]
        for room, some in packed_tier(list(here), tier, shorter):
            (gapped if room else full).append((tier, room, some))
    full = [(tier, some) for tier, _, some in full]
    # the fullest first; those of the shortest tier and most room are the first to be cut up for the others
    gapped.sort(key=lambda g: (-g[0], g[1], g[2]), reverse=True)
    while gapped:
        tier, room, some = gapped.pop()
        got = loose.take(room)
        while sum(p[2] for p in got) < room and gapped:
            loose.pieces = gapped.pop(0)[2]
            got += loose.take(room - sum(p[2] for p in got))
        if sum(p[2] for p in got) < room:
            loose.pieces += some + got
        else:
            full.append((tier, some + got))
    full += [(length, w) for w in loose.windows]
    while sum(p[2] for p in loose.pieces) >= length:
        loose.windows = []
        full.append((length, loose.take(length)))
    return full, loose.pieces


def taper(last: list[Piece]) -> list[list[Piece]]:
    """What is left at the end, cut at powers of two."""
    loose, out = Loose(list(last)[::-1], []), []
    while loose.pieces:
        n = sum(p[2] for p in loose.pieces)
        out.append(loose.take(1 << (n.bit_length() - 1)))
    return out


def grouped(sequences: list[tuple[int, list[Piece]]], length: int) -> list[tuple[int, int, list[Piece]]]:
    """(step group from 0, tier, pieces): every tier is dealt in rounds of one sequence a group, the costliest to the group that costs least so far."""
    count = max(1, -(-sum(t for t, _ in sequences) // (GROUP * length)))
    spent, out, ranked, turn = [0] * count, [], [], 0
    cost = lambda s: sum(p[2] ** 2 for p in s)
    for tier, some in sorted(sequences, key=lambda s: (-s[0], -cost(s[1]), s[1])):
        if turn == 0:
            ranked = sorted(range(count), key=lambda g: (spent[g], g))
        group, turn = ranked[turn], (turn + 1) % count
        spent[group] += cost(some)
        out.append((group, tier, some))
    return out


def pack(docs: DataFrame, path: str | None = None, end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """Pieces with their ids, sequence, offset, tier and step group."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), end_id.to_bytes(4, "little")
        task = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64())])
        sequences, groups = 0, 0

        def emit(made: list[tuple[int, list[Piece]]], keys: list, parts: list[bytes]) -> Iterator[pa.RecordBatch]:
            nonlocal sequences, groups
            rows: list[tuple] = []
            dealt = grouped(made, length)
            for group, tier, s in dealt:
                offset = 0
                for doc, start, n in s:
                    rows.append((keys[doc], start, parts[doc][4 * start : 4 * (start + n)], len(parts[doc]) // 4, task + sequences, offset, tier, task + groups + group))
                    offset += n
                sequences += 1
            groups += max((g for g, _, _ in dealt), default=-1) + 1
            for i in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[i : i + 4096], strict=True), schema, strict=True)], schema=schema)

        keys: list = []
        parts: list[bytes] = []
        sizes: dict[int, int] = {}
        open_pieces: list[Piece] = []
        held = 0
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                for key, ids in zip(part["doc_id"].to_pylist(), enc.encode(part["text"].to_pylist()), strict=True):
                    n = len(ids) // 4 + 1
                    open_pieces.append((len(parts), 0, n))
                    sizes[len(parts)] = n
                    keys.append(key)
                    parts.append(ids + end)
                    held += n
                if held >= HELD:
                    made, last = fill(open_pieces, length, sizes)
                    yield from emit(made, keys, parts)
                    numbers = sorted({p[0] for p in last})
                    place = {d: k for k, d in enumerate(numbers)}
                    keys, parts = [keys[d] for d in numbers], [parts[d] for d in numbers]
                    sizes = {k: len(p) // 4 for k, p in enumerate(parts)}
                    open_pieces = [(place[d], s, n) for d, s, n in last]
                    held = sum(n for _, _, n in open_pieces)
        if open_pieces:
            made, last = fill(open_pieces, length, sizes)
            yield from emit(made + [(sum(p[2] for p in s), s) for s in taper(last)], keys, parts)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(tidy(run), SCHEMA)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents")))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")
