"""Patched frame of reference: a binary format for unsigned 32-bit ids.

A file image holds, little-endian:

* header: magic ``PFR1``, number of ids, number of blocks, number of exceptions (4 x u32);
* index: for each block the word at which its packed bits start (u32), its minimum (u32), its
  width in bits (u8) and its number of exceptions (u8);
* the packed words: ``BLOCK`` values less the block's minimum, the low ``width`` bits of each,
  in ``BLOCK / 32`` interleaved lanes of 32 values;
* the exceptions: position in the block (u8 each), then high bits (u32 each), block by block.

The width is that of the value at ``percentile`` of the block; larger values are exceptions.
The last block is padded with its minimum.
"""

from __future__ import annotations

import numpy as np

BLOCK, LANES = 128, 4
MAGIC = int.from_bytes(b"PFR1", "little")
INDEX = np.dtype([("start", "<u4"), ("low", "<u4"), ("width", "u1"), ("exceptions", "u1")])


def _widths(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)  # bits of x; 0 for 0


def encode(ids: np.ndarray, percentile: float = 0.9) -> bytes:
    ids = np.ascontiguousarray(ids, "<u4")
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    v = np.empty(blocks * BLOCK, "<u4")
    v[:n] = ids
    if n < len(v):
        v[n:] = ids[(blocks - 1) * BLOCK :].min()
    v = v.reshape(blocks, BLOCK)
    index = np.zeros(blocks, INDEX)
    if blocks:
        index["low"] = v.min(axis=1)
        v = v - index["low"][:, None]
        index["width"] = _widths(np.partition(v, int(percentile * (BLOCK - 1)), axis=1)[:, int(percentile * (BLOCK - 1))])
    width = index["width"].astype(np.int64)
    high = np.where(width[:, None] < 32, v >> np.minimum(width, 31)[:, None].astype(np.uint32), 0).astype("<u4") if blocks else v
    at, pos = np.nonzero(high)
    index["exceptions"] = np.bincount(at, minlength=blocks)
    words = width * LANES
    index["start"] = np.cumsum(words) - words
    packed = np.zeros(int(words.sum()), "<u4")
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        low = v[rows].reshape(-1, BLOCK // LANES, LANES) & np.uint32((1 << w) - 1)
        out = np.zeros((len(rows), w, LANES), np.uint32)
        for i in range(BLOCK // LANES):
            word, bit = divmod(i * w, 32)
            out[:, word] |= low[:, i] << np.uint32(bit)
            if bit + w > 32:
                out[:, word + 1] |= low[:, i] >> np.uint32(32 - bit)
        packed[(index["start"][rows].astype(np.int64)[:, None] + np.arange(w * LANES)).ravel()] = out.ravel()
    return np.array([MAGIC, n, blocks, len(at)], "<u4").tobytes() + index.tobytes() + packed.tobytes() + pos.astype("u1").tobytes() + high[at, pos].astype("<u4").tobytes()


def decode(data: bytes) -> np.ndarray:
    magic, n, blocks, patches = np.frombuffer(data, "<u4", 4).tolist()
    if magic != MAGIC:
        raise ValueError("not a patched frame-of-reference file")
    index = np.frombuffer(data, INDEX, blocks, 16)
    at = 16 + index.nbytes
    width = index["width"].astype(np.int64)
    packed = np.frombuffer(data, "<u4", int(width.sum()) * LANES, at)
    at += packed.nbytes
    pos = np.frombuffer(data, "u1", patches, at)
    high = np.frombuffer(data, "<u4", patches, at + patches)
    v = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        words = packed[index["start"][rows].astype(np.int64)[:, None] + np.arange(w * LANES)].reshape(-1, w, LANES)
        out = np.empty((len(rows), BLOCK // LANES, LANES), np.uint32)
        mask = np.uint32((1 << w) - 1)
        for i in range(BLOCK // LANES):
            word, bit = divmod(i * w, 32)
            x = words[:, word] >> np.uint32(bit)
            if bit + w > 32:
                x = x | (words[:, word + 1] << np.uint32(32 - bit))
            out[:, i] = x & mask
        v[rows] = out.reshape(-1, BLOCK)
    rows = np.repeat(np.arange(blocks), index["exceptions"])
    v[rows, pos] |= high << width[rows].astype(np.uint32)
    return (v + index["low"][:, None]).ravel()[:n]
