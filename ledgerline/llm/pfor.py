"""Patched frame-of-reference blocks for arrays of unsigned 32-bit numbers.

A block holds 512 numbers (the last is padded with its minimum). The block's minimum is subtracted; the width is the one
at which the packed numbers and the exceptions, which take six bytes each, need the fewest bytes among the widths at
chosen percentiles of the block's bit lengths. Numbers that need more bits keep their low bits in place and stand whole in
the block's exception list. Block starts are an index, so that any block can be read alone.

File: ``MAGIC``, five little-endian uint64 (numbers, blocks, documents, bytes of payload, 0), doc ids int64, ids of each
document int64, minima uint32, exceptions uint16, widths uint8, block starts uint64 (one more than blocks), payload.
"""

from __future__ import annotations

import numpy as np

MAGIC, BLOCK, LANE = b"LPFOR\x00\x00\x01", 512, 64
#: Percentiles of a block's bit lengths that are tried as its width.
PERCENTILES = (50, 75, 90, 95, 100)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(m, 512) uint64 below 2 ** width to (m, 64 * width) uint8; every 64 numbers fill ``width`` words."""
    lanes = values.reshape(-1, LANE)
    words = np.zeros((len(lanes), width), np.uint64)
    for i in range(LANE):
        word, bit = divmod(i * width, 64)
        words[:, word] |= lanes[:, i] << np.uint64(bit)
        if bit + width > 64:
            words[:, word + 1] |= lanes[:, i] >> np.uint64(64 - bit)
    return words.astype("<u8").view(np.uint8).reshape(len(values), -1)


def _unpack(raw: np.ndarray, width: int) -> np.ndarray:
    words = np.ascontiguousarray(raw).view("<u8").reshape(-1, width)
    lanes, mask = np.empty((len(words), LANE), np.uint64), np.uint64((1 << width) - 1)
    for i in range(LANE):
        word, bit = divmod(i * width, 64)
        x = words[:, word] >> np.uint64(bit)
        if bit + width > 64:
            x |= words[:, word + 1] << np.uint64(64 - bit)
        lanes[:, i] = x & mask
    return lanes.reshape(-1, BLOCK)


def encode(values: np.ndarray, doc_ids: np.ndarray, counts: np.ndarray) -> bytes:
    """A file of all numbers, with the documents that they belong to."""
    n = len(values)
    blocks = -(-n // BLOCK)
    grid = np.zeros(blocks * BLOCK, np.uint64)
    grid[:n] = values
    if n % BLOCK:
        grid[n:] = grid[n - n % BLOCK : n].min()
    grid = grid.reshape(blocks, BLOCK)
    minima = grid.min(axis=1)
    grid -= minima[:, None]
    bits = np.frexp(grid.astype(np.float64))[1].astype(np.uint8)  # 0 for 0, else the bit length
    ranked = np.sort(bits, axis=1)
    best, widths = np.full(blocks, np.iinfo(np.int64).max), np.zeros(blocks, np.uint8)
    for p in PERCENTILES:
        at = max(0, -(-BLOCK * p // 100) - 1)
        w = ranked[:, at]
        cost = w.astype(np.int64) * (BLOCK // 8) + 6 * (bits > w[:, None]).sum(axis=1)
        widths, best = np.where(cost < best, w, widths), np.minimum(cost, best)
    over = bits > widths[:, None]
    exceptions = over.sum(axis=1)
    starts = np.concatenate([[0], np.cumsum(widths.astype(np.int64) * (BLOCK // 8) + 6 * exceptions)])
    payload = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(widths[widths > 0]).tolist():
        own = np.flatnonzero(widths == w)
        packed = _pack(grid[own] & np.uint64((1 << w) - 1), w)
        payload[starts[own][:, None] + np.arange(packed.shape[1])] = packed
    rows, places = np.nonzero(over)
    if len(rows):
        nth = np.arange(len(rows)) - (np.cumsum(exceptions) - exceptions)[rows]
        head = starts[rows] + widths[rows].astype(np.int64) * (BLOCK // 8)
        payload[(head + 2 * nth)[:, None] + np.arange(2)] = places.astype("<u2").view(np.uint8).reshape(-1, 2)
        payload[(head + 2 * exceptions[rows] + 4 * nth)[:, None] + np.arange(4)] = grid[rows, places].astype("<u4").view(np.uint8).reshape(-1, 4)
    head = np.array([n, blocks, len(doc_ids), len(payload), 0], "<u8")
    parts = (head, doc_ids.astype("<i8"), counts.astype("<i8"), minima.astype("<u4"), exceptions.astype("<u2"), widths, starts.astype("<u8"), payload)
    return MAGIC + b"".join(p.tobytes() for p in parts)


class Reader:
    """Documents and numbers of a file's bytes; ``blocks`` decodes any run of blocks through the index."""

    def __init__(self, data: bytes) -> None:
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        self.n, blocks, docs, size, _ = np.frombuffer(data, "<u8", 5, len(MAGIC)).tolist()
        at = len(MAGIC) + 40
        out = []
        for kind, count in (("<i8", docs), ("<i8", docs), ("<u4", blocks), ("<u2", blocks), ("u1", blocks), ("<u8", blocks + 1), ("u1", size)):
            out.append(np.frombuffer(data, kind, count, at))
            at += out[-1].nbytes
        self.doc_ids, self.counts, self.minima, self.exceptions, self.widths, self.starts, self.payload = out
        self.starts = self.starts.astype(np.int64)

    def blocks(self, first: int = 0, stop: int | None = None) -> np.ndarray:
        """The numbers of blocks first ... stop - 1, uint32."""
        stop = len(self.minima) if stop is None else stop
        grid = np.zeros((stop - first, BLOCK), np.uint64)
        widths, starts, exceptions = self.widths[first:stop], self.starts[first:stop], self.exceptions[first:stop].astype(np.int64)
        for w in np.unique(widths[widths > 0]).tolist():
            own = np.flatnonzero(widths == w)
            grid[own] = _unpack(self.payload[starts[own][:, None] + np.arange(w * (BLOCK // 8))], w)
        rows = np.repeat(np.arange(stop - first), exceptions)
        if len(rows):
            nth = np.arange(len(rows)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
            head = starts[rows] + widths[rows].astype(np.int64) * (BLOCK // 8)
            places = self.payload[(head + 2 * nth)[:, None] + np.arange(2)].view("<u2")[:, 0]
            grid[rows, places] = self.payload[(head + 2 * exceptions[rows] + 4 * nth)[:, None] + np.arange(4)].view("<u4")[:, 0]
        return (grid + self.minima[first:stop].astype(np.uint64)[:, None]).astype(np.uint32).reshape(-1)

    def read(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Numbers start ... stop - 1, from the blocks that hold them only."""
        stop = self.n if stop is None else stop
        if stop <= start:
            return np.empty(0, np.uint32)
        first = start // BLOCK
        return self.blocks(first, -(-stop // BLOCK))[start - first * BLOCK : stop - first * BLOCK]
