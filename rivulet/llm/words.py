"""Words of Arrow text columns as numpy arrays.

A block is a run of rows whose UTF-8 bytes are handled at once; its size bounds the memory of a task.
Words get 64-bit hashes (polynomial over a random byte table, then mixed; where 64 bits are too few, another table gives 64 more); runs of words get hashes from
prefix sums, so any window or range costs O(1).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_SEGMENT = 1 << 18
_U = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words [^\x20\x09-\x0D]+
SPACED = np.ones(256, bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (texts are lower-cased first)
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_BYTES, _OTHER_BYTES = (np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1) for seed in (20240501, 20240502))


class _Powers:
    """Powers of an odd number modulo 2**64, and of its inverse."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.concatenate(([_U(1)], np.full(size - 1, x, _U)))) for x in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_byte_powers, _word_powers = _Powers(0x9E3779B97F4A7C15), _Powers(0xD1342543DE82EF95)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of runs of whole texts with about limit bytes; a longer text is a run of its own."""
    data, at = buffers(column)
    row, n = 0, len(at) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, stop - row, data[at[row] : at[stop]], at[row : stop + 1] - at[row]
        row = stop


class Words:
    """start, end (bytes), hash and doc of each word of a block; first and count of each document's words."""

    def __init__(self, data: np.ndarray, at: np.ndarray, table: np.ndarray = SPACED, lower: bool = False):
        self.data = data = LOWER[data] if lower else data
        self.docs = len(at) - 1
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = table[data]
        before, after = inside[:-2].copy(), inside[2:].copy()
        inside = inside[1:-1]
        edges = at[1:-1]
        before[edges[edges < len(data)]] = False
        after[edges[edges > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, at[:-1])
        self.count = np.diff(np.append(self.first, len(self.start)))
        self.doc = np.repeat(np.arange(self.docs), self.count)
        self.hash = self._hashes(_BYTES)
        self._totals: dict[bool, np.ndarray] = {}

    def _hashes(self, table: np.ndarray) -> np.ndarray:
        out, data = np.empty(len(self.start), _U), self.data
        cuts = np.unique(np.concatenate(([0], np.searchsorted(self.start, np.arange(_SEGMENT, len(data), _SEGMENT)), [len(self.start)])))
        for a, b in zip(cuts[:-1], cuts[1:]):
            lo, hi = self.start[a], self.end[b - 1]
            up, down = _byte_powers.get(int(hi - lo) + 1)
            total = np.concatenate(([_U(0)], np.cumsum(table[data[lo:hi]] * up[:-1])))
            out[a:b] = (total[self.end[a:b] - lo] - total[self.start[a:b] - lo]) * down[self.start[a:b] - lo]
        return mix(out + (self.end - self.start).astype(_U))

    def ranges(self, start: np.ndarray, end: np.ndarray, other: bool = False) -> np.ndarray:
        """Hashes of the word sequences [start, end); other: by another table of bytes, so that both together have 128 bits."""
        up, down = _word_powers.get(len(self.hash) + 1)
        if other not in self._totals:
            own = self._hashes(_OTHER_BYTES) if other else self.hash
            self._totals[other] = np.concatenate(([_U(0)], np.cumsum(own * up[:-1])))
        total = self._totals[other]
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(_U) * _U(0x9E3779B97F4A7C15))

    def windows(self, n: int) -> np.ndarray:
        """Starts of all runs of n words of one document."""
        keep = self.count >= n
        rest = (self.count[keep] - n + 1).astype(np.int64)
        return np.repeat(self.first[keep], rest) + ragged(rest)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0 .. length - 1 for each length, one after the other."""
    lengths = np.asarray(lengths, np.int64)
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def per_doc_sum(docs: int, doc: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weight, docs).astype(np.int64)


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any [start, end)."""
    steps = np.bincount(starts, minlength=n + 1).astype(np.int64) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(steps)[:n] > 0


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys are there twice or more."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
    return out


def in_doc(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that are equal within a document only."""
    return mix(h + doc.astype(_U) * _U(0xA24BAED4963EE407))


def sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of flags over [at[i], at[i + 1])."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[at[1:]] - total[at[:-1]]
