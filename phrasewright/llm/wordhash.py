"""Words of many texts at once, as 64-bit hashes, computed on Arrow's own byte buffers with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text that are hashed at a time; one longer text is taken alone.
SLICE_BYTES = 1 << 20
#: Bytes of runs that are hashed in one step; a step needs some 40 bytes for each.
BLOCK_BYTES = 256 << 10

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE = U(0x9E3779B97F4A7C15)
_STEP = U(0xD1342543DE82EF95)
_powers = np.ones(1, U)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 2 * len(_powers), 256), _BASE, U)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (splitmix64's finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets into them; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes each."""
    at, n = 0, len(offs) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def hash_runs(raw: np.ndarray, start: np.ndarray, lower: bool = False) -> np.ndarray:
    """A hash of each run of bytes; runs follow each other without gaps, from `start` to the next one. Worked out a block of runs at a time."""
    n = len(start)
    if not n:
        return np.zeros(0, U)
    end = np.append(start[1:], len(raw))
    size, letter = end - start, _BYTE_LOWER if lower else _BYTE
    power, out, a = _power(int(size.max())), np.empty(n, U), 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(end, start[a] + BLOCK_BYTES, "right")))
        low, high = start[a], end[b - 1]
        place = np.arange(high - low) - np.repeat(start[a:b] - low, size[a:b])
        out[a:b] = np.add.reduceat(letter[raw[low:high]] * power[place], start[a:b] - low)
        a = b
    return mix(out + size.astype(U))


class Words:
    """The words of a run of texts: byte starts and ends, the text each is in, and its hash."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, lower: bool = False):
        n = len(offs) - 1
        if len(raw):
            inside = ~_SEPARATOR[raw]
            edge = np.zeros(len(raw) + 1, bool)
            edge[offs] = True
            first = inside & edge[:-1]
            first[1:] |= inside[1:] & ~inside[:-1]
            last = inside & edge[1:]
            last[:-1] |= inside[:-1] & ~inside[1:]
            self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        else:
            inside = np.zeros(0, bool)
            self.start = self.end = np.zeros(0, np.int64)
        self.doc = np.searchsorted(offs, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=n) if n else np.zeros(0, np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.count)))  # of each text's words
        size = self.end - self.start
        self.hash = hash_runs(raw[inside], np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else size, lower)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of each run of k words within one text, and its hash."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, U)
        h = self.hash[: n - k + 1].copy()
        for i in range(1, k):
            h *= _STEP
            h += self.hash[i : n - k + 1 + i]
        at = np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :])
        return at, mix(h[at])


def runs(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES, lower: bool = False) -> Iterator[tuple[int, int, Words, np.ndarray]]:
    """(first row, end row, words, raw bytes) over slices of a batch."""
    raw, offs = buffers(batch.column(batch.schema.get_field_index(column)))
    for a, b in slices(offs, most):
        part = raw[offs[a] : offs[b]]
        yield a, b, Words(part, offs[a : b + 1] - offs[a], lower), part
