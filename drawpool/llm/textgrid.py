"""Words, n-grams and their 64-bit hashes for whole blocks of texts in numpy.

Words are runs of bytes of a class; all separators are ASCII, so the UTF-8
bytes can be scanned directly.  A word's hash is a polynomial over its bytes
(from prefix sums modulo 2**64), an n-gram's one over its words' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_P, _Q, _R = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0x2545F4914F6CDD1D))
#: Bytes of text handled at once; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.ones(256, bool)
    for lo, hi in ranges:
        out[lo:hi + 1] = False
    return out


#: Word classes: bytes outside the separators.
ALNUM = _class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
NONSPACE = _class((0x20, 0x20), (0x09, 0x0D))
LINE = _class((0x0A, 0x0A))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(p: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i modulo 2**64 for i < n."""
    have = _POWERS.get(int(p))
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inv = np.uint64(pow(int(p), -1, 1 << 64))
        with np.errstate(over="ignore"):
            pair = []
            for x in (p, inv):
                a = np.full(size, x, np.uint64)
                a[0] = 1
                pair.append(np.cumprod(a))
        have = _POWERS[int(p)] = tuple(pair)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the result."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, p: np.uint64, seg: int = 1 << 18) -> np.ndarray:
    """Polynomial hashes of values[start:end]; starts ascend."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(starts, base + seg)))
        top = int(ends[lo:hi].max())
        up, down = powers(p, top - base + 1)
        sums = np.zeros(top - base + 1, np.uint64)
        np.cumsum((values[base:top].astype(np.uint64) + np.uint64(1)) * up[:top - base], out=sums[1:])
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = (sums[e] - sums[s]) * down[s]
        lo = hi
    return mix(out)


class Grid:
    """The words of a block of texts.

    data    folded bytes; starts, ends: byte span of each word
    bounds  words of document i are bounds[i]:bounds[i+1]
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, cls: np.ndarray, lower: bool):
        self.offsets = offsets = offsets.astype(np.int64) - int(offsets[0])
        self.data = data = LOWER[data] if lower else data
        inside = cls[data] if len(data) else np.zeros(0, bool)
        before = np.empty_like(inside)
        after = np.empty_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        first, last = offsets[:-1], offsets[1:] - 1
        full = last >= first
        before[first[full]] = False
        after[last[full]] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.n_docs = len(offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(self.n_docs), self.counts)

    def hashes(self) -> np.ndarray:
        return _spans(self.data, self.starts, self.ends, _P)

    def left(self) -> np.ndarray:
        """Words from each word to the end of its document."""
        return np.repeat(self.bounds[1:], self.counts) - np.arange(len(self.starts))


def ngrams(words: np.ndarray, left: np.ndarray, n: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which n words begin inside a document, and their hashes.
    ``second`` gives another hash function."""
    at = np.flatnonzero(left >= n)
    return at, _spans(mix(words + _R) if second else words, at, at + n, _R if second else _Q)


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string array; null counts as empty."""
    import pyarrow.compute as pc

    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets


def blocks(texts: pa.Array, cls: np.ndarray, lower: bool, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Grid]]:
    """(first, end, grid) for runs of whole texts of about ``size`` bytes."""
    data, offsets = buffers(texts)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        hi = min(hi, n)
        part = offsets[lo:hi + 1]
        yield lo, hi, Grid(data[part[0]:part[-1]], part, cls, lower)
        lo = hi
