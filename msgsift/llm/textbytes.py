"""Words of whole texts straight from Arrow string buffers (NumPy, no per-row Python).

Texts are read as UTF-8 bytes. ``A``-``Z`` are lower-cased, separator bytes
become spaces, and a maximal run of other bytes is a word. Every separator of
the two word classes is ASCII, so cutting bytes cuts code points as well.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20      # bytes of text worked on at a time (bounds task memory)
_HASH_SLICE = 1 << 18      # bytes per running sum inside the word hash

_M = (1 << 64) - 1


def _mix_int(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _M
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _M
    return x ^ (x >> 31)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): spreads every input bit over the output."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_table(separators) -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[ord("A"):ord("Z") + 1] += 32
    t[list(separators)] = 32
    return t


# words [^\x20\x09-\x0D]+
SPACE_WORDS = _byte_table([0x20, *range(0x09, 0x0E)])
# words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing: digits, a-z, non-ASCII
ALNUM_WORDS = _byte_table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])

_BYTE_CODE = np.array([_mix_int(i + 1) | 1 for i in range(256)], dtype=np.uint64)
_BASE = 0x9DDFEA08EB382D69
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_HASH_SLICE, 1 << max(0, (n - 1).bit_length()))
    if size not in _powers:
        inv = pow(_BASE, -1, 1 << 64)
        out = []
        for b in (_BASE, inv):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers.clear()
        _powers[size] = (out[0], out[1])
    return _powers[size]


@dataclass
class Words:
    """Words of the texts ``lo .. hi`` of a batch; word ``first[i] .. first[i+1]`` belong to text ``lo + i``."""

    lo: int
    hi: int
    buf: np.ndarray      # lower-cased bytes, separators as spaces
    bounds: np.ndarray   # byte offsets of the texts in buf, length hi - lo + 1
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray    # length hi - lo + 1

    def hashes(self) -> np.ndarray:
        return hash_words(self.buf, self.starts, self.ends)

    def text_of(self) -> np.ndarray:
        """Index (from 0) of each word's text."""
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.first))

    def join(self, a: int, b: int) -> str:
        """Words ``a .. b`` joined by one space."""
        return b" ".join(bytes(self.buf[s:e]) for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist())
                         ).decode("utf-8", "replace")


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range: a polynomial over random byte codes, then a finaliser."""
    out = np.empty(len(starts), dtype=np.uint64)
    i, n = 0, len(starts)
    while i < n:
        base = int(starts[i])
        j = max(int(np.searchsorted(ends, base + _HASH_SLICE, side="right")), i + 1)
        size = int(ends[j - 1]) - base
        p, q = _power_tables(size)
        cs = np.empty(size + 1, dtype=np.uint64)
        cs[0] = 0
        np.cumsum(_BYTE_CODE[buf[base:base + size]] * p[:size], out=cs[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (cs[e] - cs[s]) * q[s]
        i = j
    return mix(out)


def string_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    large = pa.types.is_large_string(col.type)
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64 if large else np.int32)
    offs = offs[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    return data, offs


def batch_words(col, table: np.ndarray, slice_bytes: int = SLICE_BYTES):
    """Yield :class:`Words` for consecutive slices of a string column (at least one text each)."""
    if len(col) == 0:
        return
    data, offs = string_buffers(col)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(int(np.searchsorted(offs, offs[i] + slice_bytes, side="right")) - 1, i + 1)
        yield find_words(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i], table, i, j)
        i = j
    pa.default_memory_pool().release_unused()      # workers live on between stages: hand freed batches back


def find_words(data: np.ndarray, bounds: np.ndarray, table: np.ndarray, lo: int = 0, hi: int | None = None) -> Words:
    buf = table[data]
    inside = np.zeros(len(buf) + 2, dtype=bool)
    np.not_equal(buf, 32, out=inside[1:-1])
    begin = inside[1:-1] & ~inside[:-2]
    stop = inside[1:-1] & ~inside[2:]
    cut = bounds[1:-1]
    cut = cut[(cut > 0) & (cut < len(buf))]
    begin[cut] = inside[1:-1][cut]          # a text never continues the word of the text before
    stop[cut - 1] = inside[1:-1][cut - 1]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(stop) + 1
    return Words(lo, len(bounds) - 1 if hi is None else hi, buf, bounds, starts, ends,
                 np.searchsorted(starts, bounds, side="left"))


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive words: entry i covers words i .. i+size-1."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = h[:n].copy()
    for k in range(1, size):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += h[k:k + n]
    out += np.uint64(size)
    return mix(out)
