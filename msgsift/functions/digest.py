"""md5 of many short keys at once: the draws of :mod:`.keys` for whole arrays of places.

A key is a prefix and a place number, ``b"1:0:17:3:" + b"42"``. Keys that fit one
md5 block (55 bytes) go through the 64 steps of RFC 1321 together, one NumPy
operation per step part for all keys of a slice; longer ones are digested one by one.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np

SLICE = 1 << 14      # keys whose words stay in the cache together
_K = [np.uint32(int(abs(math.sin(i + 1)) * 2 ** 32)) for i in range(64)]
_TURN = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_WORD = [[(m * i + c) % 16 for i in range(16)] for m, c in ((1, 0), (5, 1), (3, 5), (7, 0))]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _one_block(words: dict[int, np.ndarray], n: int) -> list[np.ndarray]:
    """The first three digest words of ``n`` padded blocks; ``words`` holds those that are not zero."""
    a, b, c, d = (np.full(n, x) for x in _START)
    t = np.empty(n, dtype=np.uint32)
    for i in range(64):
        kind, turn, g = i >> 4, _TURN[i >> 4][i & 3], _WORD[i >> 4][i & 15]
        if kind == 0:
            np.bitwise_xor(c, d, out=t)
            t &= b
            t ^= d
        elif kind == 1:
            np.bitwise_xor(b, c, out=t)
            t &= d
            t ^= c
        elif kind == 2:
            np.bitwise_xor(b, c, out=t)
            t ^= d
        else:
            np.invert(d, out=t)
            t |= b
            t ^= c
        a += t
        a += _K[i]
        if g in words:
            a += words[g]
        np.right_shift(a, np.uint32(32 - turn), out=t)
        a <<= np.uint32(turn)
        a |= t
        a += b
        a, b, c, d = d, a, b, c
    return [(x + s).byteswap() for x, s in zip((a, b, c), _START)]


def place_draws(prefixes: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """(3, sum of sizes) 32-bit draws of ``prefix + str(place)``, place = 0 .. size - 1 of every prefix.

    Row k is ``digest_key(md5, k)``.
    """
    total = int(sizes.sum())
    out = np.empty((3, total), dtype=np.uint32)
    if not total:
        return out
    top = int(sizes.max())
    tail = len(str(top - 1)) + 1                                       # digits and the byte that ends the key
    places = np.zeros((top, tail), dtype=np.uint8)
    digits = np.zeros(top, dtype=np.int64)
    for w in range(1, tail):                                            # places of w digits
        x = np.arange(0 if w == 1 else 10 ** (w - 1), min(top, 10 ** w))
        digits[x] = w
        for k in range(w):
            places[x, k] = 48 + x // 10 ** (w - 1 - k) % 10
        places[x, w] = 0x80
    length = np.array([len(p) for p in prefixes], dtype=np.int64)
    short = length + tail + 8 <= 64
    width = -(-int(length[short].max(initial=0) + tail) // 4) * 4
    heads = np.zeros((len(prefixes), width), dtype=np.uint8)
    for r in np.flatnonzero(short).tolist():
        heads[r, :length[r]] = np.frombuffer(prefixes[r], dtype=np.uint8)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    for r in np.flatnonzero(~short).tolist():
        for p in range(int(sizes[r])):
            out[:, begins[r] + p] = np.frombuffer(hashlib.md5(prefixes[r] + str(p).encode()).digest(), dtype=">u4")[:3]
    for lo in range(0, total, SLICE):
        hi = min(total, lo + SLICE)
        first, last = np.searchsorted(ends, [lo, hi - 1], side="right").tolist()
        row = np.repeat(np.arange(first, last + 1),
                        np.minimum(ends[first:last + 1], hi) - np.maximum(begins[first:last + 1], lo))
        at = np.arange(lo, hi)
        if not short[first:last + 1].all():
            row, at = row[short[row]], at[short[row]]
            if not len(row):
                continue
        n, place = len(row), at - begins[row]
        block = heads[row]
        flat, cell = block.ravel(), np.arange(n) * width + length[row]
        for k in range(len(str(int(place.max()))) + 1):
            flat[cell + k] = places[place, k]
        columns = np.ascontiguousarray(block.view("<u4").T)
        words = dict(enumerate(columns))
        words[14] = ((length[row] + digits[place]) * 8).astype(np.uint32)
        got = _one_block(words, n)
        for k in range(3):
            if n == hi - lo:
                out[k, lo:hi] = got[k]
            else:
                out[k, at] = got[k]
    return out
