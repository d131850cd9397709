"""Words of whole texts as they are written (no lower-casing), and texts rebuilt from some of their words."""

from __future__ import annotations

import hashlib

import numpy as np

from .textbytes import Words

# words [^\x20\x09-\x0D]+, letters unchanged
PLAIN_WORDS = np.arange(256, dtype=np.uint8)
PLAIN_WORDS[[0x20, *range(0x09, 0x0E)]] = 32


def kept_bytes(w: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): per text its kept words, each followed by one space; ``keep`` by word."""
    sizes = np.where(keep, w.ends - w.starts + 1, 0)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    some = np.flatnonzero(keep)
    at = np.arange(upto[-1]) + np.repeat(w.starts[some] - upto[some], sizes[some])
    out = np.append(w.buf, np.uint8(32))[at]
    out[upto[some + 1] - 1] = 32
    return out, upto[w.first]


def kept_texts(w: Words, keep: np.ndarray):
    """Yield per text its kept words joined by one space, as bytes."""
    data, at = kept_bytes(w, keep)
    data = data.tobytes()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield data[a:b - 1] if b > a else b""


def kept_digests(w: Words, keep: np.ndarray) -> list[str]:
    """Lower-case hex sha256 of each of :func:`kept_texts`."""
    return [hashlib.sha256(t).hexdigest() for t in kept_texts(w, keep)]


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in some range ``starts .. ends``."""
    change = np.bincount(starts, minlength=n + 1)[:n + 1] - np.bincount(ends, minlength=n + 1)[:n + 1]
    return np.cumsum(change)[:n] > 0
