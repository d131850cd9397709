"""Recompression of word sequences: runs and pairs of symbols get names, round by round (NumPy).

A round first names every run of equal neighbouring symbols, then every pair of
a *left* symbol followed by a *right* one; a bit of a symbol's name says which
of the two it is in that round. A name is a 64-bit hash of what it stands for
(run: name and count; pair: both names), so all tasks give equal content the
same name, without a table to agree on.

Beside its words ``start .. end`` a symbol keeps its support ``lo .. hi``: the
words that decide that the symbol stands there. Where two texts agree on the
support of a symbol, both have the symbol. A support that reaches beyond its
text (``lo`` before the first, ``hi`` after the last word) lies in no window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .textbytes import mix

_RUN, _PAIR, _LEFT = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


@dataclass
class Level:
    """Symbols of a round in text order; ``lo`` and ``hi`` never decrease."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def words_level(h: np.ndarray) -> Level:
    at = np.arange(len(h))
    return Level(h, at, at + 1, at, at + 1)


def _runs(x: Level, h: np.ndarray, text: np.ndarray) -> Level:
    n = len(x.name)
    equal = (x.name[1:] == x.name[:-1]) & (text[x.start[1:]] == text[x.start[:-1]])
    a = np.flatnonzero(np.r_[True, ~equal])            # first and last symbol of every run
    b = np.r_[a[1:], n] - 1
    start, end, lo, hi = x.start[a], x.end[b], x.lo[a], x.hi[b]
    name = x.name[a]
    long = np.flatnonzero(b > a)
    name[long] = mix(name[long] * _RUN + (b[long] - a[long]).astype(np.uint64))
    # The symbol after it is another one: seen from one word if that differs from the symbol's first, else from its support.
    inside = text[start[1:]] == text[start[:-1]]
    nxt = np.where(h[start[1:]] != h[x.start[b[:-1]]], end[:-1] + 1, np.maximum(end[:-1] + 1, x.hi[b[:-1] + 1]))
    hi[:-1] = np.maximum(hi[:-1], np.where(inside, nxt, end[:-1] + 1))
    hi[-1] = end[-1] + 1
    prev = np.where(h[start[1:] - 1] != h[x.end[a[1:]] - 1], start[1:] - 1, np.minimum(start[1:] - 1, x.lo[a[1:] - 1]))
    lo[1:] = np.minimum(lo[1:], np.where(inside, prev, start[1:] - 1))
    lo[0] = start[0] - 1
    return Level(name, start, end, lo, hi)


def _pairs(x: Level, text: np.ndarray, turn: int) -> Level:
    n = len(x.name)
    side = np.array([turn + 1], dtype=np.uint64) * _LEFT
    left = mix(x.name ^ side) >> np.uint64(63) != 0
    inside = text[x.start[1:]] == text[x.start[:-1]]
    joined = np.flatnonzero(left[:-1] & ~left[1:] & inside)
    lo, hi, name, end = x.lo.copy(), x.hi.copy(), x.name.copy(), x.end.copy()
    # an unpaired symbol rests on its neighbour being of the same side, or on the end of the text
    beyond = np.where(inside, x.hi[1:], x.end[:-1] + 1)
    hi[:-1] = np.where(left[:-1], np.maximum(hi[:-1], beyond), hi[:-1])
    before = np.where(inside, x.lo[:-1], x.start[1:] - 1)
    lo[1:] = np.where(~left[1:], np.minimum(lo[1:], before), lo[1:])
    if left[-1]:
        hi[-1] = x.end[-1] + 1
    if not left[0]:
        lo[0] = x.start[0] - 1
    name[joined] = mix(x.name[joined] * _PAIR + x.name[joined + 1])
    end[joined] = x.end[joined + 1]
    lo[joined] = np.minimum(x.lo[joined], x.lo[joined + 1])
    hi[joined] = np.maximum(x.hi[joined], x.hi[joined + 1])
    stay = np.ones(n, dtype=bool)
    stay[joined + 1] = False
    return Level(name[stay], x.start[stay], end[stay], lo[stay], hi[stay])


def rounds(h: np.ndarray, text: np.ndarray, n: int) -> list[Level]:
    """The words and the symbols after each of ``n`` rounds; ``text`` is the text of each word."""
    out = [words_level(h)]
    for turn in range(n if len(h) else 0):
        out.append(_pairs(_runs(out[-1], h, text), text, turn))
    return out


def anchors(levels: list[Level], starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(level, symbol) that stands for each window: of the highest level with a symbol whose support lies in the
    window, the symbol with the least name, the first of equal ones. It depends on the window's words alone."""
    level = np.zeros(len(starts), dtype=np.int64)
    symbol = np.zeros(len(starts), dtype=np.int64)
    todo = np.arange(len(starts))
    for k in range(len(levels) - 1, -1, -1):
        if not len(todo):
            break
        x = levels[k]
        first = np.searchsorted(x.lo, starts[todo], side="left")
        last = np.searchsorted(x.hi, starts[todo] + window, side="right") - 1
        some = last >= first
        at, first, last = todo[some], first[some], last[some]
        todo = todo[~some]
        if not len(at):
            continue
        least = [np.arange(len(x.name))]                 # least name among 2^i symbols from each on
        width = np.frexp(last - first + 1)[1] - 1
        for i in range(int(width.max())):
            t = least[-1]
            u, v = t[:-(1 << i)], t[1 << i:]
            least.append(np.where(x.name[v] < x.name[u], v, u))
        pick = np.empty(len(at), dtype=np.int64)
        for i in np.unique(width).tolist():
            sel = np.flatnonzero(width == i)
            u, v = least[i][first[sel]], least[i][last[sel] - (1 << i) + 1]
            pick[sel] = np.where(x.name[v] < x.name[u], v, u)
        level[at], symbol[at] = k, pick
    return level, symbol
