"""Periodic run detection: Lyndon-root candidates extended by suffix-tree LCE queries.

A run is a maximal stretch of words with smallest period q and a length of at
least ``max(least, times * q)``. Spark deals the texts out; each Arrow batch is
worked on in slices of about 1 MiB of text:

1. Only words that can be in a run stay: with ``times`` of 4 every word of a
   run lies in three consecutive words that occur three times in its stretch
   (a run of length L >= 4q has L - 2 >= 3q such triples of q kinds, one of
   length >= 6 with q = 1 has four equal ones). Stretches of words that pass
   are tried again until none falls away. This drops no run.
2. The stretches of a slice, each closed by an end mark of its own, get
   Ukkonen suffix trees, forwards and reversed; Euler tours give lowest common
   ancestors, and with them longest common extensions, in constant time.
3. For the word order and its reverse, the longest Lyndon word at each place
   ends before the next smaller suffix. It is the root of a candidate: its
   length is the period, extended to the right and to the left by one query
   each. Every run has such a root in one of the two orders.

Words are compared by their bytes. A text is worked on by one task; its memory
grows with the text and, for the trees, with its stretches that repeat.

Defined cases
    null, empty or wordless text: no words, no runs, empty collapsed text.
    null id: passed on. repeated rows: each row gets its own, equal result. empty table: no rows.
    very long texts: worked on whole. ties of the longest run: smallest start, then smallest period.
    further columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .suffixtree import SuffixTree
from .textbytes import Words, batch_words, mix, shingle_hashes
from .wordstream import PLAIN_WORDS, covered, kept_digests, kept_texts

TIMES = 4     # a run is at least so many times its period
LEAST = 6     # and at least so many words long

_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUNS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def repetitive(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, stretch): the words that can be in a run, and the stretch of consecutive ones each is in."""
    at = np.arange(len(h))
    while True:
        new = np.r_[True, (np.diff(at) > 1) | (text[at[1:]] != text[at[:-1]])][:len(at)]
        stretch = np.cumsum(new)
        t = shingle_hashes(h[at], 3)
        whole = np.flatnonzero(stretch[:len(t)] == stretch[2:]) if len(t) else np.zeros(0, dtype=np.int64)
        key = mix(t[whole] + stretch[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        first = whole[count[back] >= 3]
        stay = np.zeros(len(at), dtype=bool)
        for k in range(3):
            stay[first + k] = True
        if stay.all():
            return at, stretch
        at = at[stay]


def _next_smaller(rank: list[int]) -> list[int]:
    """Per place the next place with a smaller rank (its own length if there is none)."""
    n = len(rank)
    out, stack = [n] * n, []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return out


def runs_of(s: np.ndarray, ends: np.ndarray, times: int = TIMES, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of the sequences in ``s``.

    Symbols of words are ``len(ends)`` and more; the place ``ends[k]`` holds
    the end mark ``k`` of sequence k.
    """
    n, marks = len(s), len(ends)
    size = int(s.max()) + 1
    up = np.arange(size)
    down = np.where(up < marks, up, size - 1 - up + marks)      # end marks come first in both orders
    ahead = SuffixTree(s)
    back = SuffixTree(np.r_[s[:-1][::-1], s[-1]])               # the last end mark closes the reversal too
    back.prepare(*back.tour(up))
    found = []
    order, met = ahead.tour(up)
    ahead.prepare(order, met)
    for rank in (ahead.rank, _rank(ahead.tour(down)[0])):
        i = np.arange(n)
        j = np.array(_next_smaller(rank.tolist()), dtype=np.int64)
        some = (j < n) & (s >= marks)
        i, j = i[some], j[some]
        p = j - i
        right = ahead.lce(i, j)
        ok = right + 2 * p > np.maximum(least, times * p)      # at its first root a run has less than a period to the left
        i, j, p, right = i[ok], j[ok], p[ok], right[ok]
        left = np.zeros(len(i), dtype=np.int64)
        inner = i > 0
        left[inner] = back.lce(n - 1 - i[inner], n - 1 - j[inner])     # words i-1 and j-1, read backwards
        length = left + p + right
        ok = length >= np.maximum(least, times * p)
        found.append(np.stack([i[ok] - left[ok], length[ok], p[ok]]))
    return tuple(np.unique(np.concatenate(found, axis=1), axis=1))


def _rank(order: np.ndarray) -> np.ndarray:
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return rank


def slice_runs(w: Words, times: int = TIMES, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of all texts of a slice; start counts the slice's words."""
    none = (np.zeros(0, dtype=np.int64),) * 3
    at, stretch = repetitive(w.hashes(), w.text_of())
    if not len(at):
        return none
    # words by their bytes; stretch k is followed by its end mark k
    names: dict[bytes, int] = {}
    data = w.buf.tobytes()
    marks = int(stretch[-1])
    ids = [names.setdefault(data[a:b], len(names) + marks) for a, b in zip(w.starts[at].tolist(), w.ends[at].tolist())]
    s = np.empty(len(at) + marks, dtype=np.int64)
    place = np.arange(len(at)) + stretch - 1
    s[place] = ids
    last = np.r_[np.flatnonzero(np.diff(stretch)), len(at) - 1]
    ends = place[last] + 1
    s[ends] = np.arange(marks)
    start, length, period = runs_of(s, ends, times, least)
    where = np.full(len(s), -1, dtype=np.int64)
    where[place] = at
    return where[start], length, period


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES, least: int = LEAST,
                  with_text: bool = False) -> DataFrame:
    """doc_id, n_words, runs, collapsed_sha256 (and ``collapsed`` with ``with_text``), one row per row.

    runs: start, length and period of every run, by start, then period.
    collapsed: the words that no run holds after its first period, joined by
    one space.
    """
    if times < 4 or least < 6:
        raise ValueError("runs are found from 4 periods and 6 words on")
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            for w in batch_words(b.column(1), PLAIN_WORDS):
                start, length, period = slice_runs(w, times, least)
                order = np.lexsort((period, start))
                start, length, period = start[order], length[order], period[order]
                keep = ~covered(start + period, start + length, len(w.starts))
                text = np.searchsorted(w.first, start, side="right") - 1
                bounds = np.searchsorted(text, np.arange(w.hi - w.lo + 1)).astype(np.int32)
                runs = pa.StructArray.from_arrays(
                    [pa.array(start - w.first[text]), pa.array(length), pa.array(period)], fields=list(_RUNS_ARROW.value_type))
                out = [b.column(0).slice(w.lo, w.hi - w.lo), pa.array(np.diff(w.first).astype(np.int64)),
                       pa.ListArray.from_arrays(pa.array(bounds), runs), pa.array(kept_digests(w, keep))]
                if with_text:
                    out.append(pa.array([t.decode("utf-8", "replace") for t in kept_texts(w, keep)]))
                yield pa.RecordBatch.from_arrays(out, names=names)

    names = ["doc_id", "n_words", "runs", "collapsed_sha256", *["collapsed"] * with_text]
    id_type = docs.schema[id_col].dataType.simpleString()
    shape = f"doc_id {id_type}, n_words bigint, runs {_RUNS}, collapsed_sha256 string" + ", collapsed string" * with_text
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, shape)


def longest(runs: Column) -> Column:
    """The run of greatest length; of equal ones that with the smallest start, then period (null without a run)."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"),
                                                            (-r["period"]).alias("p"))))
    return F.when(best.isNotNull(), F.struct((-best["s"]).alias("start"), best["length"].alias("length"),
                                             (-best["p"]).alias("period")))


def runs_digest(runs: Column) -> Column:
    """sha256 of ``start,length,period`` and a line feed per run."""
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"),
                                                            r["period"].cast("string")), F.lit("\n")))
    return F.sha2(F.array_join(lines, "").cast("binary"), 256)
