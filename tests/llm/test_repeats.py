"""Substring dedup and periodic runs against brute force on small fixtures."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from msgsift.llm import periodic, substring
from msgsift.llm.recompress import anchors, rounds
from msgsift.llm.suffixtree import SuffixTree

# extra columns named like internal ones
SCHEMA = "doc_id bigint, text string, lang string, th string, spans string, w string, chunk int"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", "y", "z", 1) for i, t in rows], SCHEMA)


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def _sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def _substring_brute(rows, window):
    texts = [_words(t) for _, t in rows]
    seen = Counter(tuple(w[k:k + window]) for w in texts for k in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, texts):
        gone = {x for k in range(len(w) - window + 1) if seen[tuple(w[k:k + window])] > 1 for x in range(k, k + window)}
        out.append((i, len(w), len(gone), _sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out, key=str)


def _substring_rows(seed):
    rng = random.Random(seed)
    vocab = ["w%d" % k for k in range(30)]
    prose = lambda n, v=vocab: [rng.choice(v) for _ in range(n)]
    passages = [prose(rng.choice([5, 9, 12, 40, 90])) for _ in range(12)]
    rows = []
    for i in range(60):
        w = prose(rng.randrange(0, 50), vocab if i % 4 else vocab[:2])
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            w += p[a:a + rng.randrange(1, 80)] + prose(rng.randrange(0, 6))
        if i % 9 == 0:
            w = w[:20] + w[:rng.randrange(1, 20)] * rng.randrange(1, 7) + w
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(w)))
    rows += [(100, None), (101, ""), (102, " \n"), (103, "a " * 200), (104, "a " * 60 + "b"), (105, "A " * 40), (None, "é ü " * 30),
             (106, rows[7][1]), (107, rows[7][1]), (7, rows[7][1]), (108, " ".join(prose(20_000, ["z%d" % k for k in range(9)])))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("window,n_rounds,chunk_bytes,seed", [(8, 3, 16 << 20, 1), (8, 2, 300, 2), (35, 5, 16 << 20, 3), (11, 5, 2000, 4)])
def test_substring_matches_brute_force(spark, window, n_rounds, chunk_bytes, seed):
    rows = _substring_rows(seed)
    got = substring.repeated_spans(_docs(spark, rows).repartition(5), window=window, n_rounds=n_rounds, chunk_bytes=chunk_bytes).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == _substring_brute(rows, window)
    assert all(r.n_removed == sum(s.end - s.start for s in r.spans) for r in got)


def test_substring_text_and_empty_table(spark):
    rows = [(1, "p q " + "a b c d e " * 2), (2, "x a b c d e y"), (3, "nothing else")]
    out = substring.repeated_spans(_docs(spark, rows), window=5, with_text=True)
    assert {r.doc_id: r.kept_text for r in out.collect()} == {1: "p q", 2: "x y", 3: "nothing else"}
    assert substring.repeated_spans(_docs(spark, rows).limit(0)).collect() == []


def test_equal_windows_have_equal_symbols():
    rng = np.random.default_rng(5)
    for _ in range(40):
        core = rng.integers(0, rng.choice([2, 4, 50]), 30)
        texts = [np.r_[rng.integers(0, 4, rng.integers(0, 9)), core, rng.integers(0, 4, rng.integers(0, 9))] for _ in range(2)]
        h = (np.concatenate(texts) + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        text = np.repeat([0, 1], [len(t) for t in texts])
        levels = rounds(h, text, 4)
        for x in levels:
            assert (np.diff(x.lo) >= 0).all() and (np.diff(x.hi) >= 0).all()
        offs = [k for k in range(len(h)) for t in [text[k]] if k + 20 <= (len(texts[0]) if t == 0 else len(h))]
        level, symbol = anchors(levels, np.array(offs), 20)
        seen = {}
        for s, lv, sy in zip(offs, level.tolist(), symbol.tolist()):
            x = levels[lv]
            mine = (lv, int(x.name[sy]), int(x.start[sy]) - s, int(x.lo[sy]) - s, int(x.hi[sy]) - s)
            assert 0 <= mine[3] <= mine[4] <= 20
            assert seen.setdefault(tuple(h[s:s + 20].tolist()), mine) == mine


def _runs_brute(w):
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            seg = w[s:i + q]
            if len(seg) >= max(6, 4 * q) and not any(seg[d:] == seg[:-d] for d in range(1, q)):
                out.append((s, len(seg), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _collapse(w, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def _periodic_rows(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(150):
        w = [rng.choice("abcdeF"[:rng.choice([1, 2, 3, 6])]) for _ in range(rng.randrange(0, 70))]
        for _ in range(rng.randrange(3)):
            if w:
                a, p = rng.randrange(len(w)), rng.randrange(1, 9)
                w[a:a] = (w[a:a + p] * rng.randrange(2, 9))[:rng.randrange(1, 60)]
        rows.append((i, rng.choice([" ", "\n ", "\t"]).join(w)))
    rows += [(200, None), (201, ""), (202, " \t"), (203, "É é " * 40), (None, "x " * 9), (204, "lone"), (205, rows[3][1]), (3, rows[3][1]),
             (206, " ".join("n%d" % (k % 700) for k in range(6_000)))]
    return rows


def test_runs_match_brute_force(spark):
    rows = _periodic_rows(2)
    got = periodic.periodic_runs(_docs(spark, rows), with_text=True).collect()
    want = []
    for i, t in rows:
        w = _words(t)
        runs = _runs_brute(w) if len(w) < 1000 else [(0, 6_000, 700)]
        want.append((i, len(w), runs, _collapse(w, runs)))
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=str) == sorted(want, key=str)
    assert all(r.collapsed_sha256 == _sha(r.collapsed) for r in got)
    assert periodic.periodic_runs(_docs(spark, rows).limit(0)).collect() == []


def test_longest_run_ties_and_digest(spark):
    rows = [(1, "x x x x x x y " + "a a a a a a"), (2, "one two"), (3, "a b " * 4 + "c c c c c c c c")]
    out = periodic.periodic_runs(_docs(spark, rows))
    got = {r.doc_id: r for r in out.select("doc_id", periodic.longest(out["runs"]).alias("best"),
                                           periodic.runs_digest(out["runs"]).alias("sha")).collect()}
    assert tuple(got[1].best) == (0, 6, 1) and got[2].best is None and tuple(got[3].best) == (0, 8, 2)
    assert got[1].sha == _sha("0,6,1\n7,6,1\n") and got[2].sha == _sha("")


def test_planted_repeats_follow_the_rule(spark):
    from msgsift.llm.queries import planted_repeats
    rows = [(i, " ".join("w%d" % k for k in range(i % 41))) for i in range(300)] + [(None, "a b"), (7, None)]
    for r in planted_repeats(_docs(spark, rows)).collect():
        w = _words(dict((i, t) for i, t in rows if (i, t) != (7, None)).get(r.doc_id)) if r.text is not None else []
        h = zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
        assert _words(r.text) == w


def test_extensions_of_a_suffix_tree():
    rng = np.random.default_rng(3)
    s = np.r_[rng.integers(1, 3, 200), 0]
    tree = SuffixTree(s)
    order, met = tree.tour(np.arange(3))
    assert [tuple(s[k:]) for k in order] == sorted(tuple(s[k:]) for k in range(len(s)))
    tree.prepare(order, met)
    i, j = rng.integers(0, 201, 300), rng.integers(0, 201, 300)
    i, j = i[i != j], j[i != j]
    for a, b, n in zip(i.tolist(), j.tolist(), tree.lce(i, j).tolist()):
        m = max(a, b)
        want = next((k for k in range(len(s) - m) if s[a + k] != s[b + k]), len(s) - m)
        assert n == want
