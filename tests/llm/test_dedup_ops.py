"""Exact dedup, near-dedup, decontamination and mixing against brute force on small fixtures."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from msgsift.llm import decontam, exact_dedup, minmax, mixing

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# extra columns named like internal ones
SCHEMA = "doc_id bigint, text string, lang string, source string, h bigint, kept string, _row string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", 1, "x", "y") for i, t in rows], SCHEMA)


def _words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(40))
                    for _ in range(n))


def _fixture(seed=3):
    rng = random.Random(seed)
    rows = []
    for k in range(12):
        base = _words(rng, rng.choice([3, 7, 20, 60, 200]))
        rows.append((len(rows), base))
        for _ in range(rng.randrange(4)):
            w = base.split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = "x%d" % rng.randrange(9)
            rows.append((len(rows), " ".join(w)))
        rows.append((len(rows), base.upper()))
    rows += [(900, None), (901, ""), (902, "É"), (903, "é"), (904, "  \n"), (905, "one two"), (906, "One\ttwo")]
    rows += [(907, _words(rng, 30_000))]
    return rows


@pytest.mark.parametrize("bits", [64, 4])
def test_exact_groups_match_brute_force(spark, bits):
    rows = _fixture() + [(None, "only null id"), (None, "alpha"), (7_000, "alpha")]
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    got = exact_dedup.exact_groups(_docs(spark, rows), bucket_rows=4, hash_bits=bits).collect()
    want = []
    for t, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        want += [(i, best, len(ids), i == best, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    key = lambda r: (r[0] is None, r[0] or 0, r[4])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_exact_repeated_rows_leave_one_and_columns_stay(spark):
    docs = _docs(spark, [(1, "a b"), (1, "a b"), (2, "c"), (2, "C"), (3, "a B"), (4, None), (5, "")])
    out = exact_dedup.drop_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, (r.text or "").lower()) for r in out.collect()) == [(2, "c"), (3, "a b"), (5, "")]
    assert exact_dedup.drop_duplicates(docs.limit(0)).count() == 0


def test_directory_doubles_only_full_buckets():
    counts = {p: (100 if p == 3 else 1) for p in range(16)}
    leaves = exact_dedup.split_buckets(counts, 10, 4)
    assert sum(n for _, _, n in leaves) == sum(counts.values())
    assert (3, 4, 100) in leaves                      # cannot split further: deepest level
    assert all(n <= 10 for p, d, n in leaves if (p, d) != (3, 4))
    covered = sorted(x for p, d, _ in leaves for x in range(p << (4 - d), (p + 1) << (4 - d)))
    assert covered == list(range(16))
    assert len({d for _, d, _ in leaves}) > 1


def test_verdicts_come_through_the_directory(spark, monkeypatch):
    """A directory that loses a bucket, or names two for one slot, gives wrong verdicts."""
    rows = _fixture()
    docs = _docs(spark, rows)
    right = exact_dedup.split_buckets
    assert exact_dedup.exact_groups(docs, bucket_rows=4).count() == len(rows)
    monkeypatch.setattr(exact_dedup, "split_buckets", lambda *a: right(*a)[:-1])
    assert 0 < exact_dedup.exact_groups(docs, bucket_rows=4).count() < len(rows)
    monkeypatch.setattr(exact_dedup, "split_buckets", lambda *a: right(*a) + [(0, 0, 0)])
    assert exact_dedup.exact_groups(docs, bucket_rows=4).count() > len(rows)
    index = exact_dedup.build_index(docs, bucket_rows=4)[2]
    assert index.groupBy("bucket").count().count() > 3


def _shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    n = min(5, len(w))
    return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if n else set()


def _nulls_last(row):
    return [(v is None, v or 0) for v in row]


def _near_brute(rows):
    sets = [(i, _shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    best = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            best[find(a)] = min(best.get(find(a), i), i)
    return sorted(((i, len(s), best.get(find(a))) for a, (i, s) in enumerate(sets)), key=_nulls_last)


@pytest.mark.parametrize("bucket_rows,family_shingles", [(8_192, 2_000_000), (3, 40)])
def test_near_groups_match_brute_force_also_in_blocks(spark, bucket_rows, family_shingles):
    rows = _fixture(5)
    got = minmax.near_groups(_docs(spark, rows), bucket_rows=bucket_rows, family_shingles=family_shingles)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == _near_brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def test_near_chain_hub_and_large_family(spark):
    rng = random.Random(11)
    base = _words(rng, 120).split()
    rows = [(i, " ".join("v%d_%d" % (i, k) if k % 40 == (i * 7) % 40 else w for k, w in enumerate(base))) for i in range(1, 60)]
    rows.append((500, " ".join(base)))               # the hub has the largest id
    got = minmax.near_groups(_docs(spark, rows), bucket_rows=8, family_shingles=500)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == _near_brute(rows)


@pytest.mark.parametrize("bound", [200, 2_000])
def test_near_family_whose_representative_leaves_many_over(spark, bound):
    """Two centres, a chain away from each of them, and members near to neither: most pairs need the second pass."""
    rng = random.Random(23)
    rows = [(900, None), (901, None), (None, "x")]
    for c in range(2):
        text = _words(rng, 90).split()
        rows += [(100 * c + i, " ".join(w + "x" if k % 30 == i % 30 else w for k, w in enumerate(text))) for i in range(25)]
        for i in range(25, 70):                      # each step changes one more word: far ends are not near
            text = [w + f"y{i}" if k == i else w for k, w in enumerate(text)]
            rows.append((100 * c + i, " ".join(text)))
    rows += [rows[5], rows[40], (None, rows[41][1])]     # repeated rows, a null id with a known text
    docs = _docs(spark, rows)
    got = minmax.near_groups(docs, bucket_rows=10, family_shingles=bound)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=_nulls_last) == _near_brute(rows)


def test_large_group_is_dealt_to_slices(spark):
    """Members near to the representative are compared once, in slices; every slice holds part of the group only."""
    rows = spark.createDataFrame([(1, i, i % 5) for i in range(400)], "g bigint, node bigint, kind long")
    groups = spark.createDataFrame([(1, 0, 400, 400)], "g bigint, rep bigint, members bigint, weight bigint")

    def graph(t):
        node = sorted(set(t.column("node").to_pylist()))
        kind = dict(zip(t.column("node").to_pylist(), t.column("kind").to_pylist()))
        assert len(node) < 400
        near = lambda i: [j for j, x in enumerate(node) if j != i and (kind[x] != 4) == (kind[node[i]] != 4)]
        return np.array(node), near, lambda: list(range(len(node)))
    links = minmax.group_links(rows, groups, 200, lambda who: who, graph, "test").collect()
    root = list(range(400))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for r in links:
        assert (r.a % 5 == 4) == (r.b % 5 == 4)
        root[find(r.a)] = find(r.b)
    assert len({find(i) for i in range(400)}) == 2


def test_keep_one_keeps_columns_and_handles_empty(spark):
    rows = [(1, "a b c d e f g"), (2, "A b c d e f g"), (3, "zzz"), (4, None)]
    docs = _docs(spark, rows)
    out = minmax.keep_one(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 3, 4]
    assert minmax.near_groups(docs.limit(0)).count() == 0


def _contamination_brute(rows, items):
    pat = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    out = []
    for i, t in rows:
        w = re.findall(pat, (t or "").translate(LOWER))
        hit, ids = set(), set()
        for item, it in items:
            x = re.findall(pat, (it or "").translate(LOWER))
            n = min(13, len(x))
            wins = {tuple(x[k:k + n]) for k in range(len(x) - n + 1)} if n else set()
            for k in range(len(w) - n + 1) if n else ():
                if tuple(w[k:k + n]) in wins:
                    hit.update(range(k, k + n))
                    ids.add(str(item) if item is not None else "")
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("bits", [24, 7])
def test_contamination_matches_brute_force(spark, bits):
    rng = random.Random(2)
    items = [(k, _words(rng, n)) for k, n in enumerate([13, 40, 12, 5, 3, 1, 60, 14])] + [(50, None), (51, "?!"), (None, "null id item here")]
    items.append((6, items[1][1]))                   # an id used twice, texts shared by two items
    rows = []
    for i in range(40):
        w = _words(rng, rng.choice([0, 4, 30, 300])).split()
        for _ in range(rng.randrange(3)):
            x = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(x) + 1)
            p = rng.randrange(len(w) + 1)
            w[p:p] = x[a:a + rng.randrange(1, 40)]
        rows.append((i, rng.choice([" ", ", ", "\n", "-"]).join(w)))
    rows += [(100, None), (101, ""), (102, items[6][1].upper()), (103, (items[6][1] + " ") * 3), (104, "Null id ITEM here")]
    docs = _docs(spark, rows)
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = decontam.contamination(docs, bench, filter_bits=bits).drop("th").collect()
    assert sorted(map(tuple, got)) == _contamination_brute(rows, items)
    none = decontam.contamination(docs, bench.limit(0)).agg(F.sum("n_hit"), F.count("*")).first()
    assert tuple(none) == (0, len(rows))
    assert decontam.contamination(docs.limit(0), bench).count() == 0


def _check_schedule(weights, slots, frame):
    """Every block in its window and every source less than a block from its exact share, at every slot."""
    shares = list(mixing.shares_of(weights).values())
    blocks = [-(-slots * s.numerator // s.denominator) + 5 for s in shares]
    frame = max(frame, 2 * len(shares))
    plan = [x for f in range(-(-slots // frame)) for x in mixing.schedule_frame(shares, blocks, f * frame, frame)]
    assert [p[2] for p in plan] == list(range(len(plan)))                    # no slot empty, none used twice
    assert all(rel <= slot < dead for _, _, slot, rel, dead in plan)
    done = [0] * len(shares)
    for t, (k, j, *_rest) in enumerate(plan, 1):
        done[k] += 1
        assert j == done[k]
        assert abs(done[k] - shares[k] * t) < 1
        if t % 61 == 0:
            assert all(abs(d - s * t) < 1 for d, s in zip(done, shares))


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1, "c": 1}, {"a": 97, "b": 2, "c": 1}, {"a": 0.5, "b": 0.3, "c": 0.2},
                                     {"x": 3 ** 0.5, "y": 2 ** 0.5, "z": 0.1}, {"only": 2}])
def test_pfair_windows_and_lag(weights):
    _check_schedule(weights, 3_000, 100)


def test_pfair_holds_the_given_weights_over_many_frames_and_sources():
    _check_schedule({k: 0.5 if k == 0 else 0.5 / 99 for k in range(100)}, 20 * 200, 200)
    _check_schedule({k: 0.3 if k == 0 else 0.7 / 999 for k in range(1_000)}, 6_000, 2_000)
    _check_schedule({k: 0.14 if k == 0 else 0.86 / 19 for k in range(20)}, 20 * 250, 250)


def test_boundaries_sum_to_the_slot():
    shares = list(mixing.shares_of({k: (k + 1) ** 0.5 for k in range(30)}).values())
    for t in (0, 1, 7, 4_096, 10 ** 12 + 3):
        a = mixing.placed_before(shares, t)
        assert sum(a) == t and all(abs(n - s * t) < 1 for n, s in zip(a, shares))


def test_mix_keeps_every_row_and_the_shares(spark):
    rows = [(i, "a" if i % 3 else ("b" if i % 2 else None), "t", 9) for i in range(3_000)] + [(7, "b", "t", 9), (7, "b", "t", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, mix_slot int")
    w = {"a": 0.5, "b": 0.3, None: 0.2}
    out = mixing.mix(docs, w, block_rows=8, frame=50, range_rows=100).collect()
    assert Counter((r.doc_id, r.source) for r in out) == Counter((r[0], r[1]) for r in rows)
    assert len({r.mix_pos for r in out}) == len(out)
    slots = {}
    for r in out:
        slots.setdefault(r.mix_slot, set()).add(r.source)
        assert r.mix_release <= r.mix_slot < r.mix_deadline
    assert all(len(s) == 1 for s in slots.values())
    target = [r for r in out if r.mix_on_target]
    n = max(r.mix_slot for r in target) + 1
    for s, share in w.items():
        assert abs(len({r.mix_slot for r in target if r.source == s}) - share * n) < 1
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": 1})
    assert mixing.mix(docs.limit(0)).count() == 0
    zero = mixing.mix(docs, {"a": 1, "b": 1, None: 0}, block_rows=8, frame=50)
    assert zero.where("source is null and mix_slot is null").count() == sum(r[1] is None for r in rows)
