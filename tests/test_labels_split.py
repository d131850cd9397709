import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from msgsift.operators.labels import decode, encode, label_map, label_table, width_check
from msgsift.operators.split import random_split, stratified_split


def _rows(counts):
    rows, i = [], 0
    for intent, n in counts.items():
        for _ in range(n):
            rows.append((i, f"text {i}", intent))
            i += 1
    return rows


def _df(spark, rows):
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING, intent STRING")


def test_label_map_ties_by_intent(spark):
    df = _df(spark, _rows({"b": 2, "a": 2, "c": 3}))
    m = {r["intent"]: (r["corresponding_label"], r["freq_rank"]) for r in label_map(df).collect()}
    assert m == {"a": (0, 2), "b": (1, 3), "c": (2, 1)}


def test_encode_decode_roundtrip_and_missing(spark):
    df = _df(spark, _rows({"x": 2, "y": 1}))
    t = label_table(df)
    enc = encode(df, t)
    back = decode(enc.drop("intent"), t)
    assert sorted(r["intent"] for r in back.collect()) == ["x", "x", "y"]
    bad = spark.createDataFrame([(7,)], "label INT")
    with pytest.raises(Exception):
        decode(bad, t).collect()
    assert decode(bad, t, on_missing="unknown").first()["intent"] == "<unknown:7>"
    chk = {(r["label"], r["problem"]) for r in width_check(bad, t).collect()}
    assert chk == {(7, "no_intent"), (0, "never_scored"), (1, "never_scored")}


def test_quotas_5_4_2(spark):
    df = _df(spark, _rows({"a": 5, "b": 4, "c": 2}))
    s = stratified_split(df)
    got = {(r["intent"], r["part"]): r["count"] for r in s.groupBy("intent", "part").count().collect()}
    assert got == {("a", "train"): 4, ("a", "test"): 1, ("b", "train"): 3, ("b", "test"): 1,
                   ("c", "train"): 1, ("c", "test"): 1}


def test_singleton(spark):
    df = _df(spark, _rows({"a": 5, "b": 1}))
    with pytest.raises(ValueError):
        stratified_split(df)
    s = stratified_split(df, on_singleton="train")
    assert s.where("intent = 'b'").first()["part"] == "train"


def test_split_independent_of_order_and_partitioning(spark):
    rows = _rows({"a": 40, "b": 25, "c": 9})
    a = {r["doc_id"]: r["part"] for r in stratified_split(_df(spark, rows)).collect()}
    b = {r["doc_id"]: r["part"] for r in stratified_split(_df(spark, rows[::-1]).repartition(7)).collect()}
    assert a == b
    c = {r["doc_id"]: r["part"] for r in random_split(_df(spark, rows)).collect()}
    d = {r["doc_id"]: r["part"] for r in random_split(_df(spark, rows[::-1]).repartition(7)).collect()}
    assert c == d and sum(v == "test" for v in c.values()) == 15   # ceil(0.2 * 74)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(min_value=2, max_value=30), min_size=1, max_size=5))
def test_split_is_exact_partition(spark, sizes):
    counts = {f"c{i}": n for i, n in enumerate(sizes)}
    df = _df(spark, _rows(counts))
    n = sum(sizes)
    import math
    n_test = math.ceil(0.2 * n)
    if n_test < len(sizes) or n - n_test < len(sizes):   # a side with fewer rows than classes
        with pytest.raises(ValueError, match="fewer than"):
            stratified_split(df, bits=4)
        return
    s = stratified_split(df, bits=4).collect()
    assert len(s) == n and len({r["doc_id"] for r in s}) == n
    assert sum(r["part"] == "test" for r in s) == n_test
    for c, k in counts.items():
        tr = sum(1 for r in s if r["intent"] == c and r["part"] == "train")
        exact = k * (n - n_test) / n
        assert math.floor(exact) <= tr <= math.floor(exact) + 1


def test_split_membership_equals_brute_force_rank(spark):
    """Train = the first quota rows of each class in (md5 key, id) order (brute force in Python)."""
    import hashlib
    import math
    counts = {"a": 300, "b": 41, "c": 7, "d": 2}
    rows = _rows(counts)
    got = {r["doc_id"]: r["part"] for r in stratified_split(_df(spark, rows), bits=3).collect()}
    got16 = {r["doc_id"]: r["part"] for r in stratified_split(_df(spark, rows)).collect()}

    def key(i):
        return int(hashlib.md5(f"42:{i}".encode()).hexdigest()[:8], 16)

    n = sum(counts.values())
    n_train = n - math.ceil(0.2 * n)
    base = {c: k * n_train // n for c, k in counts.items()}
    rem = sorted(counts, key=lambda c: (-(counts[c] * n_train % n), c))
    quota = {c: base[c] + (1 if c in rem[:n_train - sum(base.values())] else 0) for c in counts}
    want = {}
    for c in counts:
        ids = sorted((key(i), i) for i, _, cc in rows if cc == c)
        for r, (_, i) in enumerate(ids):
            want[i] = "train" if r < quota[c] else "test"
    assert got == want == got16
    rnd = {r["doc_id"]: r["part"] for r in random_split(_df(spark, rows), seed=0).collect()}
    order = sorted((int(hashlib.md5(f"0:{i}".encode()).hexdigest()[:8], 16), i) for i, _, _ in rows)
    assert rnd == {i: ("train" if r < n_train else "test") for r, (_, i) in enumerate(order)}


def test_split_side_smaller_than_class_count_fails(spark):
    # 6 rows in 3 classes: ceil(0.2 * 6) = 2 test rows < 3 classes
    df = _df(spark, _rows({"a": 2, "b": 2, "c": 2}))
    with pytest.raises(ValueError, match="test part"):
        stratified_split(df)
    # 15 rows: 3 test rows, 12 train rows: fine
    s = stratified_split(_df(spark, _rows({"a": 5, "b": 5, "c": 5})))
    assert s.where("part = 'test'").count() == 3


def test_three_way_split_quotas(spark):
    import math
    from msgsift.operators.split import three_way_split
    counts = {"a": 50, "b": 30, "c": 20}
    s = three_way_split(_df(spark, _rows(counts))).collect()
    parts = {}
    for r in s:
        parts.setdefault(r["part"], []).append(r)
    n_test = math.ceil(0.2 * 100)
    n_val = math.ceil(0.2 * (100 - n_test))
    assert len(s) == 100 and len({r["doc_id"] for r in s}) == 100
    assert len(parts["test"]) == n_test and len(parts["validation"]) == n_val
    assert len(parts["train"]) == 100 - n_test - n_val
    for c, k in counts.items():
        assert sum(r["intent"] == c for r in parts["test"]) == k // 5   # exact shares here
