"""The softmax fit against a dense one, and its defined cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from msgsift.operators import softmax

from .test_plans import _exchanges

SCHEMA = "doc_id BIGINT, text STRING, label INT, bucket STRING"


def _rows(n=90, seed=2):
    rng = random.Random(seed)
    vocab = {k: ["%s%d" % ("abc"[k], i) for i in range(30)] for k in range(3)}
    rows = [(i, " ".join(rng.choice(vocab[i % 3] if rng.random() < 0.4 else sum(vocab.values(), []))
                         for _ in range(rng.randrange(1, 40))), (i % 3) * 5, "x") for i in range(n)]
    return rows + [(n, "", 0, "x"), (n + 1, None, 5, "x"), (3, rows[3][1], 0, "x"), (None, "A0 a0 É", 10, "x"), (n + 2, "--- !!", 10, "x")]


def _dense(rows, bits, steps, rate, reg):
    import re
    labels = sorted({r[2] for r in rows})
    x = np.zeros((len(rows), 1 << bits))
    for i, r in enumerate(rows):
        for t in re.findall(r"[^\W_]+", (r[1] or "").lower()):
            x[i, softmax._bucket(t, bits)] += 1
    x = np.log1p(x)
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
    y = np.array([labels.index(r[2]) for r in rows])
    b = np.log(np.bincount(y) / len(y))
    w = np.zeros((1 << bits, len(labels)))
    for _ in range(steps):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        w, b = w - rate * (x.T @ p / len(y) + reg * w), b - rate * p.mean(axis=0)
    return labels, w, b


def test_fit_equals_the_dense_one(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    model = softmax.fit(df, bits=6, steps=5, rate=3.0, reg=0.01)
    labels, w, b = _dense(rows, 6, 5, 3.0, 0.01)
    assert model.labels == labels
    assert np.allclose(model.weights, w, atol=1e-10) and np.allclose(model.bias, b, atol=1e-10)
    got = softmax.predict(model, df, ["doc_id", "label"]).collect()
    assert len(got) == len(rows)
    right = sum(r["label"] == r["pred_label"] for r in got)
    assert right > 0.7 * len(rows) and all(0 < r["p_top"] <= 1 for r in got)
    none = next(r for r in got if r["doc_id"] == len(rows) - 5 + 0)
    assert math.isclose(none["p_top"], float(np.exp(b).max() / np.exp(b).sum()), rel_tol=1e-9)      # the empty text: the bias alone


def test_matrix_takes_fewer_bits_when_it_would_not_fit(spark):
    df = spark.createDataFrame(_rows(30), SCHEMA)
    model = softmax.fit(df, bits=16, steps=1, max_bytes=8 * 3 * 40)
    assert model.bits == 5 and model.weights.shape == (32, 3)


def test_nothing_of_vocabulary_size_is_shuffled(spark):
    from msgsift.session import materialize
    df = spark.createDataFrame(_rows(), SCHEMA)
    model = softmax.fit(df, bits=4, steps=1)
    feats = materialize(softmax.features(df, ["label"], bits=4), "softmax-test")
    ex, text = _exchanges(softmax._gradient(feats, model, 3))
    assert len(ex) == 1 and "bucket" in ex[0][1] and "idx" not in ex[0][1], text
    assert softmax._gradient(feats, model, 3).count() <= 17


def test_one_class_and_no_rows(spark):
    df = spark.createDataFrame(_rows(12), SCHEMA)
    one = softmax.predict(softmax.fit(df.withColumn("label", F.lit(4)), bits=4, steps=2), df, ["doc_id"]).collect()
    assert {r["pred_label"] for r in one} == {4} and all(r["p_top"] == pytest.approx(1.0) for r in one)
    empty = softmax.fit(df.limit(0), bits=4)
    assert empty.labels == [] and {r["pred_label"] for r in softmax.predict(empty, df, ["doc_id"]).collect()} == {None}
    assert softmax.predict(empty, df.limit(0), ["doc_id"]).collect() == []
