"""What a Python worker holds does not grow with the table: small Arrow batches, sums class by class, features in slices."""

import tracemalloc

import numpy as np
import pytest

from msgsift.operators import plug, softmax, tokens
from msgsift.operators.masking import mask_arrays
from msgsift.session import materialize

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture()
def wide(spark):
    old = spark.conf.get(KEY)
    spark.conf.set(KEY, "10000")
    yield
    spark.conf.set(KEY, old)


def _texts(spark):
    rows = [(i, " ".join("w%d" % (i * k % 41) for k in range(i % 60)), i % 3) for i in range(300)]
    return materialize(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, label INT"), "worker-texts")


@pytest.mark.parametrize("step", ["lookup", "ask", "features", "mask", "score", "ranges"])
def test_operators_ask_for_small_batches(spark, wide, step):
    docs = _texts(spark)
    vocab = tokens.vocab_from_texts(docs)
    if step in ("lookup", "ask"):
        tokens.text_ids(docs, vocab, ["doc_id"], max_lookup_rows=1_000_000 if step == "lookup" else 1)
    elif step == "features":
        softmax.features(docs, ["doc_id"])
    elif step == "mask":
        mask_arrays(spark.createDataFrame([(1, [4])], "doc_id BIGINT, ids ARRAY<INT>"), 9, ["doc_id"])
    else:
        enc = spark.createDataFrame([(1, 0, [0, 4, 2], [1, 1, 1])], "doc_id BIGINT, chunk BIGINT, input_ids ARRAY<INT>, attention_mask ARRAY<INT>")
        model = plug.AdditiveModel(spark.createDataFrame([(4, [1.0, 2.0])], "token_id INT, w ARRAY<DOUBLE>"), [0.0, 0.0], 9)
        plug.score_additive(enc, model, 3, max_bytes=plug.MAX_BYTES if step == "score" else 1)
    assert int(spark.conf.get(KEY)) <= 1_000


def test_partial_sums_hold_no_array_of_ids_times_classes():
    rng = np.random.default_rng(1)
    n, c, rows = 400_000, 16, 500
    row, ids, mat = np.sort(rng.integers(0, rows, n)), rng.integers(0, 900, n), rng.random((900, c))
    want = np.zeros((rows, c))
    np.add.at(want, row, mat[ids])
    tracemalloc.start()
    got = plug._sums(row, mat, ids, rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got, want) and peak < 3 * 8 * n
    assert plug._sums(row[:0], mat, ids[:0], 2).tolist() == [[0.0] * c] * 2 and plug._sums(row, mat[:, :0], ids, rows).shape == (rows, 0)


def test_features_in_slices_are_the_same(spark, monkeypatch):
    docs = _texts(spark)
    want = sorted(map(tuple, softmax.features(docs, ["doc_id"], bits=6).collect()))
    monkeypatch.setattr(softmax, "SLICE_TOKENS", 70)
    assert sorted(map(tuple, softmax.features(docs, ["doc_id"], bits=6).collect())) == want and len(want) == 300
