"""Paths for vocabularies and models that are too big to ship: the same rows as the shipped ones, and what they shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from msgsift.operators.naive_bayes import score, train_nb
from msgsift.operators.plug import nb_additive, score_additive, score_ranges
from msgsift.operators.ranking import range_places, sorted_rank
from msgsift.operators.tokens import ask_ids, encode, vocab_from_texts
from msgsift.session import materialize

from .test_plans import _exchanges


def _texts(spark, n=120, seed=4):
    rng = random.Random(seed)
    words = ["w%d" % int(rng.paretovariate(0.6)) for _ in range(4000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 600))), i % 3, "abc"[i % 3]) for i in range(n)]
    rows += [(n, None, 0, "a"), (n + 1, "", 1, "b"), (n + 2, "zzz unknown", 2, "c"), (7, "w1 w1 w2", 1, "b"), (None, "w3 w1", 0, "a")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, label INT, intent STRING").repartition(3, "text")
    return materialize(df, "scale-texts")


@pytest.fixture(scope="module")
def model(spark):
    return train_nb(_texts(spark).where("doc_id < 80"))


def _scores(df):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], str(r[2]))
    return sorted(((r["doc_id"], r["chunk"] if "chunk" in r else 0, [round(x, 6) for x in r["scores"]]) for r in
                   (x.asDict() for x in df.collect())), key=key)


def test_model_in_ranges_scores_as_the_whole_one(spark, model):
    enc = materialize(encode(_texts(spark), model.vocabulary(), pad_to="max_len"), "scale-encoded")
    whole = score_additive(enc, nb_additive(model), 250)
    want = _scores(whole)
    assert len(want) > 125
    for options in ({"max_bytes": 1}, {"max_bytes": 1, "range_rows": 7, "cell_ids": 50}, {"max_bytes": 400, "range_rows": 5}):
        parts = score_additive(enc, nb_additive(model), 250, **options)
        assert _scores(parts) == want
        assert {(r["doc_id"], r["chunk"]): r["pred_index"] for r in parts.collect()} == \
            {(r["doc_id"], r["chunk"]): r["pred_index"] for r in whole.collect()}
    assert score_ranges(enc.limit(0), nb_additive(model), max_bytes=1).collect() == []


def test_model_ranges_shuffle_no_single_occurrences(spark, model):
    enc = materialize(encode(_texts(spark), model.vocabulary(), pad_to="max_len"), "scale-encoded")
    ex, text = _exchanges(score_additive(enc, nb_additive(model), 250, max_bytes=1))
    assert ex and all("input_ids" not in cols and "token" not in cols for _, cols in ex), text
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text


def test_asked_scores_equal_shipped_ones(spark, model):
    docs = _texts(spark)
    want = _scores(score(model, docs))
    for head in (0, 600, 10_000):
        assert _scores(score(model, docs, lookup_bytes=head, broadcast_bytes=0)) == want


def test_asked_ids_equal_shipped_ones_and_shuffle_distinct_tokens(spark):
    docs = _texts(spark)
    vocab = vocab_from_texts(docs.where("doc_id < 60"), min_df=1)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted(map(tuple, encode(docs, vocab).collect()), key=key)
    for bound in (0, 3):
        assert sorted(map(tuple, encode(docs, vocab, max_lookup_rows=bound).collect()), key=key) == want
    ex, text = _exchanges(ask_ids(docs, vocab, ["doc_id"], head_rows=3))
    assert ex, text
    for args, cols in ex:      # words of pages, answers, pages and the dictionary: never texts or token rows of documents
        assert "text" not in cols and not ("doc_id" in cols and "token" in cols), (args, cols)


def test_ranges_of_equal_frequency_and_head_stay_bounded(spark):
    n, per = 1_000_000, 50_000
    stats = spark.range(n).select(F.format_string("aa%07d", (F.col("id") * 7919) % n).alias("token"), F.lit(1).alias("tf"))
    placed = range_places(stats, [F.desc("tf"), F.asc("token")], rows_per_range=per)
    sizes = [r["count"] for r in placed.groupBy("_range").count().collect()]
    assert sum(sizes) == n and max(sizes) <= 2 * per and len(sizes) >= n / (2 * per)
    ranked = sorted_rank(stats, [F.desc("tf"), F.asc("token")], rows_per_range=per)
    wrong = ranked.where(F.col("rank") != F.substring("token", 3, 7).cast("bigint") + 1)
    assert ranked.count() == n and wrong.isEmpty()


def test_ranks_after_a_second_cut(spark):
    """A sample that misjudges the ranges (here: one range asked for) leads to a second cut with the same ranks."""
    from msgsift.operators import ranking
    rows = [((i * 37) % 1000, f"t{i % 50}") for i in range(1000)]
    df = spark.createDataFrame(rows, "k BIGINT, t STRING").repartition(4)
    real = ranking.math.ceil
    calls = []

    class Low:      # the first cut gets one range only
        @staticmethod
        def ceil(x):
            calls.append(x)
            return 1 if len(calls) == 1 else real(x)
    ranking.math, saved = Low, ranking.math
    try:
        placed = range_places(df, [F.asc("k")], rows_per_range=100)
        sizes = [r["count"] for r in placed.groupBy("_range").count().collect()]
        calls.clear()
        got = sorted_rank(df, [F.asc("k")], rows_per_range=100).collect()
    finally:
        ranking.math = saved
    assert max(sizes) <= 250 and sum(sizes) == 1000
    assert all(r["rank"] == r["k"] + 1 for r in got)


def test_ranks_of_an_empty_table(spark):
    assert sorted_rank(spark.createDataFrame([], "k BIGINT"), [F.asc("k")]).collect() == []
