"""Brute-force checks for the model paths with no SQL oracle or a composite one:
background-prior NB (M3), batch-model scoring (M8), the ML pipeline (M2) and
JSON answers (M7)."""

import json
import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from msgsift.operators.answers import answer_json, answer_long, answer_map, parse_json
from msgsift.operators.naive_bayes import long_form, predict, score, train_nb
from msgsift.operators.tokens import encode

TRAIN = [(1, "good happy fine", 0, "pos"), (2, "happy good day", 0, "pos"), (3, "sad bad awful", 1, "neg"),
         (4, "bad sad night", 1, "neg"), (5, "good bad", 1, "neg")]
CORPUS = [(100, "good good day night"), (101, "awful weather today"), (102, "happy happy happy")]


def _train(spark):
    return spark.createDataFrame(TRAIN, "doc_id BIGINT, text STRING, label INT, intent STRING")


def test_background_nb_equals_dense_formula(spark):
    mu = 3.0
    bg = spark.createDataFrame(CORPUS, "doc_id BIGINT, text STRING")
    model = train_nb(_train(spark), min_df=1, max_vocab=100, background=bg, mu=mu)
    test = spark.createDataFrame([(10, "good good sad today"), (11, "zzz")], "doc_id BIGINT, text STRING")
    got = {(r["doc_id"], r["intent"]): r["score"] for r in long_form(model, score(model, test)).collect()}
    # brute force: vocabulary = every token of training + corpus texts (min_df 1)
    vocab = sorted({t for _, x, _, _ in TRAIN for t in x.split()} | {t for _, x in CORPUS for t in x.split()})
    bg_counts = Counter(t for _, x in CORPUS for t in x.split())
    n_bg = sum(bg_counts.values())
    p_bg = {t: (bg_counts[t] + 1) / (n_bg + len(vocab)) for t in vocab}
    counts = {c: Counter(t for _, x, _, i in TRAIN if i == c for t in x.split()) for c in ("pos", "neg")}
    prior = {"pos": math.log(2 / 5), "neg": math.log(3 / 5)}
    for c in ("pos", "neg"):
        n_c = sum(counts[c].values())
        want = prior[c] + sum(math.log((counts[c][t] + mu * p_bg[t]) / (n_c + mu))
                              for t in "good good sad today".split())
        assert abs(got[(10, c)] - want) < 1e-9
        assert abs(got[(11, c)] - prior[c]) < 1e-12


def test_batch_model_equals_nb_per_chunk(spark):
    from msgsift.operators.plug import nb_batch_model, score_batches
    model = train_nb(_train(spark), min_df=1, max_vocab=100)
    long_text = " ".join(["good", "sad", "night", "qqq"] * 70)   # 280 tokens: two chunks of 248 + 32
    test = spark.createDataFrame([(10, long_text), (11, "happy day"), (12, "")], "doc_id BIGINT, text STRING")
    enc = encode(test, model.vocabulary(), pad_to="max_len")
    out = {(r["doc_id"], r["chunk"]): r for r in score_batches(enc, nb_batch_model(model), width=250,
                                                                batch_size=2).collect()}
    assert set(out) == {(10, 0), (10, 1), (11, 0), (12, 0)}
    # brute force: the NB score of the text made of each chunk's tokens
    toks = long_text.split()
    pieces = [(1, " ".join(toks[:248])), (2, " ".join(toks[248:])), (3, "happy day"), (4, "")]
    ref = {r["doc_id"]: r["scores"] for r in score(model, spark.createDataFrame(
        pieces, "doc_id BIGINT, text STRING")).collect()}
    for key, rid in (((10, 0), 1), ((10, 1), 2), ((11, 0), 3), ((12, 0), 4)):
        assert np.allclose(out[key]["scores"], ref[rid], rtol=0, atol=1e-9)
        assert out[key]["pred_index"] == int(np.argmax(ref[rid]))


def test_lr_pipeline_learns_separable_classes(spark):
    from msgsift.operators.ml import fit_lr, predict_lr
    rows = [(i, ("good happy fine day " if i % 2 else "sad bad awful night ") + f"w{i}", i % 2) for i in range(40)]
    train = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, label INT")
    model = fit_lr(train, max_vocab=100, min_df=2)
    test = spark.createDataFrame([(1, "happy good"), (2, "awful sad")], "doc_id BIGINT, text STRING")
    pred = {r["doc_id"]: r for r in predict_lr(model, test).collect()}
    assert pred[1]["pred_label"] == 1 and pred[2]["pred_label"] == 0
    assert all(0.5 < r["p_top"] <= 1.0 for r in pred.values())


def test_json_answers_parse_back_to_the_map(spark):
    model = train_nb(_train(spark), min_df=1, max_vocab=100)
    msgs = spark.createDataFrame([(1, "good day"), (2, ""), (3, "sad " * 400)], "doc_id BIGINT, text STRING")
    amap = answer_map(model, score(model, msgs))
    js = answer_json(amap)
    back = sorted(tuple(r) for r in parse_json(js).collect())
    assert back == sorted(tuple(r) for r in answer_long(amap).collect()) and len(back) == 6
    for r in js.collect():   # a list holding one map, keys in label-id order
        doc = json.loads(r["json"])
        assert isinstance(doc, list) and len(doc) == 1 and list(doc[0]) == ["pos", "neg"]


def test_predictions_independent_of_partitioning(spark):
    model = train_nb(_train(spark), min_df=1, max_vocab=100)
    texts = [(i, " ".join(["good", "sad", "bad", "day"][(i * k) % 4] for k in range(i % 7 + 1))) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id BIGINT, text STRING")
    a = sorted(tuple(r) for r in predict(model, score(model, df)).select("doc_id", "pred_label").collect())
    b = sorted(tuple(r) for r in predict(model, score(model, df.orderBy(F.desc("doc_id")).repartition(7)))
               .select("doc_id", "pred_label").collect())
    assert a == b and len(a) == 60


def test_in_row_truth_probability_equals_long_form_join(spark):
    from msgsift.operators import metrics as met
    from msgsift.operators.naive_bayes import truth_probability
    model = train_nb(_train(spark), min_df=1, max_vocab=100)
    # label 7 is a class the model never saw: floor, not dropped
    test = spark.createDataFrame([(10, "good good sad", 0), (11, "bad night", 1), (12, "happy", 7)],
                                 "doc_id BIGINT, text STRING, label INT")
    a = {r["doc_id"]: r["p_true"] for r in truth_probability(
        model, predict(model, score(model, test, keep=["label"]))).collect()}
    b = {r["doc_id"]: r["p_true"] for r in met.truth_probability(
        long_form(model, score(model, test)), test.select("doc_id", "label")).collect()}
    assert a.keys() == b.keys() == {10, 11, 12}
    assert all(abs(a[k] - b[k]) < 1e-15 for k in a) and a[12] == 1e-6


def test_json_number_text_follows_the_oracle_rule(spark):
    """The oracle SQL prints k/10^6 as the JVM does; guard the rule on the running JDK."""
    def rule(k):
        if k == 0:
            return "0.0"
        if k >= 1000:
            i, f = divmod(k, 10**6)
            return f"{i}.{f'{f:06d}'.rstrip('0') or '0'}"
        d = str(k).rstrip("0")
        return f"{d[0]}.{d[1:] or '0'}E{len(str(k)) - 7}"
    ks = list(range(0, 3000)) + list(range(3000, 10**6 + 1, 997)) + [10**6]
    df = spark.createDataFrame([(k,) for k in ks], "k BIGINT")
    out = df.select("k", F.to_json(F.array(F.create_map(F.lit("x"), F.round(F.col("k") / F.lit(1e6), 6))))
                    .alias("j")).collect()
    assert all(r["j"] == '[{"x":' + rule(r["k"]) + '}]' for r in out)


def test_batch_lookup_and_join_scoring_agree(spark, monkeypatch):
    import msgsift.operators.naive_bayes as nb
    model = train_nb(_train(spark), min_df=1, max_vocab=100)
    texts = [(1, "good good sad", 0), (2, "", 1), (3, None, 0), (4, "zzz qqq", 1),
             (5, " ".join(["bad", "night", "happy"] * 40), 1)]
    df = spark.createDataFrame(texts, "doc_id BIGINT, text STRING, label INT")
    monkeypatch.setattr(nb, "SCORE_SLICE_TOKENS", 7)            # many slices, texts across slice edges
    a = {r["doc_id"]: (r["label"], r["scores"]) for r in score(model, df, keep=["label"]).collect()}
    b = {r["doc_id"]: (r["label"], r["scores"]) for r in score(model, df, keep=["label"], lookup_bytes=0).collect()}
    assert a.keys() == b.keys() == {1, 2, 3, 4, 5}
    for k in a:
        assert a[k][0] == b[k][0] and np.allclose(a[k][1], b[k][1], rtol=0, atol=1e-9)
    assert np.allclose(a[2][1], model.log_prior) and np.allclose(a[3][1], model.log_prior)


def test_message_scores_from_chunks_equal_whole_text_scores(spark):
    from msgsift.operators.plug import nb_batch_model, score_batches, score_messages
    from msgsift.operators.tokens import encode
    train = spark.createDataFrame([(1, "a b c a", 0, "x"), (2, "c d d e", 1, "y"), (3, "b e", 1, "y")],
                                  "doc_id BIGINT, text STRING, label INT, intent STRING")
    model = train_nb(train)
    test = spark.createDataFrame([(1, " ".join("abcdez"[i % 6] for i in range(700))), (2, ""), (3, "d zz")],
                                 "doc_id BIGINT, text STRING")
    enc = encode(test, model.vocabulary(), pad_to="max_len")
    assert enc.count() > 3
    got = {r["doc_id"]: r for r in score_messages(score_batches(enc, nb_batch_model(model), 250),
                                                  model.log_prior).collect()}
    want = {r["doc_id"]: r for r in predict(model, score(model, test)).collect()}
    assert set(got) == set(want) == {1, 2, 3}
    for k in want:
        assert all(abs(x - y) < 1e-6 for x, y in zip(got[k]["scores"], want[k]["scores"]))
        assert abs(got[k]["p_top"] - want[k]["p_top"]) < 1e-6
