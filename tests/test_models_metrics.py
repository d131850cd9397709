import math

from pyspark.sql import functions as F

from msgsift.operators import metrics as met
from msgsift.operators.naive_bayes import long_form, predict, score, train_nb

TRAIN = [(1, "good happy fine", 0, "pos"), (2, "happy good day", 0, "pos"), (3, "sad bad awful", 1, "neg"),
         (4, "bad sad night", 1, "neg"), (5, "good bad", 1, "neg")]


def _train(spark):
    return spark.createDataFrame(TRAIN, "doc_id BIGINT, text STRING, label INT, intent STRING")


def test_nb_matches_hand_computation(spark):
    model = train_nb(_train(spark), min_df=1, max_vocab=100)
    test = spark.createDataFrame([(10, "good good sad"), (11, "zzz ###")], "doc_id BIGINT, text STRING")
    lf = {(r["doc_id"], r["intent"]): r for r in long_form(model, score(model, test)).collect()}
    vocab = {t for _, txt, _, _ in TRAIN for t in txt.split()}
    v = len(vocab)
    n_tok = {"pos": 6, "neg": 8}
    count = {("pos", "good"): 2, ("neg", "good"): 1, ("neg", "sad"): 2}
    prior = {"pos": math.log(2 / 5), "neg": math.log(3 / 5)}
    for c in ("pos", "neg"):
        want = prior[c] + sum(math.log((count.get((c, t), 0) + 1) / (n_tok[c] + v)) for t in ["good", "good", "sad"])
        assert abs(lf[(10, c)]["score"] - want) < 1e-9
        assert abs(lf[(11, c)]["score"] - prior[c]) < 1e-12   # no known token: prior only
    assert len(lf) == 4


def test_nb_agrees_with_spark_ml(spark):
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import CountVectorizer, RegexTokenizer
    from msgsift.config import TOKEN_SPLIT
    train = _train(spark)
    model = train_nb(train, min_df=1, max_vocab=100)
    test = spark.createDataFrame([(10, "good good sad"), (12, "bad night day")], "doc_id BIGINT, text STRING")
    ours = {r["doc_id"]: r["pred_label"] for r in predict(model, score(model, test)).collect()}
    tok = RegexTokenizer(inputCol="text", outputCol="t", pattern=TOKEN_SPLIT)
    cv = CountVectorizer(inputCol="t", outputCol="features").fit(tok.transform(train))
    nb = NaiveBayes(smoothing=1.0, labelCol="label_d").fit(
        cv.transform(tok.transform(train)).withColumn("label_d", F.col("label").cast("double")))
    ml = {r["doc_id"]: int(r["prediction"]) for r in nb.transform(cv.transform(tok.transform(test))).collect()}
    assert ours == ml


def test_report_with_unpredicted_and_absent_classes(spark):
    rows = [(1, "a", "a"), (2, "a", "c"), (3, "b", "a"), (4, "b", "a")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, y STRING, yhat STRING")
    rep = {r["label"]: r for r in met.report(df).collect()}
    assert set(rep) == {"a", "b", "c", "accuracy", "macro avg", "weighted avg"}
    assert rep["b"]["precision"] == 0.0 and rep["b"]["recall"] == 0.0 and rep["c"]["support"] == 0
    assert abs(rep["accuracy"]["f1"] - 0.25) < 1e-12
    w = met.weighted_prf(df).first()
    assert abs(w["recall"] - w["accuracy"]) < 1e-12


def test_weighted_prf_matches_ml_evaluator(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    import random
    rnd = random.Random(5)
    rows = [(i, float(rnd.randint(0, 3)), float(rnd.randint(0, 3))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, y DOUBLE, yhat DOUBLE")
    ours = met.weighted_prf(df).first()
    ev = MulticlassClassificationEvaluator(labelCol="y", predictionCol="yhat")
    for ours_name, ml_name in (("precision", "weightedPrecision"), ("recall", "weightedRecall"), ("f1", "f1")):
        assert abs(ours[ours_name] - ev.setMetricName(ml_name).evaluate(df)) < 1e-12


def test_loss_keeps_unseen_true_class(spark):
    proba = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5)], "doc_id BIGINT, label INT, p DOUBLE")
    truth = spark.createDataFrame([(1, 0, 0), (2, 7, 0)], "doc_id BIGINT, label INT, batch_id BIGINT")
    pt = met.truth_probability(proba, truth.drop("batch_id")).join(truth, ["doc_id", "label"])
    rows = {r["doc_id"]: r["p_true"] for r in pt.collect()}
    assert rows == {1: 0.5, 2: 1e-6}
    loss = met.mean_loss(pt).first()["mean_loss"]
    assert abs(loss - (-math.log(0.5) - math.log(1e-6)) / 2) < 1e-9


def test_alignment_counts(spark):
    t = spark.createDataFrame([(1,), (2,), (3,)], "doc_id BIGINT")
    p = spark.createDataFrame([(2,), (3,), (4,), (4,)], "doc_id BIGINT")
    r = met.alignment(t, p).first()
    assert (r["n_matched"], r["n_truth_only"], r["n_pred_only"], r["n_duplicate_keys"]) == (2, 1, 1, 1)
