import pytest

from msgsift.config import TriageConfig
from msgsift.plans.pipeline import answer, evaluate, prepare_labelled, train
from msgsift.sources.tables import annotated, labelled, messages

from .conftest import SF_SMALL


def test_train_evaluate_answer(spark, tmp_dir):
    lab = labelled(spark, SF_SMALL)
    res = train(lab, TriageConfig(on_singleton="train"), out_dir=tmp_dir)
    m = res.metrics.first()
    assert 0 <= m["accuracy"] <= 1 and m["val_loss"] > 0
    test = res.split.where("part = 'test'").select("doc_id", "text", "label")
    rep = {r["label"] for r in evaluate(spark, res.model_path, test, tmp_dir).collect()}
    assert {"accuracy", "macro avg", "weighted avg"} <= rep
    msgs = messages(spark, SF_SMALL).select("msg_id", "text")
    assert answer(spark, res.model_path, msgs, tmp_dir, "msg_id").count() == msgs.count()


def test_prepare_labelled_drops_and_validates(spark):
    raw = annotated(spark, SF_SMALL)
    good, rejected = prepare_labelled(raw, on_bad="quarantine")
    assert good.where("intent IS NULL").count() == 0
    assert {r["reason"] for r in rejected.select("reason").distinct().collect()} == {"label"}
    kept = good.count() + rejected.count()
    assert 0 < kept < raw.count() and kept == raw.where("Translation IS NOT NULL").count()
    marked = raw.limit(3).selectExpr("Index", "if(Index % 2 = 0, 'NA', `Original Text`) AS `Original Text`",
                                     "'yes' AS Translation", "'x' AS Intent1_Cleaned")
    good, rejected = prepare_labelled(marked, on_bad="quarantine")
    assert good.count() + rejected.count() == 3
    assert all(r["reason"] == "feature" and r["doc_id"] % 2 == 0 for r in rejected.collect())


def test_answer_rejects_null_text_and_answers_an_empty_one(spark, tmp_dir):
    res = train(labelled(spark, SF_SMALL), TriageConfig(on_singleton="train"), out_dir=tmp_dir)
    msgs = spark.createDataFrame([("1:0", "hello"), ("1:1", None), ("1:2", "")], "msg_id STRING, text STRING")
    with pytest.raises(Exception, match="invalid row"):
        answer(spark, res.model_path, msgs, None, "msg_id").collect()
    out = answer(spark, res.model_path, msgs, tmp_dir, "msg_id", on_bad="quarantine")
    assert sorted(r["msg_id"] for r in out.collect()) == ["1:0", "1:2"]
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_dir}/rejected").collect()] == [("1:1", None, "feature")]


def test_train_with_separate_validation_part(spark, tmp_dir):
    lab = labelled(spark, "/root/testdata/sf0.01")
    res = train(lab, TriageConfig(on_singleton="train", val_share=0.2))
    parts = {r["part"]: r["count"] for r in res.split.groupBy("part").count().collect()}
    assert set(parts) == {"train", "validation", "test"} and sum(parts.values()) == lab.count()
    assert 0 <= res.metrics.first()["accuracy"] <= 1
