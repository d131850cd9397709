import json
import os
import sys

import pytest
from pyspark.sql import functions as F

from msgsift.operators.answers import answer_json, answer_map
from msgsift.operators.naive_bayes import predict, score, train_nb
from msgsift.sinks.files import load_model, save_model, write_label_map
from msgsift.sources.files import read_label_map
from msgsift.sources.tables import message_key
from msgsift.streaming.score_stream import message_stream, read_answers, start_answering

from .conftest import SF_SMALL

TRAIN = [(1, "good happy fine", 0, "pos"), (2, "happy good day", 0, "pos"), (3, "sad bad awful", 1, "neg"),
         (4, "bad sad night", 1, "neg")]


def _model(spark):
    return train_nb(spark.createDataFrame(TRAIN, "doc_id BIGINT, text STRING, label INT, intent STRING"),
                    min_df=1, max_vocab=50)


def test_json_answer_shape(spark):
    model = _model(spark)
    msgs = spark.createDataFrame([(1, "good day"), (2, "")], "doc_id BIGINT, text STRING")
    out = {r["doc_id"]: json.loads(r["json"]) for r in answer_json(answer_map(model, score(model, msgs))).collect()}
    assert list(out[1][0].keys()) == ["pos", "neg"] or list(out[1][0].keys()) == ["neg", "pos"]
    assert abs(sum(out[1][0].values()) - 1) < 1e-5 and out[1][0]["pos"] > out[1][0]["neg"]
    assert len(out) == 2


def test_model_and_label_map_roundtrip(spark, tmp_dir):
    model = _model(spark)
    root = save_model(model, f"{tmp_dir}/model", version=3)
    assert root.endswith("version=3")
    back = load_model(spark, root)
    msgs = spark.createDataFrame([(1, "sad night"), (2, "happy")], "doc_id BIGINT, text STRING")
    a = {r["doc_id"]: r["pred_intent"] for r in predict(model, score(model, msgs)).collect()}
    b = {r["doc_id"]: r["pred_intent"] for r in predict(back, score(back, msgs)).collect()}
    assert a == b == {1: "neg", 2: "pos"}
    lm = spark.createDataFrame([("x", 1, 5, 1), ("y", 0, 3, 2)], "intent STRING, corresponding_label INT, n BIGINT, r INT")
    write_label_map(lm, f"{tmp_dir}/lm")
    assert sorted(tuple(r) for r in read_label_map(spark, f"{tmp_dir}/lm").collect()) == [("x", 1), ("y", 0)]


def test_stream_equals_batch_and_replay_adds_nothing(spark, tmp_dir):
    model = _model(spark)
    src = f"{tmp_dir}/in"
    rows = [(1, 0, "user", "good day"), (1, 1, "assistant", "sad night"), (2, 0, "user", "")]
    spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING").write.parquet(src)
    out, ckpt = f"{tmp_dir}/out", f"{tmp_dir}/ckpt"
    start_answering(model, message_stream(spark, src), out, ckpt).awaitTermination()
    first = read_answers(spark, out).select("msg_id", "json").collect()
    start_answering(model, message_stream(spark, src), out, ckpt).awaitTermination()
    again = read_answers(spark, out).select("msg_id", "json").collect()
    assert sorted(first) == sorted(again) and len(first) == 3
    msgs = spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING") \
        .withColumn("msg_id", message_key())
    batch = answer_json(answer_map(model, score(model, msgs, "msg_id"), "msg_id"), "msg_id").collect()
    assert sorted(tuple(r) for r in batch) == sorted(tuple(r) for r in first)


def test_entry_and_registry(spark):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"doc_id", "true_intent", "pred_intent", "p_top"}
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q)
    from msgsift.plans.queries import QUERIES   # the training-data queries have their own tests
    assert (set(q) & set(QUERIES)) - set(o) == set()


def test_some_queries_on_smallest_tables(spark):
    import __spark_entry__ as e
    q = e.queries()
    for name in ("label_map", "split_stratified", "tokens", "nb_proba", "report", "mlm_epochs"):
        assert q[name](spark, SF_SMALL).count() > 0


def test_versions_keep_last_and_latest(spark, tmp_dir):
    from msgsift.sinks.files import list_versions
    model = _model(spark)
    for v in range(4):
        save_model(model, f"{tmp_dir}/m", version=v, keep_last=2)
    assert list_versions(spark, f"{tmp_dir}/m") == [2, 3]
    back = load_model(spark, f"{tmp_dir}/m", version="latest")
    assert back.intents == model.intents and back.vocab_size == model.vocab_size


def test_lr_pipeline_save_and_load(spark, tmp_dir):
    from msgsift.operators.ml import fit_lr, load_lr, predict_lr, save_lr
    rows = [(i, ("good happy day " if i % 2 else "sad bad night ") + f"w{i}", i % 2) for i in range(20)]
    train = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, label INT")
    model = fit_lr(train, max_vocab=50, min_df=2, max_iter=20)
    root = save_lr(model, f"{tmp_dir}/lr", version=1)
    a = sorted(tuple(r) for r in predict_lr(model, train).collect())
    b = sorted(tuple(r) for r in predict_lr(load_lr(root), train).collect())
    assert a == b


def test_registered_queries_do_not_depend_on_partitioning(spark):
    import __spark_entry__ as e
    q = e.queries()
    names = ("split_stratified", "batches_shuffled", "batches_ordered", "nb_predict", "report", "mlm_mask")

    def run(parts):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            return {n: sorted(tuple(r) for r in q[n](spark, SF_SMALL).collect()) for n in names}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")

    a, b = run(3), run(13)
    for n in names:
        assert a[n] == b[n] and len(a[n]) > 0, n


def test_stream_over_several_micro_batches(spark, tmp_dir):
    model = _model(spark)
    src = f"{tmp_dir}/in3"
    schema = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
    files = [[(1, 0, "user", "good day")], [(1, 1, "assistant", "sad night"), (2, 0, "user", "happy")],
             [(3, 0, "user", "")]]
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    out, ckpt = f"{tmp_dir}/out3", f"{tmp_dir}/ckpt3"
    start_answering(model, message_stream(spark, src, max_files_per_trigger=1), out, ckpt).awaitTermination()
    got = read_answers(spark, out)
    assert got.select("batch_id").distinct().count() == 3      # one micro-batch per file
    first = sorted(tuple(r) for r in got.select("msg_id", "json").collect())
    start_answering(model, message_stream(spark, src, max_files_per_trigger=1), out, ckpt).awaitTermination()
    assert sorted(tuple(r) for r in read_answers(spark, out).select("msg_id", "json").collect()) == first
    msgs = spark.createDataFrame([r for f in files for r in f], schema) \
        .withColumn("msg_id", message_key())
    batch = answer_json(answer_map(model, score(model, msgs, "msg_id"), "msg_id"), "msg_id").collect()
    assert sorted(tuple(r) for r in batch) == first and len(first) == 4


def test_another_checkpoint_keeps_the_old_answers(spark, tmp_dir):
    model = _model(spark)
    src, out = f"{tmp_dir}/in4", f"{tmp_dir}/out4"
    spark.createDataFrame([(1, 0, "user", "good day"), (10**15, 10**7, "user", "sad")],
                          "conv_id BIGINT, turn BIGINT, role STRING, text STRING").write.parquet(src)
    for k in (1, 2):
        start_answering(model, message_stream(spark, src), out, f"{tmp_dir}/ckpt4-{k}").awaitTermination()
        got = read_answers(spark, out)
        assert got.select("run").distinct().count() == k and got.count() == 2 * k
    assert {r["msg_id"] for r in got.collect()} == {"1:0", f"{10**15}:{10**7}"}
    os.rename(f"{tmp_dir}/ckpt4-1", f"{tmp_dir}/elsewhere")
    with pytest.raises(ValueError, match="checkpoint is gone"):
        start_answering(model, message_stream(spark, src), out, f"{tmp_dir}/ckpt4-1")
