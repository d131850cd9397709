"""Committed model versions, the keyed run table, counts that ride on writes, line numbers, epoch orders, masks on arrays."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from msgsift.operators import metrics as met
from msgsift.operators.batching import epoch_batches, permute
from msgsift.operators.clean import counted
from msgsift.operators.masking import mask_arrays, mask_epochs, mask_line_epochs, mask_positions
from msgsift.operators.naive_bayes import score, train_nb
from msgsift.plans.pipeline import evaluate, write_prepared
from msgsift.session import materialize
from msgsift.sinks.files import (list_versions, load_model, prune_versions, read_runs, save_model, write_masked_lines, write_run)
from msgsift.sources.files import read_corpus

from .test_plans import _exchanges

TRAIN = [(1, "good happy fine", 0, "pos"), (2, "happy good day", 0, "pos"), (3, "sad bad awful", 1, "neg"),
         (4, "bad sad night", 1, "neg"), (5, "good bad", 1, "neg")]


def _model(spark, rows=TRAIN):
    return train_nb(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, label INT, intent STRING"))


# --- versions

def test_torn_version_is_not_loaded_nor_counted(spark, tmp_dir):
    path = f"{tmp_dir}/m"
    first, second = _model(spark), _model(spark, TRAIN[:4])
    save_model(first, path, version=0)
    save_model(second, path, version=1)
    torn = f"{path}/version=2/attempt-x"
    second.weights.limit(1).write.parquet(f"{torn}/weights")           # died before its commit
    assert list_versions(spark, path) == [0, 1]
    assert load_model(spark, path, version="latest", check=True).n_tokens == second.n_tokens
    with pytest.raises(FileNotFoundError):
        load_model(spark, f"{path}/version=2")
    assert prune_versions(spark, path, 1) == [0]                       # the torn one is not taken for the newest
    assert list_versions(spark, path) == [1] and os.path.isdir(torn)


def test_saving_a_version_again_replaces_it_whole(spark, tmp_dir):
    path = f"{tmp_dir}/m"
    save_model(_model(spark), path, version=4)
    save_model(_model(spark, TRAIN[:3]), path, version=4)
    back = load_model(spark, path, version=4, check=True)
    assert sum(back.n_tokens) == 9 and list_versions(spark, path) == [4]
    names = os.listdir(f"{path}/version=4")
    assert sum(n.startswith("attempt-") for n in names) == 1
    assert sum(n.startswith("commit-") and n.endswith(".json") for n in names) == 1


def test_a_failed_second_save_leaves_the_first(spark, tmp_dir):
    path = f"{tmp_dir}/m"
    model = _model(spark)
    save_model(model, path, version=0)
    bad = _model(spark, TRAIN[:3])
    bad.counts = bad.counts.withColumn("n_tc", F.raise_error(F.lit("lost")).cast("bigint"))
    with pytest.raises(Exception, match="lost"):
        save_model(bad, path, version=0)
    back = load_model(spark, path, version="latest", check=True)
    assert back.n_tokens == model.n_tokens and back.weights.count() == model.weights.count()


def test_rows_lost_after_the_commit_are_noticed(spark, tmp_dir):
    root = save_model(_model(spark), f"{tmp_dir}/m", version=0)
    commit = next(n for n in os.listdir(root) if n.startswith("commit-") and n.endswith(".json"))
    attempt = json.load(open(f"{root}/{commit}"))["attempt"]
    spark.createDataFrame([("x", [0.0, 0.0])], "token STRING, w ARRAY<DOUBLE>").write.mode("overwrite").parquet(f"{root}/{attempt}/weights")
    with pytest.raises(ValueError, match="weights"):
        load_model(spark, root, check=True)


def test_run_table_keeps_one_row_per_version(spark, tmp_dir):
    def run(version, value):
        write_run(spark.createDataFrame([(value, version)], "accuracy DOUBLE, version INT"), f"{tmp_dir}/runs")
    for version, value in ((0, 0.5), (1, 0.6), (0, 0.7), (2, 0.8), (1, 0.9)):
        run(version, value)
    assert sorted(map(tuple, read_runs(spark, f"{tmp_dir}/runs").collect())) == [(0.7, 0), (0.8, 2), (0.9, 1)]


# --- counts

def test_prepared_rows_are_counted_by_their_write(spark, tmp_dir):
    rows = [(1, "a", "x"), (2, None, "x"), (3, "", "x"), (4, "b", None), (5, "c", ""), (6, None, None), (7, "d", "y")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, intent STRING")
    assert write_prepared(df, f"{tmp_dir}/p") == {"n_rows": 7, "n_good": 2, "n_feature": 3, "n_label": 2}
    back = spark.read.parquet(f"{tmp_dir}/p")
    assert {r["reason"]: r["count"] for r in back.groupBy("reason").count().collect()} == {"ok": 2, "feature": 3, "label": 2}
    tagged, seen = counted(df.where("doc_id > 100"))
    assert materialize(tagged, "none").count() == 0 and seen.get["n_rows"] == 0


@pytest.mark.parametrize("truth,pred", [([1, 2, 3], [1, 2, 3]), ([1, 2, 3, 4], [2, 3]), ([1], [1, 2, 2, 3]), ([1, 1, 2], [1, 3]),
                                        ([1, 1, 1], [1, 1]), ([], [5]), ([5], []), ([], [])])
def test_alignment_in_the_join_equals_the_plain_one(spark, truth, pred):
    t = spark.createDataFrame([(i, "a") for i in truth], "doc_id BIGINT, y STRING")
    p = spark.createDataFrame([(i, "b") for i in pred], "doc_id BIGINT, yhat STRING")
    joined, seen = met.aligned(t, p)
    rows = materialize(joined, "aligned-test")
    assert rows.columns == ["doc_id", "y", "yhat"]
    want = met.alignment(t, p).first().asDict()
    assert {k: seen.get[k] or 0 for k in want} == {k: v or 0 for k, v in want.items()}


def test_evaluate_names_what_does_not_align(spark, tmp_dir):
    root = save_model(_model(spark), f"{tmp_dir}/m", version=0)
    test = spark.createDataFrame([(10, "good day", 0), (11, "bad", 1)], "doc_id BIGINT, text STRING, label INT")
    report = {r["label"]: r["support"] for r in evaluate(spark, root, test).collect()}
    assert report["pos"] == 1 and report["accuracy"] == 2
    with pytest.raises(ValueError, match="label the model does not know"):
        evaluate(spark, root, test.withColumn("label", F.lit(9)))


# --- lines

def test_line_numbers_by_array_equal_the_join_and_move_no_lines(spark, tmp_dir):
    rng = random.Random(1)
    for k in range(4):
        with open(f"{tmp_dir}/f{k}.txt", "w") as f:
            f.write("\n".join("" if rng.random() < 0.2 else "line %d of %d" % (i, k) for i in range(rng.randrange(1, 900))))
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c in old:
            spark.conf.set(c, "1000")
        joined = sorted(map(tuple, read_corpus(spark, tmp_dir).collect()))
        by_array = read_corpus(spark, tmp_dir, join_splits=0)
        ex, text = _exchanges(by_array)
        assert sorted(map(tuple, by_array.collect())) == joined and len(joined) > 100
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert ex == [] and "Join" not in text, text
    for file, line_no, piece, value in joined:
        assert value.split()[1] == str(line_no) and piece == 0


# --- epoch orders

@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation_is_one_to_one_per_epoch(n):
    seen = set()
    for epoch in range(6):
        p = permute(np.arange(n), np.full(n, epoch), n, seed=7)
        assert sorted(p.tolist()) == list(range(n))
        seen.add(tuple(p.tolist()))
    assert n < 5 or len(seen) == 6


def test_permutation_spreads_ranks():
    n = 20_000
    p = permute(np.arange(n), np.zeros(n, dtype=np.int64), n)
    q = permute(np.arange(n), np.ones(n, dtype=np.int64), n)
    for x in (p, q):
        assert abs(np.corrcoef(np.arange(n), x)[0, 1]) < 0.05
        near = np.abs(np.diff(x))
        assert 0.28 < near.mean() / n < 0.39                          # a random order: a third
    assert abs(np.corrcoef(p, q)[0, 1]) < 0.05


def test_epochs_share_one_exchange(spark):
    df = materialize(spark.range(1000).select(F.col("id").alias("doc_id")), "epoch-input")
    three, many = (epoch_batches(df, k) for k in (3, 15))
    (ex3, _), (ex15, text) = _exchanges(three), _exchanges(many)
    assert len(ex3) == len(ex15) == 0, text                            # the ranks are written before
    got = many.groupBy("epoch").agg(F.countDistinct("doc_id").alias("d"), F.max("batch_id").alias("b"), F.count("*").alias("n")).collect()
    assert len(got) == 15 and all((r["d"], r["b"], r["n"]) == (1000, 124, 1000) for r in got)


def test_epoch_batches_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id BIGINT")
    assert epoch_batches(df, 3).collect() == []


# --- masks

def _lines(spark):
    rng = random.Random(5)
    rows = [(d, n, [rng.randrange(0, 60) for _ in range(rng.randrange(0, 90))]) for d in range(20) for n in range(3)]
    return spark.createDataFrame(rows, "doc_id BIGINT, line_no BIGINT, ids ARRAY<INT>")


def test_masks_on_arrays_equal_masks_on_positions(spark):
    lines = _lines(spark)
    rows = lines.select("doc_id", "line_no", F.posexplode("ids").alias("pos", "token_id"))
    want = mask_positions(rows, 56, ["doc_id", "line_no", "pos"], seed=3).select(
        "doc_id", "line_no", "pos", "input_id", "target_id", "action")
    got = mask_arrays(lines, 56, ["doc_id", "line_no"], seed=3).select("doc_id", "line_no", F.posexplode("cells").alias("pos", "c")).select(
        "doc_id", "line_no", "pos", "c.*")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_epochs_on_arrays_make_no_token_rows(spark, tmp_dir):
    lines = materialize(_lines(spark), "mask-lines")
    masked = mask_line_epochs(lines, 56, ["doc_id", "line_no"], 15, seed=3)
    _, text = _exchanges(masked)
    assert text.count("- * Generate") == 1 and "posexplode" not in text, text       # one copy of a line per epoch
    write_masked_lines(masked, f"{tmp_dir}/e")
    back = spark.read.parquet(f"{tmp_dir}/e")
    assert sorted(r["epoch"] for r in back.select("epoch").distinct().collect()) == list(range(15))
    rows = lines.select("doc_id", "line_no", F.posexplode("ids").alias("pos", "token_id"))
    want = mask_epochs(rows, 56, ["doc_id", "line_no", "pos"], 15, seed=3).groupBy("epoch").agg(F.sum("input_id")).collect()
    got = back.groupBy("epoch").agg(F.sum(F.aggregate("input_ids", F.lit(0), lambda a, x: a + x))).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_scores_survive_a_reload(spark, tmp_dir):
    model = _model(spark)
    root = save_model(model, f"{tmp_dir}/plain")
    df = spark.createDataFrame([(1, "good sad")], "doc_id BIGINT, text STRING")
    assert score(load_model(spark, root), df).collect() == score(model, df).collect()
