"""Masks drawn for whole batches: the draws against hashlib, the arrays against position rows, the epoch files without a shuffle."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from msgsift.functions import digest
from msgsift.operators.masking import ACTIONS, mask_arrays, mask_epochs, mask_line_epochs, mask_positions
from msgsift.session import materialize
from msgsift.sinks.files import write_masked_lines

KEY = lambda r: tuple(map(str, r))


@pytest.mark.parametrize("step", [7, 1 << 14])
def test_draws_equal_hashlib(monkeypatch, step):
    monkeypatch.setattr(digest, "SLICE", step)
    rng = random.Random(3)
    prefixes = ["1:%d:%s:%d:" % (k, "é" * rng.choice([0, 1, 5, 18, 19, 20, 24, 25, 40]), k * 7919) for k in range(60)]
    sizes = np.array([rng.choice([0, 1, 9, 10, 11, 101, 1_100]) for _ in prefixes])
    got = digest.place_draws([p.encode() for p in prefixes], sizes)
    want = [[int(hashlib.md5(f"{p}{i}".encode()).hexdigest()[8 * k:8 * k + 8], 16) for k in range(3)]
            for p, n in zip(prefixes, sizes) for i in range(n)]
    assert got.T.tolist() == want
    assert digest.place_draws([], np.zeros(0, dtype=int)).shape == (3, 0)
    assert digest.place_draws([b"x"], np.zeros(1, dtype=int)).shape == (3, 0)


def _odd_lines(spark):
    rng = random.Random(8)
    rows = [(None if d % 7 == 0 else f"d{d}" * (1 + 30 * (d % 5 == 0)), n, None if d == 3 else
             [rng.randrange(0, 40) for _ in range(rng.choice([0, 1, 30, 1_200]))])
            for d in range(25) for n in (0, 1, None)]
    return materialize(spark.createDataFrame(rows, "doc_id STRING, line_no BIGINT, ids ARRAY<INT>"), "odd-lines")


@pytest.mark.parametrize("limit", [50, 1 << 18])
def test_masks_with_nulls_and_long_keys_equal_position_rows(spark, monkeypatch, limit):
    from msgsift.operators import masking
    monkeypatch.setattr(masking, "SLICE_IDS", limit)
    lines = _odd_lines(spark)
    rows = lines.select("doc_id", "line_no", F.posexplode("ids").alias("pos", "token_id"))
    want = mask_positions(rows, 36, ["doc_id", "line_no", "pos"], seed=2)
    got = mask_arrays(lines, 36, ["doc_id", "line_no"], seed=2)
    names = ["doc_id", "line_no", "pos", "token_id", "input_id", "target_id", "action"]
    flat = got.select("doc_id", "line_no", F.posexplode(F.arrays_zip("ids", "cells")).alias("pos", "x")).select(
        "doc_id", "line_no", "pos", F.col("x.ids").alias("token_id"), "x.cells.*")
    assert sorted(map(tuple, flat.select(names).collect()), key=KEY) == sorted(map(tuple, want.select(names).collect()), key=KEY)
    assert got.where("ids IS NULL AND cells IS NOT NULL").isEmpty() and got.count() == lines.count()
    sums = got.agg(F.sum("n_masked"), F.sum("n_random"), F.sum("n_same")).first()
    counts = {r["action"]: r["count"] for r in want.groupBy("action").count().collect()}
    assert tuple(sums) == tuple(counts.get(a, 0) for a in ACTIONS[1:])


def test_an_entry_without_an_id_stays_without_one(spark):
    lines = spark.createDataFrame([(1, 2, [None, 5, None, 6] * 50)], "doc_id BIGINT, line_no BIGINT, ids ARRAY<INT>")
    got = mask_arrays(lines, 36, ["doc_id", "line_no"]).first()
    assert all(c["input_id"] is None and c["target_id"] is None and c["action"] == "keep" for c in got["cells"][::2])
    assert got["input_ids"][::2] == [None] * 100 and None not in got["input_ids"][1::2]
    assert 0 < got["n_masked"] + got["n_random"] + got["n_same"] < 50


def test_masks_of_one_line_do_not_go_through_row_by_row_lambdas(spark):
    plan = mask_line_epochs(_odd_lines(spark), 36, ["doc_id", "line_no"], 3).select("epoch", "input_ids", "target_ids", "n_masked") \
        ._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "md5" not in plan and "lambdafunction" not in plan, plan


def test_epoch_files_are_written_without_moving_the_copies(spark, tmp_dir, monkeypatch):
    lines = _odd_lines(spark).where("ids IS NOT NULL")
    masked = mask_line_epochs(lines, 36, ["doc_id", "line_no"], 4, seed=2)
    monkeypatch.setattr(type(masked), "repartition", lambda *a: pytest.fail("the copies of every epoch are shuffled"))
    write_masked_lines(masked, f"{tmp_dir}/e")
    back = spark.read.parquet(f"{tmp_dir}/e")
    assert back.count() == 4 * lines.count()
    rows = lines.select("doc_id", "line_no", F.posexplode("ids").alias("pos", "token_id"))
    want = mask_epochs(rows, 36, ["doc_id", "line_no", "pos"], 4, seed=2).select("epoch", "doc_id", "line_no", "pos", "input_id", "target_id")
    got = back.select("epoch", "doc_id", "line_no", F.posexplode(F.arrays_zip("input_ids", "target_ids")).alias("pos", "x")).select(
        "epoch", "doc_id", "line_no", "pos", "x.*")
    assert sorted(map(tuple, got.collect()), key=KEY) == sorted(map(tuple, want.collect()), key=KEY)
