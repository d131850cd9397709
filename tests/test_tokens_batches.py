from pyspark.sql import functions as F

from msgsift.config import BOS_ID, EOS_ID, PAD_ID, UNK_ID
from msgsift.functions.text import argmax, softmax
from msgsift.operators import metrics as met
from msgsift.operators.batching import ordered_batches, shuffled_batches, step_counts
from msgsift.operators.masking import mask_positions
from msgsift.operators.tokens import build_vocab, encode, token_ids, tokenize


def test_long_message_chunks_and_empty_message(spark):
    long_text = " ".join(f"w{i % 7}" for i in range(300))
    df = spark.createDataFrame([(1, long_text), (2, "!!! ???")], "doc_id BIGINT, text STRING")
    vocab = build_vocab(tokenize(df), min_df=1, max_vocab=100)
    enc = {(r["doc_id"], r["chunk"]): r for r in encode(df, vocab).collect()}
    assert sorted(enc) == [(1, 0), (1, 1), (2, 0)]
    a, b, e = enc[(1, 0)], enc[(1, 1)], enc[(2, 0)]
    assert a["n_tokens"] == 248 and b["n_tokens"] == 52 and e["n_tokens"] == 0
    assert len(a["input_ids"]) == 250 and a["input_ids"][0] == BOS_ID and a["input_ids"][-1] == EOS_ID
    assert e["input_ids"][:2] == [BOS_ID, EOS_ID] and set(e["input_ids"][2:]) == {PAD_ID}
    assert e["attention_mask"][:3] == [1, 1, 0]
    assert sum(b["attention_mask"]) == 54
    fixed = encode(df, vocab, pad_to="max_len").collect()
    assert all(len(r["input_ids"]) == 250 for r in fixed)


def test_unknown_token_id(spark):
    df = spark.createDataFrame([(1, "aa bb"), (2, "aa cc")], "doc_id BIGINT, text STRING")
    vocab = build_vocab(tokenize(df), min_df=2)
    ids = {r["token"]: r["token_id"] for r in token_ids(tokenize(df), vocab).collect()}
    assert ids["aa"] == 4 and ids["bb"] == UNK_ID and ids["cc"] == UNK_ID


def test_argmax_ties_and_softmax(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([-1000.0, -1001.0, -5000.0],)], "s ARRAY<DOUBLE>")
    r = df.select(argmax("s").alias("i"), softmax("s").alias("p")).collect()
    assert r[0]["i"] == 1 and abs(sum(r[0]["p"]) - 1) < 1e-12
    assert r[1]["i"] == 0 and abs(sum(r[1]["p"]) - 1) < 1e-12


def test_batches_17_by_8(spark):
    df = spark.range(17).withColumnRenamed("id", "doc_id")
    b = shuffled_batches(df, "doc_id", 8, seed=3).groupBy("batch_id").count().orderBy("batch_id").collect()
    assert [r["count"] for r in b] == [8, 8, 1]
    a1 = {r["doc_id"]: r["batch_id"] for r in shuffled_batches(df, "doc_id", 8, seed=3).collect()}
    a2 = {r["doc_id"]: r["batch_id"] for r in shuffled_batches(df.repartition(7).orderBy(F.desc("doc_id")),
                                                               "doc_id", 8, seed=3).collect()}
    assert a1 == a2
    o = ordered_batches(df, "doc_id", 8).collect()
    assert all(r["batch_id"] == r["doc_id"] // 8 for r in o)
    sc = step_counts(df, 8, 3).first()
    assert sc["steps_per_epoch"] == 3 and sc["total_steps"] == 9


def test_batch_mean_is_mean_of_three(spark):
    rows = [(i, "a", "a" if i % 3 else "b") for i in range(17)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, y STRING, yhat STRING")
    b = ordered_batches(df, "doc_id", 8)
    per = [met.accuracy(b.where(F.col("batch_id") == k)).first()["accuracy"] for k in range(3)]
    got = met.batch_mean(b).first()
    assert abs(got["accuracy"] - sum(per) / 3) < 1e-12 and got["n_batches"] == 3


def test_every_10th_batch(spark):
    rows = [(i, "a", "a") for i in range(10 * 4)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, y STRING, yhat STRING")
    assert met.every_n_accuracy(ordered_batches(df, "doc_id", 4)).count() == 0
    df2 = spark.createDataFrame([(i, "a", "a") for i in range(11 * 4)], "doc_id BIGINT, y STRING, yhat STRING")
    assert [r["batch_id"] for r in met.every_n_accuracy(ordered_batches(df2, "doc_id", 4)).collect()] == [10]


def test_mask_rates_and_determinism(spark):
    ids = spark.range(200000).select(F.lit(1).alias("doc_id"), F.col("id").alias("pos"),
                                     (F.col("id") % 50 + 4).cast("int").alias("token_id"))
    m = mask_positions(ids, 50, ["doc_id", "pos"], seed=1)
    c = {r["action"]: r["count"] for r in m.groupBy("action").count().collect()}
    sel = c["mask"] + c["random"] + c["same"]
    assert abs(sel / 200000 - 0.15) < 0.01
    assert abs(c["mask"] / sel - 0.8) < 0.02
    m2 = mask_positions(ids.repartition(5), 50, ["doc_id", "pos"], seed=1)
    assert m.exceptAll(m2).count() == 0
    r = m.where("action = 'random'").agg(F.min("input_id"), F.max("input_id")).first()
    assert r[0] >= 4 and r[1] < 54


def test_ordered_rank_with_clustered_ids_and_outliers(spark):
    from msgsift.operators.ranking import ordered_rank
    ids = list(range(1000)) + [10**12, 10**15, 2**62] + list(range(5000, 5050))
    df = spark.createDataFrame([(i,) for i in ids[::-1]], "doc_id BIGINT").repartition(5)
    got = {r["doc_id"]: r["rank"] for r in ordered_rank(df, "doc_id", bits=6).collect()}
    assert got == {i: r + 1 for r, i in enumerate(sorted(ids))}
    # equal-width ranges would put all but three rows in one bucket; quantile ranges spread them
    from msgsift.operators.ranking import quantile_ranges
    ranged, n_ranges = quantile_ranges(df, "doc_id", bits=6)
    sizes = [r["count"] for r in ranged.groupBy("_range").count().collect()]
    assert n_ranges > 32 and max(sizes) <= 3 * len(ids) / 64


def test_ordered_rank_sizes_ranges_from_the_count(spark):
    from msgsift.operators.ranking import ordered_rank
    ids = [i * i for i in range(700)] + [7 * 10**14 + i for i in range(300)]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id BIGINT").repartition(6)
    # ~10 rows per range: 1,000 rows -> 2^7 quantile ranges; one range when the target is large
    for target in (10, 10**6):
        got = {r["doc_id"]: r["rank"] for r in ordered_rank(df, "doc_id", rows_per_range=target).collect()}
        assert got == {i: r + 1 for r, i in enumerate(sorted(ids))}


def test_lookup_and_join_paths_encode_alike(spark):
    from msgsift.operators.tokens import encode, vocab_from_texts
    texts = [(1, " ".join(f"w{i % 13}" for i in range(600))), (2, ""), (3, None), (4, "w1 zz w2 ÉTÉ été")]
    df = spark.createDataFrame(texts, "doc_id BIGINT, text STRING")
    vocab = vocab_from_texts(df, min_df=1, max_vocab=10)
    a = sorted(tuple(r) for r in encode(df, vocab).collect())
    b = sorted(tuple(r) for r in encode(df, vocab, max_lookup_rows=3).collect())   # forces the join path
    assert a == b and [r[1] for r in a if r[0] == 1] == [0, 1, 2]
    assert {r[0] for r in a} == {1, 2, 3, 4}
