"""Registered queries: one DataFrame per operator group, over the whole tables.

Every query reads the parquet tables of ``sf_dir`` (documents, labels,
conversations) and returns a DataFrame whose columns are BIGINT, DOUBLE or
STRING, named as in :mod:`msgsift.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CORPUS_EPOCHS, INFER_BATCH, SEED, TRAIN_BATCH
from ..functions.text import ALL_LINE_BREAKS
from ..operators import answers as ans
from ..operators import metrics as met
from ..operators.batching import epoch_batches, ordered_batches, shuffled_batches, step_counts
from ..operators.clean import feature_table
from ..operators.labels import (class_counts, class_stats, decode, encode, label_map, label_table,
                               table_from_counts, width_check)
from ..operators.masking import mask_arrays, mask_line_epochs
from ..operators.naive_bayes import long_form, predict, score, train_nb, truth_loss
from ..operators.split import random_split, stratified_split, three_way_split
from ..operators.tokens import encode as encode_texts, text_ids, tokenize, vocab_from_texts
from ..session import materialize
from ..sources.files import split_lines
from ..sources.tables import annotated, documents, labelled, labelled_keys, messages, unlabelled, with_text
from .pipeline import prepare_labelled, prepare_scored

PREDICT_BATCH = 64  # batch of the training script's prediction helper, in order
MLM_SEED = 1
MAX_VOCAB = None    # every token
MIN_DF = 1


# --- shared stages ---------------------------------------------------------

def _encoded_labelled(spark: SparkSession, sf: str):
    lab = labelled_keys(spark, sf)
    counts = class_counts(lab)
    return encode(lab, table_from_counts(spark, counts), bounded=True), counts


def _split(spark: SparkSession, sf: str) -> DataFrame:
    """Stratified 80/20 split, seed 42; a one-row class stays in training.

    ``(doc_id, intent, label, part)`` without the texts, written once to the
    shared checkpoint folder: training, scoring and metrics read it several
    times, and a lost executor re-reads the written split instead of
    recomputing the ranks.
    """
    enc, counts = _encoded_labelled(spark, sf)
    s = stratified_split(enc, "intent", "doc_id", seed=SEED, on_singleton="train", class_counts=counts)
    return materialize(s.select("doc_id", "intent", "label", "part"), "split")


def _part_keys(spark: SparkSession, sf: str):
    """The two parts without texts."""
    s = _split(spark, sf)
    return s.where(F.col("part") == "train"), s.where(F.col("part") == "test")


def _parts(spark: SparkSession, sf: str):
    """The two parts with their texts."""
    return tuple(with_text(spark, sf, keys) for keys in _part_keys(spark, sf))


def _nb(spark: SparkSession, sf: str, background: bool = False):
    keys, test_keys = _part_keys(spark, sf)
    train, test = with_text(spark, sf, keys), with_text(spark, sf, test_keys)
    bg = unlabelled(spark, sf) if background else None
    model = train_nb(train, min_df=MIN_DF, max_vocab=MAX_VOCAB, background=bg, members=keys)
    return model, train, test


def _test_predictions(spark: SparkSession, sf: str):
    model, train, test = _nb(spark, sf)
    pred = predict(model, score(model, test, keep=["intent", "label"]))   # truth rides along: no join
    out = pred.select("doc_id", F.col("intent").alias("y"), "label", F.col("pred_intent").alias("yhat"), "p_top")
    return model, train, test, materialize(out, "test-predictions")


# --- labels, cleaning, lines -------------------------------------------------

def q_label_map(spark, sf):
    m = label_map(labelled(spark, sf))
    return m.select("intent", F.col("corresponding_label").cast("bigint"), F.col("n").cast("bigint"),
                    F.col("freq_rank").cast("bigint"))


def q_class_stats(spark, sf):
    return class_stats(labelled(spark, sf)).select(F.col("n_classes").cast("bigint"),
                                                   F.col("n_samples").cast("bigint"))


def q_label_roundtrip(spark, sf):
    lab = labelled(spark, sf)
    table = label_table(lab)
    enc = encode(lab, table)
    dec = decode(enc.select("doc_id", "label", F.col("intent").alias("original")), table)
    return dec.select("doc_id", F.col("label").cast("bigint"), "intent",
                      (F.col("intent") == F.col("original")).cast("bigint").alias("same"))


def q_feature_filter(spark, sf):
    t = feature_table(annotated(spark, sf))
    return t.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "intent", "status")


def q_prepared_labelled(spark, sf):
    """P7 (training mode): P2 drops, P4 sorts the rest into good rows and rejects with a reason."""
    good, rejected = prepare_labelled(annotated(spark, sf), on_bad="quarantine")
    both = good.withColumn("reason", F.lit("ok")).unionByName(rejected)
    return both.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "intent", "reason")


def q_prepared_scored(spark, sf):
    """P7 (scoring mode): user turns are the messages; another turn has no message text and is rejected."""
    said = messages(spark, sf).withColumn("text", F.when(F.col("role") == "user", F.col("text")))
    good, rejected = prepare_scored(said, "msg_id", on_bad="quarantine")
    both = good.withColumn("reason", F.lit("ok")).unionByName(rejected)
    return both.select("msg_id", F.length("text").cast("bigint").alias("n_chars"), "reason")


def q_corpus_lines(spark, sf):
    lines = split_lines(unlabelled(spark, sf), "text", ["doc_id"], ALL_LINE_BREAKS)
    return lines.select("doc_id", "line_no", "line")


# --- splits and batches ------------------------------------------------------

def q_split_stratified(spark, sf):
    return _split(spark, sf).select("doc_id", "intent", F.col("label").cast("bigint"), "part")


def q_split_three_way(spark, sf):
    """Optional third part: test off the whole set, then validation off the training part."""
    enc, _ = _encoded_labelled(spark, sf)
    return three_way_split(enc, seed=SEED, on_singleton="train").select("doc_id", "intent", "part")


def q_split_random(spark, sf):
    return random_split(labelled(spark, sf), "doc_id", seed=0).select("doc_id", "intent", "part")


def q_batches_shuffled(spark, sf):
    train, _ = _part_keys(spark, sf)
    ep = train.select("doc_id").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(2))))
    b = shuffled_batches(ep, "doc_id", TRAIN_BATCH, SEED, "epoch", n_epochs=3)
    return b.select(F.col("epoch").cast("bigint"), "doc_id", "batch_id", "batch_pos")


def q_batches_epochs(spark, sf):
    """X3/B1 for all corpus epochs: one rank, a keyed permutation of it per epoch."""
    train, _ = _part_keys(spark, sf)
    b = epoch_batches(train.select("doc_id"), CORPUS_EPOCHS, "doc_id", TRAIN_BATCH, SEED)
    return b.select(F.col("epoch").cast("bigint"), "doc_id", "batch_id", "batch_pos")


def q_batches_ordered(spark, sf):
    _, test = _part_keys(spark, sf)
    return ordered_batches(test.select("doc_id"), "doc_id", PREDICT_BATCH).select("doc_id", "batch_id", "batch_pos")


def q_step_counts(spark, sf):
    train, test = _part_keys(spark, sf)
    a = step_counts(train, TRAIN_BATCH, 3).withColumn("part", F.lit("train"))
    b = step_counts(test, INFER_BATCH, 1).withColumn("part", F.lit("test"))
    return a.unionByName(b)


# --- tokens, vocabulary, encoding, masks ----------------------------------

def q_tokens(spark, sf):
    docs = documents(spark, sf)
    return tokenize(docs, "doc_id", "text")


def q_vocab_topk(spark, sf):
    v = vocab_from_texts(documents(spark, sf), "text", MIN_DF, MAX_VOCAB)
    return v.select("token", F.col("token_id").cast("bigint"), "df", "tf")


def q_encoded_padded(spark, sf):
    train, test = _parts(spark, sf)
    vocab = materialize(vocab_from_texts(train, "text", MIN_DF, MAX_VOCAB), "train-vocab")
    enc = None
    for name, part in (("train", train), ("test", test)):      # each part has its own width
        e = encode_texts(part, vocab, "doc_id", "text").withColumn("part", F.lit(name))
        enc = e if enc is None else enc.unionByName(e)
    return enc.select("part", "doc_id", "chunk", F.array_join("input_ids", " ").alias("input_ids"),
                      F.array_join("attention_mask", " ").alias("attention_mask"), "n_tokens")


def _corpus_line_ids(spark, sf):
    """(doc_id, line_no, ids) of every corpus line with a token, and the vocabulary's size."""
    corpus = unlabelled(spark, sf)
    lines = split_lines(corpus, "text", ["doc_id"], ALL_LINE_BREAKS)
    # document frequency per corpus document (tokens never span a line break)
    vocab = materialize(vocab_from_texts(corpus, "text", MIN_DF, MAX_VOCAB), "corpus-vocab")
    return text_ids(lines, vocab, ["doc_id", "line_no"], "line").where("size(ids) > 0"), vocab.count()


def q_mlm_mask(spark, sf):
    lines, v = _corpus_line_ids(spark, sf)
    m = mask_arrays(lines, v, ["doc_id", "line_no"], MLM_SEED)
    rows = m.select("doc_id", "line_no", F.posexplode(F.arrays_zip("ids", "input_ids", "target_ids")).alias("pos", "x"))
    return rows.select("doc_id", "line_no", F.col("pos").cast("bigint"), F.col("x.ids").cast("bigint").alias("token_id"),
                       F.col("x.input_ids").cast("bigint").alias("input_id"),
                       F.col("x.target_ids").cast("bigint").alias("target_id"))


def q_mlm_epochs(spark, sf):
    lines, v = _corpus_line_ids(spark, sf)
    m = mask_line_epochs(lines, v, ["doc_id", "line_no"], CORPUS_EPOCHS, MLM_SEED)
    sums = m.groupBy(F.col("epoch").cast("bigint").alias("epoch")).agg(
        F.sum(F.size("actions")).cast("bigint").alias("n_positions"), *[F.sum(c).alias(c) for c in ("n_masked", "n_random", "n_same")])
    return sums.select("epoch", "n_positions", F.expr("n_masked + n_random + n_same").alias("n_selected"),
                       "n_masked", "n_random", "n_same")


def q_mlm_epoch_file(spark, sf):
    """T9 -> sink: every epoch written partitioned by epoch and read back, summed per (epoch, document)."""
    from ..session import shared_path
    from ..sinks.files import write_masked_lines
    lines, v = _corpus_line_ids(spark, sf)
    path = shared_path(spark, "mlm-epochs")
    write_masked_lines(mask_line_epochs(lines, v, ["doc_id", "line_no"], CORPUS_EPOCHS, MLM_SEED), path)

    # each id weighted by its place
    cells = spark.read.parquet(path).select(
        F.col("epoch").cast("bigint").alias("epoch"), "doc_id", "line_no", "target_ids", F.posexplode("input_ids").alias("pos", "input_id"))
    target, place = F.get("target_ids", F.col("pos")), F.col("line_no") * 31 + F.col("pos") + 1
    cells = cells.select("epoch", "doc_id", "input_id", target.alias("target_id"), place.cast("bigint").alias("place"))

    def place_sum(value):
        return F.coalesce(F.sum(value.cast("bigint") * F.col("place")), F.lit(0)).cast("bigint")
    return cells.groupBy("epoch", "doc_id").agg(
        F.count(F.lit(1)).alias("n_positions"), F.count("target_id").alias("n_targets"),
        place_sum(F.coalesce("target_id", "input_id")).alias("token_sum"), place_sum(F.col("input_id")).alias("input_sum"),
        place_sum(F.col("target_id")).alias("target_sum"))


# --- Naive Bayes -------------------------------------------------------------

def _weights_long(model):
    ints = {l: i for l, i in zip(model.labels, model.intents)}
    lut = model.counts.sparkSession.createDataFrame(list(ints.items()), "label INT, intent STRING")
    idx = {l: k for k, l in enumerate(model.labels)}
    pos = model.counts.sparkSession.createDataFrame(list(idx.items()), "label INT, k INT")
    w = model.weights
    return (model.counts.join(F.broadcast(lut), "label").join(F.broadcast(pos), "label")
            .join(w, "token")
            .select("token", "intent", F.col("n_tc").cast("bigint"),
                    F.round(F.element_at("w", F.col("k") + 1), 6).alias("log_p")))


def q_nb_weights(spark, sf):
    model, _, _ = _nb(spark, sf)
    return _weights_long(model)


def q_nb_scores(spark, sf):
    model, _, test = _nb(spark, sf)
    lf = long_form(model, score(model, test))
    return lf.select("doc_id", "intent", F.round("score", 4).alias("score"))


def q_nb_proba(spark, sf):
    model, _, test = _nb(spark, sf)
    lf = long_form(model, score(model, test))
    return lf.select("doc_id", "intent", F.round("p", 6).alias("p"))


def _predict_rows(model, test):
    pred = predict(model, score(model, test, keep=["intent"]))   # truth rides along: no join
    return pred.select("doc_id", F.col("intent").alias("true_intent"), "pred_intent",
                       F.round("p_top", 6).alias("p_top"))


def q_nb_predict(spark, sf):
    model, _, test = _nb(spark, sf)
    return _predict_rows(model, test)


def q_background_weights(spark, sf):
    model, _, _ = _nb(spark, sf, background=True)
    return _weights_long(model)


def q_background_predict(spark, sf):
    model, _, test = _nb(spark, sf, background=True)
    return _predict_rows(model, test)


def q_label_width(spark, sf):
    model, _, test = _nb(spark, sf)
    pred = predict(model, score(model, test))
    table = label_table(labelled(spark, sf))
    chk = width_check(pred.select(F.col("pred_label").alias("label")), table)
    return chk.select(F.col("label").cast("bigint"), "problem")


# --- answers -------------------------------------------------------------------

def q_answer_map(spark, sf):
    model, _, _ = _nb(spark, sf)
    msgs = messages(spark, sf)
    a = ans.answer_map(model, score(model, msgs, "msg_id"), "msg_id")
    return ans.answer_long(a, "msg_id").withColumn("p", F.round("p", 6))


def q_answer_json(spark, sf):
    model, _, _ = _nb(spark, sf)
    msgs = messages(spark, sf)
    # rounded for the comparison: the SQL prints k / 10^6 as the JVM does
    return ans.answer_json(ans.answer_map(model, score(model, msgs, "msg_id"), "msg_id", digits=6), "msg_id")


# --- metrics ---------------------------------------------------------------

def _r6(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def q_accuracy(spark, sf):
    *_, j = _test_predictions(spark, sf)
    return _r6(met.accuracy(j), ["accuracy"]).select("accuracy", F.col("n").cast("bigint"))


def q_weighted_prf(spark, sf):
    *_, j = _test_predictions(spark, sf)
    return _r6(met.weighted_prf(j), ["accuracy", "precision", "recall", "f1"])


def _val_batches(j: DataFrame) -> DataFrame:
    """Validation batches have the training size and are shuffled."""
    return shuffled_batches(j.withColumn("epoch", F.lit(0)), "doc_id", TRAIN_BATCH, SEED, "epoch", n_epochs=1)


def q_batch_mean_metrics(spark, sf):
    *_, j = _test_predictions(spark, sf)
    bm = met.batch_mean(_val_batches(j))
    return _r6(bm, ["accuracy", "precision", "recall", "f1"]).select(
        "accuracy", "precision", "recall", "f1", F.col("n_batches").cast("bigint"))


def q_report(spark, sf):
    *_, j = _test_predictions(spark, sf)
    return _r6(met.report(j), ["precision", "recall", "f1"])


def _losses(spark, sf, trained=None):
    model, train, test = trained or _nb(spark, sf)
    out = []
    for name, part in (("validation", test), ("train", train)):
        # written once: the batch ranks read it more than once
        loss = materialize(truth_loss(model, predict(model, score(model, part, keep=["label"]))), "losses")
        out.append(met.mean_loss(_val_batches(loss)).withColumn("part", F.lit(name)))
    return out[0].unionByName(out[1])


def q_mean_loss(spark, sf):
    return _r6(_losses(spark, sf), ["mean_loss"]).select("part", "mean_loss", F.col("n_batches").cast("bigint"))


def q_every10_accuracy(spark, sf):
    model, train, _ = _nb(spark, sf)
    pred = predict(model, score(model, train, keep=["intent"]))
    j = materialize(pred.select("doc_id", F.col("intent").alias("y"), F.col("pred_intent").alias("yhat")),
                    "train-predictions")   # the batch ranks read it twice
    b = shuffled_batches(j.withColumn("epoch", F.lit(0)), "doc_id", TRAIN_BATCH, SEED, "epoch", n_epochs=1)
    return _r6(met.every_n_accuracy(b), ["accuracy"]).select("batch_id", "accuracy", F.col("n").cast("bigint"))


def q_run_summary(spark, sf):
    """One ``(metric, value)`` row per figure of the run."""
    model, train, test, j = _test_predictions(spark, sf)
    names = ["accuracy", "precision", "recall", "f1"]
    whole = met.weighted_prf(j)
    bm = met.batch_mean(_val_batches(j))
    rows = [whole.select(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names]
    rows += [bm.select(F.lit(f"batch_{n}").alias("metric"), F.col(n).alias("value")) for n in names]
    loss = _losses(spark, sf, (model, train, test))
    rows.append(loss.select(F.concat(F.col("part"), F.lit("_loss")).alias("metric"), F.col("mean_loss").alias("value")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select("metric", F.round("value", 6).alias("value"))


def q_test_alignment(spark, sf):
    """E9 as ``evaluate`` has it: the test part against its predictions, counted by the pass that writes the joined rows."""
    model, _, test = _nb(spark, sf)
    pred = predict(model, score(model, test))
    joined, seen = met.aligned(test.select("doc_id", F.col("intent").alias("y")), pred.select("doc_id", F.col("pred_intent").alias("yhat")))
    rows = materialize(joined, "aligned")
    counts = spark.createDataFrame([tuple(seen.get[c] for c in _ALIGNED)], ", ".join(f"{c} bigint" for c in _ALIGNED))
    right = rows.agg(F.count_if(F.col("y") == F.col("yhat")).alias("n_right"))
    return counts.join(F.broadcast(right))      # one row each


_ALIGNED = ("n_matched", "n_truth_only", "n_pred_only", "n_duplicate_keys")


def q_prepared_counts(spark, sf):
    """P4 -> sink: good rows and rejects written by reason in one pass, its counts beside those of the files."""
    from ..operators.clean import drop_missing, normalize_na, select_feature
    from ..session import shared_path
    from .pipeline import write_prepared
    path = shared_path(spark, "prepared")
    rows = select_feature(drop_missing(normalize_na(annotated(spark, sf)), "Translation"), "Original Text")
    seen = write_prepared(rows, path)
    told = spark.createDataFrame([("ok", seen["n_good"]), ("feature", seen["n_feature"]), ("label", seen["n_label"])],
                                 "reason STRING, n_counted BIGINT")
    back = spark.read.schema("doc_id BIGINT, text STRING, intent STRING, reason STRING").parquet(path)
    found = back.groupBy("reason").agg(F.count(F.lit(1)).alias("n_written"), F.sum("doc_id").alias("id_sum"))
    return told.join(found, "reason", "left").select(
        "reason", "n_counted", F.coalesce("n_written", F.lit(0)).cast("bigint").alias("n_written"), "id_sum")


def q_pred_alignment(spark, sf):
    *_, j = _test_predictions(spark, sf)
    return met.alignment(labelled(spark, sf), j)


QUERIES = {
    "label_map": q_label_map,
    "class_stats": q_class_stats,
    "label_roundtrip": q_label_roundtrip,
    "feature_filter": q_feature_filter,
    "prepared_labelled": q_prepared_labelled,
    "prepared_scored": q_prepared_scored,
    "corpus_lines": q_corpus_lines,
    "split_stratified": q_split_stratified,
    "split_random": q_split_random,
    "split_three_way": q_split_three_way,
    "batches_shuffled": q_batches_shuffled,
    "batches_epochs": q_batches_epochs,
    "batches_ordered": q_batches_ordered,
    "step_counts": q_step_counts,
    "tokens": q_tokens,
    "vocab_topk": q_vocab_topk,
    "encoded_padded": q_encoded_padded,
    "mlm_mask": q_mlm_mask,
    "mlm_epochs": q_mlm_epochs,
    "mlm_epoch_file": q_mlm_epoch_file,
    "nb_weights": q_nb_weights,
    "nb_scores": q_nb_scores,
    "nb_proba": q_nb_proba,
    "nb_predict": q_nb_predict,
    "background_weights": q_background_weights,
    "background_predict": q_background_predict,
    "label_width": q_label_width,
    "answer_map": q_answer_map,
    "answer_json": q_answer_json,
    "accuracy": q_accuracy,
    "weighted_prf": q_weighted_prf,
    "batch_mean_metrics": q_batch_mean_metrics,
    "report": q_report,
    "mean_loss": q_mean_loss,
    "every10_accuracy": q_every10_accuracy,
    "run_summary": q_run_summary,
    "pred_alignment": q_pred_alignment,
    "test_alignment": q_test_alignment,
    "prepared_counts": q_prepared_counts,
}


# --- ML pipeline, pluggable model, stream, files -------------------------------

def q_lr_predict(spark, sf):
    """M2: softmax on hashed counts, fitted on the training part by a fixed number of gradient steps, top-1 on the held-out part."""
    from ..operators import softmax
    train, test = _parts(spark, sf)
    pred = softmax.predict(softmax.fit(train), test, ["doc_id"])
    lut = table_from_counts(spark, class_counts(labelled_keys(spark, sf)))
    out = pred.join(F.broadcast(lut.withColumnRenamed("label", "pred_label")), "pred_label", "left")
    return out.select("doc_id", F.col("intent").alias("pred_intent"), F.round("p_top", 6).alias("p_top"))


def q_lr_coverage(spark, sf):
    """M2 held to figures SQL can state: every held-out row answered once, with a known intent and a
    probability, and more of them right than by always naming the biggest training class."""
    from ..operators import softmax
    train, test = _parts(spark, sf)
    pred = softmax.predict(softmax.fit(train), test, ["doc_id"])
    table = table_from_counts(spark, class_counts(labelled_keys(spark, sf)))
    biggest = max(class_counts(train, "label"), key=lambda r: (r[1], -r[0]))[0] if not train.isEmpty() else None
    j = (test.select("doc_id", "label").join(pred, "doc_id", "full_outer")
         .join(F.broadcast(table.select(F.col("label").alias("pred_label"), F.col("intent").alias("known"))),
               "pred_label", "left"))
    right = F.sum((F.col("pred_label") == F.col("label")).cast("bigint"))
    plain = F.sum((F.col("label") == F.lit(biggest)).cast("bigint"))
    return j.agg(F.count("label").alias("n_rows"), F.countDistinct("doc_id").alias("n_ids"),
                 F.count("known").alias("n_known"),
                 F.sum(F.col("p_top").between(0, 1).cast("bigint")).alias("n_probabilities"),
                 (right > plain).cast("bigint").alias("beats_biggest_class"))


def _chunk_scores(spark, sf):
    """M8: encoded held-out chunks scored in Arrow batches of 128 by a NumPy model."""
    from ..operators.plug import nb_additive, score_additive
    model, _, test = _nb(spark, sf)
    enc = materialize(encode_texts(test, model.vocabulary(), "doc_id", "text", pad_to="max_len"), "encoded")
    return model, score_additive(enc, nb_additive(model), width=250, batch_size=INFER_BATCH)


def q_plug_predict(spark, sf):
    """M8: one answer per held-out message, its chunk scores summed."""
    from ..operators.plug import score_messages
    model, chunks = _chunk_scores(spark, sf)
    out = score_messages(chunks, model.log_prior)
    ints = F.array(*[F.lit(x) for x in model.intents])
    return out.select("doc_id", F.element_at(ints, F.col("pred_index") + 1).alias("pred_intent"),
                      F.round("p_top", 6).alias("p_top"))


def q_plug_score(spark, sf):
    """M8 per chunk."""
    model, out = _chunk_scores(spark, sf)
    ints = F.array(*[F.lit(x) for x in model.intents])
    return out.select("doc_id", "chunk", F.element_at(ints, F.col("pred_index") + 1).alias("pred_intent"))


def q_stream_score(spark, sf):
    """ST1: the conversations file answered by a Structured Streaming query.

    Returns ``(msg_id, intent, p)`` parsed from the JSON the stream wrote, so
    it is checked against the same SQL as the batch answers (``answer_map``).
    """
    from ..session import shared_path
    from ..streaming.score_stream import message_stream, read_answers, start_answering
    model, _, _ = _nb(spark, sf)
    out, ckpt = shared_path(spark, "answers"), shared_path(spark, "answers-ckpt")
    q = start_answering(model, message_stream(spark, f"{sf.rstrip('/')}/conversations.parquet"), out, ckpt)
    q.awaitTermination()
    # the streamed JSON answers, read back in long form
    return ans.parse_json(read_answers(spark, out), "msg_id").select("msg_id", "intent", F.round("p", 6).alias("p"))


def q_csv_roundtrip(spark, sf):
    """K1 -> S4: the label map written as CSV and read back."""
    from ..session import shared_path
    from ..sinks.files import write_label_map
    from ..sources.files import read_label_map
    path = shared_path(spark, "label-map")
    write_label_map(label_map(labelled(spark, sf)), path)
    back = read_label_map(spark, path)
    return back.select("intent", F.col("corresponding_label").cast("bigint"))


def q_split_roundtrip(spark, sf):
    """K2 -> S2: the split written as CSV (one folder per part) and read back."""
    from ..session import shared_path
    from ..sinks.files import write_split
    from ..sources.files import read_split
    path = shared_path(spark, "split-csv")
    write_split(with_text(spark, sf, _split(spark, sf)), path, fmt="csv")
    out = []
    for part in ("train", "test"):
        out.append(read_split(spark, f"{path}/part={part}").withColumn("part", F.lit(part)))
    both = out[0].unionByName(out[1])
    return both.select("doc_id", F.col("label").cast("bigint"), "part",
                       F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


def q_model_roundtrip(spark, sf):
    """K5 -> S5: the model saved as version 0, reloaded, used for top-1 on the held-out part."""
    from ..session import shared_path
    from ..sinks.files import load_model, save_model
    model, _, test = _nb(spark, sf)
    root = save_model(model, shared_path(spark, "model"), version=0)
    return _predict_rows(load_model(spark, root), test)


def q_model_latest(spark, sf):
    """Versions 0 and 1 committed, version 2 torn (its tables are there, its commit is not); ``latest`` is version 1."""
    from ..session import shared_path
    from ..sinks.files import load_model, save_model
    model, _, test = _nb(spark, sf)
    path = shared_path(spark, "models")
    for version in (0, 1):
        save_model(model, path, version=version, keep_last=2)
    model.weights.limit(1).write.parquet(f"{path}/version=2/attempt-torn/weights")
    return _predict_rows(load_model(spark, path, version="latest", check=True), test)


def q_run_table(spark, sf):
    """The run table after version 0 was run twice and version 1 once: one row per version."""
    from ..session import shared_path
    from ..sinks.files import read_runs, write_run
    *_, j = _test_predictions(spark, sf)
    figures = materialize(met.weighted_prf(j), "run-figures")
    path = shared_path(spark, "runs")
    for version in (0, 1, 0):
        write_run(figures.withColumn("version", F.lit(version)), path)
    runs = read_runs(spark, path)
    return _r6(runs, ["accuracy", "precision", "recall", "f1"]).select(
        F.col("version").cast("bigint"), "accuracy", "precision", "recall", "f1")


def q_annotated_csv(spark, sf):
    """S1 -> P2 -> P1 -> P4: the annotated shape written as multi-line CSV, read back, cleaned."""
    from ..session import shared_path
    from ..sinks.files import write_annotated
    from ..sources.files import read_annotated
    path = shared_path(spark, "annotated-csv")
    write_annotated(annotated(spark, sf), path)
    t = feature_table(read_annotated(spark, path))
    return t.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "intent", "status")


def q_corpus_file_lines(spark, sf):
    """S3 -> P3: the unlabelled texts written as a line file, read back line by line.

    ``n_keys`` counts the distinct ``(file, line_no, piece)`` keys of a line: as many as its rows.
    """
    from ..session import shared_path
    from ..sinks.files import write_lines
    from ..sources.files import read_corpus
    path = shared_path(spark, "corpus-txt")
    write_lines(unlabelled(spark, sf), path)
    lines = read_corpus(spark, path)
    one_per_key = lines.groupBy("file", "line_no", "piece").agg(F.first("value").alias("line"),
                                                                F.count(F.lit(1)).alias("_rows"))
    return one_per_key.groupBy("line").agg(F.sum("_rows").alias("n"), F.count(F.lit(1)).alias("n_keys"))


def q_predictions_csv(spark, sf):
    """K3: held-out predictions written as CSV ``doc_id,predicted_label`` and read back."""
    from ..session import shared_path
    from ..sinks.files import write_predictions
    model, _, test = _nb(spark, sf)
    path = shared_path(spark, "predictions-csv")
    write_predictions(predict(model, score(model, test)), path, fmt="csv")
    back = spark.read.schema("doc_id BIGINT, predicted_label INT").option("header", True).csv(path)
    return back.select("doc_id", F.col("predicted_label").cast("bigint"))


def q_answers_file(spark, sf):
    """K4: JSON answers for every message written as JSON lines, read back in long form."""
    from ..session import shared_path
    from ..sinks.files import write_answers
    model, _, _ = _nb(spark, sf)
    path = shared_path(spark, "answers-json")
    write_answers(ans.answer_json(ans.answer_map(model, score(model, messages(spark, sf), "msg_id"), "msg_id"),
                                  "msg_id"), path)
    back = spark.read.schema("msg_id STRING, json STRING").json(path)
    return ans.parse_json(back, "msg_id").select("msg_id", "intent", F.round("p", 6).alias("p"))


QUERIES.update({
    "predictions_csv": q_predictions_csv,
    "answers_file": q_answers_file,
    "annotated_csv": q_annotated_csv,
    "corpus_file_lines": q_corpus_file_lines,
    "lr_predict": q_lr_predict,
    "lr_coverage": q_lr_coverage,
    "plug_predict": q_plug_predict,
    "plug_score": q_plug_score,
    "stream_score": q_stream_score,
    "csv_roundtrip": q_csv_roundtrip,
    "split_roundtrip": q_split_roundtrip,
    "model_roundtrip": q_model_roundtrip,
    "model_latest": q_model_latest,
    "run_table": q_run_table,
})
