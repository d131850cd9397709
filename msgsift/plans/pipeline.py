"""P7 and the end-to-end flows: train, evaluate, answer.

The project's scripts hand over through files; here each flow is a function
over DataFrames that writes its outputs to explicit paths (parquet by
default). Between stages the split and the predictions are materialised in
the shared checkpoint folder, so a lost executor re-reads them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import TriageConfig
from ..operators import metrics as met
from ..operators.answers import answer_json, answer_map
from ..operators.batching import shuffled_batches
from ..operators.clean import counted, drop_missing, normalize_na, select_feature, validate
from ..operators.labels import class_counts, encode, label_map, table_from_counts
from ..operators.naive_bayes import NBModel, predict, score, train_nb, truth_loss
from ..operators.split import stratified_split, three_way_split
from ..session import materialize
from ..sinks.files import load_model, save_model, write_answers, write_label_map, write_predictions, write_run, write_split


def prepare_labelled(raw: DataFrame, feature: str = "Original Text", required_col: str = "Translation",
                     on_bad: str = "error") -> DataFrame | tuple[DataFrame, DataFrame]:
    """P2 -> P1 -> P4 on the annotated shape: ``(doc_id, text, intent)``.

    ``on_bad="quarantine"`` gives ``(good, rejected)``, the rejects with their ``reason``.
    """
    return validate(select_feature(drop_missing(normalize_na(raw), required_col), feature), on_bad=on_bad)


def prepare_scored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   on_bad: str = "error") -> DataFrame | tuple[DataFrame, DataFrame]:
    """Messages to score, ``(id, text)``; a null text is rejected, an empty one stays.

    ``on_bad`` as in :func:`prepare_labelled`.
    """
    return validate(df.select(id_col, F.col(text_col).alias("text")), "text", None, on_bad=on_bad, allow_empty=True)


def write_prepared(rows: DataFrame, path: str, text_col: str = "text", label_col: str | None = "intent",
                   allow_empty: bool = False) -> dict[str, int]:
    """P4 -> a table partitioned by ``reason`` (``ok`` or why a row is rejected), in one pass.

    Returns the counts of :func:`operators.clean.counted`, gathered by the write.
    """
    tagged, seen = counted(rows, text_col, label_col, allow_empty)
    (tagged.withColumn("reason", F.coalesce("reason", F.lit("ok")))
     .write.mode("overwrite").partitionBy("reason").parquet(path))
    return seen.get


def _val_batches(df: DataFrame, cfg: TriageConfig) -> DataFrame:
    """Validation batches have the training size and are shuffled."""
    return shuffled_batches(df.withColumn("epoch", F.lit(0)), "doc_id", cfg.train_batch, cfg.seed, "epoch", n_epochs=1)


@dataclass
class TrainResult:
    model: NBModel
    split: DataFrame
    label_map: DataFrame
    metrics: DataFrame
    model_path: str | None


def train(labelled: DataFrame, cfg: TriageConfig = TriageConfig(), out_dir: str | None = None,
          background: DataFrame | None = None, version: int = 0) -> TrainResult:
    """S1..K5: label map, split, model, validation metrics (one row), saved model."""
    spark = labelled.sparkSession
    counts = class_counts(labelled)
    lm = label_map(labelled)
    enc = encode(labelled, table_from_counts(spark, counts), bounded=True)
    if cfg.val_share:
        split = materialize(three_way_split(enc, test_share=cfg.test_share, val_share=cfg.val_share,
                                            seed=cfg.seed, on_singleton=cfg.on_singleton), "split")
        tr, te = split.where("part = 'train'"), split.where("part = 'validation'")
    else:
        split = materialize(stratified_split(enc, seed=cfg.seed, test_share=cfg.test_share,
                                             on_singleton=cfg.on_singleton, class_counts=counts), "split")
        tr, te = split.where("part = 'train'"), split.where("part = 'test'")
    model = train_nb(tr, min_df=cfg.min_df, max_vocab=cfg.max_vocab, smoothing=cfg.smoothing,
                     background=background, mu=cfg.background_mu)
    pred = materialize(predict(model, score(model, te, keep=["intent", "label"], lookup_bytes=cfg.lookup_bytes)),
                       "val-pred")
    j = pred.select("doc_id", F.col("intent").alias("y"), "label", F.col("pred_intent").alias("yhat"))
    whole = met.weighted_prf(j)
    batch = met.batch_mean(_val_batches(j, cfg)).select(
        *[F.col(c).alias(f"batch_{c}") for c in ("accuracy", "precision", "recall", "f1")])
    loss = met.mean_loss(_val_batches(truth_loss(model, pred), cfg)).select(F.col("mean_loss").alias("val_loss"))
    metrics = (whole.withColumn("_k", F.lit(1)).join(batch.withColumn("_k", F.lit(1)), "_k")
               .join(loss.withColumn("_k", F.lit(1)), "_k").drop("_k")
               .withColumn("version", F.lit(version)))   # one-row aggregates joined on a constant key
    path = None
    if out_dir:
        write_label_map(lm, f"{out_dir}/intent_label_relation")
        write_split(split, f"{out_dir}/split")
        path = save_model(model, f"{out_dir}/model", version=version)
        write_run(metrics, f"{out_dir}/metrics")
    return TrainResult(model, split, lm, metrics, path)


def evaluate(spark: SparkSession, model_path: str, test: DataFrame, out_dir: str | None = None) -> DataFrame:
    """S2, S5 -> M4 -> T11 -> E9 -> E5 -> K3: the classification report."""
    model = load_model(spark, model_path)
    pred = materialize(predict(model, score(model, test)), "eval-pred")
    if out_dir:
        write_predictions(pred, f"{out_dir}/predicted_label_on_test")
    lut = spark.createDataFrame(list(zip(model.labels, model.intents)), "label INT, intent STRING")
    truth = test.join(F.broadcast(lut), "label", "left").select("doc_id", F.col("intent").alias("y"), F.lit(True).alias("there"))
    # Every test row has its prediction and no other; counted by the pass that writes the joined rows
    j, seen = met.aligned(truth, pred.select("doc_id", F.col("pred_intent").alias("yhat")))
    strange = Observation()
    j = materialize(j.observe(strange, F.count_if(F.col("there") & F.col("y").isNull()).alias("n")).drop("there"), "eval-joined")
    if strange.get["n"]:
        raise ValueError(f"the test part has a label the model does not know ({strange.get['n']} rows)")
    if seen.get["n_truth_only"] or seen.get["n_pred_only"]:
        raise ValueError(f"test rows and predictions do not align: {seen.get}")
    return met.report(j)


def answer(spark: SparkSession, model_path: str, messages: DataFrame, out_dir: str | None = None,
           id_col: str = "doc_id", on_bad: str = "error") -> DataFrame:
    """S4/S5 -> P7 -> T7 -> M5 -> M6 -> M7 -> K4: JSON answers for every message with a text.

    A null text fails the job, or with ``on_bad="quarantine"`` gets no
    answer and is written, with its reason, under ``<out_dir>/rejected``.
    """
    model = load_model(spark, model_path)
    ready = prepare_scored(messages, id_col, on_bad=on_bad)
    rejected = None
    if on_bad == "quarantine":
        ready, rejected = ready
    out = answer_json(answer_map(model, score(model, ready, id_col), id_col), id_col)
    if out_dir:
        write_answers(out, f"{out_dir}/answers")
        if rejected is not None:
            rejected.write.mode("overwrite").parquet(f"{out_dir}/rejected")
    return out
