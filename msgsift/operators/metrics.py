"""Accuracy, weighted precision/recall/F1, reports, losses, alignment.

Everything starts from confusion counts ``groupBy(*group, y, yhat).count()``:
a partial aggregate over the prediction rows whose output is at most
``groups x classes^2`` rows, so the per-class and summary steps are small.
Classes are the union of true and predicted labels; empty denominators give 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import EVERY_N_BATCHES, LOG_FLOOR


def _div(a, b):
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def confusion(pred: DataFrame, y: str = "y", yhat: str = "yhat", group: list[str] | None = None) -> DataFrame:
    """``(*group, y, yhat, n)``."""
    g = list(group or [])
    return pred.groupBy(*g, y, yhat).agg(F.count(F.lit(1)).alias("n"))


def per_class(pred: DataFrame, y: str = "y", yhat: str = "yhat", group: list[str] | None = None) -> DataFrame:
    """``(*group, cls, tp, support, predicted, precision, recall, f1)``."""
    g = list(group or [])
    conf = confusion(pred, y, yhat, g)
    truth = conf.select(*g, F.col(y).alias("cls"), F.col("n").alias("support"),
                        F.when(F.col(y) == F.col(yhat), F.col("n")).otherwise(0).alias("tp"),
                        F.lit(0).cast("bigint").alias("predicted"))
    guess = conf.select(*g, F.col(yhat).alias("cls"), F.lit(0).cast("bigint").alias("support"),
                        F.lit(0).cast("bigint").alias("tp"), F.col("n").alias("predicted"))
    sides = truth.unionByName(guess).groupBy(*g, "cls").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    p = _div(F.col("tp"), F.col("predicted"))
    r = _div(F.col("tp"), F.col("support"))
    return (sides.withColumn("precision", p).withColumn("recall", r)
            .withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                     2 * F.col("precision") * F.col("recall") /
                                     (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))))


def weighted(pc: DataFrame, group: list[str] | None = None) -> DataFrame:
    """E2/E4 from per-class rows: support-weighted precision, recall, F1 and accuracy."""
    g = list(group or [])
    tot = F.sum("support")
    return pc.groupBy(*g).agg(
        _div(F.sum("tp"), tot).alias("accuracy"),
        _div(F.sum(F.col("precision") * F.col("support")), tot).alias("precision"),
        _div(F.sum(F.col("recall") * F.col("support")), tot).alias("recall"),
        _div(F.sum(F.col("f1") * F.col("support")), tot).alias("f1"))


def accuracy(pred: DataFrame, y: str = "y", yhat: str = "yhat", group: list[str] | None = None) -> DataFrame:
    """E1."""
    g = list(group or [])
    return pred.groupBy(*g).agg(F.avg((F.col(y) == F.col(yhat)).cast("double")).alias("accuracy"),
                                F.count(F.lit(1)).alias("n"))


def weighted_prf(pred: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """E2/E4 over the whole set."""
    return weighted(per_class(pred, y, yhat))


def batch_mean(pred: DataFrame, y: str = "y", yhat: str = "yhat", batch_col: str = "batch_id") -> DataFrame:
    """E1/E2 per batch, then the unweighted mean over batches."""
    per_batch = weighted(per_class(pred, y, yhat, [batch_col]), [batch_col])
    return per_batch.agg(F.avg("accuracy").alias("accuracy"), F.avg("precision").alias("precision"),
                         F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                         F.count(F.lit(1)).alias("n_batches"))


def report(pred: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """E5: per class ``(label, precision, recall, f1, support)``, then rows
    ``accuracy`` (f1 = accuracy), ``macro avg`` and ``weighted avg``."""
    pc = per_class(pred, y, yhat)
    rows = pc.select(F.col("cls").cast("string").alias("label"), "precision", "recall", "f1",
                     F.col("support").cast("bigint").alias("support"))
    acc = pc.agg(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), _div(F.sum("tp"), F.sum("support")).alias("f1"),
                 F.sum("support").cast("bigint").alias("support"))
    macro = pc.agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                   F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                   F.sum("support").cast("bigint").alias("support"))
    tot = F.sum("support")
    wavg = pc.agg(F.lit("weighted avg").alias("label"),
                  _div(F.sum(F.col("precision") * F.col("support")), tot).alias("precision"),
                  _div(F.sum(F.col("recall") * F.col("support")), tot).alias("recall"),
                  _div(F.sum(F.col("f1") * F.col("support")), tot).alias("f1"),
                  tot.cast("bigint").alias("support"))
    return rows.unionByName(acc).unionByName(macro).unionByName(wavg)


def truth_probability(proba_long: DataFrame, truth: DataFrame, id_col: str = "doc_id",
                      label_col: str = "label") -> DataFrame:
    """``(id, label, p_true)``: a LEFT join, so a true class the model never saw
    keeps its row with ``p = LOG_FLOOR`` instead of disappearing."""
    p = proba_long.select(id_col, label_col, "p")
    return (truth.select(id_col, label_col).join(p, [id_col, label_col], "left")
            .withColumn("p_true", F.greatest(F.coalesce(F.col("p"), F.lit(LOG_FLOOR)), F.lit(LOG_FLOOR)))
            .drop("p"))


def mean_loss(rows: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """Cross-entropy per batch, summed over batches / number of batches, from a ``loss`` (or ``p_true``) column."""
    loss = F.col("loss") if "loss" in rows.columns else -F.log(F.col("p_true"))
    per_batch = rows.groupBy(batch_col).agg(F.avg(loss).alias("loss"))
    return per_batch.agg(F.avg("loss").alias("mean_loss"), F.count(F.lit(1)).alias("n_batches"))


def every_n_accuracy(pred: DataFrame, y: str = "y", yhat: str = "yhat", batch_col: str = "batch_id",
                     every: int = EVERY_N_BATCHES) -> DataFrame:
    """Accuracy of batches ``k`` with ``k % every == 0 and k > 0``."""
    sel = pred.where((F.col(batch_col) % every == 0) & (F.col(batch_col) > 0))
    return accuracy(sel, y, yhat, [batch_col])


def aligned(truth: DataFrame, pred: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, Observation]:
    """E9 in the pass that joins truth and predictions: the full outer join, and its counts.

    The counts (``n_matched``, ``n_truth_only``, ``n_pred_only``, ``n_duplicate_keys``
    as in :func:`alignment`) come with the first action on the joined rows,
    without a job of their own. A key that is there twice on one side gives
    a row per pair and counts once.
    """
    t = truth.withColumn("_tn", F.count(F.lit(1)).over(Window.partitionBy(id_col)))
    p = pred.withColumn("_pn", F.count(F.lit(1)).over(Window.partitionBy(id_col)))
    seen = Observation()
    # of the rows of a key, each side's number times the other's, one is counted
    share = 1.0 / (F.coalesce("_tn", F.lit(1)) * F.coalesce("_pn", F.lit(1)))
    both = F.col("_tn").isNotNull() & F.col("_pn").isNotNull()

    def keys(cond):
        return F.coalesce(F.round(F.sum(F.when(cond, share))), F.lit(0.0)).cast("bigint")
    # a key of one side only has as many rows as it occurs times
    joined = t.join(p, id_col, "full_outer").observe(
        seen, keys(both).alias("n_matched"), keys(F.col("_pn").isNull()).alias("n_truth_only"),
        keys(F.col("_tn").isNull()).alias("n_pred_only"),
        keys((F.col("_tn") > 1) | (F.col("_pn") > 1)).alias("n_duplicate_keys"))
    return joined.drop("_tn", "_pn"), seen


def alignment(truth: DataFrame, pred: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Matched / truth-only / prediction-only counts, and duplicate keys."""
    t = truth.select(id_col).withColumn("_t", F.lit(1))
    p = pred.select(id_col).withColumn("_p", F.lit(1))
    tc = t.groupBy(id_col).agg(F.count(F.lit(1)).alias("_tn"))
    pc = p.groupBy(id_col).agg(F.count(F.lit(1)).alias("_pn"))
    j = tc.join(pc, id_col, "full_outer")
    return j.agg(
        F.sum(F.when(F.col("_tn").isNotNull() & F.col("_pn").isNotNull(), 1).otherwise(0)).cast("bigint")
        .alias("n_matched"),
        F.sum(F.when(F.col("_pn").isNull(), 1).otherwise(0)).cast("bigint").alias("n_truth_only"),
        F.sum(F.when(F.col("_tn").isNull(), 1).otherwise(0)).cast("bigint").alias("n_pred_only"),
        F.sum(F.when((F.col("_tn") > 1) | (F.col("_pn") > 1), 1).otherwise(0)).cast("bigint")
        .alias("n_duplicate_keys"))
