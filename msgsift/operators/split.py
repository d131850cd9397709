"""Exact, reproducible stratified and random splits.

Quotas follow the stratified-split rule: ``n_test = ceil(share * n)`` (in
double arithmetic), train quota per class ``floor(n_c * n_train / n)`` plus one
for the classes with the largest remainder ``(n_c * n_train) mod n`` (ties by
intent). Membership is decided by a per-row md5 key salted with the seed, so
it depends neither on partitioning nor on input order. ``sampleBy`` and
``randomSplit`` are approximate and partition-dependent, so they are not used.

A row is in training when its ``(key, id)`` is at most the class's *cut*:
the ``(key, id)`` of the quota-th row in key order. The cut is found without
moving the rows: a histogram of ``(class, key bucket)`` counts (partially
aggregated, at most ``classes x 2^bits`` rows) names the one bucket per class
that holds the cut, and only that bucket's ``(key, id)`` pairs are ranked.
Every row is then classified by a broadcast compare with its class's cut
(one row per class), so the texts are never shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import HELD_OUT_SHARE, SEED
from ..functions.keys import hash_key
from ..functions.keys import hash_bucket
from .labels import class_counts as count_classes
from .ranking import DEFAULT_BITS


def class_quotas(class_counts: DataFrame, label_col: str, test_share: float = HELD_OUT_SHARE) -> DataFrame:
    """``(label_col, n_c, n_train_c)`` from a class-count table (one row per class)."""
    w_all = Window.partitionBy(F.lit(1))
    c = (class_counts
         .withColumn("_n", F.sum("n_c").over(w_all))
         .withColumn("_n_test", F.ceil(F.lit(float(test_share)) * F.col("_n").cast("double")).cast("bigint"))
         .withColumn("_n_train", F.col("_n") - F.col("_n_test"))
         .withColumn("_base", F.expr("(n_c * _n_train) div _n"))
         .withColumn("_rem", F.pmod(F.col("n_c") * F.col("_n_train"), F.col("_n")))
         .withColumn("_extra", F.col("_n_train") - F.sum("_base").over(w_all)))
    w_rem = Window.orderBy(F.desc("_rem"), F.asc(label_col))
    c = c.withColumn("_r", F.row_number().over(w_rem))
    return c.select(label_col, "n_c",
                    (F.col("_base") + F.when(F.col("_r") <= F.col("_extra"), 1).otherwise(0))
                    .cast("bigint").alias("n_train_c"))


def cut_keys(keyed: DataFrame, quota, group: list[str], id_col: str, key_col: str = "_k",
             bits: int = DEFAULT_BITS) -> DataFrame:
    """``(*group, _ck, _cid)``: the ``(key, id)`` of the ``quota``-th row of each group
    in ``(key, id)`` order. ``quota`` is a DataFrame ``(*group, _q)`` (one row per
    group) or, with no group, an int or a function of the total row count
    (a Column). Groups with quota 0 get no row.
    """
    g = list(group)
    b = keyed.select(*g, hash_bucket(F.col(key_col), bits).alias("_b"))
    hist = b.groupBy(*g, "_b").agg(F.count(F.lit(1)).alias("_n"))    # <= groups x 2^bits rows
    w = (Window.partitionBy(*g) if g else Window.partitionBy(F.lit(0))).orderBy("_b")
    cum = hist.withColumn("_after", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if g:
        cum = cum.join(F.broadcast(quota), g)                       # one row per group
    elif callable(quota):   # quota from the total row count, read off the histogram
        total = F.sum("_n").over(Window.partitionBy(F.lit(0)))
        cum = cum.withColumn("_q", quota(total).cast("bigint"))
    else:
        cum = cum.withColumn("_q", F.lit(int(quota)).cast("bigint"))
    before = F.col("_after") - F.col("_n")
    cut = (cum.where((before < F.col("_q")) & (F.col("_q") <= F.col("_after")))
           .select(*g, "_b", (F.col("_q") - before).alias("_need")))  # one row per group
    rows = (keyed.select(*g, key_col, id_col).withColumn("_b", hash_bucket(F.col(key_col), bits))
            .join(F.broadcast(cut), g + ["_b"]))                    # rows of the cut buckets only
    wr = Window.partitionBy(*g, "_b").orderBy(key_col, id_col)
    return (rows.withColumn("_r", F.row_number().over(wr)).where(F.col("_r") == F.col("_need"))
            .select(*g, F.col(key_col).alias("_ck"), F.col(id_col).alias("_cid")))


def _below_cut(key_col: str, id_col: str) -> Column:
    """``(key, id) <= (cut key, cut id)``; false when the group has no cut (quota 0)."""
    k, i = F.col(key_col), F.col(id_col)
    return F.coalesce((k < F.col("_ck")) | ((k == F.col("_ck")) & (i <= F.col("_cid"))), F.lit(False))


def stratified_split(df: DataFrame, label_col: str = "intent", id_col: str = "doc_id",
                     test_share: float = HELD_OUT_SHARE, seed: int = SEED,
                     on_singleton: str = "error", bits: int = DEFAULT_BITS,
                     part_col: str = "part", class_counts: list[tuple] | None = None) -> DataFrame:
    """Add ``part`` = 'train' | 'test' with exact per-class quotas.

    ``class_counts`` (``[(label, n)]``, one per class) may be passed when the
    caller already counted the classes; otherwise one small job counts them.

    A class with one row cannot be stratified: ``on_singleton="error"``
    raises, ``"train"`` puts it in the training part and leaves it out of the
    quota arithmetic.
    """
    if class_counts is None:   # one row per class
        class_counts = count_classes(df, label_col)
    counts = df.sparkSession.createDataFrame([(k, int(n)) for k, n in class_counts],
                                             f"`{label_col}` STRING, n_c BIGINT")
    n_single = sum(1 for _, n in class_counts if n == 1)
    if n_single and on_singleton == "error":
        raise ValueError(f"{n_single} class(es) have a single row; a stratified split needs at least 2 "
                         "(use on_singleton='train')")
    if on_singleton not in ("error", "train"):
        raise ValueError(f"on_singleton must be 'error' or 'train', not {on_singleton!r}")
    # each side must hold at least one row per (stratified) class
    strata = [int(n) for _, n in class_counts if n > 1]
    n_all = sum(strata)
    n_test = math.ceil(float(test_share) * float(n_all)) if n_all else 0
    for side, size in (("train", n_all - n_test), ("test", n_test)):
        if strata and size < len(strata):
            raise ValueError(f"the {side} part would have {size} rows, fewer than the {len(strata)} classes")
    multi = class_quotas(counts.where(F.col("n_c") > 1), label_col, test_share)
    single = counts.where(F.col("n_c") == 1).select(label_col, "n_c", F.col("n_c").alias("n_train_c"))
    quotas = multi.unionByName(single).select(label_col, F.col("n_train_c").alias("_q"))

    keyed = df.withColumn("_k", hash_key(seed, F.col(id_col)))
    cuts = cut_keys(keyed, quotas, [label_col], id_col, "_k", bits)
    out = keyed.join(F.broadcast(cuts), label_col, "left")          # one row per class: bounded
    return (out.withColumn(part_col, F.when(_below_cut("_k", id_col), F.lit("train")).otherwise(F.lit("test")))
            .drop("_k", "_ck", "_cid"))


def random_split(df: DataFrame, id_col: str = "doc_id", test_share: float = HELD_OUT_SHARE,
                 seed: int = 0, bits: int = DEFAULT_BITS, part_col: str = "part") -> DataFrame:
    """One stratum; the ``ceil(share * n)`` rows with the largest keys are held out.

    ``n`` is read off the bucket histogram, so there is no separate count pass.
    """
    keyed = df.withColumn("_k", hash_key(seed, F.col(id_col)))
    share = float(test_share)

    def n_train(n):
        return n - F.ceil(F.lit(share) * n.cast("double"))

    row = cut_keys(keyed, n_train, [], id_col, "_k", bits).first()   # at most one row
    if row is None:
        train = F.lit(False)
    else:
        k, i = F.col("_k"), F.col(id_col)
        train = (k < F.lit(row["_ck"])) | ((k == F.lit(row["_ck"])) & (i <= F.lit(row["_cid"])))
    return keyed.withColumn(part_col, F.when(train, F.lit("train")).otherwise(F.lit("test"))).drop("_k")


def three_way_split(df: DataFrame, label_col: str = "intent", id_col: str = "doc_id",
                    test_share: float = HELD_OUT_SHARE, val_share: float = HELD_OUT_SHARE,
                    seed: int = SEED, on_singleton: str = "error", bits: int = DEFAULT_BITS,
                    part_col: str = "part") -> DataFrame:
    """Optional third part: ``train`` / ``validation`` / ``test``.

    The project validates each epoch on the same part it later evaluates on;
    here the test part is split off first (exact per-class quotas), then
    ``val_share`` of the remaining training rows become ``validation`` by a
    second stratified split salted with ``seed + 1``.
    """
    first = stratified_split(df, label_col, id_col, test_share, seed, on_singleton, bits, "_p1")
    train = first.where(F.col("_p1") == "train").drop("_p1")
    counts = count_classes(train, label_col)
    second = stratified_split(train, label_col, id_col, val_share, seed + 1, on_singleton, bits, "_p2",
                              class_counts=counts)
    rest = second.withColumn(part_col, F.when(F.col("_p2") == "test", F.lit("validation"))
                             .otherwise(F.lit("train"))).drop("_p2")
    test = first.where(F.col("_p1") == "test").drop("_p1").withColumn(part_col, F.lit("test"))
    return rest.unionByName(test)
