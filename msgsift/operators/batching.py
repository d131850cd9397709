"""Shuffled and ordered fixed-size batches, step counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SEED, TRAIN_BATCH
from ..functions.keys import hash_key
from ..session import materialize
from .ranking import DEFAULT_BITS, hash_rank, ordered_rank


FEISTEL_ROUNDS = 6


def with_epochs(df: DataFrame, epochs: int, epoch_col: str = "epoch") -> DataFrame:
    """One copy of each row per epoch (a per-row generator, no join)."""
    return df.withColumn(epoch_col, F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


def shuffled_batches(df: DataFrame, id_col: str = "doc_id", size: int = TRAIN_BATCH,
                     seed: int = SEED, epoch_col: str | None = None,
                     bits: int = DEFAULT_BITS, n_epochs: int | None = None) -> DataFrame:
    """Order by md5(seed, epoch, id), cut into batches of ``size``.

    Adds ``batch_id`` and ``batch_pos``; a new order per epoch when
    ``epoch_col`` is given. The last batch may be short. ``n_epochs`` (the
    number of distinct epochs) bounds the bucket-offset table so it can be
    broadcast.
    """
    parts = [F.col(epoch_col), F.col(id_col)] if epoch_col else [F.col(id_col)]
    keyed = df.withColumn("_k", hash_key(seed, *parts))
    group = [epoch_col] if epoch_col else None
    ranked = hash_rank(keyed, "_k", id_col, group, "_rank", bits, n_epochs if epoch_col else None)
    return _cut(ranked, size).drop("_k")


def permute(ranks, epochs, n: int, seed: int = SEED):
    """NumPy: place of rank ``0 .. n-1`` in the order of its epoch; a bijection per epoch.

    A Feistel network over the least even number of bits (8 at least) that
    hold ``n`` ranks; a result of ``n`` or more goes through it again until it is a rank
    (cycle walking), which keeps the map one to one.
    """
    half = max(4, -(-max(n - 1, 1).bit_length() // 2))
    m = 1 << half

    def once(x, key):
        left, right = x >> half, x & (m - 1)
        for k in range(FEISTEL_ROUNDS):
            odd = 2 * ((key * 7_919 + k * 104_729 + seed) % m) + 1
            t = (right * odd + key * 40_503 + k * 9_176 + seed * 613) % m
            left, right = right, left ^ (((t * t) // (1 << (half // 2)) + t * 25_173 + key + k) % m)
        return left << half | right
    x, key = np.asarray(ranks, dtype=np.int64).copy(), np.asarray(epochs, dtype=np.int64) + 1
    todo = np.arange(len(x))
    while len(todo):
        x[todo] = once(x[todo], key[todo])
        todo = todo[x[todo] >= n]
    return x


def epoch_batches(df: DataFrame, epochs: int, id_col: str = "doc_id", size: int = TRAIN_BATCH, seed: int = SEED,
                  bits: int = DEFAULT_BITS) -> DataFrame:
    """X3/B1 for many epochs: ``(*, epoch, batch_id, batch_pos)``.

    Rows are ranked once, by hash of the id; every epoch's order is a keyed
    permutation of those ranks (:func:`permute`), made in the row, so the
    shuffles are the same for any number of epochs.
    """
    ranked = materialize(hash_rank(df.withColumn("_k", hash_key(seed, F.col(id_col))), "_k", id_col, None, "_rank", bits).drop("_k"),
                         "epoch-ranks")
    n = ranked.count()

    @F.pandas_udf("bigint")
    def place(ranks: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series(permute(ranks.to_numpy() - 1, key.to_numpy(), n, seed) + 1)

    rows = with_epochs(ranked, epochs)
    return _cut(rows.withColumn("_rank", place("_rank", "epoch")), size)


def ordered_batches(df: DataFrame, id_col: str = "doc_id", size: int = 128,
                    bits: int | None = None) -> DataFrame:
    """B2: batches in key order (the project's ``shuffle=False`` loaders)."""
    return _cut(ordered_rank(df, id_col, None, "_rank", bits), size)


def _cut(ranked: DataFrame, size: int) -> DataFrame:
    return (ranked.withColumn("batch_id", F.expr(f"(_rank - 1) div {int(size)}"))
            .withColumn("batch_pos", F.expr(f"(_rank - 1) % {int(size)}"))
            .drop("_rank"))


def step_counts(df: DataFrame, size: int, epochs: int = 1) -> DataFrame:
    """``n_rows``, ``steps_per_epoch = ceil(n/size)``, ``total_steps``."""
    return (df.agg(F.count(F.lit(1)).alias("n_rows"))
            .withColumn("batch_size", F.lit(size).cast("bigint"))
            .withColumn("steps_per_epoch", F.expr(f"(n_rows + {size - 1}) div {size}"))
            .withColumn("epochs", F.lit(epochs).cast("bigint"))
            .withColumn("total_steps", F.col("steps_per_epoch") * F.col("epochs")))
