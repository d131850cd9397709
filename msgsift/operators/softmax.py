"""M2: a softmax classifier on hashed token counts, fitted by gradient sums.

A text's features are its tokens hashed to ``2^bits`` buckets: ``ln(1 + count)``
per bucket, divided by the row's length. No vocabulary is built, so nothing
grows with it: the matrix has ``2^bits x classes`` doubles, and :func:`fit`
takes fewer bits when that would exceed ``max_bytes``.

The fit is full-batch gradient descent with a fixed number of steps. Features
are written once. Each step is one pass: a task adds up the gradient of its
rows and hands over one row per bucket it has touched; a grouped sum over the
buckets gives the step. Only bucket rows, a fixed number, reach the driver.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_array
from ..session import materialize, small_batches
from .lookup import slices

BITS = 16
STEPS = 10
RATE = 8.0
REG = 1e-4
MAX_BYTES = 64 << 20
SLICE_TOKENS = 1 << 18     # tokens that a task counts at once; a text is never cut


@dataclass
class SoftmaxModel:
    weights: np.ndarray        # (2^bits, classes)
    bias: np.ndarray
    labels: list[int]
    bits: int


def _bucket(token: str, bits: int) -> int:
    """The first 32 bits of the token's md5 (as ``functions.keys.hash_key``), modulo the buckets."""
    return int.from_bytes(hashlib.md5(token.encode()).digest()[:4], "big") % (1 << bits)


def features(df: DataFrame, cols: list[str], text_col: str = "text", bits: int = BITS) -> DataFrame:
    """``(*cols, idx, val)``: bucket numbers (ascending) and values of each text; no shuffle."""
    def run(batches):
        for whole in batches:
            sizes = np.diff(np.asarray(whole.column(len(cols)).offsets))
            for lo, hi in slices(sizes, SLICE_TOKENS):
                b = whole.slice(lo, hi - lo)
                lists = b.column(len(cols))
                coded = pc.dictionary_encode(lists.flatten())
                of_word = np.array([_bucket(t, bits) for t in coded.dictionary.to_pylist()], dtype=np.int64)
                row = np.repeat(np.arange(b.num_rows), sizes[lo:hi])
                cell, n = np.unique((row << bits) + of_word[coded.indices.to_numpy(zero_copy_only=False)] if len(row)
                                    else np.zeros(0, dtype=np.int64), return_counts=True)
                row, idx, val = cell >> bits, cell & ((1 << bits) - 1), np.log1p(n)
                val = val / np.sqrt(np.bincount(row, weights=val * val, minlength=b.num_rows))[row]
                at = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:-1], pa.ListArray.from_arrays(at, pa.array(idx, pa.int32())), pa.ListArray.from_arrays(at, pa.array(val))],
                    names=[*cols, "idx", "val"])

    small_batches(df.sparkSession)
    src = df.select(*cols, F.coalesce(token_array(text_col), F.array().cast("array<string>")).alias("_t"))
    keys = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in cols)
    return src.mapInArrow(run, f"{keys}idx array<int>, val array<double>")


def _flat(b: pa.RecordBatch, k: int):
    idx, val = b.column(k), b.column(k + 1)
    row = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(idx.offsets)))
    return row, idx.flatten().to_numpy(), val.flatten().to_numpy()


def _probabilities(row, idx, val, n: int, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    z = np.tile(bias, (n, 1))
    for k in range(len(bias)):
        z[:, k] += np.bincount(row, weights=val * weights[idx, k], minlength=n)
    z -= z.max(axis=1, keepdims=True)
    e = np.exp(z)
    return e / e.sum(axis=1, keepdims=True)


def _gradient(feats: DataFrame, model: SoftmaxModel, classes: int) -> DataFrame:
    """(bucket, g): the summed gradient per touched bucket; bucket -1 is the bias."""
    shipped = feats.sparkSession.sparkContext.broadcast((model.weights, model.bias, np.array(model.labels)))

    def run(batches):
        weights, bias, labels = shipped.value
        total, base, hit = np.zeros_like(weights), np.zeros(classes), np.zeros(len(weights), dtype=bool)
        for b in batches:
            row, idx, val = _flat(b, 1)
            err = _probabilities(row, idx, val, b.num_rows, weights, bias)
            err[np.arange(b.num_rows), np.searchsorted(labels, b.column(0).to_numpy())] -= 1.0
            base += err.sum(axis=0)
            hit[idx] = True
            for k in range(classes):
                total[:, k] += np.bincount(idx, weights=val * err[row, k], minlength=len(weights))
        at = np.flatnonzero(hit)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.r_[-1, at], pa.int32()),
                                          "g": pa.array([base.tolist(), *total[at].tolist()], pa.list_(pa.float64()))})
    parts = feats.select("label", "idx", "val").mapInArrow(run, "bucket int, g array<double>")
    return parts.groupBy("bucket").agg(F.array(*[F.sum(F.col("g")[k]) for k in range(classes)]).alias("g"))


def fit(train: DataFrame, text_col: str = "text", label_col: str = "label", bits: int = BITS, steps: int = STEPS,
        rate: float = RATE, reg: float = REG, max_bytes: int = MAX_BYTES) -> SoftmaxModel:
    """Fit on ``(text, label)``. The bias starts at the class log priors, the weights at 0."""
    src = train.select(F.col(label_col).cast("int").alias("label"), F.col(text_col).alias("text"))
    counts = sorted(map(tuple, src.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()))     # one row per class
    labels, total = [k for k, _ in counts], sum(n for _, n in counts)
    while bits > 1 and (8 * max(len(labels), 1)) << bits > max_bytes:
        bits -= 1
    model = SoftmaxModel(np.zeros((1 << bits, len(labels))), np.array([math.log(n / total) for _, n in counts]), labels, bits)
    if not labels:
        return model
    feats = materialize(features(src, ["label"], "text", bits), "softmax-features")
    for _ in range(steps):
        rows = _gradient(feats, model, len(labels)).toArrow()            # at most 2^bits + 1 rows
        bucket, g = rows.column("bucket").to_numpy(), rows.column("g").combine_chunks().flatten().to_numpy().reshape(-1, len(labels))
        step = reg * model.weights
        step[bucket[bucket >= 0]] += g[bucket >= 0] / total
        model.weights = model.weights - rate * step
        model.bias = model.bias - rate * g[bucket < 0].sum(axis=0) / total
    return model


def predict(model: SoftmaxModel, df: DataFrame, cols: list[str], text_col: str = "text") -> DataFrame:
    """``(*cols, pred_label, p_top)``: the likeliest class (the first of equal ones) and its probability; null without classes."""
    shipped = df.sparkSession.sparkContext.broadcast((model.weights, model.bias, np.array(model.labels, dtype=np.int32)))
    k = len(cols)

    def run(batches):
        weights, bias, labels = shipped.value
        for b in batches:
            n = b.num_rows
            if len(labels):
                p = _probabilities(*_flat(b, k), n, weights, bias)
                best = p.argmax(axis=1)
                out = [pa.array(labels[best], pa.int32()), pa.array(p[np.arange(n), best])]
            else:
                out = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:k], *out], names=[*cols, "pred_label", "p_top"])
    keys = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in cols)
    return features(df, cols, text_col, model.bits).mapInArrow(run, f"{keys}pred_label int, p_top double")
