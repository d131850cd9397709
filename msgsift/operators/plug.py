"""M8: score encoded batches with any model that maps (input_ids, attention_mask)
arrays to class scores, through ``predict_batch_udf`` (Arrow batches).

The user supplies ``make_fn`` (called once per Python worker) returning a
function ``(ids[n, w], mask[n, w]) -> scores[n, C]``.

A model whose scores are a prior plus one row of weights per input id
(:class:`AdditiveModel`) may be of any size. While its matrix is under
``max_bytes`` it travels with the tasks. Beyond, it is cut into ranges of ids:
the head (ids are frequency ranks, so the first ids are the frequent ones)
still travels, as far as ``max_bytes`` goes; every other id goes to the task
that holds its range, which returns partial scores per example. The model
never reaches the driver or any task whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..config import FIRST_TOKEN_ID
from ..functions.text import argmax, softmax
from ..session import materialize, small_batches
from .labels import small
from .naive_bayes import NBModel

MAX_BYTES = 32 << 20      # of a matrix that travels with the tasks: every Python worker holds it
RANGE_ROWS = 1 << 16      # ids per range
CELL_IDS = 1_000_000      # input ids that one task scores against a range


@dataclass
class AdditiveModel:
    """``scores = prior + sum of weights[id]`` over the unmasked input ids from ``first_id`` on."""

    weights: DataFrame          # (token_id, w array<double>), one row per id that has weights
    prior: list[float]
    n_ids: int                  # ids are below it
    first_id: int = FIRST_TOKEN_ID

    @property
    def n_bytes(self) -> int:
        return self.n_ids * max(len(self.prior), 1) * 8

    def matrix(self, lo: int, hi: int) -> np.ndarray:
        """Rows ``lo .. hi`` on the driver: for callers that have checked their size."""
        rows = self.weights.where((F.col("token_id") >= lo) & (F.col("token_id") < hi)).select("token_id", "w").toArrow()
        return _fill(rows, lo, hi - lo, len(self.prior))


def _fill(rows: pa.Table, lo: int, n: int, c: int) -> np.ndarray:
    mat = np.zeros((n, c), dtype=np.float64)
    if rows.num_rows:
        mat[rows.column("token_id").to_numpy() - lo] = rows.column("w").combine_chunks().flatten().to_numpy().reshape(-1, c)
    return mat


def nb_additive(model: NBModel) -> AdditiveModel:
    """A Naive Bayes model by token id."""
    weights = model.weights.join(model.vocabulary().select("token", "token_id"), "token").select("token_id", "w")
    return AdditiveModel(weights, list(model.log_prior), FIRST_TOKEN_ID + model.vocab_size)


def additive_batch_model(model: AdditiveModel) -> Callable:
    """``make_fn`` for :func:`score_batches`; the whole matrix travels with the tasks."""
    mat = model.matrix(0, model.n_ids)
    prior, first = np.asarray(model.prior, dtype=np.float64), model.first_id

    def make_fn():
        def predict(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
            ids = ids.astype(np.int64)
            use = (mask > 0) & (ids >= first)
            contrib = mat[np.where(use, ids, 0)] * use[..., None]
            return contrib.sum(axis=1) + prior
        return predict

    return make_fn


def _sums(rows: np.ndarray, mat: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Per example the sum of ``mat[ids]``, class by class: no array of ids times classes."""
    out = np.zeros((n, mat.shape[1]))
    for k in range(mat.shape[1]):
        out[:, k] = np.bincount(rows, weights=mat[ids, k], minlength=n)
    return out


def _score_arrays(x: np.ndarray) -> pa.ListArray:
    n, c = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * c + 1, c) if c else np.zeros(n + 1), pa.int32()), pa.array(x.ravel(), pa.float64()))


def score_ranges(encoded: DataFrame, model: AdditiveModel, key_cols: tuple[str, ...] = ("doc_id", "chunk"),
                 max_bytes: int = MAX_BYTES, range_rows: int = RANGE_ROWS, cell_ids: int = CELL_IDS) -> DataFrame:
    """``(*keys, scores, pred_index)`` by a model cut into id ranges.

    One pass scores the head's ids and writes, per example and touched range,
    one row with the ids in it. Ranges and their weights meet in a cogroup; a
    range that more than ``cell_ids`` ids fall in is served by several copies
    of it, each with a share of the examples. Partial scores are summed per
    example.
    """
    c, first = len(model.prior), model.first_id
    head_rows = min(model.n_ids, max_bytes // (8 * max(c, 1)))
    head = model.matrix(0, head_rows)
    names = ["_row", *key_cols, "_range", "_ids", "_part"]

    def cut(batches):
        k = len(key_cols)
        for b in batches:
            ids, mask = b.column(k + 1), b.column(k + 2)
            size = np.diff(np.asarray(ids.offsets))
            row = np.repeat(np.arange(b.num_rows), size)
            flat = ids.flatten().to_numpy().astype(np.int64)
            use = (mask.flatten().to_numpy() > 0) & (flat >= first)
            row, flat = row[use], flat[use]
            near = flat < head_rows
            part = _sums(row[near], head, flat[near], b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:k + 1], pa.array(np.full(b.num_rows, -1), pa.int64()), pa.nulls(b.num_rows, pa.list_(pa.int32())),
                 _score_arrays(part)], names=names)
            row, flat = row[~near], flat[~near]
            if len(row):
                order = np.lexsort((flat // range_rows, row))
                row, flat = row[order], flat[order]
                piece = flat // range_rows
                at = np.flatnonzero(np.r_[True, (np.diff(row) > 0) | (np.diff(piece) != 0)])
                take = pa.array(row[at])
                yield pa.RecordBatch.from_arrays(
                    [*[x.take(take) for x in b.columns[:k + 1]], pa.array(piece[at]),
                     pa.ListArray.from_arrays(pa.array(np.r_[at, len(row)], pa.int32()), pa.array(flat, pa.int32())),
                     pa.nulls(len(at), pa.list_(pa.float64()))], names=names)

    small_batches(encoded.sparkSession)
    src = encoded.select(F.monotonically_increasing_id().alias("_row"), *key_cols, "input_ids", "attention_mask")
    keys = ", ".join(f"`{x}` {encoded.schema[x].dataType.simpleString()}" for x in key_cols)
    pieces = materialize(src.mapInArrow(cut, f"_row bigint, {keys}, _range bigint, _ids array<int>, _part array<double>"),
                         "model-pieces")
    far = pieces.where("_range >= 0").select("_row", "_range", "_ids")
    share = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.sum(F.size("_ids")) / cell_ids).cast("bigint"))
    copies = materialize(far.groupBy("_range").agg(share.alias("_copies")), "model-copies")      # one row per touched range
    far = (far.join(small(copies), "_range").withColumn("_copy", F.pmod(F.xxhash64("_row"), F.col("_copies"))).drop("_copies"))
    rows = model.weights.where(F.col("token_id") >= head_rows).withColumn("_range", F.expr(f"token_id div {range_rows}"))
    rows = rows.join(small(copies), "_range").withColumn("_copy", F.explode(F.expr("sequence(0L, _copies - 1)")))

    def meet(key, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not mine.num_rows:
            return pa.table({"_row": pa.array([], pa.int64()), "_part": pa.array([], pa.list_(pa.float64()))})
        lo = key[0].as_py() * range_rows
        mat = _fill(theirs, lo, range_rows, c)
        ids = mine.column("_ids").combine_chunks()
        row = np.repeat(np.arange(mine.num_rows), np.diff(np.asarray(ids.offsets)))
        part = _sums(row, mat, ids.flatten().to_numpy().astype(np.int64) - lo, mine.num_rows)
        return pa.table({"_row": mine.column("_row"), "_part": _score_arrays(part)})

    parts = far.groupBy("_range", "_copy").cogroup(rows.select("_range", "_copy", "token_id", "w").groupBy("_range", "_copy")) \
        .applyInArrow(meet, "_row bigint, _part array<double>")
    near = pieces.where("_range < 0").select("_row", F.struct(*key_cols).alias("_key"), "_part")
    every = near.unionByName(parts, allowMissingColumns=True)
    sums = every.groupBy("_row").agg(F.first("_key", ignorenulls=True).alias("_key"),
                                     *[F.sum(F.col("_part")[k]).alias(f"_s{k}") for k in range(c)])
    scores = F.array(*[F.col(f"_s{k}") + F.lit(float(model.prior[k])) for k in range(c)])
    return sums.select("_key.*", scores.alias("scores")).withColumn("pred_index", argmax("scores"))


def score_additive(encoded: DataFrame, model: AdditiveModel, width: int, batch_size: int = 128,
                   key_cols: tuple[str, ...] = ("doc_id", "chunk"), max_bytes: int = MAX_BYTES, **ranges) -> DataFrame:
    """``(*keys, scores, pred_index)``: in batches while the matrix is under ``max_bytes``, by id ranges beyond."""
    if model.n_bytes <= max_bytes:
        return score_batches(encoded, additive_batch_model(model), width, batch_size, key_cols)
    return score_ranges(encoded, model, key_cols, max_bytes, **ranges)


def score_batches(encoded: DataFrame, make_fn, width: int, batch_size: int = 128,
                  key_cols: tuple[str, ...] = ("doc_id", "chunk")) -> DataFrame:
    """``(*keys, scores, pred_index)`` for every encoded example."""
    small_batches(encoded.sparkSession)
    udf = predict_batch_udf(make_fn, return_type=ArrayType(DoubleType()), batch_size=batch_size,
                            input_tensor_shapes=[[width], [width]])
    out = encoded.withColumn("scores", udf(F.col("input_ids"), F.col("attention_mask")))
    return out.select(*key_cols, "scores", argmax("scores").alias("pred_index"))


def score_messages(chunk_scores: DataFrame, prior: list[float], id_col: str = "doc_id") -> DataFrame:
    """One answer per message from its chunks: ``(id, scores, pred_index, p_top)``.

    Chunk scores are log joints that each hold the class log ``prior``; they are
    summed per message (partial aggregation) with the prior counted once.
    """
    c = len(prior)
    sums = chunk_scores.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"),
                                            *[F.sum(F.col("scores")[k]).alias(f"_s{k}") for k in range(c)])
    scores = F.array(*[F.col(f"_s{k}") - (F.col("_n") - 1) * F.lit(float(prior[k])) for k in range(c)])
    out = sums.select(id_col, scores.alias("scores")).withColumn("pred_index", argmax("scores"))
    return out.withColumn("p_top", F.element_at(softmax("scores"), F.col("pred_index") + 1))


def nb_batch_model(model: NBModel) -> Callable:
    """``make_fn`` of a Naive Bayes model whose matrix may travel with the tasks (:func:`score_additive` checks that)."""
    return additive_batch_model(nb_additive(model))
