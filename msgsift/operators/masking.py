"""Masked-LM examples, drawn anew per epoch.

One md5 of ``seed:epoch:id:pos`` per position gives three 32-bit draws: of
the known-token positions, draw 1 ``% 100 < 15`` selects; of those, draw 2
gives 80 % mask id, 10 % a random vocabulary id, 10 % unchanged; draw 3
picks the random id directly (ids are dense from 4, so no lookup join). The target is the original id
on selected positions and null elsewhere.

:func:`mask_arrays` draws for one array of ids per line, in Arrow batches; epochs
are copies of lines, and no row per token is made. :func:`mask_positions` does
the same for position rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, IntegerType

from ..config import FIRST_TOKEN_ID, MASK_RATE, MASK_SPLIT, SEED
from ..functions.digest import place_draws
from ..functions.keys import digest_key, hash_digest, key_prefix
from ..session import small_batches
from .batching import with_epochs
from .lookup import slices


def mask_id(vocab_size: int) -> int:
    """Id of the mask marker: right after the vocabulary."""
    return FIRST_TOKEN_ID + vocab_size


def mask_positions(ids: DataFrame, vocab_size: int, key_cols: list[str], seed: int = 1,
                   epoch_col: str | None = None, rate: float = MASK_RATE) -> DataFrame:
    """``input_id`` and ``target_id`` for each position row of ``ids``.

    ``ids`` holds one row per content position with ``token_id``; the key of
    a position is ``key_cols`` (+ epoch).
    """
    parts = ([F.col(epoch_col)] if epoch_col else []) + [F.col(c) for c in key_cols]
    pct = int(round(rate * 100))
    digest = F.col("_md5")
    # markers and unknown tokens are never selected
    sel = (F.col("token_id") >= FIRST_TOKEN_ID) & ((digest_key(digest, 0) % 100) < pct)
    how = digest_key(digest, 1) % 100
    rnd = (digest_key(digest, 2) % vocab_size + FIRST_TOKEN_ID).cast("int")
    masked, randomised = MASK_SPLIT[0], MASK_SPLIT[0] + MASK_SPLIT[1]
    out = (ids.withColumn("_md5", hash_digest(seed, *parts)).withColumn("_sel", sel).withColumn("_how", how)
           .withColumn("input_id",
                       F.when(~F.col("_sel"), F.col("token_id"))
                       .when(F.col("_how") < masked, F.lit(mask_id(vocab_size)))
                       .when(F.col("_how") < randomised, rnd)
                       .otherwise(F.col("token_id")).cast("int"))
           .withColumn("target_id", F.when(F.col("_sel"), F.col("token_id")).cast("int"))
           .withColumn("action", F.when(~F.col("_sel"), F.lit("keep"))
                       .when(F.col("_how") < masked, F.lit("mask"))
                       .when(F.col("_how") < randomised, F.lit("random"))
                       .otherwise(F.lit("same"))))
    return out.drop("_md5", "_sel", "_how")


ACTIONS = ("keep", "mask", "random", "same")
MASKED_COLS = ["input_ids", "target_ids", "actions", "n_masked", "n_random", "n_same"]
SLICE_IDS = 1 << 18        # ids that a task masks at once; a line is never cut


def _masked(ids: pa.Array, prefixes: list[bytes], vocab_size: int, rate: float) -> list[pa.Array]:
    """The ``MASKED_COLS`` of lines of ids whose keys begin with ``prefixes``."""
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = ids.flatten()
    x = pc.fill_null(flat, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    draws = place_draws(prefixes, sizes)
    at = np.flatnonzero((x >= FIRST_TOKEN_ID) & (draws[0] % np.uint32(100) < int(round(rate * 100))))
    how = draws[1, at] % np.uint32(100)
    kind = np.where(how < MASK_SPLIT[0], 1, np.where(how < MASK_SPLIT[0] + MASK_SPLIT[1], 2, 3)).astype(np.int8)
    action = np.zeros(len(x), dtype=np.int8)
    action[at] = kind
    value = x.astype(np.int32)
    value[at[kind == 1]] = mask_id(vocab_size)
    value[at[kind == 2]] = draws[2, at[kind == 2]].astype(np.int64) % max(vocab_size, 1) + FIRST_TOKEN_ID
    begin = np.r_[0, np.cumsum(sizes)]
    offsets, gone = pa.array(begin, pa.int32()), ids.is_null() if ids.null_count else None

    def lists(v):
        return pa.ListArray.from_arrays(offsets, v, mask=gone)

    def count(k):
        return pa.array(np.diff(np.searchsorted(at[kind == k], begin)), pa.int32(), mask=None if gone is None else np.asarray(gone))
    return [lists(pa.array(value, pa.int32(), mask=np.asarray(flat.is_null()) if flat.null_count else None)),
            lists(pa.array(x.astype(np.int32), pa.int32(), mask=action == 0)), lists(pa.array(action, pa.int8())), count(1), count(2), count(3)]


def mask_arrays(lines: DataFrame, vocab_size: int, key_cols: list[str], seed: int = 1, epoch_col: str | None = None,
                rate: float = MASK_RATE, ids_col: str = "ids") -> DataFrame:
    """T8 per line: adds ``input_ids``, ``target_ids`` and ``actions`` (places in ``ACTIONS``), one entry per entry of
    ``ids_col``, the counts ``n_masked``, ``n_random`` and ``n_same``, and ``cells``, the arrays as one of
    ``(input_id, target_id, action)``.

    The draws are those of :func:`mask_positions` with the entry's place (from
    0) as the last key, made for all ids of a batch at once (:mod:`..functions.digest`).
    """
    kept = [c for c in lines.columns if c not in (*MASKED_COLS, "cells")]
    small_batches(lines.sparkSession)
    src = lines.select(*[F.col(f"`{c}`") for c in kept], F.col(ids_col).cast("array<int>").alias("_mask_ids"),
                       key_prefix(seed, *([epoch_col] if epoch_col else []), *key_cols).alias("_mask_key"))
    names = [*kept, *MASKED_COLS]

    def run(batches):
        for b in batches:
            k = len(kept)
            size = pc.fill_null(pc.list_value_length(b.column(k)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi in slices(size, SLICE_IDS):
                part = b.slice(lo, hi - lo)
                out = _masked(part.column(k), [p.encode() for p in part.column(k + 1).to_pylist()], vocab_size, rate)
                yield pa.RecordBatch.from_arrays([*part.columns[:k], *out], names=names)

    schema = lines.select(*[F.col(f"`{c}`") for c in kept]).schema
    for c, t in zip(MASKED_COLS, [*[ArrayType(t) for t in (IntegerType(), IntegerType(), ByteType())], *[IntegerType()] * 3]):
        schema = schema.add(c, t)
    named = F.array(*[F.lit(a) for a in ACTIONS])
    cells = F.zip_with(F.arrays_zip("input_ids", "target_ids"), "actions", lambda x, a: F.struct(
        x["input_ids"].alias("input_id"), x["target_ids"].alias("target_id"), F.get(named, a.cast("int")).alias("action")))
    return src.mapInArrow(run, schema).withColumn("cells", cells)


def mask_line_epochs(lines: DataFrame, vocab_size: int, key_cols: list[str], epochs: int, seed: int = 1,
                     rate: float = MASK_RATE) -> DataFrame:
    """T9 per line: the masked lines of every epoch (a copy of the line per epoch, its draws made anew)."""
    return mask_arrays(with_epochs(lines, epochs), vocab_size, key_cols, seed, "epoch", rate)


def mask_epochs(ids: DataFrame, vocab_size: int, key_cols: list[str], epochs: int, seed: int = 1,
                rate: float = MASK_RATE) -> DataFrame:
    """The masked examples of every epoch (write partitioned by ``epoch``)."""
    return mask_positions(with_epochs(ids, epochs), vocab_size, key_cols, seed, "epoch", rate)
