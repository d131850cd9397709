"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_SHARE = 512   # a key holding more than 1/512 of the rows is hot: at most 512 such keys exist

FILTER_BITS = 24  # bit filter before a join: 2 MiB of bits, at most 262,144 rows

BATCH_ROWS = 500  # rows of an Arrow batch that carries whole texts

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batches to ``rows`` rows: whole texts make big rows, and a batch is held
    in the JVM and in the Python worker of every running task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null becomes empty. ASCII texts take the cheaper ``lower``."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.char_length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def crc_mod(id_col: Column, m: int) -> Column:
    """crc32 of the id written as text, modulo m (0 for a null id)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")), F.lit(0).cast("bigint")) % m


def join_by_key(rows: DataFrame, lookup: DataFrame, keys: list[str], n_col: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``lookup`` (one row per key, ``n_col`` = rows of that key).

    Keys with more than ``total / HOT_SHARE`` rows (at most HOT_SHARE of them)
    are broadcast, so a key holding a third of all rows never meets in one
    task; the others join by shuffle.
    """
    is_hot = F.col(n_col) * HOT_SHARE > F.lit(int(total))
    hot, cold = lookup.where(is_hot), lookup.where(~is_hot)
    hot_keys = F.broadcast(hot.select(*keys))
    return (rows.join(F.broadcast(hot), keys)
            .unionByName(rows.join(hot_keys, keys, "left_anti").join(cold, keys)))


def flag_keys(rows: DataFrame, key: Column, keys: DataFrame, keys_key: Column, bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` with a boolean ``_in``: false only if the row's 64-bit ``key`` is none of ``keys``'.

    A bit filter of fixed size (2^bits bits, at most 2^(bits-6) rows to
    broadcast) whatever the number of keys: more keys let more rows through,
    and the exact join that follows decides. It spares that join the texts of
    rows that cannot match.
    """
    bit = F.shiftrightunsigned(keys_key, 64 - bits)
    words = keys.groupBy(F.shiftright(bit, 6).alias("_w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit % 64).cast("int"))).alias("_v"))
    mine = rows.withColumn("_bit", F.shiftrightunsigned(key, 64 - bits))
    out = mine.join(F.broadcast(words), F.shiftright("_bit", 6) == F.col("_w"), "left")
    there = F.call_function("shiftright", F.col("_v"), (F.col("_bit") % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
    return out.withColumn("_in", F.coalesce(there, F.lit(False))).drop("_bit", "_w", "_v")


def keep_rows(docs: DataFrame, verdict: DataFrame, on: dict[str, Column]) -> DataFrame:
    """Rows of ``docs`` without a match in ``verdict`` (columns named as ``on``), all columns unchanged.

    The row travels as one struct, so its column names cannot clash with the
    key columns. Keys are matched null-safely. Only rows that pass
    :func:`flag_keys` take part in the join; ``verdict`` should be a written table.
    """
    names = list(on)
    d = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"),
                    *[c.alias(f"_k_{k}") for k, c in on.items()])
    v = verdict.select(*[F.col(k).alias(f"_v_{k}") for k in names])
    d = flag_keys(d, F.xxhash64(*[f"_k_{k}" for k in names]), v, F.xxhash64(*[f"_v_{k}" for k in names]))
    cond = None
    for k in names:
        c = F.col(f"_k_{k}").eqNullSafe(F.col(f"_v_{k}"))
        cond = c if cond is None else cond & c
    left = d.where("_in").join(v, cond, "left_anti").select("_row.*")
    return d.where("not _in").select("_row.*").unionByName(left)
