"""Exact ranks without a single-task global sort.

``row_number() over (order by k)`` with no partition moves every row into one
task. Here a row's rank is ``offset(group, bucket) + row_number() inside
(group, bucket)``, where buckets are ranges of the order key. Only the
bucket-count table (at most groups x buckets rows) is ranked globally, so the
wide work is spread over ``groups x buckets`` tasks and the result does not
depend on partitioning or input order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import hash_bucket
from ..session import materialize

DEFAULT_BITS = 16  # 65,536 buckets per group: ~5e5 rows/bucket at 3e10 rows
# Quantile ranges for id order: the cut points come back through the driver
# (4,095 doubles); ~7e6 narrow rows per range at 3e10 rows.
ORDERED_BITS = 12
ROWS_PER_RANGE = 100_000   # target rows per id range (one window task)
SMALL_RANGE = 4_096        # a table too small for that is cut into ranges of this size, at most one per core


def _join_offsets(df: DataFrame, offsets: DataFrame, keys: list[str],
                  row_bound: int | None, broadcast_row_limit: int) -> DataFrame:
    if row_bound is not None and row_bound <= broadcast_row_limit:
        offsets = F.broadcast(offsets)
    return df.join(offsets, keys, "inner")


def bucketed_rank(df: DataFrame, order_cols: list[str], bucket, group: list[str] | None = None,
                  rank_col: str = "rank", n_buckets: int | None = None,
                  n_groups: int | None = None, broadcast_row_limit: int = 2_000_000) -> DataFrame:
    """Add a 1-based, gap-free ``rank_col`` inside ``group`` ordered by ``order_cols``.

    ``bucket`` must be non-decreasing in ``order_cols`` (a range of the key).
    ``n_buckets``/``n_groups`` bound the offset table; it is broadcast only
    when that bound is below ``broadcast_row_limit``.
    """
    group = list(group or [])
    keyed = df.withColumn("_bucket", bucket)
    parts = group + ["_bucket"]
    counts = keyed.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n"))
    w_off = Window.orderBy("_bucket") if not group else Window.partitionBy(*group).orderBy("_bucket")
    offsets = counts.withColumn(
        "_offset", F.coalesce(F.sum("_n").over(w_off.rowsBetween(Window.unboundedPreceding, -1)),
                              F.lit(0))
    ).drop("_n")
    bound = None
    if n_buckets is not None and (n_groups is not None or not group):
        bound = n_buckets * (n_groups if group else 1)
    joined = _join_offsets(keyed, offsets, parts, bound, broadcast_row_limit)
    w_in = Window.partitionBy(*parts).orderBy(*order_cols)
    return (joined.withColumn(rank_col, (F.col("_offset") + F.row_number().over(w_in)).cast("bigint"))
            .drop("_bucket", "_offset"))


def hash_rank(df: DataFrame, key_col: str, tie_col: str, group: list[str] | None = None,
              rank_col: str = "rank", bits: int = DEFAULT_BITS, n_groups: int | None = None,
              broadcast_row_limit: int = 2_000_000) -> DataFrame:
    """Rank by a uniform 32-bit hash key (ties by ``tie_col``)."""
    return bucketed_rank(df, [key_col, tie_col], hash_bucket(F.col(key_col), bits), group,
                         rank_col, 1 << bits, n_groups, broadcast_row_limit)


def quantile_ranges(df: DataFrame, id_col: str, bits: int = ORDERED_BITS, rel_error: float = 1e-4,
                    out_col: str = "_range") -> tuple[DataFrame, int] | tuple[None, int]:
    """Add ``out_col``: the id range of each row, cut at approximate quantiles.

    One pass (``approxQuantile``) picks at most ``2^bits - 1`` cut points, so a
    range holds about ``n / 2^bits`` rows (plus ``2 * rel_error * n`` at most)
    however the ids are spread: clustered ids or outliers cannot pile the rows
    into one task. ``Bucketizer`` assigns the range by binary search (JVM side);
    the range is non-decreasing in the id. Returns ``(df, number of ranges)``,
    or ``(None, 0)`` for an empty input.
    """
    from pyspark.ml.feature import Bucketizer
    n = 1 << bits
    cuts = df.approxQuantile(id_col, [i / n for i in range(1, n)], rel_error)   # <= 2^bits doubles
    if not cuts:
        return None, 0
    splits = [float("-inf")] + sorted(set(cuts)) + [float("inf")]
    src = df.withColumn("_id_d", F.col(id_col).cast("double"))
    out = Bucketizer(splits=splits, inputCol="_id_d", outputCol="_range_d").transform(src)
    return (out.withColumn(out_col, F.col("_range_d").cast("bigint")).drop("_id_d", "_range_d"),
            len(splits) - 1)


def ordered_rank(df: DataFrame, id_col: str, group: list[str] | None = None,
                 rank_col: str = "rank", bits: int | None = None,
                 broadcast_row_limit: int = 2_000_000, rel_error: float = 1e-4,
                 rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Rank by a numeric id; buckets are the quantile ranges of :func:`quantile_ranges`.

    ``bits=None`` sizes the ranges from one count: about ``rows_per_range``
    rows each, at most ``2^ORDERED_BITS`` ranges. An input of at most
    ``rows_per_range`` rows is one range and needs no quantile pass.
    The input is read two or three times: pass a written table.
    """
    if bits is None:
        n = df.count()
        bits = min(ORDERED_BITS, max(0, math.ceil(math.log2(max(n, 1) / rows_per_range))))
    if bits == 0:
        return bucketed_rank(df, [id_col], F.lit(0).cast("bigint"), group, rank_col, 1, None,
                             broadcast_row_limit)
    ranged, n_ranges = quantile_ranges(df, id_col, bits, rel_error)
    if ranged is None:
        return df.withColumn(rank_col, F.lit(None).cast("bigint"))
    return bucketed_rank(ranged, [id_col], F.col("_range"), group, rank_col, n_ranges, None,
                         broadcast_row_limit).drop("_range")


def range_places(df: DataFrame, order: list, rows_per_range: int = ROWS_PER_RANGE, name: str = "ranges") -> DataFrame:
    """``df`` written in the order of ``order``, with ``_range`` (bigint, ascending) and ``_at`` (place in the range, from 0).

    Cut points over the order key are sampled (``repartitionByRange``), so the
    key may be of any type and spread. Ranges of more than twice
    ``rows_per_range`` rows, which the sample misjudged, are cut once more by
    a sample of their own. Each range is sorted by its task and its rows are
    numbered as they are written; nothing is ordered in one task.
    """
    return _placed(df, order, rows_per_range, name)[0]


def _placed(df: DataFrame, order: list, rows_per_range: int, name: str) -> tuple[DataFrame, DataFrame]:
    """:func:`range_places`, and ``(_range, _n)``: one row per range."""
    rows = materialize(df, f"{name}-rows")      # counted, sampled and sorted from the written table
    n = rows.count()

    def cut(part: DataFrame, keys: list, ranges: int, step: str) -> DataFrame:
        done = (part.repartitionByRange(max(1, ranges), *keys).sortWithinPartitions(*keys)
                .withColumn("_m", F.monotonically_increasing_id()))
        return materialize(done, f"{name}-{step}")

    spark = df.sparkSession
    least = min(spark.sparkContext.defaultParallelism, math.ceil(n / SMALL_RANGE))       # small tables still use every core
    stretch = 1 << 20                                                           # room for the second cut's ranges
    first = cut(rows, order, max(math.ceil(n / rows_per_range), least), "cut")
    first = (first.withColumn("_range", F.shiftright("_m", 33) * stretch).withColumn("_at", F.col("_m") % (1 << 33)).drop("_m"))
    sizes = [tuple(r) for r in first.groupBy("_range").agg(F.count(F.lit(1))).collect()]      # one row per range
    full = [(k, m) for k, m in sizes if m > 2 * rows_per_range]
    extra = sum(m for _, m in full)
    if not extra:
        return first, spark.createDataFrame(sizes, "_range bigint, _n bigint")
    marked = spark.createDataFrame([(k,) for k, _ in full], "_range bigint")
    again = cut(first.join(F.broadcast(marked), "_range", "left_semi").drop("_at"), ["_range", *order],
                math.ceil(extra / rows_per_range), "recut")
    part = F.shiftright("_m", 33)
    again = (again.withColumn("_range", F.col("_range") + part).withColumn("_m", F.col("_m") % (1 << 33)))
    start = again.groupBy("_range").agg(F.min("_m").alias("_s"))                # a task may hold the ends of two ranges
    again = again.join(F.broadcast(start), "_range").withColumn("_at", F.col("_m") - F.col("_s")).drop("_m", "_s")
    placed = first.join(F.broadcast(marked), "_range", "left_anti").unionByName(again.select(first.columns))
    return placed, placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))


def sorted_rank(df: DataFrame, order: list, rank_col: str = "rank", rows_per_range: int = ROWS_PER_RANGE,
                name: str = "ranges") -> DataFrame:
    """1-based, gap-free ``rank_col`` in the order of ``order``, for a table of any size and key.

    The rows before a range are a running sum over one row per range.
    """
    placed, sizes = _placed(df, order, rows_per_range, name)
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    return (placed.join(F.broadcast(before), "_range")
            .withColumn(rank_col, (F.col("_before") + F.col("_at") + 1).cast("bigint")).drop("_range", "_at", "_before"))
