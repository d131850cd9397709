"""Label frequencies, encoding, label map, decoding and width checks.

The label table has one row per distinct intent (the class count, 58 in the
surveyed setup); it is the only table ranked without a partition and the
only one broadcast by default, behind a checked row count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def label_counts(df: DataFrame, label_col: str = "intent") -> DataFrame:
    """L1: ``(intent, n, freq_rank)``; nulls dropped, count desc then intent asc."""
    counts = df.where(F.col(label_col).isNotNull()).groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.desc("n"), F.asc(label_col))
    return counts.withColumn("freq_rank", F.row_number().over(w).cast("bigint"))


def label_table(df: DataFrame, label_col: str = "intent") -> DataFrame:
    """L2: ``(intent, label)``, id = position in the sorted distinct intents."""
    distinct = df.where(F.col(label_col).isNotNull()).select(label_col).distinct()
    w = Window.orderBy(label_col)
    return distinct.withColumn("label", (F.row_number().over(w) - 1).cast("int"))


def label_map(df: DataFrame, label_col: str = "intent") -> DataFrame:
    """L3: ``(intent, corresponding_label, n, freq_rank)`` in frequency order."""
    counts = label_counts(df, label_col)
    w = Window.orderBy(label_col)
    return (counts.withColumn("corresponding_label", (F.row_number().over(w) - 1).cast("int"))
            .select(label_col, "corresponding_label", "n", "freq_rank"))


def class_stats(df: DataFrame, label_col: str = "intent") -> DataFrame:
    """L4: number of classes and of samples."""
    return df.agg(F.countDistinct(label_col).alias("n_classes"), F.count(F.lit(1)).alias("n_samples"))


def small(table: DataFrame, limit: int = 100_000) -> DataFrame:
    """Broadcast a dimension table after checking its row count."""
    n = table.count()
    return F.broadcast(table) if n <= limit else table


def class_counts(df: DataFrame, label_col: str = "intent", limit: int = 100_000) -> list[tuple]:
    """``[(intent, n)]``, one row per class, for the driver; more than ``limit`` classes fail."""
    rows = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} classes: class tables are held on the driver")
    return [tuple(r) for r in rows]


def table_from_counts(spark, class_counts: list[tuple]) -> DataFrame:
    """L2 from collected ``[(intent, n)]`` (one row per class): a local table."""
    intents = sorted(k for k, _ in class_counts if k is not None)
    return spark.createDataFrame([(k, i) for i, k in enumerate(intents)], "intent STRING, label INT")


def encode(df: DataFrame, table: DataFrame, label_col: str = "intent", out_col: str = "label",
           on_missing: str = "error", bounded: bool = False) -> DataFrame:
    """L2 transform: intent -> id with a broadcast lookup; unknown intents fail.

    ``bounded=True`` states the table is already known small (built from
    collected class counts); otherwise its row count is checked first.
    """
    lut = table.select(F.col(label_col).alias("_i"), F.col("label").alias("_l"))
    lut = F.broadcast(lut) if bounded else small(lut)
    j = df.join(lut, df[label_col] == lut["_i"], "left")
    if on_missing == "error":
        val = F.when(F.col("_l").isNull(),
                     F.raise_error(F.concat(F.lit("intent without id: "),
                                            F.coalesce(F.col(label_col), F.lit("<null>")))))\
            .otherwise(F.col("_l"))
    else:
        val = F.col("_l")
    return j.withColumn(out_col, val.cast("int")).drop("_i", "_l")


def decode(df: DataFrame, table: DataFrame, id_col: str = "label", out_col: str = "intent",
           on_missing: str = "error") -> DataFrame:
    """Id -> intent; a missing id fails (``"error"``) or reads ``<unknown:id>``."""
    lut = small(table.select(F.col("label").alias("_l"), F.col("intent").alias("_i")))
    j = df.join(lut, df[id_col] == lut["_l"], "left")
    if on_missing == "error":
        val = F.when(F.col("_i").isNull(),
                     F.raise_error(F.concat(F.lit("label id without intent: "), F.col(id_col).cast("string"))))\
            .otherwise(F.col("_i"))
    else:
        val = F.coalesce(F.col("_i"), F.concat(F.lit("<unknown:"), F.col(id_col).cast("string"), F.lit(">")))
    return j.withColumn(out_col, val).drop("_l", "_i")


def width_check(scored_ids: DataFrame, table: DataFrame, id_col: str = "label") -> DataFrame:
    """Ids scored without a map entry, and map entries never scored.

    Output ``(label, problem)`` with problem ``no_intent`` or ``never_scored``.
    """
    ids = scored_ids.select(F.col(id_col).cast("int").alias("label")).distinct()
    known = table.select(F.col("label").cast("int").alias("label"))
    no_intent = ids.join(known, "label", "left_anti").withColumn("problem", F.lit("no_intent"))
    never = known.join(ids, "label", "left_anti").withColumn("problem", F.lit("never_scored"))
    return no_intent.unionByName(never)
