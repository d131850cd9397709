"""File scans (S1-S4): annotated CSV, text,label CSV, line corpus, label map."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import ANNOTATED_SCHEMA, LABEL_MAP_SCHEMA, SPLIT_SCHEMA
from ..functions.text import EXTRA_LINE_BREAKS, is_blank
from ..session import materialize
from .quoted import read_quoted_csv


def _csv(spark: SparkSession, schema: str, multiline: bool):
    return (spark.read.schema(schema)
            .option("header", True)
            .option("multiLine", multiline)
            .option("quote", '"')
            .option("escape", '"')
            .option("mode", "FAILFAST"))


def _read_quoted(spark: SparkSession, path: str, schema: str, multiline: bool, bare_quotes: bool) -> DataFrame:
    if multiline and not bare_quotes:
        return read_quoted_csv(spark, path, schema)
    return _csv(spark, schema, multiline).csv(path)


def read_annotated(spark: SparkSession, path: str, multiline: bool = True, bare_quotes: bool = False) -> DataFrame:
    """The annotated message table with its explicit schema.

    ``multiline`` keeps line breaks inside quoted fields; big files are still
    read by many tasks (:mod:`.quoted`). Files with quotes inside unquoted
    fields (``bare_quotes``) are left to Spark's reader, one task per file.
    """
    return _read_quoted(spark, path, ANNOTATED_SCHEMA, multiline, bare_quotes)


def read_split(spark: SparkSession, path: str, multiline: bool = True, bare_quotes: bool = False) -> DataFrame:
    """A ``doc_id,text,label`` table as written by :func:`sinks.write_split`; options as in :func:`read_annotated`."""
    return _read_quoted(spark, path, SPLIT_SCHEMA, multiline, bare_quotes)


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """The ``intent,corresponding_label`` table."""
    return _csv(spark, LABEL_MAP_SCHEMA, False).csv(path)


def split_lines(df: DataFrame, text_col: str = "value", keep: list[str] | None = None,
                breaks: str = EXTRA_LINE_BREAKS) -> DataFrame:
    """Split on the remaining ``str.splitlines`` boundaries, drop blank lines.

    Output ``(*keep, line_no, line)``; ``line_no`` counts pieces before the
    blank filter, so it is the index ``splitlines`` would give.
    """
    keep = list(keep or [])
    pieces = df.select(*keep, F.posexplode(F.split(F.col(text_col), breaks)).alias("line_no", "line"))
    return pieces.where(~is_blank("line")).withColumn("line_no", F.col("line_no").cast("bigint"))


def _split_base(base: DataFrame):
    """A column function: row number -> ``_base`` of its scan split (the last one that starts at or before it)."""
    rows = base.select("_first", "_base").toArrow()
    first, shift = (rows.column(c).to_numpy() for c in ("_first", "_base"))
    order = np.argsort(first)
    table = base.sparkSession.sparkContext.broadcast((first[order], shift[order]))

    @F.pandas_udf("bigint")
    def look_up(ids: pd.Series) -> pd.Series:
        firsts, shifts = table.value
        return pd.Series(shifts[np.searchsorted(firsts, ids.to_numpy(), side="right") - 1])
    return look_up


def read_corpus(spark: SparkSession, path: str, join_splits: int = 100_000) -> DataFrame:
    """S3: one example per non-blank line, ``(file, line_no, piece, value)``.

    The text source splits on ``\\n``, ``\\r\\n`` and ``\\r`` and stays splittable;
    the other ``splitlines`` boundaries are split per row (``piece``).
    ``line_no`` counts the lines of the file from 0, however the scan cuts the
    file: lines before the scan split (a running sum over one row per split)
    plus the place inside the split, whose rows are numbered consecutively.
    Up to ``join_splits`` splits join by broadcast. Beyond, the splits' first row numbers
    travel with the tasks as a sorted array (16 bytes per split) and each
    batch of row numbers is looked up in it: the lines themselves are not
    shuffled, however many splits there are.
    """
    raw = (spark.read.text(path)
           .select("value", F.col("_metadata.file_path").alias("file"),
                   F.col("_metadata.file_block_start").alias("_block"),
                   F.monotonically_increasing_id().alias("_id")))
    splits = raw.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_block")) - F.col("_n")
    base = materialize(splits.select("file", "_block", "_first", (before - F.col("_first")).alias("_base")), "corpus-splits")
    if base.count() <= join_splits:
        shift = F.broadcast(base.drop("_first"))
        numbered = raw.join(shift, ["file", "_block"]).withColumn("line_no", F.col("_id") + F.col("_base"))
    else:
        numbered = raw.withColumn("line_no", F.col("_id") + _split_base(base)(F.col("_id")))
    pieces = split_lines(numbered.withColumnRenamed("line_no", "row_no"), "value", ["file", "row_no"])
    return pieces.select("file", F.col("row_no").alias("line_no"), F.col("line_no").alias("piece"),
                         F.col("line").alias("value"))
