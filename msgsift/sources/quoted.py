"""Quoted CSV with line breaks inside fields, read by all tasks of a splittable scan.

Spark's ``multiLine`` reader gives a file to one task. Here the files are
scanned as lines, cut into splits like any text:

1. One pass counts the quotes of every split. Their running parity (one row
   per split) says whether a split begins inside a quoted field.
2. A second pass walks each split's lines in order, keeps the parity, and puts
   the lines of a record together where they are. Only the pieces of records
   that cross a split border, at most two per split, are grouped by record.
3. Records are parsed by ``from_csv``.

Quotes may stand in quoted fields only, doubled (RFC 4180, as Spark's writer
gives with ``escape`` set to the quote); files with bare quotes inside unquoted
fields need the ``multiLine`` reader.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import materialize

QUOTE = '"'


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _split_records(starts: dict[str, dict[int, tuple[int, int]]]):
    """Per scan split its whole records and the pieces at its borders.

    ``starts``: per file and split, whether it begins inside quotes, and its number in the file.
    """
    names = ["file", "split", "first", "last", "lead", "record"]

    def run(batches):
        held, where, inside, begun, top = [], None, 0, False, False      # the open record of the split being read

        def close(last: bool):
            """The open record; ``first``: it begins in this split, ``last``: it ends in it, ``lead``: it is the file's first."""
            file, block = where
            return (file, starts[file][block][1], begun, last, top, "\n".join(held))
        for b in batches:
            out = []
            values = b.column(2)
            quotes = pc.count_substring(pc.fill_null(values, ""), QUOTE).to_numpy(zero_copy_only=False) & 1
            files, blocks, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), values.to_pylist()
            for at, odd, text in zip(zip(files, blocks), quotes.tolist(), texts):
                if at != where:
                    if held:
                        out.append(close(False))
                    where, held, (inside, k) = at, [], starts[at[0]][at[1]]
                    begun, top = not inside, k == 0
                held.append(text)
                inside ^= odd
                if not inside:
                    blank = begun and len(held) == 1 and text in ("", "\r")
                    if not blank:
                        out.append(close(True))
                        top = False
                    held, begun = [], True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(close(False))], names=names)
    return run


def read_quoted_csv(spark: SparkSession, path: str, schema: StructType | str, header: bool = True) -> DataFrame:
    """The records of all files under ``path``; line breaks inside quoted fields stay part of the field.

    ``header``: the first record of every file is dropped. Blank lines between
    records are skipped. An empty field is null, a quoted empty one is an empty text. A malformed record fails the job.
    """
    raw = _lines(spark, path)
    odd = F.sum(F.length("value") - F.length(F.replace("value", F.lit(QUOTE), F.lit("")))) % 2
    splits = materialize(raw.groupBy("file", "block").agg(odd.alias("odd")), "csv-splits")
    before = Window.partitionBy("file").orderBy("block")
    begins = ((F.sum("odd").over(before) - F.col("odd")) % 2).cast("int")
    table = splits.select("file", "block", begins.alias("inside"), (F.row_number().over(before) - 1).alias("k")).toArrow()
    starts: dict[str, dict[int, tuple[int, int]]] = {}            # one entry per split
    for file, block, inside, k in zip(*(table.column(c).to_pylist() for c in table.column_names)):
        starts.setdefault(file, {})[block] = (inside, k)

    shape = "file string, split bigint, first boolean, last boolean, lead boolean, record string"
    pieces = materialize(raw.mapInArrow(_split_records(starts), shape), "csv-records")
    whole = pieces.where("first and last").select("lead", "record")
    # a record that crosses borders: its first piece, pieces without an end, its last piece
    cut = pieces.where("not (first and last)")
    opened = F.sum(F.col("first").cast("int")).over(Window.partitionBy("file").orderBy("split", F.col("first").cast("int")))
    joined = (cut.withColumn("r", opened).groupBy("file", "r")
              .agg(F.max("lead").alias("lead"), F.array_sort(F.collect_list(F.struct("split", "record"))).alias("p"))
              .select("lead", F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record")))
    records = whole.unionByName(joined)
    if header:
        records = records.where("not lead")
    records = records.select(F.regexp_replace("record", "\\r\\z", "").alias("record"))
    shape = schema if isinstance(schema, str) else schema.simpleString()[7:-1]
    # an empty field is null, a quoted empty one an empty text: so null needs a mark that is not the empty text
    options = {"quote": QUOTE, "escape": QUOTE, "mode": "FAILFAST", "multiLine": "true", "nullValue": "\u0000", "emptyValue": ""}
    return records.select(F.from_csv("record", shape, options).alias("x")).select("x.*")

