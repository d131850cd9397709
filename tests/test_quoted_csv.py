"""Quoted CSV read by many tasks: the rows that Spark's one-task reader gives, wherever the splits fall."""

import random

import pytest
from pyspark.sql import functions as F

from msgsift.sinks.files import write_annotated, write_split
from msgsift.sources.files import _csv, read_annotated, read_split
from msgsift.sources.quoted import read_quoted_csv

SCHEMA = "doc_id BIGINT, text STRING, label INT"
ODD = ["plain", "", " edges ", "two\nlines", "a\n\n\nb", "\n", "\"", "\"\"", "say \"hi\"", "comma, inside", "\",\"\n\"", "tab\there",
       "é 漢字 😀", "x" * 3000, "ends with quote\"", "\"starts", "cr\r\nlf", "back\\slash", "#", "null", "line\n" * 300, "q\"\n\"q\n" * 40]


@pytest.fixture()
def small_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {k: spark.conf.get(k, None) for k in keys}

    def use(size):
        spark.conf.set(keys[0], str(size))
        spark.conf.set(keys[1], "1")
    yield use
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _quote(v):
    return "" if v is None else '"' + v.replace('"', '""') + '"'


def _file(path, rows, end="\n", header=True, tail=True):
    lines = (["doc_id,text,label"] if header else []) + [f"{i},{_quote(t)},{n}" for i, t, n in rows]
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(end.join(lines) + (end if tail else ""))


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("size", [37, 100, 1000, 1 << 20])
def test_same_rows_for_any_split_size(spark, small_splits, tmp_dir, size):
    rng = random.Random(size)
    want = []
    for k in range(3):
        rows = [(1000 * k + i, rng.choice(ODD) if rng.random() < 0.9 else None, i) for i in range(60)]
        rows = [(i, t, n) for i, t, n in rows if size > 37 or len(t or "") < 400]
        _file(f"{tmp_dir}/f{k}.csv", rows, tail=k != 1)
        want += rows
    small_splits(size)
    got = _rows(read_quoted_csv(spark, tmp_dir, SCHEMA))
    assert got == sorted(want, key=str)
    plain = _rows(_csv(spark, SCHEMA, True).csv(tmp_dir))          # this reader makes an empty text null
    assert sorted([(i, t or None, n) for i, t, n in got], key=str) == plain


def test_windows_line_ends_blank_lines_and_header_only(spark, small_splits, tmp_dir):
    _file(f"{tmp_dir}/a.csv", [(1, "x\r\ny", 2), (2, "z", 3)], end="\r\n")
    _file(f"{tmp_dir}/b.csv", [])
    with open(f"{tmp_dir}/c.csv", "w") as f:
        f.write('\n\ndoc_id,text,label\n\n3,"p\n\nq",4\n\n\n5,,6\n')
    open(f"{tmp_dir}/d.csv", "w").close()
    small_splits(11)
    assert _rows(read_quoted_csv(spark, tmp_dir, SCHEMA)) == [(1, "x\r\ny", 2), (2, "z", 3), (3, "p\n\nq", 4), (5, None, 6)]
    assert _rows(read_quoted_csv(spark, f"{tmp_dir}/d.csv", SCHEMA)) == []


def test_header_may_hold_line_breaks_and_rows_may_have_none(spark, small_splits, tmp_dir):
    with open(f"{tmp_dir}/a.csv", "w") as f:
        f.write('"doc\nid","te\nxt",label\n1,"a",2\n')
    small_splits(4)
    assert _rows(read_quoted_csv(spark, tmp_dir, SCHEMA)) == [(1, "a", 2)]
    _file(f"{tmp_dir}/a.csv", [(1, "a", 2)], header=False)
    assert _rows(read_quoted_csv(spark, tmp_dir, SCHEMA, header=False)) == [(1, "a", 2)]


def test_a_malformed_record_fails(spark, tmp_dir):
    with open(f"{tmp_dir}/a.csv", "w") as f:
        f.write('doc_id,text,label\nnot a number,"a",2\n')
    with pytest.raises(Exception):
        read_quoted_csv(spark, tmp_dir, SCHEMA).collect()


def test_many_tasks_read_one_file(spark, small_splits, tmp_dir):
    _file(f"{tmp_dir}/one.csv", [(i, ODD[i % len(ODD)], i) for i in range(400)])
    small_splits(4000)
    parts = spark.read.option("lineSep", "\n").text(tmp_dir).rdd.getNumPartitions()
    assert parts > 10 and _csv(spark, SCHEMA, True).csv(tmp_dir).rdd.getNumPartitions() == 1
    assert read_quoted_csv(spark, tmp_dir, SCHEMA).count() == 400


def test_split_and_annotated_tables_survive_odd_texts(spark, small_splits, tmp_dir):
    rows = [(i, t, i % 3, "train" if i % 2 else "test") for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, label INT, part STRING")
    write_split(df.coalesce(1), f"{tmp_dir}/s", fmt="csv")
    small_splits(200)
    for part in ("train", "test"):
        want = [(i, t, n) for i, t, n, p in rows if p == part]
        assert _rows(read_split(spark, f"{tmp_dir}/s/part={part}")) == sorted(want, key=str)
    table = df.select(F.col("doc_id").cast("int").alias("Index"), F.col("text").alias("Original Text"), F.lit("").alias("Translation"),
                      F.lit(None).cast("string").alias("Intent1_Cleaned"), F.col("text").alias("Intent2"), F.lit("o").alias("Other"),
                      F.lit(None).cast("string").alias("Quality Check"), F.col("part").alias("Intent1_Original"))
    write_annotated(table.coalesce(1), f"{tmp_dir}/a")
    assert _rows(read_annotated(spark, f"{tmp_dir}/a")) == _rows(table)
