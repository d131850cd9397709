import pytest
from pyspark.sql import functions as F

from msgsift.operators.clean import drop_missing, feature_table, normalize_na, select_feature, validate
from msgsift.sources.files import read_annotated, read_corpus, split_lines

HEADER = "Index,Original Text,Translation,Intent1_Cleaned,Intent2,Other,Quality Check,Intent1_Original\n"


def _write(path, text):
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)


def test_quoted_newline_comma_quotes_and_blank_tail(spark, tmp_dir):
    p = f"{tmp_dir}/a.csv"
    _write(p, HEADER + '1,"line one\nline, ""two""",tr,normal,,,,normal\n\n')
    rows = read_annotated(spark, p).collect()
    assert len(rows) == 1
    assert rows[0]["Original Text"] == 'line one\nline, "two"'
    assert rows[0]["Intent2"] is None


@pytest.mark.parametrize("marker", ["", "NA", "nan", "NULL", "#N/A"])
def test_na_markers_drop_the_row(spark, marker):
    df = spark.createDataFrame([(1, "hello", marker, "x"), (2, "world", "ok", "y")],
                               "`Index` INT, `Original Text` STRING, Translation STRING, Intent1_Cleaned STRING")
    kept = drop_missing(normalize_na(df), "Translation")
    assert [r["Index"] for r in kept.collect()] == [2]


def test_validation_rejects_empty_feature_and_label(spark):
    df = spark.createDataFrame(
        [(1, "", "tr", "a"), (2, "text", "tr", ""), (3, "text", "tr", "b")],
        "`Index` INT, `Original Text` STRING, Translation STRING, Intent1_Cleaned STRING")
    chosen = select_feature(drop_missing(normalize_na(df)))
    good, bad = validate(chosen, on_bad="quarantine")
    assert [r["doc_id"] for r in good.collect()] == [3]
    assert sorted((r["doc_id"], r["reason"]) for r in bad.collect()) == [(1, "feature"), (2, "label")]
    with pytest.raises(Exception):
        validate(chosen, on_bad="error").collect()
    st = {r["doc_id"]: r["status"] for r in feature_table(df.withColumn("Other", F.lit(None))).collect()}
    assert st == {1: "missing_feature", 2: "missing_label", 3: "ok"}


def test_corpus_lines_follow_splitlines(spark, tmp_dir):
    text = "first\n\n   \nin side\nnel\u0085here\r\nlast line\rno newline"
    p = f"{tmp_dir}/c.txt"
    _write(p, text)
    got = [r["value"] for r in read_corpus(spark, p).orderBy("line_no", "piece").collect()]
    want = [x for x in text.splitlines() if not x.isspace() and x != ""]
    assert got == want


def test_line_numbers_do_not_depend_on_how_the_scan_cuts_the_files(spark, tmp_dir):
    for name, n in (("a", 4000), ("b", 300)):
        _write(f"{tmp_dir}/{name}.txt", "".join(f"{name} line {i}\n" if i % 7 else "\n" for i in range(n)))
    want = {(name, i, f"{name} line {i}") for name, n in (("a", 4000), ("b", 300)) for i in range(n) if i % 7}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (old, "7000", "64000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = [(r["file"].rsplit("/", 1)[1][0], r["line_no"], r["value"])
                   for r in read_corpus(spark, f"{tmp_dir}/*.txt").collect()]
            assert len(got) == len(want) and set(got) == want, size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_split_lines_all_breaks_match_python(spark):
    text = "a\r\nb\x0bc\x0cd\x1ce\x1df\x1eg\x85h i j\n \t　\nk"
    df = spark.createDataFrame([(1, text)], "doc_id BIGINT, text STRING")
    from msgsift.functions.text import ALL_LINE_BREAKS
    got = [(r["line_no"], r["line"]) for r in split_lines(df, "text", ["doc_id"], ALL_LINE_BREAKS)
           .orderBy("line_no").collect()]
    want = [(i, x) for i, x in enumerate(text.splitlines()) if x.strip() != "" and not x.isspace()]
    assert got == want
