"""The stream reads its table as one file or as a folder of files, and answers of an empty table are no rows."""

import os

import pytest

from msgsift.operators.naive_bayes import train_nb
from msgsift.sources.tables import messages
from msgsift.streaming.score_stream import message_stream, read_answers, start_answering

ROWS = [(1, 0, "user", "good day"), (1, 1, "assistant", "sad night"), (2, 0, "user", ""), (None, 3, "user", None)]


@pytest.mark.parametrize("kind", ["file", "folder", "empty folder"])
def test_a_table_is_streamed_as_it_is_read(spark, tmp_dir, kind):
    model = train_nb(spark.createDataFrame([(1, "good happy", 0, "pos"), (2, "sad bad", 1, "neg")], "doc_id BIGINT, text STRING, label INT, intent STRING"))
    df = spark.createDataFrame([] if kind == "empty folder" else ROWS, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    df.repartition(1 if kind == "file" else 3).write.parquet(f"{tmp_dir}/w")
    df.write.parquet(f"{tmp_dir}/sf/documents.parquet")          # another table beside it
    os.makedirs(f"{tmp_dir}/sf", exist_ok=True)
    path = f"{tmp_dir}/sf/conversations.parquet"
    if kind == "file":
        part = next(n for n in os.listdir(f"{tmp_dir}/w") if n.startswith("part-") and n.endswith(".parquet"))
        os.link(f"{tmp_dir}/w/{part}", path)
    else:
        df.repartition(3).write.parquet(path)
    start_answering(model, message_stream(spark, path), f"{tmp_dir}/out", f"{tmp_dir}/ckpt").awaitTermination()
    got = read_answers(spark, f"{tmp_dir}/out").select("msg_id", "json").collect()
    assert sorted(r["msg_id"] for r in got) == sorted(r["msg_id"] for r in messages(spark, f"{tmp_dir}/sf").collect())
    assert len(got) == (0 if kind == "empty folder" else len(ROWS))


def test_no_answers_before_the_first_batch(spark, tmp_dir):
    assert read_answers(spark, f"{tmp_dir}/none").collect() == []


def test_stream_query_reads_a_table_of_several_files(spark, tmp_dir):
    from msgsift.plans.queries import QUERIES
    from .conftest import SF_SMALL
    for name in ("documents", "labels"):
        os.symlink(f"{SF_SMALL}/{name}.parquet", f"{tmp_dir}/{name}.parquet")
    spark.read.parquet(f"{SF_SMALL}/conversations.parquet").repartition(3).write.parquet(f"{tmp_dir}/conversations.parquet")
    want = QUERIES["stream_score"](spark, SF_SMALL).collect()
    assert len(want) > 0 and sorted(map(tuple, QUERIES["stream_score"](spark, tmp_dir).collect())) == sorted(map(tuple, want))
