"""Physical-plan checks for the scale design: what each shuffle carries."""

import contextlib
import io
import re

from pyspark.sql import functions as F

from msgsift.operators.naive_bayes import score, train_nb
from msgsift.operators.split import stratified_split
from msgsift.operators.tokens import vocab_from_texts
from msgsift.session import materialize


def _exchanges(df):
    """``[(arguments, input columns)]`` of every shuffle Exchange (broadcasts excluded)."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    text = buf.getvalue()
    out = []
    for m in re.finditer(r"\(\d+\) Exchange\s*\nInput \[\d+\]: \[(.*?)\]\nArguments: (.*?)\n", text):
        cols = [c.split("#")[0] for c in m.group(1).split(", ")]
        out.append((m.group(2), cols))
    return out, text


def _docs(spark, n=400):
    rows = [(i, f"word{i % 17} text {i % 5} more words", ["a", "b", "c"][i % 3]) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, intent STRING")
    return materialize(df.repartition(4), "plan-input")   # a scan with no exchange of its own


def test_split_never_shuffles_texts(spark):
    ex, text = _exchanges(stratified_split(_docs(spark)))
    assert ex, text
    for args, cols in ex:
        assert "text" not in cols, (args, cols)


def test_scoring_shuffles_one_partial_row_per_text(spark):
    docs = _docs(spark)
    model = train_nb(docs.withColumn("label", F.when(F.col("intent") == "a", 0).otherwise(1)),
                     min_df=1, max_vocab=50)
    ex, text = _exchanges(score(model, docs))          # weights shipped with the tasks: no shuffle
    assert ex == [] and "MapInArrow" in text, text
    ex, text = _exchanges(score(model, docs, lookup_bytes=0))   # join path
    assert len(ex) == 1, text
    args, cols = ex[0]
    assert args.startswith("hashpartitioning(doc_id") and "token" not in cols and "text" not in cols
    assert "HashAggregate" in text and "partial_sum" in text


def test_vocabulary_shuffles_partial_counts_per_token(spark):
    ex, text = _exchanges(vocab_from_texts(_docs(spark), min_df=1, max_vocab=10))
    agg = [cols for args, cols in ex if args.startswith("hashpartitioning(token")]
    assert agg and all("doc_id" not in c and "text" not in c for c in agg), text
    assert "TakeOrderedAndProject" in text or "partial_sum" in text


def test_scans_read_only_needed_columns(spark):
    from msgsift.sources.tables import labelled
    _, text = _exchanges(labelled(spark, "/root/testdata/sf0.001").select("doc_id", "intent"))
    schemas = re.findall(r"ReadSchema: (struct<.*?>)", text)
    assert schemas and all("text" not in s for s in schemas), schemas


def test_epoch_table_reads_one_partition(spark, tmp_dir):
    from msgsift.operators.masking import mask_epochs
    from msgsift.sinks.files import write_masked
    ids = spark.range(200).select((F.col("id") % 7).alias("doc_id"), F.lit(0).alias("line_no"),
                                  F.col("id").alias("pos"), (F.col("id") % 20 + 4).cast("int").alias("token_id"))
    write_masked(mask_epochs(ids, 20, ["doc_id", "line_no", "pos"], 4), f"{tmp_dir}/m")
    last = spark.read.parquet(f"{tmp_dir}/m").where(F.col("epoch") == 3)
    _, text = _exchanges(last)
    assert re.search(r"PartitionFilters: \[.*epoch", text), text
    assert last.count() == 200


def test_encoding_has_no_shuffle(spark):
    from msgsift.operators.tokens import encode, vocab_from_texts
    docs = _docs(spark)
    vocab = materialize(vocab_from_texts(docs, min_df=1, max_vocab=20), "plan-vocab")
    ex, text = _exchanges(encode(docs, vocab, pad_to="max_len"))
    assert ex == [], text
    assert "MapInArrow" in text or "PythonMapInArrow" in text


def test_split_writes_no_texts(spark):
    from msgsift.plans.queries import _split
    assert _split(spark, "/root/testdata/sf0.001").columns == ["doc_id", "intent", "label", "part"]
