"""Run the split and NB scoring with the first attempt of some tasks failing; print OK
when the results equal a clean run (a task retry recomputes the same rows)."""

import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark import TaskContext  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from msgsift.operators.labels import encode, label_table  # noqa: E402
from msgsift.operators.naive_bayes import predict, score, train_nb  # noqa: E402
from msgsift.operators.split import stratified_split  # noqa: E402
from msgsift.session import ensure_checkpoint_dir  # noqa: E402
from msgsift.sources.tables import labelled  # noqa: E402

spark = (SparkSession.builder.master("local[4,3]")           # up to 3 attempts per task
         .config("spark.sql.shuffle.partitions", "6").config("spark.ui.enabled", "false")
         .config("spark.sql.execution.pythonUDF.arrow.enabled", "false").getOrCreate())
spark.sparkContext.setLogLevel("OFF")
ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="msgsift-retry-"))


@F.udf("bigint")
def flaky(x):
    tc = TaskContext.get()
    if tc is not None and tc.attemptNumber() == 0 and tc.partitionId() % 2 == 0:
        raise RuntimeError("injected task failure")
    return x


def run(inject: bool):
    lab = labelled(spark, sys.argv[1])
    if inject:
        lab = lab.withColumn("doc_id", flaky("doc_id"))
    split = stratified_split(encode(lab, label_table(lab)), on_singleton="train")
    parts = sorted((r["doc_id"], r["part"]) for r in split.select("doc_id", "part").collect())
    train = split.where("part = 'train'")
    model = train_nb(train, min_df=1, max_vocab=500)
    pred = sorted((r["doc_id"], r["pred_label"]) for r in
                  predict(model, score(model, split.where("part = 'test'"))).select("doc_id", "pred_label").collect())
    return parts, pred


clean, retried = run(False), run(True)
print("OK" if clean == retried and clean[0] else "DIFFERENT")
