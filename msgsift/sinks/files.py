"""K1-K5: label map, split tables, predictions, JSON answers, versioned models, the run table.

A model version is a folder ``version=<k>``. Every save writes its tables to a
fresh ``attempt-<id>`` folder in it and then, as its last step, one small
``commit-<time>-<id>.json`` that names the attempt and its row counts. A version is
there once it has such a file; the newest one counts. A save that dies half-way
leaves an attempt that nothing refers to, and a repeated save never touches the
tables that the version before it reads.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.naive_bayes import NBModel


def write_label_map(label_map: DataFrame, path: str) -> None:
    """K1: ``intent,corresponding_label`` CSV (a folder of part files)."""
    (label_map.select("intent", F.col("corresponding_label").cast("int"))
     .write.mode("overwrite").option("header", True).csv(path))


def write_split(split: DataFrame, path: str, fmt: str = "parquet", part_col: str = "part") -> None:
    """K2: the split, one folder per part (``part=train`` / ``part=test``)."""
    cols = ["doc_id", "text", F.col("label").cast("int").alias("label"), part_col]
    w = split.select(*cols).write.mode("overwrite").partitionBy(part_col)
    if fmt == "csv":
        (w.option("header", True).option("quote", '"').option("escape", '"')       # texts keep their edge whitespace
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    else:
        w.parquet(path)


def write_predictions(pred: DataFrame, path: str, id_col: str = "doc_id", fmt: str = "parquet") -> None:
    """K3: ``(doc_id, predicted_label)``; the key is kept so rows stay aligned."""
    out = pred.select(id_col, F.col("pred_label").cast("int").alias("predicted_label"))
    w = out.write.mode("overwrite")
    w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path)


def write_annotated(df: DataFrame, path: str) -> None:
    """The annotated message table as CSV (header, ``"`` quoting, doubled quotes).

    Whitespace is kept as is (Spark's CSV writer trims it by default), so a
    text survives a round trip through :func:`sources.files.read_annotated`.
    """
    (df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def write_lines(df: DataFrame, path: str, text_col: str = "text") -> None:
    """A line corpus: each text followed by a line break (texts may hold several lines)."""
    df.select(F.col(text_col).alias("value")).write.mode("overwrite").text(path)


def write_masked(masked: DataFrame, path: str) -> None:
    """Masked-LM examples of every epoch, one folder per epoch (read back with pruning).

    Rows are brought together by epoch and key hash first, so a task writes
    into few epoch folders instead of all of them.
    """
    spark = masked.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    masked.repartition(n, "epoch", F.pmod(F.xxhash64("doc_id", "line_no"), F.lit(n))).write.mode("overwrite").partitionBy("epoch").parquet(path)


def write_masked_lines(masked: DataFrame, path: str) -> None:
    """The lines of :func:`operators.masking.mask_line_epochs`, one folder per epoch: arrays ``input_ids`` and ``target_ids``.

    A task brings its own lines into epoch order and writes them: the copies of the lines, many times the corpus, are not shuffled.
    """
    masked.select("epoch", "doc_id", "line_no", "input_ids", "target_ids").write.mode("overwrite").partitionBy("epoch").parquet(path)


def write_run(metrics: DataFrame, path: str) -> None:
    """The run table, one partition per ``version``; a version that is written again replaces its rows."""
    (metrics.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs, ``version`` as a column."""
    runs = spark.read.parquet(path)
    return runs.withColumn("version", F.col("version").cast("int"))


def write_answers(answers_json: DataFrame, path: str) -> None:
    """K4: JSON answers as JSON lines ``{"doc_id":..., "json": "[{...}]"}``."""
    answers_json.write.mode("overwrite").json(path)


def _fs(spark: SparkSession, path: str):
    """Hadoop FileSystem of ``path`` (HDFS, object stores, local) and the JVM Path class."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _fs(spark, path)
    return fs.exists(jpath)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, jpath = _fs(spark, path)
    return fs.exists(jpath) and fs.getFileStatus(jpath).isFile()


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, jpath = _fs(spark, path)
    return [st.getPath().getName() for st in fs.listStatus(jpath)] if fs.exists(jpath) else []


def _commits(spark: SparkSession, root: str) -> list[str]:
    """Commit files of a model folder, oldest first."""
    return sorted(n for n in _names(spark, root) if n.startswith("commit-") and n.endswith(".json"))


def _write_small(spark: SparkSession, path: str, text: str) -> None:
    """One small file, complete or absent: written under another name, then renamed."""
    jvm = spark.sparkContext._jvm
    fs, jpath = _fs(spark, path)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(part, jpath):
        raise OSError(f"could not write {path}")


def list_versions(spark: SparkSession, path: str) -> list[int]:
    """Committed model versions under ``path`` (``version=<k>`` folders), ascending."""
    numbers = [int(n[8:]) for n in _names(spark, path) if n.startswith("version=") and n[8:].lstrip("-").isdigit()]
    return sorted(k for k in numbers if _commits(spark, f"{path.rstrip('/')}/version={k}"))


def prune_versions(spark: SparkSession, path: str, keep_last: int) -> list[int]:
    """Delete all but the ``keep_last`` newest committed versions; returns the deleted ones.

    Versions without a commit neither count as kept nor are deleted: their save may still be running.
    """
    versions = list_versions(spark, path)
    old = versions[:-keep_last] if keep_last > 0 else versions
    fs, _ = _fs(spark, path)
    jvm = spark.sparkContext._jvm
    for v in old:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/version={v}"), True)
    return old


def save_model(model: NBModel, path: str, version: int | None = None, keep_last: int | None = None) -> str:
    """K5: weights, counts and vocabulary as parquet, class arrays in the commit file (written last).

    ``version`` writes under ``<path>/version=<k>`` (one folder per epoch/run);
    ``keep_last`` then deletes all but the newest committed versions (the
    corpus trainer keeps 2). Saving a version again replaces it: readers see the old tables until
    the new commit is there, and the old ones are deleted after it.
    """
    root = f"{path.rstrip('/')}/version={version}" if version is not None else path.rstrip("/")
    spark = model.weights.sparkSession
    attempt = f"attempt-{uuid.uuid4().hex[:12]}"
    tables = {"weights": model.weights, "counts": model.counts, "vocab": model.vocabulary()}
    rows = {}
    for name, df in tables.items():
        seen = Observation(name)
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{root}/{attempt}/{name}")
        rows[name] = seen.get["n"]
    before = _commits(spark, root)
    meta = {"labels": model.labels, "intents": model.intents, "log_prior": model.log_prior,
            "n_tokens": model.n_tokens, "vocab_size": model.vocab_size, "kind": model.kind,
            "params": model.params, "attempt": attempt, "rows": rows}
    _write_small(spark, f"{root}/commit-{time.time_ns():020d}-{uuid.uuid4().hex[:6]}.json", json.dumps(meta))
    fs, _ = _fs(spark, root)
    for name in before:
        old = json.loads(spark.read.text(f"{root}/{name}").first()[0])["attempt"]
        for gone in (name, old):
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{gone}"), True)
    if version is not None and keep_last:
        prune_versions(spark, path, keep_last)
    return root


def load_model(spark: SparkSession, root: str, version: int | str | None = None, check: bool = False) -> NBModel:
    """The model written by :func:`save_model`; ``version="latest"`` picks the newest committed one.

    ``check`` counts the tables' rows (from their footers) and compares them with the commit's.
    """
    if version == "latest":
        versions = list_versions(spark, root)
        if not versions:
            raise FileNotFoundError(f"no model version under {root}")
        version = versions[-1]
    if version is not None:
        root = f"{root.rstrip('/')}/version={version}"
    commits = _commits(spark, root)
    if not commits:
        raise FileNotFoundError(f"no committed model in {root}")
    meta = json.loads(spark.read.text(f"{root.rstrip('/')}/{commits[-1]}").first()[0])
    tables = {name: spark.read.parquet(f"{root.rstrip('/')}/{meta['attempt']}/{name}") for name in meta["rows"]}
    if check:
        for name, df in tables.items():
            if df.count() != meta["rows"][name]:
                raise ValueError(f"{root}: {name} does not hold the {meta['rows'][name]} rows of its commit")
    return NBModel(weights=tables["weights"], counts=tables["counts"], vocab=tables["vocab"],
                   labels=meta["labels"], intents=meta["intents"], log_prior=meta["log_prior"],
                   n_tokens=meta["n_tokens"], vocab_size=meta["vocab_size"], kind=meta["kind"],
                   params=meta["params"])
