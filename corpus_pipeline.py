"""Corpus pipeline: language ID, exact dedup, near-dedup, decontamination, mixing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents`` and ``lang_pred``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgsift.llm import decontam, exact_dedup, langid, minmax, mixing
from msgsift.llm.common import keep_rows
from msgsift.session import materialize


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language, predicted where it is missing; null texts and texts without a letter go.

    Every text is parsed: ``lang_pred`` is its predicted language, by which the last stage mixes.
    """
    return langid.drop_undetermined(docs, out_lang="lang_pred")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (A-Z lower-cased), the one with the largest id."""
    return exact_dedup.drop_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id."""
    return minmax.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    bench = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    hit = materialize(decontam.contamination(docs, bench).where("contaminated").select("doc_id", "th"), "pipeline-hit")
    return keep_rows(docs, hit, {"doc_id": docs["doc_id"], "th": F.xxhash64(docs["text"])})


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in a stream mixed to tempered source weights, within a source to tempered weights of
    the predicted languages; ``mix_stream`` names a document's source and predicted language."""
    streams = docs.withColumn("mix_stream", F.to_json(F.struct("source", "lang_pred")))
    rows = streams.groupBy("mix_stream", "source", "lang_pred").agg(F.count(F.lit(1)).alias("n")).collect()    # one row per stream
    weights = mixing.nested_weights({(r["source"], r["lang_pred"]): r["n"] for r in rows})
    return mixing.mix(streams, {r["mix_stream"]: weights[r["source"], r["lang_pred"]] for r in rows}, source_col="mix_stream")


STAGES = [
    ("language", language_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
]

# Cross parsing and the earliest-deadline-first schedule have no SQL form: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
