"""Registered queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, exact_dedup, langid, merkle, minmax, mixing, ngramlm, periodic, secrets, substring, tokencount, toxicity, warc
from .common import crc_mod


# the public unigram vocabulary; another file through the environment variable or count_tokens' parameter
VOCABULARY = os.environ.get("MSGSIFT_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.fit(docs), keep=["doc_id"])
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), VOCABULARY)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("th")


def op9_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramlm.fit_and_score(_table(spark, sf_dir, "documents"))


def op10_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_groups(_table(spark, sf_dir, "documents")).drop("th")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_spans(_table(spark, sf_dir, "documents")).drop("spans")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents; where 7 divides the id's checksum, n_chars is tampered with before the check."""
    docs = _table(spark, sf_dir, "documents")
    fields = {c: docs[c] for c in merkle.FIELDS}
    touched = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 0
    found = F.when(touched, merkle.leaf_digest([*(fields | {"n_chars": docs["n_chars"] + 1}).values()]))
    out = merkle.manifest(docs, leaves={"leaf": merkle.leaf_digest([*fields.values()]), "found": found})
    out = out.withColumn("folded_root", merkle.root_from(F.coalesce("found", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"),
                      "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_SPACES = r"[^\x20\x09-\x0D]+"


def planted_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): where 10 divides the id's checksum h, the words from place a on repeat the p words there.

    a = floor(h / 10) % n, p = 1 + floor((n - a) / (3 + floor(h / 10) % 8)), n words.
    """
    h = F.crc32(docs["doc_id"].cast("string").cast("binary"))
    t = docs.select("doc_id", F.col("text").cast("string").alias("text"), h.alias("h"), F.expr("cast(null as array<string>)").alias("w"))
    t = t.withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(_SPACES), F.lit(0))))
    cut = F.expr("cast(h div 10 % size(w) as int)")
    t = t.withColumn("a", F.when(F.size("w") > 0, cut))
    t = t.withColumn("p", F.expr("cast(1 + (size(w) - a) div (3 + h div 10 % 8) as int)"))
    again = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[a + (i - a) % p])), ' ')")
    return t.select("doc_id", F.when(F.col("a").isNotNull(), again).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.periodic_runs(planted_repeats(_table(spark, sf_dir, "documents")))
    best = periodic.longest(F.col("runs"))
    out = out.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"),
                     periodic.runs_digest(F.col("runs")).alias("runs_sha256"), "collapsed_sha256")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                      F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_language_id": op2_language_id,
    "op3_token_counts": op3_token_counts,
    "op4_source_mixing": op4_source_mixing,
    "op5_secret_scan": op5_secret_scan,
    "op6_warc": op6_warc,
    "op7_toxicity": op7_toxicity,
    "op8_decontamination": op8_decontamination,
    "op9_ngram_lm": op9_ngram_lm,
    "op10_minmax_near_dedup": op10_minmax_near_dedup,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_periodic_runs": op13_periodic_runs,
}
