"""Binding of the roles (labelled messages, corpus, new messages) to parquet tables.

labelled    = documents JOIN labels ON doc_id, intent = lang_q<quality>_t<toxic>
unlabelled  = documents LEFT ANTI labels
messages    = conversations, key msg_id = "<conv_id>:<turn>"
annotated   = documents LEFT JOIN labels in the annotated-table shape (D1)

Splits are decided on the narrow :func:`labelled_keys`; :func:`with_text` joins
the texts once, where tokens are needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def message_key(conv: str = "conv_id", turn: str = "turn"):
    """``"<conv_id>:<turn>"``: the pair itself as text, so no two messages share a key (null reads as empty)."""
    return F.concat(F.coalesce(F.col(conv).cast("string"), F.lit("")), F.lit(":"),
                    F.coalesce(F.col(turn).cast("string"), F.lit("")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def under_split(scan: DataFrame) -> int:
    """Cores to spread over when a plain scan yields fewer tasks than cores, else 0.

    Only call this on a scan (no exchange): asking a plan with joins for its
    partition count can run its shuffle stages.
    """
    try:
        cores = scan.sparkSession.sparkContext.defaultParallelism
        return 0 if scan.rdd.getNumPartitions() >= cores else cores
    except Exception:  # noqa: BLE001 - no RDD view (e.g. a remote session): leave the scan as read
        return 0


def spread(df: DataFrame, key: str, scan: DataFrame | None = None) -> DataFrame:
    """Hash-partition ``df`` by ``key`` when its input ``scan`` is under-split.

    A big input arrives as many files/row groups and is left alone; a scan
    of one row group (one task) is spread so per-row work runs in parallel.
    Partitioning by the text key also lets later ``groupBy(key)`` steps reuse
    it instead of shuffling again. ``scan`` defaults to ``df`` itself.
    """
    cores = under_split(df if scan is None else scan)
    return df.repartition(cores * 2, key) if cores else df


def intent_expr(lang="lang", quality="quality", toxic="toxic"):
    return F.concat(F.col(lang), F.lit("_q"), F.col(quality).cast("string"),
                    F.lit("_t"), F.col(toxic).cast("string"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text, intent)`` for every labelled document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    # spread after the join: only the labelled rows move
    out = docs.join(labels, "doc_id").select("doc_id", "text", intent_expr().alias("intent"))
    return spread(out, "doc_id", scan=docs)


def labelled_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, intent)`` for every labelled document: no text is read."""
    return labelled(spark, sf_dir).select("doc_id", "intent")


def with_text(spark: SparkSession, sf_dir: str, keys: DataFrame) -> DataFrame:
    """The rows of ``keys`` (unique ``doc_id``) with their ``text``: the one join that carries texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spread(docs.join(keys, "doc_id"), "doc_id", scan=docs)


def unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text)`` for documents without a label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id")
    return spread(docs.join(labels, "doc_id", "left_anti"), "doc_id", scan=docs)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(msg_id, conv_id, turn, role, text)`` new messages to answer."""
    conv = table(spark, sf_dir, "conversations")
    out = conv.select(message_key().alias("msg_id"), "conv_id", "turn", "role", "text")
    # spread by the unique message key: one long conversation stays in many tasks
    return spread(out, "msg_id")


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the annotated-table shape.

    ``Translation`` (into English) is the whole text of an English document and
    null where the tables hold no translation (other languages) or the text is
    empty; ``Intent1_Cleaned`` is null for unlabelled documents.
    """
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    j = docs.join(labels, "doc_id", "left")
    translation = F.when(F.col("lang") == "en", F.nullif(F.col("text"), F.lit("")))
    return j.select(
        F.col("doc_id").alias("Index"),
        F.col("text").alias("Original Text"),
        translation.alias("Translation"),
        intent_expr().alias("Intent1_Cleaned"),
        F.lit(None).cast("string").alias("Intent2"),
        F.col("source").alias("Other"),
        F.lit(None).cast("string").alias("Quality Check"),
        intent_expr().alias("Intent1_Original"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, spread by ``doc_id`` when the scan is under-split."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")
