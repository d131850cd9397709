"""Feature choice, NA normalisation, null-row filter, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import na_to_null


def normalize_na(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pandas NA markers in string columns become null."""
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return df.select(*[na_to_null(F.col(f"`{c}`")).alias(c) if c in cols else F.col(f"`{c}`")
                       for c in df.columns])


def drop_missing(df: DataFrame, required_col: str = "Translation") -> DataFrame:
    """Drop a row when ``required_col`` is null (the project filters on
    ``Translation`` whatever the feature is; configurable here)."""
    return df.na.drop(subset=[required_col])


def select_feature(df: DataFrame, feature: str = "Original Text", label: str = "Intent1_Cleaned",
                   key: str = "Index") -> DataFrame:
    """``(doc_id, text, intent)`` from the annotated shape."""
    return df.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"),
                     F.col(f"`{feature}`").alias("text"),
                     F.col(f"`{label}`").alias("intent"))


def bad_reason(text_col: str = "text", label_col: str | None = "intent", allow_empty: bool = False) -> Column:
    """``feature`` or ``label`` for an invalid row, null for a good one.

    A null/empty feature (null only with ``allow_empty``) or a null/empty label is invalid.
    """
    missing = F.col(text_col).isNull()
    reason = F.when(missing if allow_empty else missing | (F.col(text_col) == ""), F.lit("feature"))
    if label_col is not None:
        reason = reason.when(F.col(label_col).isNull() | (F.col(label_col) == ""), F.lit("label"))
    return reason


def counted(df: DataFrame, text_col: str = "text", label_col: str | None = "intent",
            allow_empty: bool = False) -> tuple[DataFrame, Observation]:
    """The rows with their ``reason``, and counts that come with the first action on them (a write, say).

    ``n_rows``, ``n_good``, ``n_feature`` and ``n_label`` are read with
    ``Observation.get`` after it; no job is run for them.
    """
    seen = Observation()
    n = F.count(F.lit(1))
    tagged = df.withColumn("reason", bad_reason(text_col, label_col, allow_empty))
    return tagged.observe(seen, n.alias("n_rows"), F.count_if(F.col("reason").isNull()).alias("n_good"),
                          F.count_if(F.col("reason") == "feature").alias("n_feature"),
                          F.count_if(F.col("reason") == "label").alias("n_label")), seen


def validate(df: DataFrame, text_col: str = "text", label_col: str | None = "intent",
             on_bad: str = "error", allow_empty: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """P4 by :func:`bad_reason`.

    ``on_bad="error"`` fails the job at the first bad row (``raise_error``);
    ``"quarantine"`` returns ``(good, rejected)`` with a ``reason`` column.
    """
    tagged = df.withColumn("reason", bad_reason(text_col, label_col, allow_empty))
    if on_bad == "error":
        # a filter (not a dropped column) so column pruning keeps the check
        ok = F.when(F.col("reason").isNotNull(),
                    F.raise_error(F.concat(F.lit("invalid row: missing "), F.col("reason")))) \
            .otherwise(F.lit(True))
        return tagged.where(ok).drop("reason")
    if on_bad == "quarantine":
        return tagged.where(F.col("reason").isNull()).drop("reason"), tagged.where(F.col("reason").isNotNull())
    raise ValueError(f"on_bad must be 'error' or 'quarantine', not {on_bad!r}")


def feature_table(df: DataFrame, feature: str = "Original Text", required_col: str = "Translation",
                  label: str = "Intent1_Cleaned", key: str = "Index") -> DataFrame:
    """S1 -> P2 -> P1 with a ``status`` column (``ok`` / ``missing_feature`` / ``missing_label``)."""
    clean = drop_missing(normalize_na(df), required_col)
    chosen = select_feature(clean, feature, label, key)
    status = (F.when(F.col("text").isNull(), F.lit("missing_feature"))
              .when(F.col("intent").isNull(), F.lit("missing_label"))
              .otherwise(F.lit("ok")))
    return chosen.withColumn("status", status)
