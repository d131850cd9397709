"""M6, M7: per-message intent -> probability maps and JSON answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .naive_bayes import NBModel
from ..functions.text import softmax


def answer_map(model: NBModel, scored: DataFrame, id_col: str = "doc_id", digits: int | None = None) -> DataFrame:
    """M6: ``(id, answer MAP<STRING, DOUBLE>)`` in label-id order, for every row.

    Probabilities keep full precision unless ``digits`` asks for rounding.
    """
    ints = F.array(*[F.lit(x) for x in model.intents])
    p = softmax("scores")
    if digits is not None:
        p = F.transform(p, lambda x: F.round(x, digits).cast("double"))
    return scored.select(id_col, F.map_from_arrays(ints, p).alias("answer"))


def answer_json(answers: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """M7: ``(id, json)`` with ``json = '[{"intent": p, ...}]'`` (a list holding one map)."""
    return answers.select(id_col, F.to_json(F.array(F.col("answer"))).alias("json"))


def answer_long(answers: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Long form ``(id, intent, p)`` of an answer map (for comparisons)."""
    return answers.select(id_col, F.explode("answer").alias("intent", "p"))


def parse_json(answers: DataFrame, id_col: str = "doc_id", json_col: str = "json") -> DataFrame:
    """Long form ``(id, intent, p)`` read back from JSON answers (inverse of :func:`answer_json`).

    JSON numbers are written in their shortest round-trip form, so the
    parsed doubles equal the rounded probabilities that were written.
    """
    parsed = F.from_json(F.col(json_col), "array<map<string,double>>")
    return answers.select(id_col, F.explode(F.element_at(parsed, 1)).alias("intent", "p"))
