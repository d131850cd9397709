"""M2: a Spark ML pipeline classifier (tokens -> counts -> IDF -> logistic regression)."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, RegexTokenizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TOKEN_SPLIT
from ..session import shared_path


def lr_pipeline(max_vocab: int = 1 << 24, min_df: int = 1, max_iter: int = 50, reg: float = 0.01) -> Pipeline:
    tok = RegexTokenizer(inputCol="text", outputCol="tokens", pattern=TOKEN_SPLIT, gaps=True,
                         toLowercase=True, minTokenLength=1)
    cv = CountVectorizer(inputCol="tokens", outputCol="tf", vocabSize=max_vocab, minDF=float(min_df))
    idf = IDF(inputCol="tf", outputCol="features")
    lr = LogisticRegression(featuresCol="features", labelCol="label_d", family="multinomial",
                            maxIter=max_iter, regParam=reg)
    return Pipeline(stages=[tok, cv, idf, lr])


def fit_lr(train: DataFrame, **kw) -> PipelineModel:
    """Fit on ``(text, label)``; the label id is the class index.

    The fitted model is written to the shared folder and read back: a freshly
    fitted one holds its training summary, and with it the session, which
    cannot be sent to tasks once the session has observed a write.
    """
    model = lr_pipeline(**kw).fit(train.withColumn("label_d", F.col("label").cast("double")))
    path = shared_path(train.sparkSession, "lr-model")
    model.write().save(path)
    return PipelineModel.load(path)


def predict_lr(model: PipelineModel, df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, pred_label, p_top)`` (argmax of the class probabilities)."""
    out = model.transform(df)
    from pyspark.ml.functions import vector_to_array
    p = vector_to_array("probability")
    return out.select(id_col, F.col("prediction").cast("int").alias("pred_label"),
                      F.array_max(p).alias("p_top"))


def save_lr(model: PipelineModel, path: str, version: int | None = None) -> str:
    """K5 for the ML pipeline: ``PipelineModel`` folder, one per version."""
    root = f"{path.rstrip('/')}/version={version}" if version is not None else path
    model.write().overwrite().save(root)
    return root


def load_lr(root: str) -> PipelineModel:
    """S5 for the ML pipeline."""
    return PipelineModel.load(root)
