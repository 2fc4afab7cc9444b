"""D4 with a trained model: logistic regression over hashed words and word pairs
(``pyspark.ml``; gradients are aggregated in a tree, the model is one number a slot).

The lexicon of ``decision.sentiment`` stays the default where nothing is labelled; a
fitted model is saved and loaded as a ``PipelineModel``.  A null or empty text is
neutral 0.5, as with the lexicon; scores within ``UNSURE`` of 0.5 are neutral too.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decision import words

SLOTS = 1 << 14  # of words, and as many of pairs
UNSURE = 0.02


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "positive", slots: int = SLOTS) -> PipelineModel:
    """A model of (text, 0 or 1 for negative or positive); rows of the rarer label
    weigh as much in sum as the others."""
    rows = labelled.where(F.col(label_col).isNotNull()).select(words(text_col).alias("_words"), F.col(label_col).cast("double").alias("_label"))
    n, positive = rows.agg(F.count(F.lit(1)), F.sum("_label")).first()
    if not n or not 0 < positive < n:
        raise ValueError("both labels are needed")
    rows = rows.withColumn("_weight", F.when(F.col("_label") == 1, F.lit(n / (2 * positive))).otherwise(F.lit(n / (2 * (n - positive)))))
    return Pipeline(stages=[
        NGram(n=2, inputCol="_words", outputCol="_pairs"),
        HashingTF(inputCol="_words", outputCol="_w", numFeatures=slots, binary=True),
        HashingTF(inputCol="_pairs", outputCol="_p", numFeatures=slots, binary=True),
        VectorAssembler(inputCols=["_w", "_p"], outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol="_label", weightCol="_weight", regParam=0.01, maxIter=25, probabilityCol="_prob",
                           rawPredictionCol="_raw", predictionCol="_pred"),
    ]).fit(rows)


def classify(model: PipelineModel, df: DataFrame, text_col: str = "text", out_col: str = "sentiment") -> DataFrame:
    """Adds ``out_col``: struct(label, score) of the likelier label."""
    made = model.transform(df.withColumn("_words", words(text_col)))
    p = vector_to_array("_prob")[1]
    empty = F.size("_words") == 0
    label = F.when(empty | (F.abs(p - 0.5) < UNSURE), "neutral").when(p > 0.5, "positive").otherwise("negative")
    score = F.when(empty, F.lit(0.5)).otherwise(F.greatest(p, 1 - p))
    return made.withColumn(out_col, F.struct(label.alias("label"), score.alias("score"))).drop("_words", "_pairs", "_w", "_p", "_features", "_raw", "_prob", "_pred")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
