"""Multi-label content types: hashed word features or frozen embeddings, one logistic regression a label, swept thresholds."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics


def targets(rows: DataFrame, labels: list[str], gold: str = "gold") -> DataFrame:
    """rows with a 0/1 column t_<label> for each label."""
    return rows.withColumns({f"t_{x}": F.array_contains(gold, F.lit(x)).cast("double") for x in labels})


def _heads(labels: list[str]) -> list[LogisticRegression]:
    return [LogisticRegression(featuresCol="_x", labelCol=f"t_{x}", probabilityCol=f"_p_{x}", rawPredictionCol=f"_r_{x}", predictionCol=f"_y_{x}", regParam=0.01, maxIter=30) for x in labels]


def fit(train: DataFrame, labels: list[str], text: str = "comment", features: int = 1 << 14) -> PipelineModel:
    stages = [RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\W+"), HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="_x")]
    return Pipeline(stages=[*stages, *_heads(labels)]).fit(targets(train, labels))


def with_vector(rows: DataFrame, embedding: str) -> DataFrame:
    """rows that have an embedding, with it as the vector that the heads read."""
    return rows.where(F.col(embedding).isNotNull()).withColumn("_x", array_to_vector(F.col(embedding).cast("array<double>")))


def fit_on_embeddings(train: DataFrame, labels: list[str], embedding: str = "embedding") -> PipelineModel:
    """One logistic regression a label on a frozen embedding."""
    return Pipeline(stages=_heads(labels)).fit(targets(with_vector(train, embedding), labels))


def probabilities(model: PipelineModel, rows: DataFrame, labels: list[str], embedding: str | None = None) -> DataFrame:
    """rows with probabilities, a map label -> p; embedding names the column that fit_on_embeddings had, whose nulls are left out."""
    made = model.transform(with_vector(rows, embedding) if embedding else rows)
    pairs = [x for name in labels for x in (F.lit(name), vector_to_array(f"_p_{name}")[1])]
    return made.select(*rows.columns, F.create_map(*pairs).alias("probabilities"))


def save(model: PipelineModel, thresholds: DataFrame, path: str, **metadata) -> None:
    """The model, its thresholds and its metadata (one row of values as JSON text) under path, which must be new."""
    model.write().save(f"{path}/model")
    thresholds.write.json(f"{path}/thresholds")
    row = [(k, json.dumps(v)) for k, v in sorted(metadata.items())]
    thresholds.sparkSession.createDataFrame([(dict(row),)], "metadata map<string,string>").coalesce(1).write.json(f"{path}/metadata")


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame, dict]:
    """What save wrote: the model, the thresholds and the metadata."""
    values = spark.read.schema("metadata map<string,string>").json(f"{path}/metadata").first().metadata
    return PipelineModel.load(f"{path}/model"), spark.read.json(f"{path}/thresholds"), {k: json.loads(v) for k, v in values.items()}


def predict(rows: DataFrame, thresholds: DataFrame, labels: list[str]) -> DataFrame:
    """rows with prediction: labels at or over their threshold; thresholds(label, threshold) or one row (threshold)."""
    if "label" in thresholds.columns:
        limits = thresholds.agg(F.map_from_entries(F.collect_list(F.struct("label", "threshold"))).alias("_t"))
    else:
        limits = thresholds.select(F.create_map(*[x for name in labels for x in (F.lit(name), F.col("threshold"))]).alias("_t"))
    known = F.array(*map(F.lit, labels))
    return rows.crossJoin(F.broadcast(limits)).withColumn("prediction", F.filter(known, lambda x: F.col("probabilities")[x] >= F.col("_t")[x])).drop("_t")  # one row


def train_and_tune(train: DataFrame, dev: DataFrame, labels: list[str], per_label: bool = True):
    """The model and the thresholds of the best micro F1 on dev."""
    model = fit(train, labels)
    return model, metrics.best_thresholds(metrics.threshold_counts(probabilities(model, dev, labels), labels), per_label)
