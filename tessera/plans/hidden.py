"""A hidden-layer head on frozen embeddings for several labels, trained by mini-batches of distributed gradients.

A round is one Spark job over a mini-batch (rows dealt by a hash that changes with the epoch):
every task sums the gradients of its rows, Spark adds them up by parameter, and the driver,
which holds the weights and Adam's two moments, takes a step. What comes to the driver and
what is broadcast has the size of the model, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from ..storage import saved
from .classify import targets


@dataclass
class Head:
    """Weights of inputs to hidden units (w, b) and of those to labels (v, c)."""

    labels: list[str]
    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    c: np.ndarray

    @staticmethod
    def new(labels: list[str], inputs: int, hidden: int, seed: int) -> Head:
        rng = np.random.default_rng(seed)
        return Head(labels, rng.normal(0, np.sqrt(2 / inputs), (inputs, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, len(labels))), np.zeros(len(labels)))

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.w, self.b, self.v, self.c]

    @property
    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def with_flat(self, values: np.ndarray) -> Head:
        at, out = 0, []
        for p in self.parts:
            out.append(values[at : at + p.size].reshape(p.shape))
            at += p.size
        return Head(self.labels, *out)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(gelu(x @ self.w + self.b)[0] @ self.v + self.c, -60, 60)))

    def gradient(self, x: np.ndarray, y: np.ndarray, keep: tuple = (1.0, 1.0)) -> tuple[np.ndarray, float]:
        """The sums over rows of the gradient of binary cross-entropy and of the loss; keep scales inputs and hidden units (dropout)."""
        x = x * keep[0]
        h, slope = gelu(x @ self.w + self.b)
        h = h * keep[1]
        z = np.clip(h @ self.v + self.c, -60, 60)
        d = 1 / (1 + np.exp(-z)) - y
        dh = (d @ self.v.T) * slope * keep[1]
        loss = float((np.logaddexp(0, z) - y * z).sum())
        return np.concatenate([(x.T @ dh).ravel(), dh.sum(axis=0), (h.T @ d).ravel(), d.sum(axis=0)]), loss


def gelu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smooth rectifier (by its usual tanh form) and its slope."""
    k = np.sqrt(2 / np.pi)
    t = np.tanh(k * (x + 0.044715 * x**3))
    return x * (1 + t) / 2, (1 + t) / 2 + x * (1 - t * t) / 2 * k * (1 + 3 * 0.044715 * x * x)


def _matrix(column) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _features(rows: DataFrame, labels: list[str], embedding: str, unit: bool) -> DataFrame:
    """x and y of rows that have an embedding, and a hash that deals rows to mini-batches."""
    x = F.col(embedding).cast("array<double>")
    if unit:
        norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
        x = F.transform(x, lambda v: v / F.when(norm > 0, norm).otherwise(1.0))
    made = targets(rows.where(F.col(embedding).isNotNull()), labels)
    return made.select(x.alias("x"), F.array(*(F.coalesce(F.col(f"t_{n}"), F.lit(0.0)) for n in labels)).alias("y"), F.xxhash64(embedding, F.monotonically_increasing_id()).alias("h"))


def _round(rows: DataFrame, head: Head, dropout: float, seed: int) -> tuple[np.ndarray, float, int]:
    """The sums of the gradient and of the loss over rows, and how many they are."""
    held = rows.sparkSession.sparkContext.broadcast(head)
    size = len(head.flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _matrix(batch.column(0)), _matrix(batch.column(1))
            keep = (1.0, 1.0)
            if dropout:
                rng = np.random.default_rng([seed, int(batch.column(2)[0].as_py()) & 0xFFFFFFFF])
                keep = tuple((rng.random((len(x), n)) >= dropout) / (1 - dropout) for n in held.value.w.shape)
            gradient, loss = held.value.gradient(x, y, keep)
            total += np.concatenate([gradient, [loss, len(x)]])
        if total[-1]:
            yield pa.RecordBatch.from_arrays([pa.array(range(size + 2), pa.int32()), pa.array(total)], names=["i", "g"])

    out = np.zeros(size + 2)
    for r in rows.select("x", "y", "h").mapInArrow(run, "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).collect():  # a row per parameter
        out[r.i] = r.g
    return out[:-2], out[-2], int(out[-1])


def fit(
    train: DataFrame, labels: list[str], embedding: str = "embedding", hidden: int = 64, epochs: int = 10, batches: int = 4, rate: float = 0.01, decay: float = 0.01, dropout: float = 0.0,
    seed: int = 13, unit: bool = True, dev: DataFrame | None = None,
) -> tuple[Head, list[float]]:
    """The head and each epoch's mean loss; with dev, the head of the epoch with the best micro F1 on it (threshold 0.5).

    Embeddings of one length; rows without one are left out. Adam with decoupled weight decay.
    """
    rows = saved(_features(train, labels, embedding, unit), "head-rows")
    first = rows.select(F.size("x").alias("n")).first()
    if first is None:
        raise ValueError("no rows with an embedding")
    head = Head.new(labels, first.n, hidden, seed)
    m, s, step, losses, best = np.zeros(len(head.flat)), np.zeros(len(head.flat)), 0, [], (-1.0, head)
    for epoch in range(epochs):
        loss, seen = 0.0, 0
        for b in range(batches):
            part = rows.where(F.pmod(F.xxhash64("h", F.lit(epoch)), F.lit(batches)) == b) if batches > 1 else rows
            gradient, own, n = _round(part, head, dropout, seed + step)
            if not n:
                continue
            loss, seen, step, gradient = loss + own, seen + n, step + 1, gradient / (n * len(labels))
            m, s = 0.9 * m + 0.1 * gradient, 0.999 * s + 0.001 * gradient**2
            move = m / (1 - 0.9**step) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
            head = head.with_flat(head.flat * (1 - rate * decay) - rate * move)
        losses.append(loss / max(1, seen * len(labels)))
        if dev is not None:
            told = predict(probabilities(head, dev, embedding, unit=unit), labels)
            score = metrics.label_report(told, labels).where("label = 'micro'").first()
            best = max(best, (score.f1 if score else 0.0, head), key=lambda x: x[0])
    return (head if dev is None else best[1]), losses


def probabilities(head: Head, rows: DataFrame, embedding: str = "embedding", unit: bool = True) -> DataFrame:
    """rows that have an embedding with probabilities, a map label -> p."""
    held = rows.sparkSession.sparkContext.broadcast(head)

    @F.pandas_udf("array<double>")
    def score(x):
        m = np.stack(x.to_numpy()).astype(np.float64) if len(x) else np.zeros((0, held.value.w.shape[0]))
        if unit:
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            m = m / np.where(norm > 0, norm, 1)
        return pd.Series(list(held.value.probabilities(m)))

    made = rows.where(F.col(embedding).isNotNull()).withColumn("_p", score(F.col(embedding).cast("array<double>")))
    return made.withColumn("probabilities", F.map_from_arrays(F.array(*map(F.lit, head.labels)), "_p")).drop("_p")


def predict(rows: DataFrame, labels: list[str], threshold: float = 0.5) -> DataFrame:
    """rows with prediction: labels at or over the threshold."""
    return rows.withColumn("prediction", F.filter(F.array(*map(F.lit, labels)), lambda x: F.col("probabilities")[x] >= threshold))


def save(head: Head, spark: SparkSession, path: str) -> None:
    """The head as one Parquet row under path, which must be new."""
    row = (head.labels, list(head.w.shape), head.flat.tolist())
    spark.createDataFrame([row], "labels array<string>, shape array<long>, weights array<double>").coalesce(1).write.parquet(path)


def load(spark: SparkSession, path: str) -> Head:
    r = spark.read.parquet(path).first()
    inputs, hidden = r["shape"]
    return Head.new(list(r["labels"]), inputs, hidden, 0).with_flat(np.array(r["weights"]))
