"""The hidden-layer head: gradients by differences, a fixture that no line separates, saved heads."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics
from tessera.plans import classify, hidden


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    head = hidden.Head.new(["a", "b"], 3, 4, 1)
    x, y, keep = rng.normal(size=(5, 3)), (rng.random((5, 2)) > 0.5).astype(float), ((rng.random((5, 3)) > 0.3) / 0.7, (rng.random((5, 4)) > 0.3) / 0.7)
    found, loss = head.gradient(x, y, keep)
    for i in range(len(head.flat)):
        step = np.zeros(len(head.flat))
        step[i] = 1e-6
        up, down = (head.with_flat(head.flat + k * step).gradient(x, y, keep)[1] for k in (1, -1))
        assert found[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


@pytest.fixture(scope="module")
def crossed(spark):
    """Two labels: of one sign, and both positive; the first is not linear."""
    rng = random.Random(5)
    rows = []
    for i in range(600):
        a, b = rng.choice([-1, 1]) * rng.uniform(0.3, 1), rng.choice([-1, 1]) * rng.uniform(0.3, 1)
        rows.append((i, [a, b], (["same"] if a * b > 0 else []) + (["high"] if a > 0 < b else [])))
    return spark.createDataFrame([*rows, (600, None, ["same"])], "id int, embedding array<double>, gold array<string>").repartition(3)


def test_beats_the_linear_head_where_no_line_separates(spark, crossed, tmp_path):
    labels = ["same", "high"]
    train, test = crossed.where("id % 2 = 0"), crossed.where("id % 2 = 1")
    head, losses = hidden.fit(train, labels, hidden=16, epochs=25, batches=2, rate=0.05, dev=None)
    assert losses[-1] < 0.3 * losses[0]
    exact = lambda df: metrics.set_summary(df).first().set_accuracy
    ours = exact(hidden.predict(hidden.probabilities(head, test), labels))
    linear = exact(hidden.predict(classify.probabilities(classify.fit_on_embeddings(train, labels), test, labels, "embedding"), labels))
    assert ours > 0.97 and ours > linear + 0.2
    hidden.save(head, spark, str(tmp_path / "head"))
    again = hidden.load(spark, str(tmp_path / "head"))
    assert again.labels == labels and np.array_equal(again.flat, head.flat)
    assert hidden.probabilities(head, crossed).count() == 600


def test_dropout_dev_and_no_rows(spark, crossed):
    head, losses = hidden.fit(crossed.where("id < 60"), ["high"], hidden=4, epochs=2, batches=3, dropout=0.2, dev=crossed.where("id >= 540"))
    assert len(losses) == 2 and all(np.isfinite(losses)) and head.labels == ["high"]
    with pytest.raises(ValueError, match="no rows"):
        hidden.fit(crossed.where(F.col("embedding").isNull()), ["high"])
