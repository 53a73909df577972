"""Dense and late-interaction ranking in blocks, and the inverted file, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import vectors as vc


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 2
    x = centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 16))
    x[700:710] = x[5]  # ties
    return x.round(3)


@pytest.fixture(scope="module")
def table(spark, made):
    rows = [(i, i, v.tolist()) for i, v in enumerate(made)] + [(2000, 2000, None), (2001, 2001, [])]
    return spark.createDataFrame(rows, "cand_id long, ord long, vec array<double>").repartition(5)


def brute(x, q, k, normalize=False):
    if normalize:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x[q], 6)
    return [i for i in sorted(range(len(x)), key=lambda i: (-s[i], i)) if i != q][:k]


@pytest.mark.parametrize(("k", "block", "normalize"), [(1, 1 << 20, False), (7, 700, True), (2000, 3000, False)])
def test_top_equals_brute_force_in_any_blocks(spark, made, table, k, block, normalize, monkeypatch):
    monkeypatch.setattr(vc, "BLOCK_BYTES", block)
    monkeypatch.setattr(vc, "SCORE_BYTES", 4000)
    asked = table.where("cand_id % 100 = 5 or cand_id = 2000").select(F.col("cand_id").alias("q"), F.col("vec").alias("qvec"))
    got = {}
    for r in vc.top(asked, table, ["q"], k, skip="q", digits=6, normalize=normalize).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append(r.cand_id)
    assert got == {q: brute(made, q, k, normalize) for q in range(5, 900, 100)}


def test_all_pairs_and_no_queries(spark, made, table):
    asked = table.where("cand_id in (1, 2)").select(F.col("cand_id").alias("q"), F.col("vec").alias("qvec"))
    got = {(r.q, r.cand_id): r.score for r in vc.scores(asked, table, ["q"]).collect()}
    assert len(got) == 1800 and got[1, 77] == pytest.approx(made[1] @ made[77])
    assert vc.top(asked.where("q < 0"), table, ["q"], 3).count() == 0


def test_late_interaction_of_any_numbers_of_vectors(spark):
    rng = np.random.default_rng(4)
    items = [rng.normal(size=(rng.integers(1, 5), 6)).round(3) for _ in range(60)]
    df = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(items)] + [(99, 99, [])], "cand_id long, ord long, vec array<array<double>>").repartition(3)
    asked = df.where("cand_id < 4").select(F.col("cand_id").alias("q"), F.col("vec").alias("qvec"))
    got = {(r.q, r.cand_id): r.score for r in vc.scores(asked, df, ["q"]).collect()}
    assert got == {(q, i): pytest.approx((items[q] @ v.T).max(axis=1).sum()) for q in range(4) for i, v in enumerate(items)}


def test_inverted_file_holds_every_row_and_finds_most(spark, made, table):
    centres = vc.centroids(table.where("size(vec) > 0"), 12)
    lists = vc.inverted_file(table.where("size(vec) > 0"), centres)
    assert sorted(r.cand_id for r in lists.collect()) == list(range(900)) and lists.select("list").distinct().count() == len(centres)
    asked = table.where("cand_id % 9 = 0 and size(vec) > 0").select(F.col("cand_id").alias("q"), F.col("vec").alias("qvec"))
    want = {q: set(brute(made, q, 10)) for q in range(0, 900, 9)}

    def recall(probes):
        rows = vc.probed_top(asked, lists, centres, ["q"], 10, probes, skip="q", digits=6).collect()
        return sum(r.cand_id in want[r.q] for r in rows) / (10 * len(want))

    assert recall(len(centres)) == 1.0 and recall(4) >= 0.95
