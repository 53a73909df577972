"""The rank of each query's best candidate of its label without rows for pairs; products stay within their bound."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import vectors as vc


def test_first_ranks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vc, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(vc, "SCORE_BYTES", 4000)
    rng = np.random.default_rng(11)
    x = rng.integers(-2, 3, size=(500, 8)).astype(float)  # many ties
    label = [None if i % 50 == 7 else int(v) for i, v in enumerate(rng.integers(0, 9, 500))]
    label[20] = 99  # the only one of its label
    rows = spark.createDataFrame([(i, i, label[i], v.tolist()) for i, v in enumerate(x)], "cand_id long, ord long, label int, vec array<double>").repartition(4)
    asked = rows.where("cand_id % 10 = 0 OR cand_id = 7").select(F.col("cand_id").alias("q"), F.col("label").alias("gold"), F.col("vec").alias("qvec"))
    got = {r.q: r["rank"] for r in vc.first_ranks(asked, rows, ["q"], ("label", "gold"), skip="q", digits=6).collect()}
    want = {}
    for q in [*range(0, 500, 10), 7]:
        order = sorted((i for i in range(500) if i != q), key=lambda i: (-(x[i] @ x[q]), i))
        found = [k for k, i in enumerate(order, 1) if label[q] is not None and label[i] == label[q]]
        if found:
            want[q] = found[0]
    assert got == want and 20 not in got and 7 not in got and len(got) > 40


def test_products_of_many_vectors_stay_within_the_bound(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(vc, "SCORE_BYTES", 8000)
    seen, scores = [], vc.Block.scores
    monkeypatch.setattr(vc.Block, "scores", lambda self, v, *a: seen.append(len(v) * len(self.vectors)) or scores(self, v, *a))
    rng = np.random.default_rng(2)
    block = vc.Block(rng.normal(size=(20, 4)), np.arange(0, 21, 4), None, pa.table({"q": list(range(5))}))
    batch = pa.RecordBatch.from_pydict({"cand_id": list(range(200)), "ord": list(range(200)), "vec": rng.normal(size=(200, 4, 4)).tolist()})
    held = type("Held", (), {"value": block})()
    out = pa.Table.from_batches(vc._run(held, "vec", 3, None, False, None, None)(iter([batch])))
    assert max(seen) * 8 <= 8000 and out.num_rows == 15
