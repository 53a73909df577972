"""Coverage against all pairs; only papers of very many texts are cut into words."""

import random

from tessera.operators import ranking
from tessera.plans import construct


def test_coverage_equals_all_pairs_and_cuts_only_large_papers(spark, monkeypatch):
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice(["ab", "bc", "cd", "Da", "x"]) for _ in range(rng.randint(0, 4)))
    size = {p: 70 if p < 2 else rng.randint(0, 4) for p in range(25)} | {None: 3}
    fields = [(p, n, text()) for p, k in size.items() for n in range(2 * k)]
    kept = [(p, text() if rng.random() < 0.8 else " ") for p, k in size.items() for _ in range(k)] + [(1, f"long text number {n} of many") for n in range(70)] + [(0, None)]
    seen, holding = set(), ranking.holding
    monkeypatch.setattr(construct.ranking, "holding", lambda c, q, *a, **o: seen.update(r.paper_id for r in c.select("paper_id").collect()) or holding(c, q, *a, **o))
    notes = spark.createDataFrame([(p, n, None, "Reviewer", "c") for p, n, _ in fields if p is not None], "paper_id int, note_id int, replyto int, from_role string, comment string")
    got = construct.coverage(notes, spark.createDataFrame(kept, "paper_id int, query string"), spark.createDataFrame(fields, "paper_id int, note_id int, text string")).first()
    low = lambda t: " ".join((t or "").lower().split())
    hits = [any(low(q) and (low(q) in low(t) or low(t) in low(q)) for k, q in kept if k == p and p is not None) for p, _, t in fields if low(t)]
    assert (got.spans, got.included) == (len(hits), sum(hits)) and 0 < sum(hits) < len(hits)
    assert seen <= {0, 1} and 1 in seen
