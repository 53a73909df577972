"""Windows that cannot reach a cutoff are not compared, none that can is lost; papers are aligned in batches."""

import random

from tessera.operators import documents as dc
from tessera.operators import fuzzy


def test_windows_that_cannot_reach_the_cutoff_are_skipped(monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(400)]
    a, b = (" ".join(rng.choice(words) for _ in range(n)) for n in (40, 120))
    calls, lcs = [], fuzzy.lcs
    monkeypatch.setattr(fuzzy, "lcs", lambda *x: calls.append(1) or lcs(*x))
    assert fuzzy.best_window(a, b, 90) == 0 and not calls
    assert fuzzy.best_window(a, b) > 0 and calls  # without a cutoff every window counts


def test_no_window_is_lost():
    rng, between = random.Random(4), 0
    for _ in range(600):
        a = "".join(rng.choice("abcde ") for _ in range(rng.randint(1, 40)))
        near = list(a)
        for _ in range(rng.randint(0, 1 + len(a) // 6)):
            if near and rng.random() < 0.5:
                near.pop(rng.randrange(len(near)))
            else:
                near.insert(rng.randint(0, len(near)), rng.choice("abcdé"))
        b = "".join(rng.choice("abcde ") for _ in range(rng.randint(0, 25))) + "".join(near)[rng.randint(0, 4) :] + "".join(rng.choice("abcde ") for _ in range(rng.randint(0, 25)))
        s, t = sorted((a, b), key=len)
        whole = fuzzy.best_window(s, t)
        for cutoff in (80, 85, 90):
            assert abs(fuzzy.best_window(s, t, cutoff) - (whole if whole >= cutoff else 0)) < 1e-9
        between += 80 <= whole < 100
    assert between > 100


def test_papers_reach_python_in_batches(spark):
    """No Python call a paper: the plan has no grouped map."""
    lines = spark.createDataFrame([(p, n, f"alpha{p} beta{n} gamma") for p in range(30) for n in (1, 2, 3)], "paper_id long, line_no long, text string")
    pars = spark.createDataFrame([(p, 1, "s", f"alpha{p} beta2 gamma alpha{p} beta3 gamma") for p in range(30)] + [(77, 1, "s", "no lines")], "paper_id long, paragraph_id int, section string, text string")
    start = lines.select("paper_id").distinct().selectExpr("paper_id", "2L AS line")
    out = dc.aligned(pars, lines, start, lambda a, b: fuzzy.best_window(a, b, 90))
    assert "FlatMapCoGroups" not in out._jdf.queryExecution().toString()
    got = {r.paper_id: (r.start_line, r.end_line, r.status) for r in out.collect()}
    assert got == {str(p): (2, 3, "matched") for p in range(30)} | {"77": (-1, -1, "filled")}
