"""Rankers, metrics, sampling, sources, classification, resume."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import postings, metrics, ranking, sampling
from tessera.plans import classify
from tessera.sources import io
from tessera.streaming.resume import incremental


def test_retrieval_scores(spark):
    ranks = spark.createDataFrame([("q", c, i) for i, c in enumerate(["P1", "S2", "F1", "P9"], 1)], "q string, cand_id string, rank int")
    gold = spark.createDataFrame([("q", "F1", "F1"), ("q", "P9", "P9"), ("none", "x", None)], "q string, slot string, unit string")
    got = {r.q: r for r in metrics.query_scores(metrics.slot_ranks(ranks, gold, ["q"]), ["q"], [1, 2, 10]).collect()}
    r = got["q"]
    assert (r.hit_1, r.hit_2, r.hit_10, r.recall_2, r.recall_10) == (0, 0, 1, 0, 1) and abs(r.rr - 1 / 3) < 1e-9
    assert got["none"].rr == 0 and got["none"].recall_10 == 0


def test_label_metrics(spark):
    rows = spark.createDataFrame([(["figure", "table"], ["figure"]), (["line"], ["line", "section"]), (["section"], [])], "gold array<string>, prediction array<string>")
    got = {r.label: r for r in metrics.label_report(rows, ["figure", "table", "line", "section"]).collect()}
    m = got["micro"]
    assert (m.tp, m.fp, m.fn, m.precision, m.recall, m.f1) == (2, 1, 2, 0.666667, 0.5, 0.571429) and got["macro"].f1 == 0.5
    s = metrics.set_summary(rows).first()
    assert (s.set_accuracy, s.empty_predictions) == (0, 1)


def test_threshold_ties_go_to_the_middle(spark):
    counts = spark.createDataFrame([("a", t, n, 1, 1) for t, n in ((0.20, 5), (0.48, 5), (0.60, 5), (0.9, 1))], "label string, threshold double, tp int, fp int, fn int")
    assert metrics.best_thresholds(counts).first().threshold == 0.48
    assert metrics.best_thresholds(counts, per_label=True).first().label == "a"


def test_combinations(spark):
    units = spark.createDataFrame([(1, "figure", 1), (1, "figure", 2), (1, "table", 3), (1, "table", 3)], "q int, type string, label int")
    assert metrics.combinations(units, ["q"]).first().combination == "2 figure + table"


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, 1, "a b b"), (2, 2, "a c"), (3, 3, "d")], "cand_id int, ord int, text string")
    q = spark.createDataFrame([(7, "b b d")], "q int, text string")
    got = {r.cand_id: r.score for r in ranking.bm25(q, postings.count_terms(docs, []), [], ["q"]).collect()}
    idf = {t: math.log((3 - n + 0.5) / (n + 0.5)) for t, n in {"a": 2, "b": 1, "c": 1, "d": 1}.items()}
    idf["a"] = 0.25 * sum(idf.values()) / 4
    part = lambda t, tf, n: idf[t] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / 2))
    assert got.keys() == {1, 3} and abs(got[1] - 2 * part("b", 2, 3)) < 1e-9 and abs(got[3] - part("d", 1, 1)) < 1e-9


def test_ranking_ties_and_late_interaction(spark):
    s = spark.createDataFrame([(1, "x", 2, 0.5), (1, "y", 1, 0.5), (1, "x", 3, 0.1)], "q int, cand_id string, ord int, score double")
    assert [(r.cand_id, r["rank"]) for r in ranking.ranked(s, ["q"]).orderBy("rank").collect()] == [("y", 1), ("x", 2)]
    v = spark.createDataFrame([([[1.0, 0.0], [0.0, 2.0]], [[3.0, 0.0], [1.0, 1.0]])], "q array<array<double>>, d array<array<double>>")
    assert v.select(ranking.max_sim(F.col("q"), F.col("d"))).first()[0] == 5.0
    p = spark.createDataFrame([(math.log(0.2), math.log(0.6)), (None, 0.0)], "y double, n double").select(ranking.yes_probability(F.col("y"), F.col("n"))).collect()
    assert abs(p[0][0] - 0.25) < 1e-9 and p[1][0] == -100


def test_splits(spark):
    df = spark.createDataFrame([(i, "a" if i < 10 else "b") for i in range(13)], "id int, s string")
    count = {(r.s, r.split): r["count"] for r in sampling.stratified(df, "s", "id").groupBy("s", "split").count().collect()}
    assert count == {("a", "train"): 7, ("a", "dev"): 2, ("a", "test"): 1, ("b", "train"): 2, ("b", "test"): 1}
    assert sampling.stratified(df, "s", "id", at_least_one=True).where("s = 'b' and split <> 'train'").count() == 2
    a, b = (sorted(r.id for r in sampling.sample(df.repartition(n), 5, "id").collect()) for n in (1, 7))
    assert a == b and len(a) == 5


def test_sources(spark, tmp_path):
    paper = tmp_path / "v" / "p1"
    paper.mkdir(parents=True)
    (paper / "reviews.json").write_text(json.dumps([{"note_id": "r", "rid": "1", "report": {"a": "x"}}, {"note_id": "s", "report": "text"}]))
    (paper / "comments.json").write_text(json.dumps({"c1": {"note_id": "c1", "replyto": "r", "comment": "hi"}}))
    (tmp_path / "v" / "bad.json").write_text("{nope")
    assert {r.note_id: r.comment for r in io.reviews(spark, str(paper / "reviews.json")).collect()} == {"r": '{"a":"x"}', "s": "text"}
    assert io.comments(spark, str(tmp_path / "v" / "*" / "comments.json")).first().comment == "hi"
    with pytest.raises(Exception, match="bad.json"):  # a file that is no JSON does not vanish
        io.comments(spark, str(tmp_path / "v" / "bad.json")).collect()
    (tmp_path / "v" / "blank.json").write_text(" \n")
    assert io.comments(spark, str(tmp_path / "v" / "blank.json")).count() == 0  # an empty file has no notes
    with pytest.raises(Exception, match="blank.json"):
        io.dataset(spark, str(tmp_path / "v" / "blank.json")).collect()
    data = {"V": {"p": {"r": {"review": "a", "rebuttal": "b", "aligned": [{"rebuttal_sentence": "s", "review_spans": ["x"], "labels": None}]}, "e": {"review": "", "rebuttal": "", "aligned": []}}}}
    (tmp_path / "set.json").write_text(json.dumps(data))
    assert {(r.review_id, r.pos) for r in io.dataset(spark, str(tmp_path / "set.json")).collect()} == {("r", 0), ("e", None)}
    for venue in ("V", "retrieval_x"):
        (tmp_path / "results" / venue).mkdir(parents=True)
        (tmp_path / "results" / venue / "m.json").write_text(json.dumps({"p": {"0": {"query": "q", "gold": [{"type": "Table", "label": "1"}], "scores": {"B": 2.0, "A": 1.0}}}}))
    got = io.rankings(spark, str(tmp_path / "results"))
    assert [(r.venue, r.cand_id, r["rank"]) for r in got.orderBy("rank").collect()] == [("V", "B", 1), ("V", "A", 2)]
    tei = '<TEI xmlns="x"><text><body><div><head>Intro</head><p>One  <b>two</b></p><p> </p></div><div><p>no head</p></div></body></text></TEI>'
    (tmp_path / "t.tei").write_text(tei)
    assert [(r.head, r.text) for r in io.tei_paragraphs(spark, str(tmp_path / "t.tei")).collect()] == [("Intro", "One two"), ("", "no head")]
    html = spark.createDataFrame([("<p>a <i>b</i><p class=x>c</div><script>'<p>no'</script><pre>d",)], "html string")
    assert [r.paragraph for r in io.html_paragraphs(html).collect()] == ["a b", "c"]


def test_sinks_and_merges(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,\"b\"\nc", None)], "id int, x string, y string")
    io.write_csv(df, str(tmp_path / "csv"), ["x", "y", "id"])
    back = io.csv_rows(spark, str(tmp_path / "csv")).first()
    assert (back.x, back.y, back.id) == ('a,"b"\nc', None, "1")
    rows = spark.createDataFrame([(1, "old"), (2, "own")], "id int, c string")
    known = spark.createDataFrame([(1, "good"), (2, "junk")], "id int, c string")
    assert {r.id: r.c for r in io.with_annotations(rows, known, ["id"], "c", ["good"]).collect()} == {1: "good", 2: "own"}
    ok, bad = io.split_by(rows, F.col("c") == "own")
    assert ok.count() == bad.count() == 1
    a, b = (str(tmp_path / f"s{i}.json") for i in (1, 2))
    for path, ids in ((a, ["p", "q"]), (b, ["r"])):
        with open(path, "w") as f:
            f.writelines(json.dumps({"paper_id": x}) + "\n" for x in ids)
    assert io.shards(spark, [a, b], "paper_id string").count() == 3


def test_resume(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for k in range(3):
        (source / f"{k}.json").write_text(json.dumps({"id": k // 2, "x": k}) + "\n")
        incremental(spark, str(source), "id long, x long", out, str(tmp_path / "ck"), ["id"], lambda df: df.withColumn("y", F.col("x") * 2))
    assert sorted((r.id, r.y) for r in spark.read.parquet(out).collect()) == [(0, 0), (1, 4)]


def test_classifier(spark):
    data = [(f"see the {w} number {i}", [w] if i % 3 else [w, "table"]) for i in range(60) for w in ("figure", "line")]
    data = [(c + (" tabular" if "table" in g else ""), g) for c, g in data]
    df = spark.createDataFrame(data, "comment string, gold array<string>")
    labels = ["figure", "table", "line"]
    model, limits = classify.train_and_tune(df, df, labels)
    out = classify.predict(classify.probabilities(model, df, labels), limits, labels)
    assert metrics.set_summary(out).first().set_accuracy > 0.95
