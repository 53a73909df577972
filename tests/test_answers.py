"""Classification by a provider, model answers, gold texts, page numbers, document readers, embedding heads."""

import json

from pyspark.sql import functions as F

from tessera.operators import answers, metrics, providers
from tessera.operators import documents as dc
from tessera.plans import classify
from tessera.sources import io


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in rows.orderBy("k").select(make(F.col("v"))).collect()]


def test_message_contents(spark):
    texts = ["plain", 'say "x" \\ [a]\n{"text": 1}', "", "ü "]
    for family in ("gemma3", "standard"):
        assert column(spark, texts, lambda v, f=family: answers.message_text(answers.message_content(v, F.lit(f)))) == texts
    assert column(spark, ['["a", {"text": "b"}, {"image": 1}]', "17", None], answers.message_text) == ["ab", "", ""]
    assert column(spark, ["openai/gpt-oss-20b", "Qwen3-30B-Thinking", "Qwen3-8B", "GPT-5.1"], answers.profile) == ["gpt-oss", "qwen3-thinking", "standard", "openai-gpt5"]


def test_labels_and_flags_of_answers(spark):
    said = ['{"content_types": ["Table", "x", "figure", "table"]}', '{"content_type": "line"}', "a Figure, not the tables", "", None, '{"content_types": []} table']
    assert column(spark, said, answers.content_types) == [["table", "figure"], ["line"], ["figure"], [], [], ["table"]]
    flags = {"future_changes": False, "new_experiments": False, "external_references": False, "grounded_in_paper": True}
    given = [json.dumps(flags), json.dumps(flags | {"new_experiments": True}), json.dumps(flags | {"grounded_in_paper": "yes"}), json.dumps(flags | {"grounded_in_paper": None}), "none", None]
    assert [x and x.filter_out for x in column(spark, given, answers.grounding)] == [False, True, None, None, None, None]


def test_classified_checks_and_resumes(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["good", "bad", "old", "stale"])], "id int, prompt string")
    done = spark.createDataFrame([(2, "low"), (2, "high"), (3, "sure")], "id int, confidence string")

    def provider():
        def call(prompts):
            assert prompts[0] != "old"
            return [{"confidence": "unsure" if prompts[0] == "bad" else "medium"}]

        return call

    found = {r.prompt: r for r in answers.classified(rows, ["id"], "prompt", provider, {"confidence": answers.CONFIDENCE}, done=done, tries=2).collect()}
    assert {k: r.confidence for k, r in found.items()} == {"good": "medium", "bad": None, "old": "high", "stale": "medium"}
    assert "unexpected confidence" in found["bad"].error and found["good"].error is None
    table = spark.createDataFrame([("a", "low"), ("a", "high"), ("a", None), ("a", "low")], "role string, confidence string")
    assert {r.confidence: (r.n, r.percentage) for r in answers.shares(table, "confidence", answers.CONFIDENCE, ["role"]).collect()} == {"high": (1, 25.0), "medium": (0, 0.0), "low": (2, 50.0)}
    assert [r.n for r in answers.shares(table.limit(0), "confidence", answers.CONFIDENCE).collect()] == [0, 0, 0]


def test_gold_texts(spark):
    pars = spark.createDataFrame([("p", 1, "A", "one", 1, 4), ("p", 2, "A", "two", 5, 9)], "paper_id string, paragraph_id int, section string, text string, start_line int, end_line int")
    secs = spark.createDataFrame([("p", "1", "A", 1, 1, 9), ("p", "2", "B", 1, 10, 11)], "paper_id string, number string, name string, level int, start_line int, end_line int")
    lines = spark.createDataFrame([("p", 10, "ten"), ("p", 11, "eleven")], "paper_id string, line_no int, text string")
    caps = spark.createDataFrame([("p", "Table 1", "cap")], "paper_id string, caption_id string, text string")
    asked = [("Line", "6-4"), ("Line", "40"), ("Section", "1"), ("Section", "2"), ("Section", "7"), ("Table", "1"), ("Figure", "1"), ("Page", "1")]
    gold = spark.createDataFrame([("p", *a) for a in asked] + [("p", *asked[0])], "paper_id string, kind string, label string")
    found = dc.gold_texts(gold, pars, dc.with_paragraphs(secs, pars), caps, lines).collect()
    assert len(found) == 9
    assert {(r.kind, r.label): r.texts for r in found} == dict(zip(asked, [["one", "two"], [], ["one two"], ["ten eleven"], [], ["cap"], [], None], strict=True))


def test_line_numbers_against_a_walk(spark):
    papers = {"p": ["000", "text", "000", "001", "12", "003", "002", "AnonymousACLsubmission", "1999", "003", None, "000", "0004", "١٢٣"], "q": ["002", "001"], "r": [str(k).zfill(3) for k in range(1, 1500)] + ["x"]}
    rows = spark.createDataFrame([(p, k, t) for p, x in papers.items() for k, t in enumerate(x)], "paper_id string, ord int, text string")
    want = []
    for p, texts in papers.items():
        last = 0
        for k, t in enumerate(texts):
            number = int(t) if t and t.isascii() and t.isdigit() and len(t) in (3, 4) else None
            if number is not None and (number == last + 1 or number == last == 0):
                last = number
            elif t != "AnonymousACLsubmission":
                want.append((p, k, t))
    assert sorted(map(tuple, dc.without_line_numbers(rows).collect())) == sorted(want)
    assert dc.without_line_numbers(rows.limit(0)).count() == 0


def test_tei_divisions(spark, tmp_path):
    body = "<div><head>Outer</head><div><p>In a headless one</p><div><head>In<hi>ner</hi></head><p>deep <b>x</b></p></div></div><p>after</p></div><p>loose</p><p> </p>"
    (tmp_path / "a.tei").write_text(f'<TEI xmlns="http://x"><text><front><p>no</p></front><body>{body}</body></text></TEI>')
    (tmp_path / "b.tei").write_text("<TEI><text><body><p>cut")
    found = [(r.head_ord, r.head, r.ord, r.text) for r in io.tei_paragraphs(spark, str(tmp_path)).orderBy("ord").collect()]
    assert found == [(0, "Outer", 0, "In a headless one"), (2, "Inner", 1, "deep x"), (0, "Outer", 2, "after"), (-1, "", 3, "loose")]


def test_documents_by_venue_and_paper(spark, tmp_path):
    for name, text in {"v 1/p+1": '{"lines": {"1": "a"}, "captions": {}}', "v 1/p2": "{", "w/p3": '{"sections": []}'}.items():
        (tmp_path / name / "v1").mkdir(parents=True)
        (tmp_path / name / "v1/paper.sdr.json").write_text(text)
    assert [(r.venue, r.paper_id, r.sdr.lines) for r in io.documents(spark, str(tmp_path)).collect()] == [("v 1", "p+1", {"1": "a"})]


def test_embedding_heads_and_their_files(spark, tmp_path):
    rows = spark.createDataFrame([(k, [float(k % 2), 1.0, k / 90], ["a"] if k % 2 else ["b"]) for k in range(80)] + [(80, None, ["a"])], "id int, embedding array<double>, gold array<string>")
    model = classify.fit_on_embeddings(rows.where("id < 40"), ["a", "b"])
    limits = metrics.best_thresholds(metrics.threshold_counts(classify.probabilities(model, rows.where("id < 60"), ["a", "b"], "embedding"), ["a", "b"]), True)
    classify.save(model, limits, str(tmp_path / "m"), labels=["a", "b"], seed=3)
    again, thresholds, metadata = classify.load(spark, str(tmp_path / "m"))
    assert metadata == {"labels": ["a", "b"], "seed": 3}
    found = classify.predict(classify.probabilities(again, rows.where("id >= 60"), ["a", "b"], "embedding"), thresholds, ["a", "b"]).collect()
    assert len(found) == 20 and all(r.prediction == r.gold for r in found)
    assert providers.keywords({"f": {"x": ["u"], "y": ["w"]}})(["head:\nw u w", ""]) == [{"f": "y"}, {"f": "x"}]
