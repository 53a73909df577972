"""Threads, structured documents, fuzzy filters, construction."""

import random

from pyspark.sql import functions as F

from tessera.operators import documents as dc
from tessera.operators import fuzzy, providers, threads
from tessera.plans import construct

NOTES = [("p", "r1", None, "Reviewer"), ("p", "c1", "r1", "Authors"), ("p", "c2", "c1", "Authors"), ("p", "c3", "c2", "Reviewer"), ("p", "c9", "zzz", "Authors"), ("p", "x", "y", "A"), ("p", "y", "x", "A")]


def test_threads(spark):
    df = spark.createDataFrame(NOTES, "paper_id string, note_id string, replyto string, from_role string")
    assert {r.note_id: r.depth for r in threads.flattened(df).collect()} == {"r1": 0, "c1": 1, "c2": 2, "c3": 3}
    up = {r.note_id: r.ancestor for r in threads.ancestor_of_other_role(df).collect()}
    assert (up["c1"], up["c2"], up["c3"], up["r1"]) == ("r1", "r1", "c2", None)
    deep = spark.createDataFrame([("q", f"n{k}", f"n{k - 1}" if k else None, "A" if k else "B") for k in range(300)], df.schema)
    flat = {r.note_id: (r.depth, r.path[-2:]) for r in threads.flattened(deep).collect()}
    assert len(flat) == 300 and flat["n299"] == (299, ["n298", "n299"])
    assert {r.ancestor for r in threads.ancestor_of_other_role(deep).collect()} == {None, "n0"}
    ring = spark.createDataFrame([("q", f"n{k}", f"n{(k + 1) % 3}", "A") for k in range(3)] + [("q", "out", "n0", "A")], df.schema)
    assert threads.flattened(ring).count() == 0 and {r.ancestor for r in threads.ancestor_of_other_role(ring).collect()} == {None}
    assert [r.note_id for r in threads.with_reply_from(df, "Reviewer").collect()] == ["c2"]
    twice = spark.createDataFrame([("p", "a", 1, "old"), ("p", "a", 2, "new")], "paper_id string, note_id string, ord int, comment string")
    assert threads.last_of_each(twice, ["paper_id", "note_id"], "ord").first().comment == "new"


PARS = [("p", 1, "A", "one", 10, 14), ("p", 2, "A", "two", 15, 20), ("p", 3, "B", "three", -1, -1)]
SECS = [("p", "2", "A", 1, 8, 20), ("p", "2.1", "B", 2, 15, 20), ("p", "3", "C", 1, 21, -1)]


def tables(spark):
    pars = spark.createDataFrame(PARS, "paper_id string, paragraph_id int, section string, text string, start_line int, end_line int")
    secs = spark.createDataFrame(SECS, "paper_id string, number string, name string, level int, start_line int, end_line int")
    return pars, secs


def test_interval_and_hierarchy_joins(spark):
    pars, secs = tables(spark)
    wanted = spark.createDataFrame([("p", 14, 15)], "paper_id string, lo int, hi int")
    assert {r.paragraph_id for r in dc.paragraphs_of_lines(wanted, pars).collect()} == {1, 2}
    assert {(r.paragraph_id, r.number) for r in dc.paragraph_sections(pars, secs).collect()} == {(1, "2"), (2, "2"), (2, "2.1")}
    more = spark.createDataFrame([("p", x) for x in ("3", "3.2", "4", "3.2.1")], "paper_id string, number string")
    assert {(r.number, r.ancestor) for r in dc.section_ancestors(more).collect()} == {("3.2", "3"), ("3.2.1", "3"), ("3.2.1", "3.2")}
    gold = spark.createDataFrame([("p", "2")], "paper_id string, gold string")
    assert {r.paragraph_id for r in dc.section_tree_paragraphs(gold, pars, secs).collect()} == {1, 2}


def test_section_detection_and_gaps(spark):
    heads = {1: "Abstract", 5: "1 Introduction", 8: "1.1 Setup", 12: "2 Method"}
    lines = spark.createDataFrame([("p", n, heads.get(n, "text")) for n in range(1, 21)], "paper_id string, line_no int, text string")
    secs = dc.sections_of(lines)
    assert {r.number: (r.start_line, r.end_line) for r in secs.collect()} == {"0": (1, 4), "1": (5, 11), "1.1": (8, 11), "2": (12, 20)}
    assert dc.introduction_line(secs).first().line == 5
    holes = spark.createDataFrame([("p", 1, 1, 5), ("p", 2, -1, -1), ("p", 3, None, None), ("p", 4, 12, 15)], "paper_id string, paragraph_id int, start_line int, end_line int")
    assert [(r.start_line, r.end_line) for r in dc.filled_gaps(holes).orderBy("paragraph_id").collect()] == [(1, 5), (6, 11), (-1, -1), (12, 15)]


def test_look_ups(spark):
    pars, secs = tables(spark)
    lines = spark.createDataFrame([("p", n, f"l{n}") for n in (8, 9, 21, 22)], "paper_id string, line_no int, text string")
    with_pars = dc.with_paragraphs(secs, pars)
    assert {r.number: r.end_line for r in with_pars.collect()} == {"2": 20, "2.1": None, "3": -1}
    wanted = spark.createDataFrame([("p", "2"), ("p", "9")], "paper_id string, number string")
    assert {r.number: r.text for r in dc.section_text(wanted, with_pars, pars, lines).collect()} == {"2": "one two", "9": None}
    caps = dc.captions_of(spark.createDataFrame([("p", "Figure", "1", "cap"), ("p", "Table", "", "x")], "paper_id string, figType string, name string, caption string"))
    ask = spark.createDataFrame([("p", " figure 1 "), ("p", "Figure 2")], "paper_id string, name string")
    assert {r.name.strip(): r.text for r in dc.caption(ask, caps).collect()} == {"figure 1": "cap", "Figure 2": None}
    pool = dc.candidates(lines, pars, with_pars.where("level = 1"), caps)
    assert {r.cand_id for r in pool.collect()} == {"Line 8", "Line 9", "Line 21", "Line 22", "Paragraph 1", "Paragraph 2", "Paragraph 3", "Section 2 / A", "Figure 1"}
    meta = spark.createDataFrame([("p", "v", "t")], "paper_id string, venue string, title string")
    assert '"line_no"' not in dc.assembled(lines, pars, secs, caps, meta).first().sdr
    names = spark.createDataFrame([("p", "methods overview")], "paper_id string, name string")
    named = spark.createDataFrame([("p", "1", "Method overview", 1), ("p", "2", "Results", 2)], "paper_id string, number string, name string, start_line int")
    assert dc.section_by_name(names, named).first().number == "1"
    rows = spark.createDataFrame([("p", 1, "some text- 012"), ("p", 2, "other 012"), ("p", 3, "no number")], "paper_id string, ord int, text string")
    assert [(r.line_no, r.text) for r in dc.numbered_lines(rows).collect()] == [(12, "other")]


def test_alignment(spark):
    lines = spark.createDataFrame([("p", n, t) for n, t in enumerate(["head", "alpha beta gamma", "delta epsilon", "zeta eta", "other stuff here", "more of it"], 1)], "paper_id string, line_no int, text string")
    pars = spark.createDataFrame([("p", 1, "s", "alpha beta gamma delta epsilon"), ("p", 2, "s", "not there at all, never"), ("p", 3, "s", "other stuff here more of it")], "paper_id string, paragraph_id int, section string, text string")
    start = spark.createDataFrame([("p", 1)], "paper_id string, line int")
    got = {r.paragraph_id: (r.start_line, r.end_line, r.status) for r in dc.aligned(pars, lines, start, lambda a, b: fuzzy.best_window(a, b, 90)).collect()}
    assert got == {1: (2, 3, "matched"), 2: (-1, -1, "filled"), 3: (5, 6, "matched")}


def test_fuzzy_ratios_against_definitions(spark):
    def lcs(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    rng = random.Random(6)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, n))) for n in (8, 20))
        assert fuzzy.lcs(a, b) == lcs(a, b)
        s, t = sorted((a, b), key=len)
        want = max((200 * lcs(s, t[max(i, 0) : i + len(s)]) / (len(s) + len(t[max(i, 0) : i + len(s)])) for i in range(1 - len(s), len(t))), default=0) if s else 100.0 * (not t)
        assert abs(fuzzy.best_window(a, b) - want) < 1e-9
    assert fuzzy.set_ratio("a b", "b a c") == 100 and fuzzy.set_ratio("", "a") == 0
    df = spark.createDataFrame([("> quoted",), ("**bold**",), ("# head",), ("plain",)], "t string")
    assert [r[0] for r in df.select(fuzzy.looks_quoted(F.col("t"))).collect()] == [True, True, True, False]


def test_construction(spark):
    reviews = spark.createDataFrame([("p", "r1", "The claim in Table 3 is unclear to me. Yes.")], "paper_id string, note_id string, comment string")
    comments = spark.createDataFrame([("p", "c1", "r1", "Authors", "We added the numbers in Table 2 and Section 4.1 for you. See Fig. 3 now.")], "paper_id string, note_id string, replyto string, from_role string, comment string")
    flat = construct.notes(reviews, comments)
    authors = flat.where("from_role = 'Authors'")
    found = construct.contexts(authors, ["paper_id", "note_id"], "comment")
    assert {(r.kind, r.mention) for r in found.collect()} == {("table", "Table 2"), ("section", "Section 4.1")}  # the short sentence goes
    nested = construct.grouped_contexts(found, ["paper_id", "note_id"]).first().referencing_sentences
    assert nested == {"We added the numbers in Table 2 and Section 4.1 for you.": {"table": ["Table 2"], "section": ["Section 4.1"]}}
    said = reviews.selectExpr("paper_id", "comment AS review").join(found.select("paper_id", "note_id").distinct(), "paper_id")
    assert construct.unquoted(found.select("paper_id", "note_id", "context").distinct(), said, ["paper_id", "note_id"]).count() == 1
    spans = construct.reviewer_spans(said, ["paper_id"])
    assert [r.span_id for r in spans.orderBy("pos").collect()] == ["rev_sent_0", "rev_sent_1"]
    pairs = found.select("paper_id", "context").distinct().join(spans.select("paper_id", "pos", F.col("text").alias("review_sentence")), "paper_id")
    links = construct.aligned(pairs, ["paper_id"], providers.scorer("lexical"), 0.3)
    assert links.first().review_spans == ["The claim in Table 3 is unclear to me."]
    keep = spark.createDataFrame([("See Tables 2-4", ["Table 3 is unclear"]), ("See Tables 2-4", ["Figure 3 is unclear"])], "context string, review_spans array<string>")
    assert [r.review_spans for r in construct.nontrivial(keep).collect()] == [["Figure 3 is unclear"]]
    ids = spark.createDataFrame([("p", ["rev_sent_1", "nope"]), ("p", ["nope"]), ("p", ["rev_sent_0", "rev_sent_1"]), ("p", ["rev_sent_0", "rev_sent_1"])], "paper_id string, ids array<string>")
    assert [len(r.review_spans) for r in construct.spans_of_ids(ids, spans, ["paper_id"]).collect()].count(2) == 2
    assert {(tuple(r.review_spans), r.reason) for r in construct.spans_of_ids(ids, spans, ["paper_id"]).collect()} == {(("Yes.",), None), ((), "no known span"), (("The claim in Table 3 is unclear to me.", "Yes."), None)}


def test_providers_report_failures(spark):
    def broken():
        def call(prompts):
            if "bad" in prompts[0]:
                raise ValueError("no")
            return [{"score": 1.0}]

        return call

    df = spark.createDataFrame([("good",), ("bad",)], "prompt string")
    got = {r.prompt: r for r in providers.answered(df, "prompt", broken, "score double", tries=2).collect()}
    assert got["good"].score == 1.0 and got["good"].error is None and got["bad"].score is None and "no" in got["bad"].error
    assert [providers.wait_seconds(k, 1, 60, lambda: 1.0) for k in (0, 3, 9)] == [1, 8, 60]
