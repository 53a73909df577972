"""Golden cases and properties of text functions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.patterns import FLAGS, PATTERNS
from tessera.functions.sentences import merge, sentences, split_text
from tessera.operators import intervals


def values(spark, items, make):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


MENTIONS = {
    "See Section 3.2, Tables 1-3 and Fig. 2a (lines 120-125).": [("section", "Section 3.2", 4, 15), ("table", "Tables 1-3", 17, 27), ("figure", "Fig. 2a", 32, 39), ("line", "lines 120-125)", 41, 55)],
    "Use L1 loss, L120 and L12-L15; Tables 2 and\n4, Sec. 3": [("line", "L120", 13, 17), ("line", "L12-L15", 22, 29), ("table", "Tables 2 and\n4", 31, 45), ("section", "Sec. 3", 47, 53)],
    "Table\n3 but lines\n7": [("line", "lines\n7", 12, 19)],
    "é😀 Eq. (3) on p. 4, footnote 2, Appendix B.1": [("equation", "Eq. (3)", 3, 10), ("page", "p. 4", 14, 18), ("footnote", "footnote 2", 20, 30), ("appendix", "Appendix B.1", 32, 44)],
    "": [],
}


def test_mentions(spark):
    for got, want in zip(values(spark, list(MENTIONS), tx.mentions), MENTIONS.values()):
        assert [(m.kind, m.text, m.start, m.end) for m in got] == want
    assert values(spark, [None], tx.mentions) == [[]]


def test_mentions_match_a_plain_scan(spark):
    rng = random.Random(2)
    bits = ["Section", "Tab.", "fig", "line", "l.", " ", " ", "3", "4.2", "-", " and ", "\n", "(", ")", "é", "p.", "L12", "appendix ", "B", ",", "eq", "results section"]
    items = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    for t, got in zip(items, values(spark, items, tx.mentions)):
        want = sorted({(m.start(), m.end(), k, m.group()) for k, p in PATTERNS.items() for m in re.finditer(p.removeprefix(FLAGS), t, re.I)})
        assert [tuple(m) for m in got] == want
        assert all(t[m.start : m.end] == m.text for m in got)


def test_references(spark):
    refs = lambda t: [(r.type, r.label) for r in values(spark, [t], tx.references)[0]]
    assert refs(next(iter(MENTIONS))) == [("Section", "3.2"), ("Table", "1"), ("Table", "2"), ("Table", "3"), ("Figure", "2a"), ("Line", "120-125")]
    assert refs("Limitations section, L12-L15") == [("Section", "limitations"), ("Line", "12-15")]
    old = values(spark, ["Limitations section, L12-L15"], lambda x: tx.references(x, compat=True))[0]
    assert [(r.type, r.label) for r in old] == [("Section", "imitations"), ("Line", "12"), ("Line", "15")]
    assert refs("appendix b and eq. 3") == [("Appendix", "B"), ("Equation", "3")]


@pytest.mark.parametrize(("label", "want"), [("4-6", ["4", "5", "6"]), ("4.1-4.3", ["4.1", "4.2", "4.3"]), ("7A-7C", ["7A-7C"]), ("6-4", ["6-4"]), ("1–2", ["1", "2"]), ("5", ["5"]), ("1-9999", ["1-9999"])])
def test_expand_range(spark, label, want):
    assert values(spark, [label], tx.expand_range) == [want]


def test_other_labels(spark):
    assert values(spark, ["Appendix B.1", "Tables 2-4", "Fig. 3(a)"], tx.trivial_refs) == [[], ["table:2", "table:3", "table:4"], ["figure:3"]] or values(spark, ["Tables 2-4"], tx.trivial_refs) == [["table:2", "table:3", "table:4"]]
    stat = lambda t: values(spark, [t], lambda x: F.transform(tx.mentions(x), tx.stat_label))[0]
    assert stat("Tables 2–4, the Results section") == ["2-4", "results"]
    got = values(spark, ["12", "12-15", "15–12", "x"], tx.label_bounds)
    assert [tuple(x) if x else None for x in got] == [(12, 12), (12, 15), (12, 15), None]
    assert values(spark, ["Section 3 / Intro", "Line 4"], tx.canonical_id) == ["Section 3", "Line 4"]
    assert values(spark, ["Line 4", "Paragraph 2", "Section 1 / A", "Figure 2", "Table x", "other"], tx.candidate_type) == ["raw_line", "line", "section", "figure", "table", None]


def test_clean_up(spark):
    df = spark.createDataFrame([(["con-", "cept is", "", "multi-"],), ([],)], "l array<string>")
    assert [r[0] for r in df.select(tx.join_lines(F.col("l"))).collect()] == ["concept is multi-", ""]
    assert values(spark, ["  A\u00a0 b\n"], tx.collapse) == ["a b"]
    assert values(spark, ["A–b* c!"], tx.plain) == ["a-b c"]
    assert values(spark, ["soft\u00adhy  x"], tx.no_soft_hyphens) == ["softhy x"]
    assert values(spark, ["3 Intro-duction"], tx.name_key) == ["3introduction"]
    assert values(spark, [None, " a  b "], tx.n_tokens) == [0, 2]


def test_answers(spark):
    fenced = 'Sure:\n```json\n{"a": 1}\n```'
    got = values(spark, [fenced, 'x {"a":1} y', "none", "[1, 2]", '```json\n{"a":{"b":2}}\n```'], tx.salvage_json)
    assert got[1] == '{"a":1}' and got[2] is None and got[3] == "[1, 2]" and got[4] == '{"a":{"b":2}}' and '"a"' in got[0]
    df = spark.createDataFrame([(["Line", "section", "figure", "foo"],)], "l array<string>")
    assert df.select(tx.normalize_labels(F.col("l"))).first()[0] == ["figure", "line", "section"]
    assert df.select(tx.normalize_labels(F.col("l"), "text3")).first()[0] == ["figure", "text"]
    assert values(spark, ['{"a": "x", "b": "y"}', "plain"], tx.flatten_review) == ["a:\nx\n\nb:\ny", "plain"]


def test_sentences(spark):
    t = "As shown in Fig. 2, it works. See e.g. Sec. 3! Done\nNext line"
    assert [s for s, _, _ in split_text(t)] == ["As shown in Fig. 2, it works.", "See e.g. Sec. 3!", "Done", "Next line"]
    assert [s for s, _, _ in split_text("# Head: body\n1. one\n> q. r\n")] == ["# Head:", "body", "1. one", "> q.", "r"]
    rng = random.Random(3)
    for _ in range(300):
        x = "".join(rng.choice("ab. !?\n>#*:1)\"é") for _ in range(rng.randint(0, 40)))
        parts = split_text(x)
        assert all(x[a:b] == s and s.strip() == s != "" for s, a, b in parts)
        assert all(p[2] <= q[1] for p, q in zip(parts, parts[1:]))
        assert "".join("".join(s.split()) for s, _, _ in parts) == "".join(x.split())
    assert [s.text for s in values(spark, [t], sentences)[0]][0] == "As shown in Fig. 2, it works."


def test_intervals(spark):
    assert merge([(0, 5), (5, 7), (11, 20), (10, 12)]) == [(0, 7), (10, 20)]
    rng = random.Random(5)
    data = [(k, a, a + rng.randint(0, 6)) for k in range(8) for a in (rng.randint(0, 60) for _ in range(12))]
    df = spark.createDataFrame(data, "k int, start int, end int")
    got = {}
    for r in intervals.merged(df, ["k"]).collect():
        got.setdefault(r.k, []).append((r.start, r.end))
    for k in range(8):
        assert sorted(got[k]) == merge([(a, b) for x, a, b in data if x == k])
    arr = df.groupBy("k").agg(F.collect_list(F.struct("start", "end")).alias("s")).select("k", intervals.merged_array(F.col("s")).alias("m"), intervals.holds(F.col("s"), F.lit(30)).alias("h"))
    for r in arr.collect():
        mine = [(a, b) for x, a, b in data if x == r.k]
        assert [tuple(m) for m in r.m] == merge(mine) and r.h == any(a <= 30 < b for a, b in mine)


def test_mentions_keep_control_characters_and_are_found_without_digits(spark):
    rows = [(2, "no digits: appendix B, results section"), (3, "l12 \u2013 Fig\x01 3"), (4, "eq. \u0663")]
    got = {r.i: [m.text for m in r.m] for r in spark.createDataFrame(rows, "i int, t string").select("i", tx.mentions(F.col("t")).alias("m")).collect()}
    assert got[2] == ["appendix B", "results section"] and got[4] == ["eq. \u0663"]
    held = spark.createDataFrame([(1, "Table 1\x01 Table 2")], "i int, t string").select(tx.mentions(F.col("t")).alias("m")).first().m
    assert [(m.start, m.end, m.text) for m in held] == [(0, 7, "Table 1"), (9, 16, "Table 2")]
