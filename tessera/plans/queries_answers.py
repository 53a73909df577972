"""Queries over classification by a provider, gold texts, assembled documents and classifiers on embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers, metrics, providers
from ..operators import documents as dc
from ..sources import io
from . import classify, hidden, lens
from .lens import LENS

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


# Words that the stand-in for a model looks for; of values with as many words the first wins.
_DIMENSION_WORDS = dict(zip(answers.DIMENSIONS, (["of"], ["in", "a"], ["and"], ["is", "it"], ["to", "that"], ["was", "for"], ["the"]), strict=True))
_RELATION_WORDS = dict(zip(answers.RELATIONS, (["in", "on"], ["of", "to"], ["the"]), strict=True))


def _most(words: dict) -> str:
    """SQL of the value whose words stand most often in the list x, the first of equals."""
    counts = ", ".join(f"len(list_filter(x, lambda w: w IN ({', '.join(repr(w) for w in ws)})))" for ws in words.values())
    return f"list_extract([{', '.join(repr(v) for v in words)}], list_position([{counts}], list_max([{counts}])))"


_TURNS = "t AS (SELECT conv_id, turn, role, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') AS x FROM conversations WHERE text IS NOT NULL)"


@query(
    f"""WITH {_TURNS}, c AS (SELECT role, {_most(_DIMENSION_WORDS)} AS category FROM t), n AS (SELECT role, count(*) AS n FROM c GROUP BY role)
  SELECT n.role, d.category, (SELECT count(*) FROM c WHERE c.role = n.role AND c.category = d.category) AS n, round(100 * (SELECT count(*) FROM c WHERE c.role = n.role AND c.category = d.category) / n.n, 6) AS percentage
  FROM n, (SELECT unnest([{', '.join(repr(v) for v in answers.DIMENSIONS)}]) AS category) d"""
)
def dimension_shares(spark, sf_dir):
    """The dimension of each turn by role; the user's turns were classified in an earlier run."""
    turns = lens.table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", "role", answers.dimension_prompt(F.col("text")).alias("prompt"))
    model = lambda: providers.keywords({"category": _DIMENSION_WORDS})
    allowed = {"category": answers.DIMENSIONS}
    done = answers.classified(turns.where("role = 'user'"), ["conv_id", "turn"], "prompt", model, allowed).select("conv_id", "turn", "category")
    found = answers.classified(turns, ["conv_id", "turn"], "prompt", model, allowed, done=done)
    return answers.shares(found, "category", answers.DIMENSIONS, ["role"]).select("role", "category", "n", "percentage")


@query(
    f"""WITH {_TURNS}, p AS (SELECT a.conv_id, a.turn, a.x FROM t a JOIN t u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant')
  SELECT conv_id, turn, {_most(_RELATION_WORDS)} AS relation, CASE WHEN len(list_filter(x, lambda w: w = 'the')) > 0 THEN 'low' ELSE 'high' END AS confidence, true AS ok FROM p"""
)
def relation_types(spark, sf_dir):
    """How each assistant turn answers the turn before it."""
    turns = lens.table(spark, sf_dir, "conversations").where("text is not null")
    before = turns.select("conv_id", (F.col("turn") + 1).cast(turns.schema["turn"].dataType).alias("turn"), F.col("text").alias("comment"))
    # the stand-in reads the last part of a prompt, so the sentence stands there
    pairs = turns.where("role = 'assistant'").join(before, ["conv_id", "turn"]).select("conv_id", "turn", answers.relation_prompt(F.col("comment"), F.lit("see below"), F.col("text")).alias("prompt"))
    model = lambda: providers.keywords({"relation": _RELATION_WORDS, "confidence": {"high": [], "medium": [], "low": ["the"]}, "rationale": {"words": []}})
    found = answers.classified(pairs, ["conv_id", "turn"], "prompt", model, {"relation": answers.RELATIONS, "confidence": answers.CONFIDENCE}, ["rationale"])
    return found.select("conv_id", "turn", "relation", "confidence", F.col("error").isNull().alias("ok"))


@query(
    """SELECT conv_id, turn, md5(text) AS text_md5, CASE conv_id % 3 WHEN 0 THEN 'gemma3' WHEN 1 THEN 'openai-gpt5' ELSE 'standard' END AS family FROM conversations WHERE text IS NOT NULL"""
)
def message_round_trip(spark, sf_dir):
    """Texts as message contents of three families, read back."""
    name = F.element_at(F.array(*map(F.lit, ["google/Gemma-3-27b", "gpt-5-mini", "some-model"])), (F.col("conv_id") % 3 + 1).cast("int"))
    rows = lens.table(spark, sf_dir, "conversations").where("text is not null").withColumn("family", answers.profile(name))
    return rows.select("conv_id", "turn", F.md5(answers.message_text(answers.message_content(F.col("text"), F.col("family")))).alias("text_md5"), "family")


_FLAG = "CASE WHEN doc_id % 5 = 4 THEN NULL WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 2 = 0 OR doc_id % 3 <> 0 END"


@query(f"SELECT doc_id, {_FLAG} AS filter_out FROM documents")
def grounding_answers(spark, sf_dir):
    """Four booleans in a fence after the text; some answers leave one out, some quote it."""
    flag = lambda c: F.when(c, "true").otherwise("false")
    grounded = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit('"'), flag(F.col("doc_id") % 3 == 0), F.lit('"'))).otherwise(flag(F.col("doc_id") % 3 == 0))
    tail = F.when(F.col("doc_id") % 5 == 4, F.lit("}")).otherwise(F.concat(F.lit(', "grounded_in_paper": '), grounded, F.lit("}")))
    answer = F.concat(F.lit('```json\n{"future_changes": false, "new_experiments": '), flag(F.col("doc_id") % 2 == 0), F.lit(', "external_references": false'), tail, F.lit("\n```"))
    return lens.table(spark, sf_dir, "documents").select("doc_id", answers.grounding(answer)["filter_out"].alias("filter_out"))


@query(
    f"""WITH {LENS}, d AS (SELECT doc_id AS paper_id, doc_id % 3 + 2 AS a, doc_id % 2 + 1 AS k, source || ' over ' || lang AS caption FROM documents),
  g AS (SELECT paper_id, 'Line' AS kind, a || '-' || (a + 2) AS label, (SELECT string_agg(text, '|' ORDER BY paragraph_id) FROM paragraphs p WHERE p.paper_id = d.paper_id AND p.start_line <= a + 2 AND p.end_line >= a) AS t FROM d
  UNION ALL SELECT paper_id, 'Section', CAST(k AS VARCHAR), (SELECT string_agg(text, ' ' ORDER BY paragraph_id) FROM paragraphs p WHERE p.paper_id = d.paper_id AND (paragraph_id - 1) // 2 + 1 = k) FROM d
  UNION ALL SELECT paper_id, 'Figure', CAST(k AS VARCHAR), CASE WHEN k = 1 THEN caption END FROM d)
  SELECT paper_id, kind, label, md5(coalesce(t, '')) AS texts_md5 FROM g
  UNION ALL SELECT paper_id, 'Page', '1', NULL FROM d"""
)
def gold_texts(spark, sf_dir):
    """Lines, a section, a figure and a page of each document as texts."""
    docs, pars = lens.table(spark, sf_dir, "documents"), lens.paragraphs(spark, sf_dir)
    a, k = F.col("doc_id") % 3 + 2, (F.col("doc_id") % 2 + 1).cast("string")
    label = {"Line": F.concat(a.cast("string"), F.lit("-"), (a + 2).cast("string")), "Section": k, "Figure": k, "Page": F.lit("1")}
    gold = docs.select(F.col("doc_id").alias("paper_id"), F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), c.alias("label")) for kind, c in label.items()))).alias("g")).select("paper_id", "g.*")
    figures = docs.select(F.col("doc_id").alias("paper_id"), F.lit("Figure").alias("figType"), F.lit("1").alias("name"), F.concat("source", F.lit(" over "), "lang").alias("caption"))
    found = dc.gold_texts(gold, pars, dc.with_paragraphs(lens.sections(spark, sf_dir), pars), dc.captions_of(figures), lens.lines(spark, sf_dir))
    return found.select("paper_id", "kind", "label", F.md5(F.array_join("texts", "|")).alias("texts_md5"))


@query(f"WITH {LENS} SELECT paper_id, count(*) AS n, md5(string_agg(text, chr(10) ORDER BY line_no)) AS text_md5 FROM (SELECT paper_id, line_no * 4 AS line_no, text FROM lines UNION ALL SELECT paper_id, line_no * 4 + 1, '9999' FROM lines) GROUP BY paper_id")
def without_line_numbers(spark, sf_dir):
    """Each line between its running number and another number; the third is followed by the author's mark."""
    at = (F.col("line_no") * 4).alias("at")
    ops = F.array(
        F.struct((at - 1).alias("ord"), F.lpad(F.col("line_no").cast("string"), 3, "0").alias("text")), F.struct(at.alias("ord"), "text"),
        F.struct((at + 1).alias("ord"), F.lit("9999").alias("text")), F.struct((at + 2).alias("ord"), F.when(F.col("line_no") == 3, "AnonymousACLsubmission").alias("text")),
    )
    rows = lens.lines(spark, sf_dir).select("paper_id", F.explode(ops).alias("o")).select("paper_id", "o.*").where("text is not null")
    kept = dc.without_line_numbers(rows).groupBy("paper_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("x"))
    return kept.select("paper_id", "n", F.md5(F.array_join(F.transform("x", lambda r: r["text"]), "\n")).alias("text_md5"))


@query(
    f"""WITH {LENS} SELECT d.doc_id AS paper_id, d.source AS venue, l.n AS lines, md5(l.t) AS text_md5, p.n AS paragraphs, s.n AS sections
  FROM documents d JOIN (SELECT paper_id, count(*) AS n, string_agg(text, chr(10) ORDER BY line_no) AS t FROM lines GROUP BY paper_id) l ON l.paper_id = d.doc_id
  JOIN (SELECT paper_id, count(*) AS n FROM paragraphs GROUP BY paper_id) p ON p.paper_id = d.doc_id JOIN (SELECT paper_id, count(*) AS n FROM sections GROUP BY paper_id) s ON s.paper_id = d.doc_id"""
)
def assembled_documents(spark, sf_dir):
    """Documents assembled as JSON, then read back."""
    docs, pars = lens.table(spark, sf_dir, "documents"), lens.paragraphs(spark, sf_dir)
    meta = docs.select(F.col("doc_id").alias("paper_id"), F.col("source").alias("venue"), F.lit("a title").alias("title"))
    figures = docs.select(F.col("doc_id").alias("paper_id"), F.lit("Figure 1").alias("caption_id"), F.col("lang").alias("text")).where("text is not null")
    back = io.parsed_documents(dc.assembled(lens.lines(spark, sf_dir), pars, lens.sections(spark, sf_dir), figures, meta), "sdr")
    ordered = F.array_sort(F.transform(F.map_entries("sdr.lines"), lambda e: F.struct(e["key"].cast("long").alias("k"), e["value"].alias("v"))))
    return back.select(
        "paper_id", "sdr.metadata.venue", F.size("sdr.lines").cast("long").alias("lines"), F.md5(F.array_join(F.transform(ordered, lambda x: x["v"]), "\n")).alias("text_md5"),
        F.size("sdr.paragraphs").cast("long").alias("paragraphs"), F.size("sdr.sections").cast("long").alias("sections"),
    )


@query()
def embedding_classifier(spark, sf_dir):
    """Classes of vectors by heads on the embeddings: trained and tuned on even rows, tested on odd ones."""
    rows = lens.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.array(F.col("label").cast("string")).alias("gold"))
    labels = [str(k) for k in range(10)]
    model = classify.fit_on_embeddings(rows.where("vec_id % 4 = 0"), labels)
    counts = metrics.threshold_counts(classify.probabilities(model, rows.where("vec_id % 4 = 2"), labels, "embedding"), labels)
    found = classify.predict(classify.probabilities(model, rows.where("vec_id % 2 = 1"), labels, "embedding"), metrics.best_thresholds(counts, True), labels)
    return metrics.label_report(found, labels)


@query()
def hidden_classifier(spark, sf_dir):
    """Whether the first two numbers of a vector have one sign, which no linear head can tell: linear and hidden heads, trained on even rows, tested on odd ones."""
    same = F.col("embedding")[0] * F.col("embedding")[1] > 0
    rows = lens.table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 8).alias("embedding"), F.array(F.when(same, "same").otherwise("other")).alias("gold"))
    train, test, labels = rows.where("vec_id % 2 = 0"), rows.where("vec_id % 2 = 1"), ["same", "other"]
    head, _ = hidden.fit(train, labels, hidden=32, epochs=30, batches=2, rate=0.05)
    linear = hidden.predict(classify.probabilities(classify.fit_on_embeddings(train, labels), test, labels, "embedding"), labels)
    told = linear.withColumn("head", F.lit("linear")).unionByName(hidden.predict(hidden.probabilities(head, test), labels).withColumn("head", F.lit("hidden")))
    right = (F.array_join("prediction", ",") == F.array_join("gold", ",")).cast("int")
    return told.groupBy("head").agg(F.count("*").alias("n"), F.round(F.avg(right), 6).alias("accuracy"))
