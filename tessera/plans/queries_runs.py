"""Queries over sources, retrieval runs and bookkeeping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import documents as dc
from ..operators import metrics, ranking, sampling, threads
from . import classify, lens, retrieval
from .lens import LENS

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


@query(f"WITH {LENS}, k AS (SELECT paper_id, line_no, 100 + line_no % 7 AS n, text AS t, max(line_no) OVER (PARTITION BY paper_id, line_no % 7) AS last_no FROM lines) SELECT paper_id, CAST(n AS BIGINT) AS line_no, md5(trim(t || ' end')) AS text_md5 FROM k WHERE line_no = last_no")
def numbered_lines(spark, sf_dir):
    """Page rows that end in a number; of equal numbers the last row stays."""
    rows = lens.lines(spark, sf_dir).select("paper_id", F.col("line_no").alias("ord"), F.concat("text", F.lit(" end "), (100 + F.col("line_no") % 7).cast("string")).alias("text"))
    return dc.numbered_lines(rows).select("paper_id", F.col("line_no").cast("long").alias("line_no"), F.md5("text").alias("text_md5"))


@query(f"WITH {LENS}, s AS (SELECT paper_id, line_no, (line_no - 1) // 2 AS k FROM lines) SELECT paper_id, line_no FROM s WHERE k <= 2")
def until_limitations(spark, sf_dir):
    """Sections of two lines; the third is called Limitations."""
    k = F.expr("(line_no - 1) DIV 2")
    rows = lens.lines(spark, sf_dir).select("paper_id", "line_no", k.alias("section_ord"), F.when(k == 2, "Our Limitations").otherwise("Part").alias("section"), "text")
    return dc.until_limitations(rows).select("paper_id", "line_no")


@query("SELECT doc_id AS paper_id, CASE WHEN doc_id % 2 = 0 THEN source || ' over ' || lang END AS caption FROM documents")
def caption_lookup(spark, sf_dir):
    docs = lens.table(spark, sf_dir, "documents")
    figures = docs.select(F.col("doc_id").alias("paper_id"), F.lit("Figure").alias("figType"), F.when(F.col("doc_id") % 2 == 0, "1").otherwise("2").alias("name"), F.concat("source", F.lit(" over "), "lang").alias("caption"))
    asked = docs.select(F.col("doc_id").alias("paper_id"), F.lit(" FIGURE 1").alias("name"))
    return dc.caption(asked, dc.captions_of(figures)).select("paper_id", F.col("text").alias("caption"))


@query("SELECT conv_id, turn, concat_ws('::', role, conv_id, turn) AS record_id FROM conversations")
def record_ids(spark, sf_dir):
    return lens.table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.record_id("role", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("record_id"))


@query("SELECT doc_id, least(doc_id % 50, doc_id % 70) AS lo, greatest(doc_id % 50, doc_id % 70) AS hi FROM documents")
def line_labels(spark, sf_dir):
    label = F.concat((F.col("doc_id") % 50).cast("string"), F.lit("–"), (F.col("doc_id") % 70).cast("string"))
    return lens.table(spark, sf_dir, "documents").select("doc_id", tx.label_bounds(label).alias("b")).select("doc_id", "b.lo", "b.hi")


@query("SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS prompt_tokens, round((sum(length(text)) * 1.25 + count(*) * 10) / 1000000, 6) AS cost FROM conversations GROUP BY role")
def token_costs(spark, sf_dir):
    used = lens.table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("prompt_tokens"))
    return used.withColumn("cost", F.round(ranking.cost(F.col("prompt_tokens").cast("double"), F.col("n").cast("double")), 6))


@query("SELECT vec_id, round(exp(-label) / (exp(-label) + exp(-(vec_id % 5))), 6) AS p FROM embeddings")
def yes_probabilities(spark, sf_dir):
    """P(yes) of two log-probabilities."""
    return lens.table(spark, sf_dir, "embeddings").select("vec_id", F.round(ranking.yes_probability(-F.col("label").cast("double"), -(F.col("vec_id") % 5).cast("double")), 6).alias("p"))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN -100.0 ELSE round(1 / (1 + exp(-(label - 5))), 6) END AS p FROM embeddings")
def decision_probabilities(spark, sf_dir):
    """P(A) at the last label that a response said; no label gives -100."""
    top = F.create_map(F.lit(" A"), F.col("label").cast("double") - 20, F.lit("b"), F.lit(-15.0), F.lit("x"), F.lit(-1.0))
    tokens = F.array(F.struct(F.lit("B").alias("token"), F.create_map(F.lit("A"), F.lit(-9.0)).alias("top")), F.struct(F.when(F.col("vec_id") % 3 == 0, "?").otherwise(" A.").alias("token"), top.alias("top")))
    shown = F.when(F.col("vec_id") % 3 == 0, F.slice(tokens, 2, 1)).otherwise(tokens)
    return lens.table(spark, sf_dir, "embeddings").select("vec_id", F.round(retrieval.decision(shown), 6).alias("p"))


_RUNS = "q AS (SELECT doc_id, doc_id % 11 = 0 AS s, doc_id % 7 = 0 AS p, doc_id % 5 = 0 AS e, doc_id % 3 = 0 AS g FROM documents)"


@query(f"WITH {_RUNS}, r AS (SELECT CASE WHEN s THEN 'outside_shared_subset' WHEN p THEN 'missing_prediction' WHEN e THEN 'empty_scores' WHEN g THEN 'missing_or_unexpandable_gold' END AS reason FROM q) SELECT reason, count(*) AS n FROM r GROUP BY reason")
def exclusion_reasons(spark, sf_dir):
    docs = lens.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "doc_id")
    queries = docs.select("id", F.when(F.col("doc_id") % 3 != 0, F.array(F.lit("x"))).alias("gold_units"), F.when(F.col("doc_id") % 5 == 0, 0).otherwise(4).alias("n_scores"))
    return retrieval.exclusions(queries, docs.where("doc_id % 7 <> 0"), docs.where("doc_id % 11 <> 0")).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id % 4 IN (1, 3) AND text IS NOT NULL")
def figure_table_queries(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ["Section 2", "Table 3", "lines 3-4", "Fig. 1"])), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = lens.table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit("\nSee "), kind, F.lit(" please.")).alias("rebuttal_sentence"))
    return retrieval.on_figures_and_tables(retrieval.with_gold(rows)).select("doc_id")


@query(f"WITH {LENS} SELECT paper_id, md5(string_agg(text, ' ' ORDER BY paragraph_id)) AS text_md5 FROM paragraphs GROUP BY paper_id")
def entire_texts(spark, sf_dir):
    return dc.entire_texts(lens.paragraphs(spark, sf_dir), lens.lines(spark, sf_dir)).select("paper_id", F.md5("text").alias("text_md5"))


@query(
    f"""WITH {LENS}, p AS (SELECT paper_id, (line_no - 1) // 4 AS page, line_no, trim(text) AS t, max(line_no) OVER (PARTITION BY paper_id, (line_no - 1) // 4) AS last_no FROM lines)
  SELECT paper_id, page, md5(trim(string_agg(CASE WHEN t = '' THEN '' WHEN t LIKE '%-' AND line_no < last_no THEN regexp_replace(t, '-$', '') ELSE t || ' ' END, '' ORDER BY line_no))) AS text_md5 FROM p GROUP BY paper_id, page"""
)
def page_texts(spark, sf_dir):
    """Pages of four lines."""
    rows = lens.lines(spark, sf_dir)
    pages = rows.groupBy("paper_id", F.expr("(line_no - 1) DIV 4").alias("page")).agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"))
    return dc.page_texts(pages, rows).select("paper_id", "page", F.md5("text").alias("text_md5"))


@query("SELECT nation, id, row_number() OVER (PARTITION BY nation ORDER BY try_cast(id AS BIGINT) NULLS LAST, id) AS place FROM (SELECT c_nationkey AS nation, CASE WHEN c_custkey % 10 = 0 THEN 'q' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS id FROM customer)")
def numeric_order(spark, sf_dir):
    """Places in each nation, in an order that is numeric where it can be."""
    ids = lens.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("q"), "c_custkey")).otherwise(F.col("c_custkey").cast("string")).alias("id"))
    return ids.withColumn("place", F.row_number().over(Window.partitionBy("nation").orderBy(*ranking.numeric_first("id"))).cast("long"))


@query(
    """WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS x FROM conversations WHERE conv_id % 2 = 1),
  s AS (SELECT q.conv_id, c.turn, (len(list_intersect(q.x, c.x)) + 0.5) / (len(list_distinct(q.x)) + 1) AS s FROM w q JOIN w c ON c.conv_id = q.conv_id AND q.turn = 0 AND c.turn > 0)
  SELECT conv_id, 0 AS q_idx, 'Turn ' || turn AS cand_id, CAST(turn AS BIGINT) AS ord, round(s, 6) AS score, row_number() OVER (PARTITION BY conv_id ORDER BY s DESC, turn) AS rank FROM s"""
)
def scored_run(spark, sf_dir):
    """A registered scorer over each conversation's first turn against its other turns; half of the queries are done already."""
    turns = lens.table(spark, sf_dir, "conversations")
    asked = turns.where("turn = 0").select("conv_id", F.lit(0).alias("q_idx"), "text")
    pool = turns.where("turn > 0").select("conv_id", F.concat(F.lit("Turn "), F.col("turn").cast("string")).alias("cand_id"), F.col("turn").alias("ord"), "text")
    run = retrieval.scored(asked, pool, ["conv_id"], ["q_idx"], "lexical", asked.where("conv_id % 2 = 0").select("conv_id", "q_idx"))
    return run.select("conv_id", "q_idx", "cand_id", F.col("ord").cast("long").alias("ord"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("SELECT count(*) AS comments, count(*) FILTER (doc_id % 3 <> 0) AS referring, CAST(sum(CASE WHEN doc_id % 3 <> 0 THEN doc_id % 3 ELSE 0 END) AS BIGINT) AS mentions, round(100 * count(*) FILTER (doc_id % 3 <> 0) / count(*), 6) AS referring_pct FROM documents")
def reference_counts(spark, sf_dir):
    """How many comments refer to something, and how often."""
    said = F.concat("text", F.lit("\n"), F.when(F.col("doc_id") % 3 == 1, "see Table 4 here").when(F.col("doc_id") % 3 == 2, "Table 4; Figure 2").otherwise("nothing"))
    n = lens.table(spark, sf_dir, "documents").select(F.size(tx.mentions(said)).alias("n"))
    counts = n.agg(F.count("*").alias("comments"), F.count_if(F.col("n") > 0).alias("referring"), F.sum("n").alias("mentions"))
    return counts.withColumn("referring_pct", F.round(100 * metrics.ratio(F.col("referring"), F.col("comments")), 6))


@query("SELECT conv_id AS paper_id, turn % 3 AS note_id, max_by(md5(text), turn) AS text_md5 FROM conversations GROUP BY conv_id, turn % 3")
def last_duplicates(spark, sf_dir):
    """Of notes with one id the last stays."""
    rows = lens.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("paper_id"), (F.col("turn") % 3).alias("note_id"), "turn", F.md5("text").alias("text_md5"))
    return threads.last_of_each(rows, ["paper_id", "note_id"], "turn").select("paper_id", "note_id", "text_md5")


@query("SELECT 'REL-' || lpad(CAST(row_number() OVER (ORDER BY md5(doc_id || ':23'), doc_id) AS VARCHAR), 3, '0') AS sample_id, doc_id FROM documents QUALIFY row_number() OVER (ORDER BY md5(doc_id || ':23'), doc_id) <= 50")
def relation_sample(spark, sf_dir):
    """Fifty rows (the feature) with running ids."""
    return sampling.numbered(sampling.sample(lens.table(spark, sf_dir, "documents").select("doc_id"), 50, "doc_id", "23"), "doc_id", "23", "REL-").select("sample_id", "doc_id")


@query()
def content_type_classifier(spark, sf_dir):
    """Languages as content types: trained and tuned on even documents, tested on odd ones."""
    rows = lens.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("comment"), F.array("lang").alias("gold"))
    labels = ["de", "en", "es", "fr"]
    model, limits = classify.train_and_tune(rows.where("doc_id % 4 = 0"), rows.where("doc_id % 4 = 2"), labels)
    return metrics.label_report(classify.predict(classify.probabilities(model, rows.where("doc_id % 2 = 1"), labels), limits, labels), labels)
