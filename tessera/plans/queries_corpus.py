"""Queries over structured documents and rankers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.patterns import SECTION_HEADER, UNNUMBERED
from ..operators import documents as dc
from ..operators import fuzzy, metrics, postings, ranking, vectors
from ..sources import io
from ..storage import saved
from . import lens
from .lens import LENS

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


_JOINED = """w AS (SELECT paper_id, CAST(line_no AS BIGINT) AS line_no, trim(text) AS t, max(line_no) OVER (PARTITION BY paper_id) AS last_no FROM lines WHERE line_no BETWEEN 2 AND 5),
  p AS (SELECT paper_id, line_no, CASE WHEN t = '' THEN '' WHEN t LIKE '%-' AND line_no < last_no THEN regexp_replace(t, '-$', '') ELSE t || ' ' END AS piece FROM w)"""


@query(f"WITH {LENS}, {_JOINED} SELECT paper_id, trim(string_agg(piece, '' ORDER BY line_no)) AS text FROM p GROUP BY paper_id")
def lines_range_text(spark, sf_dir):
    rows = lens.lines(spark, sf_dir)
    wanted = rows.select("paper_id").distinct().selectExpr("paper_id", "5L AS lo", "2L AS hi")
    return dc.line_texts(wanted, rows, [])


@query(
    """WITH n AS (SELECT doc_id, text, greatest(length(text) - 1, 0) // 40 AS last FROM documents), c AS (SELECT doc_id, last, unnest(range(last + 1)) AS i, text FROM n)
  SELECT doc_id, md5(trim(string_agg(CASE WHEN i < last THEN ltrim(text[40 * i + 1:40 * i + 40]) ELSE trim(text[40 * i + 1:]) END, '' ORDER BY i))) AS text_md5 FROM c GROUP BY doc_id"""
)
def dehyphenate(spark, sf_dir):
    """Whole texts broken by hyphens into lines of forty letters, and joined again."""
    parts = F.regexp_extract_all("text", F.lit("(?s).{1,40}"), F.lit(0))
    lines = F.transform(F.array(parts), lambda held: F.transform(held, lambda x, i: F.when(i < F.size(held) - 1, F.concat(x, F.lit("-"))).otherwise(x)))[0]
    return lens.table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.join_lines(lines)).alias("text_md5"))


@query(f"WITH {LENS} SELECT d.doc_id AS paper_id, p.paragraph_id FROM documents d JOIN paragraphs p ON p.paper_id = d.doc_id AND p.start_line <= d.doc_id % 7 + 4 AND p.end_line >= d.doc_id % 7 + 1")
def line_to_paragraph_overlap(spark, sf_dir):
    wanted = lens.table(spark, sf_dir, "documents").selectExpr("doc_id AS paper_id", "doc_id % 7 + 1 AS lo", "doc_id % 7 + 4 AS hi")
    return dc.paragraphs_of_lines(wanted, lens.paragraphs(spark, sf_dir)).select("paper_id", "paragraph_id")


@query(f"WITH {LENS} SELECT DISTINCT p.paper_id, p.paragraph_id, s.number FROM paragraphs p JOIN sections s ON s.paper_id = p.paper_id AND s.start_line <= p.start_line AND p.end_line <= s.end_line")
def paragraph_sections(spark, sf_dir):
    return dc.paragraph_sections(lens.paragraphs(spark, sf_dir), lens.sections(spark, sf_dir))


@query(f"WITH {LENS} SELECT s.paper_id, s.number, a.number AS ancestor FROM sections s JOIN sections a ON a.paper_id = s.paper_id AND s.number LIKE a.number || '.%'")
def section_ancestors(spark, sf_dir):
    return dc.section_ancestors(lens.sections(spark, sf_dir)).select("paper_id", "number", "ancestor")


@query(
    f"""WITH {LENS}, inside AS (SELECT DISTINCT p.paper_id, p.paragraph_id, s.number FROM paragraphs p JOIN sections s ON s.paper_id = p.paper_id AND s.start_line <= p.start_line AND p.end_line <= s.end_line)
  SELECT DISTINCT d.doc_id AS paper_id, CAST(d.doc_id % 3 + 1 AS VARCHAR) AS gold, i.paragraph_id FROM documents d JOIN inside i ON i.paper_id = d.doc_id AND (i.number = CAST(d.doc_id % 3 + 1 AS VARCHAR) OR i.number LIKE (d.doc_id % 3 + 1) || '.%')"""
)
def section_tree_paragraphs(spark, sf_dir):
    wanted = lens.table(spark, sf_dir, "documents").selectExpr("doc_id AS paper_id", "CAST(doc_id % 3 + 1 AS STRING) AS gold")
    return dc.section_tree_paragraphs(wanted, lens.paragraphs(spark, sf_dir), lens.sections(spark, sf_dir))


_HEADS = ("Abstract", "1 Introduction", "1.1 Setup", "2 Method", "Appendix A", "Limitations")
_HEADED = f"""headed AS (SELECT paper_id, 2 * line_no AS line_no, text FROM lines UNION ALL SELECT paper_id, 2 * line_no - 1, [{", ".join(f"'{h}'" for h in _HEADS)}][line_no] FROM lines WHERE line_no <= {len(_HEADS)}),
  m AS (SELECT paper_id, line_no, trim(text) AS t, {", ".join(f"regexp_extract(trim(text), '{SECTION_HEADER}', {i}) AS {c}" for i, c in enumerate(("num", "name", "app", "app_name"), 1))} FROM headed),
  w AS (SELECT *, max(line_no) OVER p AS last_line, max(CASE WHEN num <> '' OR app <> '' THEN line_no END) OVER p AS last_head FROM m WINDOW p AS (PARTITION BY paper_id))"""


@query(
    f"""WITH {LENS}, {_HEADED}, heads AS (
  SELECT paper_id, CASE WHEN num <> '' THEN num WHEN app <> '' THEN 'Appendix ' || app ELSE replace(lower(t), ' ', '_') END AS number,
    CASE WHEN num <> '' THEN trim(name) WHEN app <> '' THEN coalesce(nullif(trim(app_name), ''), 'Appendix ' || app) ELSE t END AS name,
    CASE WHEN num <> '' THEN len(string_split(num, '.')) ELSE 1 END AS level, line_no AS start_line, last_line FROM w WHERE num <> '' OR app <> '' OR (regexp_matches(t, '{UNNUMBERED}') AND line_no > coalesce(last_head, -1))
  UNION ALL SELECT paper_id, '0', 'Abstract', 0, min(line_no), any_value(last_line) FROM w WHERE lower(t) = 'abstract' GROUP BY paper_id),
  cut AS (SELECT h.paper_id, h.number, h.name, h.level, h.start_line, h.last_line, min(o.start_line) AS next FROM heads h LEFT JOIN heads o ON o.paper_id = h.paper_id AND o.start_line > h.start_line AND o.level > 0 AND (h.level = 0 OR o.level <= h.level) GROUP BY ALL)
  SELECT paper_id, number, name, CAST(level AS BIGINT) AS level, start_line, CASE WHEN level = 0 THEN coalesce(next - 1, last_line) ELSE greatest(start_line, coalesce(next - 1, last_line)) END AS end_line FROM cut"""
)
def section_detect(spark, sf_dir):
    """Headings between the given lines of a text, found among all of them."""
    rows = lens.lines(spark, sf_dir)
    heads = rows.where(F.col("line_no") <= len(_HEADS)).select("paper_id", (2 * F.col("line_no") - 1).alias("line_no"), F.element_at(F.array(*map(F.lit, _HEADS)), F.col("line_no").cast("int")).alias("text"))
    return dc.sections_of(rows.withColumn("line_no", 2 * F.col("line_no")).unionByName(heads)).withColumn("level", F.col("level").cast("long"))


@query(
    f"""WITH {LENS}, k AS (SELECT paper_id, paragraph_id, CASE WHEN paragraph_id % 3 = 2 THEN -1 ELSE start_line END AS a, CASE WHEN paragraph_id % 3 = 2 THEN -1 ELSE end_line END AS b FROM paragraphs),
  g AS (SELECT *, lag(b) OVER (PARTITION BY paper_id ORDER BY paragraph_id) AS before, lead(a) OVER (PARTITION BY paper_id ORDER BY paragraph_id) AS after FROM k)
  SELECT paper_id, paragraph_id, CASE WHEN a = -1 AND after - before - 1 BETWEEN 1 AND 10 THEN before + 1 ELSE a END AS start_line, CASE WHEN a = -1 AND after - before - 1 BETWEEN 1 AND 10 THEN after - 1 ELSE b END AS end_line FROM g"""
)
def fill_gaps(spark, sf_dir):
    hole = F.col("paragraph_id") % 3 == 2
    rows = lens.paragraphs(spark, sf_dir).select("paper_id", "paragraph_id", F.when(hole, -1).otherwise(F.col("start_line")).cast("long").alias("start_line"), F.when(hole, -1).otherwise(F.col("end_line")).cast("long").alias("end_line"))
    return dc.filled_gaps(rows)


@query()
def align_paragraphs(spark, sf_dir):
    """Paragraphs found again among their paper's lines."""
    rows = lens.lines(spark, sf_dir)
    start = rows.select("paper_id").distinct().selectExpr("paper_id", "1L AS line")
    pars = lens.paragraphs(spark, sf_dir).select("paper_id", F.col("paragraph_id").cast("int").alias("paragraph_id"), "section", "text")
    return dc.aligned(pars, rows, start, lambda a, b: fuzzy.best_window(a, b, 90))


@query(
    f"""WITH {LENS} SELECT paper_id, name, number, min(paragraph_id) AS start_paragraph, max(paragraph_id) AS end_paragraph, max(p.end_line) AS end_line
  FROM sections s JOIN (SELECT paper_id, paragraph_id, end_line, concat('Part ', (paragraph_id - 1) // 2 + 1) AS name FROM paragraphs) p USING (paper_id, name) GROUP BY ALL"""
)
def sections_with_paragraphs(spark, sf_dir):
    top = lens.sections(spark, sf_dir).where("level = 1")
    return dc.with_paragraphs(top, lens.paragraphs(spark, sf_dir)).select("paper_id", "name", "number", "start_paragraph", "end_paragraph", "end_line")


_TOP = "top AS (SELECT paper_id, number, name, min(paragraph_id) AS a, max(paragraph_id) AS b FROM (SELECT s.paper_id, s.number, s.name, paragraph_id FROM sections s JOIN paragraphs p ON p.paper_id = s.paper_id AND concat('Part ', (p.paragraph_id - 1) // 2 + 1) = s.name) GROUP BY ALL)"
_SECTION_TEXT = f"""{_TOP}, st AS (SELECT t.paper_id, t.number, t.name, string_agg(p.text, ' ' ORDER BY p.paragraph_id) AS text FROM top t JOIN paragraphs p ON p.paper_id = t.paper_id AND p.paragraph_id BETWEEN t.a AND t.b GROUP BY ALL)"""


@query(f"WITH {LENS}, {_SECTION_TEXT} SELECT paper_id, number, text FROM st")
def section_texts(spark, sf_dir):
    pars = lens.paragraphs(spark, sf_dir)
    top = dc.with_paragraphs(lens.sections(spark, sf_dir).where("level = 1"), pars)
    return dc.section_text(top.select("paper_id", "number"), top, pars, lens.lines(spark, sf_dir))


@query(
    f"""WITH {LENS}, {_SECTION_TEXT}, pool AS (
  SELECT paper_id, 'Paragraph ' || paragraph_id AS cand_id, 'line' AS ctype, text FROM paragraphs
  UNION ALL SELECT paper_id, 'Section ' || number || ' / ' || name, 'section', text FROM st
  UNION ALL SELECT doc_id, 'Figure ' || (doc_id % 3 + 1), 'figure', source || ' over ' || lang FROM documents)
  SELECT paper_id, cand_id, ctype, md5(trim(text)) AS text_md5 FROM pool WHERE trim(text) <> ''"""
)
def candidate_pool(spark, sf_dir):
    pars = lens.paragraphs(spark, sf_dir)
    top = dc.with_paragraphs(lens.sections(spark, sf_dir).where("level = 1"), pars)
    figures = lens.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.lit("Figure").alias("figType"), (F.col("doc_id") % 3 + 1).cast("string").alias("name"), F.concat("source", F.lit(" over "), "lang").alias("caption"))
    pool = dc.candidates(lens.lines(spark, sf_dir), pars, top, dc.captions_of(figures), with_lines=False)
    return pool.select("paper_id", "cand_id", "ctype", F.md5("text").alias("text_md5"))


_BM25 = r"""tok AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f]+'), lambda x: x <> '')) AS term FROM documents),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
  dl AS (SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f]+'), lambda x: x <> '')) AS l FROM documents),
  size AS (SELECT count(*) AS n, avg(l) AS avg_l FROM dl),
  idf0 AS (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, size GROUP BY term, n),
  idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf0) ELSE idf END AS idf FROM idf0),
  q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f]+'), lambda x: x <> '')) AS term FROM benchmark) GROUP BY ALL),
  score AS (SELECT item_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / avg_l))) AS s FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), size GROUP BY ALL),
  ranking AS (SELECT item_id, doc_id, s, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 6) DESC, doc_id) AS rank FROM score)"""


def _bm25(spark, sf_dir):
    docs = lens.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cand_id"), F.col("doc_id").alias("ord"), "text")
    held = postings.count_terms(docs, [])
    return docs, held, ranking.bm25(lens.table(spark, sf_dir, "benchmark"), held, [], ["item_id"]).withColumn("score", F.round("score", 6))


@query(f"WITH {_BM25} SELECT item_id, doc_id, rank, round(s, 6) AS score FROM ranking WHERE rank <= 10")
def bm25_rank_top10(spark, sf_dir):
    top = ranking.top_k(ranking.ranked(_bm25(spark, sf_dir)[2], ["item_id"], unique=True), 10)
    return top.select("item_id", F.col("cand_id").alias("doc_id"), F.col("rank").cast("long").alias("rank"), "score")


@query(
    f"""WITH {_BM25}, gold AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
  r AS (SELECT g.item_id, rank FROM gold g LEFT JOIN ranking k ON k.item_id = g.item_id AND k.doc_id = g.doc_id),
  per AS (SELECT item_id, avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END) AS recall_1, avg(CASE WHEN rank <= 2 THEN 1.0 ELSE 0 END) AS recall_2, avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END) AS recall_10, coalesce(max(1.0 / rank), 0) AS rr FROM r GROUP BY item_id)
  SELECT count(*) AS n, round(avg(recall_1), 6) AS recall_1, round(avg(recall_2), 6) AS recall_2, round(avg(recall_10), 6) AS recall_10, round(avg(rr), 6) AS rr FROM per"""
)
def bm25_recall_mrr(spark, sf_dir):
    """Retrieval of benchmark passages: the documents that hold a passage are its gold."""
    docs, held, scores = _bm25(spark, sf_dir)
    gold = saved(ranking.holding(docs, lens.table(spark, sf_dir, "benchmark"), "item_id", held), "gold")
    scores = saved(scores, "scores").join(gold.withColumn("gold", F.lit(True)), ["item_id", "cand_id"], "left").withColumn("gold", F.coalesce("gold", F.lit(False)))
    slots = gold.select("item_id", F.col("cand_id").alias("slot"), F.col("cand_id").alias("unit"))
    scores = metrics.query_scores(metrics.slot_ranks(ranking.decisive(scores, ["item_id"], 10), slots, ["item_id"]), ["item_id"], [1, 2, 10])
    return metrics.means(scores, [], ["recall_1", "recall_2", "recall_10", "rr"])


_SPARSE = r"""tok AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f]+'), lambda x: x <> '')) AS term FROM documents),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  d AS (SELECT doc_id, term, ln(1 + tf) * ln(1 + (SELECT count(*) FROM documents) / df) AS w FROM tf JOIN df USING (term)),
  q AS (SELECT item_id, term, ln(1 + count(*)) AS w FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f]+'), lambda x: x <> '')) AS term FROM benchmark) GROUP BY ALL),
  ranking AS (SELECT item_id, doc_id, round(sum(q.w * d.w), 9) AS s, row_number() OVER (PARTITION BY item_id ORDER BY round(sum(q.w * d.w), 9) DESC, doc_id) AS rank FROM q JOIN d USING (term) GROUP BY item_id, doc_id)"""


@query(f"WITH {_SPARSE} SELECT item_id, doc_id, rank, round(s, 6) AS score FROM ranking WHERE rank <= 10")
def sparse_top10(spark, sf_dir):
    """Documents and benchmark passages as sparse vectors of term weights, ranked by dot product."""
    docs = lens.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cand_id"), F.col("doc_id").alias("ord"), "text")
    asked = lens.table(spark, sf_dir, "benchmark").select("item_id", F.explode(ranking.terms(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.log1p(F.count("*")).alias("weight"))
    held, asked = postings.count_vectors(docs), saved(asked, "asked")
    held = held.withColumn("weights", F.transform("counts", F.log1p))
    top = postings.vector_top(asked.join(postings.rarity(asked, held), "term"), held, ["item_id"], 10)
    return top.select("item_id", F.col("cand_id").alias("doc_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


_DENSE = """c AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), q AS (SELECT * FROM c WHERE vec_id % 100 = 0),
  ranking AS (SELECT q.vec_id, c.vec_id AS cand_id, q.label AS ql, c.label AS cl, round(list_dot_product(q.v, c.v), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.v, c.v), 6) DESC, c.vec_id) AS rank FROM q, c WHERE q.vec_id <> c.vec_id)"""


def _dense(spark, sf_dir):
    rows = lens.table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 100 = 0").select("vec_id", F.col("label").alias("gold_label"), F.col("embedding").alias("qvec"))
    return asked, rows.select(F.col("vec_id").alias("cand_id"), F.col("vec_id").alias("ord"), "label", F.col("embedding").alias("vec"))


@query(f"WITH {_DENSE} SELECT vec_id, cand_id, rank, score FROM ranking WHERE rank <= 10")
def dense_cosine_top10(spark, sf_dir):
    top = vectors.top(*_dense(spark, sf_dir), ["vec_id"], 10, skip="vec_id", digits=6)
    return top.select("vec_id", "cand_id", F.col("rank").cast("long").alias("rank"), "score")


@query(f"WITH {_DENSE}, per AS (SELECT vec_id, max(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END) AS hit_1, max(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END) AS hit_10, coalesce(max(1.0 / rank), 0) AS rr FROM ranking WHERE ql = cl GROUP BY vec_id) SELECT count(*) AS n, round(avg(hit_1), 6) AS hit_1, round(avg(hit_10), 6) AS hit_10, round(avg(rr), 6) AS rr FROM per")
def dense_recall_mrr(spark, sf_dir):
    asked, there = _dense(spark, sf_dir)
    first = vectors.first_ranks(asked, there, ["vec_id"], ("label", "gold_label"), skip="vec_id", digits=6)
    return metrics.means(metrics.query_scores(first, ["vec_id"], [1, 10]), [], ["hit_1", "hit_10", "rr"])


@query(
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), m AS (SELECT vec_id, [e[1:16], e[17:32], e[33:48], e[49:64]] AS parts FROM v),
  pairs AS (SELECT q.vec_id, c.vec_id AS cand_id, round(list_sum(list_transform(q.parts, lambda a: list_max(list_transform(c.parts, lambda b: list_dot_product(a, b))))), 6) AS score FROM m q, m c WHERE q.vec_id % 100 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cand_id) AS rank FROM pairs) SELECT vec_id, cand_id, score, rank FROM r WHERE rank <= 5"""
)
def maxsim_rank(spark, sf_dir):
    """Late interaction over vectors cut into four parts."""
    parts = F.array(*(F.slice("embedding", i, 16) for i in (1, 17, 33, 49)))
    rows = lens.table(spark, sf_dir, "embeddings").select("vec_id", parts.alias("parts"))
    asked = rows.where("vec_id % 100 = 0").select("vec_id", F.col("parts").alias("qvec"))
    top = vectors.top(asked, rows.select(F.col("vec_id").alias("cand_id"), F.col("vec_id").alias("ord"), F.col("parts").alias("vec")), ["vec_id"], 5, digits=6)
    return top.select("vec_id", "cand_id", "score", F.col("rank").cast("long").alias("rank"))


@query("SELECT doc_id, text FROM documents WHERE doc_id % 3 <> 0")
def resume_anti_join(spark, sf_dir):
    docs = lens.table(spark, sf_dir, "documents").select("doc_id", "text")
    return io.remaining(docs, docs.where("doc_id % 3 = 0"), ["doc_id"])


@query("SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def shared_semi_join(spark, sf_dir):
    return lens.table(spark, sf_dir, "documents").select("doc_id", "text").join(lens.table(spark, sf_dir, "labels"), "doc_id", "left_semi")


@query("SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'good' ELSE d.source END AS note FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_merge_annotations(spark, sf_dir):
    rows = lens.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("note"))
    known = lens.table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("note"))
    return io.with_annotations(rows, known, ["doc_id"], "note", ["good"])


@query("SELECT doc_id FROM documents WHERE lang = 'en' UNION SELECT doc_id FROM labels")
def set_union(spark, sf_dir):
    return lens.table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id").union(lens.table(spark, sf_dir, "labels").select("doc_id")).distinct()


@query("SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels")
def set_intersect(spark, sf_dir):
    return lens.table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id").intersect(lens.table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM labels")
def set_except(spark, sf_dir):
    return lens.table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id").exceptAll(lens.table(spark, sf_dir, "labels").select("doc_id")).distinct()


@query("SELECT l_suppkey, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 3")
def topk_per_group(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"))
    rows = lens.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return ranking.top_k(rows.withColumn("rank", place), 3).select("l_suppkey", "l_orderkey", "l_linenumber", F.col("rank").cast("long").alias("rank"))
