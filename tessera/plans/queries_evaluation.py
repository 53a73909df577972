"""Queries over retrieval metrics, label metrics, statistics and sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import documents as dc
from ..operators import metrics, ranking, sampling
from . import construct, lens
from .lens import LENS

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


# A ranking of each paper's sections: by an md5 order; gold is section doc_id % 3 + 1, sub 1.
_EVAL = f"""WITH {LENS}, ranked AS (SELECT paper_id, number, row_number() OVER (PARTITION BY paper_id ORDER BY md5(paper_id || ':' || number), number) AS rank FROM sections),
  gold AS (SELECT doc_id AS paper_id, (doc_id % 3 + 1) || '.1' AS number FROM documents WHERE EXISTS (SELECT 1 FROM sections s WHERE s.paper_id = doc_id AND s.number = (doc_id % 3 + 1) || '.1'))"""


def _section_ranking(spark, sf_dir):
    sections = lens.sections(spark, sf_dir)
    scores = sections.select("paper_id", F.col("number").alias("cand_id"), F.col("number").alias("ord"), F.md5(F.concat(F.col("paper_id").cast("string"), F.lit(":"), "number")).alias("key"))
    # the md5 order, descending scores: rank by key ascending
    return sections, scores.withColumn("rank", F.row_number().over(Window.partitionBy("paper_id").orderBy("key", "ord")))


def _section_gold(sections, spark, sf_dir):
    gold = lens.table(spark, sf_dir, "documents").selectExpr("doc_id AS paper_id", "concat(doc_id % 3 + 1, '.1') AS number")
    return gold.join(sections.select("paper_id", "number"), ["paper_id", "number"], "left_semi")


def _averaged(spark, ranks, names):
    scores = metrics.query_scores(ranks, ["mode", "paper_id"], [1, 2])
    return metrics.means(scores, ["mode"], ["hit_1", "recall_1", "hit_2", "recall_2", "rr"]).select("mode", "n", *names)


_MEANS = "SELECT mode, count(*) AS n, round(avg(h1), 6) AS hit_1, round(avg(h2), 6) AS hit_2, round(avg(rr), 6) AS rr FROM per GROUP BY mode"


@query(
    _EVAL
    + f""", slots AS (SELECT 'corrected_exact' AS mode, paper_id, number AS unit FROM gold UNION ALL SELECT 'ancestor_relaxed', paper_id, number FROM gold UNION ALL SELECT 'ancestor_relaxed', paper_id, string_split(number, '.')[1] FROM gold
    UNION ALL SELECT 'legacy_exact', paper_id, 'Section ' || number FROM gold),
  per AS (SELECT mode, s.paper_id, max(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END) AS h1, max(CASE WHEN rank <= 2 THEN 1.0 ELSE 0 END) AS h2, coalesce(max(1.0 / rank), 0) AS rr FROM slots s LEFT JOIN ranked r ON r.paper_id = s.paper_id AND r.number = s.unit GROUP BY mode, s.paper_id)
  {_MEANS}"""
)
def eval_ancestor_modes(spark, sf_dir):
    """Exact ids as written, canonical ids, and canonical ids with credit for ancestors."""
    sections, ranks = _section_ranking(spark, sf_dir)
    gold = _section_gold(sections, spark, sf_dir)
    units = F.create_map(
        F.lit("legacy_exact"), F.array(F.concat(F.lit("Section "), "number")), F.lit("corrected_exact"), F.array("number"), F.lit("ancestor_relaxed"), F.concat(F.array("number"), dc.ancestors(F.col("number")))
    )
    slots = gold.select("paper_id", F.explode(units).alias("mode", "units")).select("mode", "paper_id", F.lit(0).alias("slot"), F.explode("units").alias("unit"))
    modes = ranks.crossJoin(F.broadcast(spark.createDataFrame([("legacy_exact",), ("corrected_exact",), ("ancestor_relaxed",)], "mode string")))  # three rows
    return _averaged(spark, metrics.slot_ranks(modes, slots, ["mode", "paper_id"]), ["hit_1", "hit_2", "rr"])


@query(
    _EVAL
    + f""", pool AS (SELECT paper_id, number, row_number() OVER (PARTITION BY paper_id ORDER BY rank) AS rank FROM ranked WHERE number LIKE '%.%'),
  per AS (SELECT 'oracle' AS mode, g.paper_id, max(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END) AS h1, max(CASE WHEN rank <= 2 THEN 1.0 ELSE 0 END) AS h2, coalesce(max(1.0 / rank), 0) AS rr FROM gold g LEFT JOIN pool p ON p.paper_id = g.paper_id AND p.number = g.number GROUP BY g.paper_id)
  {_MEANS}"""
)
def eval_oracle_section(spark, sf_dir):
    """Only subsections compete, re-ranked among themselves."""
    sections, ranks = _section_ranking(spark, sf_dir)
    pool = ranks.where(F.col("cand_id").contains(".")).withColumn("rank", F.row_number().over(Window.partitionBy("paper_id").orderBy("rank"))).withColumn("mode", F.lit("oracle"))
    slots = _section_gold(sections, spark, sf_dir).select(F.lit("oracle").alias("mode"), "paper_id", F.lit(0).alias("slot"), F.col("number").alias("unit"))
    return _averaged(spark, metrics.slot_ranks(pool, slots, ["mode", "paper_id"]), ["hit_1", "hit_2", "rr"])


@query(
    _EVAL
    + f""", l AS (SELECT doc_id AS paper_id, doc_id % 4 + 1 AS line_no FROM documents),
  units AS (SELECT 'exact' AS mode, paper_id, NULL AS unit FROM l UNION ALL SELECT 'container', l.paper_id, s.number FROM l LEFT JOIN sections s ON s.paper_id = l.paper_id AND l.line_no BETWEEN s.start_line AND s.end_line),
  per AS (SELECT mode, u.paper_id, max(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END) AS h1, max(CASE WHEN rank <= 2 THEN 1.0 ELSE 0 END) AS h2, coalesce(max(1.0 / rank), 0) AS rr FROM units u LEFT JOIN ranked r ON r.paper_id = u.paper_id AND r.number = u.unit GROUP BY mode, u.paper_id)
  {_MEANS}"""
)
def eval_section_container(spark, sf_dir):
    """Line gold: sections that contain the line are credited; exact keeps an empty slot, so both count the same queries."""
    sections, ranks = _section_ranking(spark, sf_dir)
    line = lens.table(spark, sf_dir, "documents").selectExpr("doc_id AS paper_id", "doc_id % 4 + 1 AS line_no")
    held = line.join(sections.select("paper_id", "number", "start_line", "end_line"), "paper_id").where("line_no between start_line and end_line").select("paper_id", "number")
    container = line.select("paper_id").join(held, "paper_id", "left").select(F.lit("container").alias("mode"), "paper_id", F.lit(0).alias("slot"), F.col("number").alias("unit"))
    exact = line.select(F.lit("exact").alias("mode"), "paper_id", F.lit(0).alias("slot"), F.lit(None).cast("string").alias("unit"))
    modes = ranks.withColumn("mode", F.explode(F.array(F.lit("exact"), F.lit("container"))))
    return _averaged(spark, metrics.slot_ranks(modes, exact.unionByName(container), ["mode", "paper_id"]), ["hit_1", "hit_2", "rr"])


@query(
    f"""WITH {LENS}, ranked AS (SELECT paper_id, paragraph_id, row_number() OVER (PARTITION BY paper_id ORDER BY md5(paper_id || ':' || paragraph_id), paragraph_id) AS rank FROM paragraphs),
  gold AS (SELECT DISTINCT d.doc_id AS paper_id, p.paragraph_id FROM documents d JOIN sections s ON s.paper_id = d.doc_id AND (s.number = '1' OR s.number LIKE '1.%') JOIN paragraphs p ON p.paper_id = d.doc_id AND s.start_line <= p.start_line AND p.end_line <= s.end_line),
  per AS (SELECT 'descendant' AS mode, g.paper_id, avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END) AS r1, avg(CASE WHEN rank <= 2 THEN 1.0 ELSE 0 END) AS r2, max(1.0 / rank) AS rr FROM gold g JOIN ranked r ON r.paper_id = g.paper_id AND r.paragraph_id = g.paragraph_id GROUP BY g.paper_id)
  SELECT mode, count(*) AS n, round(avg(r1), 6) AS recall_1, round(avg(r2), 6) AS recall_2, round(avg(rr), 6) AS rr FROM per GROUP BY mode"""
)
def eval_paragraph_descendant(spark, sf_dir):
    """Section gold over a paragraph pool: each paragraph under the section is a slot."""
    pars, sections = lens.paragraphs(spark, sf_dir), lens.sections(spark, sf_dir)
    key = F.md5(F.concat(F.col("paper_id").cast("string"), F.lit(":"), F.col("paragraph_id").cast("string")))
    ranks = pars.select("paper_id", F.col("paragraph_id").alias("cand_id"), F.row_number().over(Window.partitionBy("paper_id").orderBy(key, "paragraph_id")).alias("rank")).withColumn("mode", F.lit("descendant"))
    wanted = lens.table(spark, sf_dir, "documents").selectExpr("doc_id AS paper_id", "'1' AS gold")
    slots = dc.section_tree_paragraphs(wanted, pars, sections).select(F.lit("descendant").alias("mode"), "paper_id", F.col("paragraph_id").alias("slot"), F.col("paragraph_id").alias("unit"))
    return _averaged(spark, metrics.slot_ranks(ranks, slots, ["mode", "paper_id"]), ["recall_1", "recall_2", "rr"])


@query(
    f"""WITH {LENS}, pool AS (SELECT paper_id, number AS cand_id, CASE WHEN level = 1 THEN 'section' ELSE 'line' END AS ctype FROM sections),
  base AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY md5(paper_id || ':' || cand_id), cand_id) AS rank FROM pool),
  kept AS (SELECT paper_id, cand_id, row_number() OVER (PARTITION BY paper_id ORDER BY rank) AS rank FROM base WHERE ctype = CASE WHEN paper_id % 2 = 0 THEN 'section' ELSE 'line' END),
  both_modes AS (SELECT 'baseline' AS mode, paper_id, cand_id, rank FROM base UNION ALL SELECT 'filtered', paper_id, cand_id, rank FROM kept),
  g AS (SELECT 'baseline' AS mode, doc_id AS paper_id FROM documents UNION ALL SELECT 'filtered', doc_id FROM documents),
  per AS (SELECT g.mode, g.paper_id, max(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END) AS h1, max(CASE WHEN rank <= 2 THEN 1.0 ELSE 0 END) AS h2, coalesce(max(1.0 / rank), 0) AS rr FROM g LEFT JOIN both_modes b ON b.mode = g.mode AND b.paper_id = g.paper_id AND b.cand_id = '1' GROUP BY g.mode, g.paper_id)
  {_MEANS}"""
)
def eval_type_filtered(spark, sf_dir):
    """A ranking as it is, and with only candidates of the predicted type, ranked anew; gold is section 1."""
    sections, ranks = _section_ranking(spark, sf_dir)
    typed = ranks.withColumn("ctype", F.when(F.col("cand_id").contains("."), "line").otherwise("section"))
    predicted = F.when(F.col("paper_id") % 2 == 0, "section").otherwise("line")
    kept = typed.where(F.col("ctype") == predicted).withColumn("rank", F.row_number().over(Window.partitionBy("paper_id").orderBy("rank")))
    both = typed.withColumn("mode", F.lit("baseline")).unionByName(kept.withColumn("mode", F.lit("filtered")))
    slots = lens.table(spark, sf_dir, "documents").select(F.explode(F.array(F.lit("baseline"), F.lit("filtered"))).alias("mode"), F.col("doc_id").alias("paper_id"), F.lit(0).alias("slot"), F.lit("1").alias("unit"))
    return _averaged(spark, metrics.slot_ranks(both, slots, ["mode", "paper_id"]), ["hit_1", "hit_2", "rr"])


_LABELLED = """d AS (SELECT doc_id, quality = 1 AS gq, toxic = 1 AS gt, n_chars > 300 AS pq, doc_id % 5 = 0 AS pt FROM labels JOIN documents USING (doc_id)),
  e AS (SELECT 'quality' AS label, gq AS g, pq AS p FROM d UNION ALL SELECT 'toxic', gt, pt FROM d),
  c AS (SELECT label, count(*) FILTER (g AND p) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (g AND NOT p) AS fn FROM e GROUP BY label)"""


def _labelled(spark, sf_dir):
    rows = lens.table(spark, sf_dir, "labels").join(lens.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    some = lambda *pairs: F.filter(F.array(*(F.when(c, x) for x, c in pairs)), lambda v: v.isNotNull())
    return rows.select("doc_id", some(("quality", F.col("quality") == 1), ("toxic", F.col("toxic") == 1)).alias("gold"), some(("quality", F.col("n_chars") > 300), ("toxic", F.col("doc_id") % 5 == 0)).alias("prediction"))


@query(
    f"""WITH {_LABELLED}, a AS (SELECT label, tp, fp, fn FROM c UNION ALL SELECT 'micro', sum(tp), sum(fp), sum(fn) FROM c),
  s AS (SELECT label, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM a)
  SELECT label, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM s
  UNION ALL SELECT 'macro', 0, 0, 0, 0.0, 0.0, round(avg(f1), 6) FROM s WHERE label <> 'micro'"""
)
def multilabel_metrics(spark, sf_dir):
    return metrics.label_report(_labelled(spark, sf_dir), ["quality", "toxic"])


@query(
    f"""WITH {_LABELLED}, x AS (SELECT doc_id, list_filter([CASE WHEN gq THEN 'q' END, CASE WHEN gt THEN 't' END], lambda v: v IS NOT NULL) AS g, list_filter([CASE WHEN pq THEN 'q' END, CASE WHEN pt THEN 't' END], lambda v: v IS NOT NULL) AS p FROM d)
  SELECT count(*) AS n, round(avg(CASE WHEN g = p THEN 1 ELSE 0 END), 6) AS set_accuracy, count(*) FILTER (len(p) = 0) AS empty_predictions, round(avg(len(g)), 6) AS mean_gold, round(avg(len(p)), 6) AS mean_predicted FROM x"""
)
def label_set_summary(spark, sf_dir):
    return metrics.set_summary(_labelled(spark, sf_dir))


@query(
    """WITH p AS (SELECT quality = 1 AS g, ((doc_id * 7919) % 1000 + quality * 300) / 1300.0 AS p FROM labels), t AS (SELECT CAST(round(0.1 + 0.02 * i, 2) AS DOUBLE) AS threshold FROM range(41) r(i)),
  c AS (SELECT threshold, count(*) FILTER (g AND p >= threshold) AS tp, count(*) FILTER (NOT g AND p >= threshold) AS fp, count(*) FILTER (g AND NOT p >= threshold) AS fn FROM p, t GROUP BY threshold)
  SELECT threshold, tp, fp, fn FROM c"""
)
def threshold_sweep(spark, sf_dir):
    rows = lens.table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, F.array(F.lit("quality"))).otherwise(F.array().cast("array<string>")).alias("gold"), F.create_map(F.lit("quality"), ((F.col("doc_id") * 7919) % 1000 + F.col("quality") * 300) / 1300.0).alias("probabilities"))
    return metrics.threshold_counts(rows, ["quality"]).select("threshold", "tp", "fp", "fn")


@query(
    """WITH p AS (SELECT quality = 1 AS g, ((doc_id * 7919) % 1000 + quality * 300) / 1300.0 AS p FROM labels), t AS (SELECT CAST(round(0.1 + 0.02 * i, 2) AS DOUBLE) AS threshold FROM range(41) r(i)),
  c AS (SELECT threshold, count(*) FILTER (g AND p >= threshold) AS tp, count(*) FILTER (NOT g AND p >= threshold) AS fp, count(*) FILTER (g AND NOT p >= threshold) AS fn FROM p, t GROUP BY threshold)
  SELECT threshold, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM c ORDER BY f1 DESC, round(abs(threshold - 0.5), 6), threshold LIMIT 1"""
)
def threshold_best(spark, sf_dir):
    return metrics.best_thresholds(threshold_sweep(spark, sf_dir).withColumn("label", F.lit("quality")))


@query(
    """WITH u AS (SELECT DISTINCT l_orderkey, l_returnflag AS type, l_partkey FROM lineitem), n AS (SELECT l_orderkey, type, count(*) AS n FROM u GROUP BY ALL),
  c AS (SELECT l_orderkey, string_agg(CASE WHEN n > 1 THEN n || ' ' || type ELSE type END, ' + ' ORDER BY type) AS combination FROM n GROUP BY l_orderkey) SELECT combination, count(*) AS n FROM c GROUP BY combination"""
)
def evidence_combinations(spark, sf_dir):
    units = lens.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("type"), F.col("l_partkey").alias("label"))
    return metrics.combinations(units, ["l_orderkey"])


@query(
    """WITH notes AS (SELECT conv_id AS paper_id, turn AS note_id, CASE WHEN turn > 0 THEN turn - 1 END AS replyto, CASE WHEN turn % 2 = 0 THEN 'Reviewer' ELSE 'Authors' END AS r FROM conversations),
  s AS (SELECT conv_id AS paper_id, turn AS note_id, lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))) AS n FROM conversations WHERE turn % 2 = 0),
  q AS (SELECT DISTINCT conv_id AS paper_id, lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))) AS q FROM conversations WHERE turn % 4 = 0),
  m AS (SELECT s.*, EXISTS (SELECT 1 FROM q WHERE q.paper_id = s.paper_id AND q.q <> '' AND (contains(s.n, q.q) OR contains(q.q, s.n))) AS i, EXISTS (SELECT 1 FROM notes r WHERE r.paper_id = s.paper_id AND r.replyto = s.note_id AND r.r = 'Authors') AS a FROM s WHERE n <> ''),
  c AS (SELECT count(*) AS spans, count(*) FILTER (a) AS answered, count(*) FILTER (i) AS included, count(*) FILTER (i AND a) AS included_answered, count(*) FILTER (a AND NOT i) AS excluded_answered FROM m)
  SELECT *, round(100 * included / nullif(spans, 0), 6) AS included_pct, round(100 * answered / nullif(spans, 0), 6) AS answered_pct FROM c"""
)
def coverage_report(spark, sf_dir):
    conversations = lens.table(spark, sf_dir, "conversations")
    fields = conversations.where("turn % 2 = 0").selectExpr("conv_id AS paper_id", "turn AS note_id", "text")
    retained = conversations.where("turn % 4 = 0").select(F.col("conv_id").alias("paper_id"), F.col("text").alias("query"))
    report = construct.coverage(lens.notes(spark, sf_dir), retained, fields)
    return report.select("spans", "answered", "included", "included_answered", "excluded_answered", "included_pct", "answered_pct")


@query(
    """WITH c AS (SELECT event_type, count(*) FILTER (user_id % 2 = 0) AS a, count(*) FILTER (user_id % 2 = 1) AS b FROM events GROUP BY event_type), t AS (SELECT sum(a) AS ta, sum(b) AS tb FROM c)
  SELECT event_type, a AS even, b AS odd, round(100 * a / ta, 6) AS even_pct, round(100 * b / tb, 6) AS odd_pct, round(round(100 * a / ta, 6) - round(100 * b / tb, 6), 6) AS pp_difference FROM c, t"""
)
def taxonomy_pivot(spark, sf_dir):
    rows = lens.table(spark, sf_dir, "events").select("event_type", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("half"))
    return sampling.share_pivot(rows, "event_type", "half", ["even", "odd"])


_SPLIT = """r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':42'), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents),
  s AS (SELECT doc_id, lang, CASE WHEN k <= round_even(n * 0.7, 0) THEN 'train' WHEN k <= round_even(n * 0.7, 0) + round_even(n * 0.15, 0) THEN 'dev' ELSE 'test' END AS split FROM r)"""


@query(f"WITH {_SPLIT} SELECT doc_id, lang, split FROM s")
def stratified_split(spark, sf_dir):
    return sampling.stratified(lens.table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query(f"WITH {_SPLIT} SELECT lang, split, count(*) AS n FROM s GROUP BY lang, split")
def split_histogram(spark, sf_dir):
    return stratified_split(spark, sf_dir).groupBy("lang", "split").agg(F.count("*").alias("n"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || ':17'), doc_id) AS k FROM documents) WHERE k <= 5")
def seeded_sample(spark, sf_dir):
    return sampling.sample(lens.table(spark, sf_dir, "documents").select("source", "doc_id"), 5, "doc_id", "17", ["source"])


@query("SELECT lang, source, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM documents GROUP BY GROUPING SETS ((lang, source), (lang))")
def venue_grouping_sets(spark, sf_dir):
    rows = lens.table(spark, sf_dir, "documents").withColumn("mean_chars", F.col("n_chars").cast("double"))
    return metrics.means(rows, ["lang", "source"], ["mean_chars"], overall=["lang"])


@query(
    """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
  p AS (SELECT a.label, greatest(list_cosine_similarity(a.v, b.v), 0) AS s FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
  SELECT label, count(*) AS n, round(avg(s), 6) AS mean_cosine FROM p GROUP BY GROUPING SETS ((label), ())"""
)
def similarity_stats(spark, sf_dir):
    """Mean cosine of neighbours by label and over all; negative values count as 0."""
    rows = lens.table(spark, sf_dir, "embeddings")
    nxt = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("vec"))
    pairs = ranking.dense(rows.select("vec_id", "label", F.col("embedding").alias("qvec")), nxt, ["vec_id"], normalize=True)
    return metrics.means(pairs.withColumn("mean_cosine", F.greatest("score", F.lit(0.0))), ["label"], ["mean_cosine"], overall=[])


@query("WITH s AS (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS d FROM documents) SELECT doc_id, n_chars FROM documents, s WHERE abs(n_chars - m) <= 4 * d")
def length_outliers_removed(spark, sf_dir):
    return metrics.without_outliers(lens.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars")
