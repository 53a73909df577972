"""Queries over text operators: references, labels, sentences, threads, filters, model answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.sentences import sentences
from ..operators import fuzzy, intervals, providers, threads
from ..sources import io
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


_FOUND = f"""WITH {LENS}, found AS (
  SELECT doc_id, text AS t, 'section' AS kind, regexp_extract(text, 'Section \\d+\\.\\d+') AS mention FROM referring
  UNION ALL SELECT doc_id, text, 'table', regexp_extract(text, 'Tables \\d+-\\d+') FROM referring
  UNION ALL SELECT doc_id, text, 'line', regexp_extract(text, 'lines \\d+-\\d+') FROM referring)"""


@query(_FOUND + " SELECT doc_id, kind, mention, CAST(instr(t, mention) - 1 AS BIGINT) AS start_at, CAST(instr(t, mention) - 1 + length(mention) AS BIGINT) AS end_at FROM found")
def mentions_with_offsets(spark, sf_dir):
    rows = lens.referring(spark, sf_dir).select("doc_id", F.explode_outer(tx.mentions(F.col("text"))).alias("m")).where("m IS NOT NULL")  # outer: references are found once
    return rows.select("doc_id", F.col("m.kind").alias("kind"), F.col("m.text").alias("mention"), F.col("m.start").cast("long").alias("start_at"), F.col("m.end").cast("long").alias("end_at"))


@query(_FOUND + " SELECT kind, count(*) AS n, count(DISTINCT mention) AS n_different FROM found GROUP BY kind")
def mentions_by_kind(spark, sf_dir):
    rows = lens.referring(spark, sf_dir).select(F.explode(tx.mentions_by_kind(F.col("text"))).alias("kind", "texts")).select("kind", F.explode("texts").alias("t"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("t").alias("n_different"))


@query(
    _FOUND
    + """ SELECT doc_id, 'Section' AS type, regexp_extract(mention, '[0-9.]+') AS label FROM found WHERE kind = 'section'
  UNION ALL SELECT doc_id, 'Table', CAST(unnest(generate_series(CAST(regexp_extract(mention, '(\\d+)-', 1) AS BIGINT), CAST(regexp_extract(mention, '-(\\d+)', 1) AS BIGINT))) AS VARCHAR) FROM found WHERE kind = 'table'
  UNION ALL SELECT doc_id, 'Line', regexp_extract(mention, '\\d+-\\d+') FROM found WHERE kind = 'line'"""
)
def normalize_refs(spark, sf_dir):
    rows = lens.referring(spark, sf_dir).select("doc_id", F.explode(tx.references(F.col("text"))).alias("r"))
    return rows.select("doc_id", "r.type", "r.label")


@query(
    """WITH l AS (SELECT doc_id, doc_id % 6 AS a, doc_id % 6 + doc_id % 4 AS b, doc_id % 3 AS k FROM documents)
  SELECT doc_id, CAST(unnest(generate_series(a, b)) AS VARCHAR) AS label FROM l WHERE k = 0
  UNION ALL SELECT doc_id, concat('4.', unnest(generate_series(a, b))) FROM l WHERE k = 1
  UNION ALL SELECT doc_id, concat(a, 'A-', b, 'C') FROM l WHERE k = 2"""
)
def expand_ranges(spark, sf_dir):
    rows = lens.table(spark, sf_dir, "documents").selectExpr("doc_id", "doc_id % 6 AS a", "doc_id % 6 + doc_id % 4 AS b", "doc_id % 3 AS k")
    label = F.when(F.col("k") == 0, F.concat("a", F.lit("-"), "b")).when(F.col("k") == 1, F.concat(F.lit("4."), "a", F.lit("–4."), "b")).otherwise(F.concat("a", F.lit("A-"), "b", F.lit("C")))
    return rows.select("doc_id", F.explode(tx.expand_range(label)).alias("label"))


@query(
    _FOUND
    + """ , tokens AS (
  SELECT doc_id, kind, unnest(regexp_extract_all(mention, '\\d+(\\.\\d+)*')) AS token FROM found
  UNION SELECT doc_id, kind, CAST(unnest(generate_series(CAST(regexp_extract(mention, '(\\d+)-', 1) AS BIGINT), CAST(regexp_extract(mention, '-(\\d+)', 1) AS BIGINT))) AS VARCHAR) FROM found WHERE kind <> 'section')
  SELECT DISTINCT doc_id, concat(kind, ':', token) AS ref FROM tokens"""
)
def refs_trivial_set(spark, sf_dir):
    return lens.referring(spark, sf_dir).select("doc_id", F.explode(tx.trivial_refs(F.col("text"))).alias("ref"))


@query(_FOUND + " SELECT doc_id, CASE kind WHEN 'line' THEN 'paragraph' ELSE kind END AS type, regexp_replace(mention, '^[A-Za-z]+ ', '') AS label FROM found")
def refs_stat_units(spark, sf_dir):
    rows = lens.referring(spark, sf_dir).select("doc_id", F.explode(tx.mentions(F.col("text"))).alias("m"))
    return rows.select("doc_id", F.when(F.col("m.kind") == "line", "paragraph").otherwise(F.col("m.kind")).alias("type"), tx.stat_label(F.col("m")).alias("label"))


@query()
def sentence_split(spark, sf_dir):
    rows = lens.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "s"))
    return rows.select("doc_id", "pos", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"), F.col("s.text").alias("sentence"))


@query(
    """WITH s AS (SELECT user_id, event_id % 97 AS a, event_id % 97 + event_id % 5 + 1 AS b FROM events),
  o AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
  i AS (SELECT *, sum(CASE WHEN a <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM o)
  SELECT user_id, min(a) AS start_at, max(b) AS end_at FROM i GROUP BY user_id, island"""
)
def merge_intervals(spark, sf_dir):
    rows = lens.table(spark, sf_dir, "events").selectExpr("user_id", "event_id % 97 AS start_at", "event_id % 97 + event_id % 5 + 1 AS end_at")
    return intervals.merged(rows, ["user_id"], "start_at", "end_at")


@query(
    _FOUND
    + """ SELECT doc_id, kind, mention, 'We refer to Section ' || split_part(t, 'We refer to Section ', 2) AS context FROM found"""
)
def mention_to_sentence(spark, sf_dir):
    """The sentence of each reference."""
    return construct.contexts(lens.referring(spark, sf_dir), ["doc_id"], "text").select("doc_id", "kind", "mention", "context")


@query()
def context_window(spark, sf_dir):
    return construct.contexts(lens.referring(spark, sf_dir), ["doc_id"], "text", around=1)


_NOTES = "notes AS (SELECT conv_id AS paper_id, turn AS note_id, CASE WHEN turn > 0 THEN turn - 1 END AS replyto, CASE WHEN turn // 2 % 2 = 0 THEN 'Reviewer' ELSE 'Authors' END AS from_role, text AS comment FROM conversations)"


@query(
    f"""WITH RECURSIVE {_NOTES}, walk AS (SELECT paper_id, note_id, 0 AS depth, CAST(note_id AS VARCHAR) AS path FROM notes WHERE replyto IS NULL
  UNION ALL SELECT c.paper_id, c.note_id, w.depth + 1, w.path || '/' || c.note_id FROM walk w JOIN notes c ON c.paper_id = w.paper_id AND c.replyto = w.note_id)
  SELECT paper_id, note_id, CAST(depth AS BIGINT) AS depth, path FROM walk"""
)
def thread_flatten(spark, sf_dir):
    flat = threads.flattened(lens.notes(spark, sf_dir, 2))
    return flat.select("paper_id", "note_id", F.col("depth").cast("long").alias("depth"), F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


@query(
    f"""WITH RECURSIVE {_NOTES}, up AS (SELECT paper_id, note_id, replyto, from_role, CAST(NULL AS VARCHAR) AS found FROM notes
  UNION ALL SELECT u.paper_id, u.note_id, p.replyto, p.from_role, CASE WHEN p.from_role <> u.from_role THEN CAST(p.note_id AS VARCHAR) END
  FROM up u JOIN notes p ON p.paper_id = u.paper_id AND p.note_id = u.replyto WHERE u.found IS NULL)
  SELECT paper_id, note_id, max(found) AS ancestor FROM up GROUP BY paper_id, note_id"""
)
def ancestor_other_role(spark, sf_dir):
    return threads.ancestor_of_other_role(lens.notes(spark, sf_dir, 2))


@query(f"WITH {_NOTES} SELECT paper_id, note_id FROM notes n WHERE EXISTS (SELECT 1 FROM notes r WHERE r.paper_id = n.paper_id AND r.replyto = n.note_id AND r.from_role = 'Authors')")
def notes_with_author_reply(spark, sf_dir):
    return threads.with_reply_from(lens.notes(spark, sf_dir, 2), "Authors").select("paper_id", "note_id")


@query(
    f"""WITH {_NOTES}, said AS (SELECT paper_id, note_id, 'See Table ' || (note_id + 1) || ' for the numbers.' AS added FROM notes WHERE from_role = 'Authors' AND comment IS NOT NULL)
  SELECT paper_id, note_id, 'table' AS kind, 'Table ' || (note_id + 1) AS mention FROM said"""
)
def author_reference_comments(spark, sf_dir):
    """References in what authors say (each comment gets a sentence that names a table)."""
    rows = lens.notes(spark, sf_dir, 2).where("from_role = 'Authors'").select("paper_id", "note_id", F.concat("comment", F.lit("\nSee Table "), F.col("note_id") + 1, F.lit(" for the numbers.")).alias("comment"))
    found = rows.select("paper_id", "note_id", F.explode(tx.mentions(F.col("comment"))).alias("m"))
    return found.select("paper_id", "note_id", "m.kind", F.col("m.text").alias("mention"))


_SAID = """said AS (SELECT a.conv_id, a.turn, a.text AS sentence, u.text AS review_sentence FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant'),
  n AS (SELECT *, lower(trim(regexp_replace(sentence, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))) AS s, lower(trim(regexp_replace(review_sentence, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))) AS r FROM said)"""


def _said(spark, sf_dir):
    rows = lens.table(spark, sf_dir, "conversations")
    user = rows.selectExpr("conv_id", "turn + 1 AS turn", "text AS review_sentence")
    return rows.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("sentence")).join(user, ["conv_id", "turn"])


@query(f"WITH {_SAID} SELECT conv_id, turn, sentence FROM n WHERE NOT (starts_with(trim(sentence), '>') OR starts_with(trim(sentence), '#')) AND NOT (s <> '' AND r <> '' AND (contains(s, r) OR contains(r, s)))")
def quote_filter_cheap(spark, sf_dir):
    rows = _said(spark, sf_dir).withColumns({"_s": tx.collapse(F.col("sentence")), "_r": tx.collapse(F.col("review_sentence"))})
    return rows.where(~fuzzy.looks_quoted(F.col("sentence")) & ~fuzzy.contains_either(F.col("_s"), F.col("_r"))).select("conv_id", "turn", "sentence")


@query()
def quote_filter_fuzzy(spark, sf_dir):
    """Sentences of what an assistant says that quote no sentence of the turn before."""
    rows = _said(spark, sf_dir)
    said = rows.select("conv_id", "turn", F.explode(sentences(F.col("review_sentence"))).alias("s")).select("conv_id", "turn", F.col("s.text").alias("review_sentence"))
    own = rows.select("conv_id", "turn", F.explode(sentences(F.col("sentence"))).alias("s")).select("conv_id", "turn", F.col("s.text").alias("sentence"))
    return fuzzy.without_quotes(own, said, ["conv_id", "turn"])


@query(
    """WITH p AS (SELECT doc_id, text, doc_id % 4 + 1 AS a, doc_id % 4 + 1 + doc_id % 3 AS b, doc_id % 5 + 1 AS c FROM documents)
  SELECT doc_id, concat(text, chr(10), 'As Tables ', a, '-', b, ' show, it holds.') AS context FROM p WHERE NOT c BETWEEN a AND b"""
)
def trivial_ref_filter(spark, sf_dir):
    rows = lens.table(spark, sf_dir, "documents").selectExpr("doc_id", "concat(text, '\\n', 'As Tables ', doc_id % 4 + 1, '-', doc_id % 4 + 1 + doc_id % 3, ' show, it holds.') AS context", "array(concat('Table ', doc_id % 5 + 1, ' is unclear')) AS review_spans")
    return construct.nontrivial(rows).select("doc_id", "context")


@query("WITH l AS (SELECT doc_id, doc_id % 2 = 0 AS a, doc_id % 3 = 0 AS b, doc_id % 5 = 0 AS c, doc_id % 7 <> 0 AS d FROM documents) SELECT doc_id, a OR b OR c OR NOT d AS filter_out FROM l")
def filter_labels_derive(spark, sf_dir):
    m = lambda n: F.col("doc_id") % n
    return lens.table(spark, sf_dir, "documents").select("doc_id", tx.filter_out(m(2) == 0, m(3) == 0, m(5) == 0, m(7) != 0).alias("filter_out"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 3 < 2 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 3 = 2")
def json_salvage(spark, sf_dir):
    """The object in an answer that is fenced, wrapped in words, or none."""
    rows = lens.table(spark, sf_dir, "events")
    answer = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here it is: "), "props", F.lit(" as asked."))).otherwise("no answer")
    return rows.select("event_id", F.get_json_object(tx.salvage_json(answer), "$.k").cast("long").alias("k"))


@query(
    """WITH l AS (SELECT doc_id, quality, toxic FROM labels)
  SELECT doc_id, concat_ws(',', CASE WHEN quality = 1 THEN 'figure' END, CASE WHEN toxic = 1 THEN 'table' END, CASE WHEN doc_id % 2 = 0 OR doc_id % 3 = 0 THEN 'text' END) AS labels FROM l"""
)
def normalize_labels(spark, sf_dir):
    raw = F.array(F.when(F.col("doc_id") % 2 == 0, "Line").otherwise("junk"), F.when(F.col("doc_id") % 3 == 0, " section").otherwise("x"), F.when(F.col("toxic") == 1, "TABLE").otherwise("y"), F.when(F.col("quality") == 1, "figure").otherwise("z"))
    return lens.table(spark, sf_dir, "labels").select("doc_id", F.array_join(tx.normalize_labels(raw, "text3"), ",").alias("labels"))


@query("SELECT conv_id, string_agg(concat(role, ' ', turn, ':', chr(10), text), chr(10) || chr(10) ORDER BY turn) AS review FROM conversations GROUP BY conv_id")
def review_flatten(spark, sf_dir):
    """All turns of a conversation as the fields of one report."""
    field = F.struct("turn", F.concat("role", F.lit(" "), F.col("turn").cast("string")).alias("name"), "text")
    fields = F.map_from_entries(F.transform(F.array_sort(F.collect_list(field)), lambda x: F.struct(x["name"], x["text"])))
    return lens.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(fields).alias("report")).select("conv_id", tx.flatten_review(F.col("report")).alias("review"))


@query(
    """WITH w AS (SELECT page_id, html, regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g') AS b FROM pages),
  s AS (SELECT page_id, regexp_split_to_array(b, '(?i)<p(?:\\s[^>]*)?>')[2:] AS parts FROM w),
  u AS (SELECT page_id, unnest(range(len(parts))) AS ord, unnest(parts) AS x FROM s),
  t AS (SELECT page_id, ord, trim(regexp_replace(regexp_replace(regexp_replace(x, '(?is)</?(?:p|div|section|article|ul|ol|table|h[1-6]|body|html|footer|nav|header|main)[ >].*$', ''), '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g')) AS paragraph FROM u)
  SELECT page_id, ord, paragraph FROM t WHERE paragraph <> ''"""
)
def html_paragraphs(spark, sf_dir):
    return io.html_paragraphs(lens.table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", F.col("ord").cast("long").alias("ord"), "paragraph")


_SCORED = """said AS (SELECT a.conv_id, a.turn, a.text AS a, u.text AS b FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant'),
  w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(a), '\\s+'), lambda x: x <> '') AS x, list_filter(regexp_split_to_array(lower(b), '\\s+'), lambda x: x <> '') AS y FROM said),
  s AS (SELECT conv_id, turn, len(x) + len(y) + 1 AS n, (len(list_intersect(x, y)) + 0.5) / (len(list_distinct(x)) + 1) AS s FROM w)"""


@query(f"WITH {_SCORED} SELECT conv_id, turn, true AS ok, CAST(n AS BIGINT) AS prompt_tokens, CAST(1 AS BIGINT) AS completion_tokens, round(ln(s), 6) AS yes, round(ln(1 - s), 6) AS no FROM s")
def model_scores(spark, sf_dir):
    """A registered scorer over (assistant turn, user turn) pairs, with probabilities and cost."""
    rows = _said(spark, sf_dir).withColumn("prompt", providers.pointwise_prompt(F.col("sentence"), F.col("review_sentence")))
    out = providers.answered(rows, "prompt", providers.scorer("lexical"), "yes double, no double, prompt_tokens long, completion_tokens long")
    return out.select("conv_id", "turn", F.expr("error IS NULL").alias("ok"), "prompt_tokens", "completion_tokens", F.round("yes", 6).alias("yes"), F.round("no", 6).alias("no"))
