"""Dataset construction: threads -> references -> quotes out -> alignment -> trivial pairs out -> labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.sentences import sentences
from ..operators import fuzzy, intervals, providers, ranking, threads
from ..storage import saved


def notes(reviews: DataFrame, comments: DataFrame) -> DataFrame:
    """reviews(paper_id, note_id, comment) and comments(paper_id, note_id, replyto, from_role, comment) as flat threads."""
    roots = reviews.select("paper_id", "note_id", F.lit(None).cast("string").alias("replyto"), F.lit("Reviewer").alias("from_role"), "comment")
    return threads.flattened(roots.unionByName(comments.select(*roots.columns)))


def contexts(rows: DataFrame, keys: list[str], text: str, around: int = 0, least_tokens: int = 7) -> DataFrame:
    """(keys, context, kind, mention, ord): references with their sentence (and neighbours), short contexts out, first-seen repeats only."""
    cut = rows.select(*keys, sentences(F.col(text)).alias("s"), tx.mentions(F.col(text)).alias("m"))
    each = cut.select(*keys, "s", F.posexplode_outer("m").alias("ord", "x"))  # outer: no filter on the array's size, which would find the references twice
    each = each.withColumn("at", intervals.place_of(F.col("s"), F.col("x.start")))
    found = each.where("at is not null").select(*keys, intervals.window_text(F.col("s"), F.col("at"), around).alias("context"), F.col("x.kind").alias("kind"), F.col("x.text").alias("mention"), "ord")
    return found.where(tx.n_tokens(F.col("context")) >= least_tokens).groupBy(*keys, "context", "kind", "mention").agg(F.min("ord").alias("ord"))


def grouped_contexts(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, referencing_sentences): context -> kind -> mentions in order."""
    kinds = found.groupBy(*keys, "context", "kind").agg(F.array_sort(F.collect_list(F.struct("ord", "mention"))).alias("m"), F.min("ord").alias("o"))
    per = kinds.groupBy(*keys, "context").agg(F.array_sort(F.collect_list(F.struct("o", "kind", F.transform("m", lambda x: x["mention"]).alias("m")))).alias("k"), F.min("o").alias("o"))
    entry = F.struct("o", "context", F.map_from_entries(F.transform("k", lambda x: F.struct(x["kind"], x["m"]))).alias("kinds"))
    out = per.groupBy(*keys).agg(F.array_sort(F.transform(F.collect_list(entry), lambda x: F.struct(x["o"].alias("o"), x["context"].alias("context"), F.map_entries(x["kinds"]).alias("e")))).alias("c"))
    return out.select(*keys, F.map_from_entries(F.transform("c", lambda x: F.struct(x["context"], F.map_from_entries(x["e"])))).alias("referencing_sentences"))


def unquoted(found: DataFrame, reviews: DataFrame, keys: list[str]) -> DataFrame:
    """Contexts that do not quote the review: reviews(keys, review)."""
    said = reviews.select(*keys, F.explode(sentences(F.col("review"))).alias("s")).select(*keys, F.col("s.text").alias("review_sentence"))
    return fuzzy.without_quotes(found.withColumnRenamed("context", "sentence"), said, keys).withColumnRenamed("sentence", "context")


def aligned(rows: DataFrame, keys: list[str], provider: providers.Provider, least: float = 0.5) -> DataFrame:
    """(keys, context, review_spans): the review sentences that the provider scores at least so high; rows without any are left out.

    rows(keys, context, review_sentence, pos); each pair is one prompt.
    """
    asked = rows.withColumn("prompt", providers.pointwise_prompt(F.col("review_sentence"), F.col("context")))
    scored = providers.answered(asked, "prompt", provider, "score double")
    kept = scored.where(F.col("score") >= least)
    return kept.groupBy(*keys, "context").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "review_sentence"))), lambda x: x["review_sentence"]).alias("review_spans"))


def nontrivial(rows: DataFrame, sentence: str = "context", spans: str = "review_spans") -> DataFrame:
    """Rows whose sentence and review spans name no common reference."""
    a, b = tx.trivial_refs(F.col(sentence)), tx.trivial_refs(F.array_join(spans, " "))
    return rows.where(~F.arrays_overlap(a, b) | (F.size(a) == 0) | (F.size(b) == 0))


def reviewer_spans(reviews: DataFrame, keys: list[str], review: str = "review") -> DataFrame:
    """(keys, span_id, pos, text): review sentences named rev_sent_i."""
    each = reviews.select(*keys, F.posexplode(sentences(F.col(review))).alias("pos", "s"))
    return each.select(*keys, F.concat(F.lit("rev_sent_"), F.col("pos").cast("string")).alias("span_id"), "pos", F.col("s.text").alias("text"))


def spans_of_ids(rows: DataFrame, spans: DataFrame, keys: list[str], ids: str = "ids") -> DataFrame:
    """rows with review_spans, the texts of their span ids in order; unknown ids are dropped, reason says why none is left."""
    numbered = rows.select(F.struct(*rows.columns).alias("_row"), F.expr("uuid()").alias("_u"))  # equal rows stay apart
    numbered = saved(numbered, "spans")
    one = numbered.select("_u", *(F.col("_row").getField(k).alias(k) for k in keys), F.explode(F.col("_row").getField(ids)).alias("span_id")).join(spans, [*keys, "span_id"])
    texts = one.groupBy("_u").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("review_spans"))
    out = numbered.join(texts, "_u", "left").withColumn("review_spans", F.coalesce("review_spans", F.array().cast("array<string>")))
    return out.select("_row.*", "review_spans", F.when(F.size("review_spans") == 0, "no known span").alias("reason"))


def rebuttal_window(texts, sentence, around: int = 2):
    """Sentences around the one equal to `sentence` (then equal with folded white space); all if none is."""
    same = F.array_position(texts, sentence)
    folded = F.array_position(F.transform(texts, tx.collapse), tx.collapse(sentence))
    at = F.when(same > 0, same).otherwise(folded).cast("int")
    first = F.greatest(at - around, F.lit(1))
    return F.array_join(F.when(at > 0, F.slice(texts, first, at + around - first + 1)).otherwise(texts), " ")


#: Different texts of a paper that are compared as one row; texts of larger papers meet under rare words.
TEXTS_OF_A_PAPER = 64


def _included(texts: DataFrame) -> DataFrame:
    """(paper_id, id) of the asked texts that equal, hold or lie in a retained one of their paper: texts(paper_id, id, text, asked, retained), each once."""
    n = texts.groupBy("paper_id").agg(F.count("*").alias("_texts"), F.count_if(F.col("asked") & ~F.col("retained")).alias("_open"))
    open_papers = n.where("_open > 0 AND _open < _texts")
    held = texts.where("asked AND retained").select("paper_id", "id")
    few = texts.join(open_papers.where(F.col("_texts") <= TEXTS_OF_A_PAPER), "paper_id", "left_semi")
    listed = lambda flag, x: F.collect_list(F.when(flag, x))
    row = few.groupBy("paper_id").agg(listed(~F.col("retained"), F.struct("id", "text")).alias("a"), listed(F.col("retained"), F.col("text")).alias("b"))
    met = F.filter("a", lambda x: F.exists("b", lambda q: x["text"].contains(q) | q.contains(x["text"])))
    held = held.unionByName(row.select("paper_id", F.explode(met).alias("x")).select("paper_id", F.col("x.id").alias("id")))
    many = texts.join(open_papers.where(F.col("_texts") > TEXTS_OF_A_PAPER), "paper_id", "left_semi")
    said = many.where(~F.col("retained")).select("paper_id", F.col("id").alias("cand_id"), "text")
    kept = many.where("retained").select("paper_id", F.col("id").alias("cand_id"), "text")
    other = lambda rows: rows.withColumnRenamed("cand_id", "_id")
    held = held.unionByName(ranking.holding(said, other(kept), "_id", corpus=["paper_id"]).select("paper_id", F.col("cand_id").alias("id")))
    return held.unionByName(ranking.holding(kept, other(said), "_id", corpus=["paper_id"]).select("paper_id", F.col("_id").alias("id"))).distinct()


def coverage(notes: DataFrame, retained: DataFrame, fields: DataFrame) -> DataFrame:
    """fields(paper_id, note_id, text): review spans; retained(paper_id, query): how many are in the retained queries.

    A span counts as included if it equals, holds or lies in a retained query of its paper. A text is known by its
    hash, so texts move twice: once to be found equal, once to their paper's row. Texts of a paper of very many
    meet under a rare word that both have, not all with all.
    """
    named = lambda text: F.unhex(F.sha2(text, 256))
    spans = fields.withColumn("_n", tx.collapse(F.col("text"))).where("_n <> ''").withColumn("_id", named("_n")).drop("_n")
    texts = lambda rows, x, retained: rows.select("paper_id", tx.collapse(F.col(x)).alias("text"), F.lit(retained).alias("retained"))
    every = texts(fields, "text", False).unionByName(texts(retained, "query", True)).where("paper_id IS NOT NULL AND text <> ''")
    every = every.groupBy("paper_id", named("text").alias("id")).agg(F.first("text").alias("text"), F.bool_or(~F.col("retained")).alias("asked"), F.bool_or("retained").alias("retained"))
    hit = _included(saved(every, "texts")).select("paper_id", F.col("id").alias("_id"), F.lit(True).alias("included"))
    answered = threads.with_reply_from(notes, "Authors").select("paper_id", "note_id").distinct().withColumn("answered", F.lit(True))
    marked = spans.join(hit, ["paper_id", "_id"], "left").join(answered, ["paper_id", "note_id"], "left")
    marked = marked.withColumns({"included": F.coalesce("included", F.lit(False)), "answered": F.coalesce("answered", F.lit(False)), "refers": F.size(tx.mentions(F.col("text"))) > 0})
    counts = marked.agg(
        F.count("*").alias("spans"), F.count_if("answered").alias("answered"), F.count_if("included").alias("included"), F.count_if(F.col("included") & F.col("answered")).alias("included_answered"),
        F.count_if("refers").alias("refers"), F.count_if(F.col("refers") & F.col("included")).alias("refers_included"), F.count_if(~F.col("included") & F.col("answered")).alias("excluded_answered"),
    )
    pct = lambda a, b: F.round(100 * F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 6).alias(f"{a}_pct")
    return counts.select("*", pct("included", "spans"), pct("answered", "spans"), pct("included_answered", "answered"), pct("refers_included", "refers"))
