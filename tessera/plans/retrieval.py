"""Retrieval runs: gold of queries, pools, scorers, resume, and the reasons why a query is left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import providers, ranking
from ..sources.io import remaining


def with_gold(aligned: DataFrame, sentence: str = "rebuttal_sentence", compat: bool = False) -> DataFrame:
    """aligned with gold, the canonical references of the sentence."""
    return aligned.withColumn("gold", tx.references(F.col(sentence), compat))


def on_figures_and_tables(queries: DataFrame) -> DataFrame:
    """Queries whose gold names a figure or table."""
    return queries.where(F.exists("gold", lambda g: g["type"].isin("Figure", "Table")))


def scored(queries: DataFrame, candidates: DataFrame, corpus: list[str], query: list[str], model: str, done: DataFrame | None = None) -> DataFrame:
    """(corpus, query, cand_id, score, rank, error) by a registered scorer; queries in done are skipped.

    A pair without an answer has the score of no label and its error, by which it is told from an answer that names none.
    Every candidate of a query's corpus is one prompt, so the pairs are the work asked for.
    """
    todo = remaining(queries, done, [*corpus, *query]) if done is not None else queries
    pairs = todo.withColumnRenamed("text", "_q").join(candidates, corpus).withColumn("prompt", providers.pointwise_prompt(F.col("_q"), F.col("text")))
    out = providers.answered(pairs.select(*corpus, *query, "cand_id", "ord", "prompt"), "prompt", providers.scorer(model), "yes double, no double")
    return ranking.ranked(out.withColumn("score", ranking.yes_probability(F.col("yes"), F.col("no"))).drop("yes", "no", "prompt"), [*corpus, *query])


def decision(logprobs: Column, yes: tuple[str, ...] = ("A",), no: tuple[str, ...] = ("B",)) -> Column:
    """P(yes) from a response's tokens: array<struct<token, top: map<token, logprob>>>; the last token that is a label decides.

    Of spellings of a label the likeliest counts; -100 if no label was said.
    """
    bare = lambda t: F.upper(F.regexp_replace(t, r"[^A-Za-z]", ""))
    said = F.filter(logprobs, lambda x: bare(x["token"]).isin(*yes, *no))
    top = F.map_entries(F.try_element_at(said, F.lit(-1))["top"])
    best = lambda names: F.array_max(F.transform(F.filter(top, lambda e: bare(e["key"]).isin(*names)), lambda e: e["value"]))
    known = lambda a, b: F.coalesce(a, b - 100.0)  # noqa: E731  a label that is not among the likely ones has next to no share
    y, n = best(yes), best(no)
    return F.when(y.isNull() & n.isNull(), F.lit(-100.0)).otherwise(ranking.yes_probability(known(y, n), known(n, y)))


def exclusions(queries: DataFrame, predictions: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """queries(id, gold_units, n_scores) with reason: outside_shared_subset, missing_prediction, empty_scores, missing_or_unexpandable_gold, or null."""
    marked = queries.join(predictions.select("id", F.lit(True).alias("_p")).distinct(), "id", "left")
    marked = marked.join(shared.select("id", F.lit(True).alias("_s")).distinct(), "id", "left") if shared is not None else marked.withColumn("_s", F.lit(True))
    reason = F.when(F.col("_s").isNull(), "outside_shared_subset").when(F.col("_p").isNull(), "missing_prediction").when(F.col("n_scores") == 0, "empty_scores")
    return marked.withColumn("reason", reason.when(F.coalesce(F.size("gold_units"), F.lit(0)) <= 0, "missing_or_unexpandable_gold")).drop("_p", "_s")


def cached_embeddings(items: DataFrame, cache: DataFrame | None, content: str, embed) -> tuple[DataFrame, DataFrame]:
    """(items with vec, new cache rows): contents are embedded once each, known ones (by SHA-1) not again; embed is a column function."""
    keyed = items.withColumn("sha1", F.sha1(F.col(content).cast("binary")))
    todo = keyed.select("sha1", content).dropDuplicates(["sha1"])
    fresh = (remaining(todo, cache, ["sha1"]) if cache is not None else todo).select("sha1", embed(F.col(content)).alias("vec"))
    every = fresh if cache is None else cache.select("sha1", "vec").unionByName(fresh)
    return keyed.join(every, "sha1").drop("sha1"), fresh
