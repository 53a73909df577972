"""Rankers: BM25, dense dot products, late interaction, and pluggable model scorers.

A ranking is rows (keys..., cand_id, score, rank): greater scores first, ties by the candidate's order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import saved

SPACE = r"[ \t\n\r\f]+"


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPACE), lambda t: t != "")


def ranked(scores: DataFrame, query: list[str], order: str = "ord", unique: bool = False) -> DataFrame:
    """rank from 1 by score, then order; equal candidate ids keep their best rank (and greatest score).

    unique says that a query has each candidate id once: then a limit on the rank reaches each task before rows are shuffled.
    """
    place = Window.partitionBy(*query).orderBy(F.desc("score"), order)
    if not unique:
        first = F.row_number().over(Window.partitionBy(*query, "cand_id").orderBy(F.desc("score"), order))
        scores = scores.withColumn("_first", first).where("_first = 1").drop("_first")
    return scores.withColumn("rank", F.row_number().over(place))


def top_k(ranking: DataFrame, k: int) -> DataFrame:
    return ranking.where(F.col("rank") <= k)


def decisive(scores: DataFrame, query: list[str], k: int) -> DataFrame:
    """(query, cand_id, gold, rank) of the top k and of each query's best gold candidate: all that hits, recall up to k and reciprocal ranks need.

    scores(query, cand_id, ord, score, gold) has each candidate id of a query once. The best gold's rank is one more than
    the count of better rows, so no ranking of all rows is made.
    """
    best = scores.where("gold").groupBy(*query).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("ord").alias("o"), "cand_id")).alias("b"))
    best = saved(best.select(*query, "b"), "best-gold")  # a row a query, of known size
    ahead = (F.col("score") > -F.col("b.s")) | (F.col("score") == -F.col("b.s")) & (F.col("ord") < F.col("b.o"))
    placed = scores.join(best, query).groupBy(*query).agg((F.count_if(ahead) + 1).alias("rank"), F.first("b.cand_id").alias("cand_id"))
    top = top_k(ranked(scores, query, unique=True), k).select(*query, "cand_id", "gold", F.col("rank").cast("long").alias("rank"))
    return top.unionByName(placed.where(F.col("rank") > k).select(*query, "cand_id", F.lit(True).alias("gold"), "rank"))


def holding(candidates: DataFrame, passages: DataFrame, id: str, postings: DataFrame | None = None, corpus: list[str] | None = None) -> DataFrame:
    """(corpus, id, cand_id) of the candidates(corpus, cand_id, text) that hold a passage(corpus, id, text) of their corpus as it is.

    A passage's inner words are whole words of a text that holds it, so pairs meet under the one
    that fewest candidates have. The words of a passage of one or two may be parts of words: they are looked for in
    the list of different words. A passage without words meets every candidate. postings: as postings.count_terms gives them.
    """
    corpus = corpus or []
    words = candidates.select(*corpus, "cand_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")) if postings is None else postings.where("term IS NOT NULL").select(*corpus, "cand_id", "term")
    inner = passages.select(*corpus, id, F.col("text").alias("_passage"), terms(F.col("text")).alias("t"))
    long = inner.where(F.size("t") > 2).select(*corpus, id, "_passage", F.explode(F.array_distinct(F.slice("t", 2, F.size("t") - 2))).alias("term"))
    n = words.join(long.select(*corpus, "term").distinct(), [*corpus, "term"], "left_semi").groupBy(*corpus, "term").agg(F.count("*").alias("n"))
    seed = long.join(n, [*corpus, "term"], "left").groupBy(*corpus, id, "_passage").agg(F.min_by("term", F.struct(F.coalesce("n", F.lit(0)), "term")).alias("term"))
    part = inner.where(F.size("t").isin(1, 2)).select(*corpus, id, "_passage", F.array_max(F.transform("t", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"].alias("_part"))
    known = words.select(*corpus, "term").distinct()
    met = (known.join(part, corpus) if corpus else known.join(part, F.col("term").contains(F.col("_part")))).where(F.col("term").contains(F.col("_part"))).select(*corpus, id, "_passage", "term")
    pairs = words.join(seed.unionByName(met), [*corpus, "term"]).select(*corpus, id, "_passage", "cand_id").distinct()
    texts = candidates.select(*corpus, "cand_id", "text")
    held = pairs.join(texts, [*corpus, "cand_id"]).where(F.col("text").contains(F.col("_passage"))).select(*corpus, id, "cand_id")
    blank = inner.where(F.size("t") == 0).select(*corpus, id, "_passage")
    empty = (texts.join(blank, corpus) if corpus else texts.join(blank, F.col("text").contains(F.col("_passage")))).where(F.col("text").contains(F.col("_passage")))
    return held.unionByName(empty.select(*corpus, id, "cand_id")).distinct()


def bm25(queries: DataFrame, postings: DataFrame, corpus: list[str], query: list[str], k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
    """(corpus, query, cand_id, ord, score) of candidates that share a term with the query, each corpus on its own.

    queries(corpus, query, text); postings(corpus, term, cand_id, ord, len, tf) as postings.count_terms saves them. A negative
    idf becomes floor times the mean idf of the corpus's terms; repeated query terms count each time. Candidates without
    a shared term score 0 and have no row. Document frequencies are summed before they are shuffled, and only the lists
    of query terms meet the queries.
    """
    known = postings.where("term IS NOT NULL")
    size = postings.where("term IS NULL").groupBy(*corpus).agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    df = known.groupBy(*corpus, "term").agg(F.count("*").alias("df"))
    on = lambda a, c: a.join(c, corpus) if corpus else a.crossJoin(F.broadcast(c))  # noqa: E731  without a corpus key, c is one row
    idf = on(df, size).withColumn("idf", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = idf.groupBy(*corpus).agg(F.avg("idf").alias("mean_idf"))
    idf = on(idf, mean).withColumn("idf", F.when(F.col("idf") < 0, floor * F.col("mean_idf")).otherwise(F.col("idf")))
    asked = queries.select(*corpus, *query, F.explode(terms(F.col("text"))).alias("term")).groupBy(*corpus, *query, "term").agg(F.count("*").alias("qtf"))
    weight = saved(asked.join(idf.select(*corpus, "term", "idf", "avg_len"), [*corpus, "term"]), "query-terms")  # a row per term of a query, of known size
    gain = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return known.join(weight, [*corpus, "term"]).groupBy(*corpus, *query, "cand_id", "ord").agg(F.sum(gain).alias("score"))


def numeric_first(c: str) -> list[Column]:
    """Sort keys that order numbers in a text column by value, then other texts."""
    return [F.try_to_number(F.when(F.col(c).rlike("^[0-9]{1,18}$"), F.lpad(c, 18, "0")), F.lit("9" * 18)).asc_nulls_last(), F.col(c).asc()]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))


def dense(queries: DataFrame, candidates: DataFrame, corpus: list[str], normalize: bool = False) -> DataFrame:
    """queries(corpus, ..., qvec) against candidates(corpus, cand_id, ord, vec) with score, the dot product.

    Without a corpus key the candidates meet a stated query set in full.
    """
    vec = (lambda c: unit(F.col(c))) if normalize else F.col
    q, c = queries.withColumn("qvec", vec("qvec")), candidates.withColumn("vec", vec("vec"))
    pairs = q.join(c, corpus) if corpus else q.crossJoin(c)
    return pairs.withColumn("score", dot(F.col("qvec"), F.col("vec"))).drop("qvec", "vec")


def max_sim(query: Column, document: Column) -> Column:
    """Late interaction: for each query vector its best document vector, summed."""
    best = F.transform(query, lambda q: F.array_max(F.transform(document, lambda d: dot(q, d))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x)


def yes_probability(yes: Column, no: Column, failed: float = -100.0) -> Column:
    """Softmax share of yes among two log-probabilities; failed where either is missing."""
    top = F.greatest(yes, no)
    return F.coalesce(F.exp(yes - top - F.log(F.exp(yes - top) + F.exp(no - top))), F.lit(failed))


def cost(prompt_tokens: Column, completion_tokens: Column, per_million: tuple[float, float] = (1.25, 10.0)) -> Column:
    return (prompt_tokens * per_million[0] + completion_tokens * per_million[1]) / 1_000_000
