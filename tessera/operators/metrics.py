"""Retrieval and label metrics: aggregations over ranks and label sets.

rankings(query..., cand_id, rank) and gold(query..., slot, unit): a slot is credited at the best rank of its units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slot_ranks(rankings: DataFrame, gold: DataFrame, query: list[str]) -> DataFrame:
    """(query, slot, rank): the best rank of any of the slot's units, null if none is ranked; a null unit keeps its slot."""
    found = gold.join(rankings.select(*query, F.col("cand_id").alias("unit"), "rank"), [*query, "unit"], "left")
    return found.groupBy(*query, "slot").agg(F.min("rank").alias("rank"))


def query_scores(ranks: DataFrame, query: list[str], cutoffs: list[int]) -> DataFrame:
    """hit_k, recall_k and rr of each query from slot ranks."""
    aggs = []
    for k in cutoffs:
        inside = F.when(F.col("rank") <= k, 1.0).otherwise(0.0)
        aggs += [F.max(inside).alias(f"hit_{k}"), F.avg(inside).alias(f"recall_{k}")]
    return ranks.groupBy(*query).agg(*aggs, F.coalesce(F.max(1.0 / F.col("rank")), F.lit(0.0)).alias("rr"))


def means(scores: DataFrame, keys: list[str], values: list[str], digits: int = 6, overall: list[str] | None = None) -> DataFrame:
    """Mean of each value by keys, and over the keys in overall (pooled) with null in the others; 0 for nothing."""
    aggs = [F.count("*").alias("n"), *(F.round(F.coalesce(F.avg(v), F.lit(0.0)), digits).alias(v) for v in values)]
    if overall is None:
        return scores.groupBy(*keys).agg(*aggs)
    return scores.groupingSets([[F.col(k) for k in keys], [F.col(k) for k in overall]], *[F.col(k) for k in keys]).agg(*aggs)


def label_counts(rows: DataFrame, labels: list[str], gold: str = "gold", prediction: str = "prediction", by: list[str] | None = None) -> DataFrame:
    """(by, label, tp, fp, fn, tn) of label arrays; a row meets each of the few labels."""
    by = by or []
    each = rows.select(*by, gold, prediction, F.explode(F.array(*map(F.lit, labels))).alias("label"))
    g, p = F.array_contains(gold, F.col("label")), F.array_contains(prediction, F.col("label"))
    return each.groupBy(*by, "label").agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def prf(counts: DataFrame) -> DataFrame:
    """counts with precision, recall, f1; 0 where nothing is counted."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def label_report(rows: DataFrame, labels: list[str], gold: str = "gold", prediction: str = "prediction", digits: int = 6) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1): each label, 'micro' over all, and 'macro' with the mean f1."""
    counts = label_counts(rows, labels, gold, prediction).drop("tn")
    micro = counts.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))).select(F.lit("micro").alias("label"), "tp", "fp", "fn")
    scored = prf(counts)
    macro = scored.agg(F.avg("f1").alias("f1")).selectExpr("'macro' AS label", "0L AS tp", "0L AS fp", "0L AS fn", "0D AS precision", "0D AS recall", "f1")
    out = scored.unionByName(prf(micro)).unionByName(macro)
    return out.select("label", "tp", "fp", "fn", *(F.round(c, digits).alias(c) for c in ("precision", "recall", "f1")))


def set_summary(rows: DataFrame, gold: str = "gold", prediction: str = "prediction") -> DataFrame:
    """n, exact set matches, empty predictions, mean set sizes."""
    same = (F.size(F.array_except(gold, prediction)) == 0) & (F.size(F.array_except(prediction, gold)) == 0)
    return rows.agg(
        F.count("*").alias("n"), F.round(F.avg(same.cast("int")), 6).alias("set_accuracy"), F.count_if(F.size(prediction) == 0).alias("empty_predictions"),
        F.round(F.avg(F.size(gold)), 6).alias("mean_gold"), F.round(F.avg(F.size(prediction)), 6).alias("mean_predicted"),
    )


def threshold_counts(rows: DataFrame, labels: list[str], gold: str = "gold", probabilities: str = "probabilities") -> DataFrame:
    """(label, threshold, tp, fp, fn) for 41 thresholds 0.10 .. 0.90; probabilities is a map label -> p."""
    each = rows.select(F.array_contains(gold, F.col("label")).alias("g"), F.col(probabilities)[F.col("label")].alias("p"), "label") if "label" in rows.columns else rows.select(
        gold, probabilities, F.explode(F.array(*map(F.lit, labels))).alias("label")
    ).select("label", F.array_contains(gold, F.col("label")).alias("g"), F.col(probabilities)[F.col("label")].alias("p"))
    # the counts of each (label, how many thresholds p reaches) first: 42 rows a label, then sums over them
    step = F.when(F.col("p").isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(41), F.floor((F.col("p") - 0.1) / 0.02 + 1e-9).cast("int") + 1)))
    few = each.groupBy("label", "g", step.alias("reached")).agg(F.count("*").alias("n"))
    grid = few.select("*", F.explode(F.sequence(F.lit(0), F.lit(40))).alias("i"))
    hit = F.col("reached") > F.col("i")
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).alias
    return grid.groupBy("label", F.round(F.lit(0.1) + 0.02 * F.col("i"), 2).alias("threshold")).agg(total(F.col("g") & hit)("tp"), total(~F.col("g") & hit)("fp"), total(F.col("g") & ~hit)("fn"))


def best_thresholds(counts: DataFrame, per_label: bool = False) -> DataFrame:
    """The threshold of the greatest micro F1; ties: nearest to 0.5, then the lowest."""
    keys = ["label"] if per_label else []
    pooled = counts.groupBy(*keys, "threshold").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    scored = prf(pooled).withColumn("f1", F.round("f1", 9))
    best = F.max_by("threshold", F.struct("f1", -F.round(F.abs(F.col("threshold") - 0.5), 6), -F.col("threshold")))
    return scored.groupBy(*keys).agg(best.alias("threshold"), F.max("f1").alias("f1"))


def combinations(units: DataFrame, query: list[str], types: list[str] | None = None) -> DataFrame:
    """(combination, n): how many queries have each multiset of unit types, as '2 figure + table'; units(query, type, label)."""
    kept = units.where(F.col("type").isin(types)) if types else units
    per = kept.select(*query, "type", "label").distinct().groupBy(*query, "type").agg(F.count("*").alias("n"))
    name = F.when(F.col("n") > 1, F.concat_ws(" ", F.col("n").cast("string"), "type")).otherwise(F.col("type"))
    combo = per.groupBy(*query).agg(F.array_sort(F.collect_list(F.struct("type", name.alias("name")))).alias("c"))
    return combo.groupBy(F.array_join(F.transform("c", lambda x: x["name"]), " + ").alias("combination")).agg(F.count("*").alias("n"))


def without_outliers(rows: DataFrame, value: str, sigmas: float = 4.0) -> DataFrame:
    """Rows within so many standard deviations of the mean."""
    stats = rows.agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return rows.crossJoin(F.broadcast(stats)).where(F.abs(F.col(value) - F.col("_m")) <= sigmas * F.col("_s")).drop("_m", "_s")  # one row
