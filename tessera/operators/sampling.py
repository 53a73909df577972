"""Seeded samples and stratified splits, ordered by md5 of id and seed: the same rows on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Hex digits of an md5 order that part a stratum.
PART_DIGITS = 3


def shuffled(id: Column, seed: str) -> Column:
    return F.md5(F.concat(id.cast("string"), F.lit(":" + seed)))


def sample(df: DataFrame, n: int, id: str, seed: str = "42", by: list[str] | None = None) -> DataFrame:
    """n rows without replacement, of each group in by."""
    if not by:
        return df.orderBy(shuffled(F.col(id), seed), id).limit(n)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(shuffled(F.col(id), seed), id))
    return df.withColumn("_r", place).where(F.col("_r") <= n).drop("_r")


def numbered(rows: DataFrame, id: str, seed: str, prefix: str) -> DataFrame:
    """A sample (a bounded number of rows) with sample_id: prefix and three or more digits, in the sample's order."""
    k = F.row_number().over(Window.orderBy(shuffled(F.col(id), seed), id)).cast("string")
    return rows.withColumn("sample_id", F.concat(F.lit(prefix), F.lpad(k, 3, "0")))


def stratified(df: DataFrame, stratum: str, id: str, seed: str = "42", train: float = 0.70, dev: float = 0.15, at_least_one: bool = False) -> DataFrame:
    """df with split (train, dev, test); a stratum's counts are rounded half to even.

    at_least_one gives strata of three or more rows a dev and a test row each.
    """
    # a stratum is numbered in parts of its md5 order, so a hot one is not one task's work
    marked = df.withColumn("_o", shuffled(F.col(id), seed)).withColumn("_p", F.substring("_o", 1, PART_DIGITS)).withColumn("_s", F.struct(F.col(stratum)))
    sizes = marked.groupBy("_s", "_p").agg(F.count("*").alias("_k"))
    whole, before = Window.partitionBy("_s"), Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_s", "_p", F.sum("_k").over(whole).alias("_n"), F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_ahead"))
    place = F.col("_ahead") + F.row_number().over(Window.partitionBy("_s", "_p").orderBy("_o", id))
    share = lambda f: F.bround(F.col("_n") * F.lit(f), 0)
    if at_least_one:
        n_dev = F.when(F.col("_n") >= 3, F.greatest(F.lit(1), share(dev))).otherwise(0)
        n_train = F.col("_n") - n_dev - F.when(F.col("_n") >= 3, F.greatest(F.lit(1), share(1 - train - dev))).otherwise(0)
    else:
        n_train, n_dev = share(train), share(dev)
    marked = marked.join(sizes, ["_s", "_p"]).withColumn("_r", place)
    split = F.when(F.col("_r") <= n_train, "train").when(F.col("_r") <= n_train + n_dev, "dev").otherwise("test")
    return marked.withColumn("split", split).select(*df.columns, "split")


def share_pivot(df: DataFrame, category: str, by: str, values: list[str]) -> DataFrame:
    """category with the count and percentage in each of by's values, and the difference of the first two."""
    counts = df.groupBy(category).pivot(by, values).count().na.fill(0, values)
    totals = counts.agg(*(F.sum(v).alias(f"_{v}") for v in values))
    out = counts.crossJoin(F.broadcast(totals))  # one row
    for v in values:
        out = out.withColumn(f"{v}_pct", F.round(100 * F.coalesce(F.try_divide(F.col(v), F.col(f"_{v}")), F.lit(0.0)), 6)).drop(f"_{v}")
    return out.withColumn("pp_difference", F.round(F.col(f"{values[0]}_pct") - F.col(f"{values[1]}_pct"), 6))
