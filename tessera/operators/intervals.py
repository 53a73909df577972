"""Interval operators: union by window functions, points and overlaps by joins on a group key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Union of half-open intervals of each key; overlapping or touching ones are one (gaps and islands)."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col(start) <= reach, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def merged_array(spans: Column) -> Column:
    """As merged, for an array of struct(start, end)."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(out, x):
        last = F.try_element_at(out, F.lit(-1))
        one = F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"))
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], one["end"]).alias("end"))
        return F.when((F.size(out) > 0) & (x["start"] <= last["end"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(wider))).otherwise(F.concat(out, F.array(one)))

    return F.aggregate(F.array_sort(spans), empty, step)


def holds(spans: Column, point: Column) -> Column:
    """Whether a point lies in one of an array of half-open intervals."""
    return F.exists(spans, lambda s: (s["start"] <= point) & (point < s["end"]))


def place_of(spans: Column, point: Column) -> Column:
    """Index (from 0) of the interval that holds the point; null if none."""
    at = F.transform(spans, lambda s, i: F.when((s["start"] <= point) & (point < s["end"]), i))
    return F.array_min(at)


#: Widths of bins as powers of two. An interval has the first that is not narrower than itself, so it touches two of its bins at most.
LEVELS = (3, 7, 11, 15, 20, 26, 62)


def _binned(df: DataFrame, span: tuple[str, str], side: str) -> DataFrame:
    """df with a row for each bin that an interval touches, at its own level and all wider ones; intervals with null or negative ends have none."""
    low, high = F.least(*span).cast("long"), F.greatest(*span).cast("long")
    own = F.lit(LEVELS[-1])
    for k in reversed(LEVELS[:-1]):
        own = F.when(high - low < 1 << k, k).otherwise(own)
    bins = lambda k: F.array_distinct(F.array(F.struct(F.lit(k).alias("_level"), F.shiftright(low, k).alias("_bin")), F.struct(F.lit(k).alias("_level"), F.shiftright(high, k).alias("_bin"))))
    every = F.flatten(F.filter(F.array(*(F.when(own <= k, bins(k)) for k in LEVELS)), lambda x: x.isNotNull()))
    known = F.coalesce((F.col(span[0]) >= 0) & (F.col(span[1]) >= 0), F.lit(False))
    made = df.where(known).withColumns({f"_{side}_low": low, f"_{side}_own": own})
    return made.select("*", F.explode(every).alias("_at")).select(*made.columns, "_at.*")


def _meeting(a: DataFrame, b: DataFrame, keys: list[str], a_span: tuple[str, str], b_span: tuple[str, str]) -> DataFrame:
    """Pairs with equal keys that touch a bin of the wider one's level, each once (in the first bin that both touch).

    A key of any number of intervals is spread over its bins; a row is copied twice a level at most.
    """
    pairs = _binned(a, a_span, "a").join(_binned(b, b_span, "b"), [*keys, "_level", "_bin"])
    level = F.greatest("_a_own", "_b_own")
    first = reduce(lambda out, k: F.when(F.col("_level") == k, F.shiftright(F.greatest("_a_low", "_b_low"), k)).otherwise(out), LEVELS, F.lit(None).cast("long"))
    return pairs.where((F.col("_level") == level) & (F.col("_bin") == first)).drop("_level", "_bin", "_a_low", "_b_low", "_a_own", "_b_own")


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], a_span: tuple[str, str], b_span: tuple[str, str]) -> DataFrame:
    """Pairs with equal keys whose closed intervals meet; null or -1 ends meet nothing. Joined by range bins."""
    a0, a1, b0, b1 = (F.col(c) for c in (*a_span, *b_span))
    return _meeting(a, b, keys, a_span, b_span).where((b0 <= a1) & (a0 <= b1))


def containing(inner: DataFrame, outer: DataFrame, keys: list[str], inner_span: tuple[str, str], outer_span: tuple[str, str]) -> DataFrame:
    """Pairs with equal keys where the outer closed interval contains the inner one. Joined by range bins."""
    i0, i1, o0, o1 = (F.col(c) for c in (*inner_span, *outer_span))
    return _meeting(inner, outer, keys, inner_span, outer_span).where((o0 <= i0) & (i1 <= o1))


def window_text(sentences: Column, place: Column, around: int) -> Column:
    """Sentences place - around .. place + around, joined by a space."""
    first = F.greatest(place - around, F.lit(0))
    return F.array_join(F.transform(F.slice(sentences, first + 1, place + around - first + 1), lambda s: s["text"]), " ")
