"""Interval joins by range bins against all pairs, and a key of very many intervals."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import intervals


@pytest.fixture(scope="module")
def spans():
    rng = random.Random(6)

    def one():
        low = rng.choice([rng.randrange(40), rng.randrange(5000), rng.randrange(10**9)])
        return low, low + rng.choice([0, 1, 7, 8, rng.randrange(300), rng.randrange(10**8)])

    return [[(rng.randrange(3), i, *one()) for i in range(250)] + [(0, 900, None, 5), (0, 901, -1, -1), (0, 902, 9, 2), (1, 903, 4, None)] for _ in range(2)]


def frames(spark, spans):
    a = spark.createDataFrame(spans[0], "k int, a int, a0 long, a1 long").repartition(3)
    return a, spark.createDataFrame(spans[1], "k int, b int, b0 long, b1 long").repartition(3)


def known(*ends):
    return all(x is not None and x >= 0 for x in ends)


def test_overlapping_equals_all_pairs(spark, spans):
    a, b = frames(spark, spans)
    got = sorted((r.k, r.a, r.b) for r in intervals.overlapping(a, b, ["k"], ("a0", "a1"), ("b0", "b1")).collect())
    assert got == sorted((k, x, y) for k, x, a0, a1 in spans[0] for q, y, b0, b1 in spans[1] if k == q and known(a0, a1, b0, b1) and b0 <= a1 and a0 <= b1) and len(got) > 1000


def test_containing_equals_all_pairs(spark, spans):
    a, b = frames(spark, spans)
    got = sorted((r.k, r.a, r.b) for r in intervals.containing(a, b, ["k"], ("a0", "a1"), ("b0", "b1")).collect())
    assert got == sorted((k, x, y) for k, x, a0, a1 in spans[0] for q, y, b0, b1 in spans[1] if k == q and known(a0, a1, b0, b1) and b0 <= a0 and a1 <= b1) and got


def test_a_paper_of_many_lines_is_spread_over_bins(spark):
    """200,000 lines and 20,000 paragraphs of one paper: 4 x 10^9 pairs if only the paper were the key."""
    lines = spark.range(200_000).select(F.lit("p").alias("paper_id"), F.col("id").alias("lo"), F.col("id").alias("hi"))
    paragraphs = spark.range(20_000).select(F.lit("p").alias("paper_id"), F.col("id").alias("par"), (10 * F.col("id")).alias("a"), (10 * F.col("id") + 9).alias("b"))
    found = intervals.containing(lines, paragraphs, ["paper_id"], ("lo", "hi"), ("a", "b"))
    assert found.agg(F.count("*"), F.sum((F.col("par") == F.floor(F.col("lo") / 10)).cast("int"))).first()[:] == (200_000, 200_000)
