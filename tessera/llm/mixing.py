"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

1. Token counts of the sources (summed before the shuffle) give shares p.
2. Weights are p ** a, normalised. As a grows from 0 (uniform) to 1 (as found), entropy and
   the greatest repetition of a source fall. Bisection gives the greatest a whose entropy is
   target_entropy (a share of the greatest possible) or more, raised if need be until no
   source is repeated over most_repeats times. A round tries a grid of exponents in one
   aggregation over the sources, so no list of sources reaches the driver.
3. A source's quota is its weight of the budget. It is filled by passes over the source, each
   in an order of its own (by md5 of seed, pass and id), the last one as far as the quota goes:
   a document is taken while the tokens before it are below the quota.
4. A copy's place in its source's stream, as a share of the quota, names its block; in a block
   copies are permuted by md5 of seed, block, id and pass. So every block holds the sources
   at their weights.

Sums along a source run over 4096 parts of each pass first and inside a part then, and places in
a block over 256 parts of it, so neither a hot source nor a corpus of blank texts (one block) is one
task's work. Edge cases: null or blank texts have no tokens and come along
where their order puts them; sources without tokens come once; a null source is a source; equal rows are copies of
their own; null ids sort first; an empty table gives an empty mix; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import quoted, saved

#: Exponents tried in a round, rounds (each divides the interval by GRID), and fixed-point units.
GRID, ROUNDS, UNIT = 16, 5, 10**12
#: Parts of a pass (hex digits of the md5 order): 16 ** 3.
PART_DIGITS = 3
#: Parts of a block, in which its copies are numbered: 16 ** 2.
SEAT_DIGITS = 2


@dataclass(frozen=True)
class Mix:
    """budget: tokens of the mix as a share of the tokens there; block_tokens: size of a block."""

    target_entropy: float = 0.95
    most_repeats: float = 4.0
    budget: float = 1.0
    block_tokens: int = 1_000_000
    seed: str = "mix"


def n_words(text: Column) -> Column:
    """Words between ASCII white space; none for null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long"), F.lit(0).cast("long"))


def _power(share: Column, a: float) -> Column:
    """share ** a in fixed-point units, so that sums do not hang on their order."""
    return F.round(F.pow(share, F.lit(a)) * UNIT).cast("long").cast("decimal(38,0)")


def exponent(sources: DataFrame, mix: Mix) -> float:
    """The exponent for sources(share, tokens > 0)."""
    low, high, both, n = 0.0, 1.0, False, None
    for _ in range(ROUNDS):
        tried = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        sums = [F.sum(_power(F.col("share"), a)).alias(f"z{i}") for i, a in enumerate(tried)]
        logs = [F.sum(F.round(F.pow("share", F.lit(a)) * F.log("share") * UNIT).cast("long").cast("decimal(38,0)")).alias(f"l{i}") for i, a in enumerate(tried)]
        rate = [F.max(F.pow("share", F.lit(a - 1))).alias(f"r{i}") for i, a in enumerate(tried)]
        row = sources.agg(F.count("*").alias("n"), *sums, *logs, *rate).first()
        n = row.n
        if n < 2:
            return 1.0
        entropy = [math.log(float(row[f"z{i}"]) / UNIT) - a * float(row[f"l{i}"]) / float(row[f"z{i}"]) for i, a in enumerate(tried)]
        repeats = [mix.budget * row[f"r{i}"] / (float(row[f"z{i}"]) / UNIT) for i in range(len(tried))]
        flat = [e >= mix.target_entropy * math.log(n) - 1e-9 for e in entropy]
        rare = [r <= mix.most_repeats + 1e-9 for r in repeats]
        # entropy holds up to some exponent, the repetition limit from some exponent on; the limit comes first
        beyond = [not f and r for f, r in zip(flat, rare, strict=True)]
        if True not in beyond:
            return 1.0
        i = max(1, beyond.index(True))
        low, high = tried[i - 1], tried[i]
        both = flat[i - 1] and rare[i - 1]
    return low if both else high


def mixed(docs: DataFrame, mix: Mix | None = None, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """id, source, n_tokens, weight, pass, block, position (in the block, from 0): a row for each copy in the mix."""
    mix = mix or Mix()
    key = F.coalesce(quoted(id).cast("string"), F.md5(quoted(text).cast("string")), F.lit(""))  # rows without an id are dealt by their texts
    rows = docs.select(quoted(id).alias("_id"), quoted(source).cast("string").alias("_source"), n_words(quoted(text)).alias("n_tokens"), key.alias("_key"))
    rows = saved(rows, "tokens")
    totals = rows.groupBy("_source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    totals = saved(totals, "sources")
    whole = totals.agg(F.sum("tokens")).first()[0] or 0
    shares = totals.withColumn("share", F.col("tokens") / F.lit(float(max(whole, 1))))
    alive = shares.where("tokens > 0").select("share", "tokens")
    a = exponent(alive, mix)
    scale = alive.agg(F.sum(_power(F.col("share"), a)).alias("z")).first().z or 1
    weight = F.when(F.col("tokens") > 0, _power(F.col("share"), a).cast("double") / F.lit(float(scale))).otherwise(0.0)
    budget = int(mix.budget * whole)
    blocks = max(1, -(-budget // mix.block_tokens))
    quotas = shares.withColumn("weight", F.round(weight, 9)).withColumn("quota", F.floor(F.col("weight") * budget).cast("long"))
    quotas = quotas.withColumn("passes", F.greatest(F.lit(1), F.ceil(F.col("quota") / F.greatest("tokens", F.lit(1)))).cast("int"))
    quotas = quotas.select("_source", "tokens", "weight", "quota", "passes")
    tagged = rows.withColumn("_s", F.coalesce("_source", F.lit("\0null"))).join(quotas.withColumn("_s", F.coalesce("_source", F.lit("\0null"))).drop("_source"), "_s")
    copies = tagged.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    order = F.md5(F.concat_ws(":", F.lit(mix.seed), F.col("pass").cast("string"), "_key"))
    copies = copies.withColumn("_order", order).withColumn("_part", F.substring("_order", 1, PART_DIGITS))
    parts = copies.groupBy("_s", "pass", "_part").agg(F.sum("n_tokens").alias("n"))
    ahead = Window.partitionBy("_s", "pass").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    inside = Window.partitionBy("_s", "pass", "_part").orderBy("_order", "_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = copies.join(parts, ["_s", "pass", "_part"]).withColumn("_before", F.col("pass") * F.col("tokens") + F.col("_ahead") + F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    taken = placed.where((F.col("_before") < F.col("quota")) | (F.col("tokens") == 0))
    block = F.when(F.col("quota") > 0, F.least(F.lit(blocks - 1), F.floor(F.col("_before") * F.lit(blocks) / F.col("quota")))).otherwise(F.floor(F.conv("_part", 16, 10).cast("long") * blocks / 16**PART_DIGITS)).cast("long")
    taken = taken.withColumn("block", block)
    mark = F.md5(F.concat_ws(":", F.lit(mix.seed), F.col("block").cast("string"), "_key", F.col("pass").cast("string")))
    taken = saved(taken.withColumn("_mark", mark).withColumn("_seat", F.substring("_mark", 1, SEAT_DIGITS)).select("_id", "_source", "n_tokens", "weight", "pass", "block", "_mark", "_seat"), "taken")
    seats = taken.groupBy("block", "_seat").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("block").orderBy("_seat").rowsBetween(Window.unboundedPreceding, -1)
    seats = seats.select("block", "_seat", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_ahead"))
    order = Window.partitionBy("block", "_seat").orderBy("_mark", "_id", "pass", "n_tokens")
    out = taken.join(seats, ["block", "_seat"]).withColumn("position", (F.col("_ahead") + F.row_number().over(order) - 1).cast("long"))
    return out.select(F.col("_id").alias(id), F.col("_source").alias(source), "n_tokens", "weight", F.col("pass").cast("long").alias("pass"), "block", "position")
