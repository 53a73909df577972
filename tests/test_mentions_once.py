"""References are tried only where one can begin, with the same result, and once a text."""

import random

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.patterns import BEGINS, PATTERNS
from tessera.plans import construct

PIECES = ["Appendix A.1", "eq. (3)", "Eqs 4-5", "Equation 2a", "Fig. 3", "figures 4, 5", "FN 3", "footnote 12", "Lines 3-4", "l.5", "l12", "line (7)", "p. 4", "pp 5-6", "page 9", "p7", "Section 4.1", "lıne 3", "ıntroduction section", "dıscussion section", "analyſis section", "sec. 2", "§ 4", "§5", "related  work section", "Method section", "ablation section", "limitation section", "future work section", "introduction section", "Tables 2-4", "tab. 7", "\x01", "word", "é3", "İ", "1", ",", "\n"]


def test_places_of_mentions_do_not_change(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(PIECES) + rng.choice(["", " ", " ", "x", "\t"]) for _ in range(rng.randint(1, 9))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    same = {k: p.replace("(?iU)", "(?iU)(?:)", 1) for k, p in PATTERNS.items()}  # not the known patterns, so tried everywhere
    got = df.select((tx.mentions(F.col("t")) == tx.mentions(F.col("t"), same)).alias("same"), F.size(tx.mentions(F.col("t"))).alias("n"))
    row = got.agg(F.bool_and("same"), F.sum("n")).first()
    assert BEGINS.keys() == PATTERNS.keys() and row[0] and row[1] > 3000


def test_contexts_find_references_once(spark):
    rows = spark.range(3).selectExpr("id AS doc_id", "concat('We refer to Table ', id, ' for more of these details.') AS text")
    out = construct.contexts(rows, ["doc_id"], "text")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("appendix[ ") == 1 and out.count() == 3
