"""The test tables seen as the engine's data model; each view has a DuckDB twin in LENS."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def referring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): a document's whole text and a line with a sentence that names a section, tables and lines."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "concat(text, '\\n', 'We refer to Section ', doc_id % 9 + 1, '.', doc_id % 4 + 1, ', Tables ', doc_id % 5 + 1, '-', doc_id % 5 + 1 + doc_id % 3, ' and lines ', doc_id % 200 + 10, '-', doc_id % 200 + 10 + doc_id % 7, ' for details.') AS text",
    )


def notes(spark: SparkSession, sf_dir: str, turns_per_role: int = 1) -> DataFrame:
    """Conversations as threads: a turn replies to the one before; roles change every so many turns."""
    role = f"CASE WHEN turn DIV {turns_per_role} % 2 = 0 THEN 'Reviewer' ELSE 'Authors' END"
    return table(spark, sf_dir, "conversations").selectExpr("conv_id AS paper_id", "turn AS note_id", "CASE WHEN turn > 0 THEN turn - 1 END AS replyto", f"{role} AS from_role", "text AS comment")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("p", "text")).select("paper_id", (F.col("p") + 1).cast("long").alias("line_no"), "text")


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """(paper_id, block, start_line, end_line) of runs of so many lines."""
    return rows.groupBy("paper_id", F.expr(f"(line_no - 1) DIV {size} + 1").alias("block")).agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ")
    out = rows.groupBy("paper_id", F.expr("(line_no - 1) DIV 3 + 1").alias("paragraph_id")).agg(text.alias("text"), F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"))
    return out.withColumn("section", F.expr("concat('Part ', (paragraph_id - 1) DIV 2 + 1)"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of six lines and subsections of three."""
    rows = lines(spark, sf_dir)
    top = blocks(rows, 6).selectExpr("paper_id", "CAST(block AS STRING) AS number", "concat('Part ', block) AS name", "1L AS level", "start_line", "end_line")
    sub = blocks(rows, 3).selectExpr("paper_id", "concat((block - 1) DIV 2 + 1, '.', (block - 1) % 2 + 1) AS number", "concat('Half ', block) AS name", "2L AS level", "start_line", "end_line")
    return top.unionByName(sub)


# DuckDB twins, as common table expressions
LENS = r"""
referring AS (SELECT doc_id, concat(text, chr(10), 'We refer to Section ', doc_id % 9 + 1, '.', doc_id % 4 + 1, ', Tables ', doc_id % 5 + 1, '-', doc_id % 5 + 1 + doc_id % 3,
  ' and lines ', doc_id % 200 + 10, '-', doc_id % 200 + 10 + doc_id % 7, ' for details.') AS text FROM documents),
lines AS (SELECT doc_id AS paper_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS text FROM documents),
paragraphs AS (SELECT paper_id, (line_no - 1) // 3 + 1 AS paragraph_id, string_agg(text, ' ' ORDER BY line_no) AS text, min(line_no) AS start_line, max(line_no) AS end_line FROM lines GROUP BY ALL),
sections AS (
  SELECT paper_id, CAST((line_no - 1) // 6 + 1 AS VARCHAR) AS number, concat('Part ', (line_no - 1) // 6 + 1) AS name, 1 AS level, min(line_no) AS start_line, max(line_no) AS end_line FROM lines GROUP BY ALL
  UNION ALL
  SELECT paper_id, concat((line_no - 1) // 6 + 1, '.', ((line_no - 1) // 3) % 2 + 1), concat('Half ', (line_no - 1) // 3 + 1), 2, min(line_no), max(line_no) FROM lines GROUP BY ALL)
"""
