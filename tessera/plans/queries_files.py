"""Queries over files that are made from the tables: printed and numbered PDF lines, pixels of images, numbered JSON lines, published tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..sources import nested, pdf, pixels, published
from ..storage import new_folder
from . import lens

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def _printed(docs: DataFrame) -> DataFrame:
    """(doc_id, content): a PDF file of each text, a numbered row per line; built by column expressions."""
    shown = lambda x: F.concat(F.lit("<"), F.hex(F.encode(x, "UTF-16BE")), F.lit("> Tj "))
    fold = lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\f\x0B]+", " "))
    move = lambda x, i: F.concat(F.lit(f"1 0 0 1 {x} "), (-12 * i).cast("string"), F.lit(" Tm "))
    rows = F.transform(F.split("text", "\n"), lambda t, i: F.concat(move(72, i), shown(fold(t)), move(500, i), shown(F.format_string("%03d", i))))
    body = F.concat(F.lit("BT /F1 10 Tf\n"), F.array_join(rows, "\n"), F.lit("\nET"))
    head = "%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F1 5 0 R >> >> >> endobj\n"
    head += "3 0 obj << /Type /Page /Parent 2 0 R /Contents 4 0 R >> endobj\n5 0 obj << /Type /Font /Subtype /Type0 /Encoding /UniGB-UTF16-H >> endobj\n4 0 obj << /Length "
    whole = F.concat(F.lit(head), F.length(body).cast("string"), F.lit(" >>\nstream\n"), body, F.lit("\nendstream\nendobj\ntrailer << /Root 1 0 R >>\n%%EOF\n"))
    return docs.where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("path"), whole.cast("binary").alias("content"))


_LINES = r"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
  f AS (SELECT doc_id, line_no, trim(regexp_replace(t, '[ \t\r\f\x0B]+', ' ', 'g')) AS t FROM l)"""


@query(f"WITH {_LINES} SELECT doc_id, CAST(line_no AS INT) AS line_no, CASE WHEN t LIKE '%-' THEN rtrim(left(t, length(t) - 1)) || '-' ELSE t END AS text FROM f")
def pdf_lines(spark, sf_dir):
    """Every text printed to a PDF file with line numbers, and read back by them."""
    files = _printed(lens.table(spark, sf_dir, "documents"))
    return pdf.pdf_lines(files).select(F.col("path").cast("long").alias("doc_id"), "line_no", "text")


@query(r"SELECT doc_id, count(*) FILTER (NOT regexp_full_match(t, '[0-9]{3,4}')) AS n_rows FROM (WITH " + _LINES + " SELECT * FROM f) GROUP BY doc_id")
def pdf_cleaned(spark, sf_dir):
    """Rows of text that are left in cleaned operations of those files; rows that are numbers themselves are not counted."""
    kept = pdf.unnumbered_operations(pdf.text_operations(_printed(lens.table(spark, sf_dir, "documents"))))
    return kept.groupBy(F.col("path").cast("long").alias("doc_id")).agg(F.count_if(~F.col("bare").rlike("^[0-9]{3,4}$")).alias("n_rows"))


@F.pandas_udf(BinaryType())
def _png(grey: pd.Series) -> pd.Series:
    return grey.map(lambda x: pixels.png_file(np.array(x, np.uint8).reshape(8, -1, 1), [0, 1, 2, 3, 4]))


@query(
    """WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 1000) AS BIGINT) % 256) AS b FROM embeddings)
  SELECT vec_id, CAST(len(b) // 8 AS INT) AS width, 8 AS height, md5(unhex(array_to_string(list_transform(b, lambda x: printf('%02x%02x%02x', x, x, x)), ''))) AS rgb_md5 FROM b"""
)
def image_pixels(spark, sf_dir):
    """Vectors as small PNG files of all five row filters, decoded to RGB."""
    grey = F.transform("embedding", lambda x: (F.floor(F.abs(x.cast("double")) * 1000) % 256).cast("int"))
    files = lens.table(spark, sf_dir, "embeddings").select("vec_id", _png(grey).alias("content"))
    found = files.select("vec_id", pixels.pixels(F.col("content")).alias("p"))
    return found.select("vec_id", "p.width", "p.height", F.md5("p.rgb").alias("rgb_md5"))


@query("SELECT c_custkey, c_name, count(*) OVER () AS n_lines FROM customer")
def json_lines_numbered(spark, sf_dir):
    """Customers written as JSON lines and read with file and line number; numbers of a file run without gaps."""
    path = new_folder(spark, "json-lines")
    lens.table(spark, sf_dir, "customer").select("c_custkey", "c_name").repartition(3).write.json(path)
    rows = nested.numbered_json_lines(spark, path, "c_custkey long, c_name string")
    last = rows.groupBy("path").agg(F.max("line_no").alias("last"), F.count("*").alias("n")).where("last = n").agg(F.sum("n").alias("n_lines"))
    return rows.select("value.*").crossJoin(F.broadcast(last))  # one row


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def published_orders(spark, sf_dir):
    """Orders published in two versions, the second added to the first, and read back."""
    path = new_folder(spark, "published")
    orders = lens.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    published.publish(orders.where("o_orderkey % 2 = 0"), path)
    published.publish(orders.where("o_orderkey % 2 <> 0"), path, overwrite=False)
    return published.published(spark, path).groupBy("o_custkey").agg(F.count("*").alias("n"))
