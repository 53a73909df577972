"""Readers and writers: nested JSON, JSONL, CSV, archives of pages, images, rankings, reports."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import nested

IMAGES = "*.{png,jpg,jpeg,webp,bmp}"
NOTE = "struct<note_id:string,replyto:string,rid:string,comment:string>"
ALIGNED = "struct<rebuttal_sentence:string,review_spans:array<string>,labels:struct<future_changes:boolean,new_experiments:boolean,external_references:boolean,grounded_in_paper:boolean,filter_out:boolean>>"
REVIEWED = f"struct<review:string,rebuttal:string,aligned:array<{ALIGNED}>>"
DATASET = f"map<string,map<string,map<string,{REVIEWED}>>>"


def whole_json(spark: SparkSession, path: str, schema: str, blank_ok: bool = False) -> DataFrame:
    """(path, value) of each JSON file under path. A file that is no JSON of that form raises with its name; blank ones too, or they are left out."""
    raw = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value", F.from_json("value", schema).alias("made"))
    blank = F.trim(F.translate("value", "\t\r\n", "   ")) == ""
    fail = F.raise_error(F.concat("path", F.lit(": no JSON of the form "), F.lit(schema))).cast("boolean")
    known = F.when(F.col("made").isNotNull(), True).when(F.trim("value") == "null", False)
    return raw.where((known.when(blank, False) if blank_ok else known).otherwise(fail)).select("path", F.col("made").alias("value"))


def reviews(spark: SparkSession, path: str) -> DataFrame:
    """reviews.json files -> (path, note_id, rid, comment): report is text or an object, kept as JSON text."""
    rows = whole_json(spark, path, "array<struct<note_id:string,rid:string,report:string>>")
    return rows.select("path", F.explode("value").alias("r")).select("path", "r.note_id", "r.rid", F.col("r.report").alias("comment"))


def comments(spark: SparkSession, path: str) -> DataFrame:
    """comments.json files (id -> note) -> (path, note_id, replyto, rid, comment); empty files give no rows."""
    rows = whole_json(spark, path, f"map<string,{NOTE}>", blank_ok=True)
    return rows.select("path", F.explode("value").alias("k", "n")).select("path", F.coalesce("n.note_id", "k").alias("note_id"), "n.replyto", "n.rid", "n.comment")


def dataset(spark: SparkSession, path: str) -> DataFrame:
    """venue -> paper -> review nested JSON -> (venue, paper_id, review_id, review, rebuttal, pos, aligned)."""
    rows = whole_json(spark, path, DATASET)
    rows = rows.select(F.explode("value").alias("venue", "papers")).select("venue", F.explode("papers").alias("paper_id", "reviews")).select("venue", "paper_id", F.explode("reviews").alias("review_id", "r"))
    return rows.select("venue", "paper_id", "review_id", "r.review", "r.rebuttal", F.posexplode_outer("r.aligned").alias("pos", "aligned"))


def dataset_in_parts(spark: SparkSession, path: str) -> DataFrame:
    """As dataset, for files of any size: papers are cut out of byte ranges, and one that is not of that form raises."""
    papers = nested.parsed(nested.members(spark, path), f"map<string,{REVIEWED}>")
    rows = papers.select(F.col("outer").alias("venue"), F.col("key").alias("paper_id"), F.explode("value").alias("review_id", "r"))
    return rows.select("venue", "paper_id", "review_id", "r.review", "r.rebuttal", F.posexplode_outer("r.aligned").alias("pos", "aligned"))


def json_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSONL; blank lines are skipped, a bad line fails the read (nested.numbered_json_lines names it)."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all strings, quoted line breaks allowed."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def comment_labels(spark: SparkSession, path: str) -> DataFrame:
    """A {comment: [labels]} object -> (id, comment, labels); a comment without labels raises."""
    rows = whole_json(spark, path, "map<string,array<string>>").select(F.posexplode(F.map_entries("value")).alias("id", "e"))
    bad = F.raise_error(F.concat(F.lit("no labels: "), F.col("e.key"))).cast("array<string>")
    return rows.select("id", F.col("e.key").alias("comment"), F.when(F.size("e.value") > 0, F.col("e.value")).otherwise(bad).alias("labels"))


def shards(spark: SparkSession, paths: list[str], schema: str, key: str = "paper_id") -> DataFrame:
    """Union of shard files; a key that two shards have raises when it is read."""
    rows = spark.read.schema(schema).json(paths).select("*", F.col("_metadata.file_path").alias("_file"))
    twice = rows.groupBy(key).agg(F.count_distinct("_file").alias("_n"))
    checked = rows.join(twice, key).withColumn(key, F.when(F.col("_n") == 1, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("in several shards: "), F.col(key))).cast("string")))
    return checked.drop("_file", "_n")


def rankings(spark: SparkSession, root: str, models: list[str] | None = None) -> DataFrame:
    """root/<venue>/<model>.json -> (venue, model, paper_id, q_idx, query, gold, cand_id, score, rank); venues named retrieval_* are left out."""
    entry = "struct<query:string,gold:array<struct<type:string,label:string>>,scores:map<string,double>>"
    rows = whole_json(spark, f"{root}/*/*.json", f"map<string,map<string,{entry}>>")
    name = lambda i: F.regexp_extract("path", r"([^/]+)/([^/]+)\.json$", i)
    rows = rows.select(F.url_decode(name(1)).alias("venue"), F.url_decode(name(2)).alias("model"), "value").where(~F.col("venue").startswith("retrieval_"))
    if models:
        rows = rows.where(F.col("model").isin(models))
    rows = rows.select("venue", "model", F.explode("value").alias("paper_id", "qs")).select("venue", "model", "paper_id", F.explode("qs").alias("q_idx", "q"))
    rows = rows.select("venue", "model", "paper_id", F.col("q_idx").cast("int").alias("q_idx"), "q.query", "q.gold", F.posexplode("q.scores").alias("pos", "cand_id", "score"))
    return rows.withColumn("rank", F.col("pos") + 1).drop("pos")


def paper_meta(spark: SparkSession, path: str) -> DataFrame:
    """Metadata files -> (path, venue, title); blank or unreadable fields are null, the file still has its row."""
    raw = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", "accepted_at string, title string").alias("m"))
    return raw.select("path", F.nullif(F.trim("m.accepted_at"), F.lit("")).alias("venue"), F.nullif(F.trim("m.title"), F.lit("")).alias("title"))


def predictions(spark: SparkSession, model_paths: dict[str, str]) -> DataFrame:
    """JSONL predictions of each model -> (model, id, prediction)."""
    out = None
    for model, path in model_paths.items():
        one = json_lines(spark, path, "id string, prediction array<string>").withColumn("model", F.lit(model))
        out = one if out is None else out.unionByName(one)
    return out.select("model", "id", "prediction")


def shared_ids(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of ids -> (id)."""
    return whole_json(spark, path, "array<string>").select(F.explode("value").alias("id")).distinct()


def images(spark: SparkSession, path: str) -> DataFrame:
    """Image files (path, content), each path once, by five extensions."""
    return spark.read.format("binaryFile").option("pathGlobFilter", IMAGES).option("recursiveFileLookup", True).load(path).select("path", "content").dropDuplicates(["path"])


def tei_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """TEI files -> (path, head_ord, head, ord, text): the body's paragraphs, white space folded, empty ones out.

    head is that of the nearest division around a paragraph that has one ('' and -1 if none has), head_ord counts
    divisions in the file and ord its paragraphs. A file that is not well-formed XML gives no rows.
    """
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_tei_rows, "path string, head_ord int, head string, ord int, text string")


def _tei_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    local = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    fold = lambda e, gap: " ".join(gap.join(e.itertext()).split())
    for batch in batches:
        out = []
        for path, content in zip(batch.path, batch.content, strict=True):
            try:
                root = ElementTree.fromstring(content)
            except ElementTree.ParseError:
                continue
            divisions, place = 0, 0
            open_ = [(x, -1, "") for top in root.iter() if local(top) == "text" for x in top if local(x) == "body"][::-1]
            while open_:  # in document order; no recursion, however deep the file
                node, number, head = open_.pop()
                if local(node) == "div":
                    own = next((c for c in node if local(c) == "head"), None)
                    number, head = (number, head) if own is None else (divisions, fold(own, ""))
                    divisions += 1
                elif local(node) == "p" and (text := fold(node, " ")):
                    out.append((path, number, head, place, text))
                    place += 1
                open_.extend((c, number, head) for c in reversed(node))
        yield pd.DataFrame(out, columns=["path", "head_ord", "head", "ord", "text"])


#: An assembled document as JSON, as operators.documents.assembled writes it.
SDR = "struct<metadata:struct<venue:string,title:string,paper_id:string>,lines:map<string,string>,paragraphs:array<struct<paragraph_id:long,section:string,text:string,start_line:long,end_line:long>>,sections:array<struct<start_line:long,number:string,name:string,level:long,end_line:long>>,captions:map<string,string>>"


def parsed_documents(rows: DataFrame, column: str) -> DataFrame:
    """rows with column, JSON text of an assembled document, as a struct; rows that do not parse or have no lines are left out."""
    return rows.withColumn(column, F.from_json(column, SDR)).where(F.col(column)["lines"].isNotNull())


def documents(spark: SparkSession, root: str) -> DataFrame:
    """root/<venue>/<paper>/v1/paper.sdr.json -> (venue, paper_id, sdr), names as in the path; unreadable ones are left out.

    An inner join on (venue, paper_id) skips the papers that have none.
    """
    raw = spark.read.option("wholetext", True).text(f"{root}/*/*/v1/paper.sdr.json").select(F.col("_metadata.file_path").alias("_path"), F.col("value").alias("sdr"))
    part = lambda i: F.url_decode(F.replace(F.regexp_extract("_path", r"([^/]+)/([^/]+)/v1/[^/]+$", i), F.lit("+"), F.lit("%2B")))
    return parsed_documents(raw.select(part(1).alias("venue"), part(2).alias("paper_id"), "sdr"), "sdr")


def html_paragraphs(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with (ord, paragraph) of each <p>, closed or not, tags stripped, empty ones out."""
    body = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " ")
    parts = F.filter(F.split(body, r"(?i)<p(?:\s[^>]*)?>"), lambda x, i: i > 0)
    inner = F.transform(parts, lambda x: F.regexp_replace(x, r"(?is)</?(?:p|div|section|article|ul|ol|table|h[1-6]|body|html|footer|nav|header|main)[ >].*$", ""))
    plain = F.transform(inner, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), r"[ \t\n\r\f]+", " ")))
    return pages.select("*", F.posexplode(plain).alias("ord", "paragraph")).where("paragraph <> ''")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """The fields in order, nulls as empty."""
    df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in fields)).write.option("header", True).option("escape", '"').csv(path)


def write_pretty(df: DataFrame, path: str) -> None:
    """Each row as indented JSON text."""
    df.select(F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("value")).write.text(path)


def write_rankings(df: DataFrame, path: str) -> None:
    """Parquet by venue and model."""
    df.write.partitionBy("venue", "model").parquet(path)


def split_by(df: DataFrame, ok) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and the failures (null counts as failure)."""
    return df.where(ok), df.where(~F.coalesce(ok, F.lit(False)))


def percent_report(df: DataFrame, values: list[str]) -> DataFrame:
    """Shares as percentages with two decimals, for reading."""
    return df.select(*(F.format_number(100 * F.col(c), 2).alias(c) if c in values else F.col(c) for c in df.columns))


def remaining(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The work rows whose keys are not done."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def with_annotations(rows: DataFrame, known: DataFrame, keys: list[str], column: str, valid: list[str]) -> DataFrame:
    """rows with column taken from known where its value is valid, else their own."""
    new = known.where(F.col(column).isin(valid)).groupBy(*keys).agg(F.min(column).alias("_new"))
    return rows.join(new, keys, "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(*rows.columns)
