"""Large JSON files in parts: the members of an object, or of the objects in it, and JSON lines with their numbers.

Spark splits a file into byte ranges by itself, here after closing braces: the text source with
"}" as the end of a row. A range does not know whether it begins inside a string, nor how deep.
So a first pass sums up each range for both cases (how quotes and depth end), the ranges' few
numbers are chained on the driver (a row a range), and a second pass cuts every range at the
commas and braces of the upper levels. A member that spans ranges is put together by its first
piece's place. No task reads more than its range, whatever the size of the file or of a key's
object; a member has to fit into a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import saved

_QUOTE, _BACK, _OPEN, _CLOSE, _COMMA = 34, 92, b"{[", b"}]", 44


def _ranges(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", "}").text(path)
    return raw.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], int, np.ndarray]]:
    """(path and block, file size, bytes with their closing braces) of neighbouring rows of a range; rows of a range come in order."""
    for batch in batches:
        values, paths, blocks, sizes = (c.to_pylist() if k else c for k, c in enumerate(batch.columns))
        begin = 0
        for i in range(1, batch.num_rows + 1):
            if i == batch.num_rows or (paths[i], blocks[i]) != (paths[begin], blocks[begin]):
                part = values.slice(begin, i - begin).cast(pa.binary())
                yield (paths[begin], blocks[begin]), sizes[begin], np.frombuffer(b"}".join(part.to_pylist()) + b"}", np.uint8)
                begin = i


def _outside(buf: np.ndarray, inside: int) -> tuple[np.ndarray, int]:
    """Which bytes are outside strings (their quotes count as inside), and whether the end is inside one."""
    place = np.arange(len(buf))
    plain = np.maximum.accumulate(np.where(buf != _BACK, place, -1))
    quote = np.flatnonzero(buf == _QUOTE)
    before = np.where(quote > 0, plain[quote - 1], -1)
    quote = quote[(quote - 1 - before) % 2 == 0]  # an odd number of backslashes escapes it
    flips = np.zeros(len(buf), np.int64)
    flips[quote] = 1
    state = (np.cumsum(flips) + inside) & 1
    out = state == 0
    out[quote] = False
    return out, int(state[-1]) if len(buf) else inside


def _moves(buf: np.ndarray, outside: np.ndarray) -> np.ndarray:
    """+1 where a brace or bracket opens, -1 where one closes."""
    return np.where(outside, np.isin(buf, list(_OPEN)).astype(np.int64) - np.isin(buf, list(_CLOSE)), 0)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple, list] = {}
    for key, size, buf in _runs(batches):
        have = found.setdefault(key, [size, 0, [0, 1], [0, 0]])
        have[1] += len(buf)
        for s in (0, 1):
            outside, end = _outside(buf, have[2][s])
            have[3][s] += int(_moves(buf, outside).sum())
            have[2][s] = end
    rows = [(*k, size, n, *ends, *depths) for k, (size, n, ends, depths) in found.items()]
    if rows:
        yield pa.RecordBatch.from_pydict(dict(zip(["path", "block", "size", "bytes", "end0", "end1", "depth0", "depth1"], map(list, zip(*rows, strict=True)), strict=True)))


def _starts(rows: DataFrame) -> dict[tuple[str, int], tuple[int, int]]:
    """(inside a string, depth) at the begin of each range; raises for a file whose braces or quotes do not end."""
    sums = rows.mapInArrow(_summed, "path string, block long, size long, bytes long, end0 long, end1 long, depth0 long, depth1 long")
    files: dict[str, list] = {}
    for r in sums.collect():  # a row per range
        files.setdefault(r.path, []).append(r)
    out = {}
    for path, ranges in files.items():
        inside, depth = 0, 0
        for r in sorted(ranges, key=lambda r: r.block):
            out[path, r.block] = (inside, depth)
            inside, depth = (r.end1, depth + r.depth1) if inside else (r.end0, depth + r.depth0)
        depth += int(sum(r.bytes for r in ranges) > ranges[0].size)  # the last row had no brace of its own
        if inside or depth:
            raise ValueError(f"{path} is not whole JSON: it ends {'inside a string' if inside else f'at depth {depth}'}")
    return out


_PIECE = "path string, block long, seq long, level int, starts boolean, opens boolean, text string"


def _cut(starts: dict, levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple, list] = {}
        for key, _, buf in _runs(batches):
            now = state.setdefault(key, [*starts.value[key], 0, False, None])  # inside, depth, next piece, does the piece begin here and how deep
            if key[1] == 0 and now[2] == 0:
                now[3:] = [True, 0]
            outside, end = _outside(buf, now[0])
            move = _moves(buf, outside)
            after = np.cumsum(move) + now[1]
            upper = np.minimum(after, after - move) < levels  # braces that lead to or from an upper level
            cuts = np.flatnonzero((outside & (buf == _COMMA) & (after <= levels)) | ((move != 0) & upper))
            rows, at, raw = [], 0, buf.tobytes()
            for c in [*cuts.tolist(), None]:
                text = raw[at : c if c is not None else len(raw)]
                opens = c is not None and move[c] > 0
                if opens and raw[c : c + 1] == b"[":
                    raise ValueError(f"{key[0]}: a list where an object was expected, after {text[-80:].decode(errors='replace')}")
                rows.append((*key, now[2], now[4] if now[3] else None, now[3], opens, text))
                if c is not None:
                    at, now[2:] = c + 1, [now[2] + 1, True, int(after[c])]
                elif text:
                    now[3] = False
            now[0], now[1], now[2] = end, int(after[-1]), now[2] + 1
            columns = list(zip(*rows, strict=True))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays[:-1], arrays[-1].cast(pa.string())], names=[c.split()[0] for c in _PIECE.split(", ")])

    return run


def members(spark: SparkSession, path: str, levels: int = 2) -> DataFrame:
    """(path, outer, key, value): the members of the object that each file is (levels 1, outer null), or of the objects in it (levels 2, outer names them).

    value is JSON text. Members of one name are rows of their own. A file that is no object of that form raises.
    """
    rows = _ranges(spark, path)
    held = spark.sparkContext.broadcast(_starts(rows))  # two numbers per range
    pieces = saved(rows.mapInArrow(_cut(held, levels), _PIECE), "pieces")
    # A piece that goes on from before belongs to the last piece begun before it; only the first piece of a run can.
    order = Window.partitionBy("path", "block").orderBy("seq")
    own = F.when(F.col("starts"), F.struct("block", "seq"))
    marked = pieces.withColumn("_own", own).withColumn("id", F.last("_own", ignorenulls=True).over(order))
    outer = F.when(F.col("_own").isNotNull() & (F.col("level") == 1) & (F.col("opens") | (F.trim("text") != "")), F.col("_own"))
    marked = marked.withColumn("outer", F.last(outer, ignorenulls=True).over(order)) if levels == 2 else marked.withColumn("outer", F.lit(None).cast("struct<block:long,seq:long>"))
    ends = marked.groupBy("path", "block").agg(F.max("id").alias("last_id"), F.max("outer").alias("last_outer"))
    over = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    ends = ends.select("path", "block", F.last("last_id", ignorenulls=True).over(over).alias("id_before"), F.last("last_outer", ignorenulls=True).over(over).alias("outer_before"))
    dealt = marked.join(ends, ["path", "block"]).withColumns({"id": F.coalesce("id", "id_before"), "outer": F.coalesce("outer", "outer_before")})
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "seq", "text"))), lambda x: x["text"]), "")
    whole = dealt.groupBy("path", "id").agg(F.max("level").alias("level"), F.max("opens").alias("opens"), F.min("outer").alias("outer"), text.alias("text"))
    whole = whole.where(F.trim(F.translate("text", "\n\r\t", "   ")) != "")
    form = r'(?s)^\s*("(?:[^"\\]|\\.)*")\s*:(.*)$'
    key = F.from_json(F.concat(F.lit("["), F.regexp_extract("text", form, 1), F.lit("]")), "array<string>")[0]
    bad = F.raise_error(F.concat(F.col("path"), F.lit(": no member of an object: "), F.substring("text", 1, 200))).cast("string")
    named = whole.withColumn("key", F.when(F.col("text").rlike(form), key).otherwise(bad)).withColumn("value", F.trim(F.regexp_extract("text", form, 2)))
    inner = named.where(F.col("level") == levels).select("path", "outer", "key", "value")
    if levels == 1:
        return inner.select("path", F.lit(None).cast("string").alias("outer"), "key", "value")
    above = named.where("level = 1")
    odd = F.raise_error(F.concat(F.col("path"), F.lit(": no object at "), F.col("key"))).cast("string")
    above = above.select("path", F.col("id").alias("outer"), F.when(F.col("value") == "", F.col("key")).otherwise(odd).alias("name"))
    joined = above.join(inner, ["path", "outer"], "left").where(F.col("key").isNotNull() | (F.length("name") < 0))  # names are looked at even where an object is empty
    return joined.select("path", F.col("name").alias("outer"), "key", "value")


def parsed(rows: DataFrame, schema: str, strict: bool = True) -> DataFrame:
    """members() with value as schema; a value that is not of that form raises, or is listed with its error where strict is false."""
    out = rows.withColumn("_made", F.from_json("value", schema))
    wrong = F.col("_made").isNull() & (F.col("value") != "null")
    where = F.concat_ws(" / ", "path", "outer", "key")
    if strict:
        fail = F.raise_error(F.concat(where, F.lit(": not of the form asked for"))).cast("boolean")
        return out.where(F.when(wrong, fail).otherwise(F.lit(True))).select("path", "outer", "key", F.col("_made").alias("value"))
    return out.select("path", "outer", "key", F.col("_made").alias("value"), F.when(wrong, F.concat(where, F.lit(": not of the form asked for"))).alias("error"))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts the rows of each range."""
    at, n = None, 0
    for batch in batches:
        out = []
        for key in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            at, n = key, n + 1 if key == at else 1
            out.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=["value", "path", "block", "place"])


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, value) of text files, numbered from 1: places inside a range plus the lines of the ranges before it."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    n = rows.groupBy("path", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = saved(n.select("path", "block", before.alias("before")), "line-counts")  # a row per range, of known size
    placed = rows.mapInArrow(_places, "value string, path string, block long, place long")
    return placed.join(counts, ["path", "block"]).select("path", (F.col("before") + F.col("place")).alias("line_no"), "value")


def numbered_json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines as (path, line_no, value); blank lines are skipped.

    A line that is no JSON of that form raises with its file and number, or is listed with its error where strict is false.
    """
    made = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("made")
    rows = text_lines(spark, path).where(F.trim(F.translate("value", "\t\r", "  ")) != "").select("path", "line_no", F.col("value").alias("text"), made)
    bad = F.col("made").isNull() | F.col("made._bad").isNotNull()
    told = F.concat("path", F.lit(" line "), "line_no", F.lit(": invalid JSON: "), F.substring("text", 1, 200))
    value = F.struct(*(F.col("made")[f.name].alias(f.name) for f in rows.schema["made"].dataType.fields if f.name != "_bad"))
    if strict:
        return rows.where(F.when(bad, F.raise_error(told).cast("boolean")).otherwise(F.lit(True))).select("path", "line_no", value.alias("value"))
    return rows.select("path", "line_no", F.when(~bad, value).alias("value"), F.when(bad, told).alias("error"))
