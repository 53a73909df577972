"""Structured documents: lines, paragraphs, sections, captions, and look-ups between them.

Tables: lines(paper_id, line_no, text), paragraphs(paper_id, paragraph_id, section, text,
start_line, end_line), sections(paper_id, number, name, level, start_line, end_line),
captions(paper_id, caption_id, text). -1 and null both mean an unknown line.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.patterns import SECTION_HEADER, UNNUMBERED
from . import intervals


def line_texts(wanted: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """wanted(paper_id, keys, lo, hi) with the text of those lines, de-hyphenated; missing lines are skipped."""
    hit = wanted.join(lines, "paper_id").where(F.col("line_no").between(F.least("lo", "hi"), F.greatest("lo", "hi")))
    found = hit.groupBy("paper_id", *keys).agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    return found.select("paper_id", *keys, tx.join_lines(F.transform("l", lambda x: x["text"])).alias("text"))


def numbered_lines(rows: DataFrame) -> DataFrame:
    """Page rows (paper_id, ord, text) that end in a 3-4 digit number -> lines; the last of equal numbers stays."""
    parts = rows.select("paper_id", "ord", *(F.regexp_extract("text", r"^(.*?)(-)?\s*(\d{3,4})$", i).alias(f"p{i}") for i in (1, 2, 3))).where("p3 <> ''")
    lines = parts.select("paper_id", F.col("p3").cast("int").alias("line_no"), "ord", F.concat(F.trim("p1"), "p2").alias("text"))
    return lines.groupBy("paper_id", "line_no").agg(F.max_by("text", "ord").alias("text"))


def until_limitations(paragraphs: DataFrame) -> DataFrame:
    """(paper_id, section_ord, section, text) up to and with the first section named after limitations."""
    ranked = paragraphs.withColumn("_k", F.dense_rank().over(Window.partitionBy("paper_id").orderBy("section_ord")))
    first = F.min(F.when(F.lower("section").contains("limitation"), F.col("_k"))).over(Window.partitionBy("paper_id"))
    return ranked.withColumn("_first", first).where("_first is null or _k <= _first").drop("_k", "_first")


def sections_of(lines: DataFrame) -> DataFrame:
    """Sections by their header lines; a section ends before the next of its level or above."""
    bare = F.trim("text")
    part = lambda i: F.regexp_extract(bare, SECTION_HEADER, i)
    marked = lines.select("paper_id", "line_no", bare.alias("t"), part(1).alias("num"), part(2).alias("name"), part(3).alias("app"), part(4).alias("app_name"))
    paper = Window.partitionBy("paper_id")
    marked = marked.withColumns({"last_line": F.max("line_no").over(paper), "last_head": F.max(F.when((F.col("num") != "") | (F.col("app") != ""), F.col("line_no"))).over(paper)})
    numbered, appendix = F.col("num") != "", F.col("app") != ""
    late = F.col("t").rlike(UNNUMBERED) & (F.col("line_no") > F.coalesce("last_head", F.lit(-1)))
    number = F.when(numbered, F.col("num")).when(appendix, F.concat(F.lit("Appendix "), F.col("app"))).otherwise(F.regexp_replace(F.lower("t"), " ", "_"))
    name = F.when(numbered, F.trim("name")).when(appendix, F.coalesce(F.nullif(F.trim("app_name"), F.lit("")), F.concat(F.lit("Appendix "), F.col("app")))).otherwise(F.col("t"))
    level = F.when(numbered, F.size(F.split("num", r"\."))).otherwise(1)
    heads = marked.where(numbered | appendix | late).select("paper_id", number.alias("number"), name.alias("name"), level.alias("level"), F.col("line_no").alias("start_line"), "last_line")
    other = heads.select("paper_id", F.col("level").alias("l2"), F.col("start_line").alias("s2"))
    cut = heads.join(other, "paper_id", "left").groupBy("paper_id", "number", "name", "level", "start_line", "last_line").agg(F.min(F.when((F.col("s2") > F.col("start_line")) & (F.col("l2") <= F.col("level")), F.col("s2"))).alias("next"))
    body = cut.select("paper_id", "number", "name", "level", "start_line", F.greatest("start_line", F.coalesce(F.col("next") - 1, "last_line")).alias("end_line"))
    abstract = marked.where(F.lower("t") == "abstract").groupBy("paper_id").agg(F.min("line_no").alias("start_line"), F.first("last_line").alias("last_line"))
    after = abstract.join(heads.select("paper_id", F.col("start_line").alias("s2")), "paper_id", "left").groupBy("paper_id", "start_line", "last_line").agg(F.min(F.when(F.col("s2") > F.col("start_line"), F.col("s2"))).alias("next"))
    zero = after.select("paper_id", F.lit("0").alias("number"), F.lit("Abstract").alias("name"), F.lit(0).alias("level"), "start_line", F.coalesce(F.col("next") - 1, "last_line").alias("end_line"))
    return zero.unionByName(body)


def introduction_line(sections: DataFrame) -> DataFrame:
    """(paper_id, line): the line after the abstract; papers without one raise."""
    end = F.max(F.when(F.lower("name") == "abstract", F.col("end_line") + 1))
    return sections.groupBy("paper_id").agg(end.alias("line")).select("paper_id", F.coalesce("line", F.raise_error(F.lit("no abstract")).cast("int")).alias("line"))


def filled_gaps(paragraphs: DataFrame, most: int = 10) -> DataFrame:
    """Unresolved paragraphs in a gap of 1..most lines get it; of several in a row, the first."""
    order = Window.partitionBy("paper_id").orderBy("paragraph_id")
    known = lambda c: F.when(F.coalesce(F.col("start_line"), F.lit(-1)) != -1, F.col(c))
    before = F.last(known("end_line"), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(known("start_line"), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    first = F.lag(known("start_line")).over(order).isNotNull()
    gap = after - before - 1
    fill = known("start_line").isNull() & first & gap.between(1, most)
    marked = paragraphs.withColumns({"_fill": F.coalesce(fill, F.lit(False)), "_a": before + 1, "_b": after - 1})
    put = lambda c, x: F.when(F.col("_fill"), F.col(x)).otherwise(F.coalesce(F.col(c), F.lit(-1))).alias(c)
    return marked.select(*(put(c, {"start_line": "_a", "end_line": "_b"}[c]) if c in ("start_line", "end_line") else c for c in paragraphs.columns))


def with_paragraphs(sections: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """sections with start_paragraph, end_paragraph by section name; end_line follows the last paragraph's (null if unknown)."""
    ends = paragraphs.groupBy("paper_id", F.col("section").alias("name")).agg(
        F.min("paragraph_id").alias("start_paragraph"), F.max("paragraph_id").alias("end_paragraph"), F.nullif(F.max_by("end_line", "paragraph_id"), F.lit(-1)).alias("_end"), F.count("*").alias("_n")
    )
    return sections.join(ends, ["paper_id", "name"], "left").withColumn("end_line", F.when(F.col("_n").isNull(), F.col("end_line")).otherwise(F.col("_end"))).drop("_end", "_n")


def section_text(wanted: DataFrame, sections: DataFrame, paragraphs: DataFrame, lines: DataFrame) -> DataFrame:
    """wanted(paper_id, number) with text: the section's paragraphs joined by a space, else its lines; null if none."""
    first = sections.groupBy("paper_id", "number").agg(F.min_by(F.struct("start_line", "end_line", "start_paragraph", "end_paragraph"), "start_line").alias("s")).select("paper_id", "number", "s.*")
    hit = wanted.join(first, ["paper_id", "number"], "left")
    by_par = hit.join(paragraphs, "paper_id").where(F.col("paragraph_id").between(F.col("start_paragraph"), F.col("end_paragraph")))
    by_par = by_par.groupBy("paper_id", "number").agg(F.array_sort(F.collect_list(F.struct("paragraph_id", "text"))).alias("p")).select("paper_id", "number", F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("by_par"))
    spans = hit.where("start_line >= 0 and end_line >= 0").select("paper_id", "number", F.col("start_line").alias("lo"), F.col("end_line").alias("hi"))
    by_line = line_texts(spans, lines, ["number"]).withColumnRenamed("text", "by_line")
    return wanted.join(by_par, ["paper_id", "number"], "left").join(by_line, ["paper_id", "number"], "left").select("paper_id", "number", F.coalesce("by_par", "by_line").alias("text"))


def page_texts(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """pages(paper_id, page, start_line, end_line) with the text of their lines."""
    return line_texts(pages.select("paper_id", "page", F.col("start_line").alias("lo"), F.col("end_line").alias("hi")), lines, ["page"])


def entire_texts(paragraphs: DataFrame, lines: DataFrame) -> DataFrame:
    """(paper_id, text): a paper's paragraphs joined by a space; its lines where it has none."""
    by_par = paragraphs.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("paragraph_id", "text"))).alias("p")).select("paper_id", F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("by_par"))
    rest = lines.join(by_par, "paper_id", "left_anti")
    by_line = rest.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l")).select("paper_id", tx.join_lines(F.transform("l", lambda x: x["text"])).alias("text"))
    return by_par.withColumnRenamed("by_par", "text").unionByName(by_line)


def section_by_name(wanted: DataFrame, sections: DataFrame, partial: bool = False, least_score: float = 82.0) -> DataFrame:
    """wanted(paper_id, name) with the number of its section: equal name, equal letters and digits, part of a name, or most alike."""
    from .fuzzy import partial_ratio

    pairs = wanted.join(sections.select("paper_id", "number", F.col("name").alias("section_name"), "start_line"), "paper_id")
    ask, have = tx.collapse(F.col("name")), tx.collapse(F.col("section_name"))
    tier = F.when(ask == have, 0).when(tx.name_key(F.col("name")) == tx.name_key(F.col("section_name")), 1)
    tier = tier.when(F.lit(partial) & have.contains(ask), 2)
    cheap = pairs.withColumn("tier", tier)
    best = cheap.groupBy("paper_id", "name").agg(F.min("tier").alias("best"))
    sure = cheap.where("tier is not null").select("paper_id", "name", "number", "tier", F.lit(100.0).alias("score"), "start_line")
    rest = pairs.join(best.where("best is null"), ["paper_id", "name"], "left_semi").withColumn("score", partial_ratio(ask, have)).where(F.col("score") >= least_score)
    every = sure.unionByName(rest.select("paper_id", "name", "number", F.lit(3).alias("tier"), "score", "start_line"))
    pick = F.row_number().over(Window.partitionBy("paper_id", "name").orderBy("tier", F.desc("score"), "start_line"))
    found = every.withColumn("_r", pick).where("_r = 1").select("paper_id", "name", "number")
    return wanted.join(found, ["paper_id", "name"], "left")


def captions_of(figures: DataFrame) -> DataFrame:
    """(paper_id, figType, name, caption) rows with all three -> captions, named 'figType name'."""
    full = (F.trim("figType") != "") & (F.trim("name") != "") & (F.trim("caption") != "")
    return figures.where(full).select("paper_id", F.concat_ws(" ", "figType", "name").alias("caption_id"), F.col("caption").alias("text"))


def caption(wanted: DataFrame, captions: DataFrame) -> DataFrame:
    """wanted(paper_id, name) with the caption of that name, case and outer space aside."""
    key = lambda c: F.lower(F.trim(c))
    one = captions.groupBy("paper_id", key("caption_id").alias("_k")).agg(F.min_by("text", "caption_id").alias("text"))
    return wanted.withColumn("_k", key("name")).join(one, ["paper_id", "_k"], "left").drop("_k")


def paragraphs_of_lines(wanted: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """wanted(paper_id, ..., lo, hi) joined with the paragraphs that those lines touch."""
    p = paragraphs.select("paper_id", "paragraph_id", F.col("start_line").alias("_a"), F.col("end_line").alias("_b"))
    return intervals.overlapping(wanted, p, ["paper_id"], ("lo", "hi"), ("_a", "_b")).drop("_a", "_b")


def gold_texts(gold: DataFrame, paragraphs: DataFrame, sections: DataFrame, captions: DataFrame, lines: DataFrame) -> DataFrame:
    """gold(paper_id, kind, label, ...) with texts, what the label points to.

    Line: the paragraphs that its lines touch, in order; Section: its text (sections as of with_paragraphs);
    Figure and Table: the caption of exactly that name. Nothing found gives no texts, another kind null.
    """
    keys = ["paper_id", "kind", "label"]
    asked = gold.select(*keys).distinct()
    ranges = asked.where("kind = 'Line'").withColumn("_b", tx.label_bounds(F.col("label"))).select(*keys, F.col("_b.lo").alias("lo"), F.col("_b.hi").alias("hi"))
    touched = paragraphs_of_lines(ranges, paragraphs).select(*keys, "paragraph_id").join(paragraphs.select("paper_id", "paragraph_id", "text"), ["paper_id", "paragraph_id"])
    by_line = touched.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("paragraph_id", "text"))), lambda x: x["text"]).alias("texts"))
    numbers = asked.where("kind = 'Section'").select("paper_id", F.col("label").alias("number"))
    by_section = section_text(numbers, sections, paragraphs, lines).where("text is not null").select("paper_id", F.lit("Section").alias("kind"), F.col("number").alias("label"), F.array("text").alias("texts"))
    named = asked.where("kind in ('Figure', 'Table')").withColumn("caption_id", F.concat_ws(" ", "kind", "label"))
    by_caption = named.join(captions.select("paper_id", "caption_id", "text"), ["paper_id", "caption_id"]).groupBy(*keys).agg(F.array_sort(F.collect_set("text")).alias("texts"))
    found = by_line.unionByName(by_section).unionByName(by_caption)
    none = F.when(F.col("kind").isin("Line", "Section", "Figure", "Table"), F.array().cast("array<string>"))
    return gold.join(found, keys, "left").withColumn("texts", F.coalesce("texts", none)).select(*gold.columns, "texts")


def without_line_numbers(rows: DataFrame, author: str = "AnonymousACLsubmission") -> DataFrame:
    """Text operations of pages (paper_id, ord, text), ord the place in the paper, without running line numbers and the anonymous author's mark.

    A text of three or four digits is a line number if it is one more than the line number before it; the count
    starts after 0, and zeros before the first are line numbers too. Other numbers stay, as do null texts.
    At most 9,999 texts of a paper are line numbers; only its numbers are gathered.
    """
    numbers = rows.where(F.col("text").rlike(r"^[0-9]{3,4}$")).select("paper_id", "ord", F.col("text").cast("int").alias("n"))
    gathered = numbers.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("ord", "n"))).alias("x"))
    start = F.struct(F.lit(0).alias("last"), F.array().cast(f"array<{rows.schema['ord'].dataType.simpleString()}>").alias("at"))

    def step(acc, x):
        zero, following = (x["n"] == 0) & (acc["last"] == 0), x["n"] == acc["last"] + 1
        return F.struct(F.when(following, x["n"]).otherwise(acc["last"]).alias("last"), F.when(zero | following, F.array_append(acc["at"], x["ord"])).otherwise(acc["at"]).alias("at"))

    running = gathered.select("paper_id", F.explode(F.aggregate("x", start, step)["at"]).alias("ord"))
    return rows.where(F.coalesce(F.col("text") != author, F.lit(True))).join(running, ["paper_id", "ord"], "left_anti").select(*rows.columns)


def paragraph_sections(paragraphs: DataFrame, sections: DataFrame) -> DataFrame:
    """(paper_id, paragraph_id, number): every section that contains a paragraph."""
    p = paragraphs.select("paper_id", "paragraph_id", F.col("start_line").alias("_a"), F.col("end_line").alias("_b"))
    s = sections.select("paper_id", "number", F.col("start_line").alias("_c"), F.col("end_line").alias("_d"))
    return intervals.containing(p, s, ["paper_id"], ("_a", "_b"), ("_c", "_d")).select("paper_id", "paragraph_id", "number").distinct()


def ancestors(number: Column) -> Column:
    """'3.2.1' -> ['3', '3.2']: the strict ancestors of a dotted number."""
    parts = F.split(number, r"\.")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "."))).otherwise(F.array().cast("array<string>"))


def section_ancestors(sections: DataFrame) -> DataFrame:
    """(paper_id, number, ancestor): strict ancestors that exist in the paper."""
    have = sections.select("paper_id", F.col("number").alias("ancestor")).distinct()
    return sections.select("paper_id", "number", F.explode(ancestors(F.col("number"))).alias("ancestor")).distinct().join(have, ["paper_id", "ancestor"])


def section_tree_paragraphs(wanted: DataFrame, paragraphs: DataFrame, sections: DataFrame) -> DataFrame:
    """wanted(paper_id, gold) -> paragraphs inside section gold or a subsection of it."""
    inside = paragraph_sections(paragraphs, sections)
    hit = wanted.join(inside, "paper_id").where((F.col("number") == F.col("gold")) | F.col("number").startswith(F.concat("gold", F.lit("."))))
    return hit.select("paper_id", "gold", "paragraph_id").distinct()


def aligned(paragraphs: DataFrame, lines: DataFrame, start: DataFrame, score: Callable[[str, str], float], at: float = 90, misses: int = 5, coverage: float = 0.35) -> DataFrame:
    """Greedy paragraph-to-line alignment of each paper, from the line in start(paper_id, line) on.

    A paper is one row of arrays: its lines and paragraphs together are a document. score(a, b) is 0..100.
    Python gets the normalised texts and returns a span a paragraph; the texts themselves stay in the JVM.
    """

    def paper(pars: list[str], numbers: list[int], norm: list[str], begin: int | None) -> list[dict]:
        cursor = next((i for i, n in enumerate(numbers) if n >= begin), 0)
        out = []
        for text in pars:
            tokens = set(text.split())
            need = 1 if len(tokens) < 30 else 2 if len(tokens) < 60 else 3
            first, last, hits, missed, seen, known = None, None, 0, 0, set(), {}
            for i in range(cursor, len(norm)):
                if norm[i] not in known:  # equal lines are scored once a paragraph
                    known[norm[i]] = score(text, norm[i]) >= at
                good = known[norm[i]]
                if first is None:
                    hits = hits + 1 if good else 0
                    if hits == need:
                        first, last = i - need + 1, i
                        seen |= set(norm[first].split())
                elif good:
                    missed, last = 0, i
                    seen |= set(norm[i].split())
                else:
                    missed += 1
                    if missed == misses:
                        break
            state = "filled" if first is None else "matched" if len(seen & tokens) >= coverage * max(len(tokens), 1) else "weak_match"
            span = (numbers[first], numbers[last]) if state == "matched" else (-1, -1)
            cursor = last + 1 if state == "matched" else cursor
            out.append(dict(zip(("start_line", "end_line", "status"), (*span, state), strict=True)))
        return out

    @F.arrow_udf("array<struct<start_line:int,end_line:int,status:string>>")
    def spans(pars: pa.Array, numbers: pa.Array, norm: pa.Array, begin: pa.Array) -> pa.Array:
        made = [paper(*(x.as_py() or [] for x in row[:3]), row[3].as_py()) for row in zip(pars, numbers, norm, begin, strict=True)]
        return pa.array(made, pa.list_(pa.struct([("start_line", pa.int32()), ("end_line", pa.int32()), ("status", pa.string())])))

    norm = tx.plain(F.col("text")).alias("norm")
    left = paragraphs.groupBy(F.col("paper_id").cast("string").alias("paper_id")).agg(F.array_sort(F.collect_list(F.struct("paragraph_id", "section", "text", norm))).alias("p"))
    rows = lines.join(start, "paper_id").select(F.col("paper_id").cast("string"), "line_no", "line", norm)
    right = rows.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "norm"))).alias("l"), F.min_by("line", "line_no").alias("begin"))
    placed = left.join(right, "paper_id", "left").withColumn("s", spans(F.col("p.norm"), F.col("l.line_no"), F.col("l.norm"), F.col("begin")))
    return placed.select("paper_id", F.explode(F.arrays_zip("p", "s")).alias("x")).select("paper_id", F.col("x.p.paragraph_id").cast("int").alias("paragraph_id"), "x.p.section", "x.p.text", "x.s.*")


def assembled(lines: DataFrame, paragraphs: DataFrame, sections: DataFrame, captions: DataFrame, meta: DataFrame) -> DataFrame:
    """(paper_id, sdr): one JSON document of each paper in meta(paper_id, venue, title)."""
    listed = lambda df, cols, name: df.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    as_map = lambda c, k, v: F.map_from_entries(F.transform(c, lambda x: F.struct(x[k].cast("string"), x[v])))
    out = meta
    for df, cols, name in (
        (lines, ["line_no", "text"], "lines"), (paragraphs, ["paragraph_id", "section", "text", "start_line", "end_line"], "paragraphs"),
        (sections, ["start_line", "number", "name", "level", "end_line"], "sections"), (captions, ["caption_id", "text"], "captions"),
    ):
        out = out.join(listed(df, cols, name), "paper_id", "left")
    body = F.struct(
        F.struct("venue", "title", "paper_id").alias("metadata"), as_map(F.col("lines"), "line_no", "text").alias("lines"), "paragraphs", "sections", as_map(F.col("captions"), "caption_id", "text").alias("captions")
    )
    return out.select("paper_id", F.to_json(body).alias("sdr"))


def candidates(lines: DataFrame, paragraphs: DataFrame, sections: DataFrame, captions: DataFrame, with_lines: bool = True) -> DataFrame:
    """(paper_id, cand_id, ctype, text, ord): lines, paragraphs, sections (paragraphs' text) and captions; blank texts go."""
    section = section_text(sections.select("paper_id", "number").distinct(), sections, paragraphs, lines).join(sections.groupBy("paper_id", "number").agg(F.min_by("name", "start_line").alias("name"), F.min("start_line").alias("start_line")), ["paper_id", "number"])
    pools = [
        paragraphs.select("paper_id", F.concat(F.lit("Paragraph "), F.col("paragraph_id").cast("string")).alias("cand_id"), F.lit("line").alias("ctype"), "text", (F.col("paragraph_id") + 10**9).cast("long").alias("ord")),
        section.select("paper_id", F.concat_ws(" / ", F.concat(F.lit("Section "), "number"), "name").alias("cand_id"), F.lit("section").alias("ctype"), "text", (F.col("start_line") + 2 * 10**9).cast("long").alias("ord")),
        captions.select("paper_id", F.col("caption_id").alias("cand_id"), tx.candidate_type(F.col("caption_id")).alias("ctype"), "text", F.lit(3 * 10**9).cast("long").alias("ord")),
    ]
    if with_lines:
        pools.insert(0, lines.select("paper_id", F.concat(F.lit("Line "), F.col("line_no").cast("string")).alias("cand_id"), F.lit("raw_line").alias("ctype"), "text", F.col("line_no").cast("long").alias("ord")))
    out = pools[0]
    for p in pools[1:]:
        out = out.unionByName(p)
    return out.withColumn("text", F.trim("text")).where("text <> ''")
