"""Column expressions over text: references with offsets, labels, clean-up, model answers.

All stay in the JVM. Offsets count code points and are half-open.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import BEGINS, FLAGS, NEEDS, NO_DIGIT, NUM, PATTERNS, PREFIX, RANGE, SAFE_PREFIX, STAT_PREFIX

MENTION = "struct<start:int,end:int,kind:string,text:string>"


def _matches(text: Column, pattern: str, kind: str) -> Column:
    """Matches of one pattern with offsets: one scan puts a mark around each, then every second part is a match.

    Texts that lack what every match of the kind holds (NEEDS, a digit) are not scanned; in others only places
    where a match can begin (BEGINS) are tried.
    """
    known = PATTERNS.get(kind) == pattern
    tried = f"{FLAGS}(?={BEGINS[kind]})(?:{pattern.removeprefix(FLAGS)})" if known else pattern
    none = F.array().cast(f"array<{MENTION}>")
    marked = F.regexp_replace(F.replace(text, F.lit("\x01"), F.lit("\x03")), F.lit(tried), F.lit("\x01$0\x01"))
    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), none.alias("out"))

    def step(acc, x):
        end = acc["at"] + F.length(x)
        said = F.substring(text, acc["at"] + 1, F.length(x))
        one = F.struct(acc["at"].alias("start"), end.alias("end"), F.lit(kind).alias("kind"), said.alias("text"))
        return F.struct(end.alias("at"), (~acc["inside"]).alias("inside"), F.when(acc["inside"], F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(F.split(marked, "\x01", -1), zero, step, lambda acc: acc["out"])
    if not known:
        return found
    folded = F.lower(F.upper(text))
    may = reduce(or_, (folded.contains(x) for x in NEEDS[kind]))
    return F.when(may if kind in NO_DIGIT else may & text.rlike(r"(?U)\d"), found).otherwise(none)


def mentions(text: Column, patterns: dict[str, str] | None = None) -> Column:
    """All references in a text, ordered by start, end and kind, without exact repeats; overlaps of kinds stay."""
    text = F.coalesce(text, F.lit(""))
    return F.array_distinct(F.array_sort(F.flatten(F.array(*(_matches(text, p, k) for k, p in (patterns or PATTERNS).items())))))


def mentions_by_kind(text: Column) -> Column:
    """map kind -> distinct mention texts in order of place; kinds without mentions are absent."""
    text = F.coalesce(text, F.lit(""))
    entries = F.array(*(F.struct(F.lit(k).alias("kind"), F.array_distinct(F.transform(_matches(text, p, k), lambda m: m["text"])).alias("texts")) for k, p in PATTERNS.items()))
    return F.map_from_entries(F.filter(entries, lambda e: F.size(e["texts"]) > 0))


def _dashes(x: Column) -> Column:
    return F.regexp_replace(x, "[–—]", "-")


def expand_range(label: Column, widest: int = 5000) -> Column:
    """'4-6' -> 4, 5, 6; '4.1-4.3' -> 4.1, 4.2, 4.3; anything else as it is."""
    flat = _dashes(label)
    a, b = F.trim(F.substring_index(flat, "-", 1)), F.trim(F.regexp_replace(flat, "^[^-]*-", ""))
    whole = flat.contains("-") & a.rlike(r"^\d+$") & b.rlike(r"^\d+$")
    dotted = flat.contains("-") & a.rlike(r"^\d+(\.\d+)+$") & b.rlike(r"^\d+(\.\d+)+$")
    head = lambda x: F.regexp_extract(x, r"^(.*)\.\d+$", 1)
    tail = lambda x: F.regexp_extract(x, r"(\d+)$", 1).try_cast("long")
    lo, hi = tail(a), tail(b)
    fits = (lo <= hi) & (hi - lo <= widest)
    numbers = F.sequence(lo, hi)
    return (
        F.when(whole & fits, F.transform(numbers, lambda x: x.cast("string")))
        .when(dotted & (head(a) == head(b)) & fits, F.transform(numbers, lambda x: F.concat(head(a), F.lit("."), x.cast("string"))))
        .otherwise(F.array(label))
    )


def _references(kind: str, labels: Column) -> Column:
    return F.transform(labels, lambda x: F.struct(F.lit(kind.capitalize()).alias("type"), x.alias("label")))


def normalize(mention: Column, compat: bool = False) -> Column:
    """The {type, label} list of a mention struct (kind, text).

    compat keeps two oddities of older data: a bare leading l is cut from words, and L12-L15
    is two lines. Otherwise words keep their l and L12-L15 is the range 12-15.
    """
    cleaned = F.regexp_replace(mention["text"], PREFIX if compat else SAFE_PREFIX, "")
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(cleaned, r"[\(\)\[\]]", ""), r"(?U)\s+", " "))
    flat = _dashes(cleaned)
    line = F.regexp_replace(F.regexp_replace(flat, "to", "-"), "and", ",")
    line = line if compat else F.regexp_replace(line, r"(?i)(-\s*)l(?=\d)", "$1")
    lines = F.transform(F.regexp_extract_all(line, F.lit(r"\d+(?:\s*-\s*\d+)?"), F.lit(0)), lambda x: F.regexp_replace(x, " ", ""))
    named = F.lower(F.trim(F.regexp_replace(cleaned, r"(?i) section$", "")))
    ranges = F.transform(F.regexp_extract_all(flat, F.lit(FLAGS + RANGE), F.lit(0)), lambda x: F.regexp_replace(x, " ", ""))
    kinds = {
        "appendix": F.array(F.upper(cleaned)),
        "line": lines,
        "section": F.when(F.size(ranges) > 0, ranges).otherwise(F.array(named)),
        **{k: F.when(F.size(ranges) > 0, F.flatten(F.transform(ranges, lambda r: expand_range(r)))).otherwise(F.array(cleaned)) for k in ("figure", "table")},
        **{k: F.when(F.size(ranges) > 0, ranges).otherwise(F.array(cleaned)) for k in ("equation", "page", "footnote")},
    }
    out = None
    for k, labels in kinds.items():
        out = (F if out is None else out).when(mention["kind"] == k, _references(k, labels))
    return out


def references(text: Column, compat: bool = False) -> Column:
    """Canonical references of a text, in order, repeats kept."""
    return F.flatten(F.transform(mentions(text), lambda m: normalize(m, compat)))


def trivial_refs(text: Column) -> Column:
    """Set of kind:token: every number token, integers of narrow ranges, the letter of an appendix."""

    def tokens(m):
        ranges = F.regexp_extract_all(m["text"], F.lit(r"(\d+)\s*[-–]\s*(\d+)"), F.lit(0))
        lo = lambda r: F.regexp_extract(r, r"^(\d+)", 1).try_cast("long")
        hi = lambda r: F.regexp_extract(r, r"(\d+)$", 1).try_cast("long")
        wide = F.flatten(F.transform(ranges, lambda r: F.when((hi(r) > lo(r)) & (hi(r) - lo(r) <= 20), F.transform(F.sequence(lo(r), hi(r)), lambda x: x.cast("string"))).otherwise(F.array().cast("array<string>"))))
        plain = F.transform(F.regexp_extract_all(m["text"], F.lit(rf"(?i){NUM}(?:\([a-z]\))?".replace("[A-Za-z]", "[a-z]")), F.lit(0)), lambda x: F.lower(F.regexp_replace(x, r"[()]", "")))
        letter = F.upper(F.regexp_extract(m["text"], r"(?i)\bappendix\s+([A-Z])\b", 1))
        some = F.when(m["kind"] != "appendix", F.concat(wide, plain)).when(letter != "", F.array(letter)).otherwise(F.array().cast("array<string>"))
        return F.transform(some, lambda x: F.concat(m["kind"], F.lit(":"), x))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(mentions(text), tokens))))


def stat_label(mention: Column) -> Column:
    """The label that statistics count: case folded, prefix and brackets off, ranges kept."""
    x = F.trim(F.regexp_replace(_dashes(F.lower(mention["text"])), r"(?U)\s+", " "))
    x = F.regexp_replace(F.regexp_replace(x, STAT_PREFIX, ""), r"^[ ()\[\]{}.,:;]+|[ ()\[\]{}.,:;]+$", "")
    return F.when((mention["kind"] == "section") & x.endswith(" section"), F.trim(F.regexp_replace(x, " section$", ""))).otherwise(x)


def collapse(x: Column) -> Column:
    """Lower-cased, white space runs as one space."""
    return F.lower(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))


def plain(x: Column) -> Column:
    """collapse, dashes unified, characters other than word characters and .,;:()- dropped."""
    return F.trim(F.regexp_replace(F.regexp_replace(_dashes(F.lower(x)), r"(?U)\s+", " "), r"(?U)[^\w\s.,;:()-]", ""))


def name_key(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^0-9a-z]+", "")


def no_soft_hyphens(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(x, "­", ""), r"(?U)\s+", " "))


def join_lines(lines: Column) -> Column:
    """Ordered lines as one text: a hyphen at a line's end is dropped with its break, but for the last line."""

    def joined(held: Column) -> Column:
        """As a function of a bound variable, so that the lines are computed once and not for each of them."""
        last = F.size(held) - 1
        piece = lambda x, i: F.when(F.trim(x) == "", "").when(F.rtrim(x).endswith("-") & (i < last), F.regexp_replace(F.trim(x), "-$", "")).otherwise(F.concat(F.trim(x), F.lit(" ")))
        return F.trim(F.array_join(F.transform(held, piece), ""))

    return F.transform(F.array(lines), joined)[0]


def n_tokens(x: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(x, F.lit("")), r"(?U)\s+"), lambda t: t != ""))


def candidate_type(cand_id: Column) -> Column:
    """Line n -> raw_line, Paragraph n -> line, Section -> section, captions by their first word."""
    low = F.lower(cand_id)
    return (
        F.when(low.startswith("line"), "raw_line").when(low.startswith("paragraph"), "line").when(low.startswith("section"), "section")
        .when(low.startswith("figure"), "figure").when(low.startswith("table"), "table")
    )


def canonical_id(cand_id: Column) -> Column:
    """'Section 3 / Intro' -> 'Section 3'; others as they are."""
    return F.when(cand_id.startswith("Section "), F.trim(F.substring_index(cand_id, " / ", 1))).otherwise(cand_id)


def label_bounds(label: Column) -> Column:
    """'12' or '12-15' -> struct(lo, hi), swapped if reversed; null for others."""
    flat = _dashes(label)
    a = F.regexp_extract(flat, r"^\s*(\d+)\s*(?:-\s*\d+)?\s*$", 1)
    b = F.regexp_extract(flat, r"^\s*\d+\s*-\s*(\d+)\s*$", 1)
    lo, hi = a.try_cast("long"), F.coalesce(F.nullif(b, F.lit("")), a).try_cast("long")
    return F.when(a != "", F.struct(F.least(lo, hi).alias("lo"), F.greatest(lo, hi).alias("hi")))


def record_id(*parts: Column) -> Column:
    return F.concat_ws("::", *parts)


# The two label lists, in their order.
LABELS = {"four": ("figure", "table", "line", "section"), "text3": ("figure", "table", "text")}


def normalize_labels(labels: Column, mode: str = "four") -> Column:
    """Known labels in canonical order; text3 folds line and section into text."""
    low = F.transform(labels, lambda x: F.lower(F.trim(x)))
    if mode == "text3":
        low = F.transform(low, lambda x: F.when(x.isin("line", "section"), "text").otherwise(x))
    return F.filter(F.array(*map(F.lit, LABELS[mode])), lambda x: F.array_contains(low, x))


def salvage_json(answer: Column) -> Column:
    """The JSON text in a model's answer: without code fences, the whole if it parses, else the first {...} or [...] that does."""
    bare = F.trim(F.regexp_replace(answer, r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))
    parses = lambda x: F.when(F.try_parse_json(x).isNotNull() & x.rlike(r"^\s*[\[{]"), x)
    pick = lambda p: F.regexp_extract(bare, p, 1)
    return F.coalesce(parses(bare), parses(pick(r"(?s)(\{.*?\})")), parses(pick(r"(?s)(\{.*\})")), parses(pick(r"(?s)(\[.*?\])")), parses(pick(r"(?s)(\[.*\])")))


def flatten_review(report: Column) -> Column:
    """A review that is text or a JSON object field -> text, as one text with 'field:' heads."""
    fields = F.from_json(report, "map<string,string>")
    entries = F.filter(F.map_entries(fields), lambda e: e["value"].isNotNull())
    joined = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(":\n"), e["value"])), "\n\n")
    return F.when(report.rlike(r"(?s)^\s*\{.*\}\s*$") & fields.isNotNull(), joined).otherwise(report)


def filter_out(future_changes: Column, new_experiments: Column, external_references: Column, grounded_in_paper: Column) -> Column:
    """Whether an aligned sentence is to be filtered: any of the first three, or not grounded."""
    return future_changes | new_experiments | external_references | ~grounded_in_paper
