"""PDF files as rows: their text operations, the rows of text they print, numbered lines, and copies without line numbers.

A file (a row of Spark's binaryFile source) is one task's work and becomes a row per text
operation; everything after that (removing line numbers and the author's mark, joining
operations of a baseline, numbered lines) is joins and groups over those rows.

The reader finds objects by their headers, in the file's order, so that a later version of an
object counts, and neither junk before the header nor a broken cross-reference table matters.
It reads object streams, Flate and ASCII-hex streams, character maps, differences of simple
encodings, and forms that a page draws. Encrypted files and other stream filters give one row
with an error.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from binascii import unhexlify
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.documents import numbered_lines, without_line_numbers
from ..storage import saved

# What counts as a line number, and the mark of an anonymous author as it is printed.
LINE_NUMBER = re.compile(r"[0-9]{3,4}")
AUTHOR = "AnonymousACLsubmission"

OPERATIONS = "page int, ord long, op string, text string, bare string, x double, y double, error string"
_SPACE = rb"\x00\t\n\f\r "
_PART = re.compile(rb"[%s]*+(?:(<<|>>|[\[\]{}]|/[^%s()<>\[\]{}/%%]*|<[0-9A-Fa-f%s]*>|\(|[^%s()<>\[\]{}/%%]+|[)>])|%%[^\r\n]*)|[%s]+" % ((_SPACE,) * 5))
_OBJECT = re.compile(rb"(\d+)[%s]+(\d+)[%s]+obj\b" % (_SPACE, _SPACE))
_STREAM = re.compile(rb"[%s]*stream\r?\n" % _SPACE)
_QUOTED = re.compile(rb"[()\\]")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_MARKS = {"acute": "́", "grave": "̀", "circumflex": "̂", "dieresis": "̈", "tilde": "̃", "cedilla": "̧", "ring": "̊", "caron": "̌"}
_GLYPHS = dict(zip("zero one two three four five six seven eight nine".split(), "0123456789", strict=True)) | {
    "space": " ", "hyphen": "-", "minus": "-", "period": ".", "comma": ",", "colon": ":", "semicolon": ";", "parenleft": "(", "parenright": ")", "bracketleft": "[", "bracketright": "]", "slash": "/",
    "quoteright": "’", "quoteleft": "‘", "quotedblleft": "“", "quotedblright": "”", "endash": "–", "emdash": "—", "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl", "germandbls": "ß",
    "question": "?", "exclam": "!", "percent": "%", "ampersand": "&", "plus": "+", "equal": "=", "asterisk": "*", "bullet": "•", "underscore": "_", "section": "§", "dotlessi": "ı",
}


class Name(str):
    pass


class Word(bytes):
    """An operator or keyword."""


@dataclass(frozen=True)
class Ref:
    number: int
    generation: int


@dataclass
class Stream:
    entries: dict
    raw: bytes


class Unreadable(ValueError):
    pass


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in round brackets whose first is before at, and the place after it."""
    out, depth = [], 1
    while m := _QUOTED.search(data, at):
        out.append(data[at : m.start()])
        at, c = m.end(), m[0]
        if c == b"\\":
            octal = re.compile(rb"[0-7]{1,3}|\r\n|.", re.S).match(data, at)
            if not octal:
                break
            at, e = octal.end(), octal[0]
            out.append(bytes([int(e, 8) & 255]) if e[:1].isdigit() and e[:1] < b"8" else b"" if e[:1] in b"\r\n" else _ESCAPES.get(e, e))
            continue
        depth += 1 if c == b"(" else -1
        if not depth:
            return b"".join(out), at
        out.append(c)
    raise Unreadable("a string does not end")


def _hex(token: bytes) -> bytes:
    try:
        return unhexlify(token[1:-1])
    except ValueError:  # spaces, or half a byte
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", token)
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


@lru_cache(maxsize=1 << 14)
def _plain(token: bytes):
    """The value of a token that is no hex string; such values do not change, and few of them make up a file."""
    if token[:1] == b"/":
        return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), token[1:]).decode("latin-1"))
    for kind in (int, float):
        try:
            return kind(token)
        except ValueError:
            pass
    return {b"true": True, b"false": False, b"null": None}.get(token, Word(token))


def values(data: bytes, at: int = 0) -> Iterator[tuple[object, int, int]]:
    """The values of data from a place on, outermost ones whole, with where each begins and ends."""
    open_: list[tuple[list, int]] = []
    while m := _PART.search(data, at):
        token, at = m[1], m.end()
        if token is None:
            continue
        begin = at - len(token)
        if token in (b"[", b"<<"):
            open_.append(([], begin))
            continue
        if token in (b"]", b">>"):
            if not open_:
                continue
            items, begin = open_.pop()
            value = items if token == b"]" else {k: v for k, v in zip(items[::2], items[1::2], strict=False) if isinstance(k, Name)}
        elif token == b"(":
            value, at = _string(data, at)
        else:
            value = _hex(token) if token[:1] == b"<" else _plain(token) if len(token) < 64 else _plain.__wrapped__(token)
        if not open_:
            yield value, begin, at
        elif value == b"R" and isinstance(value, Word) and len(open_[-1][0]) > 1:
            items = open_[-1][0]
            items[-2:] = [Ref(*items[-2:])]
        else:
            open_[-1][0].append(value)


def _decoded(stream: Stream, look) -> bytes:
    data, filters = stream.raw, look(stream.entries.get("Filter")) or []
    for f in map(look, filters if isinstance(filters, list) else [filters]):
        if f in ("FlateDecode", "Fl"):
            data = zlib.decompressobj().decompress(data)
        elif f in ("ASCIIHexDecode", "AHx"):
            data = _hex(b"<" + data.split(b">")[0] + b">")
        else:
            raise Unreadable(f"streams by {f} are not read")
    if (parms := look(stream.entries.get("DecodeParms"))) and any((look(p) or {}).get("Predictor", 1) > 1 for p in (parms if isinstance(parms, list) else [parms])):
        raise Unreadable("streams with a predictor are not read")
    return data


@dataclass
class File:
    """The objects of a file by number, later ones in place of earlier ones."""

    data: bytes
    objects: dict[int, object] = field(default_factory=dict)
    catalog: dict | None = None
    catalog_at: int = 0

    def look(self, value):
        seen = 0
        while isinstance(value, Ref) and seen < 32:
            value, seen = self.objects.get(value.number), seen + 1
        return value

    def put(self, number: int, value) -> None:
        self.objects[number] = value
        if isinstance(value, dict) and value.get("Type") == "Catalog":
            self.catalog, self.catalog_at = value, number

    @staticmethod
    def read(data: bytes) -> File:
        if b"%PDF-" not in data:
            raise Unreadable("no PDF header")
        self, at, packed = File(data), 0, []
        while m := _OBJECT.search(data, at):
            found = next(values(data, m.end()), None)
            if found is None:
                break
            value, _, at = found
            if isinstance(value, int):  # a reference, or a number
                at = m.end()
            if isinstance(value, dict) and (s := _STREAM.match(data, at)):
                size = value.get("Length")
                end = s.end() + size if isinstance(size, int) else -1
                if end < 0 or not data[end : end + 20].lstrip().startswith(b"endstream"):
                    end = data.find(b"endstream", s.end())
                    if end < 0:
                        raise Unreadable("a stream does not end")
                value, at = Stream(value, data[s.end() : end]), end
                if value.entries.get("Encrypt") is not None and value.entries.get("Type") == "XRef":
                    raise Unreadable("encrypted")
                if value.entries.get("Type") == "ObjStm":
                    packed.append(value)
            self.put(int(m[1]), value)
            while packed:
                one = packed.pop()
                inside, first = _decoded(one, self.look), self.look(one.entries.get("First"))
                heads = [int(x) for x in inside[:first].split()]
                for number, place in zip(heads[::2], heads[1::2], strict=False):
                    if found := next(values(inside, first + place), None):
                        self.put(number, found[0])
        if re.search(rb"trailer[%s]*<<(?:(?!>>[%s]*startxref).)*/Encrypt" % (_SPACE, _SPACE), data, re.S):
            raise Unreadable("encrypted")
        if self.catalog is None:
            raise Unreadable("no catalog")
        return self

    def pages(self) -> Iterator[tuple[Ref | None, dict, dict]]:
        """(reference, page, resources) in the order of the page tree."""
        waiting, seen = [(self.catalog.get("Pages"), {})], set()
        while waiting:
            ref, over = waiting.pop()
            node = self.look(ref)
            if not isinstance(node, dict) or ref in seen:
                continue
            seen.add(ref)
            own = self.look(node.get("Resources")) or over
            kids = self.look(node.get("Kids"))
            if isinstance(kids, list):
                waiting += [(k, own) for k in reversed(kids)]
            else:
                yield ref, node, own

    def content(self, page: dict) -> bytes:
        parts = self.look(page.get("Contents"))
        parts = [self.look(p) for p in parts] if isinstance(parts, list) else [parts]
        return b"\n".join(_decoded(p, self.look) for p in parts if isinstance(p, Stream))

    def reader(self, font) -> tuple[int, dict[int, str] | None]:
        """Bytes of a code, and the texts of codes; None: codes are UTF-16 (the predefined character maps that say so)."""
        font = self.look(font)
        if not isinstance(font, dict):
            return 1, {}
        width, texts = 2 if font.get("Subtype") == "Type0" else 1, {}
        encoding = self.look(font.get("Encoding"))
        if width == 2 and isinstance(encoding, Name) and encoding.endswith(("UTF16-H", "UTF16-V")) and "ToUnicode" not in font:
            return width, None
        code = 0
        for x in (self.look(encoding.get("Differences")) or []) if isinstance(encoding, dict) else []:
            if isinstance(x, Name):
                texts[code] = glyph(x)
                code += 1
            elif isinstance(x, int):
                code = x
        if isinstance(cmap := self.look(font.get("ToUnicode")), Stream):
            texts |= _character_map(_decoded(cmap, self.look))
        return width, texts


def glyph(name: str) -> str:
    base, mark = re.fullmatch(r"([A-Za-z]?)(.*)", name).groups()
    if name in _GLYPHS or len(name) == 1:
        return _GLYPHS.get(name, name)
    if m := re.fullmatch(r"uni([0-9A-Fa-f]{4})", name):
        return chr(int(m[1], 16))
    return unicodedata.normalize("NFC", base + _MARKS[mark]) if base and mark in _MARKS else ""


def _character_map(data: bytes) -> dict[int, str]:
    number, text = (lambda b: int.from_bytes(b, "big")), (lambda b: b.decode("utf-16-be", "replace"))
    out, given = {}, []
    for value, _, _ in values(data):
        if not isinstance(value, Word):
            given.append(value)
            continue
        if value == b"endbfchar":
            out |= {number(a): text(b) for a, b in zip(given[::2], given[1::2], strict=False)}
        elif value == b"endbfrange":
            for a, b, to in zip(given[::3], given[1::3], given[2::3], strict=False):
                span = range(number(a), min(number(b), number(a) + 0xFFFF) + 1)
                out |= dict(zip(span, map(text, to), strict=False)) if isinstance(to, list) else {c: text((number(to) + c - span.start).to_bytes(len(to), "big")) for c in span}
        given = []
    return out


def _times(m: tuple, n: tuple) -> tuple:
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u


_ONE = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def shown(file: File, content: bytes, resources: dict, base: tuple = _ONE, depth: int = 0) -> Iterator[tuple[str, str, str, float, float, int, int]]:
    """(op, text, bare, x, y, begin, end) of each text operation; bare has no spaces for gaps, begin and end are places in content."""
    fonts, forms, readers = file.look(resources.get("Font")) or {}, file.look(resources.get("XObject")) or {}, {}
    state, kept, given, begin, line, matrix, leading = (base, (1, {})), [], [], None, _ONE, _ONE, 0.0
    for value, at, end in values(content):
        begin = at if begin is None else begin
        if not isinstance(value, Word):
            given.append(value)
            continue
        op, numbers = value.decode("latin-1"), [x for x in given if isinstance(x, (int, float))]
        if op == "q":
            kept.append(state)
        elif op == "Q" and kept:
            state = kept.pop()
        elif op == "cm" and len(numbers) == 6:
            state = (_times(tuple(numbers), state[0]), state[1])
        elif op == "BT":
            line = matrix = _ONE
        elif op == "Tf" and given:
            if given[0] not in readers:
                readers[given[0]] = file.reader(fonts.get(given[0]))
            state = (state[0], readers[given[0]])
        elif op == "TL" and numbers:
            leading = numbers[0]
        elif op == "Tm" and len(numbers) == 6:
            line = matrix = tuple(numbers)
        elif op in ("Td", "TD") and len(numbers) == 2:
            leading = -numbers[1] if op == "TD" else leading
            line = matrix = _times((1, 0, 0, 1, *numbers), line)
        elif op == "Do" and given and depth < 8 and isinstance(form := file.look(forms.get(given[0])), Stream) and form.entries.get("Subtype") == "Form":
            own = tuple(file.look(form.entries.get("Matrix")) or _ONE)
            yield from ((*x[:5], -1, -1) for x in shown(file, _decoded(form, file.look), file.look(form.entries.get("Resources")) or resources, _times(own, state[0]), depth + 1))
        if op in ("T*", "'", '"'):
            line = matrix = _times((1, 0, 0, 1, 0, -leading), line)
        if op in ("Tj", "TJ", "'", '"') and given:
            parts, (width, texts) = given[-1] if isinstance(given[-1], list) else [given[-1]], state[1]
            said = []
            for p in parts:
                if isinstance(p, bytes) and texts is None:
                    said.append(p.decode("utf-16-be", "replace"))
                elif isinstance(p, bytes):
                    codes = [int.from_bytes(p[i : i + width], "big") for i in range(0, len(p), width)]
                    said.append("".join(texts[c] if c in texts else bytes([c]).decode("cp1252", "replace") if c < 256 and width == 1 else "" for c in codes))
                elif isinstance(p, (int, float)) and p < -GAP and said:
                    said.append(None)
            place = _times(matrix, state[0])
            yield op, "".join(" " if x is None else x for x in said), "".join(x for x in said if x is not None), place[4], place[5], begin, end
        given, begin = [], None


#: A move to the right of so many thousandths of the font size is a space.
GAP = 200


#: Rows that a task holds before it gives them on; a file of more is held whole.
ROWS = 1 << 14


def _operations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]
    names = ["_key", *(c.split()[0] for c in OPERATIONS.split(", "))]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    held: list[tuple] = []
    for batch in batches:
        for key, content in zip(batch.column(0), batch.column(1), strict=True):
            key, rows, n = key.as_py(), [], 0
            try:
                file = File.read(content.as_py() or b"")
                for k, (_, page, resources) in enumerate(file.pages()):
                    for op, text, bare, x, y, _, _ in shown(file, file.content(page), resources):
                        rows.append((key, k, n, op, text, bare, float(x), float(y), None))
                        n += 1
            except (Unreadable, zlib.error, ValueError, TypeError, AttributeError, KeyError, IndexError, RecursionError) as e:  # whatever a broken file leads to
                rows = [(key, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500])]
            held += rows
            if len(held) >= ROWS:
                yield made(held)
                held = []
    if held:
        yield made(held)


def pdf_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, content) of the files under path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")


def text_operations(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, page, ord, op, text, bare, x, y, error): a row per text operation, ord counted over the file; a file that cannot be read has one row with an error."""
    inside = files.select(F.col(key).cast("string").alias("_key"), F.col(content).alias("_content"))
    return inside.mapInArrow(_operations, f"_key string, {OPERATIONS}").withColumnRenamed("_key", key)


def printed_rows(operations: DataFrame, key: str = "path", near: float = 1.0) -> DataFrame:
    """(key, ord, page, text): neighbouring operations of a page whose baselines are within near points, joined by single spaces."""
    place = Window.partitionBy(key).orderBy("ord")
    new = (F.lag("page").over(place).isNull() | (F.lag("page").over(place) != F.col("page")) | (F.abs(F.lag("y").over(place) - F.col("y")) > near)).cast("long")
    dealt = operations.where("error is null").withColumn("_new", new).withColumn("_row", F.sum("_new").over(place))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: F.trim(x["text"]))
    return dealt.groupBy(key, "page", "_row").agg(F.array_join(F.filter(parts, lambda t: t != ""), " ").alias("text")).select(key, F.col("_row").alias("ord"), "page", "text")


def pdf_lines(files: DataFrame, key: str = "path", strict: bool = True) -> DataFrame:
    """(key, line_no, text) of printed rows that end in a line number.

    strict: a file that cannot be read or has no line numbers raises when it is reached; else it gives no rows.
    """
    ops = saved(text_operations(files, key), "operations")  # files are parsed once
    rows = printed_rows(ops, key).select(F.col(key).alias("paper_id"), "ord", "text")
    lines = numbered_lines(rows).withColumnRenamed("paper_id", key)
    if not strict:
        return lines
    told = ops.groupBy(key).agg(F.max("error").alias("_error"))
    found = files.select(F.col(key).cast("string").alias(key)).distinct().join(told, key, "left").join(lines, key, "left")
    fail = F.raise_error(F.concat(F.col(key), F.lit(": "), F.coalesce("_error", F.lit("no line numbers"))))
    return found.withColumn("line_no", F.when(F.col("line_no").isNull(), fail.cast("int")).otherwise(F.col("line_no"))).drop("_error").select(key, "line_no", "text")


def unnumbered_operations(operations: DataFrame, key: str = "path") -> DataFrame:
    """Text operations without running line numbers and the author's mark; errors stay."""
    operations = saved(operations, "operations")
    bare = operations.where("error is null").select(F.col(key).alias("paper_id"), "ord", F.col("bare").alias("text"))
    kept = without_line_numbers(bare).select(F.col("paper_id").alias(key), "ord")
    return operations.join(kept, [key, "ord"], "left_semi").unionByName(operations.where("error is not null")).select(*operations.columns)


def _written(value) -> bytes:
    if isinstance(value, Ref):
        return b"%d %d R" % (value.number, value.generation)
    if isinstance(value, Name):
        return b"/" + re.sub(rb"[^!-~]|[()<>\[\]{}/%#]", lambda m: b"#%02X" % m[0][0], value.encode("latin-1"))
    if isinstance(value, dict):
        return b"<< " + b" ".join(_written(Name(k)) + b" " + _written(v) for k, v in value.items()) + b" >>"
    if isinstance(value, list):
        return b"[" + b" ".join(map(_written, value)) + b"]"
    if isinstance(value, Word):
        return bytes(value)
    if isinstance(value, bytes):
        return b"<" + value.hex().encode() + b">"
    return {True: b"true", False: b"false", None: b"null"}[value] if value is None or isinstance(value, bool) else str(value).encode()


def clean(data: bytes) -> bytes:
    """The file with an update that leaves out line numbers and the author's mark; the same bytes if there are none."""
    data = data[max(0, data.find(b"%PDF-")) :]
    file, last, changed = File.read(data), 0, []
    for ref, page, resources in file.pages():
        content = file.content(page)
        out, at = [], 0
        for op, text, bare, _, _, begin, end in shown(file, content, resources):
            if op != "TJ" or begin < 0:
                continue
            n = int(bare) if LINE_NUMBER.fullmatch(bare) else -1
            follows = n == last + 1
            if follows or n == last == 0 or bare == AUTHOR:
                last = n if follows else last
                out.append(content[at:begin])
                at = end
        if out and ref is not None:
            changed.append((ref, page, b"".join([*out, content[at:]])))
    if not changed:
        return data
    free, parts, places, size = max(file.objects) + 1, [data if data.endswith(b"\n") else data + b"\n"], {}, 0
    size = len(parts[0])

    def put(number: int, generation: int, body: bytes) -> None:
        nonlocal size
        places[number] = (size, generation)
        parts.append(b"%d %d obj\n%s\nendobj\n" % (number, generation, body))
        size += len(parts[-1])

    for ref, page, content in changed:
        packed = zlib.compress(content)
        put(free, 0, b"<< /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(packed), packed))
        put(ref.number, ref.generation, _written(page | {Name("Contents"): Ref(free, 0)}))
        free += 1
    put(free, 0, b"<< /Author (Anonymous) >>")
    table = b"".join(b"%d 1\n%010d %05d n \n" % (k, *places[k]) for k in sorted(places))
    before = re.findall(rb"startxref[%s]+(\d+)" % _SPACE, data)
    trailer = {Name("Size"): free + 1, Name("Root"): Ref(file.catalog_at, 0), Name("Info"): Ref(free, 0)} | ({Name("Prev"): int(before[-1])} if before else {})
    parts.append(b"xref\n%strailer\n%s\nstartxref\n%d\n%%%%EOF\n" % (table, _written(trailer), size))
    return b"".join(parts)


def _cleaned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for key, content in zip(batch["_key"], batch["_content"], strict=True):
            try:
                made, error = clean(content or b""), None
            except (Unreadable, zlib.error, ValueError, TypeError, AttributeError, KeyError, IndexError, RecursionError) as e:
                made, error = None, f"{type(e).__name__}: {e}"[:500]
            yield pd.DataFrame({"_key": [key], "cleaned": [made], "error": [error]})


def cleaned_files(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, cleaned, error): each file's bytes without line numbers and the author's mark, or the reason why there are none."""
    inside = files.select(F.col(key).cast("string").alias("_key"), F.col(content).alias("_content"))
    return inside.mapInPandas(_cleaned, "_key string, cleaned binary, error string").withColumnRenamed("_key", key)
