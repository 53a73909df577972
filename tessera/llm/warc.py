"""WARC archives with a two-level capture index, written and read from Spark tasks.

Writing: every page is a record, a gzip member of its own, in archive files of bounded size in
the shared folder. Of pages with equal payloads of at least REVISIT_BYTES, the one with the
largest page_id is the response and the others are revisits that name it and hold no payload.
Each task gives its files names of its own attempt and reports (file, offset, length) of each
record; only reported records count, so a lost or repeated attempt leaves stray files at most.

Index: captures are sorted by the reversed-host key of their URL (SURT) and page_id, across
range partitions. Each partition is a part: its lines in compressed blocks of BLOCK_LINES, and beside
them its sparse directory, with the first key of each block, its offset and length. The table of
parts (first key and file) has a row for each partition. A look-up bisects the parts, a part's directory
and a block's lines, each read by range when it is first needed; found records are read in file
order, near ones by one range. Many look-ups are sorted by key first, so that a task reads a block once.

Files are opened with pyarrow.fs from the folder's URI, so the folder may be any store that it
knows. Edge cases: null html is an empty payload, null url an empty one; a URL that does not parse is
its own key; a null page_id is written without a number and is never the response of others; repeated
pages (equal page_id and html) of a revisited payload are responses alike; an empty table gives no
files and an empty result; other columns are not read; a payload of any size is one record, held whole.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import NO_ID, new_folder, quoted, saved, solid_id

REVISIT_BYTES = 1000
#: Bytes of an archive file beyond which a task begins another; lines of an index block.
FILE_BYTES, BLOCK_LINES = 64 << 20, 1000
#: Bytes of a file that one task reads in a row; of a range read; between records that one range takes in.
STRETCH_BYTES, RANGE_BYTES, GAP_BYTES = 8 << 20, 4 << 20, 64 << 10
DATE = "2024-01-01T00:00:00Z"
PLACE = "page_id long, key string, type string, file string, offset long, length long"


def surt(url: str) -> str:
    """The URL's sort key: lower-case host labels reversed, then port, path and query; of a URL that does not parse, the URL after a bracket."""
    url = (url or "").strip()
    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
    except ValueError:
        return ")" + re.sub(r"\s", "%20", url)
    try:
        port = parts.port
    except ValueError:
        host, port = parts.netloc.lower(), None
    host = re.sub(r"^www\d*\.", "", host)
    standard = {"http": 80, "https": 443}.get(parts.scheme)
    tail = f":{port}" if port and port != standard else ""
    key = ",".join(reversed(host.split("."))) + tail + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return re.sub(r"\s", "%20", key)


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit that names the response's record."""
    kind = "response" if refers_to is None else "revisit"
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", re.sub(r"[\r\n]", " ", url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    fields.append(("Content-Length", str(len(body))))
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """The fields and the payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def records(stream):
    """(offset, length, record) of each gzip member of a stream."""
    offset, z, out, used = 0, zlib.decompressobj(31), [], 0
    while True:
        data = stream.read(1 << 20)
        if not data:
            if used:
                raise EOFError("the archive ends inside a record")
            return
        while data:
            out.append(z.decompress(data))
            if not z.eof:
                used += len(data)
                break
            used += len(data) - len(z.unused_data)
            yield offset, used, b"".join(out)
            data, offset = z.unused_data, offset + used
            z, out, used = zlib.decompressobj(31), [], 0


def _number(urn: str) -> int | None:
    digits = urn.strip("<>").rpartition(":")[2]
    return int(digits) if digits else None


def with_responses(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, html, digest and refers_to: the response's page_id for revisits."""
    rows = pages.select(quoted(id).cast("long").alias("page_id"), F.coalesce(quoted(url), F.lit("")).alias("url"), F.coalesce(quoted(html), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    large = rows.where(F.octet_length("html") >= REVISIT_BYTES)
    keep = large.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1 and response is not null").drop("n")
    keep = saved(keep, "warc-responses")  # its size is then known: pages are shuffled only if it is too large to broadcast
    revisit = (F.col("page_id") < F.col("response")) | F.col("page_id").isNull() & F.col("response").isNotNull()
    return rows.join(keep, "digest", "left").select("page_id", "url", "html", "digest", F.when(revisit, F.col("response")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, id: str = "page_id", url: str = "url", html: str = "html") -> tuple[str, DataFrame]:
    """The folder, and where each record lies (PLACE); the table of places is written once."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    rows = with_responses(pages, id, url, html)

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out = name = None
        at = 0
        try:
            for batch in batches:
                places = []
                for page, link, text, digest, refers in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    data = member(record(page, link, text.encode(), digest, refers))
                    out.write(data)
                    places.append((page, surt(link), "response" if refers is None else "revisit", name, at, len(data)))
                    at += len(data)
                if places:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*places, strict=True), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["page_id", "key", "type", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return folder, saved(rows.mapInArrow(run, PLACE), "warc-places")


def _row(fields: dict[str, str], payload: bytes, file: str, offset: int) -> tuple:
    response = fields["WARC-Type"] == "response"
    digest = hashlib.sha1(payload).hexdigest() if response else fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = len(payload) if response else int(fields["WARC-Payload-Length"])
    return _number(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], _number(fields.get("WARC-Refers-To", "")), fields["WARC-Target-URI"], file, offset


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string, offset long"


def read_archives(folder: str, files: DataFrame) -> DataFrame:
    """Every record of the archive files named in files(file), read from first to last; a file is one task's work."""

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    rows = []
                    for offset, _, data in records(stream):
                        rows.append(_row(*parse(data), name, offset))
                        if len(rows) == 1000:
                            yield _read_batch(rows)
                            rows = []
                    if rows:
                        yield _read_batch(rows)

    return files.select("file").distinct().mapInArrow(run, READ)


_READ = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "file", "offset"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _READ, strict=True)], names=names)


def write_index(folder: str, places: DataFrame) -> DataFrame:
    """The table of parts: first_key, first_page, file (of the blocks), blocks, lines."""
    solid = F.coalesce("page_id", F.lit(NO_ID))
    ordered = places.withColumn("page", solid).repartitionByRange("key", "page").sortWithinPartitions("key", "page")

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(f"{base}/index", recursive=True)
        name = f"index/cdx-{uuid.uuid4().hex}.gz"
        out, at, n, lines, head, blocks = None, 0, 0, [], None, []

        def flush():
            nonlocal out, at, n
            out = out or fs.open_output_stream(f"{base}/{name}", compression=None)
            data = member(("\n".join(lines) + "\n").encode())
            out.write(data)
            blocks.append((*head, at, len(data)))
            at, n = at + len(data), n + len(lines)
            lines.clear()

        for batch in batches:
            for key, page, kind, file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                head = (key, page) if not lines else head
                lines.append(f"{key} {page} " + json.dumps({"type": kind, "file": file, "offset": offset, "length": length}))
                if len(lines) == BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if blocks:
            out.close()
            with fs.open_output_stream(f"{base}/{name}.directory", compression=None) as f:
                f.write(member(json.dumps(blocks).encode()))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*blocks[0][:2], name, len(blocks), n), kinds, strict=True)], names=["first_key", "first_page", "file", "blocks", "lines"])

    inside = ordered.select("key", "page", "type", "file", "offset", "length")
    return saved(inside.mapInArrow(run, "first_key string, first_page long, file string, blocks long, lines long"), "warc-parts")


def part_list(parts: DataFrame) -> list[tuple[str, int, str]]:
    """(first_key, first_page, file) in order: a row for each range partition of the index, however many captures it has."""
    return sorted(tuple(r) for r in parts.select("first_key", "first_page", "file").collect())


class Captures:
    """Look-ups in the index of a folder; the directory and the block read last are kept."""

    def __init__(self, folder: str, parts: list[tuple[str, int, str]]):
        self.fs, self.base = pafs.FileSystem.from_uri(folder)
        self.parts = parts
        self.first = [p[:2] for p in parts]
        self.part = self.block = (None, None, None)

    def _directory(self, i: int) -> tuple[list, list]:
        if self.part[0] != i:
            with self.fs.open_input_file(f"{self.base}/{self.parts[i][2]}.directory") as f:
                blocks = json.loads(zlib.decompress(f.read(), 31))
            self.part = (i, [tuple(b[:2]) for b in blocks], blocks)
        return self.part[1:]

    def _block(self, i: int, k: int) -> tuple[list, list]:
        if self.block[0] != (i, k):
            _, _, offset, length = self._directory(i)[1][k]
            with self.fs.open_input_file(f"{self.base}/{self.parts[i][2]}") as f:
                lines = zlib.decompress(f.read_at(length, offset), 31).decode().split("\n")[:-1]
            found = list(map(_capture, lines))
            self.block = ((i, k), [(c["key"], c["page_id"]) for c in found], found)
        return self.block[1:]

    def between(self, low: tuple[str, int], high: tuple[str, int]) -> Iterator[dict]:
        """Captures from (key, page) low to high, both included."""
        for i in range(max(0, bisect.bisect_left(self.first, low) - 1), bisect.bisect_right(self.first, high)):
            first = self._directory(i)[0]
            for k in range(max(0, bisect.bisect_left(first, low) - 1), bisect.bisect_right(first, high)):
                keys, found = self._block(i, k)
                yield from found[bisect.bisect_left(keys, low) : bisect.bisect_right(keys, high)]

    def of_url(self, url: str) -> list[dict]:
        key = surt(url)
        return list(self.between((key, NO_ID), (key, 2**63 - 1)))


def _capture(line: str) -> dict:
    """A line of the index: its key, page_id (NO_ID for none) and place."""
    head, _, tail = line.rpartition(" {")
    key, _, page = head.rpartition(" ")
    return json.loads("{" + tail) | {"key": key, "page_id": int(page)}


def located(folder: str, parts: DataFrame, pages: DataFrame, id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, file, offset, length) of every capture of the pages' URLs and ids, found by bisection in tasks; equal pages are looked up once."""
    listed = part_list(parts)

    def keys(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in batch.column(1).to_pylist()], pa.string()), batch.column(0)], names=["key", "page"])

    def find(batches):
        captures, last = Captures(folder, listed), None
        for batch in batches:
            found = []
            for target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if target != last:
                    found += captures.between(target, target)
                last = target
            pick = [[c[x] for c in found] for x in ("page_id", "file", "offset", "length")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(pick, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["page_id", "file", "offset", "length"])

    wanted = pages.select(solid_id(id).alias("page"), F.coalesce(quoted(url), F.lit("")).alias("url")).mapInArrow(keys, "key string, page long")
    wanted = wanted.repartitionByRange("key", "page").sortWithinPartitions("key", "page")
    return wanted.mapInArrow(find, "page_id long, file string, offset long, length long")


def read_located(folder: str, places: DataFrame) -> DataFrame:
    """READ of the records at places (file, offset, length): each task takes stretches of files in order and reads near records by one range."""

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        opened, f = None, None
        try:
            for batch in batches:
                wanted, rows = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)), []
                for file, at, size, inside in near_ranges(wanted):
                    if file != opened:
                        if f is not None:
                            f.close()
                        opened, f = file, fs.open_input_file(f"{base}/{file}")
                    data = f.read_at(size, at)
                    rows += [_row(*parse(zlib.decompress(data[o - at : o - at + n], 31)), file, o) for o, n in inside]
                if rows:
                    yield _read_batch(rows)
        finally:
            if f is not None:
                f.close()

    dealt = places.select("file", "offset", "length").repartition(F.col("file"), F.expr(f"offset DIV {STRETCH_BYTES}")).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, READ)


def near_ranges(wanted: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(file, offset, length, records in it) of ordered records: one range while the gap is GAP_BYTES or less and the range RANGE_BYTES or less."""
    inside: list[tuple[int, int]] = []
    name = None
    for file, at, size in wanted:
        if inside and (file != name or at - sum(inside[-1]) > GAP_BYTES or at + size - inside[0][0] > RANGE_BYTES):
            yield name, inside[0][0], sum(inside[-1]) - inside[0][0], inside
            inside = []
        name = file
        inside.append((at, size))
    if inside:
        yield name, inside[0][0], sum(inside[-1]) - inside[0][0], inside


def read_record(folder: str, file: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record, by a range read."""
    fs, base = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{base}/{file}") as f:
        return parse(zlib.decompress(f.read_at(length, offset), 31))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write archives and index, then look every page up in the index and read its record: a row per page."""
    folder, places = write_archives(pages)
    found = located(folder, write_index(folder, places), pages)
    return read_located(folder, found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
