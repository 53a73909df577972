"""Exact substring dedup by super-k-mers: every later copy of a run of `width` words goes.

A window is `width` consecutive words of a document. Its minimiser is the least hash among
its `gram`-word grams, the leftmost of equals; consecutive windows that share that gram form
a super-k-mer. Equal windows have equal minimisers at the same place in them, so:

1. A hash that is the minimiser of only one super-k-mer of the corpus proves its windows
   unique; that super-k-mer need not travel. Counting them moves a hash and a count for each.
2. The other super-k-mers travel as one packed string (words joined by a space) and are
   folded by content, keeping the first place of each (partial sums before the shuffle).
3. Folded strings are dealt and sorted by their minimiser. A task streams them, some minimisers
   at a time: it sorts their windows by their words; of equal ones, the first document and place
   is the original. A minimiser of HOT_ROWS super-k-mers or more is hot: its folded strings are
   cut into single windows, which are folded by their words, so each is dealt by itself. So no
   group that a task sorts has HOT_ROWS strings, whatever the corpus.
4. The first places return to their documents, where every window of a travelled
   super-k-mer that is not a first place is a copy and the words it covers go.

Documents are ordered by id; rows of one id (null ids too, which sort first) by the hash of
their text. Windows compare by their words, never by hashes alone. Edge cases: a null text has no
words, is kept and stays null; texts shorter than a window lose nothing; rows of one id and text
are one document, whose result each gets; an empty table gives an empty one; other columns stay
as they are, whatever their names; a very long text is one row, scanned whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from . import words as tw
from .shared import quoted, saved, solid_id

#: A super-k-mer has width - gram + 1 windows at most: 62 or fewer, for they are bits of a long.
WIDTH, GRAM = 20, 5
#: A minimiser of so many super-k-mers is hot and is cut into windows. Bytes of strings that a task sorts at a time.
HOT_ROWS, SORT_BYTES = 512, 4 << 20
#: A place is (first word << 8) | (hot << 7) | windows.
_HOT, _WINDOWS = 128, 63


def super_kmers(w: tw.Words, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window (as a word index), windows and minimiser of each super-k-mer."""
    n = len(w) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, span, done = tw.gram_hashes(tw.word_hashes(w), gram), width - gram + 1, 1
    seat = np.arange(len(low))
    while done < span:  # the leftmost minimum of `done` grams from each place on, doubled
        step = min(done, span - done)
        a, b = low[: len(low) - step], low[step:]
        seat, low, done = np.where(a <= b, seat[: len(a)], seat[step:]), np.minimum(a, b), done + step
    at = np.flatnonzero(tw.inner(w, width))
    if not len(at):
        return at, at, at
    low, seat = low[at], seat[at]
    new = np.ones(len(at), bool)
    new[1:] = (seat[1:] != seat[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    return at[begin], np.diff(np.append(begin, len(at))), low[begin].view(np.int64)


def _scan(width: int, gram: int, places: bool):
    """(doc, ord, text) -> the minimiser of each super-k-mer, and its place."""

    def run(batches):
        for batch in tw.passes(batches, "text"):
            w = tw.split(batch.column(2))
            start, n, low = super_kmers(w, width, gram)
            if not places:
                yield pa.RecordBatch.from_arrays([pa.array(low)], names=["low"])
                continue
            owner = pa.array(np.searchsorted(w.first, start, side="right") - 1)
            place = (start - w.first[owner.to_numpy()]) << 8 | n
            yield pa.RecordBatch.from_arrays([pa.array(low), batch.column(0).take(owner), batch.column(1).take(owner), pa.array(place)], names=["low", "doc", "ord", "place"])

    return run


def _own(lists: pa.Array) -> list[np.ndarray]:
    """Each row's places, ascending."""
    values, n = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return [np.sort(x) for x in np.split(values, np.cumsum(n)[:-1])] if len(n) else []


def _zip(batches):
    """(doc, ord, text, _row) with each text compressed: it crosses the network once."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        for part in tw.slices(batch, "text"):
            buf, off = tw.text_buffer(part.column(2))
            data, there = buf.tobytes(), part.column(2).is_valid().to_pylist()
            zipped = [squeeze(data[a:b]) if t else None for a, b, t in zip(off[:-1].tolist(), off[1:].tolist(), there, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(zipped, pa.binary()), pa.array(np.diff(off)), part.column(3)], names=["doc", "ord", "zip", "size", "_row"])


def _unzipped(batches):
    """(batch, texts) in passes of bounded text size."""
    grow = zstandard.ZstdDecompressor()
    for batch in batches:
        size = np.cumsum(batch.column(3).to_numpy())
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + tw.PASS_BYTES, side="right")))
            part = batch.slice(at, to - at)
            yield part, pa.array([None if z is None else grow.decompress(z) for z in part.column(2).to_pylist()], pa.large_binary())
            at = to


def _pack(width: int, gram: int):
    """Zipped texts with places -> each named super-k-mer's words joined by a space."""

    def run(batches):
        for batch, texts in _unzipped(batches):
            own = _own(batch.column(5))
            some = np.flatnonzero([len(x) > 0 for x in own])
            if not len(some):
                continue
            own = [own[i] for i in some]
            w = tw.split(texts.take(pa.array(some)))
            start, _, low = super_kmers(w, width, gram)
            place = np.concatenate(own)
            owner = np.repeat(np.arange(len(own)), [len(x) for x in own])
            begin, n = (place >> 8) + w.first[owner], place & _WINDOWS
            low = low[np.searchsorted(start, begin)]
            data, a, b = w.raw(), w.start[begin].tolist(), w.end[begin + n + width - 2].tolist()
            packed = [b" ".join(data[i:j].split()) for i, j in zip(a, b, strict=True)]
            of = pa.array(some[owner])
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(packed, pa.binary()), batch.column(0).take(of), batch.column(1).take(of), pa.array(place)], names=["low", "packed", "doc", "ord", "place"])

    return run


def _cut(width: int):
    """(packed, doc, ord, place) of super-k-mers -> each window of its own."""

    def run(batches):
        for batch in tw.passes(batches, "packed", 1 << 18):
            w = tw.split(batch.column(0))
            at = np.flatnonzero(tw.inner(w, width))
            owner = np.searchsorted(w.first, at, side="right") - 1
            data, of = w.raw(), pa.array(owner)
            packed = [data[i:j] for i, j in zip(w.start[at].tolist(), w.end[at + width - 1].tolist(), strict=True)]
            moved = ((batch.column(3).to_numpy()[owner] >> 8) + (at - w.first[owner])) << 8 | 1
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), batch.column(1).take(of), batch.column(2).take(of), pa.array(moved)], names=["packed", "doc", "ord", "place"])

    return run


FIRSTS = "doc long, ord long, first long, bits long"


def _first_places(width: int):
    """(low, packed, doc, ord, place) sorted by low -> FIRSTS: first word and the bits of the windows seen there first."""

    def firsts(t: pa.Table) -> pa.RecordBatch:
        doc, ord, place = (t.column(c).to_numpy() for c in ("doc", "ord", "place"))
        order = np.lexsort((place, ord, doc))
        packed = t.column("packed").take(pa.array(order)).combine_chunks()
        doc, ord, place = doc[order], ord[order], place[order]
        w = tw.split(packed)
        at = np.flatnonzero(tw.inner(w, width))
        owner = np.searchsorted(w.first, at, side="right") - 1
        data = w.raw()
        window = [data[i:j] for i, j in zip(w.start[at].tolist(), w.end[at + width - 1].tolist(), strict=True)]
        first: dict[bytes, int] = {}
        for i in sorted(range(len(window)), key=window.__getitem__):  # stable: equal windows stay in document order
            first.setdefault(window[i], i)
        seen = np.fromiter(first.values(), np.int64, len(first))
        bits = np.zeros(len(doc), np.int64)
        np.bitwise_or.at(bits, owner[seen], 1 << (at[seen] - w.first[owner[seen]]))
        some = np.flatnonzero(bits)
        return pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (doc, ord, place >> 8, bits)], names=["doc", "ord", "first", "bits"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in tw.slices(batch, "packed", SORT_BYTES):
                low = part.column(0)
                if size >= SORT_BYTES and held:
                    # whole minimisers go; the last one may go on in the next part
                    t = pa.Table.from_batches([*held, part]).combine_chunks()
                    key = t.column("low").to_numpy()
                    upto = int(np.searchsorted(key, key[-1]))
                    if upto:
                        yield firsts(t.slice(0, upto))
                    held, size = t.slice(upto).to_batches(), t.slice(upto).nbytes
                elif len(low):
                    held.append(part)
                    size += part.nbytes
        if held:
            yield firsts(pa.Table.from_batches(held))

    return run


def _removed(width: int, counts: np.ndarray, first: np.ndarray, places, firsts) -> np.ndarray:
    """Which words go: those under windows of travelled super-k-mers that are not first places."""
    edge = np.zeros(int(first[-1]) + 1, np.int64)
    for i, own in enumerate(_own(places)):
        if not len(own):
            continue
        copy = np.zeros(max(0, int(counts[i]) - width + 1), bool)
        start, n = own >> 8, own & _WINDOWS
        for k in range(int(n.max())):
            copy[start[n > k] + k] = True
        mine = firsts[i].as_py()
        if mine:
            at, bits = np.array([(f["first"], f["bits"]) for f in mine], dtype=np.int64).T
            for k in range(int(bits.max()).bit_length()):
                copy[at[bits >> k & 1 > 0] + k] = False
        at = np.flatnonzero(copy)
        np.add.at(edge, first[i] + at, 1)
        np.subtract.at(edge, first[i] + at + width, 1)
    return np.cumsum(edge[:-1]) > 0


def _joined(docs: DataFrame, id: str, text: str, width: int, gram: int, keep: list[str]) -> DataFrame:
    """(doc, ord, zip, size, _row) of each row, with its travelled places and first places.

    One plan in which the zipped texts, the places and the folded super-k-mers are each
    shuffled once and read again where they are used again (the same exchange). Texts that share
    an id are told apart by ord, the hash of their text; of other rows it is 0.
    """
    rows = docs.select(solid_id(id).alias("doc"), quoted(text).cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *(quoted(c) for c in keep)).alias("_row"))
    again = saved(rows.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc"), "again")
    repeated = not again.isEmpty()
    if not repeated:
        rows = rows.withColumn("ord", F.lit(0).cast("long"))
    else:
        rows = rows.join(again.withColumn("again", F.lit(True)), "doc", "left").withColumn("ord", F.when(F.col("again"), F.xxhash64("text")).otherwise(F.lit(0).cast("long")))
    node = ["doc", "ord"]
    rows = rows.select(*node, "text", "_row")
    texts = rows.select(*node, "text")
    if repeated:
        texts = texts.dropDuplicates(node)  # rows of one id and text have the same places: they are looked for once, and each row gets them
    shared = texts.mapInArrow(_scan(width, gram, False), "low long").groupBy("low").agg(F.count("*").alias("n")).where("n > 1").select("low", F.when(F.col("n") >= HOT_ROWS, _HOT).otherwise(0).cast("long").alias("hot"))
    shared = saved(shared, "shared")  # a plain side, so that AQE can split the join where a hash is hot
    places = texts.mapInArrow(_scan(width, gram, True), "low long, doc long, ord long, place long").join(shared, "low")
    places = places.groupBy(*node).agg(F.collect_list(F.col("place").bitwiseOR(F.col("hot"))).alias("places"))
    zip_schema = StructType([*rows.select(*node).schema, StructField("zip", BinaryType()), StructField("size", LongType()), rows.schema["_row"]])
    zipped = rows.mapInArrow(_zip, zip_schema).join(places, node, "left").select(*node, "zip", "size", "_row", "places")
    once = zipped.dropDuplicates(node) if repeated else zipped
    packed = once.mapInArrow(_pack(width, gram), "low long, packed binary, doc long, ord long, place long")
    earliest = F.min(F.struct(*node, "place")).alias("at")
    folded = packed.groupBy("low", "packed").agg(earliest).select("low", "packed", "at.*")
    hot = F.col("place").bitwiseAND(F.lit(_HOT)) > 0
    whole = folded.where(~hot).repartition("low").sortWithinPartitions("low").mapInArrow(_first_places(width), FIRSTS)
    single = folded.where(hot).select("packed", *node, "place").mapInArrow(_cut(width), "packed binary, doc long, ord long, place long").groupBy("packed").agg(earliest)
    single = single.select("at.doc", "at.ord", F.shiftright("at.place", 8).alias("first"), F.lit(1).cast("long").alias("bits"))
    firsts = whole.unionByName(single).groupBy(*node).agg(F.collect_list(F.struct("first", "bits")).alias("firsts"))
    return zipped.join(firsts, node, "left").select(*node, "zip", "size", "_row", "places", "firsts")


def _apply(docs: DataFrame, id: str, text: str, width: int, gram: int, keep: list[str], columns: dict[str, str], measure) -> DataFrame:
    """(_row, columns): _row holds keep."""
    found = _joined(docs, id, text, width, gram, keep)
    schema = StructType([found.schema["_row"]])
    for c, kind in columns.items():
        schema = schema.add(c, kind)

    def run(batches):
        for batch, texts in _unzipped(batches):
            w = tw.split(texts)
            gone = _removed(width, w.counts, w.first, batch.column(5), batch.column(6))
            made = measure(w, gone, texts)
            yield pa.RecordBatch.from_arrays([batch.column(4), *(pa.array(x) for x in made)], names=["_row", *columns])

    return found.mapInArrow(run, schema)


def _kept_words(w: tw.Words, gone: np.ndarray) -> list[bytes]:
    """Each text's kept words, joined by one space."""
    data, out = w.raw(), []
    # runs of kept words; inside a run, white space is folded by split()
    stay = ~gone
    for i in range(len(w.first) - 1):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if a == b:
            out.append(b"")
            continue
        mine = stay[a:b]
        if mine.all():
            out.append(b" ".join(data[w.start[a] : w.end[b - 1]].split()))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
        out.append(b" ".join(b" ".join(data[w.start[a + x] : w.end[a + y - 1]].split()) for x, y in edge.reshape(-1, 2).tolist()))
    return out


def removal_report(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""

    def measure(w, gone, _):
        return w.counts.astype(np.int64), tw.per_text(gone, w.first), [hashlib.sha256(x).hexdigest() for x in _kept_words(w, gone)]

    columns = {"n_words": "long", "n_removed": "long", "kept_sha256": "string"}
    return _apply(docs, id, text, width, gram, [id], columns, measure).select(F.col("_row").getField(id).alias(id), *columns)


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """docs with repeated runs of words removed from text; n_chars, if there, follows.

    A text that loses no word is unchanged; else its kept words are joined by one space. Rows
    that lose every word are dropped.
    """
    keep = [c for c in docs.columns if c != text]

    def measure(w, gone, column):
        lost = tw.per_text(gone, w.first)
        texts = [(k if n else t).decode() if t is not None else None for t, n, k in zip(column.to_pylist(), lost, _kept_words(w, gone), strict=True)]
        return pa.array(texts, pa.string()), lost, w.counts.astype(np.int64)

    out = _apply(docs, id, text, width, gram, keep, {"_text": "string", "_lost": "long", "_words": "long"}, measure)
    out = out.where("_lost = 0 or _lost < _words")
    made = {c: F.col("_row").getField(c) for c in keep} | {text: F.col("_text")}
    if "n_chars" in keep:
        made["n_chars"] = F.when(F.col("_lost") == 0, made["n_chars"]).otherwise(F.length("_text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(made[c].alias(c) for c in docs.columns))
