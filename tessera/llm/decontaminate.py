"""Benchmark decontamination by spaced-seed hashing and substitution-tolerant overlaps.

Words are lower-cased runs of letters and digits. A mask keeps some places of a span of words
and ignores the others, so a substituted word in an ignored place leaves the hash alone.

1. Masked hashes of every item set bits of a filter of 2 ** filter_bits bits: its size does
   not grow with the benchmark; a fuller filter only lets more places through.
2. One pass over the documents hashes every place under every mask. Places that pass the filter
   are written to the shared folder by pieces of a text, each with its words and as many on
   either side as the longest item has, so any laying of an item is there in full.
3. Those hashes join the items' hashes. A hit fixes an item and a diagonal.
4. On each diagonal the item is laid over the document. Items of least_words words or more: the
   longest stretch from an equal word to an equal word of which least_match are equal is the
   overlap; it counts if it has least_words words. Shorter items: the whole item is the overlap;
   it counts if least_match of its words are equal.

No accepted overlap lacks a hit. A stretch of which 0.8 are equal holds one of 13 to 25 words of
which 0.8 are equal (cut it into such pieces: one is as good as the whole), and MASKS hit every
choice of so many other words in it, which a test enumerates. A shorter item in which m words may
differ is cut into m + 2 blocks, of which two at least are equal: every two blocks are a mask.

Items of equal words are one class, searched once under its smallest item_id (item_classes lists
members). Every item of a word or more is searched. Edge cases: null texts and items match
nothing; equal rows get equal results; rows of one id with different texts are searched apart,
their results carry that id; a null doc_id is kept as null; empty tables give empty results; other
columns are not read; a text of any length is searched whole, in parts of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as tw
from .shared import NO_ID, quoted, saved, solid_id

#: Kept places, found by search: three masks of six places that hit every overlap of 13 words or more of which 0.8 are equal.
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 4, 6, 7, 8), (0, 2, 3, 10, 11, 12))
LEAST_WORDS, LEAST_MATCH = 13, 0.8
#: Words of a text whose hits make a piece (at least), and words hashed at a time.
PIECE, PART = 256, 1 << 16

NOT_WORD = np.ones(256, dtype=bool)
NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _least_equal(n: int, least_match: float) -> int:
    return ceil(least_match * n - 1e-9)


def short_masks(n: int, least_match: float) -> list[tuple[int, ...]]:
    """Kept places for items of n words: every two of as many blocks as words may differ, and two more."""
    blocks = [b.tolist() for b in np.array_split(np.arange(n), n - _least_equal(n, least_match) + 2)]
    return sorted({tuple(x + y) for x, y in combinations(blocks, 2)} if n > 1 else {(0,)})


def masks_of(lengths: list[int], least_words: int, least_match: float) -> dict[tuple[int, ...], list[tuple[int, int]]]:
    """Masks that begin at place 0, each with (item length, first place in the item); length 0: any item of least_words or more, any place."""
    out: dict[tuple[int, ...], list[tuple[int, int]]] = {m: [(0, 0)] for m in MASKS}
    for n in sorted(n for n in lengths if n < least_words):
        for kept in short_masks(n, least_match):
            out.setdefault(tuple(p - kept[0] for p in kept), []).append((n, kept[0]))
    return out


def masked_hashes(h: np.ndarray, masks: list[tuple[int, ...]]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(mask number, first place, hashes of the places from there on), by parts of the words; texts disregarded."""
    c = tw.coefficients(max(map(len, masks)), 16)
    salt = tw.mix(np.arange(len(masks), dtype=np.uint64) + np.uint64(77))
    reach = max(m[-1] for m in masks)
    for lo in range(0, len(h), PART):
        part = h[lo : lo + PART + reach]
        product = [part * x for x in c]
        for k, kept in enumerate(masks):
            n = min(PART, len(part) - kept[-1])
            if n > 0:
                total = np.full(n, salt[k])
                for j, place in enumerate(kept):
                    total += product[j][place : place + n]
                yield k, lo, tw.mix(total)


def _words(column) -> tw.Words:
    return tw.split(column, NOT_WORD, lower=True)


def _spoken(w: tw.Words, data: bytes, a: int, b: int) -> str:
    """Words a to b, joined by a space."""
    return b" ".join(data[i:j] for i, j in zip(w.start[a:b].tolist(), w.end[a:b].tolist(), strict=True)).decode()


def _told(benchmark: DataFrame, id: str, text: str) -> DataFrame:
    """(item, words, n) of each item with a word."""

    def run(batches):
        for batch in tw.passes(batches, "text"):
            w = _words(batch.column(1))
            data = w.raw()
            spoken = [_spoken(w, data, w.first[i], w.first[i + 1]) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spoken, pa.string()), pa.array(w.counts.astype(np.int32))], names=["item", "words", "n"])

    rows = benchmark.select(solid_id(id).alias("item"), quoted(text).cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(run, "item long, words string, n int").where("n > 0")


def item_classes(benchmark: DataFrame, id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, class_item_id): the smallest item_id of equal words, for each item with a word."""
    told = _told(benchmark, id, text)
    least = told.groupBy("words").agg(F.min("item").alias("class"))
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return told.join(least, "words").select(back("item").alias("item_id"), back("class").alias("class_item_id"))


def _item_seeds(items: DataFrame, masks: dict, least_words: int) -> DataFrame:
    shapes = list(masks)

    def run(batches):
        for batch in tw.passes(batches, "words"):
            w = tw.split(batch.column(1))
            item, counts = batch.column(0).to_numpy(), w.counts
            for k, lo, h in masked_hashes(tw.word_hashes(w), shapes):
                at = lo + np.arange(len(h))
                owner = np.searchsorted(w.first, at, side="right") - 1
                place, size = at - w.first[owner], counts[owner]
                good = np.zeros(len(at), bool)
                for n, first in masks[shapes[k]]:
                    good |= (size == n) & (place == first) if n else size >= least_words
                good &= place + shapes[k][-1] < size
                yield pa.RecordBatch.from_arrays([pa.array(h[good].view(np.int64)), pa.array(item[owner[good]]), pa.array(place[good].astype(np.int32))], names=["h", "item", "item_at"])

    return items.select("item", "words").mapInArrow(run, "h long, item long, item_at int")


def _filter(seeds: DataFrame, bits: int) -> np.ndarray:
    """2 ** bits bits; each hash sets those of its low and of its high part. At most 2 ** (bits - 6) rows reach the driver."""
    low = F.lit((1 << bits) - 1)
    place = F.explode(F.array(F.col("h").bitwiseAND(low), F.shiftrightunsigned("h", 32).bitwiseAND(low))).alias("p")
    rows = seeds.select(place).groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias("b"))
    table = np.zeros(1 << (bits - 6), np.int64)
    found = rows.toArrow()
    table[found.column("at").to_numpy()] = found.column("b").to_numpy()
    return table.view(np.uint64)


HITS = "doc long, mark long, piece int, start int, words string, hashes array<long>, places array<int>"


def _scan(masks: list[tuple[int, ...]], table, bits: int, longest: int):
    """(doc, mark, text) -> HITS: for each piece of a text with hits, its words, their hashes and their places in the text."""
    low, six, one = np.uint64((1 << bits) - 1), np.uint64(6), np.uint64(1)
    wide = max(PIECE, longest)

    def lit(h):
        return (table.value[(h >> six).astype(np.int64)] >> (h & np.uint64(63))) & one > 0

    def run(batches):
        for batch in tw.passes(batches, "text"):
            w = _words(batch.column(2))
            at, hs = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for k, lo, h in masked_hashes(tw.word_hashes(w), masks):
                hit = np.flatnonzero(lit(h & low))
                hit = hit[lit((h[hit] >> np.uint64(32)) & low)]
                place = lo + hit
                inside = place + masks[k][-1] < w.first[np.searchsorted(w.first, place, side="right")]
                at.append(place[inside])
                hs.append(h[hit[inside]])
            at, hs = np.concatenate(at), np.concatenate(hs)
            order = np.argsort(at, kind="stable")
            at, hs = at[order], hs[order]
            owner = np.searchsorted(w.first, at, side="right") - 1
            place = at - w.first[owner]
            piece = place // wide
            edge = np.flatnonzero((owner[1:] != owner[:-1]) | (piece[1:] != piece[:-1])) + 1
            cols, data = [[] for _ in range(6)], w.raw()
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(at)], strict=True):
                if a < b:
                    d = int(owner[a])
                    i, j = max(int(w.first[d]), int(at[a]) - longest), min(int(w.first[d + 1]), int(at[b - 1]) + longest)
                    for c, x in zip(cols, (d, piece[a], i - int(w.first[d]), _spoken(w, data, i, j), hs[a:b].view(np.int64), place[a:b].astype(np.int32)), strict=True):
                        c.append(x)
            pick = pa.array(cols[0], pa.int64())
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            made = [pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), *made], names=["doc", "mark", "piece", "start", "words", "hashes", "places"])

    return run


def best_overlap(equal: np.ndarray, least_match: float) -> tuple[int, int]:
    """The longest stretch [a, b) from an equal word to an equal word with a share of least_match equal; the first of ties."""
    at = np.flatnonzero(equal)
    if not len(at):
        return 0, 0
    worth = np.arange(len(at)) - least_match * at
    ahead = np.maximum.accumulate(worth[::-1])[::-1]  # does not rise: the last end that is good enough for each start
    last = np.searchsorted(-ahead, 1 - least_match - worth + 1e-9, side="right") - 1
    a = int(np.argmax(at[last] - at))
    return int(at[a]), int(at[last[a]]) + 1


def overlap(item: list[str], text: list[str], start: int, shift: int, least_words: int, least_match: float) -> tuple[int, int, int, int] | None:
    """(words, equal words, start, end in the text) of the overlap of an item laid at place `shift`; text begins at place `start`. None if it does not count."""
    a, b = max(0, start - shift), min(len(item), start + len(text) - shift)  # the item's words over the text
    if a >= b:
        return None
    equal = np.fromiter((x == y for x, y in zip(item[a:b], text[a + shift - start : b + shift - start], strict=True)), bool, b - a)
    if len(item) < least_words:
        n = int(equal.sum())
        return (len(item), n, a + shift, b + shift) if n >= _least_equal(len(item), least_match) else None
    x, y = best_overlap(equal, least_match)
    return (y - x, int(equal[x:y].sum()), a + x + shift, a + y + shift) if y - x >= least_words else None


FOUND = "doc long, mark long, item long, item_words int, overlap_words int, equal_words int, start_word int, end_word int"


#: Items whose words a task keeps at once.
ITEMS_HELD = 4096


def _verify(least_words: int, least_match: float):
    """(doc, mark, item, shifts, start, words, item_words) -> FOUND, the best overlap that counts of an item in a piece of a text."""

    def run(batches):
        items: dict[int, list[str]] = {}
        for batch in batches:
            rows, last, have = [], None, []
            for d, m, i, shifts, at, text, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text != last:
                    last, have = text, text.split(" ")
                if len(items) > ITEMS_HELD:
                    items.clear()
                item = items[i] = items.get(i) or words.split(" ")
                found = [x for s in shifts if (x := overlap(item, have, at, s, least_words, least_match))]
                if found:
                    rows.append((d, m, i, len(item), *max(found, key=lambda x: (x[1], x[0], x[2], x[3]))))
            kinds = [pa.int64()] * 3 + [pa.int32()] * 5
            made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(made, names=[x.split()[0] for x in FOUND.split(", ")])

    return run


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    least_words: int = LEAST_WORDS, least_match: float = LEAST_MATCH, filter_bits: int = 24,
) -> DataFrame:
    """doc (NO_ID for null), mark (the text's hash), item_id and the best overlap of each contaminated pair.

    A laxer rule than that of MASKS raises: overlaps would be lost.
    """
    if least_words < LEAST_WORDS or least_match < LEAST_MATCH:
        raise ValueError(f"the masks are made for overlaps of {LEAST_WORDS} words or more and {LEAST_MATCH} equal words or more")
    spark = docs.sparkSession
    told = _told(benchmark, item_id, item_text)
    items = saved(told.groupBy("words", "n").agg(F.min("item").alias("item"), F.count("*").cast("int").alias("same_items")), "items")
    lengths = [r.n for r in items.where(F.col("n") < least_words).select("n").distinct().collect()]  # least_words - 1 numbers at most
    longest = items.agg(F.max("n")).first()[0] or 1
    masks = masks_of(lengths, least_words, least_match)
    seeds = _item_seeds(items, masks, least_words)
    table = spark.sparkContext.broadcast(_filter(seeds, filter_bits))
    rows = docs.select(solid_id(id).alias("doc"), F.xxhash64(quoted(text)).alias("mark"), quoted(text).cast("string").alias("text"))
    hits = saved(rows.mapInArrow(_scan(list(masks), table, filter_bits, longest), HITS), "hits")
    place = ["doc", "mark", "piece"]
    each = hits.select(*place, F.explode(F.arrays_zip("hashes", "places")).alias("x")).select(*place, F.col("x.hashes").alias("h"), F.col("x.places").alias("at"))
    diagonals = each.join(seeds, "h").select(*place, "item", (F.col("at") - F.col("item_at")).alias("shift"))
    diagonals = diagonals.groupBy(*place, "item").agg(F.collect_set("shift").alias("shifts"))  # a piece has fewer than its words and the item's; its text is joined once an item
    laid = diagonals.join(hits.select(*place, "start", F.col("words").alias("text")).dropDuplicates(place), place).join(items.select("item", "words"), "item")
    found = laid.select("doc", "mark", "item", "shifts", "start", "text", "words").mapInArrow(_verify(least_words, least_match), FOUND)
    best = found.groupBy("doc", "mark", "item", "item_words").agg(F.max(F.struct("equal_words", "overlap_words", "start_word", "end_word")).alias("b"))
    return best.join(items.select("item", "same_items"), "item").select("doc", "mark", F.when(F.col("item") != NO_ID, F.col("item")).alias("item_id"), "item_words", "same_items", "b.*")


def contamination_report(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """id, item_id (of the item's class), item_words, same_items (size of the class), equal_words, overlap_words, start_word, end_word of each contaminated pair."""
    found = contaminated(docs, benchmark, id, text, **options)
    return found.drop("mark").select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias(id), *[c for c in found.columns if c not in ("doc", "mark")])


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs in which no item is found."""
    bad = contaminated(docs, benchmark, id, text, **options).select(F.col("doc").alias("_doc"), F.col("mark").alias("_mark")).distinct()
    bad = saved(bad, "contaminated")  # its size is then known: texts are shuffled only if it is too large to broadcast
    marked = docs.select(F.struct(*map(quoted, docs.columns)).alias("_in"), solid_id(id).alias("_doc"), F.xxhash64(quoted(text)).alias("_mark"))
    return marked.join(bad, ["_doc", "_mark"], "left_anti").select("_in.*")
