"""Fuzzy string ratios (normalised Indel similarity, 0..100) as Arrow-batched UDFs, and the quote filter."""

from __future__ import annotations

from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as tx


def _places(a: str) -> dict[str, int]:
    """For each letter, the bits of its places in a."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    return places


def lcs(a: str, b: str, places: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, by bit rows (one Python integer a row)."""
    places = _places(a) if places is None else places
    full = (1 << len(a)) - 1
    row = full
    for held in map(places.get, b, repeat(0)):
        u = row & held
        row = row + u | row - u  # carries past the last place change none below it
    return len(a) - (row & full).bit_count()


def ratio(a: str, b: str) -> float:
    """200 * lcs / (|a| + |b|); 100 for two empty strings."""
    return 200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


#: Lengths of runs of letters that windows are judged by, and the hashed names that runs have.
RUNS, RUN_NAMES = (4, 3), 1 << 16


@lru_cache(maxsize=128)
def _runs(text: str, size: int) -> np.ndarray:
    """The hashed runs of so many letters of a text, by their starts."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    made = np.zeros(max(0, len(x) - size + 1), np.uint32)
    for k in range(size):
        made = made * np.uint32(0x9E3779B1) + x[k : k + len(made)]
    return (made * np.uint32(0x85EBCA6B) >> 16).astype(np.uint16)


def _hopeful(a: str, b: str, share: float) -> np.ndarray | None:
    """Starts of b's windows (from 1 - |a| on) that may have 2 * lcs >= share * (|a| + |window|), in order; None for any.

    No such window is lost. A letter of the window outside the common subsequence ends `size` of its runs at most, a gap in a
    ends size - 1. The runs that are left are runs of a, so a window needs that many which a has; equal hashes let more through.
    """
    n, at = len(a), None
    for size in RUNS:
        factor = (2 * size - 1) * share / 2 - (size - 1)
        if factor <= 0 or n < size:
            continue
        held = np.zeros(RUN_NAMES, bool)
        held[_runs(a, size)] = True
        total = np.concatenate([[0], np.cumsum(held[_runs(b, size)])])
        least = share / (2 - share) * n  # letters of a window at the edge
        if total[-1] < factor * (n + least) - size + 1 - 1e-6:
            return np.zeros(0, np.int64)
        at = np.arange(1 - n, len(b)) if at is None else at
        low, high = np.maximum(at, 0), np.minimum(at + n, len(b))
        last = len(total) - 1
        inside = total[np.minimum(np.maximum(high - size + 1, low), last)] - total[np.minimum(low, last)]
        at = at[(inside >= factor * (n + high - low) - size + 1 - 1e-6) & (high - low >= least - 1e-6)]
        if not len(at):
            break
    return at


def best_window(a: str, b: str, cutoff: float = 0.0) -> float:
    """The greatest ratio of the shorter string with any window of the longer, up to its length; 0 below the cutoff.

    A shift by one place changes the common subsequence by one at most, so windows that cannot
    reach the best so far are skipped; so are those with too few of the shorter string's runs of letters to reach the cutoff.
    """
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    n, best, i = len(a), max(cutoff - 1e-9, 0.0), 1 - len(a)
    hopeful = _hopeful(a, b, best / 100)
    if hopeful is not None and not len(hopeful):
        return 0.0
    places = _places(a)
    while i < len(b):
        if hopeful is not None:
            k = int(np.searchsorted(hopeful, i))
            if k == len(hopeful):
                break
            i = int(hopeful[k])
        part = b[max(i, 0) : i + n]
        common = lcs(a, part, places)
        best = max(best, 200 * common / (n + len(part)))
        short = best * (n + len(part)) / 200 - common
        i += max(1, int(short / 1.5))  # the need itself moves by half a letter a shift at most
    return best if best >= cutoff else 0.0


def set_ratio(a: str, b: str) -> float:
    """Ratio over word sets: common words, and common words with either rest; 100 if one set holds the other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    left, right = (" ".join(filter(None, (both, " ".join(sorted(d))))) for d in (x - y, y - x))
    return max(ratio(left, right), *((ratio(both, left), ratio(both, right)) if both else (0.0,)))


#: Bits of a word, classes of letters (equal classes let more through); words and letters of the pairs judged at once; letters of the longest texts that are.
WORD, CLASSES, WORDS, LETTERS, LONGEST, LONGER = 64, 128, 2048, 1 << 21, 512, 4096


def _letters(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) % CLASSES


def _slices(a: list[str], b: list[str]):
    """Pairs of like size at once: their numbers and lengths of a; for each word, pair and class the places in a, which end with the last word's last bit; where to look for each next letter of b, longest b first."""
    n, m = (np.array([len(t) for t in x], np.int64) for x in (a, b))
    words = 1 << np.ceil(np.log2(np.maximum(1, -(-n // WORD)))).astype(np.int64)
    order, lo = np.lexsort((-m, words)), 0
    ordered = words[order]
    while lo < len(order):
        size = int(ordered[lo])
        at = order[lo : min(lo + max(1, min(WORDS // size, LETTERS // max(1, int(m[order[lo]])))), int(np.searchsorted(ordered, size, "right")))]
        lo += len(at)
        x, y, nx, my = _letters([a[i] for i in at]), _letters([b[i] for i in at]), n[at], m[at]
        pair = np.repeat(np.arange(len(at)), nx)
        place = np.arange(len(x)) - np.repeat(np.cumsum(nx) - nx, nx) + (WORD * size - nx)[pair]
        held = np.zeros((size, len(at) * CLASSES), np.uint64)
        np.bitwise_or.at(held.reshape(-1), (place // WORD * len(at) + pair) * CLASSES + x, np.uint64(1) << (place % WORD).astype(np.uint64))
        pair = np.repeat(np.arange(len(at)), my)
        look = np.zeros((int(my[0]), len(at)), np.int64)
        look[np.arange(len(y)) - np.repeat(np.cumsum(my) - my, my), pair] = pair * CLASSES + y
        yield at, nx, held, [row[:k] for row, k in zip(look, np.searchsorted(-my, -np.arange(my[0])), strict=True)]


def least_edits(a: list[str], b: list[str]) -> np.ndarray:
    """At most the letters to take out of a and to put in until it is a part of b, for each pair; b passes once, by words of bits of all pairs."""
    out, top = np.zeros(len(a), np.int64), np.uint64(WORD - 1)
    for at, n, held, look in _slices(a, b):
        spare = np.maximum(0, WORD * len(held) - n - WORD * np.arange(len(held))[:, None])  # places before a: as if each met its letter
        free = np.where(spare < WORD, (np.uint64(1) << (spare % WORD).astype(np.uint64)) - np.uint64(1), ~np.uint64(0))
        up, down, now, least = ~free, np.zeros_like(free), n.copy(), n.copy()  # where a place needs one edit more or less than the place before
        for row in look:
            k, more, less = len(row), np.uint64(0), np.uint64(0)
            for w in range(len(held)):
                met, p, q = held[w].take(row) | free[w, :k], up[w, :k], down[w, :k]
                ends = met & p
                on = p ^ ends
                fell = (p + ends + less) ^ on  # the place before needs one edit less than with the letter before
                starts = q | ~(met | p | q | fell)
                rose = ((starts | on) + starts + more) ^ on
                less, more = (ends | on & fell) >> top, (starts | on & rose) >> top
                up[w, :k], down[w, :k] = fell | ~met & (~(rose | q) | rose & p), rose & (met | q)
            now[:k] += more.view(np.int64) - less.view(np.int64)
            np.minimum(least[:k], now[:k], out=least[:k])
        out[at] = least
    return out


def most_common(a: list[str], b: list[str]) -> np.ndarray:
    """At least the length of the longest common subsequence, for each pair; as lcs, for all pairs at once."""
    out, top = np.zeros(len(a), np.int64), np.uint64(WORD - 1)
    for at, _, held, look in _slices(a, b):
        rows = np.full((len(held), len(at)), ~np.uint64(0))
        for row in look:
            k, carry = len(row), np.uint64(0)
            for w in range(len(held)):
                before = rows[w, :k]
                u = before & held[w].take(row)
                after = before + u + carry
                carry = (u | before & ~after) >> top
                rows[w, :k] = after | before ^ u
        out[at] = np.bitwise_count(~rows).sum(axis=0)
    return out


def _may_be_windows(a: list[str], b: list[str], cutoff: float) -> np.ndarray:
    """Whether best_window may reach the cutoff: of n letters and a window's m, (1 - cutoff) * (n + m) are edits at most, and m <= n. No pair that does is lost."""
    n, m = np.sort(np.array([[len(t) for t in x] for x in (a, b)], np.int64), axis=0)
    may = (n > LONGEST) | (m > LONGER)
    rest = np.flatnonzero((n > 0) & ~may)
    ordered = [(x, y) if len(x) <= len(y) else (y, x) for x, y in ((a[i], b[i]) for i in rest)]
    may[rest] = least_edits([x for x, _ in ordered], [y for _, y in ordered]) <= np.maximum(0, (1 - cutoff / 100) * 2 * n[rest]) + 1e-6
    return may


def _may_be_sets(a: list[str], b: list[str], cutoff: float) -> np.ndarray:
    """Whether set_ratio may reach the cutoff: by the lengths of the words in common and of both sets, then by the subsequence. No pair that does is lost."""
    share = cutoff / 100 - 1e-9
    sets = {t: set(t.split()) for t in {*a, *b}}
    sizes = {t: sum(map(len, x)) + len(x) - 1 for t, x in sets.items()}
    may, asked, left, right = np.zeros(len(a), bool), [], [], []
    for i, (s, t) in enumerate(zip(a, b, strict=True)):
        x, y, n, m = sets[s], sets[t], sizes[s], sizes[t]
        if n < 0 or m < 0:
            continue
        both = x & y
        common = sum(map(len, both)) + len(both) - 1
        if both and 2 * common >= share * (common + min(n, m)) or min(n, m) > LONGEST:
            may[i] = True
        elif 2 * min(n, m) >= share * (n + m):
            asked.append(i)
            said = sorted(both)
            for into, d in ((left, x - both), (right, y - both)):
                into.append(" ".join(said + sorted(d)))
    ordered = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(left, right, strict=True)]
    may[asked] = 2 * most_common([x for x, _ in ordered], [y for _, y in ordered]) >= share * np.array([len(x) + len(y) for x, y in ordered])
    return may


def alike(a: list[str], b: list[str], partial: float, token_set: float) -> list[bool]:
    """Whether one holds the other or a ratio reaches its cutoff, for each pair: bounds of all pairs first, then the ratios of those that may."""
    may = zip(a, b, _may_be_windows(a, b, partial), _may_be_sets(a, b, token_set), strict=True)
    return [bool((w and (x in y or y in x or best_window(x, y, partial) >= partial)) or (s and set_ratio(x, y) >= token_set)) for x, y, w, s in may]


def _pairs(f, **options):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y, **options) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


partial_ratio = _pairs(best_window)
token_set_ratio = _pairs(set_ratio)


def looks_quoted(sentence: Column) -> Column:
    """Marked as a quotation, bold or heading."""
    t = F.trim(sentence)
    return t.startswith(">") | t.startswith("#") | (t.startswith("**") & t.endswith("**") & (F.length(t) > 3))


def contains_either(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


#: Pairs and bytes that are judged at once.
PAIRS, BYTES = 1 << 16, 1 << 26


def _joined(batches):
    """Tables of about so many pairs."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= PAIRS or sum(x.nbytes for x in held) >= BYTES:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def without_quotes(sentences: DataFrame, reviews: DataFrame, keys: list[str], text: str = "sentence", review: str = "review_sentence", partial: float = 85, token_set: float = 80) -> DataFrame:
    """sentences that quote no review sentence of the same keys.

    Marks remove sentences in the JVM; pairs of the others are judged many at a time, and only the few
    whose bounds allow it are compared one by one.
    """
    kept = sentences.where(~looks_quoted(F.col(text))).withColumn("_n", tx.collapse(F.col(text)))
    said = reviews.select(*keys, tx.collapse(F.col(review)).alias("_r")).where("_r <> ''").distinct()

    def close(batches):
        for table in _joined(batches):
            found = alike(table["_n"].to_pylist(), table["_r"].to_pylist(), partial, token_set)
            yield from table.select([*keys, text]).filter(pa.array(found, pa.bool_())).to_batches()

    pairs = kept.join(said, keys).select(*keys, text, "_n", "_r")
    held = pairs.mapInArrow(close, pairs.select(*keys, text).schema).distinct()
    return kept.join(held, [*keys, text], "left_anti").select(*sentences.columns)
