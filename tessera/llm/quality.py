"""Quality rules on repetition: how much of a text lies inside n-grams and lines it repeats.

For several lengths n, rolling hashes of all n-word windows of a block of texts are
built in numpy (each length extends the hashes of the one before by one word). A
window is repeated when the same text holds its hash twice; the characters of words
under repeated windows, the first one included, are summed. Lines are hashed alike.
No shuffle: each task reads its rows once and keeps one block of texts in memory; a text longer
than a block is a block of its own and takes about 20 bytes of memory for each of its bytes.

Edge cases: a null or blank text has no words, fails the base rule and is rejected;
equal rows get equal verdicts; an empty table gives an empty table; other columns are
kept as they are, and verdict columns replace columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as tw
from .shared import map_texts, quoted

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class RepetitionRules:
    """Limits on shares; the n-gram shares are of word characters under repeated n-grams."""

    least_words: int = 20
    window: int = 8
    most_repeat_words_percent: int = 30
    gram_char_share: dict[int, float] = field(default_factory=lambda: {5: 0.40, 6: 0.38, 7: 0.36, 8: 0.34, 9: 0.32, 10: 0.30})
    most_line_char_share: float = 0.30


COLUMNS = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "gram_char_share": "double", "line_char_share": "double", "base_failed": "boolean", "kept": "boolean",
}


def _repeated(key: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    s = np.sort(key)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(key), bool)
    twice = np.unique(twice)
    at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    return twice[at] == key


def measure(column, rules: RepetitionRules) -> dict[str, np.ndarray]:
    """The columns of COLUMNS for each text."""
    w = tw.split(column)
    buf, n_texts = w.buf, len(w.offsets) - 1
    word_chars = tw.counts_in((buf & 0xC0) != 0x80, w.start, w.end)  # first bytes of characters
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    symbols = np.flatnonzero(symbol[buf])
    out = {
        "n_words": w.counts.astype(np.int64),
        "word_chars": tw.per_text(word_chars, w.first),
        "n_symbols": np.diff(np.searchsorted(symbols, w.offsets)).astype(np.int64),
    }
    total = np.maximum(out["word_chars"], 1)

    base = coefficient = None
    h, owner = tw.word_hashes(w), w.owner
    salt = tw.mix(np.arange(n_texts, dtype=np.uint64) + np.uint64(1))
    worst, failed = np.zeros(n_texts), np.zeros(n_texts, bool)
    coefficient = tw.coefficients(1, 7)[0]
    rolling, lengths = h.copy(), sorted({*rules.gram_char_share, rules.window})
    for n in range(1, max(lengths) + 1):
        if n > 1:
            rolling = rolling[:-1] * coefficient + h[n - 1 :] if len(h) >= n else rolling[:0]
        if n not in lengths:
            continue
        at = np.flatnonzero(tw.inner(w, n))
        again = at[_repeated(tw.mix(rolling[at]) ^ salt[owner[at]])]
        mask = tw.covered(len(w), again, n)
        if n == rules.window:
            base = tw.per_text(mask, w.first)
        if n in rules.gram_char_share:
            share = tw.per_text(word_chars * mask, w.first) / total
            worst = np.maximum(worst, share)
            failed |= share > rules.gram_char_share[n]
    out["n_repeat_words"] = base

    cut = np.flatnonzero(buf == 10)
    edges = np.unique(np.concatenate([w.offsets[:-1], cut + 1]))
    edges = edges[edges < len(buf)]
    line_end = np.append(edges[1:], len(buf))
    line_end = line_end - (buf[line_end - 1] == 10) if len(edges) else line_end
    has_word = np.searchsorted(w.start, line_end) > np.searchsorted(w.start, edges)
    edges, line_end = edges[has_word], line_end[has_word]
    line_of = np.searchsorted(w.offsets, edges, side="right") - 1
    key = tw.range_hashes(buf, edges, line_end) ^ salt[line_of]
    order = np.argsort(key, kind="stable")
    later = np.zeros(len(key), bool)
    later[order[1:]] = key[order[1:]] == key[order[:-1]]
    out["n_dup_lines"] = np.bincount(line_of[later], minlength=n_texts).astype(np.int64)
    spans = np.concatenate([[0], np.cumsum(word_chars)])
    line_chars = spans[np.searchsorted(w.start, line_end)] - spans[np.searchsorted(w.start, edges)]
    line_share = np.bincount(line_of[later], weights=line_chars[later], minlength=n_texts) / total
    out["gram_char_share"], out["line_char_share"] = worst, line_share
    out["base_failed"] = (out["n_words"] < rules.least_words) | (100 * base > rules.most_repeat_words_percent * out["n_words"])
    out["kept"] = ~out["base_failed"] & ~failed & (line_share <= rules.most_line_char_share)
    return out


def quality_verdicts(docs: DataFrame, text: str = "text", rules: RepetitionRules | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (None: all) and those of COLUMNS; kept is the verdict."""
    rules = rules or RepetitionRules()
    return map_texts(docs, text, lambda column: measure(column, rules), COLUMNS, keep)


def keep_good(docs: DataFrame, text: str = "text", rules: RepetitionRules | None = None) -> DataFrame:
    """The rows of docs whose text passes, with the columns of docs."""
    rules = rules or RepetitionRules()
    only = map_texts(docs.select(F.struct(*map(quoted, docs.columns)).alias("_in"), quoted(text)), text, lambda column: {"_kept": measure(column, rules)["kept"]}, {"_kept": "boolean"}, ["_in"])
    return only.where("_kept").select("_in.*")
