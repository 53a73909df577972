"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

Pre-tokens are the words of a text (split at ASCII white space), each with the word-begin
mark in front. The pieces are those of a public SentencePiece model, whose file is a parameter
and is read on the driver; a piece of rank r (its place among the ordinary pieces) has
probability in proportion to 1 / (r + ZIPF_SHIFT). A character without a piece costs a token
for each UTF-8 byte.

The distinct new pre-tokens of a block are walked as a trie, in sorted order: the forward
scores (best score and fewest pieces of each prefix) of the path stay on a stack, so a prefix
that several pre-tokens share is scored once. The count of pieces at a terminal is stored; a
text's count is the sum over its pre-tokens. Tasks are independent and nothing is shuffled.
The store of a worker is emptied at STORE_WORDS entries; words of over LONG_WORD bytes are not
stored.

Edge cases: null and blank texts have no tokens; a word of any length is scored whole; equal
rows get equal counts; an empty table gives an empty one; other columns are kept.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from math import log

import numpy as np
from pyspark.sql import DataFrame

from . import words as tw
from .shared import map_texts

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
ZIPF_SHIFT = 2.7
STORE_WORDS, LONG_WORD = 500_000, 64


@dataclass(frozen=True)
class Pieces:
    """Log-probabilities of pieces, the cost of a byte, and the lengths of pieces by their last two characters."""

    score: dict[str, float]
    byte: float
    lengths: dict[str, tuple[int, ...]]

    @staticmethod
    def of(pieces: list[str]) -> Pieces:
        """Pieces in the order of their ranks."""
        total = log(sum(1 / (r + ZIPF_SHIFT) for r in range(len(pieces))))
        score = {}
        for r, p in enumerate(pieces):
            score.setdefault(p, -log(r + ZIPF_SHIFT) - total)
        ends: dict[str, set[int]] = {}
        for p in score:
            ends.setdefault(p[-2:], set()).add(len(p))
        return Pieces(score, -log(len(pieces) + ZIPF_SHIFT) - total - 1, {e: tuple(sorted(n)) for e, n in ends.items()})


def load_pieces(path: str = PIECES) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return Pieces.of([model.id_to_piece(i) for i in plain])


def trie_counts(pre_tokens: list[str], pieces: Pieces) -> dict[str, int]:
    """The number of pieces of each pre-token's best segmentation; ties go to fewer pieces."""
    get, lengths, byte = pieces.score.get, pieces.lengths, pieces.byte
    best, count, path, out = [0.0], [0], "", {}
    for token in sorted(pre_tokens):
        shared, most = 0, min(len(path), len(token))
        while shared < most and path[shared] == token[shared]:
            shared += 1
        del best[shared + 1 :], count[shared + 1 :]
        for j in range(shared + 1, len(token) + 1):
            last = token[j - 1]
            cost = get(last)
            if cost is None:
                n = len(last.encode())
                top, pieces_used = best[j - 1] + n * byte, count[j - 1] + n
            else:
                top, pieces_used = best[j - 1] + cost, count[j - 1] + 1
            if j > 1:
                for n in lengths.get(token[j - 2 : j], ()):
                    if n > j:
                        break
                    cost = get(token[j - n : j])
                    if cost is not None:
                        value = best[j - n] + cost
                        if value > top or value == top and count[j - n] + 1 < pieces_used:
                            top, pieces_used = value, count[j - n] + 1
            best.append(top)
            count.append(pieces_used)
        path = token
        out[token] = count[-1]
    return out


_STORE: dict[bytes, int] = {}
_STORE_OF: list = [None]


def _counts(column, pieces: Pieces, key: str) -> dict[str, np.ndarray]:
    if _STORE_OF[0] != key or len(_STORE) > STORE_WORDS:
        _STORE.clear()
        _STORE_OF[0] = key
    buf, off = tw.text_buffer(column)
    data = buf.tobytes()
    texts = [data[a:b].split() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    new = set().union(*texts).difference(_STORE)
    found = trie_counts([MARK + w.decode() for w in new], pieces)
    known = {w: found[MARK + w.decode()] for w in new}
    _STORE.update(known)
    n = [sum(map(_STORE.__getitem__, t)) for t in texts]
    for w in [w for w in known if len(w) > LONG_WORD]:
        del _STORE[w]
    return {"n_pre_tokens": np.array([len(t) for t in texts], np.int64), "n_tokens": np.array(n, np.int64)}


def token_counts(docs: DataFrame, text: str = "text", pieces: Pieces | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (None: all), n_pre_tokens and n_tokens."""
    pieces = pieces or load_pieces()
    held = docs.sparkSession.sparkContext.broadcast(pieces)  # a vocabulary: its size does not grow with the corpus
    key = uuid.uuid4().hex  # names these pieces in the workers
    return map_texts(docs, text, lambda column: _counts(column, held.value, key), {"n_pre_tokens": "long", "n_tokens": "long"}, keep, most=4 << 20)
