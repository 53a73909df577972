"""Exact encoding and decoding with a merge-type (BPE) SentencePiece model, by backtracking.

Encoding does not replay merges over a text. A pass of an Aho-Corasick automaton over a segment
gives the longest piece that starts at each place. From the left, the longest piece is taken
that is compatible with the piece before it; where none is, the place is set in a bit field of
failed places and the piece before it gives way to the next shorter one. Two neighbours are
compatible if merging the text of both gives these two again; only the merges that touch their
border are replayed, and verdicts are kept by pair. A sequence whose neighbours are all
compatible is the model's own encoding.

Segments are runs of marks and the characters up to the next mark, and runs of characters
that no piece holds (they become byte pieces): no merge crosses their borders. That pieces
have marks only in front is checked when the model is read. The ids of a segment are computed
once in a worker's store, which is emptied at STORE_SEGMENTS entries; segments of over
LONG_SEGMENT characters are not stored. Tasks are independent, nothing is shuffled.

The model file is a parameter and read on the driver. Models that normalise texts, lack byte
pieces or the mark in front of a text raise ValueError.

Edge cases: null and empty texts have no ids and decode to an empty text; a text of any length
is encoded whole (segments without a mark in megabytes cost time in proportion, not memory in
squares); text that looks like a control piece is plain text; equal rows get equal ids; an
empty table gives an empty one; a kept column named as a new one is replaced. Null ids decode
to an empty text; byte pieces that are no UTF-8 decode to U+FFFD for each byte.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import words as tw
from .shared import map_arrow, map_texts, quoted
from .token_counts import PIECES

MARK = "▁"
STORE_SEGMENTS, LONG_SEGMENT, STORE_PAIRS = 500_000, 64, 2_000_000
#: Characters of a segment that one search for longest pieces looks at; more than two of the longest pieces.
WINDOW = 256

codecs.register_error("tessera.each_byte", lambda e: ("�", e.start + 1))


def merged(text: str, order: dict[str, float]) -> tuple[list[str], tuple[str, str] | None]:
    """What merging leaves of a short text, best order first and then leftmost, and the parts of the last merge."""
    parts, last = list(text), None
    while True:
        found = [(order[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in order]
        if not found:
            return parts, last
        _, i = min(found)
        last = (parts[i], parts[i + 1])
        parts[i : i + 2] = ["".join(last)]


@dataclass
class Model:
    """The pieces by id (None: not a text piece), orders of merging (-score), and the ids of the 256 bytes."""

    pieces: list[str | None]
    order: dict[str, float]
    bytes_: list[int]
    unknown: int
    splits: dict[str, tuple[str, str]]

    @staticmethod
    def read(path: str = PIECES) -> Model:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        bytes_ = {sp.id_to_piece(i): i for i in range(n) if sp.is_byte(i)}
        probe = "  ﬁ ① x\t y  "
        if len(bytes_) != 256 or any(sp.is_unused(i) for i in range(n)) or sp.decode(sp.encode(probe)) != probe or sp.encode("x", out_type=str)[0][0] != MARK:
            raise ValueError(f"{path}: only models with byte pieces, a mark in front of a text and no normalisation are supported")
        pieces = [None if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) else sp.id_to_piece(i) for i in range(n)]
        order = {p: -sp.get_score(i) for i, p in enumerate(pieces) if p is not None}
        if any(MARK in p.lstrip(MARK) for p in order) or any(c not in order for p in order for c in p):
            raise ValueError(f"{path}: pieces with an inner mark, or with characters that are no pieces, are not supported")
        splits = {}
        for p in order:
            parts, last = merged(p, order)
            if len(parts) == 1 and last:
                splits[p] = last
        return Model(pieces, order, [bytes_[f"<0x{b:02X}>"] for b in range(256)], sp.unk_id(), splits)

    @cached_property
    def id_of(self) -> dict[str, int]:
        """Ids of the pieces that merging can make."""
        return {p: i for i, p in enumerate(self.pieces) if p is not None and (len(p) == 1 or p in self.splits)}

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            found.add_word(p, i)
        found.make_automaton()
        return found

    @cached_property
    def sizes(self) -> list[int]:
        return [len(p or "") for p in self.pieces]

    @cached_property
    def longest(self) -> int:
        return max(self.sizes)

    @cached_property
    def shorter(self) -> list[int]:
        """The longest piece that is a proper prefix of each piece; -1 if none."""
        out = [-1] * len(self.pieces)
        for p, i in self.id_of.items():
            out[i] = next((self.id_of[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.id_of), -1)
        return out

    def edge(self, piece: str, side: int) -> list[tuple[str, float]]:
        """The parts that stand at a piece's border while it is merged, each with the order of the merge that ends it."""
        chain, end = [], float("inf")
        while True:
            chain.append((piece, end))
            if len(piece) == 1:
                return chain[::-1]
            end = self.order[piece]
            piece = self.splits[piece][side]

    @cached_property
    def edges(self) -> tuple[dict[int, list], dict[int, list]]:
        """Right and left edges, by id; only of pieces whose merges come in the order of their making."""
        plain = {p for p in self.id_of if len(p) == 1}
        for p in sorted(self.splits, key=len):
            if all(x in plain and (len(x) == 1 or self.order[x] < self.order[p]) for x in self.splits[p]):
                plain.add(p)
        return {self.id_of[p]: self.edge(p, 1) for p in plain}, {self.id_of[p]: self.edge(p, 0) for p in plain}

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the text of both pieces leaves these two."""
        right, left = self.edges
        if a not in right or b not in left:
            return merged(self.pieces[a] + self.pieces[b], self.order)[0] == [self.pieces[a], self.pieces[b]]
        xs, ys, order, i, j = right[a], left[b], self.order.get, 0, 0
        while True:
            (x, x_end), (y, y_end) = xs[i], ys[j]
            across = order(x + y)
            # of equal orders the leftmost merge comes first: inside a, across, inside b
            if across is not None and across < x_end and across <= y_end:
                return False
            if x_end <= y_end:
                if i + 1 == len(xs):
                    return True
                i += 1
            else:
                j += 1

    @cached_property
    def segment(self) -> re.Pattern:
        known = "".join(re.escape(c) for c in self.id_of if len(c) == 1 and c != MARK)
        return re.compile(f"{MARK}+[{known}]*|[{known}]+|[^{MARK}{known}]+")

    @cached_property
    def pairs(self) -> dict[int, bool]:
        return {}

    def encode_segment(self, s: str) -> list[int]:
        """The ids of one match of segment."""
        if s[0] not in self.order:
            return [self.bytes_[b] for b in s.encode()]
        search, sizes, shorter, known, base, n = self.automaton.iter_long, self.sizes, self.shorter, self.pairs, len(self.sizes), len(s)
        if len(known) > STORE_PAIRS:
            known.clear()
        out, at, last, failed, judge = [], 0, -1, None, self.judged
        while at < n:
            stop, stuck = n if n - at <= WINDOW else at + WINDOW - self.longest, False
            for _, token in search(s[at : at + WINDOW]):  # the longest pieces, one after another, as far as they fit
                if at > stop:
                    break
                if failed and failed[at + sizes[token] >> 3] >> (at + sizes[token] & 7) & 1:
                    stuck = True
                    break
                if last >= 0:
                    fits = known.get(last * base + token)
                    if not (judge(last, token) if fits is None else fits):
                        stuck = True
                        break
                out.append(token)
                at += sizes[token]
                last = token
            while stuck:
                token = shorter[token]
                if token < 0:  # nothing fits here: the piece before gives way
                    failed = failed or bytearray(n // 8 + 1)
                    failed[at >> 3] |= 1 << (at & 7)
                    token = out.pop()
                    at -= sizes[token]
                    last = out[-1] if out else -1
                    continue
                to = at + sizes[token]
                if (not failed or not failed[to >> 3] >> (to & 7) & 1) and (last < 0 or judge(last, token)):
                    out.append(token)
                    at, last, stuck = to, token, False
        return out

    def judged(self, a: int, b: int) -> bool:
        """As compatible, kept by pair."""
        pair = a * len(self.sizes) + b
        found = self.pairs.get(pair)
        if found is None:
            found = self.pairs[pair] = self.compatible(a, b)
        return found

    def segments(self, text: str) -> list[str]:
        """Pieces of the marked text between which nothing merges, some of them empty; each is one match of segment or several."""
        if "\0" in text:
            return self.segment.findall(MARK + text.replace(" ", MARK))
        marked = f"\0{MARK}" + text.replace(" ", MARK).replace(MARK, f"\0{MARK}").replace("\n", "\0\n\0")
        while f"{MARK}\0{MARK}" in marked:
            marked = marked.replace(f"{MARK}\0{MARK}", MARK + MARK)
        return marked.split("\0")

    def encode_part(self, part: str) -> list[int]:
        """The ids of one of segments."""
        found = self.segment.findall(part)
        return self.encode_segment(part) if len(found) == 1 else [i for s in found for i in self.encode_segment(s)]

    def encode(self, text: str) -> list[int]:
        return [i for part in self.segments(text) for i in self.encode_part(part)] if text else []

    @cached_property
    def decimals(self) -> list[str]:
        return list(map(str, range(len(self.pieces))))

    @cached_property
    def surfaces(self) -> list[bytes]:
        out = [b"" if p is None else p.replace(MARK, " ").encode() for p in self.pieces]
        out[self.unknown] = " ⁇ ".encode()
        for b, i in enumerate(self.bytes_):
            out[i] = bytes([b])
        return out

    def decode(self, ids: list[int]) -> str:
        surfaces = self.surfaces
        raw = b"".join(map(surfaces.__getitem__, ids))
        first = next((i for i in ids if surfaces[i]), self.unknown)
        if (self.pieces[first] or "").startswith(MARK):
            raw = raw[1:]
        return raw.decode(errors="tessera.each_byte")


class _Store(dict):
    """Segments to their ids, as the bytes of an int array."""

    model: Model | None = None

    def __missing__(self, part: str) -> bytes:
        found = self[part] = array("i", self.model.encode_part(part)).tobytes()
        return found


_STORE = _Store()
_STORE_OF: list = [None]


def _encode_block(column, model: Model, key: str) -> dict[str, pa.Array]:
    if _STORE_OF[0] != key or len(_STORE) > STORE_SEGMENTS:
        _STORE.clear()
        _STORE.model, _STORE_OF[0] = model, key
    buf, off = tw.text_buffer(column)
    parts, ends = [], [0]
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        found = model.segments(buf[a:b].tobytes().decode()) if b > a else []
        before = len(_STORE)
        parts.append(b"".join(map(_STORE.__getitem__, found)))
        ends.append(ends[-1] + len(parts[-1]) // 4)
        for s in [s for s in islice(reversed(_STORE), len(_STORE) - before) if len(s) > LONG_SEGMENT]:
            del _STORE[s]
    return {"ids": pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.frombuffer(b"".join(parts), np.int32))).cast(pa.list_(pa.int32()))}


def encoded(docs: DataFrame, text: str = "text", model: Model | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (None: all) and ids, an array of int."""
    held = docs.sparkSession.sparkContext.broadcast(model or Model.read())  # a vocabulary: its size does not grow with the corpus
    key = uuid.uuid4().hex  # names this model in the workers
    return map_texts(docs, text, lambda column: _encode_block(column, held.value, key), {"ids": "array<int>"}, keep)


def _lists(column) -> Iterator[list[int]]:
    """The lists of an Arrow column, one at a time; null is empty."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)).tolist()
    return (flat[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False))


def decoded(rows: DataFrame, ids: str = "ids", model: Model | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns keep of rows (None: all) and decoded, the text of the ids."""
    held = rows.sparkSession.sparkContext.broadcast(model or Model.read())
    return map_arrow(rows, quoted(ids).cast("array<int>"), lambda column: {"decoded": map(held.value.decode, _lists(column))}, {"decoded": "string"}, keep)


def digests(docs: DataFrame, text: str = "text", model: Model | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs, n_tokens, ids_sha256 (decimal ids with commas between) and decoded_sha256: texts encoded and decoded again in one pass."""
    held = docs.sparkSession.sparkContext.broadcast(model or Model.read())
    key = uuid.uuid4().hex
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def measure(column):
        model = held.value
        decimal, n, ids_sha, text_sha = model.decimals, [], [], []
        for ids in _lists(_encode_block(column, model, key)["ids"]):
            n.append(len(ids))
            ids_sha.append(sha(",".join(map(decimal.__getitem__, ids))))
            text_sha.append(sha(model.decode(ids)))
        return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}

    return map_texts(docs, text, measure, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, keep)
