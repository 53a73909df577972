"""Vectorised word splitting and hashing over Arrow string columns.

A word is a maximal run of bytes outside space, tab, LF, VT, FF and CR. In UTF-8
those bytes never occur inside a multi-byte character, so the split works on the
raw Arrow buffer without decoding. Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Text bytes that one numpy pass holds at a time; a longer text is a pass of its own.
PASS_BYTES = 2 << 20

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, multiply, shift)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def coefficients(n: int, stream: int = 0) -> np.ndarray:
    """n odd 64-bit multipliers, the same in every process."""
    i = np.arange(1, n + 1, dtype=_U) + _U(stream << 40)
    return mix(i * _U(0x9E3779B97F4A7C15)) | _U(1)


#: Bytes that range_hashes spreads out at a time, and places after which coefficients repeat with another factor.
_SPREAD, _TURN = 1 << 17, 1 << 10
_COEF = coefficients(_TURN)


@dataclass
class Words:
    """Words of several texts: byte ranges in buf; text i owns words first[i]:first[i + 1]."""

    buf: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def raw(self) -> bytes:
        return self.buf.tobytes()


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and len + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    o = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, o - o[0]


def split(column, separators: np.ndarray = SPACE, lower: bool = False) -> Words:
    """Words of every text; separators says which bytes part words."""
    buf, off = text_buffer(column)
    if lower:
        buf = LOWER[buf]
    return split_buffer(buf, off, separators)


def split_buffer(buf: np.ndarray, off: np.ndarray, separators: np.ndarray = SPACE) -> Words:
    n = len(buf)
    inside = ~separators[buf] if n else np.zeros(0, bool)
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0] = after[-1] = False
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        edge = off[:-1][off[:-1] < n]
        before[edge] = False
        after[edge[edge > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(buf, off, start, end, np.searchsorted(start, off))


def _spread(buf: np.ndarray, start: np.ndarray, size: np.ndarray, at: int = 0) -> np.ndarray:
    """The sum of each range's bytes times coefficients by place; places begin at `at`."""
    head = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(head, size)
    value = buf[np.repeat(start, size) + place].astype(_U)
    value += _U(1)
    place += at
    value *= _COEF[place & _TURN - 1]
    if int(size.max()) + at > _TURN:
        value *= (2 * (place >> 10) + 1).astype(_U)
    return np.add.reduceat(value, head)


def range_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range (ranges ascend and do not overlap); _SPREAD bytes are spread out at a time."""
    if not len(start):
        return np.zeros(0, _U)
    size = end - start
    out = mix(size.astype(_U) * _U(0x9E3779B97F4A7C15))
    full = np.flatnonzero(size)
    start, size = start[full], size[full]
    total, i = np.cumsum(size), 0
    while i < len(full):
        j = max(i + 1, int(np.searchsorted(total, total[i] - size[i] + _SPREAD, side="right")))
        if size[i] > _SPREAD:
            for at in range(0, int(size[i]), _SPREAD):
                out[full[i : i + 1]] += _spread(buf, start[i : i + 1] + at, np.minimum(size[i : i + 1] - at, _SPREAD), at)
        else:
            out[full[i:j]] += _spread(buf, start[i:j], size[i:j])
        i = j
    return mix(out)


def counts_in(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many flags each range (not empty, ascending) holds."""
    if not len(start):
        return np.zeros(0, np.int64)
    edge = np.empty(2 * len(start), np.int64)
    edge[0::2], edge[1::2] = start, end
    return np.add.reduceat(np.append(flags.view(np.uint8), np.uint8(0)), edge, dtype=np.int64)[::2]


def word_hashes(w: Words) -> np.ndarray:
    return range_hashes(w.buf, w.start, w.end)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive words, texts disregarded."""
    c, m = coefficients(n, 1), max(0, len(h) - n + 1)
    out = np.zeros(m, _U)
    for j in range(n):
        out += h[j : j + m] * c[j]
    return mix(out)


def inner(w: Words, n: int) -> np.ndarray:
    """Which of the n-word windows of gram_hashes lie in one text."""
    last = np.repeat(w.first[1:], w.counts)[: max(0, len(w) - n + 1)]
    return np.arange(len(last)) + n <= last


def slices(batch: pa.RecordBatch, text: str, most: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about that many text bytes, one row at least."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size.astype(np.int64) + 64)
    at = 0
    while at < batch.num_rows:
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def passes(batches, text: str, most: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, text, most)


def covered(n: int, start: np.ndarray, width: int) -> np.ndarray:
    """Which of n places lie in [s, s + width) for some s of start."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.subtract.at(edge, np.minimum(start + width, n), 1)
    return np.cumsum(edge[:n]) > 0


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values (one per word) over each text."""
    total = np.concatenate([[0], np.cumsum(values.astype(np.int64))])
    return total[first[1:]] - total[first[:-1]]
