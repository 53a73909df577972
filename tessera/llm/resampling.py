"""Importance resampling towards a target text's distribution of hashed word n-grams.

Texts are split into words (runs of ASCII digits and letters and of all characters beyond ASCII,
A-Z lower-cased). Features are all runs of 1 to `longest` consecutive words, joined by one space,
repeats counted; a feature's bucket is the CRC-32 of its UTF-8 bytes modulo the number of buckets.

The document-by-bucket counts are a sparse matrix, saved once as Parquet in compressed-row
blocks: a row of the table holds the ids of some documents, the bounds of each document's
entries, and the buckets and counts of the entries. Rows and row groups are small, so that
what a task holds does not grow with its share of the table. Column sums of the two matrices give the
two distributions, with one added to every bucket; the gain of a bucket is
floor(1000 ln(target share / share)). The product of the matrix with the gains, over the
number of features and floored, is a document's weight. Noise from a hash of the id
(Gumbel distributed) makes drawing the highest scores a weighted draw without replacement.

Sums leave a task as one row a bucket at most; the vector of gains has one entry a bucket and
is the only thing that is broadcast. Scores are whole numbers: a count by score finds the
lowest score drawn, and only rows from it upwards are sorted, by ranges, and numbered by the
offsets of the ranges.

Edge cases: null texts and texts without words have no features and weight 0; a null id is
written as nothing in the hash and sorts first; repeated rows are scored alike and each takes
a rank; equal scores go to the smaller id (equal ids: to the row with more features, then the
greater weight); an empty table gives an empty one, and an empty target leaves all gains to the
documents' own distribution. A text of any length is counted whole; it has one entry a bucket
at most. Other columns are not read, so their names may clash.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as tw
from .shared import quoted, saved

BUCKETS, LONGEST, PERCENT, LEAST_WORDS, SEED = 10_000, 1, 10, 20, "2024"
#: Entries of the matrix that a block holds at most, but for a document more.
BLOCK_ENTRIES = 1 << 12
#: The saved matrix is written in row groups of about so many encoded bytes. Spark's reader decodes 4,096 rows of a row group at once, some 30 times as many bytes: larger ones fill an executor.
ROW_GROUP = {"parquet.block.size": 2 << 20, "parquet.block.size.row.check.max": 100}
#: Bytes of features that are hashed place by place; longer ones go to zlib one at a time.
SHORT = 64

BREAKS = np.ones(256, dtype=bool)
BREAKS[0x30:0x3A] = BREAKS[0x61:0x7B] = BREAKS[0x80:] = False
#: The checksum's state s becomes _STEP[(s ^ b) & 255] ^ (s >> 8) at a byte b; checksums of one byte differ as its entries do.
_STEP = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)


def crc32_ranges(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC-32 of each byte range."""
    size = end - start
    out = np.full(len(start), 0xFFFFFFFF, np.uint32)
    short = np.flatnonzero(size <= SHORT)
    by_size = short[np.argsort(-size[short], kind="stable")]
    left, at, state = size[by_size], start[by_size], out[by_size]
    for j in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -j, side="left"))  # ranges with a byte at place j
        state[:n] = _STEP[(state[:n] ^ buf[at[:n] + j]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out[by_size] = state
    out ^= np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(size > SHORT).tolist():
        out[k] = zlib.crc32(buf[start[k] : end[k]])
    return out


def features(column, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text and the bucket of each feature, and the number of words of each text."""
    w = tw.split(column, BREAKS, lower=True)
    n_words, owner = w.counts, w.owner
    buf, start, end = w.buf, w.start, w.end
    if longest > 1 and len(w):  # words side by side, a space after each
        size = w.end - w.start + 1
        end = np.cumsum(size)
        start = end - size
        place = np.arange(int(end[-1])) - np.repeat(start, size) + np.repeat(w.start, size)
        buf = np.append(w.buf, np.uint8(32))[np.minimum(place, len(w.buf))]
        buf[end - 1] = 32
        end = end - 1
    texts, found = [], []
    for n in range(1, longest + 1):
        whole = np.flatnonzero(tw.inner(w, n))
        texts.append(owner[whole])
        found.append(crc32_ranges(buf, start[whole], end[whole + n - 1]) % np.uint32(buckets))
    return np.concatenate(texts), np.concatenate(found).astype(np.int64), n_words


BLOCK = "ids array<long>, n_words array<int>, n_features array<long>, bounds array<int>, bucket array<int>, count array<int>"


def count_matrix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """The matrix of counts in compressed-row blocks: a row per block (BLOCK)."""
    inside = docs.select(quoted(id_col).cast("long").alias("_id"), quoted(text).cast("string").alias("_text"))

    def run(batches):
        for batch in tw.passes(batches, "_text"):
            owner, bucket, n_words = features(batch.column(1), longest, buckets)
            key, count = np.unique(owner * buckets + bucket, return_counts=True)
            n = batch.num_rows
            edges = np.concatenate([[0], np.cumsum(np.bincount(key // buckets, minlength=n))])
            block = (edges[:-1] + 3 * np.arange(n)) // BLOCK_ENTRIES  # a document's own numbers take the room of three entries
            cuts = np.flatnonzero(np.diff(block, prepend=-1, append=block[-1] + 1))
            bounds = np.concatenate([edges[i : j + 1] - edges[i] for i, j in pairwise(cuts.tolist())])
            columns = (batch.column(0), n_words, np.bincount(owner, minlength=n), bounds, key % buckets, count)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            places = (cuts, cuts, cuts, cuts + np.arange(len(cuts)), edges[cuts], edges[cuts])
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), c if isinstance(c, pa.Array) else pa.array(c, k)) for c, k, at in zip(columns, kinds, places, strict=True)]
            yield pa.RecordBatch.from_arrays(lists, names=["ids", "n_words", "n_features", "bounds", "bucket", "count"])

    return inside.mapInArrow(run, BLOCK)


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: the sum of each column that has entries."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            b, c = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (0, 1))
            np.add.at(total, b, c.astype(np.int64))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["bucket", "n"])

    return matrix.select("bucket", "count").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(matrix: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, from the sums of both matrices (a row a bucket comes to the driver)."""
    sums = []
    for m in (matrix, target):
        total = [0] * buckets
        for r in column_sums(m, buckets).collect():
            total[r.bucket] = r.n
        sums.append(total)
    s, t = sums
    whole, wanted = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log((b + 1.0) * whole / ((a + 1.0) * wanted))) for a, b in zip(s, t, strict=True)], np.int64)


def noise(doc_id: int | None, seed: str) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(matrix: DataFrame, gain: np.ndarray, id_col: str = "doc_id", seed: str = SEED) -> DataFrame:
    """id, n_words, n_features, weight, score: the product of the matrix with the gains, and the noise."""
    held = matrix.sparkSession.sparkContext.broadcast(gain)  # an entry a bucket

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids, n_words, n_features, bounds, bucket, count = (batch.column(c)[k].values for c in range(6))
                bounds, n = bounds.to_numpy(), n_features.to_numpy()
                product = np.concatenate([[0], np.cumsum(held.value[bucket.to_numpy()] * count.to_numpy())])
                weight = np.floor_divide(product[bounds[1:]] - product[bounds[:-1]], np.maximum(n, 1))
                score = weight + np.array([noise(i, seed) for i in ids.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids, n_words.cast(pa.int64()), n_features, pa.array(weight), pa.array(score)], names=["_id", "n_words", "n_features", "weight", "score"])

    return matrix.mapInArrow(run, "_id long, n_words long, n_features long, weight long, score long").withColumnRenamed("_id", id_col)


def drawn(scored: DataFrame, id_col: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored with rank: 1, 2, 3 ... of the floor(percent n / 100) highest scores among the n rows of that many words; null for the others."""
    fit = F.col("n_words") >= least_words
    # a score is a whole number in a range that the buckets and the noise bound: the table of counts is small whatever the corpus
    by_score = scored.where(fit).groupBy("score").agg(F.count("*").alias("n")).orderBy(F.desc("score")).collect()
    k, above, lowest = percent * sum(r.n for r in by_score) // 100, 0, None
    for r in by_score:
        if above >= k:
            break
        above, lowest = above + r.n, r.score
    if lowest is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    reach = fit & (F.col("score") >= lowest)
    order = [F.desc("score"), F.asc_nulls_first(quoted(id_col)), F.desc("n_features"), F.desc("weight")]
    placed = saved(scored.where(reach).orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), "drawn")
    # the ranges of the sort follow one another: a range's first rank is one more than the rows of those before it
    part, sizes = F.shiftright("_place", 33).cast("int"), {}
    for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect():  # a row a task
        sizes[r.part] = r.n
    offsets = accumulate((sizes.get(i, 0) for i in range(max(sizes))), initial=0)
    rank = F.split(F.lit(" ".join(map(str, offsets))), " ")[part].cast("long") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1
    ranked = placed.withColumn("rank", F.when(rank <= k, rank)).drop("_place")
    return ranked.unionByName(scored.where(~F.coalesce(reach, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))


def resampled(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", target_text: str = "text",
    longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED,
) -> DataFrame:
    """id, n_words, n_features, weight, score, rank: a row per row of docs; rank is null where it is not drawn."""
    matrix = saved(count_matrix(docs, id_col, text, longest, buckets), "counts", ROW_GROUP)
    wanted = count_matrix(target.select(F.lit(None).cast("long").alias("_none"), quoted(target_text).alias("_text")), "_none", "_text", longest, buckets)
    scored = saved(weights(matrix, gains(matrix, wanted, buckets), id_col, seed), "scored")
    return drawn(scored, id_col, percent, least_words)
