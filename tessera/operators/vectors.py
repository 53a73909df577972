"""Dense and late-interaction ranking by matrix products over batches, and an inverted file of centroids.

A stated set of queries meets all candidates in blocks: a block of queries (BLOCK_BYTES at most)
is broadcast, a task stacks each Arrow batch of candidates to a matrix and takes one product,
and keeps the k best rows of each query, so k rows a query and task are shuffled. More queries
than a block holds are further passes over the candidates.

An item is one vector, or several (late interaction): then a score is the sum, over the query's
vectors, of the greatest product with a vector of the candidate. Items without vectors have no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..storage import saved
from .ranking import ranked, top_k

#: Bytes of a block of queries (as doubles), and of the scores that one product may hold.
BLOCK_BYTES, SCORE_BYTES = 32 << 20, 16 << 20


def _items(column) -> tuple[np.ndarray, np.ndarray]:
    """All vectors of an Arrow column of vectors, or of lists of vectors, and the bounds of each row's."""
    if pa.types.is_list(column.type.value_type) or pa.types.is_large_list(column.type.value_type):
        bounds = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        column = column.flatten()
    else:
        bounds = np.arange(len(column) + 1)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0)), bounds


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


@dataclass
class Block:
    """Queries of one pass: their vectors, bounds, the values of cand_id that each leaves out, and their other columns."""

    vectors: np.ndarray
    bounds: np.ndarray
    skip: list | None
    told: pa.Table

    def scores(self, vectors: np.ndarray, bounds: np.ndarray, which: np.ndarray | None = None) -> np.ndarray:
        """(candidates, queries): the products, or for several vectors the sums of greatest products."""
        single = len(self.vectors) == len(self.bounds) - 1
        if single and len(vectors) == len(bounds) - 1:
            return vectors @ (self.vectors if which is None else self.vectors[which]).T
        each = vectors @ self.vectors.T
        best = np.maximum.reduceat(each, bounds[:-1], axis=0)
        made = np.add.reduceat(best, self.bounds[:-1], axis=1)
        return made if which is None else made[:, which]


def _passes(queries: DataFrame, query: list[str], vec: str, skip: str | None, normalize: bool) -> Iterator[tuple[Block, DataFrame]]:
    """Blocks of queries, and a table that names the queries of each by their place."""
    asked = saved(queries.where(F.col(vec).isNotNull() & (F.size(vec) > 0)), "queries")
    nested = asked.schema[vec].dataType.elementType.typeName() == "array"
    numbers = F.aggregate(vec, F.lit(0), lambda s, v: s + F.size(v)) if nested else F.size(vec)
    bytes_ = asked.agg(F.sum(numbers.cast("long"))).first()[0] or 0
    n = -(-8 * bytes_ // BLOCK_BYTES)
    for k in range(n):
        part = asked.where(F.pmod(F.xxhash64(*query), F.lit(n)) == k) if n > 1 else asked
        table = part.toArrow().combine_chunks()  # a block: its size is bounded
        if not table.num_rows:
            continue
        vectors, bounds = _items(table[vec].combine_chunks() if isinstance(table[vec], pa.ChunkedArray) else table[vec])
        told = table.drop_columns([vec])
        names = asked.sparkSession.createDataFrame(told.append_column("_q", pa.array(range(table.num_rows), pa.int32())))
        yield Block(_unit(vectors) if normalize else vectors, bounds, table[skip].to_pylist() if skip else None, told), names


def _best(score: np.ndarray, order: np.ndarray, k: int | None) -> np.ndarray:
    """Places of the k best of one query, best first."""
    at = np.flatnonzero(score > -np.inf)
    if k is None:
        return at
    if len(at) > k:
        at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k]]
    return at[np.lexsort((order[at], -score[at]))][:k]


def _parts(b: Block, batch: pa.RecordBatch, vec: str, digits: int | None, normalize: bool, probes: Callable | None, places: dict, same: tuple[str, str] | None) -> Iterator[tuple]:
    """(cand_ids, orders, the queries or None for all, scores) of slices of a batch; no product is larger than SCORE_BYTES."""
    column = batch.column(batch.schema.get_field_index(vec))
    most = max(1, -(-len(_items(column)[0]) // max(1, batch.num_rows))) if batch.num_rows else 1  # vectors of a candidate
    rows = max(1, SCORE_BYTES // 8 // max(1, len(b.vectors)) // most)
    codes = {x: i for i, x in enumerate(dict.fromkeys(b.told[same[1]].to_pylist())) if x is not None} if same else {}
    mine = np.array([codes.get(x, -1) for x in b.told[same[1]].to_pylist()]) if same else None
    for lo in range(0, batch.num_rows, rows):
        part = batch.slice(lo, rows)
        vectors, bounds = _items(column.slice(lo, rows))
        vectors = _unit(vectors) if normalize else vectors
        ids, order = part.column(0), part.column(1)
        if probes is None:
            groups = [(np.arange(part.num_rows), None)]
        else:
            lists = part.column(3).to_numpy()
            groups = [(np.flatnonzero(lists == c), which) for c in np.unique(lists) if len(which := probes(b, int(c)))]
        for own, which in groups:
            whole = len(own) == part.num_rows
            score = b.scores(vectors if whole else vectors[own], bounds if whole else np.arange(len(own) + 1), which)
            score = np.round(score, digits) if digits is not None else score
            cands = ids.take(pa.array(own))
            for i, x in enumerate(cands.to_pylist()) if places else ():
                for q in places.get(x, ()):
                    score[i, q if which is None else np.flatnonzero(which == q)] = -np.inf
            if same:
                theirs = np.array([codes.get(x, -2) for x in part.column(part.schema.get_field_index(same[0])).take(pa.array(own)).to_pylist()])
                score[theirs[:, None] != (mine if which is None else mine[which])] = -np.inf
            yield cands, order.take(pa.array(own)).to_numpy(zero_copy_only=False), which, score


def _places(b: Block) -> dict:
    places: dict = {}
    for q, x in enumerate(b.skip or []):
        places.setdefault(x, []).append(q)
    return places


def _run(block, vec: str, k: int | None, digits: int | None, normalize: bool, probes: Callable | None, same: tuple[str, str] | None):
    """cand_id, ord, the vectors (and list, label) of candidates -> (_q, cand_id, ord, score), the k best of the task, or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = block.value
        n = len(b.bounds) - 1
        held: list = [None] * n  # of each query: scores and rows so far
        floor = np.full(n, -np.inf)  # the k-th best score so far
        places = _places(b)
        for batch in batches:
            for ids, rank, which, score in _parts(b, batch, vec, digits, normalize, probes, places, same):
                asked = np.arange(n) if which is None else which
                better = np.flatnonzero((score >= floor[asked]).any(axis=0))  # other queries keep what they have
                for j, q in zip(better.tolist(), asked[better].tolist(), strict=True):
                    at = _best(score[:, j], rank, k)
                    if not len(at):
                        continue
                    mine = pa.table({"_q": pa.array(np.full(len(at), q), pa.int32()), "cand_id": ids.take(pa.array(at)), "ord": rank[at], "score": score[at, j]})
                    if k is None:
                        yield from mine.combine_chunks().to_batches()
                        continue
                    if held[q] is not None:
                        mine = pa.concat_tables([held[q], mine])
                        at = _best(mine["score"].to_numpy(), mine["ord"].to_numpy(), k)
                        mine = mine.take(pa.array(at))
                    held[q] = mine
                    floor[q] = mine["score"][-1].as_py() if mine.num_rows == k else -np.inf
        kept = [t for t in held if t is not None]
        if kept:
            yield from pa.concat_tables(kept).combine_chunks().to_batches()

    return run


def _ahead(block, vec: str, digits: int | None, normalize: bool):
    """cand_id, ord, the vectors of candidates -> (_q, n), how many of the task come before each query's row of (_score, _ord)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = block.value
        best, at = b.told["_score"].to_numpy(), b.told["_ord"].to_numpy()
        n, places = np.zeros(len(best), np.int64), _places(b)
        for batch in batches:
            for _, rank, _, score in _parts(b, batch, vec, digits, normalize, None, places, None):
                n += ((score > best) & (rank[:, None] != at)).sum(axis=0)
                n += ((score == best) & (rank[:, None] < at)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(n)), pa.int32()), pa.array(n)], names=["_q", "n"])

    return run


def scores(queries: DataFrame, candidates: DataFrame, query: list[str], vec: str = "vec", qvec: str = "qvec", k: int | None = None, skip: str | None = None, digits: int | None = None, normalize: bool = False, probes: Callable | None = None, same: tuple[str, str] | None = None) -> DataFrame:
    """(the columns of queries but qvec, cand_id, ord, score) of queries with candidates(cand_id, ord, vec): each query's k best of every task, or all pairs.

    skip names a column of queries whose value leaves out the candidate of that cand_id; scores are rounded to digits before they are compared.
    ord must be a number. same names a column of candidates and one of queries: only pairs with equal values of them count.
    """
    rows = candidates.where(F.col(vec).isNotNull() & (F.size(vec) > 0)).select("cand_id", "ord", vec, *(["list"] if probes else []), *(same or ())[:1])
    schema = StructType([StructField("_q", IntegerType()), rows.schema["cand_id"], rows.schema["ord"], StructField("score", DoubleType())])
    out = []
    for block, names in _passes(queries, query, qvec, skip, normalize):
        held = queries.sparkSession.sparkContext.broadcast(block)
        found = rows.mapInArrow(_run(held, vec, k, digits, normalize, probes, same), schema)
        out.append(found.join(F.broadcast(names), "_q").drop("_q"))  # the names of a block
    if not out:
        return queries.drop(qvec).join(candidates.select("cand_id", "ord"), F.lit(False)).withColumn("score", F.lit(0.0))
    return reduce(DataFrame.unionByName, out)


def top(queries: DataFrame, candidates: DataFrame, query: list[str], k: int, **options) -> DataFrame:
    """scores() of each query's k best candidates, with rank; ties go to the smaller ord."""
    return top_k(ranked(scores(queries, candidates, query, k=k, **options), query, unique=True), k)


def first_ranks(queries: DataFrame, candidates: DataFrame, query: list[str], same: tuple[str, str], vec: str = "vec", qvec: str = "qvec", skip: str | None = None, digits: int | None = None, normalize: bool = False) -> DataFrame:
    """(query, rank): the rank of each query's best candidate of its own label (same, as in scores) among all candidates; queries without one have no row.

    Two passes over the candidates: the best of each task, then how many come before the best of all. A row a query and
    task is shuffled in each, never a pair. ord tells candidates apart.
    """
    best = top(queries, candidates, query, 1, vec=vec, qvec=qvec, skip=skip, digits=digits, normalize=normalize, same=same)
    asked = queries.join(saved(best.select(*query, F.col("ord").alias("_ord"), F.col("score").alias("_score")), "best"), query)
    rows = candidates.where(F.col(vec).isNotNull() & (F.size(vec) > 0)).select("cand_id", "ord", vec)
    out = [queries.where("false").select(*query, F.lit(0).cast("long").alias("n"))]
    for block, names in _passes(asked, query, qvec, skip, normalize):
        held = queries.sparkSession.sparkContext.broadcast(block)
        out.append(rows.mapInArrow(_ahead(held, vec, digits, normalize), "_q int, n long").join(F.broadcast(names), "_q").select(*query, "n"))  # the names of a block
    return reduce(DataFrame.unionByName, out).groupBy(*query).agg((F.sum("n") + 1).alias("rank"))


#: Rows of the sample that centroids are fitted on at most.
SAMPLE_ROWS = 20_000


def centroids(candidates: DataFrame, lists: int, vec: str = "vec", rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centres of candidates' vectors by k-means, fitted on the SAMPLE_ROWS rows that come first by a hash."""
    sample = candidates.where(F.col(vec).isNotNull()).orderBy(F.xxhash64(vec, F.lit(seed))).limit(SAMPLE_ROWS).select(vec).toArrow()
    x, _ = _items(sample[vec].combine_chunks())
    rng = np.random.default_rng(seed)
    found = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        own = nearest(x, found)
        for c in range(len(found)):
            if (own == c).any():
                found[c] = x[own == c].mean(axis=0)
    return found


def nearest(x: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """The nearest centre of each vector, or the n nearest."""
    apart = (centres**2).sum(axis=1) - 2 * x @ centres.T
    return apart.argmin(axis=1) if n == 1 else np.argpartition(apart, min(n, len(centres)) - 1, axis=1)[:, :n]


def inverted_file(candidates: DataFrame, centres: np.ndarray, vec: str = "vec") -> DataFrame:
    """Every candidate(cand_id, ord, vec) with list, that of its nearest centre; saved in ranges of (list, cand_id), so that a large list lies in several."""
    held = candidates.sparkSession.sparkContext.broadcast(centres)
    rows = candidates.where(F.col(vec).isNotNull()).select("cand_id", "ord", vec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = _items(batch.column(2))
            own = nearest(x, held.value) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], names=["cand_id", "ord", vec, "list"])

    placed = saved(rows.mapInArrow(run, StructType([*rows.schema, StructField("list", IntegerType())])), "lists")
    return saved(placed.repartitionByRange("list", "cand_id").sortWithinPartitions("list"), "inverted-file")


def probed_top(queries: DataFrame, lists: DataFrame, centres: np.ndarray, query: list[str], k: int, probes: int, **options) -> DataFrame:
    """top() over the candidates in the `probes` lists whose centres are nearest to a query; as many probes as lists give the exact ranking."""
    held = lists.sparkSession.sparkContext.broadcast(centres)
    near: dict[int, np.ndarray] = {}

    def of(block: Block, c: int) -> np.ndarray:
        key = id(block)
        if key not in near:
            near.clear()
            near[key] = nearest(block.vectors, held.value, probes).reshape(len(block.vectors), -1)
        return np.flatnonzero((near[key] == c).any(axis=1))

    return top(queries, lists, query, k, probes=of, **options)
