"""Toxic passages: maximum-scoring segments of token log-odds, calibrated by extreme values.

Training reads at most `train_rows` labelled documents (a bound, TRAIN_ROWS by default: rows
are taken in the order of a hash of their id). Tokens are lower-cased runs of letters and
digits, hashed to 2 ** table_bits buckets, so the model has one size at any input.

* A token has features: itself and its prefixes of some byte lengths, which inflected words
  share. A feature's score is its log-odds between toxic and clean training documents (a
  document counts once) under symmetric Dirichlet priors, shrunk to the near end of its confidence interval. A token has
  the greatest score of its features, less a drift that makes unremarkable text lose score.
* The segments of a text are the excursions of its running score above its running minimum,
  each up to its peak; what follows a peak is searched again. All texts of a block are scanned
  at once by cumulative sums and minima some times, and a stack finds what is nested deeper.
* Extreme values: lambda solves sum p(s) exp(lambda s) = 1 over clean tokens, K fits the
  greatest segments of the clean training documents. A segment of score s in n tokens has
  the E-value K n exp(-lambda s); those below `expect` are significant and are reported.
* A text's evidence, the sum of -log E over its significant segments (of the best one if none
  is), is put on 0 to 1 by a logistic curve fitted to the training documents.

Edge cases: null and blank texts have no segments and the score of no evidence; a label table
without both classes, or an empty one, gives every text the share of toxic labels (0 if none);
several labels of a document count as toxic if one is; of several texts of an id the least is
trained on; repeated documents are scored alike; other columns are kept by toxic_scores and not
read by training. A very long text takes about 22 bytes of memory for each of its bytes.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as tw
from .decontaminate import NOT_WORD
from .shared import map_texts, quoted, saved

TRAIN_ROWS, TABLE_BITS = 20_000, 20
#: Byte lengths of the prefixes that are features.
PREFIXES = (4, 5, 6, 7, 8)
#: Passes over all texts before nested segments go to the stack.
PASSES = 8


@dataclass(frozen=True)
class Model:
    scores: np.ndarray  # of each feature bucket
    rate: float  # lambda
    scale: float  # K
    curve: tuple[float, float, float]  # of the logistic: constant, evidence, its square root
    drift: float
    expect: float = 0.01
    base: float = 0.0  # the score where nothing could be learned


def features(column, bits: int) -> tuple[tw.Words, np.ndarray]:
    """Tokens, and the buckets of each token's features (features x tokens); -1 for none."""
    w = tw.split(column, NOT_WORD, lower=True)
    shift, size = np.uint64(64 - bits), w.end - w.start
    out = np.full((1 + len(PREFIXES), len(w)), -1, np.int64)
    out[0] = tw.word_hashes(w) >> shift
    c, total = tw.coefficients(PREFIXES[-1], 9), np.zeros(len(w), np.uint64)
    for k in range(PREFIXES[-1]):
        has = size > k
        total += np.where(has, (w.buf[np.minimum(w.start + k, max(len(w.buf) - 1, 0))] if len(w) else 0) + np.uint64(1), np.uint64(0)) * c[k]
        if k + 1 in PREFIXES:
            at = PREFIXES.index(k + 1)
            out[1 + at] = np.where(has, (tw.mix(total + np.uint64(at + 1)) >> shift).astype(np.int64), -1)
    return w, out


def _scored(column, scores: np.ndarray, drift: float) -> tuple[tw.Words, np.ndarray]:
    """Tokens, and each token's score."""
    w, at = features(column, len(scores).bit_length() - 1)
    return w, np.where(at >= 0, scores[at], -np.inf).max(axis=0) - drift


def excursions(v: np.ndarray, first: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, score) of every maximal segment that scores `least` or more; ordered by text and start.

    Some passes over all texts at once find the outer segments; what is nested deeper is left to a
    stack, which takes each token once. So the time is linear in the tokens.
    """
    out, own = [], np.arange(len(first) - 1)
    a, b = first[:-1].astype(np.int64), first[1:].astype(np.int64)
    for _ in range(PASSES):
        size = b - a
        own, a, b, size = own[size > 0], a[size > 0], b[size > 0], size[size > 0]
        if not len(own):
            break
        # one walk over all ranges: a zero, then the range's sums; a long drop parts the ranges
        head = np.cumsum(size + 1) - size - 1
        token = np.repeat(a - head - 1, size + 1) + np.arange(int((size + 1).sum()))
        step = v[np.clip(token, 0, len(v) - 1)].astype(np.float64)
        step[head] = 0
        walk = np.cumsum(step)
        walk -= np.repeat(walk[head], size + 1)
        fall = 2 * (np.abs(walk).max() + 1)
        drop = np.repeat(np.arange(len(own)) * fall, size + 1)
        low = np.minimum.accumulate(walk - drop)
        rise = walk - drop - low
        rise[rise < 1e-6] = 0
        zero = np.flatnonzero(rise == 0)
        peak = np.maximum.reduceat(rise, zero)
        good = np.flatnonzero(peak >= least)
        if not len(good):
            break
        ends = np.append(zero[1:], len(rise))
        group = np.repeat(np.arange(len(good)), ends[good] - zero[good])
        inside = np.concatenate([np.arange(zero[g], ends[g]) for g in good])
        at_peak = inside[rise[inside] == peak[good][group]]
        _, lead = np.unique(np.searchsorted(zero, at_peak, side="right"), return_index=True)
        top = at_peak[lead]
        of = np.searchsorted(head, zero[good], side="right") - 1
        start, end = token[zero[good]] + 1, token[top] + 1
        out.append((own[of], start, end, peak[good]))
        own, a, b = own[of], end, token[ends[good] - 1] + 1
    else:
        for x, i, j in zip(own.tolist(), a.tolist(), b.tolist(), strict=True):
            start, end, score = stacked(v[i:j], least)
            out.append((np.full(len(start), x), start + i, end + i, score))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0)
    text, start, end, score = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((start, text))
    return text[order], start[order], end[order], score[order]


def stacked(v: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, score) of every maximal segment of one range, by a stack of candidates.

    A run of positive scores is a candidate. The last candidate before it that begins lower takes
    it in if it ends lower too, with all between; each keeps which candidate before it begins lower.
    """
    up = np.concatenate([[0], (v > 0).view(np.int8), [0]])
    edge = np.flatnonzero(np.diff(up)).reshape(-1, 2)
    total = np.concatenate([[0.0], np.cumsum(v, dtype=np.float64)])
    start, end, low, high, lower = [], [], [], [], []
    for (a, b), bottom, top in zip(edge.tolist(), total[edge[:, 0]].tolist(), total[edge[:, 1]].tolist(), strict=True):
        c = len(start) - 1
        while True:
            while c >= 0 and low[c] >= bottom:
                c = lower[c]
            if c < 0 or high[c] >= top:
                break
            a, bottom, at = start[c], low[c], c
            c = lower[c]
            for x in (start, end, low, high, lower):
                del x[at:]
        for x, value in zip((start, end, low, high, lower), (a, b, bottom, top, c), strict=True):
            x.append(value)
    score = np.array(high) - np.array(low)
    good = score >= least
    return np.array(start, dtype=np.int64)[good], np.array(end, dtype=np.int64)[good], score[good]


def best_excursion(v: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The greatest segment score of each text; 0 without a positive token."""
    best = np.zeros(len(first) - 1)
    text, _, _, score = excursions(v, first, 1e-6)
    np.maximum.at(best, text, score)
    return best


def token_scores(toxic: np.ndarray, clean: np.ndarray, prior: float = 0.5, confidence: float = 2.0) -> np.ndarray:
    """Shrunk log-odds of each bucket from its counts in the two classes."""

    def odds(n):
        a = n + prior
        return np.log(a) - np.log(n.sum() + prior * len(n) - a)

    spread = np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))
    delta = odds(toxic.astype(float)) - odds(clean.astype(float))
    return np.where((toxic + clean) > 0, np.sign(delta) * np.maximum(0, np.abs(delta) - confidence * spread), 0)


def _rate(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum p exp(x s) = 1 for scores of negative mean; bisected."""
    p = weights / weights.sum()
    if (p * scores).sum() >= 0 or scores[p > 0].max() <= 0:
        return 1.0
    f = lambda x: (p * np.exp(np.minimum(x * scores, 600))).sum() - 1
    low, high = 1e-6, 1.0
    while f(high) < 0 and high < 100:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def evidence(v: np.ndarray, first: np.ndarray, model: Model):
    """Each text's evidence, and its significant segments."""
    n = np.maximum(np.diff(first), 1)
    cost = np.log(model.scale * n)
    text, start, end, score = excursions(v, first, 1e-6)
    gain = model.rate * score - cost[text]
    best = np.full(len(n), 0.0)
    np.maximum.at(best, text, gain)
    good = gain > -np.log(model.expect)
    total = np.zeros(len(n))
    np.add.at(total, text[good], gain[good])
    return np.maximum(total, best), (text[good], start[good], end[good], score[good], gain[good])


def _features(e: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(e)), np.minimum(e, 200) / 10, np.sqrt(e)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        penalty = ridge * np.array([0] + [1] * (x.shape[1] - 1))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(penalty + 1e-6), x.T @ (y - p) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", train_rows: int = TRAIN_ROWS, table_bits: int = TABLE_BITS, drift: float = 0.25) -> Model:
    """A model from at most train_rows labelled rows of docs; the driver gets counts of 2 ** table_bits buckets and a number a row at most."""
    spark = docs.sparkSession
    chosen = labels.where(quoted(label).isNotNull() & quoted(id).isNotNull()).groupBy(quoted(id).alias("_id")).agg(F.max(quoted(label).cast("int")).alias("_toxic"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(train_rows)
    rows = docs.select(quoted(id).alias("_id"), quoted(text).cast("string").alias("text")).join(F.broadcast(chosen), "_id")  # train_rows ids at most
    texts = saved(rows.groupBy("_id").agg(F.max("_toxic").alias("_toxic"), F.min("text").alias("text")).select("_toxic", "text"), "labelled")  # one text an id, read three times

    def count(batches):
        for batch in tw.passes(batches, "text"):
            w, at = features(batch.column(1), table_bits)
            key = ((w.owner << table_bits) + at) * 2 + np.repeat(batch.column(0).to_numpy(), w.counts)
            key = np.unique(key[at >= 0]) & ((2 << table_bits) - 1)  # a text counts once
            key, n = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key >> 1), pa.array(n * (key & 1)), pa.array(n * (1 - (key & 1)))], names=["bucket", "toxic", "clean"])

    counts = texts.mapInArrow(count, "bucket long, toxic long, clean long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toArrow()
    both = np.zeros((2, 1 << table_bits))
    at = counts.column("bucket").to_numpy()
    both[0, at], both[1, at] = counts.column("toxic").to_numpy(), counts.column("clean").to_numpy()
    if not both.sum(axis=1).all():
        share = texts.agg(F.avg("_toxic")).first()[0]
        return Model(np.zeros(1 << table_bits, np.float32), 1.0, 1.0, (0, 0, 0), drift, base=float(share or 0))
    scores = token_scores(*both).astype(np.float32)
    rate = _rate(scores.astype(float) - drift, both[1])
    held = spark.sparkContext.broadcast(scores)

    def best(batches):
        for batch in tw.passes(batches, "text"):
            w, v = _scored(batch.column(1), held.value, drift)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w.counts.astype(np.int64)), pa.array(best_excursion(v, w.first))], names=["toxic", "n", "best"])

    seen = texts.mapInArrow(best, "toxic int, n long, best double").toArrow()
    toxic, n, top = (seen.column(c).to_numpy() for c in ("toxic", "n", "best"))
    calm = (toxic == 0) & (n > 0)
    model = Model(np.zeros(0), rate, float(max(calm.sum(), 1) / max((n[calm] * np.exp(-rate * top[calm])).sum(), 1e-9)), (0, 0, 0), drift)

    def gather(batches):
        for batch in tw.passes(batches, "text"):
            w, v = _scored(batch.column(1), held.value, drift)
            e, _ = evidence(v, w.first, model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(e)], names=["toxic", "e"])

    seen = texts.mapInArrow(gather, "toxic int, e double").toArrow()
    curve = _logistic(_features(seen.column("e").to_numpy()), seen.column("toxic").to_numpy().astype(float))
    return replace(model, scores=scores, curve=tuple(curve))


COLUMNS = {"score": "double", "predicted": "int", "passages": "array<struct<start_word:int,end_word:int,score:double,e_value:double,text:string>>"}


def toxic_scores(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (None: all), score, predicted and the significant passages."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def measure(column):
        model = held.value
        n = len(column)
        if not any(model.curve):
            return {"score": np.full(n, model.base), "predicted": np.full(n, int(model.base >= 0.5), np.int32), "passages": pa.array([[]] * n, pa.list_(_PASSAGE))}
        w, v = _scored(column, model.scores, model.drift)
        e, (of, start, end, score, gain) = evidence(v, w.first, model)
        p = 1 / (1 + np.exp(-np.clip(_features(e) @ np.array(model.curve), -30, 30)))
        data, passages = w.raw(), [[] for _ in range(n)]
        for d, a, b, s, g in zip(of.tolist(), start.tolist(), end.tolist(), score.tolist(), gain.tolist(), strict=True):
            base = int(w.first[d])
            passages[d].append({"start_word": a - base, "end_word": b - base, "score": s, "e_value": float(np.exp(-g)), "text": data[w.start[a] : w.end[b - 1]].decode()})
        return {"score": p, "predicted": (p >= 0.5).astype(np.int32), "passages": pa.array(passages, pa.list_(_PASSAGE))}

    return map_texts(docs, text, measure, COLUMNS, keep)


_PASSAGE = pa.struct([("start_word", pa.int32()), ("end_word", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64()), ("text", pa.string())])


def in_fold(id: str, folds: int = 5) -> Column:
    """Whether crc32 of the id as text is divisible by folds: the held-out rows; a null id is not."""
    return F.coalesce(F.crc32(quoted(id).cast("string").cast("binary")) % folds == 0, F.lit(False))
