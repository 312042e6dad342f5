"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios, trained on labelled text.

A text is cut into segments of ``SEGMENT`` words. A segment's score is a bias plus the sum, over its character 3- to
5-grams, of a trained weight times the n-gram's log-count ratio between toxic and clean texts; a text's score is that
of its worst segment, so one insult in a long text counts as much as in a short one. Labels hold for whole texts: a
second fit keeps, of toxic texts, only the segments that the first finds toxic.

Defined results: a null, an empty text and one without letters or digits have no n-grams, score the bias alone and are
never toxic. Rows are scored one by one, so repeated rows repeat their score. Where the labels hold no toxic or no
clean text there is nothing to learn from: every score is 0 and nothing is toxic. A label row with a null in ``doc_id``
or ``toxic`` is ignored; of several labels of one document the toxic one counts. Other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silterra.llm.textbytes import CHUNK, U64, characters, text_chunks
from silterra.session import prepare

SIZES = (3, 4, 5)
BITS = 22
SEGMENT = 16
#: Labelled texts that the fit uses, at most, of each class; which ones, a hash of their ids decides.
SAMPLE = 2_000


@dataclass
class ToxicityModel:
    """``weights`` by hashed n-gram; a text is toxic where its worst segment scores above ``threshold``."""

    weights: np.ndarray
    bias: float = 0.0
    threshold: float = float("inf")

    def __getstate__(self) -> tuple:
        """Only the weights that aren't 0 are sent to the workers."""
        ids = np.flatnonzero(self.weights)
        return len(self.weights), ids.astype(np.int32), self.weights[ids], self.bias, self.threshold

    def __setstate__(self, state: tuple) -> None:
        n, ids, values, self.bias, self.threshold = state
        self.weights = np.zeros(n, np.float32)
        self.weights[ids] = values


def grams(c: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size, where its n-grams start and their hashed numbers; none reaches past its text's end."""
    out, h = [], c * U64(0x9E3779B97F4A7C15)
    for n in range(2, max(SIZES) + 1):
        if len(c) < n:
            break
        h = (h[:-1] ^ (h[:-1] >> U64(29))) * U64(0xBF58476D1CE4E5B9) + c[n - 1 :]
        if n in SIZES:
            whole = np.ones(len(h), bool)
            for k in range(1, n - 1):
                late = ends - k
                whole[late[(late >= 0) & (late < len(h))]] = False
            whole[ends[ends < len(h)]] = False
            at = np.flatnonzero(whole)
            out.append((at, ((h[at] * U64(0x94D049BB133111EB)) >> U64(64 - BITS)).astype(np.int64)))
    return out


def segments(c: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where segments start, and the first segment of each text (with one more entry: their number)."""
    gap = np.flatnonzero(c[: at[-1]] == 0) if len(at) else np.zeros(0, np.int64)
    first = np.searchsorted(gap, at[:-1])
    within = np.arange(len(gap)) - np.repeat(first, np.diff(np.append(first, len(gap))))
    starts = gap[within % SEGMENT == 0]
    return starts, np.searchsorted(starts, at)


def worst(column: pa.Array, model: ToxicityModel, piece: int = CHUNK) -> np.ndarray:
    """The score of each text's worst segment."""
    out = np.zeros(len(column))
    for i, n, buf, offsets in text_chunks(column, piece):
        c, at = characters(buf, offsets)
        w = np.zeros(len(c) + 1)
        for where, ids in grams(c, at[1:]):
            w[where] += model.weights[ids]
        starts, first = segments(c, at)
        total = np.add.reduceat(w[: at[-1] + 1], starts)
        out[i : i + n] = np.maximum.reduceat(total, first[:-1]) + model.bias
    return out


def _rows(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray]]:
    """``(first text, ids by size, segment of each, text of each segment)`` of each chunk."""
    for i, n, buf, offsets in text_chunks(texts, CHUNK // 8):  # small pieces, as this is the driver's work
        c, at = characters(buf, offsets)
        starts, first = segments(c, at)
        found = grams(c, at[1:])
        ids = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
        seg = np.concatenate([np.searchsorted(starts, w, "right") - 1 for w, _ in found]) if found else np.zeros(0, np.int64)
        yield i, ids, seg, np.repeat(np.arange(n), np.diff(first))


class _Features:
    """Feature values of segments, in order of segments; sums over them are made in blocks, as they are the driver's largest arrays."""

    def __init__(self, seg: np.ndarray, feature: np.ndarray, value: np.ndarray, segments_: int, features: int):
        self.seg, self.feature, self.value, self.shape = seg, feature, value, (segments_, features)

    def scores(self, beta: np.ndarray) -> np.ndarray:
        out = np.zeros(self.shape[0])
        for i in range(0, len(self.seg), CHUNK):
            k = slice(i, i + CHUNK)
            first = int(self.seg[i])
            part = np.bincount(self.seg[k] - first, beta[self.feature[k]] * self.value[k])
            out[first : first + len(part)] += part
        return out

    def gradient(self, error: np.ndarray) -> np.ndarray:
        out = np.zeros(self.shape[1])
        for i in range(0, len(self.seg), CHUNK):
            k = slice(i, i + CHUNK)
            out += np.bincount(self.feature[k], error[self.seg[k]] * self.value[k], self.shape[1])
        return out


def _logistic(x: _Features, y: np.ndarray, weight: np.ndarray, steps: int = 80) -> tuple[np.ndarray, float]:
    """Weights and bias of a weighted, ridge-penalised logistic regression, by Adam on the whole data."""
    n = x.shape[1]
    beta, bias, scale = np.zeros(n), 0.0, weight.sum()
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, steps + 1):
        z = bias + x.scores(beta)
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / scale
        g = np.append(x.gradient(error) + 1e-4 * beta, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        beta, bias = beta - move[:-1], bias - move[-1]
    return beta, bias


def fit(texts: pa.Array, toxic: np.ndarray) -> ToxicityModel:
    """Fit on labelled texts; a fifth of them, in their order, set the threshold and nothing else."""
    toxic = np.asarray(toxic, bool)
    model = ToxicityModel(np.zeros(1 << BITS, np.float32))
    held = np.arange(len(toxic)) % 5 == 4
    y = toxic & ~held
    if not y.any() or not (~toxic & ~held).any():
        return model
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    train = texts.filter(pa.array(~held))
    label = toxic[~held]
    seen = np.zeros((2, 1 << BITS), np.int32)
    for i, ids, seg, doc in _rows(train):
        pairs = np.unique((doc[seg].astype(np.int64) << BITS) | ids)
        owner = label[i + (pairs >> BITS)]
        for k in (0, 1):
            some, n = np.unique(pairs[owner == k] & ((1 << BITS) - 1), return_counts=True)
            seen[k, some] += n.astype(np.int32)
    n1, n0 = label.sum(), (~label).sum()
    used = np.flatnonzero(seen[0] + seen[1] >= 3)
    ratio = np.log((seen[1, used] + 1) / (n1 + 2)) - np.log((seen[0, used] + 1) / (n0 + 2))
    used, ratio = used[np.abs(ratio) > 0.5], ratio[np.abs(ratio) > 0.5]
    del seen
    if not len(used):
        return model
    column = np.full(1 << BITS, -1, np.int32)
    column[used] = np.arange(len(used))
    segs, cols, owners, base = [], [], [], 0
    for i, ids, seg, doc in _rows(train):
        f = column[ids]
        key = np.unique((seg[f >= 0].astype(np.int64) + base) * len(used) + f[f >= 0])
        segs.append((key // len(used)).astype(np.int32))
        cols.append((key % len(used)).astype(np.int32))
        owners.append(i + doc)
        base += len(doc)
    owner, col = np.concatenate(owners), np.concatenate(cols)
    x = _Features(np.concatenate(segs), col, ratio[col].astype(np.float32), base, len(used))
    del segs, cols, column
    y = label[owner].astype(float)
    for turn in range(3):
        weight = np.where(y > 0, 1 / max(1, y.sum()), 1 / max(1, (1 - y).sum()))
        weight[y < 0] = 0
        weight *= 1e3
        beta, bias = _logistic(x, np.maximum(y, 0), weight)
        z = bias + x.scores(beta)
        top = np.full(len(label), -np.inf)
        np.maximum.at(top, owner, z)
        clean = np.sort(z[~label[owner]])
        bar = clean[min(len(clean) - 1, int(0.999 * len(clean)))] if len(clean) else 0.0
        y = np.where(label[owner], np.where((z >= top[owner]) | (z > max(bar, 0)), 1.0, -1.0), 0.0)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = beta * ratio
    model = ToxicityModel(weights, float(bias), 0.0)
    check = texts.filter(pa.array(held)) if held.any() and toxic[held].any() and (~toxic[held]).any() else train
    truth = toxic[held] if check is not train else label
    model.threshold = _threshold(worst(check, model, CHUNK // 8), truth)
    return model


def _threshold(score: np.ndarray, truth: np.ndarray) -> float:
    """The middle of the widest gap among those cuts that tell the classes apart best."""
    order = np.argsort(score, kind="stable")
    s, t = score[order], truth[order]
    gain = np.append(0, np.cumsum(np.where(t, -1 / max(1, t.sum()), 1 / max(1, (~t).sum()))))[1:-1]
    gain[s[1:] == s[:-1]] = -np.inf
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    at = best[np.argmax((s[1:] - s[:-1])[best])]
    return float((s[at] + s[at + 1]) / 2)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Fit on at most ``sample`` labelled documents of each class. Only those documents' ids and texts reach the driver."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    picks = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    chosen = picks[0].union(picks[1])
    rows = (
        docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    ).toArrow()
    rows = rows.take(np.argsort((rows["doc_id"].to_numpy().astype(np.int64).view(np.uint64) + U64(1)) * U64(0x9E3779B97F4A7C15)))
    return fit(rows["text"].combine_chunks(), rows["toxic"].to_numpy() > 0)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``(doc_id, toxic_score, is_toxic)`` for every row of docs."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = worst(b.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(s, 6)), pa.array(_flag(s, b.column(1), shared.value))], ["doc_id", "toxic_score", "is_toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, toxic_score double, is_toxic boolean")


def _flag(score: np.ndarray, text: pa.Array, model: ToxicityModel) -> np.ndarray:
    return (score > model.threshold) & (np.asarray(text.is_valid()) != 0)


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of docs that are not toxic, with all their columns."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(where)
            yield b.filter(pa.array(~_flag(worst(text, shared.value), text, shared.value)))

    return docs.mapInArrow(run, docs.schema)
