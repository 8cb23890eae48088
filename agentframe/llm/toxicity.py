"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Text is folded (A-Z lower-cased, ASCII that is not a letter or digit becomes a space) and its n-grams of ``SIZES`` bytes are hashed into ``BUCKETS``. On a bounded
sample of labelled rows, read whole, the log ratio of each n-gram's smoothed document frequency in toxic and in other texts is computed; the ``KEPT`` n-grams
with the strongest evidence are kept, and logistic regression is trained on presence times ratio. Out-of-fold scores
calibrate the result (Platt). Scoring reads whole texts of any length. Null and empty text score as a text without n-grams. Labels that
are null, or rows without labels, are not learned from; a row labelled both ways is toxic; without both classes every score is 0. N-grams of equal strength are kept in the
order of their buckets. Repeated rows get the same score; an empty table gives no rows. Input columns with the name of an added one give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentframe.llm.common import BYTE_VALUES, mapped, mix64, powers, slices, text_buffers, without
from agentframe.llm.langid import held_out

SIZES, BUCKETS, KEPT, LEAST_TEXTS = (4, 5, 6, 7, 8), 1 << 22, 2000, 5
#: Labelled rows of each class that are learned from, about.
SAMPLE_ROWS = 900
THRESHOLD = 0.3

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not chr(b).isalnum()]] = 32
_ODD = 0x9E3779B97F4A7C15
_VALUES = BYTE_VALUES[_FOLD]


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: the buckets of the n-grams at all places, and whether the n-gram ends inside its text."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[data] * powers(_ODD, n), out=total[1:])
    back = powers(pow(_ODD, -1, 1 << 64), n)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    for size in SIZES:
        if n < size:
            continue
        m = n - size + 1
        h = (total[size:] - total[:m]) * back[:m]
        yield ((mix64(h + np.uint64(size)) >> np.uint64(42)).astype(np.int64), left[:m] >= size)


@dataclass(frozen=True)
class NbLinear:
    """weights of the kept buckets (0 elsewhere), the intercept, and Platt's slope and offset."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float
    slope: float
    offset: float

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        table = np.zeros(BUCKETS, np.int16)
        table[self.buckets] = np.arange(1, len(self.buckets) + 1)
        texts, hits = len(offsets) - 1, []
        for bucket, inside in grams(data, offsets):
            feature = table[bucket]
            at = np.flatnonzero((feature > 0) & inside)
            hits.append((np.searchsorted(offsets, at, "right") - 1) * len(self.buckets) + feature[at] - 1)
        pairs = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
        width = max(1, len(self.buckets))
        return np.bincount(pairs // width, self.weights[pairs % width] if len(pairs) else None, texts) + self.intercept

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(data, offsets) + self.offset, -30, 30)))


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def _bounded(texts: list[str], limit: int = 1 << 20) -> Iterator[int]:
    """Ends of runs of texts of about limit characters each, or of one text."""
    held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= limit or i + 1 == len(texts):
            yield i + 1
            held = 0


def _pairs(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(texts, buckets): the pairs of a bounded run of texts at a time, each once."""
    a = 0
    for b in _bounded(texts, 1 << 19):
        data, offsets = _joined(texts[a:b])
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        found = [owner[: len(bucket)][inside] * BUCKETS + bucket[inside] for bucket, inside in grams(data, offsets)]
        flat = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        yield flat // BUCKETS + a, flat % BUCKETS
        a = b


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept by Nesterov's accelerated gradient."""
    n = len(y)
    w, b, v, vb = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
    norm = np.ones(x.shape[1]) / np.sqrt(x.shape[1])
    for _ in range(20):
        norm = x.T @ (x @ norm)
        size = np.linalg.norm(norm)
        norm /= max(size, 1e-12)
    rate = 1 / (0.25 * (size / n + 1) + penalty)
    for t in range(steps):
        m = t / (t + 3)
        aw, ab = w + m * (w - v), b + m * (b - vb)
        g = 1 / (1 + np.exp(-np.clip(x @ aw + ab, -30, 30))) - y
        v, vb = w, b
        w, b = aw - rate * (x.T @ g / n + penalty * aw), ab - rate * g.mean()
    return w, b


def _chosen(total: np.ndarray, toxic: np.ndarray, n: int, n_toxic: float) -> tuple[np.ndarray, np.ndarray]:
    """The KEPT buckets with the strongest evidence, and their log ratios, by the counts of n texts with and without a label."""
    seen = np.flatnonzero(total >= LEAST_TEXTS)
    toxic, clean = toxic[seen].astype(float), (total[seen] - toxic[seen]).astype(float)
    p, q = (toxic + 0.5) / (n_toxic + 1), (clean + 0.5) / (n - n_toxic + 1)
    strength = np.abs(p - q) / np.sqrt((p + q) / 2)
    best = np.sort(np.argsort(-strength, kind="stable")[:KEPT])
    return seen[best], np.log(p / q)[best]


def _fit(kept: np.ndarray, ratio: np.ndarray, rows: np.ndarray, buckets: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """n: the numbers of the texts to learn from. Weights of the kept buckets and intercept."""
    number = np.full(len(y), -1, np.int64)
    number[n] = np.arange(len(n))
    at = np.minimum(np.searchsorted(kept, buckets), max(0, len(kept) - 1))
    ok = (number[rows] >= 0) & (kept[at] == buckets) if len(kept) else np.zeros(len(rows), bool)
    x = np.zeros((len(n), len(kept)))
    x[number[rows[ok]], at[ok]] = ratio[at[ok]]
    w, b = _logistic(x, y[n], 0.02)
    return w * ratio, b


def train(texts: list[str], labels: list[int], prior: float | None = None) -> NbLinear:
    """Learns from labelled texts; prior is the share of toxic rows that scores are calibrated to (None: as in the sample).

    Two passes over the texts: counts of each bucket by fold and class, then the pairs of the kept buckets only, so memory does not grow with the texts' n-grams.
    """
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return NbLinear(np.zeros(0, np.int64), np.zeros(0), 0.0, 0.0, -30.0)
    folds = 3
    fold = np.arange(len(y)) % folds
    counts = np.zeros((folds, 2, BUCKETS), np.int32)
    for rows, buckets in _pairs(texts):
        for k in range(folds):
            for c in (0, 1):
                own = (fold[rows] == k) & (y[rows] == c)
                np.add.at(counts[k, c], buckets[own], 1)
    sets = [np.flatnonzero(fold != k) for k in range(folds)] + [np.arange(len(y))]
    chosen = []
    for k, n in enumerate(sets):
        clean, toxic = (counts[[j for j in range(folds) if j != k], c].sum(0) for c in (0, 1))
        chosen.append(_chosen(clean + toxic, toxic, len(n), y[n].sum()))
    del counts
    wanted = np.zeros(BUCKETS, bool)
    for kept, _ in chosen:
        wanted[kept] = True
    held = [(rows[wanted[buckets]], buckets[wanted[buckets]]) for rows, buckets in _pairs(texts)]
    rows, buckets = (np.concatenate([h[i] for h in held]) for i in (0, 1))
    fitted = [(kept, *_fit(kept, ratio, rows, buckets, y, n)) for (kept, ratio), n in zip(chosen, sets, strict=True)]
    margin = np.zeros(len(y))
    for k, (kept, w, b) in enumerate(fitted[:folds]):
        test = np.flatnonzero(fold == k)
        a = 0
        for e in _bounded([texts[i] for i in test]):
            data, offsets = _joined([texts[i] for i in test[a:e]])
            margin[test[a:e]] = NbLinear(kept, w, b, 1, 0).margins(data, offsets)
            a = e
    kept, w, b = fitted[folds]
    slope, offset = _logistic(margin[:, None], y, 1e-6, 2000)
    share = y.mean()
    if prior:
        offset += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return NbLinear(kept, w, b, float(slope[0]), float(offset))


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> tuple[list[str], list[int], float | None]:
    """About SAMPLE_ROWS texts of each class, those with the smallest hash of the key, and the true share of the toxic class."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(key)).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("__y"))
    counts = {r[0]: r[1] for r in known.groupBy("__y").count().collect()}
    if len(counts) < 2:
        return [], [], None
    place = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.when(F.col("__y") == 1, min(1.0, SAMPLE_ROWS / counts[1])).otherwise(min(1.0, SAMPLE_ROWS / counts[0]))
    chosen = docs.where(F.col(text).isNotNull()).select(key, F.col(text).alias("__t")).join(F.broadcast(known.where(place < share).select(key, "__y")), key)
    rows = sorted(chosen.select(F.col(key).cast("string").alias("k"), "__t", "__y").collect(), key=lambda r: (r.k, r["__t"]))
    return [r["__t"] for r in rows], [r["__y"] for r in rows], counts[1] / (counts[0] + counts[1])


def score(df: DataFrame, model: NbLinear, text: str = "text") -> DataFrame:
    """df with score and predicted."""
    df = without(df, "score", "predicted")
    held = df.sparkSession.sparkContext.broadcast(model)
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(place))
            for a, b in slices(offsets):
                part = batch.slice(a, b - a)
                got = held.value.scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got), pa.array((got >= THRESHOLD).astype(np.int32))], names=[*part.schema.names, "score", "predicted"])

    return mapped(df, run, "score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """key, held_out, score and predicted for each row of docs, learned from labels of rows that are not held out."""
    model = train(*labelled(docs, labels, key, text, label))
    out = score(docs.select(F.col(key), F.coalesce(held_out(key), F.lit(False)).alias("held_out"), F.col(text).alias("__text")), model, "__text")
    return out.select(key, "held_out", "score", "predicted")
