"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release

_WORD = re.compile(r"[^\W\d_]+")
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_FILTER_BITS = 22
_CACHE_WORDS = 100_000
#: The bias where there is nothing to learn from: nothing is toxic.
NOTHING_KNOWN = -35.0


@dataclass(frozen=True)
class Training:
    """rows, keys: bounds of the labelled sample, in documents and in n-grams; it is the documents of least hash of doc_id.

    alpha, beta: the per-coordinate rate is alpha / (beta + root of the sum of squared gradients). l1, l2: as in
    FTRL-proximal. least_docs: n-grams of fewer documents of the sample are left out. folds: parts of the sample, each of
    which is scored by a model of the others, so that the threshold is set on texts that were not learned from.
    """

    rows: int = 8000
    keys: int = 12_000_000
    epochs: int = 5
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1
    least_docs: int = 5
    folds: int = 3


class _Hashes(dict):
    """Word -> 64-bit hash; what comes first is kept."""

    def __missing__(self, word: str) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word)
        if len(self) < _CACHE_WORDS:
            self[word] = value
        return value


_hashes = _Hashes()


def _final(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(29))


def keys(text: str | None) -> np.ndarray:
    """32-bit keys of a text's words, word pairs, and pairs of words with one between, repeats included."""
    words = _WORD.findall(text.lower()) if text else []
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    grams = [h * _MIX[0], h[:-1] * _MIX[2] + h[1:] * _MIX[3], h[:-2] * _MIX[3] + h[2:] * _MIX[1]]
    return (_final(np.concatenate(grams)) >> np.uint64(32)).astype(np.uint32)


def fit(documents: list[np.ndarray], labels: list[int], how: Training = Training()) -> tuple[np.ndarray, np.ndarray, float]:
    """Documents as arrays of distinct keys -> sorted keys with a weight other than 0, their weights, the bias."""
    flat = np.concatenate([np.zeros(0, np.uint32), *documents])
    vocabulary, index, seen = np.unique(flat, return_inverse=True, return_counts=True)
    index = np.where(seen[index] >= how.least_docs, index, -1)
    ends = np.cumsum([len(d) for d in documents], dtype=np.int64)
    rows = [r[r >= 0] for r in np.split(index, ends[:-1])] if documents else []
    z, n = np.zeros(len(vocabulary) + 1), np.zeros(len(vocabulary) + 1)
    bias = len(vocabulary)
    rows = [np.append(r, bias) for r in rows]

    def weights(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * how.l1) / ((how.beta + np.sqrt(n[i])) / how.alpha + how.l2)
        return np.where(np.abs(zi) > how.l1, w, 0.0)

    order = np.random.default_rng(7)
    for _ in range(how.epochs):
        for k in order.permutation(len(rows)):
            i = rows[k]
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[k]
            root = np.sqrt(n[i])
            n[i] += g * g
            z[i] += g - (np.sqrt(n[i]) - root) / how.alpha * w
    w = weights(np.arange(bias + 1))
    used = np.flatnonzero(w[:-1])
    return vocabulary[used], w[used], float(w[-1])


def _margins(model, documents: list[np.ndarray]) -> np.ndarray:
    known, weights, bias = model
    out = np.full(len(documents), bias)
    if len(known):
        for r, d in enumerate(documents):
            at = np.minimum(np.searchsorted(known, d), len(known) - 1)
            out[r] += weights[at][known[at] == d].sum()
    return out


def scaling(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic that fits labels to margins best, by Newton's method, with smoothed targets."""
    slope, offset, positive = 1.0, 0.0, labels.sum()
    target = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (len(labels) - positive + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ (slope, offset), -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(slope), float(offset)


def fit_scaled(documents: list[np.ndarray], labels: list[int], how: Training = Training()) -> tuple[np.ndarray, np.ndarray, float]:
    """fit(), with weights and bias scaled so that scores are probabilities on texts that were not learned from."""
    y, fold = np.array(labels), np.arange(len(labels)) % how.folds
    known, weights, bias = fit(documents, labels, how)
    if not len(known) or len(set(labels)) < 2:
        return known, weights, bias
    margins = np.zeros(len(labels))
    for k in range(how.folds):
        inner, outer = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        margins[outer] = _margins(fit([documents[i] for i in inner], y[inner].tolist(), how), [documents[i] for i in outer])
    slope, offset = scaling(margins, y)
    return (known, weights * slope, bias * slope + offset) if slope > 0 else (known, weights, bias)


def _frequent(documents: list[np.ndarray], least: int) -> list[np.ndarray]:
    """The documents without most of the keys of fewer documents than `least`, by counts of 4 million buckets of keys.

    A bucket counts at least what each of its keys does, so no frequent key is lost, and what is kept is small.
    """
    shift, counts = np.uint32(10), np.zeros(1 << 22, np.int32)
    for d in documents:
        counts[d >> shift] += 1
    for i, d in enumerate(documents):
        documents[i] = d[counts[d >> shift] >= least]
    return documents


def _train(batches: Iterator[pa.RecordBatch], how: Training) -> Iterator[pa.RecordBatch]:
    documents, labels, size = [], [], 0
    for b in batches:
        for text, label in zip(b.column("text"), b.column("label"), strict=True):
            if size < how.keys:
                documents.append(np.unique(keys(text.as_py())))
                labels.append(label.as_py())
                size += len(documents[-1])
    k, w, bias = fit_scaled(_frequent(documents, how.least_docs), labels, how) if documents else ([], [], NOTHING_KNOWN)
    k, w = np.array(k), np.array(w)
    documents.clear()
    release()
    yield pa.RecordBatch.from_arrays([pa.array([-1, *k.tolist()], pa.int64()), pa.array([bias, *w.tolist()], pa.float64())], ["key", "weight"])


def train(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on the labelled documents (labels: doc_id, label 0/1) of least hash of doc_id, in one task of bounded size.

    Null labels and ids are left out; a doc_id labelled twice counts as its larger label. Without labelled rows nothing has
    a weight.
    """
    given = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    sample = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(how.rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    alone = texts.select("doc_id", "text", "label").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), F.xxhash64("text"))
    model = alone.mapInArrow(lambda it: _train(it, how), "key long, weight double").collect()
    k = np.array([r["key"] for r in model if r["key"] >= 0], np.uint32)
    w = np.array([r["weight"] for r in model if r["key"] >= 0])
    return k, w, next((r["weight"] for r in model if r["key"] < 0), NOTHING_KNOWN)


def _score(text: str | None, model, hit: np.ndarray) -> float:
    known, weights, bias = model
    if len(known):
        k = keys(text)
        k = np.unique(k[hit[k >> np.uint32(32 - _FILTER_BITS)]])
        at = np.minimum(np.searchsorted(known, k), len(known) - 1)
        bias = bias + weights[at][known[at] == k].sum()
    return float(1 / (1 + np.exp(-np.clip(bias, -35, 35))))


def scorer(spark, model):
    """A column function text -> score 0 to 1. The weights, few because of L1 and the bounded sample, are broadcast."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def toxicity(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = sent.value[0]
        hit = np.zeros(1 << _FILTER_BITS, bool)
        hit[known >> np.uint32(32 - _FILTER_BITS)] = True
        for batch in texts:
            yield pa.array([_score(t.as_py(), sent.value, hit) for t in batch], pa.float64())

    return toxicity


def held_out(doc_id) -> F.Column:
    """A fifth of the ids, never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def scores(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> DataFrame:
    """documents, labels (doc_id, toxic) -> (doc_id, held_out, score, predicted), a row for each row of documents.

    Null and empty texts get the score of a text without n-grams; without any labelled row all scores are 0 but for rounding.
    Scores read the text only; learning uses rows that are not held out. A null doc_id is not held out and has no label.
    """
    score = scorer(docs.sparkSession, train(docs, _known(labels), how))
    out = docs.select(docs["doc_id"], held_out(docs["doc_id"]).alias("held_out"), score(docs["text"]).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _known(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.col("toxic").alias("label")).where(~held_out(F.col("doc_id")))


def keep_clean(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> DataFrame:
    """The rows of documents that are not predicted toxic, all columns unchanged."""
    score = scorer(docs.sparkSession, train(docs, _known(labels), how))
    return docs.where(score(docs["text"]) < 0.5)
