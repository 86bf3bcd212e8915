"""Linear models on hashed words: feature hashing, a bounded training sample, cumulative-link fitting, scoring.

Features of a word are its hash, the hashes of its first 4 to 8 bytes (stems, without a word list for any
language) and of its shape (``Aa***``), and whether it is the word before it again; A-Z is lowered except
for the shape.  A text is the sum of its
words' features over the square root of the number of words.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import BASES, LOWER, SpanHash, Words, byte_codes, mix, slices, text_buffers

BITS = 18
PREFIXES = (4, 5, 6, 7, 8)

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[128:] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")


def word_features(words: Words) -> np.ndarray:
    """One row of feature numbers per kind of feature, one column per word."""
    lower = SpanHash(byte_codes(LOWER[words.data]), BASES[0])
    kinds = [lower.of(words.starts, words.ends)]
    for n in PREFIXES:
        kinds.append(lower.of(words.starts, np.minimum(words.starts + n, words.ends)) + np.uint64(n))
    shape = _SHAPE[words.data]
    new = np.ones(len(shape), bool)
    new[1:] = shape[1:] != shape[:-1]
    new[words.starts] = True
    place = np.concatenate([[0], np.cumsum(new)])
    runs = SpanHash(byte_codes(shape[new]), BASES[1])
    kinds.append(runs.of(place[words.starts], place[words.ends]) + np.uint64(99))
    again = np.zeros(len(words), np.uint64)
    again[1:] = (kinds[0][1:] == kinds[0][:-1]) & (words.doc[1:] == words.doc[:-1])
    kinds.append(again + np.uint64(101))
    return (mix(np.stack(kinds)) >> np.uint64(64 - BITS)).astype(np.int32)


def text_sums(weights: np.ndarray, words: Words, features: np.ndarray) -> np.ndarray:
    """The sum of the weights of each text's features, over the square root of its number of words."""
    of_word = weights[features].sum(axis=0) if len(words) else np.zeros(0)
    sums = np.concatenate([[0.0], np.cumsum(of_word)])
    n = np.diff(words.bounds)
    return np.diff(sums[words.bounds]) / np.sqrt(np.maximum(n, 1))


@dataclass
class Links:
    """P(y > k) = sigmoid(score - thresholds[k]), with shared weights and ordered thresholds."""

    thresholds: np.ndarray
    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    extra: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def table(self) -> np.ndarray:
        full = np.zeros(1 << BITS)
        full[self.features] = self.weights
        return full

    def above(self, sums: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """P(y > k) of each text, one row per k; ``extra`` has one row per extra feature."""
        score = sums + (self.extra @ extra if len(self.extra) else 0)
        return 1 / (1 + np.exp(np.clip(self.thresholds[:, None] - score, -50, 50)))


class Sample:
    """The training texts as sparse counts, slice by slice: (row, feature) pairs and the feature's value.

    The slices stay apart and are gone through one by one, so that nothing of the size of the sample is made beside it.
    """

    def __init__(self, texts: pa.Array):
        self.parts, self.rows = [], 0
        for part in slices(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), "text"):
            words = Words(*text_buffers(part.column(0)))
            n = np.diff(words.bounds)
            if len(words):
                pairs = np.concatenate([words.doc.astype(np.int64) << BITS | kind for kind in word_features(words)])
                pairs, counts = np.unique(pairs, return_counts=True)
                row = pairs >> BITS
                feature = (pairs & ((1 << BITS) - 1)).astype(np.int32)
                self.parts.append(((row + self.rows).astype(np.int32), feature, (counts / np.sqrt(n[row])).astype(np.float32)))
            self.rows += part.num_rows

    def sums(self, table: np.ndarray) -> np.ndarray:
        """As ``text_sums``, for the sample."""
        weights, total = table.astype(np.float32), np.zeros(self.rows)
        for row, feature, value in self.parts:
            total += np.bincount(row, weights=value * weights[feature], minlength=self.rows)
        return total

    def select(self, y: np.ndarray, of: np.ndarray, most: int) -> np.ndarray:
        """The features whose values differ most between y > k and y <= k, for the best k, in rows ``of``."""
        size, levels = 1 << BITS, int(y.max(initial=0))
        n, total, squares, inside = np.zeros(size, np.int64), np.zeros(size), np.zeros(size), np.zeros((levels, size))
        for row, feature, value in self.parts:
            use = of[row]
            row, feature, value = row[use], feature[use], value[use]
            n += np.bincount(feature, minlength=size)
            total += np.bincount(feature, weights=value, minlength=size)
            squares += np.bincount(feature, weights=value * value, minlength=size)
            for k in range(levels):
                inside[k] += np.bincount(feature, weights=value * (y > k)[row], minlength=size)
        best = np.zeros(size)
        for k in range(levels):
            share = (y > k)[of].mean() if of.any() else 0.0
            spread = np.sqrt(np.maximum(squares * share * (1 - share), 1e-9))
            best = np.maximum(best, np.where(n >= 5, np.abs(inside[k] - total * share) / spread, 0))
        chosen = np.argsort(-best, kind="stable")[:most]
        return np.sort(chosen[best[chosen] > 3]).astype(np.int32)

    def matrix(self, features: np.ndarray) -> np.ndarray:
        x = np.zeros((self.rows, len(features)), np.float32)
        for row, feature, value in self.parts if len(features) else []:
            at = np.minimum(np.searchsorted(features, feature), len(features) - 1)
            hit = features[at] == feature
            x[row[hit], at[hit]] = value[hit]
        return x


def fit(sample: Sample, y: np.ndarray, extra: np.ndarray, of: np.ndarray, levels: int, most: int = 1000, steps: int = 250) -> Links:
    """Fit grades 0..levels on the rows ``of`` by maximum likelihood (Adam on scaled features, small L2 penalty)."""
    y = np.minimum(y, levels)
    if not of.any():
        return Links(np.full(levels, 50.0), extra=np.zeros(len(extra)))
    features = sample.select(y, of, most)
    x = np.concatenate([sample.matrix(features), extra.T.astype(np.float32)], axis=1)[of]
    y = y[of]
    scale = np.maximum(x.std(axis=0), 1e-3)
    x /= scale
    shares = np.clip([(y > k).mean() for k in range(levels)], 1e-4, 1 - 1e-4)
    first = np.log((1 - shares) / shares)
    # thresholds: the first, then logarithms of the steps up, so that they stay ordered
    p = np.concatenate([np.zeros(x.shape[1]), first[:1], np.log(np.maximum(np.diff(first), 0.05))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    d, n = x.shape[1], len(y)
    for t in range(1, steps + 1):
        steps_up = np.exp(p[d + 1 :])
        thresholds = p[d] + np.concatenate([[0.0], np.cumsum(steps_up)])
        score = x @ p[:d].astype(np.float32)
        above = 1 / (1 + np.exp(np.clip(thresholds[:, None] - score, -40, 40)))
        padded = np.concatenate([np.ones((1, n)), above, np.zeros((1, n))])
        a, b = padded[y, np.arange(n)], padded[y + 1, np.arange(n)]
        gap = np.maximum(a - b, 1e-9)
        g = np.empty_like(p)
        g[:d] = -(x.T @ (1 - a - b).astype(np.float32)) / n + 1e-3 * p[:d]
        by_threshold = np.array([(np.where(y == k + 1, a * (1 - a), 0) - np.where(y == k, b * (1 - b), 0)) @ (1 / gap) for k in range(levels)]) / n
        g[d] = by_threshold.sum()
        g[d + 1 :] = [steps_up[k] * by_threshold[k + 1 :].sum() for k in range(levels - 1)]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p -= 0.05 * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    weights = p[:d] / scale
    thresholds = p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1 :]))])
    return Links(thresholds, features, weights[: len(features)], weights[len(features) :])


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_cols: list[str], max_rows: int) -> DataFrame:
    """``id, text`` and the labels of at most ``max_rows`` labelled documents, chosen by a hash of the id.

    ``max_rows`` bounds the list of ids, so the list may be broadcast.  Of several complete rows of labels for one
    id the greatest counts, column by column from the left.
    """
    label_id = labels[id_col].alias("id")
    usable = labels.select(label_id, *[labels[c].cast("int").alias(c) for c in label_cols]).dropna()
    best = usable.groupBy("id").agg(F.max(F.struct(*label_cols)).alias("_best")).select("id", "_best.*")
    chosen = best.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return texts.join(F.broadcast(chosen), "id")
