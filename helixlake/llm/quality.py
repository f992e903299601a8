"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

A document gives two sequences over its words: the words themselves, and their shapes (case,
trailing sign and its run, digits, equality with the word before), which carry over to words never
seen. Uni- and bigrams of words and uni- to trigrams of shapes are hashed into ``2**bits`` weights.
A score is a sparse dot product: the mean weight of each kind of n-gram, summed, through a sigmoid.

Training is per-coordinate FTRL-proximal (L1, L2, adaptive rate) over a bounded sample of labelled
documents (``labelled.py``), in one task that holds 2 * per_class documents at most; the weights
(2**bits floats) go to the executors. The classes are weighted evenly.

Edge cases: null counts as empty; an empty text scores the bias alone; a very long text is scored
whole; without labels of both classes every score is 0.5; repeated rows are scored alike; other
columns, also label, lang, source and id, are never inputs and are carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textops import Block, encoded, gram_hashes, mix, text_blocks, trimmed

KINDS = ((0, 1), (0, 2), (1, 1), (1, 2), (1, 3))  # (words or shapes, n)
_U = np.uint64


def _classes() -> np.ndarray:
    table = np.zeros((4, 256), dtype=np.uint8)  # upper, lower, digit, sign
    table[0, 65:91] = table[1, 97:123] = table[2, 48:58] = 1
    table[3, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
    return table


_CLASS = _classes()


def shape_hashes(block: Block, words: np.ndarray) -> np.ndarray:
    if not len(words):
        return words
    upper, lower, digit, sign = (np.minimum(np.add.reduceat(c[block.raw], block.start, dtype=np.int64), 3) for c in _CLASS)
    last = block.raw[block.end - 1].astype(np.int64)
    tail = np.where(_CLASS[3, last] == 1, last, 0)
    same = np.zeros(len(words), dtype=np.int64)
    same[1:] = words[1:] == words[:-1]
    same[block.first[:-1][block.first[:-1] < len(same)]] = 0
    length = np.minimum(block.end - block.start, 24) // 6
    code = ((((upper * 4 + np.minimum(lower, 1)) * 4 + np.minimum(digit, 2)) * 4 + sign) * 256 + tail) * 2 + same
    return mix((code * 8 + length).astype(_U))


def features(block: Block, bits: int):
    """For each kind of n-gram: (weight index, document) of every n-gram in the block."""
    words = block.word_hashes()
    sequences = (words, shape_hashes(block, words))
    doc = block.doc_of_word()
    for kind, (which, n) in enumerate(KINDS):
        grams = gram_hashes(sequences[which], n) + _U(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        of = doc[: len(grams)]
        inside = of == doc[n - 1 :] if n > 1 else slice(None)
        yield (mix(grams)[inside] >> _U(64 - bits)).astype(np.int64), of[inside]


def dots(block: Block, weights: np.ndarray, bits: int) -> np.ndarray:
    """Sum over kinds of the mean weight, for each document of the block."""
    n = len(block.first) - 1
    total = np.zeros(n)
    for index, of in features(block, bits):
        total += np.bincount(of, weights[index], n) / np.maximum(1, np.bincount(of, minlength=n))
    return total


class Ftrl:
    """FTRL-proximal for logistic loss; the bias is the last coordinate."""

    def __init__(self, size: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3) -> None:
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int, importance: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x * importance
        s = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - s * w
        self.n[at] += g * g


def train(rows: list[tuple[int, bytes]], bits: int, passes: int) -> np.ndarray:
    """Weights, bias last; zeros without both classes."""
    rows = sorted(rows)
    known = [sum(y == c for y, _ in rows) for c in (0, 1)]
    model = Ftrl(1 << bits)
    if min(known) == 0:
        return model.weights()
    sparse = []
    for y, text in rows:
        parts = []
        for index, _ in features(Block([text]), bits):
            at, count = np.unique(index, return_counts=True)
            parts.append((at, count / max(1, len(index))))
        at, back = np.unique(np.concatenate([a for a, _ in parts]), return_inverse=True)
        x = np.bincount(back, np.concatenate([c for _, c in parts]), len(at)) if len(at) else np.zeros(0)
        sparse.append((np.append(at, 1 << bits), np.append(x, 1.0), y))
    for step in range(passes):
        for i in np.random.default_rng(step).permutation(len(sparse)):
            at, x, y = sparse[i]
            model.learn(at, x, y, len(rows) / (2 * known[y]))
    return model.weights()


def fit(sampled: DataFrame, bits: int = 18, passes: int = 4) -> np.ndarray:
    def run(batches):
        rows = [(y, t) for batch in batches for y, t in zip(batch.column("y").to_pylist(), encoded(batch.column("text")), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([train(rows, bits, passes).astype(np.float32).tobytes()], pa.binary())], names=["weights"])

    got = sampled.repartition(1).mapInArrow(run, "weights binary").first()
    return np.frombuffer(got["weights"], np.float32) if got else np.zeros((1 << bits) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", bits: int = 18, name: str = "score", with_text: bool = True) -> DataFrame:
    """All columns of docs (without ``with_text`` not the text) and ``name``, the probability of label 1."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    others = [c for c in docs.columns if c != name and (with_text or c != text)]
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = shared.value
        for batch in batches:
            found = [dots(Block(texts), w[:-1], bits) for _, _, texts in text_blocks(batch.column(text))]
            p = 1 / (1 + np.exp(-np.clip(np.concatenate([*found, np.zeros(0)]) + w[-1], -35, 35)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(p)], names=[*others, name])

    return docs.select(*others, *([] if with_text else [text])).mapInArrow(trimmed(run), StructType([*(docs.schema[c] for c in others), StructField(name, DoubleType())]))
