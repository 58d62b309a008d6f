"""Toxicity scores by logistic regression over hashed word n-grams and skip-grams, learned by FTRL-proximal.

Features of a text, each counted once: its words, pairs of neighbouring words, and pairs with one word between; words are runs of
letters and digits, lower-cased, and features are hashed to 2**bits coordinates. Every coordinate has its own learning rate, and L1
leaves at zero whatever does not pay, so the weights that remain are few: they are sent to all tasks as (coordinate, weight).

Learning reads at most `most` labelled texts, those of the least hashes of their ids, in the order of these hashes, in one task; a
held-out row is never among them. The bound is on the labelled sample alone, after labels and texts have met, so that it also holds
where an id has many rows or labels: every text is scored, whole and however long.

Null and empty texts get the score of the intercept, which starts from the share of label 1, (ones + 1) / (labels + 10); so without
labels all scores are 0.1, and nothing is called toxic. Null labels don't count. A document with several labels counts as each of
them. Only the text is an input of a score; rows that tie or repeat have one score each. Empty tables give empty tables. Other columns may
have any names: score() adds its own under the name it is given, toxicity() returns four columns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import BASE, by_bytes, mix64

WORD = re.compile(r"[^\W_]+")
_U = np.uint64


def codes(words: list[str]) -> np.ndarray:
    """64-bit codes of words, seven bytes at a time, of all words at once."""
    text = "".join(words)
    size = np.fromiter(map(len, words) if text.isascii() else (len(w.encode()) for w in words), np.int64, len(words))
    data = np.frombuffer(text.encode() + bytes(7), np.uint8)
    at, left, h = np.cumsum(size) - size, size, np.full(len(words), 0xCBF29CE484222325, _U)
    rows = np.flatnonzero(left > 0)
    while len(rows):
        v = np.zeros(len(rows), _U)
        for k in range(7):
            v |= np.where(left[rows] > k, data[at[rows] + k], 0).astype(_U) << _U(8 * k)
        x = (h[rows] ^ v ^ size[rows].astype(_U) << _U(56)) * _U(BASE)
        h[rows] = x ^ x >> _U(29)
        at, left = at + 7, left - 7
        rows = rows[left[rows] > 0]
    return h


def coordinates(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The coordinates of all texts, in any order and with repetitions, and the number of the text that each is of."""
    found = [WORD.findall(t.lower()) if t else [] for t in texts]
    w, of = codes(list(chain.from_iterable(found))), np.repeat(np.arange(len(texts)), np.fromiter(map(len, found), np.int64, len(found)))
    m = mix64(w)
    hashes, texts_of = [m], [of]
    for gap, more in ((1, m[:-1] * _U(3) + w[1:]), (2, m[:-2] * _U(5) + w[2:] + _U(1))):
        one = of[gap:] == of[:-gap]  # both words are of one text
        hashes.append(mix64(more[one]))
        texts_of.append(of[gap:][one])
    return (np.concatenate(hashes) >> _U(64 - bits)).astype(np.uint32), np.concatenate(texts_of)


def features(text: str | None, bits: int) -> np.ndarray:
    """The sorted distinct coordinates of a text."""
    return np.unique(coordinates([text], bits)[0])


class Ftrl:
    """FTRL-proximal for logistic loss over sets of coordinates, with an intercept."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.5):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.free = size  # the intercept; not held to zero
        self.start = 0.0  # what it starts from

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == self.free, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, x: np.ndarray, y: float) -> None:
        at = np.append(x, self.free).astype(np.int64)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum() + self.start, -35, 35))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(rows: list[tuple[np.ndarray, float]], bits: int, passes: int = 4, **how: float) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights that aren't zero; coordinate 2**bits is the intercept."""
    model, size = Ftrl(1 << bits, **how), 1 << bits
    share = (sum(y for _, y in rows) + 1) / (len(rows) + 10)
    model.start = float(np.log(share / (1 - share)))
    for _ in range(passes):
        for x, y in rows:
            model.learn(x, y)
    w = model.weights(np.arange(size + 1))
    w[size] += model.start
    at = np.flatnonzero(w)
    return at, w[at]


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def learned_from(docs: DataFrame, labels: DataFrame, label: str = "toxic", bits: int = 20, most: int = 12_000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(y, x): label and coordinates of at most `most` labelled rows that aren't held out, one partition in their order."""
    seen = labels.select(F.col(key).alias("doc"), F.col(label).cast("double").alias("y")).where(F.col("y").isin(0.0, 1.0) & F.col("doc").isNotNull()).where(~held_out("doc"))
    order = [F.xxhash64("doc"), "doc", "y"]
    sample = seen.orderBy(*order).limit(most)
    # `most` ids and labels at the most: a bounded side, so the texts stay where they are
    pool = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).join(F.broadcast(sample), "doc")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py(), bits).astype("<u4").tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.binary())], names=["doc", "y", "x"])

    kind = seen.schema["doc"].dataType.simpleString()
    ready = pool.select("doc", "y", "text").mapInArrow(hashed, f"doc {kind}, y double, x binary")
    # a document of many rows or labels gives many; the bound holds for what is read
    return ready.orderBy(*order, "x").limit(most).repartition(1).sortWithinPartitions(*order, "x").select("y", "x")


def learn_weights(docs: DataFrame, labels: DataFrame, bits: int = 20, **how: object) -> list[tuple[int, float]]:
    """(coordinate, weight) learned from the labelled rows that aren't held out; a bounded number of them is read."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.frombuffer(x, "<u4"), y) for b in batches for x, y in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True)]
        at, w = train(rows, bits)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w)], names=["at", "w"])

    one = learned_from(docs, labels, bits=bits, **how)
    got = [(r.at, r.w) for r in one.mapInArrow(fit, "at long, w double").collect()]
    return got or [(int(a), float(w)) for a, w in zip(*train([], bits), strict=True)]  # no rows, no task


def score(docs: DataFrame, weights: list[tuple[int, float]], bits: int = 20, text: str = "text", out: str = "score") -> DataFrame:
    """The rows with their scores; nothing moves between tasks."""
    size = 1 << bits
    at, w = np.array([a for a, _ in weights], np.int64), np.array([x for _, x in weights])
    schema = docs.select("*", F.lit(0.0).alias(out)).schema
    names = schema.names
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size + 1)
        table[at] = w
        heavy = table != 0  # few: only their coordinates are sorted
        for b in batches:
            for part in by_bytes(b, place, 1 << 20):
                x, of = coordinates(part.column(place).to_pylist(), bits)
                keep = heavy[x]
                each = np.unique(of[keep] << bits | x[keep])
                s = np.bincount(each >> bits, table[each & size - 1], part.num_rows) + table[size]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-np.clip(s, -35, 35))))], names=names)

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text: str = "text", key: str = "doc_id", **how: int) -> DataFrame:
    """(key, held_out, score, predicted) of each row."""
    weights = learn_weights(docs, labels, text=text, key=key, **how)
    scored = score(docs.select(F.col(key), F.col(text).alias("text")), weights)
    return scored.select(key, F.coalesce(held_out(key), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
