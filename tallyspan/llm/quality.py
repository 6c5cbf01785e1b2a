"""Quality classifier: logistic regression over hashed word 1- and 2-grams, trained by FTRL-proximal updates.

Words are runs of letters and digits or runs of other signs, in their own case. A word that repeats the one
before it, or the one before that, makes the same n-gram whatever it is. A text is a sparse vector of the square roots of its n-grams'
shares, and its score the logistic of one sparse dot product. Its length is nearly 1 however long the text; a few
words say little and stay near the bias.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspan.llm.common import fields, map_rows
from tallyspan.llm.samples import fold, labelled

BITS = 18
#: N-grams that are added to a text's own count.
SHORT = 20
#: Labelled documents of each class that training takes at most.
PER_CLASS = 1500
_WORD = re.compile(r"\w+|[^\w\s]+")
_SAME, _MIX = 0x5BD1E995, 0x9E3779B1


class _Ids(dict):
    """Hash of a word, remembered; starts over when it grows large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        got = self[word] = zlib.crc32(word.encode())
        return got


def features(text: str | None, ids: _Ids) -> tuple[np.ndarray, np.ndarray]:
    """Sorted indices and weights of a text; empty for one without words."""
    w = np.array([ids[x] for x in _WORD.findall(text or "")], np.uint64)
    if not len(w):
        return np.zeros(0, np.int64), np.zeros(0)
    pairs = (w[:-1] * np.uint64(_MIX) + w[1:] * np.uint64(_SAME)) >> np.uint64(7)
    pairs[w[:-1] == w[1:]] = _SAME
    again = np.full(int((w[:-2] == w[2:]).sum()), _SAME >> 1, np.uint64)
    index = np.concatenate((w * np.uint64(_MIX) >> np.uint64(11), pairs, again)) & np.uint64((1 << BITS) - 1)
    index, n = np.unique(index.astype(np.int64), return_counts=True)
    return index, np.sqrt(n / (n.sum() + SHORT))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, epochs: int = 8) -> tuple[np.ndarray, float]:
    """Weights and bias from (label, indices, weights); rows are taken in a fixed shuffled order."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    order = np.random.default_rng(0)

    def weights(i):
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            y, index, x = rows[k]
            i, v = np.append(index, size), np.append(x, 1.0)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ v, -35, 35)))
            g = (p - y) * v
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(size + 1))
    return w[:-1].astype(np.float32), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, value: str = "quality") -> tuple[np.ndarray, float]:
    """Model from at most ``per_class`` documents of each class, one row a document sent to the driver."""
    sample = labelled(docs, labels, value, per_class)

    def make():
        ids = _Ids()

        def run(texts):
            got = [features(t, ids) for t in texts]
            return [i.astype("<i4").tobytes() for i, _ in got], [x.astype("<f4").tobytes() for _, x in got]

        return run

    rows = map_rows(sample.withColumn("label", F.col("label").cast("int")), ["label"], ["text"], fields(i="binary", x="binary"), make).toArrow().to_pylist()
    rows.sort(key=lambda r: (r["label"], r["i"], r["x"]))
    return train([(int(r["label"]), np.frombuffer(r["i"], "<i4").astype(np.int64), np.frombuffer(r["x"], "<f4").astype(float)) for r in rows])


def score(docs: DataFrame, model: tuple[np.ndarray, float], keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` plus score (0 to 1) of every row; empty and null texts get the score of the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        (w, bias), ids = shared.value, _Ids()

        def one(t):
            i, x = features(t, ids)
            return float(1 / (1 + np.exp(-np.clip(w[i] @ x + bias, -35, 35))))

        return lambda texts: [[one(t) for t in texts]]

    return map_rows(docs, keep, [text], fields(score="double"), make)


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; trained on rows that are not held out.

    Repeated rows get a row each; without labels every score is 0.5. A label row counts once per document row. Null and
    empty texts get the bias alone. A text is held whole with its words while it is scored. Only doc_id, text and the
    label are read, so other columns may have any name.
    """
    known = labels.where(fold(F.col("doc_id"), 3) != 1)
    model = fit(docs, known, per_class)
    got = score(docs.select("doc_id", "text"), model)
    return got.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
