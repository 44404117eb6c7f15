"""Quality by ordinal regression: shared hashed-text weights with ordered thresholds.

The cumulative-link model gives P(grade <= k) = sigmoid(threshold_k - w.x) with one weight
vector for all grades and increasing thresholds, so it yields an expected grade and, for
selection, the probability that the grade is at least a wanted one.

x is made of the hashed character 1- to 3-grams of the text, case and symbols kept, log
counts scaled to length one, and of hashed marks of how repetitive the words are.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import position_of, text_slices
from .features import blocks, codepoints, collect_features, dense_rows, labelled_sample, ngram_counts, sparse_bytes

ORDERS = (1, 2, 3)
DIMS = 4096
STEPS = 10
#: Buckets after the n-grams: repeated neighbours, distinct words, upper-case words, each in tenths.
EXTRA = 3 * (STEPS + 1)
PER_GRADE = 2000
#: Tail probability from which a text is selected; below it nearly all are of a lower grade.
LEAST = 0.3


def word_marks(text: str | None) -> list[int]:
    """The extra buckets of a text."""
    words = (text or "").split()
    n = max(1, len(words))
    shares = (sum(map(eq, words, words[1:])) / n, len(set(words)) / n, sum(map(str.isupper, words)) / n)
    return [DIMS + k * (STEPS + 1) + int(STEPS * s) for k, s in enumerate(shares)]


def raw_features(texts: list[str | None]) -> np.ndarray:
    counts = np.zeros((len(texts), DIMS + EXTRA), dtype=np.int64)
    counts[:, :DIMS] = ngram_counts([codepoints(t) for t in texts], ORDERS, DIMS)
    for row, text in zip(counts, texts):
        row[word_marks(text)] = 1
    return counts


def scaled(counts: np.ndarray) -> np.ndarray:
    x = np.log1p(counts, dtype=np.float32)
    norm = np.sqrt((x[:, :DIMS] ** 2).sum(axis=1, keepdims=True))
    x[:, :DIMS] /= np.maximum(norm, 1e-9)
    x[:, DIMS:] = counts[:, DIMS:]
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


class OrdinalModel:
    """Cumulative-link regression over the sorted ``grades``."""

    def __init__(self, grades: list, weights: np.ndarray, thresholds: np.ndarray):
        self.grades, self.weights, self.thresholds = grades, weights, thresholds

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, grades: list, shares: np.ndarray, epochs: int = 60, seed: int = 7) -> OrdinalModel:
        """y holds positions in grades; shares are the classes' shares among all labelled rows."""
        k = len(grades)
        if k < 2:
            return cls(grades, np.zeros(x.shape[1], np.float32), np.zeros(0))
        drawn = np.bincount(y, minlength=k) / len(y)
        cost = (shares / np.maximum(drawn, 1e-12))[y]
        start = np.log(np.cumsum(shares)[:-1] / np.maximum(1e-6, 1 - np.cumsum(shares)[:-1]))
        # thresholds are the first one and the logarithms of the gaps, so they stay ordered
        gaps = np.log(np.maximum(np.diff(start), 1e-2))
        params = np.concatenate((np.zeros(x.shape[1]), start[:1], gaps))
        first, second = np.zeros_like(params), np.zeros_like(params)
        rng, step = np.random.default_rng(seed), 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for at in np.array_split(order, max(1, len(y) // 256)):
                step += 1
                grad = cls._gradient(params, x[at], y[at], cost[at], k)
                first = 0.9 * first + 0.1 * grad
                second = 0.999 * second + 0.001 * grad * grad
                rate = 0.03 * (1 - epoch / epochs) + 1e-4
                params -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        return cls(grades, params[: x.shape[1]].astype(np.float32), cls._ordered(params[x.shape[1] :]))

    @staticmethod
    def _ordered(raw: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate((raw[:1], np.exp(raw[1:]))))

    @classmethod
    def _gradient(cls, params: np.ndarray, x: np.ndarray, y: np.ndarray, cost: np.ndarray, k: int) -> np.ndarray:
        d = x.shape[1]
        w, theta = params[:d], cls._ordered(params[d:])
        eta = x @ w
        edges = np.concatenate(([-np.inf], theta, [np.inf]))
        upper, lower = sigmoid(edges[y + 1] - eta), sigmoid(edges[y] - eta)
        mass = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / mass, lower * (1 - lower) / mass
        du[y == k - 1], dl[y == 0] = 0.0, 0.0
        scale = cost / len(y)
        grad = np.empty_like(params)
        grad[:d] = x.T @ (scale * (du - dl)) + 1e-4 * w
        by_edge = np.bincount(y, weights=-scale * du, minlength=k)[: k - 1] + np.bincount(y, weights=scale * dl, minlength=k)[1:]
        reach = np.cumsum(by_edge[::-1])[::-1]
        grad[d:] = reach * np.concatenate(([1.0], np.exp(params[d + 1 :])))
        return grad

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= grades[k + 1]) for each threshold k, (rows, grades - 1)."""
        return sigmoid((x @ self.weights)[:, None] - self.thresholds[None, :])

    def expected(self, tails: np.ndarray) -> np.ndarray:
        grades = np.array(self.grades, dtype=float)
        return grades[0] + tails @ np.diff(grades)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    grade_col: str = "quality",
    per_grade: int = PER_GRADE,
) -> OrdinalModel:
    """The model of at most about ``per_grade`` rated rows of each grade; numeric grades are ordered by value."""
    sample, counts = labelled_sample(docs, labels, id_col, text_col, grade_col, per_grade)
    rows = collect_features(sample, lambda texts: sparse_bytes(raw_features(texts)))
    grades = sorted(counts)
    if not rows:
        return OrdinalModel(grades or [0], np.zeros(DIMS + EXTRA, np.float32), np.zeros(max(0, len(grades) - 1)))
    y = np.array([grades.index(r[1]) for r in rows])
    shares = np.array([counts[g] for g in grades], dtype=float)
    return OrdinalModel.fit(scaled(dense_rows([r[2] for r in rows], DIMS + EXTRA)), y, grades, shares / shares.sum())


def _scores(model: OrdinalModel, texts: list[str | None], wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade and the probability of at least the ``wanted``-th grade."""
    grade, tail = np.empty(len(texts)), np.empty(len(texts))
    for at in blocks(texts):
        tails = model.tails(scaled(raw_features(texts[at])))
        grade[at] = model.expected(tails)
        tail[at] = tails[:, wanted - 1] if tails.shape[1] else 1.0
    return grade, tail


def _position(model: OrdinalModel, wanted) -> int:
    return len(model.grades) - 1 if wanted is None else model.grades.index(wanted)


def score(
    docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", wanted=None, least: float = LEAST
) -> DataFrame:
    """(id, expected_grade, tail_probability, kept) of each row's whole text.

    tail_probability is P(grade >= ``wanted``), by default the best grade, and kept is
    whether it is at least ``least``.  Null and empty texts are scored as texts without any
    n-gram; repeated rows repeat; a null id stays; other columns are not looked at.
    """
    position = _position(model, wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text"):
            grade, tail = _scores(model, texts, position)
            columns = [part.column(0), pa.array(grade), pa.array(tail), pa.array(tail >= least)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "expected_grade", "tail_probability", "kept"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, expected_grade double, tail_probability double, kept boolean"
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def select(docs: DataFrame, model: OrdinalModel, text_col: str = "text", wanted=None, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` whose tail probability is at least ``least``, all columns as they are."""
    position, column = _position(model, wanted), position_of(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, column):
            good = part.filter(pa.array(_scores(model, texts, position)[1] >= least))
            if good.num_rows:
                yield good

    return docs.mapInArrow(run, docs.schema)
