"""Toxicity by a factorization machine over hashed terms.

Terms are the distinct lower-case words of a text and their beginnings and ends.  The
machine scores w0 + sum of w_i over the terms present + sum over pairs of <v_i, v_j>, so
two terms that mean little alone, such as an insult and the mention of a group, can weigh
together.

The terms that take part are those that the fitted sample shows to matter, all others have
weight zero: terms whose presence depends on the label by a likelihood-ratio test, and both
terms of every pair whose joint presence depends on it by much more than either term's does,
though neither may by itself.  Pairs are tried among the ``PAIR_TERMS`` terms that most rows
have, without those in nearly all or under one in a hundred.  There is no bound on the number
of terms but what the sample holds.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, position_of, text_slices
from .features import collect_features, labelled_sample

WORDS = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 22
AFFIXES = (3, 4, 5, 6)
#: Likelihood ratio from which a term takes part.
LEAST_RATIO = 11.0
#: What a pair's likelihood ratio must have over the greater one of its terms; millions of pairs are tried.
LEAST_PAIR_RATIO = 40.0
#: Terms whose pairs are tried.
PAIR_TERMS = 2000
FACTORS = 4
PER_CLASS = 2000
REMEMBERED = 150_000
THRESHOLD = 0.3


def terms_of(word: str) -> list[int]:
    """The hashed terms of a word: itself, its beginnings and its ends."""
    raw = [f"={word}"]
    raw += [f"<{word[:n]}" for n in AFFIXES if n < len(word)]
    raw += [f">{word[-n:]}" for n in AFFIXES if n < len(word)]
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS for t in raw]


def hashed_terms(texts: list[str | None]) -> list[bytes]:
    out = []
    for text in texts:
        words = set(WORDS.findall((text or "").lower()))
        out.append(np.unique(np.array([t for w in words for t in terms_of(w)], dtype="<u4")).tobytes())
    return out


def likelihood_ratio(with_pos: np.ndarray, with_neg: np.ndarray, pos: int, neg: int) -> np.ndarray:
    """G statistic of each term's two-by-two table against independence."""
    total = pos + neg
    g = np.zeros(np.shape(with_pos))
    for seen, rows, cols in (
        (with_pos, with_pos + with_neg, pos),
        (with_neg, with_pos + with_neg, neg),
        (pos - with_pos, total - with_pos - with_neg, pos),
        (neg - with_neg, total - with_pos - with_neg, neg),
    ):
        expected = rows * cols / total
        g += np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0.0)
    return 2 * g


def paired_terms(rows: list[np.ndarray], y: np.ndarray, every: np.ndarray, seen: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Positions in ``every`` of terms that depend on the label together with another one."""
    common = np.flatnonzero((seen >= 0.01 * len(rows)) & (seen <= 0.95 * len(rows)))
    common = np.sort(common[np.lexsort((common, -seen[common]))[:PAIR_TERMS]])
    if len(common) < 2:
        return common[:0]
    present = np.zeros((len(rows), len(common)), dtype=np.float32)
    for k, row in enumerate(rows):
        at = np.searchsorted(every[common], row)
        at = at[at < len(common)]
        present[k, at[np.isin(every[common][at], row)]] = 1
    pos, found = int(y.sum()), []
    with_pos, with_neg = present[y == 1], present[y == 0]
    for a in range(0, len(common), 256):
        at = slice(a, a + 256)
        both = likelihood_ratio((with_pos[:, at].T @ with_pos).astype(float), (with_neg[:, at].T @ with_neg).astype(float), pos, len(y) - pos)
        alone = np.maximum(g[common][at, None], g[common][None, :])
        left, right = np.nonzero(both >= alone + LEAST_PAIR_RATIO)
        found.append(np.concatenate((left + a, right)))
    return common[np.unique(np.concatenate(found))]


class FactorizationMachine:
    """Weights of the chosen terms; ``terms`` are sorted hashes."""

    def __init__(self, terms: np.ndarray, bias: float, linear: np.ndarray, factors: np.ndarray):
        self.terms, self.bias, self.linear, self.factors = terms, bias, linear, factors
        self.place = {int(t): k for k, t in enumerate(terms)}

    @classmethod
    def fit(cls, rows: list[np.ndarray], y: np.ndarray, shares: np.ndarray, epochs: int = 30, seed: int = 11) -> FactorizationMachine:
        """rows are hashed terms, y 0 or 1, shares the classes' shares among all labelled rows."""
        prior = float(np.log(max(shares[1], 1e-6) / max(shares[0], 1e-6)))
        pos, neg = int(y.sum()), int(len(y) - y.sum())
        if not pos or not neg:
            return cls(np.empty(0, np.uint32), prior, np.empty(0), np.empty((0, FACTORS)))
        has = [np.concatenate([r for r, t in zip(rows, y) if t == c] or [np.empty(0, np.uint32)]) for c in (1, 0)]
        every = np.unique(np.concatenate(has))
        counted = [np.bincount(np.searchsorted(every, h), minlength=len(every)) for h in has]
        g = likelihood_ratio(counted[0].astype(float), counted[1].astype(float), pos, neg)
        chosen = g >= LEAST_RATIO
        chosen[paired_terms(rows, y, every, counted[0] + counted[1], g)] = True
        terms = every[chosen]
        place = {int(t): k for k, t in enumerate(terms)}
        x = [np.array([place[t] for t in r.tolist() if t in place], dtype=np.int64) for r in rows]
        rng = np.random.default_rng(seed)
        bias, linear = prior, np.zeros(len(terms))
        factors = rng.normal(0, 0.01, (len(terms), FACTORS))
        seen_b, seen_w, seen_v = 1e-6, np.full(len(terms), 1e-6), np.full((len(terms), FACTORS), 1e-6)
        cost = shares[y] / np.array([neg / len(y), pos / len(y)])[y]
        for epoch in range(epochs):
            for k in rng.permutation(len(y)).tolist():
                at = x[k]
                v = factors[at]
                total = v.sum(axis=0)
                z = bias + linear[at].sum() + 0.5 * float((total**2).sum() - (v**2).sum())
                err = cost[k] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[k])
                seen_b += err * err
                bias -= 0.1 * err / np.sqrt(seen_b)
                if len(at):
                    gw = err + 1e-4 * linear[at]
                    seen_w[at] += gw * gw
                    linear[at] -= 0.2 * gw / np.sqrt(seen_w[at])
                    gv = err * (total - v) + 1e-3 * v
                    seen_v[at] += gv * gv
                    factors[at] -= 0.05 * gv / np.sqrt(seen_v[at])
        return cls(terms, bias, linear, factors)

    def score(self, at: list[int]) -> float:
        """Probability of the label with these terms present."""
        v = self.factors[at]
        z = self.bias + self.linear[at].sum() + 0.5 * float((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-min(40.0, max(-40.0, z)))))


class Scorer:
    """Scores texts, remembering which of each word's terms take part."""

    def __init__(self, machine: FactorizationMachine):
        self.machine = machine
        self.known = Remembered(REMEMBERED)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        place, out = self.machine.place, np.empty(len(texts))
        split = [set(WORDS.findall((text or "").lower())) for text in texts]
        new = self.known.missing(set().union(*split))
        known = self.known.young
        known.update((w, tuple(place[t] for t in terms_of(w) if t in place)) for w in new)
        for k, words in enumerate(split):
            out[k] = self.machine.score(sorted({t for w in words for t in known[w]}))
        return out


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    per_class: int = PER_CLASS,
) -> FactorizationMachine:
    """The machine of at most about ``per_class`` labelled rows of each class; a label above zero is toxic."""
    binary = labels.select(F.col(id_col), (F.col(label_col) > 0).cast("int").alias("label"))
    sample, counts = labelled_sample(docs, binary, id_col, text_col, "label", per_class)
    rows = collect_features(sample, hashed_terms)
    shares = np.array([counts.get(0, 0), counts.get(1, 0)], dtype=float)
    shares = shares / shares.sum() if shares.sum() else np.array([1.0, 0.0])
    return FactorizationMachine.fit([np.frombuffer(r[2], dtype="<u4") for r in rows], np.array([r[1] for r in rows], dtype=int), shares)


def score(
    docs: DataFrame, machine: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """(id, score, predicted) of each row's whole text.

    Null and empty texts have no terms and get the machine's bias; repeated rows repeat; a
    null id stays; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(machine)
        for part, texts in text_slices(batches, "text"):
            scores = scorer.scores(texts)
            columns = [part.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "score", "predicted"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "id long, score double, predicted int").withColumnRenamed("id", id_col)


def remove_toxic(docs: DataFrame, machine: FactorizationMachine, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns as they are."""

    column = position_of(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(machine)
        for part, texts in text_slices(batches, column):
            clean = part.filter(pa.array(scorer.scores(texts) < threshold))
            if clean.num_rows:
                yield clean

    return docs.mapInArrow(run, docs.schema)
