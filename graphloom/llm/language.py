"""Language identification by the nearest of several centroids per language.

A text's letters, lower-cased, with everything else as spaces, give hashed character 1- to
3-grams; log counts times inverse document frequency, scaled to length one, form its
vector.  The sampled texts of a language are clustered by spherical k-means, and a text
belongs to the language of the centroid with the greatest cosine.  A text farther from its
centroid than nearly all the fitted texts of that language were is marked rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices
from .features import blocks, codepoints, collect_features, dense_rows, labelled_sample, letters_of, ngram_counts, sparse_bytes

ORDERS = (1, 2, 3)
DIMS = 4096
CENTROIDS = 4
PER_LANGUAGE = 1000
UNDETERMINED = "und"
#: Share of a language's fitted texts that its rejection distance takes in.
INSIDE = 0.995


def raw_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts of each text's letters, and whether it has any letter."""
    codes = [letters_of(codepoints(t)) for t in texts]
    return ngram_counts(codes, ORDERS, DIMS), np.array([bool((c != 32).any()) for c in codes], dtype=bool)


class CentroidModel:
    """Centroids (rows of length one), their languages and rejection distances."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, languages: list[str], reach: np.ndarray):
        self.idf, self.centroids, self.languages, self.reach = idf, centroids, languages, reach

    @staticmethod
    def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
        x = np.log1p(counts, dtype=np.float32) * idf
        return x / np.maximum(np.sqrt((x**2).sum(axis=1, keepdims=True)), 1e-9)

    @classmethod
    def fit(cls, counts: np.ndarray, languages: list[str], k: int = CENTROIDS, rounds: int = 8, seed: int = 5) -> CentroidModel:
        n = max(1, len(counts))
        idf = (np.log((1 + n) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
        x, of = cls.vectors(counts, idf), np.array(languages)
        rng = np.random.default_rng(seed)
        centroids, owners, reach = [], [], []
        for lang in sorted(set(languages)):
            own = x[of == lang]
            c = own[rng.choice(len(own), min(k, len(own)), replace=False)]
            for _ in range(rounds):
                nearest = (own @ c.T).argmax(axis=1)
                sums = np.stack([own[nearest == j].sum(axis=0) if (nearest == j).any() else c[j] for j in range(len(c))])
                c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
            distance = 1 - (own @ c.T).max(axis=1)
            centroids.append(c)
            owners += [lang] * len(c)
            reach += [float(np.quantile(distance, INSIDE))] * len(c)
        return cls(idf, np.concatenate(centroids) if centroids else np.zeros((0, DIMS), np.float32), owners, np.array(reach))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine to its nearest centroid, and whether the text is rejected."""
        names, score, rejected = [], np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        for at in blocks(texts):
            counts, lettered = raw_features(texts[at])
            if not len(self.languages):
                names += [UNDETERMINED] * len(lettered)
                continue
            cosine = self.vectors(counts, self.idf) @ self.centroids.T
            best = cosine.argmax(axis=1)
            top = np.clip(cosine[np.arange(len(best)), best].astype(float), 0.0, 1.0)
            score[at] = np.where(lettered, top, 0.0)
            rejected[at] = ~lettered | (1 - top > self.reach[best])
            names += [self.languages[b] if has else UNDETERMINED for b, has in zip(best, lettered)]
        return names, score, rejected


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE
) -> CentroidModel:
    """The model of at most about ``per_language`` rows of each language; rows without text or language are left out."""
    sample, _ = labelled_sample(docs, docs.select(id_col, lang_col), id_col, text_col, lang_col, per_language)
    rows = collect_features(sample, lambda texts: sparse_bytes(raw_features(texts)[0]))
    return CentroidModel.fit(dense_rows([r[2] for r in rows], DIMS), [r[1] for r in rows])


def identify(
    docs: DataFrame, model: CentroidModel, id_col: str = "doc_id", text_col: str = "text", reject: bool = False
) -> DataFrame:
    """(id, lang_pred, score, rejected) of each row's whole text.

    score is the cosine to the nearest centroid.  Texts that are null or have no letter are
    ``und`` with score 0 and rejected; with ``reject`` all rejected texts are ``und``.
    Repeated rows repeat; a null id stays; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text"):
            names, score, rejected = model.predict(texts)
            if reject:
                names = [UNDETERMINED if r else n for n, r in zip(names, rejected)]
            columns = [part.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "lang_pred", "score", "rejected"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "id long, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)
