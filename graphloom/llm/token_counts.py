"""Token counts without token ids: an Aho-Corasick automaton over the distinct words of a slice.

For each place in a word the automaton enumerates the vocabulary pieces that end there (see
``forward``).  Dynamic programming over the places carries only what the count needs: for a
unigram reading the best score and its number of pieces, the first found of equal scores; for
a merging (BPE) reading, which has no scores to add, the last piece that merging leaves and
its number of pieces.  No path is kept and no ids are made.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, column_slices, tokenizer_file
from .forward import Forward
from .pieces import UNIGRAM, PieceModel, load
from .sentencepiece import TOGETHER, Words

#: Words in one generation of what a worker remembers.
REMEMBERED = 200_000


class Counter:
    """Counts the pieces of texts by one or more readings of a vocabulary, remembering words it has met."""

    def __init__(self, model: PieceModel, *readings: str):
        self.model, self.readings = model, readings or (model.reading,)
        self.forward = Forward(model, self.readings, counts=True)
        self.known = Remembered(REMEMBERED)

    def learn(self, words: set[str]) -> None:
        """Makes ``known`` hold the words: a number of pieces for each reading."""
        at, new = [1 if r == UNIGRAM else 2 for r in self.readings], sorted(self.known.missing(words))
        self.known.young.update((w[0], tuple([w[k] for k in at])) for w in self.forward.walk(new))

    def counts(self, column: pa.Array) -> list[np.ndarray]:
        """For each reading the number of pieces of each text."""
        words = Words(self.model, column)
        self.learn(words.distinct())
        known, out = self.known.young, []
        met = [known[w] for w in words.items]
        for k in range(len(self.readings)):
            total = np.zeros(len(column), dtype=np.int64)
            done = np.concatenate(([0], np.cumsum(np.array([m[k] for m in met], dtype=np.int64)[words.index])))
            total[words.plain] = np.diff(done[words.ends])
            for row, own in words.odd.items():
                total[row] = sum([known[w][k] for w in own])
            out.append(total)
        return out


@lru_cache(maxsize=4)
def counter_of(path: str, *readings: str | None) -> Counter:
    """One counter for all the tasks of a worker; None is the reading that the file was trained for."""
    model = load(path)
    return Counter(model, *(r or model.reading for r in readings))


def token_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    model: str = "piece_bpe_32k.model",
    reading: str | None = None,
) -> DataFrame:
    """(id, n_tokens, n_viterbi) of each row's whole text.

    n_tokens follows ``reading`` (by default the one the model file was trained for) and
    n_viterbi the best-score paths over the same vocabulary.  Null and empty texts count
    zero; repeated rows are repeated, a null id stays, other columns are not looked at.
    """
    path = tokenizer_file(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path, reading, UNIGRAM)
        for part, column in column_slices(batches, 1, TOGETHER):
            columns = [pa.array(n) for n in counter.counts(column)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["id", "n_tokens", "n_viterbi"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "id long, n_tokens long, n_viterbi long").withColumnRenamed("id", id_col)
