"""SentencePiece encoding and decoding over the shared prefixes of a slice's words.

The distinct marked words of a slice are sorted, which lays their trie out depth first, and
the forward states of common prefixes are reused (see ``forward``).  Each distinct word is
encoded, and what its ids spell compared with it, once a slice; the ids of whole texts are
laid end to end from those of their words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, column_slices, tokenizer_file
from .distinct import laid_out, numbered, rows_in_order
from .forward import Forward
from .pieces import MARK, UNIGRAM, PieceModel, load

#: Words whose ids a worker remembers.
REMEMBERED = 80_000
#: Text bytes whose words are sorted together: the more, the longer the prefixes they share.
TOGETHER = 4 << 20
#: Stands between words; no UTF-8 has this byte.
BORDER = b"\xff"
#: Begins a word that has no mark.
BARE = "\0"


class Words:
    """The marked words of a slice of texts, for a vocabulary."""

    def __init__(self, model: PieceModel, column: pa.Array):
        self.model, self.column = model, pc.fill_null(column, "")
        self.plain = self._plain()
        rows = self.column.filter(pa.array(self.plain))
        items, self.index, self.ends = numbered(pc.replace_substring(rows, "\n", f" {BARE}\n {BARE}"))
        self.items = [w[1:] if w[:1] == BARE else MARK + w for w in items]
        #: The words of the other rows.
        self.odd = {int(k): model.words(self.column[int(k)].as_py()) for k in np.flatnonzero(~self.plain)}

    def _plain(self) -> np.ndarray:
        """Whether a text's words are what stands between its single spaces and line breaks."""
        column = self.column
        if not (self.model.splits and self.model.breaks and self.model.dummy_prefix):
            return np.zeros(len(column), dtype=bool)
        odd = pc.or_(pc.starts_with(column, " "), pc.equal(column, ""))
        for mark in ("  ", MARK, BARE):
            odd = pc.or_(odd, pc.match_substring(column, mark))
        return ~odd.to_numpy(zero_copy_only=False)

    def distinct(self) -> set[str]:
        return set(self.items).union(*self.odd.values())


class Encoder:
    """Encodes slices of texts by one or more readings of a vocabulary, remembering words it has met."""

    def __init__(self, model: PieceModel, *readings: str):
        self.model, self.readings = model, readings or (model.reading,)
        self.forward = Forward(model, self.readings)
        self.known = Remembered(REMEMBERED)

    def _spell_well(self, words: list[str], ids: list[bytes]) -> np.ndarray:
        """Whether each word's ids spell it, looked at one by one only if not all of them do."""
        flat, ends = np.frombuffer(b"".join(ids), "<i4"), np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)
        spelt = [*self.model.spelt, BORDER]
        got = b"".join([spelt[i] for i in np.insert(flat, ends, len(spelt) - 1).tolist()])
        want = (BORDER.decode("utf-8", "surrogateescape").join([*words, ""])).replace(MARK, " ").encode("utf-8", "surrogateescape")
        if got == want:
            return np.ones(len(words), dtype=bool)
        return np.array([a == b for a, b in zip(got.split(BORDER), want.split(BORDER))][:-1], dtype=bool)

    def learn(self, words: set[str]) -> None:
        """Makes ``known`` hold the words: a reading's ids each, and whether all of them spell the word."""
        new = sorted(self.known.missing(words))
        if not new:
            return
        walked = list(self.forward.walk(new))
        columns = [[w[1 if r == UNIGRAM else 2] for w in walked] for r in self.readings]
        good = np.logical_and.reduce([self._spell_well(new, c) for c in columns])
        self.known.young.update(zip(new, zip(*columns, good.tolist())))

    def encode(self, column: pa.Array, check: bool = False) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray | None]:
        """For each reading (ids of the texts end to end, where each ends, from 0 on); and
        whether each text's ids give it back, if that is to be checked."""
        words = Words(self.model, column)
        self.learn(words.distinct())
        known, out = self.known.young, []
        met = list(map(known.__getitem__, words.items))
        for k in range(len(self.readings)):

            def plain(k=k):
                return laid_out([m[k] for m in met], words.index, words.ends, "<i4")

            def odd(row: int, k=k):
                return np.frombuffer(b"".join([known[w][k] for w in words.odd[row]]), "<i4")

            out.append(rows_in_order(words.plain, plain, odd))
        return out, self._gives_back(words, met, out) if check else None

    def _gives_back(self, words: Words, met: list[tuple], out: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Whether decoding gives each text back: its words are spelt one after another, so it does if each of them
        is; any other text is decoded whole."""
        good = np.array([m[-1] for m in met], dtype=bool)
        wrong = np.concatenate(([0], np.cumsum(~good[words.index])))[words.ends]
        sure = np.zeros(len(words.plain), dtype=bool)
        sure[words.plain] = np.diff(wrong) == 0
        for k in np.flatnonzero(~sure).tolist():
            text = words.column[k].as_py()
            sure[k] = all(self.model.decode(ids[ends[k] : ends[k + 1]].tolist()) == text for ids, ends in out)
        return sure


@lru_cache(maxsize=4)
def encoder_of(path: str, *readings: str | None) -> Encoder:
    """One encoder for all the tasks of a worker; None is the reading that the file was trained for."""
    model = load(path)
    return Encoder(model, *(r or model.reading for r in readings))


def id_lists(ids: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model", reading: str | None = None
) -> DataFrame:
    """(id, ids): the piece ids of each row's whole text, in the order of the text.

    Null and empty texts have no ids.  A row is encoded on its own, so repeated rows are
    repeated and a null id stays; other columns are not looked at.
    """
    path = tokenizer_file(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, reading)
        for part, column in column_slices(batches, 1, TOGETHER):
            ((ids, ends),), _ = encoder.encode(column)
            yield pa.RecordBatch.from_arrays([part.column(0), id_lists(ids, ends)], ["id", "ids"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(rows: DataFrame, ids_col: str = "ids", out_col: str = "text", model: str = "piece_bpe_32k.model") -> DataFrame:
    """``rows`` with the text of each row's ids in ``out_col``; null ids give null text.

    An existing column of that name is replaced.
    """
    path = tokenizer_file(model)

    @F.pandas_udf("string")
    def spell(column):
        pieces = load(path)
        return column.map(lambda ids: None if ids is None else pieces.decode(ids))

    return rows.withColumn(out_col, spell(F.col(ids_col)))


def digests(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model"
) -> DataFrame:
    """Per row: its ids, their number n_ids and crc32 ids_crc32, whether decoding them gives the text back,
    and viterbi_n and viterbi_crc32 of the same vocabulary's best-score paths.

    Encoding and decoding run in one pass.  Null and empty texts have no ids, crc32 0, and
    come back.
    """
    path = tokenizer_file(model)
    names = ["id", "n_ids", "ids_crc32", "viterbi_n", "viterbi_crc32", "round_trip", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, None, UNIGRAM)
        for part, column in column_slices(batches, 1, TOGETHER):
            found, back = encoder.encode(column, check=True)
            columns = [part.column(0)]
            for ids, ends in found:
                columns += [pa.array(np.diff(ends)), pa.array([zlib.crc32(ids[a:b]) for a, b in zip(ends, ends[1:])], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(back), id_lists(*found[0])], names)

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, n_ids long, ids_crc32 long, viterbi_n long, viterbi_crc32 long, round_trip boolean, ids array<int>"
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
