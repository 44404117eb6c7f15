"""Token-id files of patched frame-of-reference blocks.

A file holds the ids of its documents one after another, cut into blocks of ``BLOCK`` ids.
Each block stores the differences to its minimum, packed at the bit width that fits a
percentile of them; the few that do not fit are exceptions, stored with their positions in
a list after the packed bits.  An index of block starts lets a reader decode any range of
ids alone, and a document index holds ids and lengths.

    magic | blocks | sections | footer (json) | footer length (u32) | magic

The sections, named in the footer with their offsets, are the block minima (u32), widths
(u8), numbers of exceptions (u16) and starts (u64), and the documents' ids (i64), whether
they have one (u8) and token counts (u64).  All numbers are little-endian.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .common import column_slices, filesystem, fresh_dir, remove_dir, store, tokenizer_file
from .distinct import gathered, rows_in_order, words_of

MAGIC = b"PFORTOK1"
BLOCK = 512
#: Share of a block's differences that the packed width fits.
PERCENTILE = 0.9
#: Blocks that are packed or unpacked together.
TOGETHER = 512
#: Pieces that a worker remembers between slices, and bytes that each may take on average.
REMEMBERED, REMEMBERED_BYTES = 500_000, 64
#: Text bytes whose pieces are numbered together, and of which ids are laid out together.
TEXT_BYTES, LAID_BYTES = 20 << 20, 3 << 20
#: Pieces given to the library as one text, whose tokens it describes at some length.
LINES = 300


# -- blocks -----------------------------------------------------------------------------------


def bit_lengths(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.uint8)


def encode_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(minima, widths, numbers of exceptions, bytes) of whole blocks, ids being (blocks, BLOCK) u32."""
    low = ids.min(axis=1)
    over = ids - low[:, None]
    fits = int(np.ceil(percentile * ids.shape[1])) - 1
    widths = bit_lengths(np.partition(over, fits, axis=1)[:, fits])
    out: list[bytes] = [b""] * len(ids)
    counts = np.zeros(len(ids), dtype=np.uint16)
    for w in np.unique(widths).tolist():
        at = np.flatnonzero(widths == w)
        part = over[at]
        # what is above the width goes to the exceptions, so narrow integers will do
        narrow = part.astype(np.uint16 if w <= 16 else np.uint32)
        bits = np.empty((*part.shape, w), dtype=np.uint8)
        for b in range(w):
            np.bitwise_and(narrow >> b, 1, out=bits[:, :, b], casting="unsafe")
        packed = np.packbits(bits.reshape(len(at), -1), axis=1, bitorder="little")
        for k, row, payload in zip(at.tolist(), part, packed):
            where = np.flatnonzero(row >> np.uint32(w)) if w < 32 else np.empty(0, np.int64)
            counts[k] = len(where)
            out[k] = payload.tobytes() + where.astype("<u2").tobytes() + row[where].astype("<u4").tobytes()
    return low, widths, counts, out


def decode_blocks(raw: bytes, low: np.ndarray, widths: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ids of blocks, (blocks, BLOCK) u32; starts are positions in ``raw``."""
    data = np.frombuffer(raw, np.uint8)
    out = np.empty((len(low), BLOCK), dtype=np.uint32)
    for w in np.unique(widths).tolist():
        at = np.flatnonzero(widths == w)
        size = BLOCK * w // 8
        packed = data[starts[at][:, None] + np.arange(size)]
        bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(at), BLOCK, w)
        values = np.zeros((len(at), BLOCK), dtype=np.uint32)
        for b in range(w):
            values |= bits[:, :, b].astype(np.uint32) << np.uint32(b)
        for k, row in zip(at.tolist(), values):
            n, first = int(counts[k]), int(starts[k]) + size
            if n:
                row[np.frombuffer(raw, "<u2", n, first)] = np.frombuffer(raw, "<u4", n, first + 2 * n)
        out[at] = values
    return out + low[:, None]


class Writer:
    """Writes documents' ids to an open file; what it holds is a few blocks and the indexes."""

    def __init__(self, out):
        self.out, self.at = out, len(MAGIC)
        out.write(MAGIC)
        self.rest = np.empty(0, np.uint32)
        self.sections: dict[str, list] = {k: [] for k in ("low", "width", "exceptions", "start", "doc_id", "has_id", "tokens")}
        self.tokens = 0

    def add(self, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> None:
        s = self.sections
        s["doc_id"] += [d or 0 for d in doc_ids]
        s["has_id"] += [d is not None for d in doc_ids]
        s["tokens"] += lengths
        self.tokens += len(ids)
        ids = np.concatenate((self.rest, ids))
        whole = len(ids) // BLOCK * BLOCK
        self._blocks(ids[:whole])
        self.rest = ids[whole:]

    def _blocks(self, ids: np.ndarray) -> None:
        s = self.sections
        for a in range(0, len(ids), TOGETHER * BLOCK):
            low, widths, counts, blocks = encode_blocks(ids[a : a + TOGETHER * BLOCK].reshape(-1, BLOCK))
            s["low"] += low.tolist()
            s["width"] += widths.tolist()
            s["exceptions"] += counts.tolist()
            for block in blocks:
                s["start"].append(self.at)
                self.out.write(block)
                self.at += len(block)

    def close(self) -> None:
        if len(self.rest):
            # the last block is filled up with its last id; the footer has the true count
            self._blocks(np.concatenate((self.rest, np.full(BLOCK - len(self.rest), self.rest[-1], np.uint32))))
        self.sections["start"].append(self.at)
        kinds = {"low": "<u4", "width": "u1", "exceptions": "<u2", "start": "<u8", "doc_id": "<i8", "has_id": "u1", "tokens": "<u8"}
        footer = {"tokens": self.tokens, "docs": len(self.sections["doc_id"]), "block": BLOCK, "sections": {}}
        for name, kind in kinds.items():
            raw = np.array(self.sections[name], dtype=kind).tobytes()
            footer["sections"][name] = [self.at, len(raw), kind]
            self.out.write(raw)
            self.at += len(raw)
        tail = json.dumps(footer).encode()
        self.out.write(tail + np.uint32(len(tail)).tobytes() + MAGIC)


class Reader:
    """Reads a token file: its documents, and any range of its ids."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        end = self.file.read_at(len(MAGIC) + 4, size - len(MAGIC) - 4)
        if end[4:] != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{uri} is no token file")
        length = int(np.frombuffer(end[:4], "<u4")[0])
        self.footer = json.loads(self.file.read_at(length, size - len(MAGIC) - 4 - length))
        part = {k: np.frombuffer(self.file.read_at(n, at), kind) for k, (at, n, kind) in self.footer["sections"].items()}
        self.low, self.width, self.exceptions, self.start = (part[k] for k in ("low", "width", "exceptions", "start"))
        self.doc_id, self.has_id, self.counts = part["doc_id"], part["has_id"].astype(bool), part["tokens"].astype(np.int64)
        self.tokens = self.footer["tokens"]

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop, from the blocks that hold them."""
        stop = min(stop, self.tokens)
        if stop <= start:
            return np.empty(0, np.uint32)
        a, b = start // BLOCK, -(-stop // BLOCK)
        at = int(self.start[a])
        raw = self.file.read_at(int(self.start[b]) - at, at)
        ids = decode_blocks(raw, self.low[a:b], self.width[a:b], self.exceptions[a:b], (self.start[a:b] - np.uint64(at)).astype(np.int64))
        return ids.reshape(-1)[start - a * BLOCK : stop - a * BLOCK]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, first token, ids) of each document, decoding some blocks at a time."""
        ends = np.cumsum(self.counts)
        doc = 0
        while doc < len(ends):
            first = int(ends[doc] - self.counts[doc])
            # documents that end within the next blocks, one at least
            last = max(doc + 1, int(np.searchsorted(ends, first + TOGETHER * BLOCK, "right")))
            ids = self.read(first, int(ends[last - 1]))
            for k in range(doc, last):
                a = int(ends[k] - self.counts[k])
                yield int(self.doc_id[k]) if self.has_id[k] else None, a, ids[a - first : int(ends[k]) - first]
            doc = last


#: A white-space character, by any common definition of white space.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
#: Two white-space characters side by side.
SIDE_BY_SIDE = SPACE + "{2}"
#: A full stop or comma that does not follow a letter or digit, or precedes a visible character that is neither.
MARK_BESIDE = r"(^|[^\pL\pN])[.,]|[.,][^\pL\pN\s]"
#: A piece of letters that every version of Unicode has as letters.
LETTERS = r"^\x00?[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{391}-\x{3A1}\x{3A3}-\x{3CE}\x{410}-\x{44F}]+$"


# -- tokens -----------------------------------------------------------------------------------


def byte_signs() -> np.ndarray:
    """The character of each byte in a byte-level vocabulary: itself if it is visible in Latin-1, else the next from U+0100 on."""
    own = [33 <= b <= 126 or 161 <= b <= 172 or b >= 174 for b in range(256)]
    return np.where(own, np.arange(256), 255 + np.cumsum(~np.array(own))).astype("<u2")


class Tokens:
    """Ids of whole texts by a byte-level BPE of the tokenizers library.

    The library cuts a text by its pre-tokenizer's pattern and encodes each cut on its own.
    Arrow splits the texts at places that always begin a cut: a single space between visible
    characters, a line break there and, where marks are neither doubled nor beside other
    signs, a full stop or comma.  Each distinct piece that is not remembered is given to the
    library once, many as the lines of one text: pieces of letters are one cut, so they go
    to its model without the pattern, others are cut by it.  Texts with white space side by
    side, a null character or a special token's string go to the library whole.

    Pieces are remembered as an Arrow array, which is the head of the dictionary in which
    the next slice's pieces are numbered, and their ids as one array.
    """

    #: Ends a line: white space that is a cut of its own between visible characters.
    LINE = "\n"
    #: Begins a piece that has no space before it.
    BARE = "\0"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.plain = spec.get("normalizer") is None and spec.get("pre_tokenizer") == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True
        }
        self.unusual = (self.BARE, *(t["content"] for t in spec.get("added_tokens", [])))
        line = self.library.encode(self.LINE, add_special_tokens=False).ids
        self.line_id = line[0] if len(line) == 1 else None
        self.signs = byte_signs()
        # the same model for lines of signs, each of which is one cut
        mark = chr(self.signs[ord(self.LINE)])
        lines = {"type": "Split", "pattern": {"String": mark}, "behavior": "Isolated", "invert": False}
        bare = {"pre_tokenizer": lines, "added_tokens": [], "normalizer": None, "post_processor": None, "decoder": None}
        self.model = Tokenizer.from_str(json.dumps(spec | bare)) if self.plain else None
        self.known = pa.array([], pa.string())
        self.ids, self.stops = np.empty(0, "<u4"), np.zeros(1, np.int64)
        self.used, self.now = np.empty(0, np.int64), 0

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _of_lines(self, shown: pa.Array, cut: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids of texts without white space inside, how many each has); cut: by the library's pattern."""
        if not len(shown):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        lines = pc.binary_join_element_wise(shown, self.LINE, "")
        _, stops, signs = lines.buffers()
        stops, raw, found = np.frombuffer(stops, np.int32)[lines.offset :], np.frombuffer(signs, np.uint8), []
        for at in range(0, len(shown), LINES):
            part = raw[stops[at] : stops[min(at + LINES, len(shown))] - 1]
            if cut:
                found.append(self._library(part.tobytes().decode()))
            else:
                text = self.signs[part].tobytes().decode("utf-16-le")
                found.append(np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4"))
            found.append(np.array([self.line_id], "<u4"))
        ids = np.concatenate(found)
        breaks = ids == self.line_id
        return ids[~breaks], np.diff(np.flatnonzero(breaks), prepend=-1) - 1

    def _plain(self, column: pa.Array) -> np.ndarray:
        """Whether a text need not go to the library whole."""
        if not self.plain:
            return np.zeros(len(column), dtype=bool)
        odd = pc.or_(pc.equal(column, ""), pc.match_substring_regex(column, SIDE_BY_SIDE))
        for mark in self.unusual:
            odd = pc.or_(odd, pc.match_substring(column, mark))
        return ~odd.to_numpy(zero_copy_only=False)

    def _spaced(self, column: pa.Array) -> pa.Array:
        """Plain texts with a space before every piece; one that has none before it in the text begins with ``BARE``."""
        apart = pc.invert(pc.match_substring_regex(column, MARK_BESIDE))
        column = pc.binary_join_element_wise(self.BARE, pc.replace_substring(column, "\n", f" {self.BARE}\n {self.BARE}"), "")
        marked = column
        for mark in ".,":
            marked = pc.replace_substring(marked, mark, f" {self.BARE}{mark}")
        return pc.if_else(apart, marked, column)

    def _learn(self, known: pa.Array) -> None:
        """Remembers pieces of which ``known`` so far is the head; a piece has a space before it unless it begins with ``BARE``."""
        pieces = known.slice(len(self.known))
        bare = pc.starts_with(pieces, self.BARE)
        shown = pc.if_else(bare, pc.utf8_slice_codeunits(pieces, 1), pc.binary_join_element_wise(" ", pieces, ""))
        letters = pc.match_substring_regex(pieces, LETTERS).to_numpy(zero_copy_only=False)
        # a line must have something in it, and no white space but its first space
        alone = pc.or_(pc.match_substring_regex(pieces, SPACE), pc.is_in(pieces, pa.array(["", self.BARE]))).to_numpy(zero_copy_only=False)
        if self.line_id is None:
            letters, alone = np.zeros_like(letters), np.ones_like(alone)
        kinds = np.where(letters, 0, np.where(alone, 2, 1))
        parts, counts = [], np.zeros(len(pieces), np.int64)
        for kind in (0, 1):
            ids, counts[kinds == kind] = self._of_lines(shown.filter(pa.array(kinds == kind)), cut=kind == 1)
            parts.append(ids)
        others = [self._library(t) for t in shown.filter(pa.array(kinds == 2)).to_pylist()]
        counts[kinds == 2] = [len(x) for x in others]
        flat, order = np.concatenate([*parts, *others]), np.argsort(kinds, kind="stable")
        shift = np.empty(len(pieces), np.int64)
        shift[order] = np.cumsum(counts[order]) - counts[order]
        ids, ends = gathered(flat, shift, counts, np.arange(len(pieces)), np.arange(len(pieces) + 1))
        # all at once, so that an error above leaves what was remembered
        self.known, self.used = known, np.concatenate((self.used, np.zeros(len(pieces), np.int64)))
        self.ids, self.stops = np.concatenate((self.ids, ids)), np.concatenate((self.stops, ends[1:] + len(self.ids)))

    def _forget(self) -> None:
        """Keeps the pieces that were met last, half as many as may be remembered, if they are too many or too long."""
        sizes = pc.binary_length(self.known).to_numpy(zero_copy_only=False).astype(np.int64) + 4 * np.diff(self.stops)
        if len(sizes) <= REMEMBERED and sizes.sum() <= REMEMBERED * REMEMBERED_BYTES:
            return
        order = np.argsort(-self.used, kind="stable")[: REMEMBERED // 2]
        kept = np.sort(order[np.cumsum(sizes[order]) <= REMEMBERED * REMEMBERED_BYTES // 2])
        known = self.known.take(pa.array(kept))
        self.ids, self.stops = gathered(self.ids, self.stops[:-1], np.diff(self.stops), kept, np.arange(len(kept) + 1))
        self.known, self.used = known, self.used[kept]

    def _numbered(self, words: list[pa.Array]) -> list[np.ndarray]:
        """The place in ``known`` of each word of each array, after those that are new have been learnt."""
        self._forget()
        self.now += 1
        chunks = pa.chunked_array([self.known, *words], pa.string()).dictionary_encode().chunks
        before = len(self.known)
        if chunks:
            self._learn(chunks[0].dictionary)
        places = iter(chunks[before > 0 :])  # empty arrays have no chunk
        found = [next(places).indices.to_numpy(zero_copy_only=False) if len(w) else np.empty(0, np.int32) for w in words]
        for index in found:
            self.used[index] = self.now
        pa.default_memory_pool().release_unused()
        return found

    def encode_slices(self, columns: list[pa.Array]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of the texts end to end as u32, where each ends, from 0 on) of each column; their pieces are numbered together."""
        columns = [pc.fill_null(c, "") for c in columns]
        plain = [self._plain(c) for c in columns]
        split = [words_of(self._spaced(c.filter(pa.array(p)))) for c, p in zip(columns, plain)]
        index, ends = self._numbered([words for words, _ in split]), [e for _, e in split]
        del split
        ids, shift, counts = self.ids, self.stops[:-1], np.diff(self.stops)
        for k, column in enumerate(columns):
            yield rows_in_order(
                plain[k], lambda: gathered(ids, shift, counts, index[k], ends[k]), lambda row: self._library(column[row].as_py())
            )

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the texts end to end as u32, where each ends, from 0 on)."""
        return next(self.encode_slices([column]))


@lru_cache(maxsize=4)
def tokens_of(path: str) -> Tokens:
    """One encoder for all the tasks of a worker."""
    return Tokens(path)


def write(
    docs: DataFrame,
    out_dir: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "byte_bpe_50k.json",
    end_id: int | None = 2,
) -> DataFrame:
    """Writes token files in ascending id order; (shard, path, docs, tokens, first_token) of each.

    Rows are dealt by ranges of (id, text hash), so files follow each other in id order and
    a repeated id can't fill one task; null ids come first.  Each task streams its texts to
    one file.  first_token, the tokens of all files before, is a sum over the files' list.
    ``end_id`` follows every document; null and empty texts have only that.
    """
    spark, path = docs.sparkSession, tokenizer_file(tokenizer)
    ending = np.array([] if end_id is None else [end_id], dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        name = f"{out_dir}/tokens-{shard:06d}.pfor"
        total = {"docs": 0, "tokens": 0}

        def fill(out) -> None:
            writer, tokens = Writer(out), tokens_of(path)
            for together, _ in column_slices(batches, 1, TEXT_BYTES):
                parts, columns = zip(*column_slices([together], 1, LAID_BYTES))
                for part, (ids, ends) in zip(parts, tokens.encode_slices(list(columns))):
                    lengths = np.diff(ends) + len(ending)
                    ids = np.insert(ids, np.repeat(ends[1:], len(ending)), np.tile(ending, len(lengths)))
                    writer.add(part.column(0).to_pylist(), lengths.tolist(), ids)
                    total["docs"] += len(lengths)
            total["tokens"] = writer.tokens
            writer.close()

        store(name, fill)
        if total["docs"]:
            row = [[shard], [name], [total["docs"]], [total["tokens"]]]
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["shard", "path", "docs", "tokens"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ranged = source.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    shards = ranged.mapInArrow(run, "shard int, path string, docs long, tokens long").collect()  # a row a file
    at, rows = 0, []
    for s in sorted(shards, key=lambda s: s["shard"]):
        rows.append((s["shard"], s["path"], s["docs"], s["tokens"], at))
        at += s["tokens"]
    store(f"{out_dir}/manifest.json", lambda out: out.write(json.dumps([list(r) for r in rows]).encode()))
    return spark.createDataFrame(rows, "shard int, path string, docs long, tokens long, first_token long")


def read(spark: SparkSession, files: DataFrame, with_ids: bool = False, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document in the files, and its ids if asked for.

    start counts the ids of all documents before it in all files, ids_crc32 is the unsigned
    crc32 of its ids as little-endian u32.
    """
    schema = "id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("path").to_pylist(), batch.column("first_token").to_pylist()):
                rows: list[tuple] = []
                for doc, start, ids in Reader(name).documents():
                    row = (doc, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                    rows.append((*row, ids.astype("<i4")) if with_ids else row)
                    if len(rows) == 4096:
                        yield _batch(rows, with_ids)
                        rows = []
                if rows:
                    yield _batch(rows, with_ids)

    count = max(1, files.count())
    return files.repartition(count, "shard").mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = ["id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * with_ids
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """What ``read`` finds in the files that ``write`` makes of ``docs``; the files are removed."""
    spark = docs.sparkSession
    out_dir = fresh_dir(spark, "tokens")
    found = cut(read(spark, write(docs, out_dir, **options)))
    remove_dir(spark, out_dir)
    return found
