"""The distinct words of a slice of texts, split and numbered by Arrow, and sequences put together from them.

A word is looked at in Python once a slice however often it comes; what is done for every
occurrence (splitting, numbering, laying sequences end to end) runs in Arrow and numpy.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def words_of(column: pa.Array, separator: str = " ") -> tuple[pa.Array, np.ndarray]:
    """(the rows' words end to end, words up to each row's end, from 0 on)."""
    split = pc.split_pattern(column, separator)
    ends = np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False), dtype=np.int64)))
    return split.flatten(), ends


def numbered(column: pa.Array, separator: str = " ") -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, number of each row's words in that list, words up to each row's end, from 0 on)."""
    words, ends = words_of(column, separator)
    words = words.dictionary_encode()
    pa.default_memory_pool().release_unused()
    return words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy(zero_copy_only=False), ends


def laid_out(parts: list[bytes], index: np.ndarray, ends: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(the parts that ``index`` names end to end, as numbers of ``kind``; where each row ends, from 0 on)."""
    flat = np.frombuffer(b"".join(parts), kind)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // flat.itemsize
    return gathered(flat, np.cumsum(lengths) - lengths, lengths, index, ends)


def gathered(
    flat: np.ndarray, shift: np.ndarray, lengths: np.ndarray, index: np.ndarray, ends: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """``laid_out`` of parts that lie in ``flat``, each from its ``shift`` on."""
    own = lengths[index]
    stops = np.cumsum(own)
    total = int(stops[-1]) if len(stops) else 0
    # positions are the largest of these arrays, so they are no wider than they need be
    size = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    at = np.repeat((shift[index] - stops + own).astype(size), own)
    at += np.arange(total, dtype=size)
    return flat[at], np.concatenate(([0], stops))[ends]


def rows_in_order(
    plain: np.ndarray, of_plain: Callable[[], tuple[np.ndarray, np.ndarray]], others: Callable[[int], np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all rows end to end, where each ends, from 0 on) of plain rows, given together, and the others, one by one."""
    ids, ends = of_plain()
    if plain.all():
        return ids, ends
    odd = {int(k): others(int(k)) for k in np.flatnonzero(~plain)}
    lengths = np.zeros(len(plain), dtype=np.int64)
    lengths[plain] = np.diff(ends)
    for k, x in odd.items():
        lengths[k] = len(x)
    stops = np.concatenate(([0], np.cumsum(lengths)))
    out = np.empty(stops[-1], dtype=ids.dtype)
    own = lengths[plain]
    out[np.repeat(stops[:-1][plain] - ends[:-1], own) + np.arange(len(ids))] = ids
    for k, x in odd.items():
        out[stops[k] : stops[k + 1]] = x
    return out, stops
