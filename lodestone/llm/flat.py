"""Columns of texts as flat arrays of words or of pieces for a tokenizer, without a Python object for each.

A column is taken in slices of bounded bytes; the bytes of a slice are classed by table, cut where classes say so, and the
stretches between cuts are told apart by 64-bit hashes. So costs in Python are by different string, and memory is by slice.

Cases: a null text is an empty one; empty texts have no words and no pieces; a text that is longer than a slice is a slice of
its own; an empty column gives no slices.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 8 << 20
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: Bytes of a stretch up to which stretches are hashed together.
LONG = 256

LETTER, DIGIT, OTHER, QUOTE, BLANK, WHITE, HIGH = range(7)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[128:] = HIGH
_CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
_CLASS[48:58] = DIGIT
_CLASS[39], _CLASS[32] = QUOTE, BLANK
#: ASCII characters that \s matches; those beyond the six common ones are left uncut with what stands beside them.
_CLASS[9:14] = WHITE
_CLASS[28:32] = HIGH
_NO_WORD = np.zeros(256, bool)
_NO_WORD[[32, *range(9, 14)]] = True
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Where a tokenizer's pattern always ends a match between two characters, by their classes. A blank belongs to what follows
#: it, an apostrophe may begin a contraction, and characters beyond ASCII may be of any class.
_ENDS = np.zeros((7, 7), bool)
_ENDS[LETTER, [DIGIT, OTHER, QUOTE, BLANK, WHITE]] = True
_ENDS[DIGIT, [LETTER, OTHER, QUOTE, BLANK, WHITE]] = True
_ENDS[OTHER, [LETTER, DIGIT, BLANK, WHITE]] = True
_ENDS[QUOTE, [DIGIT, BLANK, WHITE]] = True
_ENDS[WHITE, [LETTER, DIGIT, OTHER, QUOTE]] = True
_ENDS = np.ascontiguousarray(_ENDS).reshape(-1)
_WHITE, _SEEN = np.zeros(7, bool), np.zeros(7, bool)
_WHITE[[BLANK, WHITE]] = True
_SEEN[[LETTER, DIGIT, OTHER, QUOTE]] = True


def slices(batch: pa.RecordBatch, text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, so many bytes of the text column at a time, one row at least."""
    n = batch.num_rows
    if not n:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def give_back() -> None:
    """Free memory goes back to the system, as an idle worker would keep it from the next stage's workers."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each row begins, and the end)."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, ends - ends[0]


def hashes(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches of the bytes, eight bytes of all of them at a time."""
    eight = np.ndarray((len(flat) + 1,), "<u8", np.concatenate([flat, np.zeros(8, np.uint8)]), strides=(1,))
    h = sizes.astype(np.uint64) * _M2
    # A stretch of many bytes is hashed by itself.
    todo = np.flatnonzero((sizes > 0) & (sizes <= LONG))
    for j in range(0, LONG, 8):
        x, rest = eight[starts[todo] + j], sizes[todo] - j
        x &= _KEEP[np.minimum(rest, 8)]
        g = (h[todo] ^ x) * _M1
        h[todo] = g ^ (g >> np.uint64(32))
        todo = todo[rest > 8]
        if not len(todo):
            break
    h *= _M2
    h ^= h >> np.uint64(29)
    for i in np.flatnonzero(sizes > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(flat[starts[i] : starts[i] + sizes[i]].tobytes())
    return h


def dictionary(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(which, strings) of the stretches of the bytes that begin at starts, which are all places but the last."""
    if len(starts) < 2:
        return np.zeros(0, np.int64), []
    which, names = pd.factorize(hashes(flat, starts[:-1], np.diff(starts)))
    first = np.empty(len(names), np.int64)
    first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
    data = flat.tobytes()
    return which, [data[a:b] for a, b in zip(starts[first].tolist(), starts[first + 1].tolist(), strict=True)]


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(names, ends): 64-bit hashes of the words between ASCII white space, A to Z in lower case; those of row i from ends[i] to ends[i + 1]."""
    flat, rows = flat_bytes(column)
    n = len(flat)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(rows), np.int64)
    seen = ~_NO_WORD[flat]
    # A word begins behind white space and at the begin of a row, and ends before white space and at the end of a row.
    edge = np.zeros(n + 1, bool)
    edge[rows] = True
    edge[1:-1] |= seen[1:] != seen[:-1]
    at = np.flatnonzero(edge)
    starts, sizes = at[:-1], np.diff(at)
    is_word = seen[starts]
    starts, sizes = starts[is_word], sizes[is_word]
    return hashes(_LOWER[flat], starts, sizes), np.searchsorted(starts, rows)


def pieces(column: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(which, strings, ends): each row cut where a byte-level tokenizer's pattern surely ends a match.

    A piece holds one match or several; matches never reach over a cut, so pieces can be encoded one by one.
    """
    flat, rows = flat_bytes(column)
    n = len(flat)
    if not n:
        return np.zeros(0, np.int64), [], np.zeros(len(rows), np.int64)
    kind = _CLASS[flat]
    # The Latin letters of two bytes that begin with 0xC3, but for the signs of times and division.
    lead = np.flatnonzero(flat == 0xC3)
    lead = lead[lead + 1 < n]
    lead = lead[(flat[lead + 1] != 0x97) & (flat[lead + 1] != 0xB7)]
    kind[lead] = LETTER
    kind[lead + 1] = LETTER
    cut = np.empty(n, bool)
    cut[0] = True
    cut[1:] = _ENDS[kind[:-1] * np.uint8(7) + kind[1:]]
    # The last character of white space before something else begins a match, unless the row ends behind it.
    begins = rows[:-1][rows[:-1] < n]
    first = np.zeros(n, bool)
    first[begins] = True
    cut[:-1] |= (_WHITE[kind[:-1]] & _SEEN[kind[1:]]) > first[1:]
    cut[begins] = True
    starts = np.flatnonzero(cut)
    which, strings = dictionary(flat, np.append(starts, n))
    return which, strings, np.searchsorted(starts, rows)


def joined(strings: list[bytes] | pa.Array, which: np.ndarray, ends: np.ndarray) -> tuple[pa.Buffer, np.ndarray]:
    """(bytes, where each row begins, and the end) of rows put together from strings; memory is that of the result."""
    if not len(which):
        return pa.py_buffer(b""), np.zeros(len(ends), np.int64)
    taken = (strings if isinstance(strings, pa.Array) else pa.array(strings, pa.large_binary())).take(pa.array(which))
    at = np.frombuffer(taken.buffers()[1], np.int64)[: len(which) + 1]
    return taken.buffers()[2] or pa.py_buffer(b""), at[ends]
