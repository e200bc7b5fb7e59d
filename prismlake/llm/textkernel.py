"""Vectorised text kernels shared by the Python-side operators.

A text is handled as UTF-8 bytes.  Words are maximal runs of bytes outside
``\\x20 \\x09-\\x0D``; since those bytes never occur inside a multi-byte
character, this equals the pattern ``[^\\x20\\x09-\\x0D]+`` over code points.
Every pass is a whole-array numpy operation over a piece of at most about
``PIECE`` bytes, so memory is bounded by the piece and by 8 bytes per word of
one record batch slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a single longer word is still taken whole.
PIECE = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Translation table that lower-cases A-Z and nothing else.
LOWER_TABLE = bytes(_LOWER)

_MULT = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values (xor-shift-multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix_int(x: int) -> int:
    """``mix64`` of one Python integer."""
    x &= _M64
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & _M64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & _M64
    return x ^ x >> 31


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_POWERS = np.ones(1, dtype=np.uint64)
_INVERSES = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, PIECE + 1024)
        _POWERS = np.full(size, _MULT, dtype=np.uint64)
        _INVERSES = np.full(size, pow(_MULT, -1, 1 << 64), dtype=np.uint64)
        _POWERS[0] = _INVERSES[0] = 1
        np.multiply.accumulate(_POWERS, out=_POWERS)
        np.multiply.accumulate(_INVERSES, out=_INVERSES)
    return _POWERS, _INVERSES


def _hash_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    powers, inverses = _powers(len(data) + 1)
    prefix = np.empty(len(data) + 1, dtype=np.uint64)
    prefix[0] = 0
    value = _BYTE_VALUE[data]
    value *= powers[: len(data)]
    np.cumsum(value, out=prefix[1:])
    out = prefix[end]
    out -= prefix[start]
    out *= inverses[start]
    return mix64(out)


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about PIECE bytes that end at a text's end or, in long texts, at white space."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        if end - at <= PIECE:
            yield at, end
            return
        cut = int(offsets[np.searchsorted(offsets, at + PIECE, side="right") - 1])
        if cut <= at:
            stop = int(offsets[np.searchsorted(offsets, at, side="right")])
            cut = min(at + PIECE, stop)
            while cut < stop:
                gaps = np.flatnonzero(_SPACE[data[at:cut]])
                if len(gaps):
                    cut = at + int(gaps[-1]) + 1
                    break
                cut = min(cut + PIECE, stop)
        yield at, cut
        at = cut


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def word_hashes(column: pa.Array, lower: bool = True, split_classes: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a string column, and n+1 word offsets of its texts.

    With ``split_classes``, runs of letters, digits and non-ASCII bytes and runs
    of other visible characters count as separate words.
    """
    data, offsets = utf8(column)
    hashes, starts_at = [], []
    is_text_start = offsets[:-1][offsets[:-1] < offsets[1:]]
    for a, b in _pieces(data, offsets):
        raw = data[a:b]
        kind = (_CLASS if split_classes else _WORD)[raw]
        change = np.empty(len(raw) + 1, dtype=bool)
        change[0] = change[-1] = True
        np.not_equal(kind[1:], kind[:-1], out=change[1:-1])
        lo, hi = np.searchsorted(is_text_start, (a, b))
        change[is_text_start[lo:hi] - a] = True
        bounds = np.flatnonzero(change)
        keep = kind[bounds[:-1]] != 0
        start = bounds[:-1][keep]
        hashes.append(_hash_runs(_LOWER[raw] if lower else raw, start, bounds[1:][keep]))
        starts_at.append(start + a)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    every = np.concatenate(hashes)
    return every, np.searchsorted(np.concatenate(starts_at), offsets)


_WORD = (~_SPACE).astype(np.uint8)
_CLASS = np.full(256, 2, dtype=np.uint8)
_CLASS[_SPACE] = 0
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _CLASS[_lo:_hi] = 1


def slices(batch: pa.RecordBatch, column: str, most: int = 4 * PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)
