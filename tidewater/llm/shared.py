"""Whole-batch text handling on flat byte arrays, for several operators of this subpackage.

The helpers work on the value buffer of an Arrow string column, so a batch of
documents is one ``uint8`` array plus row offsets; no per-row Python strings.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewater.scratch import Scratch  # noqa: F401  (the operators' common import place)

#: Bytes of text that one numpy step handles (a longer single row is handled alone).
BLOCK_BYTES = 1 << 20


def text_or_empty(col: str):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


# ---------------------------------------------------------------- flat text blocks

def string_blocks(column: pa.Array, max_bytes: int = BLOCK_BYTES):
    """Yield (first row, offsets, bytes) of consecutive rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind, width = pa.large_binary(), np.int64
    else:
        kind, width = pa.binary(), np.int32
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, width)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offs, offs[row] + max_bytes, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, offs[row:end + 1] - offs[row], data[offs[row]:offs[end]]
        row = end


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(offs: np.ndarray, data: np.ndarray):
    """(starts, ends, row of each) of the maximal runs without ASCII white space; rows are borders."""
    solid = ~_SPACE[data]
    if not solid.any():
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.empty(len(data), bool)
    first[0] = solid[0]
    np.logical_and(solid[1:], ~solid[:-1], out=first[1:])
    last = np.empty(len(data), bool)
    last[-1] = solid[-1]
    np.logical_and(solid[:-1], ~solid[1:], out=last[:-1])
    borders = offs[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    first[borders] = solid[borders]
    last[borders - 1] = solid[borders - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    rows = np.searchsorted(offs, starts, "right") - 1
    return starts, ends, rows


# ---------------------------------------------------------------- rolling hashes

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.RandomState(20240117).randint(0, 1 << 62, 256).astype(np.uint64) * np.uint64(3) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        a = np.full(max(n, 1 << 20), np.uint64(base), np.uint64)
        a[0] = 1
        have = np.multiply.accumulate(a)
        if len(have) <= 8 << 20:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j]-H[i] = sum of byte values times base**position over [i, j), modulo 2**64."""
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=h[1:])
    return h


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes [start, end): equal bytes, equal hash, wherever they stand."""
    inv = _power(_INVERSE, len(h))
    return mix((h[ends] - h[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def sorted_distinct(rows: np.ndarray, values: np.ndarray):
    """Distinct (row, value) pairs, by row then value."""
    order = np.lexsort((values, rows))
    r, v = rows[order], values[order]
    if not len(r):
        return r, v
    keep = np.ones(len(r), bool)
    keep[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    return r[keep], v[keep]


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offs = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(values, kind))
