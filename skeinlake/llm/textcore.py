"""Word, line and window primitives over whole Arrow string columns.

Texts are never turned into Python strings here: the UTF-8 buffers of an Arrow
column are cut into words with numpy, and words, lines and windows get 64-bit
fingerprints. A fingerprint sums random 64-bit values of the bytes times powers
of an odd base modulo 2**64 and is then mixed, so unequal inputs collide with a
chance near 2**-60; callers that compare across a corpus use two of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text handled at once; one longer text is handled alone.
SLICE_BYTES = 2 << 20
PIECE = 1 << 20

#: Word bytes of `[^\x20\x09-\x0D]+`: all but ASCII white space.
PLAIN = np.ones(256, bool)
PLAIN[[9, 10, 11, 12, 13, 32]] = False
#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
LINE = np.ones(256, bool)
LINE[10] = False
#: Bytes that begin a code point.
LEADS = np.ones(256, bool)
LEADS[128:192] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASES = (0x9E3779B97F4A7C15 | 5, 0xC2B2AE3D27D4EB4F | 3)
_TABLES: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, on a fresh array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _tables(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if seed not in _TABLES:
        base = _BASES[seed] & 0xFFFFFFFFFFFFFFFF
        values = mix(np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03 + 2 * seed))
        up = np.full(PIECE + 1, base, U64)
        down = np.full(PIECE + 1, pow(base, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        _TABLES[seed] = values, np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _TABLES[seed]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and each row's offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    kind = np.dtype(np.int64 if wide else np.int32)
    offs = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind.itemsize).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose texts hold about ``limit`` bytes together."""
    _, offs = buffers(batch.column(name))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


@dataclass
class Spans:
    """Words or lines of several texts: byte ranges and the row of each."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def bounds(self) -> np.ndarray:
        """first[i]:first[i + 1] are the spans of row i."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))

    def per_row(self, values: np.ndarray | None = None) -> np.ndarray:
        if values is None:
            return np.bincount(self.row, minlength=self.rows).astype(np.int64)
        return sums(values, self.bounds())

    def hashes(self, seed: int = 0) -> np.ndarray:
        return mix(span_sums(self.data, self.starts, self.ends, seed) + (self.ends - self.starts).astype(U64))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def span_sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Polynomial fingerprints of byte ranges that are in order and don't overlap; not mixed."""
    values, up, down = _tables(seed)
    out = np.zeros(len(starts), U64)
    k = 0
    while k < len(starts):
        low = int(starts[k])
        to = int(np.searchsorted(ends, low + PIECE, "right"))
        if to <= k:  # one span of more than PIECE bytes
            total, scale = 0, 1
            for at in range(low, int(ends[k]), PIECE):
                part = values[data[at : min(at + PIECE, int(ends[k]))]]
                total = (total + int((part * up[: len(part)]).sum(dtype=U64)) * scale) % (1 << 64)
                scale = scale * int(up[PIECE]) % (1 << 64)
            out[k] = total
            k += 1
            continue
        high = int(ends[to - 1])
        part = values[data[low:high]]
        part *= up[: len(part)]
        total = np.zeros(len(part) + 1, U64)
        np.cumsum(part, out=total[1:])
        s, e = starts[k:to] - low, ends[k:to] - low
        out[k:to] = (total[e] - total[s]) * down[s]
        k = to
    return out


def spans(column: pa.Array, table: np.ndarray = PLAIN, lower: bool = False) -> Spans:
    """Maximal runs of the table's bytes within each text; with LINE, lines that aren't empty."""
    data, offs = buffers(column)
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = table[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    row = np.searchsorted(offs, starts, "right") - 1
    return Spans(data, offs, starts, ends, row)


def words(column: pa.Array) -> Spans:
    return spans(column, PLAIN)


def alnum_words(column: pa.Array) -> Spans:
    return spans(column, ALNUM, lower=True)


def code_points(s: Spans) -> np.ndarray:
    """Code points in each span."""
    total = np.zeros(len(s.data) + 1, np.int64)
    np.cumsum(LEADS[s.data], out=total[1:])
    return total[s.ends] - total[s.starts]


def windows(hashes: np.ndarray, row: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of n consecutive spans and the index where each begins, within rows."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    step = U64(_BASES[1 - seed] & 0xFFFFFFFFFFFFFFFF)
    total = hashes[:m].copy()
    for j in range(1, n):
        total *= step
        total += hashes[j : j + m]
    at = np.flatnonzero(row[:m] == row[n - 1 :])
    return mix(total[at]), at


def cover(at: np.ndarray, n: int | np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` places lie in some range [at, at + n)."""
    delta = np.zeros(size + 1, np.int64)
    np.add.at(delta, at, 1)
    np.add.at(delta, at + n, -1)
    return np.cumsum(delta[:-1]) > 0


def joined(s: Spans, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's kept spans joined by one space: bytes and offsets."""
    if not keep.any():
        return np.zeros(0, np.uint8), np.zeros(s.rows + 1, np.int64)
    size = (s.ends - s.starts)[keep] + 1
    starts, row = s.starts[keep], s.row[keep]
    to = np.cumsum(size)
    begin = to - size
    at = np.arange(int(to[-1])) - np.repeat(begin - starts, size)
    out = s.data[np.minimum(at, len(s.data) - 1)]
    out[to - 1] = 32
    first = np.searchsorted(row, np.arange(s.rows + 1))
    offs = np.concatenate(([0], to))[first]
    return out, offs
