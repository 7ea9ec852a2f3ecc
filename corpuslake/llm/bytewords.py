"""Word boundaries and word hashes of a whole Arrow string column at once.

All word classes used here are unions of ASCII ranges and every non-ASCII
character, so they can be decided byte by byte on UTF-8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpuslake.llm.lean import at_end

U = np.uint64
_rng = np.random.default_rng(20240917)
_BYTE = _rng.integers(0, 2**64, 256, dtype=U)
_P = U(0x9E3779B97F4A7C15 | 1)
_P_INV = U(pow(int(_P), -1, 2**64))
_pow: dict[str, np.ndarray] = {"p": np.ones(1, U), "i": np.ones(1, U)}


def byte_class(not_in: list[tuple[int, int]]) -> np.ndarray:
    """A table of 256 booleans: bytes outside the given inclusive ranges."""
    table = np.ones(256, bool)
    for lo, hi in not_in:
        table[lo : hi + 1] = False
    return table


#: Words between white space: ``[^\x20\x09-\x0D]+``.
SPACED = byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: Words of letters, digits and non-ASCII: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing A-Z).
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@at_end
def _forget_powers() -> None:
    _pow.update(p=np.ones(1, U), i=np.ones(1, U))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow["p"]) < n:
        size = 1 << int(n - 1).bit_length()
        for key, base in (("p", _P), ("i", _P_INV)):
            out = np.full(size, base, U)
            out[0] = 1
            _pow[key] = np.multiply.accumulate(out)
    return _pow["p"], _pow["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (one more than rows); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int):
    """Row ranges of at most ``most`` bytes, of one row at least."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


#: Bytes whose spans are hashed at once; it bounds the tables of powers.
BLOCK = (1 << 20) - (1 << 16)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; starts ascend."""
    out = np.zeros(len(start), U)
    at = 0
    while at < len(start):
        low = int(start[at])
        stop = int(np.searchsorted(start, low + BLOCK))
        s, e = start[at:stop] - low, end[at:stop] - low
        n = int(e.max())
        p, inverse = _powers(n + 1)
        total = np.zeros(n + 1, U)
        np.cumsum(_BYTE[data[low : low + n]] * p[:n], out=total[1:])
        out[at:stop] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(U))
        at = stop
    return out


class Words:
    """Words of consecutive documents: ``start``/``end`` in ``data``; document d has words ``first[d]:first[d+1]``."""

    def __init__(self, data: np.ndarray, off: np.ndarray, table: np.ndarray):
        self.data, self.off = data, off
        n = len(data)
        m = table[data]
        starts, ends = m.copy(), m.copy()
        if n:
            starts[1:] &= ~m[:-1]
            ends[:-1] &= ~m[1:]
            edge = off[1:-1]
            edge = edge[(edge > 0) & (edge < n)]
            starts[edge] = m[edge]
            ends[edge - 1] = m[edge - 1]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return span_hashes(self.data, self.start, self.end)

    def doc(self) -> np.ndarray:
        """The document number of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)


def shingles(h: np.ndarray, k: int, base: int = 0xD1B54A32D192ED03) -> np.ndarray:
    """Hashes of every k consecutive entries (document edges are the caller's)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = h[:n].copy()
    for j in range(1, k):
        out *= U(base)
        out += h[j : j + n]
    return mix(out)


def inside(first: np.ndarray, k: int, total: int) -> np.ndarray:
    """For each start 0..total-k: whether k entries from there stay in one document."""
    n = total - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return doc[:n] == doc[k - 1 :]
