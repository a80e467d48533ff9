"""Vectorised text primitives over Arrow string columns.

Texts are handled as UTF-8 bytes without building Python strings. A token's hash is a
polynomial over its bytes modulo 2**64, read off one running sum for a whole block:

    P[i] = sum_{j<i} v(b_j) * r**-j          hash(s, e) = (P[e] - P[s]) * r**e

so the cost per byte is a table look-up, a product and an addition, and each token costs two
reads. Nulls count as empty texts; blocks are cut at document ends and, in a long
document, between tokens, so memory stays bounded by BLOCK bytes plus the tokens found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 21
U = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser; different salts give independent-looking hashes."""
    h = h ^ U((salt * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def byte_values(fold_case: bool) -> np.ndarray:
    """A random 64-bit value for each byte; A-Z share those of a-z when case is folded."""
    v = mix(np.arange(1, 257, dtype=U), 77)
    if fold_case:
        v[65:91] = v[97:123]
    return v


RAW, FOLDED = byte_values(False), byte_values(True)
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
GRAPH = np.ones(256, bool)
GRAPH[[9, 10, 11, 12, 13, 32]] = False
_POW: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**0 .. r**n and their inverses."""
    if not _POW or len(_POW[0]) <= n:
        size = max(n + 1, BLOCK + 65)
        up, down = np.full(size, U(_R)), np.full(size, U(_RINV))
        up[0] = down[0] = U(1)
        _POW[:] = [np.cumprod(up), np.cumprod(down)]
    return _POW[0], _POW[1]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and len(col) + 1 offsets of a string or binary column; nulls become empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if off else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def row_blocks(col: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer text is a range by itself."""
    _, off = buffers(col)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


def spans(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the maximal runs of bytes with ``inside``; no run crosses rows."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    w = inside[data]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    b = off[1:-1]
    b = b[(b > 0) & (b < n)]
    first[b] = w[b]
    last[b - 1] = w[b - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(s, off)))
    return row, s, e


def hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, values: np.ndarray = RAW) -> np.ndarray:
    """The 64-bit hash of each data[s:e]; equal bytes give equal hashes wherever they stand. Spans ascend."""
    out = np.empty(len(s), U)
    i = 0
    while i < len(s):
        base = int(s[i])
        j = max(i + 1, int(np.searchsorted(e, base + BLOCK, "right")))
        stop = int(e[j - 1])
        up, down = powers(stop - base)
        p = np.zeros(stop - base + 1, U)
        np.cumsum(values[data[base:stop]] * down[: stop - base], out=p[1:])
        a, z = s[i:j] - base, e[i:j] - base
        out[i:j] = (p[z] - p[a]) * up[z]
        i = j
    return mix(out)


def words(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, byte length) of the words: runs of ASCII letters and digits (case folded) and of bytes above 127."""
    data, off = buffers(col)
    row, s, e = spans(data, off, WORD)
    return row, hashes(data, s, e, FOLDED), e - s


def poly_hash(b: bytes, fold_case: bool = False) -> int:
    """The same hash for one byte string, by its definition; for tests and tiny tables."""
    v = FOLDED if fold_case else RAW
    h = 0
    for x in b:
        h = (h + int(v[x])) * _R & 0xFFFFFFFFFFFFFFFF
    return int(mix(np.array([h], U))[0])


class Memo:
    """A worker's memo from 64-bit hashes to row numbers of ragged values; dropped when it grows past ``most`` keys, which costs time only."""

    def __init__(self, most: int = 2_500_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys, self.rows, self.n = np.zeros(0, U), np.zeros(0, np.int64), 0

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each hash, and whether it is known."""
        if not len(self.keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return self.rows[at], self.keys[at] == h

    def add(self, h: np.ndarray) -> None:
        """New sorted distinct hashes, that get the next row numbers in this order."""
        at = np.searchsorted(self.keys, h)
        self.keys = np.insert(self.keys, at, h)
        self.rows = np.insert(self.rows, at, self.n + np.arange(len(h)))
        self.n += len(h)


def unique_first(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct values, an index of each, inverse)."""
    order = np.argsort(h)
    sorted_h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = sorted_h[1:] != sorted_h[:-1]
    inverse = np.empty(len(h), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return sorted_h[new], order[new], inverse


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0] .. starts[0]+lengths[0]-1, starts[1] .. and so on."""
    total = int(lengths.sum())
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) if total else np.zeros(0, np.int64)
    return np.arange(total) + shift
