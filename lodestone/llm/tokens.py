"""Token ids of a public byte-level vocabulary, exactly as the tokenizer gives them, one distinct unit at a time.

The published split pattern never joins what stands before a white-space gap with what stands after it, so a text
falls into units that can be encoded by themselves: a run without white space together with one plain space before it,
and what is left of the gap (all but its last character, which is a unit of its own unless it's that plain
space; a gap at the end of a text is one unit). Every worker encodes a unit once and remembers it. Texts with
white space outside ASCII (told by its exact bytes, so that quotes, dashes and other alphabets take the fast way) are left to the
tokenizer as they are. Null and empty texts have no tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lodestone.llm import arrays as A
from lodestone.llm.vocab import PATTERN, TOKENIZERS, byte_ranks

RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.memo = A.Memo()
        self.ids, self.at = np.zeros(0, self.kind), np.zeros(1, np.int64)

    def _learn(self, keys: np.ndarray, units: list[str]) -> None:
        if self.memo.n > self.memo.most:
            self.memo.clear()
            self.ids, self.at = np.zeros(0, self.kind), np.zeros(1, np.int64)
        got = [self.encoding.encode_ordinary(u) for u in units]
        size = np.fromiter(map(len, got), np.int64, len(got))
        self.ids = np.concatenate([self.ids, np.fromiter((t for g in got for t in g), self.kind, int(size.sum()))])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(size)])
        self.memo.add(keys)

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets)."""
        parts, sizes = [], []
        for i, j in A.row_blocks(col, 1 << 22):
            ids, size = self._block(col.slice(i, j - i))
            parts.append(ids)
            sizes.append(size)
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        return np.concatenate(parts) if parts else np.zeros(0, self.kind), np.concatenate([[0], np.cumsum(size)])

    def _block(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, off = A.buffers(col)
        n = len(off) - 1
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(n, np.int64)
        odd_rows = np.unique(np.searchsorted(off, wide_spaces(data), "right") - 1)
        direct = np.zeros(n, bool)
        direct[odd_rows] = True
        row, s, e = units(data, off)
        use = ~direct[row]
        row, s, e = row[use], s[use], e[use]
        h = A.hashes(data, s, e)
        keys, at, inverse = A.unique_first(h)
        slot, known = self.memo.find(keys)
        if not known.all():
            if self.memo.n > self.memo.most:
                known[:] = False  # _learn forgets all; relearn this block's
            raw = data.tobytes()
            new = at[~known]
            self._learn(keys[~known], [raw[a:b].decode() for a, b in zip(s[new].tolist(), e[new].tolist(), strict=True)])
            slot, _ = self.memo.find(keys)
        size = (self.at[1:] - self.at[:-1])[slot][inverse]
        ids = self.ids[A.ragged(self.at[slot][inverse], size)]
        count = np.bincount(row, size, n).astype(np.int64)
        if direct.any():
            own = {r: np.array(self.encoding.encode_ordinary(col[r].as_py()), self.kind) for r in odd_rows.tolist()}
            start = np.concatenate([[0], np.cumsum(count)])
            pieces, last = [], 0
            for r in odd_rows.tolist():
                pieces += [ids[start[last] : start[r]], own[r]]
                count[r], last = len(own[r]), r
            pieces.append(ids[start[last] :])
            ids = np.concatenate(pieces)
        return ids, count


def wide_spaces(data: np.ndarray) -> np.ndarray:
    """Where the UTF-8 forms of white space outside ASCII begin: U+0085, 00A0, 1680, 2000-200A, 2028, 2029, 202F, 205F, 3000."""
    at = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if not len(at):
        return at
    pad = np.append(data, np.zeros(2, np.uint8))
    a, b, c = data[at], pad[at + 1], pad[at + 2]
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    general = (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    return at[two | general | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))]


def units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end), ascending, of the units that cover every byte."""
    row, s, e = A.spans(data, off, A.GRAPH)
    grow, gs, ge = A.spans(data, off, ~A.GRAPH)
    stop = off[grow + 1]
    final = ge == stop  # a gap at the end of its text is one unit
    joined = ~final & (data[ge - 1] == 32)
    cut = np.where(final, ge, ge - 1)
    head = cut > gs
    starts = np.concatenate([s, gs[head], ge[~final & ~joined] - 1])
    ends = np.concatenate([e, cut[head], ge[~final & ~joined]])
    rows = np.concatenate([row, grow[head], grow[~final & ~joined]])
    # the plain space that ends a gap goes to the run behind it
    lead = np.zeros(len(data) + 1, bool)
    lead[ge[joined]] = True
    starts[: len(s)] -= lead[s]
    order = np.argsort(starts, kind="stable")
    return rows[order], starts[order], ends[order]


_encoders: dict[str, Encoder] = {}


def encoder(path: str, ranks: dict[bytes, int] | None = None) -> Encoder:
    """This worker's encoder, with its memory of units."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(ranks if ranks is not None else byte_ranks(path))
    return _encoders[path]
