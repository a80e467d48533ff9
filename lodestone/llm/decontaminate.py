"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are normalised alike: letters of all alphabets are folded to lower case, bytes that are no letter
or digit (and below 128) become spaces, runs of spaces one. An item of n normalised bytes has a budget of
k = floor(error_rate * n) edits and is cut into k + 1 pieces of nearly equal length. Wherever a text holds
the item with at most k edits, at least one piece stands there unchanged, so an Aho-Corasick scan
for all pieces misses nothing; each place it finds is verified with Myers' bit-parallel distance over
the window that could hold the item. The result is exact: the same as trying every substring.

Items that normalise to fewer than ``least`` bytes are found only without an edit and as whole words, for with edits they
would match by chance; so are shorter ones of SHORTEST_WORDS words or SHORTEST_BYTES bytes at least. What is
shorter still says nothing about where it comes from: ``unmatched_items`` names those, nothing drops them in silence.

Defined results. Null and empty texts match nothing, null items are none. A text of any length is searched whole, in one pass over its
bytes, and takes memory in proportion. Repeated items keep their own item_id; repeated rows give a row each in ``distinct`` form, that is one per (doc_id, item_id), with the least distance.
Rows with null doc_id never appear among the pairs and are judged like others by ``drop_contaminated``. An empty
benchmark or table gives no pairs. Extra columns, also ones named like the results, are carried or ignored.

With ``by_line`` the parts of an item that ``parts`` gives are matched besides the item, each with a budget of its own, so
that a text marks itself that an earlier line dedup left only some of an item's lines.

The benchmark is sent to every task in automata of at most ``pieces_per_pass`` pieces; a larger benchmark
takes more passes over the texts, never a larger broadcast.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import arrays as A
from lodestone.session import ship

ERROR_RATE = 0.05
LEAST = 40
SHORTEST_WORDS, SHORTEST_BYTES = 4, 16
PIECES_PER_PASS = 200_000
_FOLD = np.full(256, 32, np.uint8)
for _b in range(256):
    if A.WORD[_b]:
        _FOLD[_b] = _b


def normalise(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes and offsets; each text ends in byte 10, which nothing else contains."""
    n = len(off) - 1
    b = _FOLD[data]
    space = b == 32
    keep = ~space
    if len(b):
        keep[1:] |= ~space[:-1]  # the first space of a run
        starts = off[:-1][np.diff(off) > 0]
        keep[starts] = ~space[starts]
    total = np.concatenate([[0], np.cumsum(keep)])[off]
    size = np.diff(total)
    out_off = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(out_off[-1], 10, np.uint8)
    out[A.ragged(out_off[:-1], size)] = b[keep]
    return out, out_off


def folded(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts in lower case."""
    return A.buffers(pc.utf8_lower(col))


def normalise_text(text: str | None) -> bytes:
    out, _ = normalise(*folded(pa.array([text or ""])))
    return bytes(out[:-1]).strip()


def myers(pattern: bytes, text: bytes) -> int:
    """Least edit distance of ``pattern`` to any substring of ``text`` (Myers' bit-vectors, one step a text byte)."""
    m = len(pattern)
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = mask, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & mask  # a match may begin anywhere: no cost enters at the top
        mh = mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
        if score < best:
            best = score
            if not best:
                break
    return best


def budget(item: bytes, error_rate: float = ERROR_RATE, least: int = LEAST) -> int:
    """Edits that an item may take."""
    return int(error_rate * len(item)) if len(item) >= least else 0


def usable(item: bytes, least: int = LEAST) -> bool:
    return len(item) >= min(least, SHORTEST_BYTES) or item.count(b" ") + 1 >= SHORTEST_WORDS


def cut(item: bytes, error_rate: float = ERROR_RATE, least: int = LEAST) -> list[tuple[int, bytes]]:
    """(offset, piece): the budget plus one pieces of nearly equal length."""
    k = budget(item, error_rate, least)
    edges = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _whole(raw: bytes, a: int, z: int) -> bool:
    """Whether raw[a:z] neither begins nor ends inside a word of ASCII letters and digits."""
    inside = lambda x, y: raw[x] < 128 and raw[y] < 128 and A.WORD[raw[x]] and A.WORD[raw[y]]
    return not (a > 0 and inside(a - 1, a)) and not (z < len(raw) and inside(z - 1, z))


class Matcher:
    def __init__(self, items: list[tuple[int, bytes]], error_rate: float = ERROR_RATE, least: int = LEAST):
        self.items, self.least = items, least
        self.budgets = [budget(item, error_rate, least) for _, item in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for number, (_, item) in enumerate(items):
            for at, piece in cut(item, error_rate, least):
                where.setdefault(piece.decode("latin-1"), []).append((number, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def rows(self, col: pa.Array) -> list[tuple[int, int, int]]:
        """(row, item number, distance) of each item that a text holds within its budget."""
        out = []
        if not self.items:
            return out
        for i, j in A.row_blocks(col, 1 << 22):
            data, off = normalise(*folded(col.slice(i, j - i)))
            raw = data.tobytes()
            hits = [(end + 1 - size, places) for end, (size, places) in self.automaton.iter(raw.decode("latin-1"))]
            if not hits:
                continue
            row = np.searchsorted(off, [at for at, _ in hits], "right") - 1
            wanted: dict[tuple[int, int], list[int]] = {}
            for (at, places), r in zip(hits, row.tolist(), strict=True):
                for number, inside in places:
                    wanted.setdefault((r, number), []).append(at - inside)
            for (r, number), starts in wanted.items():
                item = self.items[number][1]
                k = self.budgets[number]
                begin, end = int(off[r]), int(off[r + 1]) - 1
                if len(item) < self.least:
                    if any(_whole(raw, at, at + len(item)) for at in starts):
                        out.append((i + r, number, 0))
                    continue
                best, seen = k + 1, -1
                starts = sorted(set(starts))
                a = 0
                while a < len(starts) and best:
                    z = a
                    while z + 1 < len(starts) and starts[z + 1] - starts[z] <= 2 * k + 1:
                        z += 1
                    lo, hi = max(begin, starts[a] - k), min(end, starts[z] + len(item) + k)
                    if hi > lo:
                        best = min(best, myers(item, raw[lo:hi]))
                    a = z + 1
                if best <= k:
                    out.append((i + r, number, best))
        return out


def parts(text: str, least: int = LEAST) -> list[bytes]:
    """The normalised lines of an item of ``least`` bytes or more; shorter ones in a row are joined until they have them."""
    out, held = [], b""
    for line in map(normalise_text, text.split("\n")):
        held = line if len(line) >= least else b" ".join(filter(None, (held, line)))
        if len(held) >= least:
            out.append(held)
            held = b""
    return out


def passes(benchmark: DataFrame, error_rate: float = ERROR_RATE, least: int = LEAST, pieces_per_pass: int = PIECES_PER_PASS, by_line: bool = False) -> list[list[tuple[int, bytes]]]:
    """The items, normalised, in groups that each fit one automaton. The benchmark goes through the driver, a chunk at a time."""
    groups: list[list[tuple[int, bytes]]] = [[]]
    count = 0
    for item_id, text in benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        whole = normalise_text(text)
        for item in dict.fromkeys([whole, *(parts(text, least) if by_line else [])]):
            if not usable(item, least):
                continue
            n = budget(item, error_rate, least) + 1
            if count + n > pieces_per_pass and groups[-1]:
                groups.append([])
                count = 0
            groups[-1].append((int(item_id), item))
            count += n
    return groups


def unmatched_items(benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """(item_id, text) of the items that are too short to be looked for."""
    short = F.udf(lambda t: not usable(normalise_text(t), least), "boolean")
    return benchmark.where("item_id is not null and text is not null").select("item_id", "text").where(short("text"))


_built: dict[int, Matcher] = {}


def _matcher(shared, error_rate: float, least: int) -> Matcher:
    if shared.id not in _built:
        _built.clear()
        _built[shared.id] = Matcher(shared.value, error_rate, least)
    return _built[shared.id]


class _Shared:
    def __init__(self, broadcast):
        self.id, self._b = broadcast._jbroadcast.id() if broadcast._jbroadcast else 0, broadcast

    def __getstate__(self):
        return {"id": self.id, "_b": self._b}

    @property
    def value(self):
        return self._b.value


def matches(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, least: int = LEAST, pieces_per_pass: int = PIECES_PER_PASS) -> DataFrame:
    """(doc_id, item_id, distance) of every document that holds an item within its budget."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for group in passes(benchmark, error_rate, least, pieces_per_pass):
        shared = _Shared(spark.sparkContext.broadcast(group))

        def run(batches, shared=shared):
            m = _matcher(shared, error_rate, least)
            for batch in batches:
                ids = batch.column("doc_id").to_numpy()
                got = m.rows(batch.column("text"))
                yield pa.RecordBatch.from_arrays([pa.array([int(ids[r]) for r, _, _ in got], pa.int64()), pa.array([m.items[k][0] for _, k, _ in got], pa.int64()), pa.array([d for _, _, d in got], pa.int32())], names=["doc_id", "item_id", "distance"])

        part = texts.mapInArrow(run, "doc_id long, item_id long, distance int")
        out = part if out is None else out.union(part)
    return out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, least: int = LEAST, pieces_per_pass: int = PIECES_PER_PASS, by_line: bool = False) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item (``by_line``: or a part of one); no shuffle, each pass filters in place."""
    spark = docs.sparkSession
    ship(spark)
    for group in passes(benchmark, error_rate, least, pieces_per_pass, by_line):
        if not group:
            continue
        shared = _Shared(spark.sparkContext.broadcast(group))

        def run(batches, shared=shared):
            m = _matcher(shared, error_rate, least)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[r for r, _, _ in m.rows(batch.column("text"))]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
