"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary gives the pieces; each language gives every piece a probability. A text is cut at
ASCII white space into units, each with a leading space; a unit's probability in a language is the sum over all its
segmentations into pieces of the product of their probabilities (forward algorithm), a text's the product
over its units. Single bytes are pieces, so nothing scores zero. Units of up to UNIT bytes are summed in scaled numbers, longer
ones, of any length, in logarithms over a window of the longest piece. Piece probabilities are fitted by expectation-maximisation
(forward-backward) on the units of up to UNIT bytes of at most ``docs_per_language`` labelled texts a language, those with
the least hash of doc_id.

Each distinct unit is scored once per worker and remembered; the whole text counts, however long: time and memory grow
with its length.

Defined results. Null, empty and all-white texts get no language (null) and a margin of 0. A tie goes to the
language that sorts first. Rows with null or repeated doc_id are scored like any other; extra columns
are carried. A null label is no training text. An empty table gives no rows; with no training text a
language has uniform probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import arrays as A
from lodestone.llm.sampling import below
from lodestone.llm.vocab import TOKENIZERS, pieces
from lodestone.session import ship

UNIT = 48
CHUNK = 8000
LANGUAGES = ("de", "en", "es", "fr")
DOCS_PER_LANGUAGE = 400
_R = np.uint64(0xC2B2AE3D27D4EB4F)


def _hash(parts: list[bytes]) -> np.ndarray:
    out = np.zeros(len(parts), np.uint64)
    for i, p in enumerate(parts):
        h = 0
        for b in p:
            h = (h * int(_R) + int(A.RAW[b])) & 0xFFFFFFFFFFFFFFFF
        out[i] = h
    return out


@dataclass
class Vocabulary:
    """By length, the sorted hashes of all beginnings of pieces, and the piece that each is (-1: none)."""

    tables: dict[int, tuple[np.ndarray, np.ndarray]]
    size: int

    @staticmethod
    def of(parts: list[bytes]) -> Vocabulary:
        number = {p: i for i, p in enumerate(parts)}
        tables = {}
        for k in range(1, max(map(len, number), default=0) + 1):
            heads = sorted({p[:k] for p in number if len(p) >= k})
            h = _hash(heads)
            order = np.argsort(h)
            tables[k] = (h[order], np.array([number.get(p, -1) for p in heads])[order])
        return Vocabulary(tables, len(parts))

    def matches(self, flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All pieces in all units, ordered by (end, length): (unit, end in unit, length, piece)."""
        unit = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
        stop = off[1:][unit]
        at = np.arange(len(flat))
        h = np.zeros(len(flat), np.uint64)
        out = []
        for k, (keys, ids) in self.tables.items():
            live = stop[at] - at >= k
            at, h = at[live], h[live]
            if not len(at):
                break
            h = h * _R + A.RAW[flat[at + k - 1]]
            slot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            head = keys[slot] == h
            at, h, piece = at[head], h[head], ids[slot[head]]
            hit = piece >= 0
            s = at[hit]
            u = unit[s]
            out.append((u, (s - off[u] + k).astype(np.int32), np.full(len(s), k, np.int16), piece[hit].astype(np.int32)))
        u, e, k, p = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int32),) * 4
        order = np.argsort(e, kind="stable")  # lengths ascend already
        return u[order], e[order], k[order], p[order]


def _groups(end: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero((end[1:] != end[:-1]) | (size[1:] != size[:-1])) + 1
    edges = [0, *cut.tolist(), len(end)]
    return list(zip(edges[:-1], edges[1:], strict=True)) if len(end) else []


def forward(m: tuple, n: int, prob: np.ndarray) -> np.ndarray:
    """alpha[end, unit, language], scaled by 256**end to stay in range. ``prob``: pieces x languages."""
    u, e, k, p = m
    alpha = np.zeros((UNIT + 1, n, prob.shape[1]))
    alpha[0] = 1
    weight = prob[p]
    weight *= (256.0 ** np.arange(UNIT + 1))[k][:, None]
    for a, b in _groups(e, k):
        at, end = u[a:b], int(e[a])
        alpha[end][at] += alpha[end - int(k[a])][at] * weight[a:b]  # no unit twice: the length is the group's
    return alpha


def unit_scores(flat: np.ndarray, off: np.ndarray, vocabulary: Vocabulary, prob: np.ndarray) -> np.ndarray:
    """log P(unit | language) of each unit."""
    sizes = np.diff(off)
    out = np.zeros((len(sizes), prob.shape[1]))
    short = np.flatnonzero(sizes <= UNIT)
    for i in range(0, len(short), CHUNK):
        some = short[i : i + CHUNK]
        size = sizes[some]
        alpha = forward(vocabulary.matches(*_picked(flat, off, some)), len(some), prob)
        out[some] = np.log(alpha[size, np.arange(len(some))]) - size[:, None] * np.log(256.0)
    long = np.flatnonzero(sizes > UNIT)
    long = long[np.argsort(sizes[long], kind="stable")]
    while len(long):  # units of like lengths together, about 2**16 bytes at a time
        count = max(1, int(np.searchsorted(np.cumsum(sizes[long]), 1 << 16)))
        out[long[:count]] = log_forward(*_picked(flat, off, long[:count]), vocabulary, prob)
        long = long[count:]
    return out


def _picked(flat: np.ndarray, off: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = off[some + 1] - off[some]
    return flat[A.ragged(off[some], size)], np.concatenate([[0], np.cumsum(size)])


def log_forward(flat: np.ndarray, off: np.ndarray, vocabulary: Vocabulary, prob: np.ndarray) -> np.ndarray:
    """The forward algorithm in logarithms, keeping only the sums that a piece can still reach."""
    n, window = len(off) - 1, max(vocabulary.tables, default=0) + 1
    u, e, k, p = vocabulary.matches(flat, off)
    size = np.diff(off)
    alpha = np.full((window, n, prob.shape[1]), -np.inf)
    alpha[0] = 0
    out = np.zeros((n, prob.shape[1]))
    weight = np.log(prob)
    last = 0
    ends = np.argsort(size, kind="stable")
    ended = 0
    for a, b in _groups(e, k):
        end = int(e[a])
        if end != last:
            alpha[end % window] = -np.inf
            last = end
        now = alpha[end % window]
        at = u[a:b]
        now[at] = np.logaddexp(now[at], alpha[(end - int(k[a])) % window][at] + weight[p[a:b]])
        if b == len(e) or e[b] != end:
            while ended < n and size[ends[ended]] == end:
                out[ends[ended]] = now[ends[ended]]
                ended += 1
    return out


def expect(flat: np.ndarray, off: np.ndarray, count: np.ndarray, vocabulary: Vocabulary, prob: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in one language's units (forward-backward over all segmentations)."""
    out = np.zeros(vocabulary.size)
    for i in range(0, len(off) - 1, CHUNK):
        o = off[i : i + CHUNK + 1]
        n = len(o) - 1
        m = vocabulary.matches(flat[o[0] : o[-1]], o - o[0])
        u, e, k, p = m
        alpha = forward(m, n, prob[:, None])[:, :, 0].T
        size = np.diff(o)
        beta = np.zeros((n, UNIT + 1))
        beta[np.arange(n), size] = 1
        w = prob[p] * (256.0 ** np.arange(UNIT + 1))[k]
        for a, b in reversed(_groups(e, k)):
            beta[u[a:b], int(e[a]) - int(k[a])] += beta[u[a:b], int(e[a])] * w[a:b]
        whole = alpha[np.arange(n), size]
        out += np.bincount(p, count[i : i + n][u] * alpha[u, e - k] * w * beta[u, e] / whole[u], vocabulary.size)
    return out


def units(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the units' bytes without the leading space, and the bytes."""
    data, off = A.buffers(col)
    return *A.spans(data, off, A.GRAPH), data


def _spell(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat bytes of the units, each with its leading space."""
    off = np.concatenate([[0], np.cumsum(e - s + 1)])
    flat = np.full(off[-1], 32, np.uint8)
    flat[A.ragged(off[:-1] + 1, e - s)] = data[A.ragged(s, e - s)]
    return flat, off


def _keyed(col: pa.Array) -> tuple:
    row, s, e, data = units(col)
    return row, s, e, data, A.mix(A.hashes(data, s, e), 21) if len(s) else np.zeros(0, np.uint64)


def fit(texts: list[pa.Array], parts: list[bytes], rounds: int = 4, smoothing: float = 0.05) -> np.ndarray:
    """pieces x languages probabilities; texts: one column of training texts a language."""
    vocabulary = Vocabulary.of(parts)
    prob = np.full((vocabulary.size, len(texts)), 1 / vocabulary.size)
    for k, col in enumerate(texts):
        row, s, e, data, h = _keyed(col)
        short = e - s < UNIT
        s, e, h = s[short], e[short], h[short]
        if not len(s):
            continue
        _, at, inverse = A.unique_first(h)
        flat, off = _spell(data, s[at], e[at])
        count = np.bincount(inverse).astype(float)
        for _ in range(rounds):
            got = expect(flat, off, count, vocabulary, prob[:, k]) + smoothing
            prob[:, k] = got / got.sum()
    return prob


_memo: dict[int, tuple[A.Memo, list[np.ndarray]]] = {}


def log_likelihoods(col: pa.Array, vocabulary: Vocabulary, prob: np.ndarray, memo_key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(rows x languages log P(text | language), whether a row has any unit)."""
    n = len(col)
    total = np.zeros((n, prob.shape[1]))
    some = np.zeros(n, bool)
    if memo_key not in _memo:
        _memo.clear()
        _memo[memo_key] = (A.Memo(), [np.zeros((0, prob.shape[1]))])
    memo, values = _memo[memo_key]
    for i, j in A.row_blocks(col, 1 << 22):
        row, s, e, data, h = _keyed(col.slice(i, j - i))
        if not len(s):
            continue
        keys, at, inverse = A.unique_first(h)
        if memo.n > memo.most:
            memo.clear()
            values[:] = [np.zeros((0, prob.shape[1]))]
        slot, known = memo.find(keys)
        if not known.all():
            new = at[~known]
            flat, off = _spell(data, s[new], e[new])
            values[0] = np.concatenate([values[0], unit_scores(flat, off, vocabulary, prob)])
            memo.add(keys[~known])
            slot, _ = memo.find(keys)
        each = values[0][slot][inverse]
        for k in range(prob.shape[1]):
            total[i:j, k] = np.bincount(row, each[:, k], j - i)
        some[i:j] = np.bincount(row, minlength=j - i) > 0
    return total, some


def train(docs: DataFrame, path: str, languages: tuple[str, ...] = LANGUAGES, docs_per_language: int = DOCS_PER_LANGUAGE) -> tuple[list[bytes], np.ndarray]:
    """Fit on a bounded, documented sample of labelled documents, found in one scan of the texts (after one of the labels).

    A language that the pre-selection by hash leaves short, as equal or null ids can, is read again without it."""
    named = docs.where(F.col("lang").isin(*languages))
    count = {r.lang: r.n for r in named.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    h = F.xxhash64("doc_id")
    found: dict[str, list[str]] = {}
    for wary in (True, False):
        want = [x for x in languages if len(found.get(x, [])) < min(docs_per_language, count.get(x, 0))]
        if not want:
            break
        chosen = F.lit(False)
        for x in want:
            chosen = chosen | ((F.col("lang") == x) & (below(h, docs_per_language, count[x]) if wary else F.lit(True)))
        place = F.row_number().over(Window.partitionBy("lang").orderBy(h, "doc_id", F.xxhash64("text")))
        sample = named.where(chosen & F.col("text").isNotNull()).select("lang", "text", place.alias("place")).where(F.col("place") <= docs_per_language)
        got = sample.orderBy("lang", "place").toArrow()
        found |= {x: [] for x in want}
        for x, text in zip(got.column("lang").to_pylist(), got.column("text").to_pylist(), strict=True):
            found[x].append(text)
    parts = pieces(path)
    return parts, fit([pa.array(found.get(x, []), pa.string()) for x in languages], parts)


def identify(docs: DataFrame, parts: list[bytes], prob: np.ndarray, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """``docs`` with predicted (language) and margin (nats per byte over the runner-up); columns of these names are replaced."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("predicted", "margin")
    vocabulary = Vocabulary.of(parts)
    key = int(np.bitwise_xor.reduce(A.mix(prob.view(np.uint64).ravel(), 1))) if prob.size else 0
    shared = spark.sparkContext.broadcast((vocabulary, prob))  # as large as the fixed vocabulary, whatever the corpus
    fields = T.StructType([*docs.schema.fields]).add("predicted", "string").add("margin", "double")

    def run(batches):
        v, p = shared.value
        for batch in batches:
            col = batch.column("text")
            total, some = log_likelihoods(col, v, p, key)
            best = total.argmax(1) if len(total) else np.zeros(0, np.int64)
            ranked = np.sort(total, 1)
            gap = (ranked[:, -1] - ranked[:, -2]) if total.shape[1] > 1 else np.zeros(len(total))
            size = np.maximum(np.diff(A.buffers(col)[1]), 1)
            name = pa.array([languages[b] if ok else None for b, ok in zip(best, some, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, name, pa.array(np.where(some, gap / size, 0.0))], names=fields.names)

    return docs.mapInArrow(run, fields)


MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
