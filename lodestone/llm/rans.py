"""Token ids as binary: static range asymmetric numeral system (rANS) with shared frequency tables.

Pass 1 tokenises every document into a table in the shared folder and counts all ids; the counts, quantised to
2**PRECISION with at least 1 for each id of the vocabulary, are the one table that every block shares. Pass 2
encodes blocks of at most BLOCK tokens. A block interleaves LANES coders (token i belongs to lane i mod LANES),
each with a 64-bit state in [2**31, 2**63) that moves 32-bit words, in one word stream whose order is the
decoder's. Every CHECKPOINT steps it records the stream position and all states, so that a decoder can start
there; a CRC-32 of the ids between checkpoints, and one of the payload, tell damage. Blocks are
independent: any can be decoded, in parallel, with nothing but the table row.

Rows. kind "table": payload holds the quantised frequencies (uint32). kind "block": doc_ids and lengths of the
documents in it in order, the payload (word stream), checkpoints (LANES uint64 states and a stream position each) and
checksums. A document longer than a block is split over blocks of its own; ``part`` numbers them.

Defined results. Null, empty and token-less texts take part with length 0, so a decoder gives back every row;
null doc_ids stay null, repeated rows are repeated. Texts of any length are split as above. Ids are stored in 16 bits: a vocabulary
of more than 65,536 is refused. An empty table gives the table row alone (all
frequencies alike). Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import arrays as A
from lodestone.llm.tokens import RANKS, encoder
from lodestone.llm.vocab import byte_ranks
from lodestone.session import persist_table, ship

PRECISION = 20
LANES = 32
BLOCK = 1 << 16
CHECKPOINT = 512
_LOW = np.uint64(1 << 31)
SCHEMA = "kind string, doc_ids array<long>, lengths array<int>, part int, n_tokens int, payload binary, checkpoints binary, checksums array<long>, crc long"


def quantise(counts: np.ndarray, precision: int = PRECISION) -> np.ndarray:
    """Frequencies of at least 1 that sum to 2**precision, as near to the counts' shares as that allows; deterministic."""
    counts = np.asarray(counts, np.float64)
    room = (1 << precision) - len(counts)
    share = counts / counts.sum() * room if counts.sum() else np.full(len(counts), room / len(counts))
    extra = np.floor(share).astype(np.int64)
    short = room - int(extra.sum())
    extra[np.argsort(-(share - extra), kind="stable")[:short]] += 1
    return (extra + 1).astype(np.uint32)


def tables(freq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frequencies, starts, symbol of each slot)."""
    start = np.concatenate([[0], np.cumsum(freq.astype(np.uint64))[:-1]]).astype(np.uint64)
    return freq.astype(np.uint64), start, np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def encode_blocks(ids: np.ndarray, edges: np.ndarray, freq: np.ndarray, start: np.ndarray, precision: int = PRECISION) -> list[tuple[bytes, bytes, list[int]]]:
    """(payload, checkpoints, checksums) of each block ids[edges[k]:edges[k+1]]; all lanes of all blocks move together."""
    n_blocks = len(edges) - 1
    size = np.diff(edges)
    steps = int(-(-size.max(initial=0) // LANES))
    lanes = n_blocks * LANES
    if not steps:
        return [(b"", b"", []) for _ in range(n_blocks)]
    grid = np.zeros((n_blocks, steps * LANES), np.uint16)
    valid = np.arange(steps * LANES) < size[:, None]
    grid[valid] = ids
    sym = np.ascontiguousarray(grid.reshape(n_blocks, steps, LANES).swapaxes(0, 1).reshape(steps, lanes))
    live = np.ascontiguousarray(valid.reshape(n_blocks, steps, LANES).swapaxes(0, 1).reshape(steps, lanes))
    words, moved = np.zeros((steps, lanes), np.uint32), np.zeros((steps, lanes), bool)
    x = np.full(lanes, _LOW)
    p = np.uint64(precision)
    high = np.uint64(63 - precision)
    marks: dict[int, np.ndarray] = {}
    for t in range(steps - 1, -1, -1):
        f, c = freq[sym[t]], start[sym[t]]
        on = live[t]
        out = on & (x >= f << high)
        moved[t] = out
        words[t] = x.astype(np.uint32)
        x1 = np.where(out, x >> np.uint64(32), x)
        q = x1 // f
        x = np.where(on, (q << p) + (x1 - q * f) + c, x)
        if t % CHECKPOINT == 0:
            marks[t] = x.copy()
    result = []
    for b in range(n_blocks):
        lane = slice(b * LANES, (b + 1) * LANES)
        m = moved[:, lane]
        stream = words[:, lane][m]
        position = np.concatenate([[0], np.cumsum(m.sum(1))])
        own = [t for t in range(0, -(-int(size[b]) // LANES), CHECKPOINT)]
        points = b"".join(marks[t][lane].astype("<u8").tobytes() + np.uint64(position[t]).tobytes() for t in own)
        block = ids[edges[b] : edges[b + 1]].astype("<u2")
        sums = [zlib.crc32(block[t * LANES : (t + CHECKPOINT) * LANES].tobytes()) for t in own]
        result.append((stream.astype("<u4").tobytes(), points, sums))
    return result


def decode(payload: bytes, checkpoints: bytes, checksums: list[int], n_tokens: int, freq: np.ndarray, first: int = 0, last: int | None = None, precision: int = PRECISION) -> np.ndarray:
    """The ids between checkpoints ``first`` and ``last`` (all by default), every segment decoded side by side; ValueError on damage."""
    f, start, symbol = tables(freq)
    stream = np.frombuffer(payload, "<u4").astype(np.uint64)
    width = LANES * 8 + 8
    last = len(checkpoints) // width if last is None else last
    points = [checkpoints[k * width : (k + 1) * width] for k in range(first, last)]
    if not points:
        return np.zeros(0, np.uint16)
    x = np.stack([np.frombuffer(q[:-8], "<u8") for q in points]).astype(np.uint64)
    at = np.array([int.from_bytes(q[-8:], "little") for q in points])
    mask, p = np.uint64((1 << precision) - 1), np.uint64(precision)
    segment = np.arange(first, last)[:, None] * (CHECKPOINT * LANES)
    out = np.zeros((len(points), CHECKPOINT, LANES), np.uint16)
    for t in range(CHECKPOINT):
        on = segment + t * LANES + np.arange(LANES) < n_tokens
        if not on.any():
            break
        slot = x & mask
        s = symbol[slot]
        out[:, t] = s
        nx = f[s] * (x >> p) + slot - start[s]
        need = on & (nx < _LOW)
        where = np.minimum(at[:, None] + np.cumsum(need, 1) - need, max(0, len(stream) - 1))
        nx = np.where(need, nx << np.uint64(32) | (stream[where] if len(stream) else np.uint64(0)), nx)
        x = np.where(on, nx, x)
        at = at + need.sum(1)
    parts = []
    for k, row in enumerate(out):
        n = min(CHECKPOINT * LANES, n_tokens - (first + k) * CHECKPOINT * LANES)
        parts.append(row.ravel()[:n])
        if zlib.crc32(parts[-1].astype("<u2").tobytes()) != checksums[first + k]:
            raise ValueError(f"checksum of segment {first + k} doesn't match")
    return np.concatenate(parts)


def tokenise(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, ids): the ids as little-endian 16-bit binary."""
    spark = docs.sparkSession
    ship(spark)
    ranks = spark.sparkContext.broadcast(byte_ranks(path))  # the fixed vocabulary

    def run(batches):
        enc = encoder(path, ranks.value)
        for batch in batches:
            for i, j in A.row_blocks(batch.column("text"), 1 << 22):
                part = batch.slice(i, j - i)
                ids, off = enc.encode(part.column("text"))
                data = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((off * 2).astype(np.int32).tobytes()), pa.py_buffer(ids.astype("<u2").tobytes())])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), data], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def count_ids(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in all documents: one row of counts a task, added up by Spark."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            data, _ = A.buffers(batch.column("ids"))
            total += np.bincount(data.view("<u2"), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    counts = np.zeros(size, np.int64)
    got = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts[got.column("id").to_numpy()] = got.column("n").to_numpy()
    return counts


def blocks_of(length: np.ndarray, block: int = BLOCK) -> list[tuple[int, int, int, int, int]]:
    """(first row, rows, part, first token, tokens): whole documents together, a longer one by itself."""
    out = []
    at = np.concatenate([[0], np.cumsum(length)])
    i, n = 0, len(length)
    while i < n:
        if length[i] > block:
            out += [(i, 1, part, int(at[i]) + part * block, int(min(block, length[i] - part * block))) for part in range(-(-int(length[i]) // block))]
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(at, at[i] + block, "right")) - 1)
        out.append((i, j - i, 0, int(at[i]), int(at[j] - at[i])))
        i = j
    return out


def vocabulary_size(path: str) -> int:
    size = max(byte_ranks(path).values()) + 1
    if size > 1 << 16:
        raise ValueError("ids are stored in 16 bits")
    return size


def encode(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """The table row and the block rows of every document."""
    spark = docs.sparkSession
    vocabulary_size(path)
    tokens = persist_table(tokenise(docs, path), "token-ids")
    size = vocabulary_size(path)
    freq = quantise(count_ids(tokens, size))
    head = spark.createDataFrame([("table", [], [], 0, 0, bytearray(freq.astype("<u4").tobytes()), bytearray(), [], zlib.crc32(freq.astype("<u4").tobytes()))], SCHEMA)
    shared = spark.sparkContext.broadcast(freq)  # as large as the fixed vocabulary

    def run(batches):
        f, start, _ = tables(shared.value)
        for batch in batches:
            for i, j in A.row_blocks(batch.column("ids"), 1 << 23):
                part = batch.slice(i, j - i)
                data, off = A.buffers(part.column("ids"))
                ids, length = data.view("<u2"), np.diff(off) // 2
                plan = blocks_of(length)
                owners, doc_ids = part.column("doc_id"), []
                rows: dict[str, list] = {c: [] for c in ("lengths", "part", "n_tokens", "payload", "checkpoints", "checksums", "crc")}
                for a in range(0, len(plan), 64):
                    some = plan[a : a + 64]
                    edges = np.array([p[3] for p in some] + [some[-1][3] + some[-1][4]])
                    coded = encode_blocks(ids[edges[0] : edges[-1]], edges - edges[0], f, start)
                    for (row, n, number, _, count), (payload, points, sums) in zip(some, coded, strict=True):
                        doc_ids.append(owners.slice(row, n).to_pylist())
                        rows["lengths"].append([count] if count != length[row : row + n].sum() else length[row : row + n].tolist())
                        for c, v in (("part", number), ("n_tokens", count), ("payload", payload), ("checkpoints", points), ("checksums", sums), ("crc", zlib.crc32(payload))):
                            rows[c].append(v)
                kinds = {"lengths": pa.list_(pa.int32()), "part": pa.int32(), "n_tokens": pa.int32(), "payload": pa.binary(), "checkpoints": pa.binary(), "checksums": pa.list_(pa.int64()), "crc": pa.int64()}
                yield pa.RecordBatch.from_arrays([pa.array(["block"] * len(plan)), pa.array(doc_ids, pa.list_(pa.int64())), *(pa.array(rows[c], k) for c, k in kinds.items())], names=["kind", "doc_ids", *kinds])

    return head.union(tokens.mapInArrow(run, SCHEMA))


def decode_documents(encoded: DataFrame) -> DataFrame:
    """(doc_id, part, tokens) of every document, from the rows that ``encode`` gave; every block is decoded by itself.

    A document within a block has one row (part 0), a longer one a row for each block of its own. Damage raises ValueError."""
    spark = encoded.sparkSession
    ship(spark)
    head = encoded.where("kind = 'table'").select("payload", "crc").first()  # one row, as large as the vocabulary
    if zlib.crc32(head.payload) != head.crc:
        raise ValueError("checksum of the table doesn't match")
    shared = spark.sparkContext.broadcast(np.frombuffer(head.payload, "<u4"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                if zlib.crc32(row["payload"]) != row["crc"]:
                    raise ValueError("checksum of a payload doesn't match")
                ids = decode(row["payload"], row["checkpoints"], row["checksums"], row["n_tokens"], shared.value)
                edges = np.concatenate([[0], np.cumsum(row["lengths"])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * len(row["doc_ids"]), pa.int32()), pa.ListArray.from_arrays(pa.array(edges), pa.array(ids.astype(np.int32)))], names=["doc_id", "part", "tokens"])

    return encoded.where("kind = 'block'").mapInArrow(run, "doc_id long, part int, tokens array<int>")
