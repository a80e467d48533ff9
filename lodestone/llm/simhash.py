"""Near-duplicate documents: 256-bit SimHash searched with an LSH forest.

Fingerprint. A text's distinct words (runs of ASCII letters and digits, case folded, and of two-byte letters) and, in
scripts of longer characters, its pairs of neighbouring characters vote on 256 bits; a word's weight grows with its length, so
that function words, which every text of a language shares, hardly count. Votes are counted with one histogram per fingerprint byte.

Forest. Each trie orders the distinct fingerprints by 64 of their bits in its own random order. Two
fingerprints at distance h agree on a random prefix of d bits with probability (1 - h/256)**d.
In a trie every fingerprint climbs from its full key to shorter prefixes: always as far as the depth at which the tries
together find a pair at the largest distance with probability ``recall``, and further, up to CLIMB bits, as long as the wider node
holds at most ``leaf`` rows. So dense regions stay at that depth, sparse ones widen. The depth and the
number of tries follow the corpus (the latter about n**0.3), and no node is cut short: nodes of any size are
compared in full (a region of more than MOST fingerprints is read node by node, without the climb). Pairs in a node are verified with their exact 256-bit distance. Tests hold the recall against brute force.

Defined results. Documents with null, empty or word-less text are nobody's duplicate; rows with a null
doc_id take no part and stay. Repeated rows (equal doc_id and text) are one document. Of a group the
row with the least (doc_id, text hash) stays. A text of any length counts whole, in time that grows with it. An empty table gives
no groups. Extra columns are carried or ignored, never read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import arrays as A
from lodestone.llm.components import connected_components, merge_labels
from lodestone.session import fresh, persist_table, ship

BITS = 256
DISTANCE = 46
RECALL = 0.9
LEAF = 64
_VOTES = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1)
CLIMB = 8
MOST = 1 << 20
_WEIGHT = np.array([0, 0.05, 0.05, 0.1, 0.25, 0.5, 0.75] + [1.0] * 9, np.float32)
FP = ["f0", "f1", "f2", "f3"]


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, byte length) of the words, and of the pairs of neighbouring characters of three bytes or more (punctuation parts them)."""
    data, off = A.buffers(col)
    if not (data >= 0xE0).any():
        return A.words(col)
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    lead, ends = data[starts], np.append(starts[1:], len(data))
    wide = lead >= 0xE0
    second = data[np.minimum(starts + 1, len(data) - 1)]
    letter = wide & ~(((lead == 0xE2) & (second <= 0x81)) | ((lead == 0xE3) & (second == 0x80)))
    plain = data.copy()
    plain[np.repeat(wide, ends - starts)] = 32
    row, s, e = A.spans(plain, off, A.WORD)
    h, size = A.hashes(plain, s, e, A.FOLDED), e - s
    at = np.flatnonzero(letter)
    owner = np.searchsorted(off, starts[at], "right") - 1
    pair = np.append((at[1:] == at[:-1] + 1) & (owner[1:] == owner[:-1]), False) if len(at) else np.zeros(0, bool)
    alone = ~pair & ~np.concatenate([[False], pair[:-1]]) if len(at) else pair
    last = np.where(pair, ends[np.minimum(at + 1, len(ends) - 1)], ends[at])
    use = pair | alone
    return np.concatenate([row, owner[use]]), np.concatenate([h, A.hashes(data, starts[at][use], last[use])]), np.concatenate([size, (last - starts[at])[use]])


def fingerprint_array(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n x 32 fingerprint bytes, which rows have any word)."""
    n = len(col)
    row, h, size = features(col)
    once = np.argsort(A.mix(h ^ A.mix(row.astype(np.uint64), 9), 5))
    if len(once):
        new = np.ones(len(once), bool)
        new[1:] = (h[once][1:] != h[once][:-1]) | (row[once][1:] != row[once][:-1])
        once = np.sort(once[new])
        row, h, size = row[once], h[once], size[once]
    weight = _WEIGHT[np.minimum(size, 15)]
    some = np.bincount(row, minlength=n) > 0
    votes = np.zeros((n, BITS // 8, 8), np.float32)
    for salt in range(BITS // 64):
        b = A.mix(h, salt + 1).view(np.uint8).reshape(-1, 8)
        for k in range(8):
            count = np.bincount(row * 256 + b[:, k], weight, n * 256).astype(np.float32)
            votes[:, salt * 8 + k] = count.reshape(n, 256) @ _VOTES
    return np.packbits((votes > 0).reshape(n, BITS), axis=1), some


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, f0..f3) of every document that has a doc_id and a word."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for i, j in A.row_blocks(batch.column("text"), 1 << 20):
                part = batch.slice(i, j - i)
                fp, some = fingerprint_array(part.column("text"))
                fp = np.ascontiguousarray(fp[some]).view(">i8").astype(np.int64)
                keep = pa.array(some)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").filter(keep), part.column("text_key").filter(keep), *(pa.array(fp[:, k].copy()) for k in range(4))], names=["doc_id", "text_key", *FP])

    seen = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return seen.mapInArrow(run, "doc_id long, text_key long, f0 long, f1 long, f2 long, f3 long")


def forest_shape(n: int, distance: int = DISTANCE, recall: float = RECALL, leaf: int = LEAF) -> tuple[int, int]:
    """(deepest prefix, tries): prefixes that spread n rows over nodes of about ``leaf``, and as many tries as then give ``recall`` at ``distance``."""
    depth = min(60, max(0, round(math.log2(max(1, n / leaf)))))
    p = (1 - distance / BITS) ** depth
    return depth, max(1, math.ceil(math.log(1 - recall) / math.log1p(-p))) if p < 1 else 1


def _orders(tries: int) -> list[np.ndarray]:
    rng = np.random.default_rng(20240229)
    return [rng.permutation(BITS)[:64] for _ in range(tries)]


def leaf_stars(tree: np.ndarray, key: np.ndarray, fp: np.ndarray, coarse: int, depth: int, distance: int, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by (tree, key): (row, least row of its component) over pairs that share a node and are within ``distance``."""
    n = len(key)
    node = np.full(n, -1, np.int64)
    base = 0
    for d in range(coarse, depth + 1):
        prefix = key >> np.uint64(64 - d) if d else np.zeros(n, np.uint64)
        new = np.ones(n, bool)
        new[1:] = (prefix[1:] != prefix[:-1]) | (tree[1:] != tree[:-1])
        g = np.cumsum(new) - 1
        size = np.bincount(g)[g]
        done = (node < 0) & ((size <= leaf) | (d == depth))
        node[done] = g[done] + base
        base += n
    cut = np.flatnonzero(np.diff(node)) + 1
    start, end = np.concatenate([[0], cut]), np.concatenate([cut, [n]])
    size = end - start
    label = np.arange(n)
    last = np.repeat(end, size)
    small = np.repeat(size <= 8 * leaf, size)
    active = np.flatnonzero(small & (last - np.arange(n) > 1))
    o = 1
    while len(active):
        i, j = active, active + o
        d2 = np.bitwise_count(fp[i, 0] ^ fp[j, 0]).astype(np.int16) + np.bitwise_count(fp[i, 1] ^ fp[j, 1])
        near = d2 <= distance
        i, j = i[near], j[near]
        d2 = d2[near] + np.bitwise_count(fp[i, 2] ^ fp[j, 2]) + np.bitwise_count(fp[i, 3] ^ fp[j, 3])
        label = merge_labels(label, i[d2 <= distance], j[d2 <= distance])
        o += 1
        active = active[last[active] - active > o]
    for s, e in zip(start[size > 8 * leaf], end[size > 8 * leaf], strict=True):
        # rows joined to a component expand once each; rows not reached yet shrink, so a family of copies costs little
        rest = np.arange(s, e)
        while len(rest):
            front, rest = rest[:1], rest[1:]
            root = front[0]
            while len(front) and len(rest):
                hit = np.zeros(len(rest), bool)
                for f in front:
                    live = np.flatnonzero(~hit)
                    x = fp[rest[live]] ^ fp[f]
                    hit[live[np.bitwise_count(x).sum(1) <= distance]] = True
                front, rest = rest[hit], rest[~hit]
                label[front] = root
    return np.arange(n), label


def near_duplicate_edges(distinct: DataFrame, n: int, distance: int = DISTANCE, recall: float = RECALL, leaf: int = LEAF, most: int = MOST) -> DataFrame:
    """Edges (a, b) between rows of ``distinct`` (node, f0..f3) whose components are those of the pairs found."""
    depth, tries = forest_shape(n, distance, recall, leaf)
    coarse = max(0, depth - CLIMB)
    orders = _orders(tries)

    def explode(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                fp = np.stack([part.column(c).to_numpy() for c in FP], axis=1)
                bits = np.unpackbits(fp.astype(">i8").view(np.uint8).reshape(len(fp), 32), axis=1)
                for t, order in enumerate(orders):
                    key = np.ascontiguousarray(np.packbits(bits[:, order], axis=1)).view(">u8")[:, 0].astype(np.uint64)
                    head = (key >> np.uint64(64 - coarse) if coarse else np.zeros(len(key), np.uint64)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), t, np.int32)), pa.array(head), pa.array((key ^ np.uint64(1 << 63)).view(np.int64)), *part.columns], names=["tree", "head", "key", "node", *FP])

    def search(batches):
        def solve(rows):
            tree = rows.column("tree").to_numpy()
            key = rows.column("key").to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
            fp = np.stack([rows.column(c).to_numpy() for c in FP], axis=1).view(np.uint64)
            node = rows.column("node").to_numpy()
            i, root = leaf_stars(tree, key, fp, coarse, depth, distance, leaf)
            got = i != root
            a, b = node[i[got]], node[root[got]]
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held, count = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count >= min(1 << 16, most):
                rows = pa.Table.from_batches(held).combine_chunks()
                t, hd = rows.column("tree").to_numpy(), rows.column("head").to_numpy()
                same = (t == t[-1]) & (hd == hd[-1])
                cut = len(t) - int(np.argmin(same[::-1])) if not same.all() else 0
                if not cut and count >= most:  # a dense head: its rows part where the depth that recall needs does, so they climb no further
                    node = (rows.column("key").to_numpy().view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(64 - depth) if depth else np.zeros(len(t), np.uint64)
                    same = node == node[-1]
                    cut = len(t) - int(np.argmin(same[::-1])) if not same.all() else 0
                if cut:
                    yield solve(rows.slice(0, cut).combine_chunks())
                    held = rows.slice(cut).to_batches()
                    count -= cut
        if count:
            yield solve(pa.Table.from_batches(held).combine_chunks())

    keyed = distinct.select("node", *FP).mapInArrow(explode, "tree int, head long, key long, node long, f0 long, f1 long, f2 long, f3 long")
    return keyed.repartition("tree", "head").sortWithinPartitions("tree", "head", "key").mapInArrow(search, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, recall: float = RECALL, leaf: int = LEAF) -> DataFrame:
    """(group_id, doc_id, text_key, kept) for every document that has a near copy; group_id is the doc_id that stays."""
    fps = persist_table(fingerprints(docs).distinct(), "simhash")
    node_of = fps.groupBy(*FP).agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    nodes = persist_table(node_of, "simhash-nodes")
    n = nodes.count()
    # one doc_id may stand for two texts; a node number must not, so the fingerprint itself names the node
    named = nodes.withColumn("name", F.xxhash64(*FP))
    edges = near_duplicate_edges(named.select(F.col("name").alias("node"), *FP), n, distance, recall, leaf)
    found = connected_components(edges)
    member = named.where("copies > 1").select("name", F.col("name").alias("root")).join(found.select(F.col("node").alias("name")), "name", "left_anti").union(found.select(F.col("node").alias("name"), "root"))
    grouped = fps.withColumn("name", F.xxhash64(*FP)).join(member, "name")
    first = F.first(F.struct("doc_id", "text_key")).over(Window.partitionBy("root").orderBy("doc_id", "text_key"))
    return grouped.withColumn("first", first).select(F.col("first.doc_id").alias("group_id"), "doc_id", "text_key", ((F.col("doc_id") == F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents without those that ``near_duplicates`` doesn't keep, and without repeated rows; columns as given."""
    key, number, gone_id, gone_key = fresh(docs.columns, "_key", "_n", "_gone_id", "_gone_key")
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_key)).distinct()
    keyed = docs.withColumn(key, F.xxhash64("text"))
    stay = keyed.join(gone, (F.col("doc_id").cast("long") == F.col(gone_id)) & (F.col(key) == F.col(gone_key)), "left_anti")
    named = Window.partitionBy("doc_id", key).orderBy(F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in docs.columns if c != "text"]))
    return stay.withColumn(number, F.row_number().over(named)).where(F.col("doc_id").isNull() | (F.col(number) == 1)).drop(number, key)
