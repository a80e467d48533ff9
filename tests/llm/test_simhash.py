from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest_texts import family_texts

from lodestone.llm import arrays as A
from lodestone.llm import simhash


def slow_fingerprint(text):
    """By the definition: distinct words vote with their weights on 256 bits."""
    found = {bytes(w) for w in split(text)}
    votes = np.zeros(256)
    for w in found:
        h = np.array([A.poly_hash(w, True)], np.uint64)
        weight = simhash._WEIGHT[min(len(w), 15)]
        for salt in range(4):
            bits = np.unpackbits(A.mix(h, salt + 1).view(np.uint8))
            votes[salt * 64 : salt * 64 + 64] += weight * (bits * 2.0 - 1)
    return np.packbits(votes > 0)


def split(text):
    w = bytearray()
    for b in text.encode() + b" ":
        if A.WORD[b]:
            w.append(b + 32 if 65 <= b <= 90 else b)
        elif w:
            yield w
            w = bytearray()


def test_fingerprints_follow_the_definition():
    texts = ["Alpha beta gamma delta-epsilon, the of", "a of", None, "", "Grüße aus München", "alpha ALPHA alpha words words"]
    fp, some = simhash.fingerprint_array(pa.array(texts))
    assert some.tolist() == [True, True, False, False, True, True]
    for k in (0, 1, 4, 5):
        assert (fp[k] == slow_fingerprint(texts[k])).all()


def brute_groups(texts):
    fp, some = simhash.fingerprint_array(pa.array(texts))
    d = np.bitwise_count(fp[:, None, :] ^ fp[None, :, :]).sum(2)
    label = np.arange(len(texts))
    i, j = np.nonzero((d <= simhash.DISTANCE) & some[:, None] & some[None, :])
    for a, b in zip(i, j):
        la, lb = label[a], label[b]
        label[label == max(la, lb)] = min(la, lb)
    groups = defaultdict(set)
    for k, x in enumerate(label):
        groups[x].add(k)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


@pytest.mark.parametrize("leaf", [2, 64])
def test_groups_match_brute_force(spark, leaf):
    texts = family_texts(60, 4, seed=3)
    want = brute_groups(texts)
    got = defaultdict(set)
    for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), leaf=leaf).collect():
        got[r.group_id].add(r.doc_id)
    pairs = lambda gs: {(a, b) for g in gs for a in g for b in g if a < b}
    w, g = pairs(want), pairs(got.values())
    assert len(w) > 50 and g <= w
    assert len(g) >= 0.9 * len(w)


def test_one_of_each_group_stays(spark):
    texts = family_texts(20, 3, seed=5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stay = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    for g in brute_groups(texts):
        assert stay & g == {min(g)}
    assert set(range(len(texts))) - set().union(*brute_groups(texts)) <= stay


def test_edges(spark, edge_docs, no_docs):
    got = simhash.drop_near_duplicates(edge_docs)
    assert got.schema == edge_docs.schema
    ids = sorted((r.doc_id if r.doc_id is not None else -1, r.text is None) for r in got.select("doc_id", "text").collect())
    # repeated row 1 and its copy 2 are one; rows without id stay, each of them
    assert [i for i, _ in ids] == [-9, -1, -1, -1, 1, 3, 4, 5, 6, 7, 8, 9223372036854775807]
    assert simhash.drop_near_duplicates(no_docs).count() == 0
    assert simhash.near_duplicates(no_docs).count() == 0


def test_scripts_without_spaces_have_pairs_of_characters():
    rng = np.random.default_rng(5)
    signs = [chr(c) for c in range(0x4E00, 0x4E00 + 800)]
    a = "".join(rng.choice(signs, 200))
    b = a[:80] + "\u4e00" + a[81:]
    other = "".join(rng.choice(signs, 200))
    row, _, size = simhash.features(pa.array(["ab \u4e2d\u6587\u3002\u5b57 x\u2019s", None, "\u4e2d"]))
    assert sorted(zip(row.tolist(), size.tolist())) == [(0, 1), (0, 1), (0, 2), (0, 3), (0, 6), (2, 3)]
    fp, some = simhash.fingerprint_array(pa.array([a, b, other]))
    assert some.all()
    far = lambda i, j: int(np.bitwise_count(fp[i] ^ fp[j]).sum())
    assert far(0, 1) <= simhash.DISTANCE < far(0, 2)


def test_short_words_tell_tables_apart():
    rng = np.random.default_rng(6)
    tables = [" ".join(["measure"] + [str(x) for x in rng.integers(0, 999, 120)]) for _ in range(2)]
    fp, _ = simhash.fingerprint_array(pa.array(tables))
    assert int(np.bitwise_count(fp[0] ^ fp[1]).sum()) > simhash.DISTANCE


def test_nodes_climb_while_sparse_and_not_where_dense():
    key = np.sort(np.concatenate([np.arange(300, dtype=np.uint64) << np.uint64(40), np.array([1 << 62, (1 << 62) + (1 << 59)], np.uint64)]))
    fp = np.zeros((len(key), 4), np.uint64)
    fp[:, 0] = np.arange(len(key))
    fp[:, 1] = np.where(key >= 1 << 62, np.uint64(0), np.uint64(2**64 - 1))
    _, root = simhash.leaf_stars(np.zeros(len(key), np.int64), key, fp, 2, 8, 16, 64)
    assert root[-1] == root[-2]  # apart at depth 8, together after the climb
    assert len(set(root[:300].tolist())) == 1


def test_dense_regions_are_read_node_by_node(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, (40, 4))
    fp = np.repeat(base, 30, axis=0)
    fp[:, 3] ^= 1 << rng.integers(0, 62, len(fp))
    fp = np.unique(fp, axis=0)
    rows = spark.createDataFrame([(i, *map(int, r)) for i, r in enumerate(fp)], "node long, f0 long, f1 long, f2 long, f3 long")
    pairs = {}
    for most in (7, 1 << 20):
        label = np.arange(len(fp))
        for a, b in simhash.near_duplicate_edges(rows, len(fp), leaf=4, most=most).collect():
            label[label == max(label[a], label[b])] = min(label[a], label[b])
        pairs[most] = len(set(label.tolist()))
    assert pairs[1 << 20] == 40 and pairs[7] <= 42
