import numpy as np
import pytest
import zlib

from lodestone.llm import rans, tokens


def skewed(n, size, seed=0):
    rng = np.random.default_rng(seed)
    return np.minimum(rng.zipf(1.3, n) - 1, size - 1).astype(np.uint16)


def test_blocks_round_trip():
    ids = skewed(200_001, 5000)
    freq = rans.quantise(np.bincount(ids, minlength=5000))
    assert freq.sum() == 1 << rans.PRECISION and freq.min() >= 1
    f, start, _ = rans.tables(freq)
    edges = np.array([0, 1, 1, 33, 20_000, 65_536, 65_536 * 3, 200_001])
    coded = rans.encode_blocks(ids, edges, f, start)
    for (payload, points, sums), a, b in zip(coded, edges[:-1], edges[1:]):
        assert (rans.decode(payload, points, sums, b - a, freq) == ids[a:b]).all()
    share = np.bincount(ids) / len(ids)
    bits = -(share[share > 0] * np.log2(share[share > 0])).sum()
    assert sum(len(c[0]) for c in coded) * 8 < 1.02 * bits * len(ids) + 7 * 2048


def test_segments_decode_alone_and_damage_is_seen():
    ids = skewed(60_000, 300)
    freq = rans.quantise(np.bincount(ids, minlength=300))
    f, start, _ = rans.tables(freq)
    payload, points, sums = rans.encode_blocks(ids, np.array([0, 60_000]), f, start)[0]
    step = rans.CHECKPOINT * rans.LANES
    assert len(sums) == -(-60_000 // step)
    assert (rans.decode(payload, points, sums, 60_000, freq, 1, 3) == ids[step : 3 * step]).all()
    bad = bytearray(payload)
    bad[len(bad) // 2] ^= 1
    with pytest.raises(ValueError):
        rans.decode(bytes(bad), points, sums, 60_000, freq)


def give_back(rows, freq):
    """{doc_id: ids} and how many rows each id had, from the encoded rows."""
    out = []
    open_part = {}
    for r in rows:
        assert zlib.crc32(r.payload) == r.crc
        ids = rans.decode(bytes(r.payload), bytes(r.checkpoints), list(r.checksums), r.n_tokens, freq).tolist()
        at = 0
        for d, n in zip(r.doc_ids, r.lengths):
            if len(r.doc_ids) == 1 and r.n_tokens == rans.BLOCK or r.part:
                open_part.setdefault(d, {})[r.part] = ids
            else:
                out.append((d, ids[at : at + n]))
            at += n
    return out + [(d, [x for k in sorted(p) for x in p[k]]) for d, p in open_part.items()]


def test_documents_come_back(edge_docs, no_docs):
    rows = rans.encode(edge_docs).collect()
    head = [r for r in rows if r.kind == "table"]
    assert len(head) == 1 and zlib.crc32(head[0].payload) == head[0].crc
    freq = np.frombuffer(bytes(head[0].payload), "<u4")
    enc = tokens.encoder(tokens.RANKS).encoding
    got = give_back([r for r in rows if r.kind == "block"], freq)
    want = [(r.doc_id, enc.encode_ordinary(r.text or "")) for r in edge_docs.select("doc_id", "text").collect()]
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(got, key=order) == sorted(want, key=order)
    assert max(len(x) for _, x in want) > rans.BLOCK
    assert [r.kind for r in rans.encode(no_docs).collect()] == ["table"]


def test_documents_come_back_through_a_dataframe(spark, edge_docs, no_docs, monkeypatch):
    from lodestone.llm import tokens

    enc = tokens.encoder(tokens.RANKS).encoding
    got = {}
    for r in rans.decode_documents(rans.encode(edge_docs)).collect():
        got.setdefault((r.doc_id is None, r.doc_id or 0), []).append((r.part, r.tokens))
    want = {}
    for r in edge_docs.select("doc_id", "text").collect():
        want.setdefault((r.doc_id is None, r.doc_id or 0), []).append(enc.encode_ordinary(r.text or ""))
    for key, parts in got.items():
        rows = [t for _, t in parts] if all(p == 0 for p, _ in parts) and len(parts) == len(want[key]) else [[x for _, t in sorted(parts) for x in t]]
        assert sorted(rows) == sorted(want[key])
    assert got.keys() == want.keys()
    assert rans.decode_documents(rans.encode(no_docs)).count() == 0
    monkeypatch.setattr(rans, "byte_ranks", lambda _: {b"a": 1 << 16})
    with pytest.raises(ValueError):
        rans.encode(no_docs)
