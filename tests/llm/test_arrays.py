import numpy as np
import pyarrow as pa

from lodestone.llm import arrays as A
from lodestone.llm.components import connected_components, merge_labels


def test_words_hash_like_their_bytes():
    texts = ["Hello, wORLD-42 é!", None, "", "x" * 100 + " y", "world 42"]
    row, h, size = A.words(pa.array(texts))
    want = [(0, b"hello"), (0, b"world"), (0, b"42"), (0, "é".encode()), (3, b"x" * 100), (3, b"y"), (4, b"world"), (4, b"42")]
    assert [(int(r), int(x), int(n)) for r, x, n in zip(row, h, size)] == [(r, A.poly_hash(w, True), len(w)) for r, w in want]


def test_slices_and_large_strings_agree():
    texts = ["abc def", "ghi", None, "jkl mno"]
    for col in (pa.array(texts).slice(1), pa.array(texts, pa.large_string()).slice(1), pa.chunked_array([texts[1:2], texts[2:]])):
        row, h, _ = A.words(col)
        assert row.tolist() == [0, 2, 2]
        assert h.tolist() == [A.poly_hash(w, True) for w in (b"ghi", b"jkl", b"mno")]


def test_merge_labels():
    label = merge_labels(np.arange(7), np.array([5, 3, 1]), np.array([3, 1, 0]))
    assert label.tolist() == [0, 0, 2, 0, 4, 0, 6]


def test_connected_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7), (None, 3)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.root) for r in got} == {(x, root(x)) for x in list(up)}
    assert len(got) == len(up)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
