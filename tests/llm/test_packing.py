import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from lodestone.llm import arrays as A
from lodestone.llm import packing, tokens
from lodestone.llm.vocab import PATTERN, byte_ranks

TEXTS = ["Hello  world\n\n  it's 42 x ", "", None, " ", "a", "tabs\t\tand\r\nlines \n", "Grüße, 中文 text!", "x" * 500, "end with gap   \n", " wide  space"]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_ranks(tokens.RANKS), special_tokens={})


def test_tokens_are_the_tokenizers(reference):
    rng = np.random.default_rng(0)
    signs = list("ab C1.'s\n\t  \r-é中") + ["'ll", "  ", " "]
    texts = TEXTS + ["".join(rng.choice(signs, rng.integers(0, 60))) for _ in range(300)]
    ids, off = tokens.encoder(tokens.RANKS).encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[off[k] : off[k + 1]].tolist() == reference.encode_ordinary(t or "")


def test_quotes_and_dashes_take_the_fast_way(reference):
    """Only white space outside ASCII goes to the tokenizer whole, wherever it stands."""
    spaces = [chr(c) for c in range(0x80, 0x3100) if chr(c).isspace()]
    rng = np.random.default_rng(1)
    signs = ["\u2019", "\u2014", "\u2022", "\u201c", "\u4e2d", "\u3042", "\u1e9e", "\u00e9", " ", "a", "b ", "\n"]
    texts = ["".join(rng.choice(signs, 30)) for _ in range(200)] + [f"a{s}{s} b {s}" for s in spaces] + ["".join(rng.choice(signs + spaces, 30)) for _ in range(200)]
    data, off = A.buffers(pa.array(texts))
    found = set((np.searchsorted(off, tokens.wide_spaces(data), "right") - 1).tolist())
    assert found == {k for k, t in enumerate(texts) if set(t) & set(spaces)}
    ids, at = tokens.encoder(tokens.RANKS).encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == reference.encode_ordinary(t)


def test_decompose():
    count, length = packing.decompose(np.array([0, 1, 13, 8192 * 2 + 5]), 8192)
    assert count.tolist() == [0, 1, 3, 4]
    assert length.tolist() == [1, 8, 4, 1, 8192, 8192, 4, 1]


def test_pieces_give_the_documents_back(spark, reference):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = packing.pack(docs, longest=16).collect()
    for k, t in enumerate(TEXTS):
        own = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.piece)
        assert [x for r in own for x in r.tokens] == reference.encode_ordinary(t or "")
        assert [r.start for r in own] == [sum(q.bucket for q in own[:i]) for i in range(len(own))]
        assert all(len(r.tokens) == r.bucket and r.bucket & (r.bucket - 1) == 0 and r.bucket <= 16 for r in own)
        assert [r.bucket for r in own] == sorted((r.bucket for r in own), reverse=True)


def test_edges(edge_docs, no_docs, reference):
    rows = packing.pack(edge_docs).collect()
    total = sum(len(reference.encode_ordinary(r.text)) for r in edge_docs.select("text").collect() if r.text)
    assert sum(r.bucket for r in rows) == total
    assert any(r.doc_id is None for r in rows)
    assert packing.pack(no_docs).count() == 0
    with pytest.raises(ValueError):
        packing.pack(no_docs, longest=3)


def test_buckets_have_folders(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    packing.write_buckets(packing.pack(docs, longest=16), f"{tmp_path}/b")
    back = spark.read.parquet(f"{tmp_path}/b")
    assert back.where("size(tokens) <> bucket").count() == 0 and back.count() == packing.pack(docs, longest=16).count()
    assert {p.name for p in (tmp_path / "b").glob("bucket=*")} <= {f"bucket={1 << k}" for k in range(5)}
