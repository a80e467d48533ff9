import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import decontaminate as D


def slow_distance(pattern, text):
    """Least edit distance of the pattern to any substring, by dynamic programming."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


@given(st.binary(min_size=1, max_size=70).map(lambda b: bytes(97 + x % 3 for x in b)), st.binary(max_size=90).map(lambda b: bytes(97 + x % 3 for x in b)))
@settings(max_examples=150, deadline=None)
def test_myers_is_the_edit_distance(pattern, text):
    assert D.myers(pattern, text) == slow_distance(pattern, text)


def test_normalise():
    assert D.normalise_text("  A, b--C!\n\té ") == "a b c é".encode()
    assert D.normalise_text(None) == b""


def test_case_of_all_alphabets_is_folded():
    item = "Éléonore a reçu des élèves près de l'école, ΩΣ и Ёлка"
    m = D.Matcher([(1, D.normalise_text(item))])
    assert m.rows(pa.array(["Vor " + item.upper() + "!", None, item])) == [(0, 0, 0), (2, 0, 0)]


def test_pieces_cover_the_item():
    item = bytes(range(65, 65 + 26)) * 4
    cuts = D.cut(item)
    assert b"".join(p for _, p in cuts) == item and len(cuts) == int(0.05 * len(item)) + 1


def planted(seed):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(400)]
    items = [(k, " ".join(rng.choice(words, 14))) for k in range(12)]
    texts = []
    for k in range(120):
        body = list(rng.choice(words, 60))
        if k % 2:
            text = list(items[k % 12][1])
            for _ in range(rng.integers(0, 8)):
                at = rng.integers(0, len(text))
                text[at] = ["", "x", text[at] + "y"][rng.integers(0, 3)]
            body.insert(rng.integers(0, 60), "".join(text).upper() if k % 3 else "".join(text))
        texts.append(" ".join(body))
    return items, texts


def test_matches_equal_brute_force(spark):
    items, texts = planted(4)
    want = {}
    for d, t in enumerate(texts):
        for i, item in items:
            p = D.normalise_text(item)
            x = slow_distance(p, D.normalise_text(t))
            if x <= int(0.05 * len(p)):
                want[d, i] = x
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(want) > 30
    for pieces in (10, 200_000):
        got = {(r.doc_id, r.item_id): r.distance for r in D.matches(docs, bench, pieces_per_pass=pieces).collect()}
        assert got == want
        left = {r.doc_id for r in D.drop_contaminated(docs, bench, pieces_per_pass=pieces).collect()}
        assert left == set(range(len(texts))) - {d for d, _ in want}


def test_edges(spark, edge_docs, no_docs):
    item = "boats and harbours in the north, a text without an identity about"
    bench = spark.createDataFrame([(1, "A text without an identity about boats and harbours in the north."), (2, None), (None, item), (3, "short"), (4, "rivers and hills at length. It has a second line of its own"), (5, "rivers and hills at length. It has a second line of its own")], "item_id long, text string")
    got = sorted(map(tuple, D.matches(edge_docs, bench).collect()))
    assert got == [(1, 4, 0), (1, 5, 0), (2, 4, 0), (2, 5, 0)]
    left = D.drop_contaminated(edge_docs, bench)
    assert left.schema == edge_docs.schema
    assert left.count() == edge_docs.count() - 5  # both rows without id go as well
    empty = spark.createDataFrame([], "item_id long, text string")
    assert D.matches(edge_docs, empty).count() == 0 and D.matches(no_docs, bench).count() == 0
    assert D.drop_contaminated(edge_docs, empty).count() == edge_docs.count()


def test_long_text_is_searched_whole():
    item = D.normalise_text("the very last sentence of an extremely long document about nothing")
    m = D.Matcher([(1, item)])
    col = pa.array(["filler words " * 400_000 + "The very last sentense of an extremely long document about nothing"])
    assert m.rows(col) == [(0, 0, 1)]


def test_repeated_hits_inside_one_text():
    item = b"abcdefghij " * 5
    m = D.Matcher([(1, item.strip())])
    assert m.rows(pa.array(["abcdefghij " * 300]))[0][2] == 0
    assert pytest.approx(0) == D.myers(item.strip(), b"abcdefghij " * 300)


def test_short_items_are_found_exactly_as_whole_words(spark):
    items = [(1, "What is the capital of France? Paris"), (2, "is it so or not"), (3, "yes"), (4, "中文的句子在这里"), (5, "ok")]
    texts = ["Q: what is the capital of france -- PARIS!", "what is the capital of france parish", "he said: Is it so, or not?", "this it so or not", "yes ok", "前面有中文的句子在这里后面", "what is the capitol of france paris"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, D.matches(docs, bench).collect())) == [(0, 1, 0), (2, 2, 0), (5, 4, 0)]
    assert sorted(r.item_id for r in D.unmatched_items(bench).collect()) == [3, 5]
    assert [r.doc_id for r in D.drop_contaminated(docs, bench).orderBy("doc_id").collect()] == [1, 3, 4, 6]
