import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import langid
from lodestone.llm.vocab import pieces
from lodestone.session import table

PARTS = sorted({bytes([b]) for b in range(256)} | {b" ab", b"ab", b"abc", b"bc", b" a", b"cab", b"b ", "é".encode()})


def brute(unit, prob):
    """Sum over all segmentations of the products of probabilities."""
    if not unit:
        return 1.0
    return sum(prob[i] * brute(unit[len(p) :], prob) for i, p in enumerate(PARTS) if unit.startswith(p))


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(0)
    prob = rng.random((len(PARTS), 2))
    prob /= prob.sum(0)
    v = langid.Vocabulary.of(PARTS)
    texts = ["abcab é", "b", "cabcabcab", None, "", "  ab\n"]
    total, some = langid.log_likelihoods(pa.array(texts), v, prob, 12345)
    assert some.tolist() == [True, True, True, False, False, True]
    for k, t in enumerate(texts):
        for lang in range(2):
            want = sum(np.log(brute(b" " + u, prob[:, lang])) for u in (t or "").encode().split())
            assert total[k, lang] == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_expectation_counts_bytes():
    prob = np.full(len(PARTS), 1 / len(PARTS))
    v = langid.Vocabulary.of(PARTS)
    flat = np.frombuffer(b" abcab", np.uint8)
    got = langid.expect(flat, np.array([0, 6]), np.array([2.0]), v, prob)
    assert got @ np.array([len(p) for p in PARTS]) == pytest.approx(12)


def by_position(unit, prob):
    """The same sum for long units: over the end of each piece, in logarithms."""
    a = [0.0] + [-np.inf] * len(unit)
    for end in range(1, len(unit) + 1):
        for i, p in enumerate(PARTS):
            if unit[:end].endswith(p):
                a[end] = np.logaddexp(a[end], a[end - len(p)] + np.log(prob[i]))
    return a[-1]


def test_units_of_any_length_are_summed_whole():
    rng = np.random.default_rng(1)
    prob = rng.random((len(PARTS), 2)) ** 4
    prob /= prob.sum(0)
    v = langid.Vocabulary.of(PARTS)
    words = ["".join(rng.choice(list("abcé"), n)) for n in (2, langid.UNIT - 1, langid.UNIT, langid.UNIT + 1, 49, 50, 90, 700, 3000, 90)]
    total, _ = langid.log_likelihoods(pa.array(words), v, prob, 777)
    for k, w in enumerate(words):
        for lang in range(2):
            assert total[k, lang] == pytest.approx(by_position(b" " + w.encode(), prob[:, lang]), rel=1e-9)


def test_pieces_longer_than_a_short_unit_count():
    parts = sorted({bytes([b]) for b in range(256)} | {b" " + b"=" * 80})
    prob = np.full(len(parts), 1 / len(parts))
    total, _ = langid.log_likelihoods(pa.array(["=" * 80]), langid.Vocabulary.of(parts), prob[:, None], 778)
    assert total[0, 0] == pytest.approx(np.log(1 / len(parts)), abs=1e-6)


def test_a_very_long_unit_ends():
    v = langid.Vocabulary.of(PARTS)
    prob = np.full((len(PARTS), 1), 1 / len(PARTS))
    total, _ = langid.log_likelihoods(pa.array(["abc" * 30_000]), v, prob, 779)
    assert np.isfinite(total).all()


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "lang", "text")
    parts, prob = langid.train(docs.where("doc_id % 2 = 0"), langid.MODEL, docs_per_language=100)
    got = langid.identify(docs.where("doc_id % 2 = 1 and length(text) > 40"), parts, prob)
    assert got.agg(F.avg((F.col("predicted") == F.col("lang")).cast("int"))).first()[0] > 0.95


def test_sample_has_the_least_hashes(spark, monkeypatch):
    rows = [(k, "en", f"text {k}") for k in range(500)] + [(None, "de", f"null id {k}") for k in range(100)] + [(7, "fr", None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    seen = []
    monkeypatch.setattr(langid, "fit", lambda texts, parts: seen.extend(t.to_pylist() for t in texts))
    langid.train(docs, langid.MODEL, docs_per_language=10)
    want = docs.where("lang = 'en'").orderBy(F.xxhash64("doc_id")).limit(10).collect()
    assert seen[1] == [r.text for r in want]
    assert len(seen[0]) == 10 and seen[2] == seen[3] == []


def test_edges(edge_docs, no_docs):
    parts = pieces(langid.MODEL)
    prob = langid.fit([pa.array(["der die das"]), pa.array(["the and of"]), pa.array([], pa.string()), pa.array([None], pa.string())], parts)
    got = langid.identify(edge_docs, parts, prob)
    assert got.count() == edge_docs.count()
    assert got.where("(text is null or trim(translate(text, '\n', '')) = '') <> (predicted is null)").count() == 0
    assert got.where("predicted is null and margin <> 0").count() == 0
    assert langid.identify(no_docs, parts, prob).count() == 0
    # a tie goes to the language that sorts first
    same = np.full((len(parts), 4), 1 / len(parts))
    assert {r.predicted for r in langid.identify(edge_docs.where("doc_id = 7"), parts, same).collect()} == {"de"}
