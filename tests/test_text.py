import compare
import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone import registry
from lodestone.functions import misc, text
from lodestone.functions.stem import stem, with_stems
from lodestone.operators import index

STEMS = """vietnamization=vietnam predication=predic analogousli=analog vileli=vile differentli=differ radically=radic conformability=conform
digitizer=digit hesitancy=hesit valency=valenc rational=ration conditional=condit relational=relat sky=sky happy=happi filing=file failing=fail
fizzed=fizz hissing=hiss falling=fall tanned=tan hopping=hop sized=size troubled=troubl conflated=conflat meetings=meet messing=mess milling=mill
mating=mate matting=mat disabled=disabl agreed=agre feed=feed cats=cat caress=caress ties=ti ponies=poni caresses=caress universities=univers
real-time=real-tim at=at a=a ée=ée"""


@pytest.mark.parametrize("pair", STEMS.split())
def test_stems(pair):
    word, want = pair.split("=")
    assert stem(word) == want


def test_stems_of_a_column(spark):
    df = spark.createDataFrame([("cats",), ("cats",), (None,), ("",)], "form string")
    assert sorted(((r.form, r.stem) for r in with_stems(df).collect()), key=str) == sorted([("cats", "cat"), ("cats", "cat"), (None, None), ("", "")], key=str)


def test_words_and_locations(spark):
    df = spark.createDataFrame([(1, ["HELLO", "world!", "!@#", "real-time", "universities"], ["The", "Title"])], "page_id long, words array<string>, title_words array<string>")
    got = {(r.loc, r.field, r.term) for r in index.page_tokens(df).collect()}
    body = {(2, "hello"), (3, "world"), (5, "real-tim"), (5, "real"), (5, "time"), (6, "univers")}
    assert got == {(n, "body", t) for n, t in body} | {(0, "title", "the"), (1, "title", "titl")}


@pytest.mark.parametrize(("word", "forms"), [("Élan", ["lan"]), ("中文", []), ("a-b-c", ["a-b-c", "a", "b-c"]), ("--x--", ["x"]), ("ok&amp;", ["ok&amp"]), ("", []), (None, None)])
def test_word_forms(spark, word, forms):
    got = spark.createDataFrame([(word,)], "w string").select(text.word_forms(F.col("w")).alias("f")).first().f
    assert (got or []) == (forms or [])


@given(st.lists(st.integers(-9, 9), min_size=1, max_size=12))
@settings(max_examples=5, deadline=None)
def test_best_run(spark, values):
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "k string, i int, v long")
    r = misc.best_run(df, ["k"], ["i"], "v").first()
    runs = [(-sum(values[a:b]), b - a, a) for a in range(len(values)) for b in range(a + 1, len(values) + 1)]
    assert (-r.best_sum, r["last"] - r["first"] + 1, r["first"] - 1) == min(runs)


def test_best_run_of_an_array(spark):
    df = spark.createDataFrame([([1.0, -2.0, 3.0, 4.0, -1.0],), ([-2.0, -1.0],), ([],)], "v array<double>")
    assert [r[0] for r in df.select(misc.best_run_array(F.col("v"))).collect()] == [7.0, -1.0, None]


@pytest.mark.parametrize(("e", "v"), [("1+2*3", 7), ("-(2+3)*4", -20), ("7/-2", -3), ("-7/2", -3), ("2 x 3", 2), ("((4))", 4), ("--3", 3)])
def test_expressions(e, v):
    assert misc.evaluate(e) == v


def test_parity_hash():
    assert misc.fold_hash("") == 0 and misc.fold_hash("ab") == 97 * 37 + 98 and misc.fold_hash("é") == ((0xC3 - 256) * 37 + 0xA9 - 256) % 2**64


def test_bloom_size():
    assert text.bloom_size(150e6, 1e-4) == (2_875_517_514, 13) or text.bloom_size(150e6, 1e-4)[0] == 2_875_517_514


@pytest.mark.parametrize(
    ("lang", "body", "title", "want"),
    [("en", ["x"], [], True), ("en-GB", [], [], True), ("EN", [], [], True), ("de", ["the"] * 60, [], False), ("", ["the", "zz"] * 30, [], True), ("", ["zz"] * 60, [], False), ("", ["Привет"] * 20, [], False), ("", ["abc"] * 20, [], True), ("", ["Привет"], [], True)],
)
def test_english(spark, lang, body, title, want):
    df = spark.createDataFrame([(lang, body, title)], "l string, b array<string>, t array<string>")
    assert df.select(text.is_english(F.col("l"), F.col("b"), F.col("t")).alias("e")).first().e is want


def test_sanitise(spark):
    df = spark.createDataFrame([("a\tb\"c'd\\e\x7f\r\n",)], "t string")
    r = df.select(text.sanitise(F.col("t")).alias("s"), text.single_line(F.col("t")).alias("l")).first()
    assert r.s == "a b c d e   " and r.l == "a\tb\"c'd\\e\x7f  "


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    t = index.text_tokens(none)
    assert index.posting_stats(t).count() == index.postings(t).count() == index.posting_lists(t).count() == 0
    assert index.corpus_stats(t, none, text.words(F.col("text"))).first().num_documents == 0


def test_utf16_round_trip_of_odd_texts(spark, tmp_path):
    texts = ["", None, "﻿", "﻿a", "\x00", "\U0001f600a", "￾", "a" * 70000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert compare.difference(registry.QUERIES["utf16_round_trip"](spark, str(tmp_path)), registry.ORACLES["utf16_round_trip"], c) == ""
