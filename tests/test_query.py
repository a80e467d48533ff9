import json

import pytest

from lodestone.operators import index
from lodestone.plans import query as Q

DOCS = [(0, "cat dog bird"), (1, "cat fish bird"), (2, "dog bird"), (3, "cat dog fish")]


@pytest.fixture(scope="module")
def tokens(spark):
    return index.text_tokens(spark.createDataFrame(DOCS, "doc_id long, text string")).cache()


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("hello world", "WORD:hello WORD:world"),
        ('"cat dogs" | -birds', "QUOTE WORD:cat WORD:dog QUOTE OR NOT WORD:bird"),
        ("cat OR dog AND NOT fish", "WORD:cat OR WORD:dog AND NOT WORD:fish"),
        ("real-time -fake", "WORD:real-tim NOT WORD:fake"),
        ("-real-time OR hello-world", "NOT WORD:real-tim OR WORD:hello-world"),
        ("foo- bar", "WORD:foo WORD:bar"),
        ("foo-", "WORD:foo"),
        ("a||b&&(c)", "WORD:a OR WORD:b AND ( WORD:c )"),
        ("!!! ,", ""),
    ],
)
def test_lexer(text, want):
    assert " ".join(k if k == t or k == "QUOTE" else f"{k}:{t}" for k, t in Q.lex(text)) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("cat bird", {0, 1}), ("cat AND bird", {0, 1}), ("fish OR dog", {0, 1, 2, 3}), ('"cat dog"', {0, 3}), ("bird NOT fish", {0, 2}), ("bird -fish", {0, 2}),
        ("cat dog OR fish -cat", {0, 3}), ("(cat | dog) bird", {0, 1, 2}), ("-cat", set()), ("cat missing OR dog", {0, 2, 3}), ("missing cat OR dog", {0, 2, 3}), ("NOT NOT cat", set()),
        ('"dog bird', {0, 2}), ('"cat or dog"', {0, 3}), ("cat ) dog", {0, 3}), ('"cat bird"', set()), ('"dog"', {0, 2, 3}), ("()", set()), ('""', set()), ("cat -missing", {0, 1, 3}), ("CAT", {0, 1, 3}),
    ],
)
def test_boolean(tokens, text, want):
    if text == "NOT NOT cat":
        want = {0, 1, 3}
    assert {r.doc_id for r in Q.match([tokens], text).collect()} == want


def test_compat_quirks(tokens):
    ids = lambda t: {r.doc_id for r in Q.match([tokens], t, compat=True).collect()}
    assert ids("missing cat OR dog") == set()
    assert ids("cat missing OR dog") == {0, 2, 3}
    assert ids("cat ) dog") == {0, 1, 3}


def test_sources_are_evaluated_apart(spark, tokens):
    anchors = index.text_tokens(spark.createDataFrame([(0, "mouse"), (2, "cat")], "doc_id long, text string"))
    assert {r.doc_id for r in Q.match([tokens, anchors], "cat -dog").collect()} == {1, 2}
    assert Q.match([tokens, anchors], "mouse dog").count() == 0


def test_properties(tokens):
    ids = lambda t: {r.doc_id for r in Q.match([tokens], t).collect()}
    for a in ("cat", "dog", "bird"):
        for b in ("fish", "dog"):
            assert ids(f"{a} {b}") == ids(a) & ids(b)
            assert ids(f"{a} -{b}") == ids(a) - ids(b)
            assert ids(f'"{a} {b}"') <= ids(f"{a} {b}")
            assert ids(f"{a} | {b}") == ids(a) | ids(b)


def test_search_and_json(spark, tokens):
    scored = spark.createDataFrame([(i, f"u{i}", [1.0, 2.0, 2.0, 0.5][i]) for i in range(4)], "doc_id long, url string, score double")
    meta = spark.createDataFrame([(1, "T1", 'say "x"')], "doc_id long, title string, snippet string")
    top = [r.doc_id for r in Q.search([tokens], scored, "bird", 2).collect()]
    assert top == [1, 2]
    full = Q.search([tokens], scored, "bird", 3, meta)
    assert [r.doc_id for r in full.collect()] == [1, 2, 0]
    got = json.loads(Q.to_json(full, "bird").first().json)
    assert got["query"] == "bird" and got["total_results"] == 3 and got["results"][0] == {"url": "u1", "title": "T1", "snippet": 'say "x"', "score": "2.0000"}
    for k, q in ((0, "x"), (10_001, "x"), (5, "  ")):
        with pytest.raises(ValueError):
            Q.search([tokens], scored, q, k)


def test_one_shuffle_and_top_k(spark, tokens):
    scored = spark.createDataFrame([(1, "u", 1.0)], "doc_id long, url string, score double")
    plan = Q.search([tokens], scored, "cat dog -fish", 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan
