"""Persisted indexes, checkpoints, membership, codecs and the eight-page corpus."""

import json
import time

import pytest
from pyspark.sql import functions as F

from lodestone.functions import codec, misc, text
from lodestone.operators import crawl, html, index, membership
from lodestone.plans import queries, query
from lodestone.sources import io

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["bool_mixed", "phrase3", "search_documents", "search_ranked"])
def test_registered_searches_push_their_terms_into_the_scan(spark, name):
    df = queries.QUERIES[name](spark, SF)
    plan = plan_of(df)
    assert "In(term" in plan and "PushedFilters: [In(term" in plan.replace("IsNotNull(term), ", "").replace("IsNotNull(schema_version), EqualTo(schema_version,2), ", "") or "In(term" in plan.split("PushedFilters")[1]
    assert "Generate" not in plan  # nothing is tokenised at query time


def test_an_index_is_built_once_and_opened_again(spark, tmp_path):
    tokens = index.text_tokens(spark.createDataFrame([(0, "cat dog bird"), (1, "cat fish bird"), (2, "dog bird"), (3, "cat dog fish"), (4, None)], "doc_id long, text string"))
    query.build(tokens, f"{tmp_path}/index")
    opened = query.open_index(spark, f"{tmp_path}/index")
    for q, want in (("cat bird", {0, 1}), ('"cat dog"', {0, 3}), ('"dog cat"', set()), ("bird -fish", {0, 2}), ('-"cat dog" bird', {1, 2}), ("cat OR missing", {0, 1, 3})):
        assert {r.doc_id for r in query.match([opened], q, stemmed=False).collect()} == want == {r.doc_id for r in query.match([tokens], q, stemmed=False).collect()}, q
    spark.range(1).write.parquet(f"{tmp_path}/other")
    with pytest.raises(ValueError):
        query.open_index(spark, f"{tmp_path}/other")


PAGES = [
    ("https://www.example.org/cats/care-guide", 0, "Complete Cat Care Guide", "Trusted cat care guide with feeding tips cat health advice and play ideas", [("https://www.vet.example.org/cat-health", "cat health guide"), ("https://www.example.org/cats/treat-ideas", "adopt a cat")]),
    ("https://www.example.com/pets/cats/adoption", 1, "Cat Adoption Tips", "Adopt a friendly cat today with adoption tips checklists and cat supplies", [("https://www.example.com/pets/checklist", "adoption checklist")]),
    ("https://www.example.net/blog/family/pets/cat-dog-routine?ref=home", 2, "Cat and Dog Routine", "My cat and my dog are friends with daily cat routines and walk plans", []),
    ("https://www.example.com/birds", 1, "Bird Watching Notes", "No cats here just birds and fish", []),
    ("http://spam-example.com/store/cat/2024/09/deals?session=abc&ref=ad&src=push", 5, "Cheap Cat Deals", "Cheap cat deals cat sale cat offer", []),
    ("https://www.example.edu/home/pets/cat-games", 1, "Cat Games at Home", "I love my cat and my dog with simple cat games at home", [("https://www.example.com/birds", "feathered friends")]),
    ("https://cats.example.com/community/stories/cat-park-story", 3, "Cat Park Story", "My cat hates dogs after a cat park visit", []),
    ("https://www.example.org/cats/treat-ideas", 0, "Cat Treat Ideas", "My cat loves ice cream but the cat vet says choose safer treats", [("https://www.example.com/birds", "winged company")]),
]


@pytest.fixture(scope="module")
def small_web(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("web")
    page = lambda title, body, links: f"<html lang='en'><head><title>{title}</title></head><body>{body} " + " ".join(f'<a href="{u}">{a}</a>' for u, a in links) + "</body></html>"
    spark.createDataFrame([(k, u, page(t, b, ls)) for k, (u, _, t, b, ls) in enumerate(PAGES)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return queries._page_index(spark, str(folder))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("cat", {0, 1, 2, 3, 4, 5, 6, 7}),  # "cats" stems to "cat"
        ("cat -dog", {0, 1, 3, 4, 7}),
        ('"my dog"', {2, 5}),
        ('"cat and my dog"', set()),  # operators drop out of quotes
        ("games | routine", {2, 5}),
        ("feathered", {3, 5}),  # 3 by the text of a link to it
        ("feathered winged", {3}),  # two pages' links to one target
        ('"adopt a cat"', {0, 7}),
        ("adopted", {0, 1, 7}),
        ("zebra", set()),
    ],
)
def test_eight_pages(small_web, text, want):
    sources, scored, _ = small_web
    assert {r.doc_id for r in query.search(sources, scored, text, 20).collect()} == want


def test_eight_pages_ranked_and_answered(spark, small_web):
    sources, scored, meta = small_web
    ranked = [r.url for r in query.search(sources, scored, "cat", 20).collect()]
    assert ranked[-1].startswith("http://spam-example.com") and len(ranked) == 8
    full = json.loads(query.request(sources, scored, meta, {"q": "treats", "k": "99999"}).first().json)
    assert full["total_results"] == 1 and full["results"][0]["title"].startswith("Cat Treat Ideas")
    assert json.loads(query.request(sources, scored, meta, {"q": " "}).first().json) == {"error": "missing query"}
    assert [query.clamp_k(x) for x in ("7", "0", "99999", "-3", "+5", " 5", "", None, "٣")] == [7, 1, 10000, 20, 20, 20, 20, 20, 20]


def test_anchor_snapshots_are_united(spark):
    one = spark.createDataFrame([("a", ["x", "y"], 2), ("b", ["z"], 1)], "url string, words array<string>, referring_count long")
    two = spark.createDataFrame([("a", ["w"], 5)], one.schema)
    got = {r.url: (r.words, r.referring_count) for r in index.merge_anchors([one, two]).collect()}
    assert got == {"a": (["x", "y", "w"], 7), "b": (["z"], 1)}


def test_restart_takes_the_newest_complete_checkpoint(spark, tmp_path):
    items = crawl.frontier(spark.createDataFrame([(f"https://h{k}.com/p{k}", k % 3, False) for k in range(20)], "url string, seed_distance int, failed boolean"))
    path = f"file://{tmp_path}/check"
    io.write_checkpoint(items.limit(5), items.select("url").limit(2), path, 1)
    io.write_checkpoint(items, items.select("url"), path, 2)
    io.write_checkpoint(items, items.select("url"), path, 3)
    for p in (tmp_path / "check/000000003/seen").glob("part-*"):
        p.unlink()  # damaged
    items.select(io.frontier_line().alias("value")).write.text(f"{path}/000000004/frontier")  # cut short
    back, seen, header = io.read_checkpoint(spark, path)
    assert header["number"] == 2 and back.count() == 20
    assert {r.url for r in seen.collect()} == {r.url for r in items.collect()}
    with pytest.raises(ValueError):
        io.write_checkpoint(items, items, f"{path}-new", 1)
        for p in (tmp_path / "check-new/000000001/frontier").glob("part-*"):
            p.unlink()
        io.read_checkpoint(spark, f"{path}-new")


def test_membership_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("k"))
    f = membership.build_filter(keys.union(spark.createDataFrame([(None,)], "k string")), "k", 20_000, 0.01)
    assert f.count() <= 7
    asked = spark.range(40_000).select(F.concat(F.lit("k"), "id").alias("k")).union(spark.createDataFrame([(None,)], "k string"))
    got = membership.maybe_members(asked, "k", f, 20_000, 0.01)
    known = F.substring("k", 2, 9).cast("long") < 20_000
    assert got.where(known & ~F.col("member")).count() == 0
    assert got.where(~known & F.col("member")).count() < 0.02 * 20_000
    assert got.where("k is null and member").count() == 0


def test_variable_byte_lists(spark):
    lists = [[], [0], [5], [127, 128, 16_383 + 128], [0, 1, 2**31, 2**34], list(range(0, 900_000, 301)), None]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k int, locs array<long>").withColumn("coded", codec.encode_deltas(F.col("locs")))
    rows = df.withColumn("back", codec.decode_deltas()("coded")).orderBy("k").collect()
    assert [r.back for r in rows] == lists
    assert rows[3].coded == bytes([0x7F, 0x01, 0xFF, 0x7F]) and rows[4].coded[:2] == b"\x00\x01"
    assert codec.decode(b"\x81") == [] and codec.decode(b"\x05\x81") == [5]


@pytest.mark.parametrize(
    ("data", "want"),
    [
        (b"\xef\xbb\xbfhi", "hi"), ("hi é".encode("utf-16"), "hi é"), (b"\xfe\xff\x00h\x00i", "hi"), ("plain text".encode("utf-16-le"), "plain text"), ("plain text".encode("utf-16-be"), "plain text"),
        (b"a\xffb", "a�b"), (b"\xe4\xb8", "�"), (b"\xff\xfeh\x00\x00\xd8", "h�"), (b"", ""), (None, None),
    ],
)
def test_transcoding(data, want):
    assert text.transcode(data) == want


def test_lenient_query_decoding(spark):
    df = spark.createDataFrame([("a+b%20c",), ("100%",), ("%zz%41",), ("%C3%A9",), (None,), ("",)], "q string")
    assert [r[0] for r in df.select(text.decode_query(F.col("q"))).collect()] == ["a b c", "100%", "%zzA", "é", None, ""]


def test_unclosed_quotes_take_time_in_proportion():
    page = ("<a href='x\" " * 60_000 + "<p>" * 60_000).encode()
    began = time.time()
    html.Page(page)
    html.Page(page.replace(b"<p>", b""))
    assert time.time() - began < 10
    assert html._tag_close(b'a href="x>y" b="z">', 0) == 18 and html._tag_close(b'a="x"">', 0) == 6 and html._tag_close(b'a="x', 0) == -1


def test_seeds_are_turned_away(spark):
    df = spark.createDataFrame([("https://a.com/",), ("https://cdn.a.com/",), ("https://a.com/dns",), ("https://a.io/",), ("https://b.co.uk/x",)], "url string")
    assert [r.url for r in crawl.clean_seeds(df).collect()] == ["https://a.com/", "https://b.co.uk/x"]


def test_promotion_of_everything_is_a_range_sort(spark):
    df = spark.range(1000).select(F.concat(F.lit("u"), "id").alias("url"), F.pmod(F.xxhash64("id"), F.lit(97)).alias("score"))
    want = [r.url for r in df.orderBy(F.desc("score"), "url").limit(250).collect()]
    got = crawl.promote(df, 0.25)
    assert sorted(r.url for r in got.collect()) == sorted(want)


def test_accepted_times_by_definition(spark):
    rows = [(k % 3, (k * 7919) % 5000) for k in range(400)] + [(1, None)]
    got = sorted((r.user, r.at) for r in crawl.accept_or_delay(spark.createDataFrame(rows, "user int, at long"), "user", "at", 100).collect())
    want = []
    for u in range(3):
        last = None
        for t in sorted(t for k, t in rows if k == u and t is not None):
            if last is None or t - last >= 100:
                want.append((u, t))
                last = t
    assert got == want


def test_harness_summary(spark):
    rows = misc.harness_summary(spark.createDataFrame([(1, 600), (11, 1800), (21, 1800), (31, 0)], "multiplier long, urls long"), 600).orderBy("place").collect()
    assert [(r.multiplier, r.per_second, r.best) for r in rows] == [(11, 3.0, True), (21, 3.0, False), (1, 1.0, False), (31, 0.0, False)]
    assert rows[0].average_per_second == 1.75


def test_meta_lines_keep_their_order_across_splits(spark, tmp_path):
    lines = [x for k in range(3000) for x in (f"u{k}\tt{k}\tfirst", "second", f"third {k}")]
    (tmp_path / "meta.txt").write_text("lost line\n" + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = io.read_meta(spark, str(tmp_path)).orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.url, r.title, r.snippet) for r in got] == [(f"u{k}", f"t{k}", f"first second third {k}") for k in range(3000)]


def test_unsigned_numbers(spark):
    df = spark.createDataFrame([("12",), ("+1",), ("-1",), (" 1",), ("",), ("1x",), ("99999999999999999999",)], "v string")
    assert [r[0] for r in df.select(io.unsigned(F.col("v"))).collect()] == [12, None, None, None, None, None, None]
