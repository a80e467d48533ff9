import pytest
from pyspark.sql import functions as F

from lodestone.functions import urls as U
from lodestone.operators import crawl, index, rank


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (" HTTPS://Example.COM/path?q=1#section ", "https://example.com/path?q=1"), ("https://a.com/foo/", "https://a.com/foo"), ("https://a.com/foo/?q=1", "https://a.com/foo?q=1"), ("https://a.com/?q=1", "https://a.com?q=1"),
        ("ftp://a.com/p", ""), ("a.com/p", ""), ("   ", ""), (None, ""), ("http://A.com:80/B", "http://a.com:80/B"), ("https://", ""), ("https://?q", ""),
    ],
)
def test_normalize(spark, raw, want):
    got = one(spark, U.normalize, raw)
    assert got == want
    assert one(spark, U.normalize, got) == got


@pytest.mark.parametrize(
    ("raw", "source", "base", "want"),
    [
        ("page", "https://x.com/dir/", "", "https://x.com/page"), ("page", "https://x.com/dir/file", "", "https://x.com/dir/page"), ("../a/./b", "https://x.com/c/d/e", "", "https://x.com/c/a/b"), ("/r/../s", "http://x.com/q", "", "http://x.com/s"),
        ("//cdn.org/z", "https://x.com/", "", "https://cdn.org/z"), ("?k=v", "https://x.com/p?o=1", "", "https://x.com/p?k=v"), ("#top", "https://x.com", "", ""), ("mailto:a@b", "https://x.com", "", ""), ("HTTP://x.com", "https://y.com", "", ""),
        ("p", "https://x.com/a", "https://base.org/b/c", "https://base.org/b/p"), ("p", "nothing", "", ""), ("https://Z.com/A/", "", "", "https://z.com/A"), (None, "https://x.com", "", ""),
    ],
)
def test_absolutize(spark, raw, source, base, want):
    assert one(spark, U.absolutize, raw, source, base) == want


def test_expressions_stay_small(spark):
    df = spark.createDataFrame([("a", "b", "c")], "a string, b string, c string")
    plan = df.select(U.passes_quality(U.absolutize(F.col("a"), F.col("b"), F.col("c"))))._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 60_000


@pytest.mark.parametrize(("tail", "ok"), [("com/p", 1), ("gov/p", 1), ("edu", 1), ("ca/a", 1), ("co.uk/h", 1), ("uk", 1), ("au", 1), ("net/f", 1), ("io/p", 0), ("dev/p", 0), ("xyz", 0), ("com/a.PDF", 0), ("com/a.pdf?x", 1), ("com/" + "%20" * 9, 0), ("com/" + "%20" * 9 + "a" * 90, 1)])
def test_quality(spark, tail, ok):
    assert one(spark, U.passes_quality, f"https://site.{tail}") is bool(ok)


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://sub-domain.example.com/a/b/c123?x=1&y=2", dict(host="sub-domain.example.com", tld="com", base_domain_length=7, path_length=17, path_depth=3, query_param_count=2, numeric_path_char_count=3, domain_hyphen_count=1)),
        ("https://www.alpha-beta.example.com/a1/b22?x=1&y=2", dict(base_domain_length=7, path_length=15, path_depth=2, query_param_count=2, numeric_path_char_count=3, domain_hyphen_count=1)),
        ("https://example.com?x=1&y=2", dict(host="example.com", url_path="?x=1&y=2")),
        ("https://e.com/path?", dict(query_param_count=0)), ("https://e.com/path?&x=1&&y=2&", dict(query_param_count=2)), ("https://e.com/path?x=1#f&y=2", dict(query_param_count=1)), ("https://e.com/path#f?x=1", dict(query_param_count=0)),
        ("http://u@10.0.0.1:8/x", dict(host="10.0.0.1", is_ip=True)),
    ],
)
def test_features(spark, url, want):
    df = spark.createDataFrame([(url,)], "u string")
    f = U.features(F.col("u"))
    r = df.select(*[f[k].alias(k) for k in want]).first().asDict()
    assert r == want


@pytest.mark.parametrize(("host", "kind", "n"), [("www.bbc.co.uk", "ORG", 3), ("startup.io", "OTHER", 7), ("mit.edu", "EDU", 3), ("www.site.ca", "OTHER", 3), ("site.ca", "ORG", 4), ("shop.com.au", "COM", 4), ("localhost", "OTHER", 9)])
def test_suffix(spark, host, kind, n):
    df = spark.createDataFrame([(host,)], "h string")
    a, b = U.suffix_of(F.col("h"))
    assert tuple(df.select(a, b).first()) == (kind, n)


def test_frontier_scores(spark):
    rows = [("https://mit.edu/", 0, False), ("https://mit.edu/about", 0, False), ("https://mit.edu/", 1, False), ("https://mit.edu/", 0, True), ("https://ads.x.com/blog/search?a=1&b=2&c=3", 0, False)]
    got = crawl.frontier(spark.createDataFrame(rows, "url string, seed_distance long, failed boolean")).collect()
    want = [4 - 0.3 - 0.2 + 2, 4 - 0.3 - 0.2, 4 - 0.3 - 0.2 + 2 - 3, 4 - 0.3 - 0.2 + 2 - 10, 3 - 0.1 - 0.4 + 1 - 1.5 - 0.5 - 2]
    assert [r.score for r in got] == pytest.approx(want)


def test_host_order_and_promotion(spark):
    items = spark.createDataFrame([(i, f"h{i % 3}", float(i % 5), f"u{i}") for i in range(20)], "seq long, host string, score double, url string")
    first = [r.seq for r in crawl.host_queue(items).where("place = 1").orderBy("seq").collect()]
    assert first == [0, 1, 2]
    best = crawl.promote(items, 0.25).collect()
    assert len(best) == 5 and min(r.score for r in best) >= 3.0


def test_reservation_equals_the_fold(spark):
    rows = [("a", t) for t in (0, 100, 450, 2000, 2001, 2002)] + [("b", 5), ("b", 5)]
    got = crawl.reserve_times(spark.createDataFrame(rows, "k string, t long"), "k", "t").orderBy("k", "t", "start_ms").collect()
    free, want = {}, []
    for k, t in rows:
        s = max(t, free.get(k, 0))
        free[k] = s + 500
        want.append(s)
    assert [r.start_ms for r in got] == want
    taken = crawl.accept_or_delay(spark.createDataFrame(rows, "k string, t long"), "k", "t").orderBy("k", "t").collect()
    assert [(r.k, r.t) for r in taken] == [("a", 0), ("a", 2000), ("b", 5)]


def test_blacklist_and_distances(spark):
    pages = spark.createDataFrame([("https://github.com/a",), ("https://gist.GitHub.com/b",), ("https://notgithub.com",), ("https://x.org",)], "url string")
    listed = spark.createDataFrame([("github.com",)], "domain string")
    assert {r.url for r in crawl.drop_blacklisted(pages, listed).collect()} == {"https://notgithub.com", "https://x.org"}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e")], "source string, target string")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert {tuple(r) for r in crawl.seed_distances(seeds, edges).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_seed_ranks_are_global(spark):
    rows = [(f"https://site{i}.com/{'x/' * (i % 7)}", i % 3, False) for i in range(200)]
    got = crawl.rank_seeds(spark.createDataFrame(rows, "url string, seed_distance long, failed boolean")).collect()
    order = sorted(got, key=lambda r: (-r.score, r.url))
    assert [r["rank"] for r in order] == list(range(1, 201))


def test_static_rank(spark):
    f = {"words": 100, "title_words": 6, "seed_distance": 1, "url_length": 60, "path_length": 20, "path_depth": 0, "query_param_count": 0, "numeric_path_char_count": 1, "domain_hyphen_count": 0, "base_domain_length": 5, "link_count": 20, "anchor_words": 80}
    df = spark.createDataFrame([(*f.values(), "org", True, False)], ", ".join(f"{k} long" for k in f) + ", tld string, t boolean, n boolean")
    cols = {k: F.col(k) for k in f} | {"tld": F.col("tld"), "https": F.col("t"), "saw_body": F.col("t"), "saw_close_html": F.col("t"), "truncated": F.col("n"), "open_discard": F.col("n")}
    got = df.select(rank.static_score(cols, F.col("t")), rank.static_score(cols, F.col("n"))).first()
    content = 3.3 / 2 + 0.9 / 6 + 0.45 / 2
    assert got[1] == pytest.approx(content)
    assert got[0] == pytest.approx(content + 0.85 + 0.275 + 0.475 + 1.15 + 0.95 + 0.375 + 0.45 + 0.35 + 0.2 + 0.15 + 0.1)


def test_meta_sync(spark):
    docs = spark.createDataFrame([("u",), ("v/",), ("w",)], "url string")
    meta = spark.createDataFrame([("u", "1", "a", 1), ("u", "2", "b", 2), ("v", "3", "c", 3)], "url string, title string, snippet string, line_no long")
    assert {tuple(r) for r in index.meta_sync(docs, meta).collect()} == {("u", "2", "b"), ("v/", "3", "c"), ("w", "<UNKNOWN TITLE>", "<UNKNOWN SNIPPET>")}
