import pytest
from pyspark.sql import functions as F

from lodestone.operators import html, index, robots
from lodestone.sources import io

MESSY = """<!doctype html><html lang='EN-gb'>
<title> One <a href="first.zip">Two</title><title>Three</title>
<BODY class="x>y">alpha<b>beta</b> 3<4 <p ptext <div>gamma</div>
<a href= <a />delta <a name="n" href='second.htm'>epsilon</a>zeta <unknown>eta</unknown>
<title/> <script> no <p> no </script> <style>no</style><!-- no <b> no --><base href="root/"></a></a><base href="other/">
<embed src=movie.swf> caf&eacute; <svg/>theta</body>last <h   this is lost>"""


def page(text):
    return html.Page(text.encode())


def test_messy_page():
    p = page(MESSY)
    words = b" ".join(p.words).decode()
    assert b" ".join(p.title) == b"One Two Three"
    assert words == "alpha beta 3<4 gamma delta epsilon zeta <unknown>eta</unknown> caf&eacute; theta last <h this is lost>"
    assert p.base == b"root/" and p.lang == b"EN-gb"
    assert [u for u, _ in p.links] == [b"first.zip", b"second.htm", b"movie.swf"]
    assert p.links[1][1] == [b"epsilon"]
    assert p.links[0][1][:2] == [b"Two", b"Three"]
    assert p.saw_body and not p.saw_close and not p.truncated and not p.open_discard


@pytest.mark.parametrize(
    ("text", "want"),
    [("<html><body><script>bad", "body open"), ("<html><body><div", "body cut"), ("<body>x</body></html>", "body close"), ("", ""), ("<svg><b>", "open"), ("<!-- x", "cut"), ("a < b > c", "")],
)
def test_signals(text, want):
    p = page(text)
    got = [n for n, v in (("body", p.saw_body), ("close", p.saw_close), ("cut", p.truncated), ("open", p.open_discard)) if v]
    assert got == want.split()


def test_attributes():
    assert html.attribute(b' data-href="x"', b"href") == b"x"
    assert html.attribute(b" href = bare rest", b"href") == b"bare"
    assert html.attribute(b" href='a b'", b"href") == b"a b"
    assert html.attribute(b" href", b"href") == b""


def test_parsed_table(spark):
    pages = spark.createDataFrame([(1, "https://a.com/x", MESSY), (2, "https://a.com/y", None), (3, None, "")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html.parse_pages(pages).collect()}
    assert got[1].title_words == ["One", "Two", "Three"] and got[1].base == "root/"
    assert got[2].words == [] and got[3].links == [] and not got[2].saw_body
    assert [r.page_id for r in html.parse_pages(pages).where(html.is_broken()).orderBy("page_id").collect()] == [1, 2, 3]
    meta = {r.doc_id: r for r in index.meta_records(html.parse_pages(pages)).collect()}
    assert meta[2].title == "Untitled" and meta[2].snippet == "No content available."
    assert html.parse_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize(("text", "want"), [("## hello", "hello"), ("1a2f word", "word"), ("abc word", "abc word"), ("12ab 345 x", "x"), ("!" * 12 + "x", "!!x"), ("y" * 400, "y" * 300), ("", "No content available.")])
def test_snippets(text, want):
    assert index._snippet(text) == want


def test_links_and_anchors(spark):
    pages = spark.createDataFrame([(1, "https://a.com/d/x", '<a href="y">one two</a><a href="y"></a><a href="/z.pdf">no</a>'), (2, "https://a.com/d/z", '<a href="https://A.com/d/y#f">three</a>')], "page_id long, url string, html string")
    edges = index.link_edges(html.parse_pages(pages))
    assert {(r.page_id, r.target) for r in edges.collect()} == {(1, "https://a.com/d/y"), (2, "https://a.com/d/y")}
    assert [tuple(r) for r in index.anchor_records(edges).collect()] == [("https://a.com/d/y", ["one", "two", "three"], 2)]


ROBOTS = """User-agent: Spider
User-agent: CRAB
Disallow: /shop
Allow:  /shop/free
Sitemap: https://s.example:50/a.xml
Allow: /shop/*gi*ft
Crawl-delay: 5
# comment

User-agent: *
Disallow: q*rk
Allow: quirk
disallow: /c%3cd.html
disallow: /c%2fd.html
disallow: /c%2e.d

User-agent: DIR
disallow: /tmp

User-agent: SLASH
disallow: /tmp/
"""
#: user, path, allowed, delay.
VERDICTS = [
    ("Spider", "/shop", False, 5), ("Spider", "/shop/free", True, 5), ("Spi", "/shop", True, 0), ("SpiderTwo", "/shop", False, 5), ("sPIDER", "/shop", False, 5), ("crab", "/shop/giraft", True, 5), ("crab", "/shop/gi-x-ft!", True, 5),
    ("any", "/qoork", False, 0), ("crab", "/quirk", True, 0), ("any", "/nothing", True, 0), ("DIR", "/tmp", False, 0), ("DIR", "/tmp.html", False, 0), ("DIR", "/tmp/a", False, 0), ("SLASH", "/tmp", True, 0), ("SLASH", "/tmp/", False, 0), ("SLASH", "/tmp.html", True, 0),
    ("any", "/c%2fd.html", False, 0), ("any", "/c%2Fd.html", False, 0), ("any", "/c/d.html", True, 0), ("any", "/c..dx", False, 0), ("any", "/%63%2e.dx", False, 0),
]


def test_robots(spark):
    rules = robots.parse_robots(spark.createDataFrame([("https://o", ROBOTS)], "origin string, text string"))
    asked = spark.createDataFrame([(i, "https://o", u, p) for i, (u, p, _, _) in enumerate(VERDICTS)] + [(99, "https://other", "Spider", "/shop")], "n long, origin string, user string, path string")
    got = {r.n: (r.allowed, r.crawl_delay) for r in robots.verdicts(asked, rules).collect()}
    assert got.pop(99) == (True, 0)
    for i, (u, p, ok, delay) in enumerate(VERDICTS):
        assert got[i] == (ok, delay), (u, p)
    assert robots.parse(ROBOTS)[1] == ["https://s.example:50/a.xml"]


def test_disallow_all(spark):
    rules = robots.parse_robots(spark.createDataFrame([("o", "User-agent: *\nDisallow: /\nAllow: /$"), ("p", None), ("q", "Disallow: /x")], "origin string, text string"))
    asked = spark.createDataFrame([("o", "a", "/"), ("o", "a", "/x"), ("p", "a", "/"), ("q", "a", "/x")], "origin string, user string, path string")
    assert [(r.origin, r.path, r.allowed) for r in robots.verdicts(asked, rules).orderBy("origin", "path").collect()] == [("o", "/", True), ("o", "/x", False), ("p", "/", True), ("q", "/x", True)]


def test_snapshots(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.txt").write_text("broken\nu\tT\tfirst\nsecond\n\nv\tU\tx\ty\n")
    got = io.read_meta(spark, str(tmp_path / "m")).orderBy("line_no").collect()
    assert [(r.url, r.title, r.snippet) for r in got] == [("u", "T", "first second"), ("v", "U", "x\ty")]
    (tmp_path / "anchors.txt").write_text("[HEADER]\n[Words]\nu\t3\t2\tone two\nbad\tline\n" + "z\t1\t1\t" + "w" * 70_000 + "\n")
    assert [tuple(r) for r in io.read_anchor_snapshot(spark, str(tmp_path / "anchors.txt")).collect()] == [("u", 3, ["one", "two"])]
    raw = spark.createDataFrame([("HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\r\n\r\nmore",), ("HTTP/1.0 404 No\n\nx",), ("junk",)], "r string")
    r = raw.select(*[c.alias(n) for n, c in io.decode_http(F.col("r")).items()]).collect()
    assert [(x.status, x.body) for x in r] == [(200, "body\r\n\r\nmore"), (404, None), (None, None)]
    with pytest.raises(ValueError):
        io.read_terms(spark, "/root/testdata/sf0.001/pages.parquet", ["x"])


def test_pushdown(spark, tmp_path):
    tokens = index.text_tokens(spark.createDataFrame([(1, "cat dog"), (2, "dog")], "doc_id long, text string"))
    io.write_chunks(index.postings(tokens).withColumn("chunk_id", F.col("doc_id") % 2), str(tmp_path / "c"))
    df = io.read_terms(spark, str(tmp_path / "c"), ["dog"])
    assert {(r.doc_id, tuple(r.locs)) for r in df.collect()} == {(1, (1,)), (2, (0,))}
    assert "In(term" in df._jdf.queryExecution().executedPlan().toString().replace(" ", "") or "EqualTo(term" in df._jdf.queryExecution().executedPlan().toString()


def test_pages_are_parsed_in_bounded_parts(spark, monkeypatch):
    """Whatever the size of the batches that Spark hands over, the words of about SLICE_BYTES of HTML are Python objects at once."""
    import pyarrow as pa

    page = "<html><body>" + "word " * 20_000
    texts = [page, None, "", *[page] * 98]
    batch = pa.record_batch({"page_id": list(range(101)), "html": texts})
    df = spark.createDataFrame([], "page_id long, html string")
    taken = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: taken.append(f) or self)
    html.parse_pages(df)
    parts = list(taken[0](iter([batch])))
    assert max(p.num_rows for p in parts) <= html.SLICE_BYTES // len(page) + 3
    assert [x for p in parts for x in p.column("page_id").to_pylist()] == list(range(101))
    assert [len(x) for p in parts for x in p.column("words").to_pylist()] == [20_000, 0, 0, *[20_000] * 98]


def test_pages_reach_python_in_small_batches(spark):
    """Not in batches of 10,000 pages or 64 MB, of which a worker holds two."""
    name, row = "spark.sql.execution.arrow.maxBytesPerBatch", 10_000
    pages = spark.createDataFrame([(1, "https://a.com/x", "x")], "page_id long, url string, html string")

    def most():
        def run(batches):
            import pyarrow as pa

            yield from (pa.record_batch({"n": [b.nbytes]}) for b in batches)

        return spark.range(3000).coalesce(1).selectExpr(f"repeat('x', {row}) AS html").mapInArrow(run, "n long").agg(F.max("n")).first()[0]

    try:
        spark.conf.set(name, "64m")
        html.parse_pages(pages)
        assert row * 100 < most() < 5 << 20
        spark.conf.set(name, "1m")
        html.parse_pages(pages)
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.unset(name)
