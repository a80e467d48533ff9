"""Tokens, positional postings, document and anchor tables, metadata."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import urls as U
from lodestone.functions.stem import with_stems
from lodestone.operators.rank import RankConfig, static_score
from lodestone.session import ship

NO_ANCHOR = "PageWithNoAnchorText"


def raw_tokens(docs: DataFrame, id_col: str, words: Column, **carried: Column) -> DataFrame:
    """(id, loc, form): every raw word takes one location, whether it gives no form, one or three.

    What a document's words share is computed before they are told apart, else once a word."""
    whole = docs.select(F.col(id_col), *[c.alias(n) for n, c in carried.items()], words.alias("_words"))
    at = whole.select(id_col, *carried, F.posexplode("_words").alias("loc", "word"))
    return at.select(id_col, *carried, F.col("loc").cast("long").alias("loc"), F.explode(X.word_forms(F.col("word"))).alias("form")).where("form <> ''")


def text_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Unstemmed tokens of a plain text column."""
    return raw_tokens(docs, id_col, X.words(F.col(text_col))).withColumnRenamed("form", "term")


def page_tokens(parsed: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, loc, field, term): stemmed tokens, the title's locations first, then the body's."""
    t = raw_tokens(parsed, id_col, F.concat("title_words", "words"), titles=F.size("title_words"))
    t = t.withColumn("field", F.when(F.col("loc") < F.col("titles"), "title").otherwise("body"))
    return with_stems(t).select(id_col, "loc", "field", F.col("stem").alias("term"))


def posting_stats(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(term, df, cf). One shuffle on the pair, whose counts both come from; a hot term is spread over its documents."""
    per_doc = tokens.groupBy("term", id_col).agg(F.count("*").alias("n"))
    return per_doc.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("cf"))


def postings(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(term, id, locs): a positional list per term and document, the unit that a reader needs."""
    return tokens.groupBy("term", id_col).agg(F.sort_array(F.collect_set("loc")).alias("locs"))


def posting_lists(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(term, df, cf, locations): whole lists, for small vocabularies and inspection."""
    lists = tokens.groupBy("term").agg(F.count_distinct(id_col).alias("df"), F.count("*").alias("cf"), F.sort_array(F.collect_list(F.struct(id_col, "loc"))).alias("locations"))
    return lists


def corpus_stats(tokens: DataFrame, docs: DataFrame, words: Column) -> DataFrame:
    """num_documents, num_unique_terms, total_locations (a slot per word and one per document end)."""
    d = docs.agg(F.count("*").alias("num_documents"), F.sum(F.coalesce(F.size(words), F.lit(0)) + 1).cast("long").alias("total_locations"))
    return d.crossJoin(tokens.agg(F.count_distinct("term").alias("num_unique_terms")))


def link_edges(parsed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, source, target, anchor): the pages' links as canonical URLs that pass the quality checks."""
    e = parsed.select(id_col, F.col(url_col).alias("source"), "base", F.posexplode("links").alias("link_no", "link"))
    e = e.withColumn("target", U.absolutize(F.col("link.url"), F.col("source"), F.col("base")))
    return e.where(U.passes_quality(F.col("target"))).select(id_col, "source", F.col("link_no").cast("long").alias("link_no"), "target", F.col("link.anchor").alias("anchor"))


def anchor_records(edges: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(url, words, referring_count): the anchor texts of a target in (page, link) order; empty ones don't count."""
    some = edges.where(F.size("anchor") > 0)
    grouped = some.groupBy(F.col("target").alias("url")).agg(F.sort_array(F.collect_list(F.struct(id_col, "link_no", "anchor"))).alias("a"), F.count("*").alias("referring_count"))
    return grouped.select("url", F.flatten(F.col("a.anchor")).alias("words"), "referring_count")


def merge_anchors(snapshots: list[DataFrame]) -> DataFrame:
    """(url, words, referring_count) of several snapshots: a target's words in the order of the snapshots, its counts added."""
    parts = [s.select("url", "words", "referring_count", F.lit(k).alias("snapshot")) for k, s in enumerate(snapshots)]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    # a target has a row a snapshot, or a few where one was appended to
    grouped = every.groupBy("url").agg(F.sort_array(F.collect_list(F.struct("snapshot", "words", "referring_count"))).alias("a"), F.sum("referring_count").alias("referring_count"))
    return grouped.select("url", F.flatten(F.col("a.words")).alias("words"), "referring_count")


def anchor_documents(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, words): the anchor text of each document, re-tokenised as letter and digit runs; a stand-in where there is none."""
    found = docs.join(anchors.select("url", "words"), "url", "left")
    text = F.coalesce(F.array_join("words", " "), F.lit(NO_ANCHOR))
    return found.select("doc_id", "url", X.alnum_runs(text).alias("words"))


def anchor_chunk_join(anchors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Anchors of indexed URLs with their chunk; of a URL in several chunks the first counts."""
    first = chunks.groupBy("url").agg(F.min(F.struct("chunk_id", "doc_id")).alias("c")).select("url", "c.chunk_id", "c.doc_id")
    return anchors.join(first, "url")


def documents(parsed: DataFrame, url_col: str = "url", seed_distance: Column | None = None) -> DataFrame:
    """A row per page: counts, signals, URL features and the static score, computed once at index time."""
    seed = seed_distance if seed_distance is not None else F.lit(0)
    f = U.features(F.col(url_col))
    base = parsed.select(
        F.col("page_id").alias("doc_id"), F.col(url_col).alias("url"),
        F.size("words").cast("long").alias("word_count"), (F.size("title_words") % 65536).cast("long").alias("title_word_count"), (seed % 256).cast("long").alias("seed_distance"),
        U.is_https(F.col(url_col)).alias("https"), "saw_body", "saw_close_html", "truncated", "open_discard",
        U.saturate(F.size("links"), 65535).alias("link_count"),
        U.saturate(F.aggregate(F.transform("links", lambda x: F.size(x["anchor"])), F.lit(0), lambda a, b: a + b), 65535).alias("anchor_word_count"),
        *[c.alias(n) for n, c in f.items()],
    )
    cols = {n: F.col(n) for n in f} | {n: F.col(n) for n in ("https", "saw_body", "saw_close_html", "truncated", "open_discard", "link_count", "seed_distance")} | {"words": F.col("word_count"), "title_words": F.col("title_word_count"), "anchor_words": F.col("anchor_word_count")}
    return base.withColumn("score", static_score(cols, F.lit(True), RankConfig()))


def page_flags(parsed: DataFrame) -> Column:
    """The packed flag byte: presence, https, body, close, truncated, open section."""
    bits = [F.lit(True), F.col("https"), F.col("saw_body"), F.col("saw_close_html"), F.col("truncated"), F.col("open_discard")]
    return sum((F.shiftleft(b.cast("int"), i) for i, b in enumerate(bits[1:], 1)), bits[0].cast("int"))


def _snippet(s: str) -> str:
    """Without up to ten leading bytes of other signs and leading code-like tokens, at most 300 bytes."""
    b = s.encode()
    lead = 0
    while lead < min(len(b), 10) and not (b[lead : lead + 1].isalnum() and b[lead] < 128):
        c = b[lead]
        lead += 1 if c < 0x80 else 2 if c & 0xE0 == 0xC0 else 3 if c & 0xF0 == 0xE0 else 4 if c & 0xF8 == 0xF0 else 1
    b = b[lead:] or b"No content available."
    at, lettered = 0, 0
    while at < min(len(b), 32):
        end = b.find(b" ", at)
        end = len(b) if end < 0 else end
        token = b[at:end]
        if not 3 <= len(token) <= 6 or not all(x in b"0123456789abcdefABCDEF" for x in token):
            break
        digit, letter = any(48 <= x <= 57 for x in token), any(x > 57 for x in token)
        if not (digit and (letter or lettered)):
            break
        lettered += letter
        at = end + (end < len(b))
    return (b[at:] or b"No content available.")[:300].decode("utf-8", "ignore")


def meta_records(parsed: DataFrame, url_col: str = "url") -> DataFrame:
    """(doc_id, url, title, snippet) for result pages."""
    ship(parsed.sparkSession)

    @F.pandas_udf("string")
    def snippet(s: pd.Series) -> pd.Series:
        return s.map(_snippet)

    @F.pandas_udf("string")
    def cap(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x.encode()[:300].decode("utf-8", "ignore"))

    title = F.when(F.size("title_words") == 0, F.lit("Untitled")).otherwise(F.concat(F.array_join("title_words", " "), F.lit(" ")))
    # a word is at least a byte and a space, so 150 words always reach the 300 bytes
    body = F.when(F.size("words") == 0, F.lit("No content available.")).otherwise(F.concat(F.array_join(F.slice("words", 1, 150), " "), F.lit(" ")))
    return parsed.select(F.col("page_id").alias("doc_id"), F.col(url_col).alias("url"), cap(X.sanitise(title)).alias("title"), snippet(X.sanitise(body)).alias("snippet"))


def meta_sync(docs: DataFrame, meta: DataFrame) -> DataFrame:
    """``docs`` (url) with title and snippet: exact URL, else with or without a trailing slash, else a marker; the last record of a URL wins.

    meta: (url, title, snippet, line_no)."""
    last = meta.groupBy("url").agg(F.max_by(F.struct("title", "snippet"), "line_no").alias("m"))
    other = F.when(F.col("url").endswith("/"), F.regexp_replace("url", r"/\z", "")).otherwise(F.concat("url", F.lit("/")))
    one = docs.join(last.withColumnRenamed("m", "_exact"), "url", "left").withColumn("_other", other)
    two = one.join(last.select(F.col("url").alias("_other"), F.col("m").alias("_near")), "_other", "left")
    m = F.coalesce("_exact", "_near")
    return two.select(*docs.columns, F.coalesce(m["title"], F.lit("<UNKNOWN TITLE>")).alias("title"), F.coalesce(m["snippet"], F.lit("<UNKNOWN SNIPPET>")).alias("snippet"))


def meta_join(docs: DataFrame, meta: DataFrame) -> DataFrame:
    """Exact URL only; empty strings where there is none."""
    return docs.join(meta.select("url", "title", "snippet"), "url", "left").select(*docs.columns, F.coalesce("title", F.lit("")).alias("title"), F.coalesce("snippet", F.lit("")).alias("snippet"))


def stitch_records(lines: DataFrame, keys: list[str], order: str, is_start: Column, body: str) -> DataFrame:
    """Records from lines: a line that doesn't start one continues the record before it (a running sum numbers them)."""
    by = Window.partitionBy(*keys).orderBy(order)
    numbered = lines.withColumn("record", F.sum(is_start.cast("long")).over(by)).where("record > 0")
    grouped = numbered.groupBy(*keys, "record").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(body).alias("b")))).alias("a"))
    return grouped.select(*keys, "record", F.array_join(F.col("a.b"), " ").alias("body"))


def location_lookup(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """The document whose [start, end] holds each location: an equi-join on coarse cells that bounds the range join."""
    width = 4096
    cells = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start_loc") / width), F.floor(F.col("end_loc") / width))))
    keyed = hits.withColumn("_cell", F.floor(F.col("loc") / width))
    return keyed.join(cells, "_cell").where("loc between start_loc and end_loc").drop("_cell")


def word_frequency(words: DataFrame) -> DataFrame:
    return words.groupBy("word").agg(F.count("*").alias("n"))


def top_n(counts: DataFrame, n: int) -> DataFrame:
    """The n most frequent words; ties by word. Spark plans it as TakeOrderedAndProject."""
    return counts.orderBy(F.desc("n"), "word").limit(n)
