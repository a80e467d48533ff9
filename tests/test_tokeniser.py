"""Postings made in Arrow batches against those of a row a token."""

import compare
import duckdb
from pyspark.sql import functions as F

from lodestone import registry
from lodestone.operators import index, tokeniser

TEXTS = [(1, "The cat-Sat, on the  MAT-mat a--b -x- é-à Éa\x0b\x0ctail"), (2, ""), (3, None), (4, "--- ... \t\n"), (5, "a-a a a-a"), (1, "the the cat"), (6, "x y " * 3000), (None, "none of the"), (7, "-a b- c d\xa0e")]


def test_same_postings_as_of_tokens(spark, monkeypatch):
    monkeypatch.setattr(tokeniser, "SLICE_BYTES", 64)
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    for some in (docs, docs.dropDuplicates(["doc_id"])):
        tokens = index.text_tokens(some)
        want = index.postings(tokens).join(tokens.groupBy("term", F.col("doc_id").alias("d")).agg(F.count("*").alias("n")).withColumnRenamed("term", "t"), F.expr("term = t AND doc_id <=> d"))
        got = tokeniser.text_postings(some)
        assert sorted(map(str, got.select("term", "doc_id", "locs", "n").collect())) == sorted(map(str, want.select("term", "doc_id", "locs", "n").collect()))
        assert "collect_set" not in got._jdf.queryExecution().toString()
        every = tokeniser.text_postings(some, distinct=False).agg(F.sum(F.size("locs")), F.sum("n")).first()
        assert every[0] == every[1] == tokens.count()


def test_posting_lists_are_hashed_as_they_stream_by(spark, tmp_path):
    """A list that goes over many batches, ids that are null, negative or repeated; no list is collected."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame([*TEXTS, (None, "none b"), (10, "x the"), (9, "x"), (-3, "y the")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    sql = duckdb.connect()
    sql.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    try:
        for most in (2, 10_000):
            spark.conf.set(name, most)
            got = registry.QUERIES["posting_lists"](spark, str(tmp_path))
            assert compare.difference(got, registry.ORACLES["posting_lists"], sql) == ""
            assert "collect_list(struct" not in got._jdf.queryExecution().toString()
    finally:
        spark.conf.unset(name)
