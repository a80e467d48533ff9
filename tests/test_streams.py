"""The streaming queries on a table that is a folder of files, whose order isn't that of its rows."""

import shutil

import compare
import pytest

from lodestone import registry


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """pages.parquet as a folder of six files, the later pages in the earlier ones."""
    d = tmp_path_factory.mktemp("folder")
    pages = spark.read.parquet(f"{compare.SF}/pages.parquet").orderBy("page_id").toPandas()
    (d / "pages.parquet").mkdir()
    step = -(-len(pages) // 6)
    for k in range(6):
        at = len(pages) - (k + 1) * step
        part = spark.createDataFrame(pages[max(0, at) : at + step]).coalesce(1)
        part.write.parquet(str(d / f"part{k}"))
        shutil.move(next((d / f"part{k}").glob("*.parquet")), d / "pages.parquet" / f"part-{k}.parquet")
        shutil.rmtree(d / f"part{k}")
    return str(d)


def test_stream_index_of_a_folder(spark, folder):
    df = registry.QUERIES["stream_index"]
    assert sorted(df(spark, folder).collect()) == sorted(df(spark, compare.SF).collect())


@pytest.mark.parametrize("name", ["stream_new_urls", "stream_polite_schedule"])
def test_streams_of_a_folder(spark, folder, name):
    c = compare.connection()
    c.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    assert compare.difference(registry.QUERIES[name](spark, folder), registry.ORACLES[name], c) == ""
