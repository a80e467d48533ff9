"""Structured Streaming jobs: micro-batch indexing, exact stateful dedup, per-host politeness."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.operators.crawl import DEFAULT_DELAY_MS
from lodestone.operators.html import is_broken, parse_pages
from lodestone.operators.index import page_tokens


def page_stream(spark: SparkSession, path: str, files_per_trigger: int | None = 4, names: str = "*") -> DataFrame:
    """Pages from a folder of Parquet files whose names fit, or from one file; the file limit is the back-pressure, None reads all that is there at once."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():  # a source's path is a folder
        path, names = p.getParent().toString(), p.getName()
    reader = spark.readStream.schema("page_id long, url string, html string").option("pathGlobFilter", names)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def index_stream(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Parse, filter and tokenise each micro-batch into a chunk of its own; a replayed batch overwrites its chunk."""

    def chunk(batch: DataFrame, number: int) -> None:
        parsed = parse_pages(batch).where(~is_broken())
        page_tokens(parsed).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{out}/chunk_id={number}")

    return pages.writeStream.foreachBatch(chunk).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_urls(stream: DataFrame, url_col: str = "url", ts_col: str | None = None, keep: str = "1 hour") -> DataFrame:
    """Each URL once; with an event time, its state is dropped ``keep`` behind the watermark."""
    if ts_col:
        return stream.withWatermark(ts_col, keep).dropDuplicatesWithinWatermark([url_col])
    return stream.dropDuplicates([url_col])


def polite_schedule(requests: DataFrame, delay_ms: int = DEFAULT_DELAY_MS) -> DataFrame:
    """(host, url, start_ms): when each request (host, url, at_ms, delay_ms) may go, one at a time per host.

    A host's requests go by (at_ms, url) within a micro-batch, and behind those of earlier ones; to have them all in that
    order, read them as one. The state of a host is one number: when it's free again."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free = state.get[0] if state.exists else 0
        rows = []
        every = pd.concat(list(batches)).sort_values(["at_ms", "url"])
        for url, at, own in zip(every["url"], every["at_ms"], every["delay_ms"], strict=True):
            start = max(int(at), free)
            free = start + max(delay_ms, int(own))
            rows.append((key[0], url, start))
        state.update((free,))
        yield pd.DataFrame(rows, columns=["host", "url", "start_ms"])

    return requests.groupBy("host").applyInPandasWithState(run, "host string, url string, start_ms long", "free long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, ts_col: str, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts per key and tumbling window, closed when the watermark has passed it."""
    return events.withWatermark(ts_col, late).groupBy(F.window(ts_col, width), key).agg(F.count("*").alias("n"))
