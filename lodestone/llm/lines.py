"""Line dedup against levelled sorted runs of line hashes.

The store is a set of runs, each a table of 128-bit line hashes bucketed and sorted by hash, in levels. A new
batch is reduced to its own first occurrences, merge-anti-joined with every run (both sides bucketed alike, so
no run is shuffled or sorted again), and what is left becomes a run of level 0. ``fanout`` runs of a level are
compacted into one of the next, so a line is rewritten once a level and a batch meets few runs.

A line is a text's part between newlines, compared without spaces at its ends. Of all equal lines the first
stays, in the order of (doc_id, nulls first; text hash; line number); batches are ranges of doc_id, so the result
doesn't depend on how many there are. Blank lines are left alone.

The lines are hashed in one pass over the texts into a table partitioned by batch; a batch reads its own part. A store can
outlive its job: its manifest, in the shared folder, names the runs of each level, and LineStore.open goes on from there.

Defined results. A document whose every non-blank line went goes too; null, empty and blank texts stay as
they are. Repeated rows (equal doc_id and text) are one document. Rows with null doc_id come first and
are told apart by their text; the least long is an id like any other. An empty table gives no rows. Extra columns are carried along,
whatever their names. A text of very many lines takes time in proportion: the numbers of the lines that stay are sorted, and each line
is marked in one pass.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.session import fresh, persist_table, remove, scratch

BATCHES = 4
FANOUT = 3
RUN = "h1 long, h2 long, none boolean, id long, key long, line int"


class LineStore:
    """Levelled runs of (h1, h2) with the place (none, id, key, line) of the line that each hash first stood for.

    With a ``path`` the runs and the manifest live there and a later job can open the store; else they are scratch."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None, path: str | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = path.rstrip("/") if path else None
        self.levels: list[list[tuple[str, str]]] = []
        self.version = 0

    @staticmethod
    def open(spark: SparkSession, path: str, fanout: int = FANOUT) -> LineStore:
        """The store that an earlier job left at ``path``; the latest complete manifest counts."""
        store = LineStore(spark, fanout, 1, path)
        rows = spark.read.json(f"{store.path}/manifest/*", schema="version long, buckets int, level int, path string").where("path is not null")
        kept = rows.join(rows.agg(F.max("version").alias("version")), "version").orderBy("level", "path").collect()  # a few rows a level
        for r in kept:
            store.buckets, store.version = r.buckets, r.version
            while len(store.levels) <= r.level:
                store.levels.append([])
            store.levels[r.level].append((store._table(r.path), r.path))
        return store

    def _table(self, path: str) -> str:
        """A bucketed table over a run's files."""
        name = f"lodestone_run_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({RUN}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return name

    def _save(self) -> None:
        """Write the next manifest; only then do runs that it doesn't name go."""
        if self.path:
            self.version += 1
            rows = [(self.version, self.buckets, k, p) for k, level in enumerate(self.levels) for _, p in level]
            self.spark.createDataFrame(rows, "version long, buckets int, level int, path string").coalesce(1).write.json(f"{self.path}/manifest/{self.version:09d}")

    def _write(self, rows: DataFrame) -> tuple[str, str]:
        name = f"lodestone_run_{uuid.uuid4().hex}"
        path = f"{self.path}/{name}" if self.path else scratch(self.spark, "line-run")
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        return name, path

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(n) for level in self.levels for n, _ in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """Takes ``lines`` (RUN), any number of rows a hash; returns the run of those that are new, which stays until the next batch."""
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fanout:
                self._drop(self._compact(k))
        first = lines.groupBy("h1", "h2").agg(F.min(F.struct(~F.col("none"), "id", "key", "line", "none")).alias("at")).select("h1", "h2", "at.none", "at.id", "at.key", "at.line").repartition(self.buckets, "h1", "h2")
        for run in self.runs():
            first = first.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._write(first))
        self._save()
        return self.spark.table(self.levels[0][-1][0])

    def _compact(self, k: int) -> list[tuple[str, str]]:
        old = self.levels[k]
        union = reduce(DataFrame.union, [self.spark.table(n) for n, _ in old]).repartition(self.buckets, "h1", "h2")
        merged = self._write(union)
        self.levels[k] = []
        if k + 1 == len(self.levels):
            self.levels.append([])
        self.levels[k + 1].append(merged)
        self._save()  # before the old runs go
        return old

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, path)

    def detach(self) -> None:
        """Forget this session's tables over the runs; the files stay for LineStore.open."""
        for level in self.levels:
            for name, _ in level:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels = []

    def close(self) -> None:
        for level in self.levels:
            self._drop(level)
        self.levels = []


def explode_lines(docs: DataFrame) -> DataFrame:
    """RUN rows of the non-blank lines."""
    # what a document's lines share is computed before they are told apart, else once a line
    whole = docs.where("text is not null").select(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("key"), F.split("text", "\n").alias("bodies"))
    at = whole.select("none", "id", "key", F.posexplode("bodies").alias("line", "body"))
    body = F.trim("body")
    return at.where(body != "").select(F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(1), body).alias("h2"), "none", "id", "key", "line")


def kept_lines(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(none, id, key, lines): for each document the sorted numbers of its lines that stay, as a table in the shared folder."""
    store = LineStore(docs.sparkSession, fanout)
    ids = docs.select(F.col("doc_id").cast("double").alias("d"))
    cuts = sorted({int(x) for x in ids.approxQuantile("d", [i / batches for i in range(1, batches)], 0.01)}) if batches > 1 else []
    batch = F.lit(0)
    for k, low in enumerate(cuts, 1):
        batch = F.when(~F.col("none") & (F.col("id") >= low), k).otherwise(batch)
    path = scratch(docs.sparkSession, "line-hashes")
    explode_lines(docs).withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    hashed = docs.sparkSession.read.schema(RUN + ", batch int").parquet(path)
    try:
        for k in range(len(cuts) + 1):
            store.add(hashed.where(F.col("batch") == k).drop("batch"))
        every = reduce(DataFrame.union, [r.select("none", "id", "key", "line") for r in store.runs()])
        return persist_table(every.groupBy("none", "id", "key").agg(F.sort_array(F.collect_list("line")).alias("lines")), "kept-lines")
    finally:
        store.close()
        remove(docs.sparkSession, path)


def dedup_lines(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with repeated lines removed from text, without repeated rows and documents that hold nothing new."""
    none, own, key, lines_of, number = fresh(docs.columns, "_none", "_id", "_key", "_lines", "_n")
    kept = kept_lines(docs, batches, fanout).select(F.col("none").alias(none), F.col("id").alias(own), F.col("key").alias(key), F.col("lines").alias(lines_of))
    keyed = docs.withColumns({none: F.col("doc_id").isNull(), own: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), key: F.coalesce(F.xxhash64("text"), F.lit(0))})
    joined = keyed.join(kept, [own, key, none], "left")
    rest = [c for c in docs.columns if c not in ("text", "doc_id")]
    order = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in rest]) if rest else F.lit(0)
    one = joined.withColumn(number, F.row_number().over(Window.partitionBy(own, key, none).orderBy(order)))
    blank = F.col("text").isNull() | (F.regexp_replace("text", "[ \n]", "") == "")
    whole = F.split("text", "\n")
    told = F.size(F.filter(whole, lambda x: F.trim(x) != ""))
    # a flag for each line, from the gaps between the sorted numbers: one pass, however many lines there are
    flags = F.flatten(F.transform(lines_of, lambda x, j: F.concat(F.array_repeat(F.lit(False), x - F.coalesce(F.get(lines_of, j - 1), F.lit(-1)) - 1), F.array(F.lit(True)))))
    lines = F.zip_with(whole, flags, lambda x, stays: F.when((F.trim(x) == "") | F.coalesce(stays, F.lit(False)), x))
    new = F.when(blank | (F.size(lines_of) == told), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n"))
    stay = one.where(blank | (F.col(lines_of).isNotNull() & (F.col(number) == 1)))
    return stay.withColumn("text", new).select([f"`{c}`" for c in docs.columns])


ORACLE = """
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY trim(line) ORDER BY doc_id, pos) AS n FROM l)
SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE trim(line) = '' OR n = 1) AS text
FROM r GROUP BY doc_id
HAVING count(*) FILTER (WHERE trim(line) <> '' AND n = 1) > 0 OR count(*) FILTER (WHERE trim(line) <> '') = 0
"""
