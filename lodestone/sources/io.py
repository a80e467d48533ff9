"""Sources and sinks: lists, snapshots, chunks, frontier lines, directory walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import urls as U

CHUNK_SCHEMA_VERSION = 2


def read_seeds(spark: SparkSession, path: str, only_canonical: bool = True) -> DataFrame:
    """(url): a URL a line; optionally only those that pass the quality checks, canonical."""
    lines = spark.read.text(path).select(F.trim("value").alias("url")).where("url <> ''")
    return lines.select(U.normalize(F.col("url")).alias("url")).where(U.passes_quality(F.col("url"))) if only_canonical else lines


def read_blacklist(spark: SparkSession, path: str) -> DataFrame:
    """(domain): a domain or URL a line."""
    line = F.trim("value")
    return spark.read.text(path).where(line != "").select(F.when(F.contains(line, F.lit("://")), U.host(line)).otherwise(line).alias("domain"))


def decode_http(raw: Column) -> dict[str, Column]:
    """status and body of a raw response; the body only of a 2xx one."""
    status = F.regexp_extract(raw, r"^HTTP/[0-9.]+ ([0-9]{3})", 1)
    status = F.nullif(status, F.lit("")).cast("int")
    body = F.regexp_extract(raw, r"(?s)^.*?(?:\r\n\r\n|\n\n)(.*)\z", 1)
    return {"status": status, "body": F.when(status.between(200, 299), body)}


def write_chunks(postings: DataFrame, path: str, chunk_col: str | None = "chunk_id", id_col: str = "doc_id") -> None:
    """Postings sorted by term and document, partitioned by chunk if there are chunks, so that a term look-up reads few row groups.

    Ranges of (term, document) spread a hot term over as many files as it needs."""
    keys = [*([chunk_col] if chunk_col else []), "term", id_col]
    rows = postings.withColumn("schema_version", F.lit(CHUNK_SCHEMA_VERSION)).repartitionByRange(*keys).sortWithinPartitions(*keys).write
    (rows.partitionBy(chunk_col) if chunk_col else rows).parquet(path)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """A chunk table, rows of the current version."""
    df = spark.read.parquet(path)
    if "schema_version" not in df.columns:
        raise ValueError("not a chunk table")
    return df.where(F.col("schema_version") == CHUNK_SCHEMA_VERSION).drop("schema_version")


def read_terms(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """The postings of some terms: the predicate reaches the Parquet scan."""
    return read_postings(spark, path).where(F.col("term").isin(terms))


def write_anchor_snapshot(anchors: DataFrame, path: str) -> None:
    """url, referring count, number of words, words; tab-separated lines, appended atomically."""
    anchors.select(F.concat_ws("\t", "url", "referring_count", F.size("words"), F.array_join("words", " ")).alias("value")).write.mode("append").text(path)


def read_anchor_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(url, referring_count, words); lines with fewer than three tabs or over 64 KiB are skipped, and a header up to [Words]."""
    f = F.split("value", "\t", 4)
    lines = spark.read.text(path).where((F.size(F.split("value", "\t")) >= 4) & (F.octet_length("value") <= 65536))
    return lines.select(f[0].alias("url"), unsigned(f[1]).alias("referring_count"), F.filter(F.split(f[3], " "), lambda w: w != "").alias("words"))


def write_meta(meta: DataFrame, path: str) -> None:
    """url, title, snippet as tab-separated lines."""
    meta.select(F.concat_ws("\t", "url", "title", "snippet").alias("value")).write.text(path)


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """(url, title, snippet, line_no); a line with fewer than two tabs continues the record before it.

    Lines keep the order of their file: by split, then as read; a large file is read as several splits."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("n"), F.col("value").alias("line")).where("line <> ''")
    start = F.size(F.split("line", "\t")) >= 3
    numbered = lines.withColumn("record", F.sum(start.cast("long")).over(Window.partitionBy("file").orderBy("n"))).where("record > 0")
    whole = numbered.groupBy("file", "record").agg(F.array_join(F.sort_array(F.collect_list(F.struct("n", "line")))["line"], " ").alias("line"))
    f = F.split("line", "\t", 3)
    return whole.select(f[0].alias("url"), f[1].alias("title"), f[2].alias("snippet"), F.row_number().over(Window.partitionBy("file").orderBy("record")).cast("long").alias("line_no"))


def frontier_line() -> Column:
    """A frontier item as link|suffix|base|seed|depth|failed."""
    return F.concat_ws("|", "url", "suffix", F.col("base_length").cast("string"), F.col("seed_distance").cast("string"), F.col("frontier_depth").cast("string"), F.col("failed").cast("int").cast("string"))


def parse_frontier_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """The items of such lines; malformed ones are dropped. The link may hold bars."""
    m = [F.regexp_extract(column, r"^(.*)\|([A-Z]+)\|([0-9]+)\|([0-9]+)\|([0-9]+)\|([01])$", g) for g in range(1, 7)]
    items = lines.where(m[1] != "")
    return items.select(m[0].alias("url"), m[1].alias("suffix"), m[2].cast("long").alias("base_length"), m[3].cast("long").alias("seed_distance"), m[4].cast("long").alias("frontier_depth"), (m[5] == "1").alias("failed"))


def write_checkpoint(frontier_items: DataFrame, seen: DataFrame, path: str, number: int) -> None:
    """One checkpoint: frontier lines, the seen URLs, and a header of counts, whose file is the mark that all of it is there."""
    at = f"{path.rstrip('/')}/{number:09d}"
    frontier_items.select(frontier_line().alias("value")).write.mode("overwrite").text(f"{at}/frontier")
    seen.select("url").write.mode("overwrite").parquet(f"{at}/seen")
    s = seen.sparkSession
    head = s.read.text(f"{at}/frontier").agg(F.count("*").alias("frontier")).crossJoin(s.read.parquet(f"{at}/seen").agg(F.count("*").alias("seen")))  # a row each
    head.withColumn("number", F.lit(number).cast("long")).coalesce(1).write.mode("overwrite").json(f"{at}/header")


def read_checkpoint(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(frontier items, seen URLs, header) of the newest checkpoint that is complete and whose counts are right."""
    heads = spark.read.json(f"{path.rstrip('/')}/*/header", schema="number long, frontier long, seen long").orderBy(F.desc("number")).limit(8).collect()
    for h in heads:
        at = f"{path.rstrip('/')}/{h.number:09d}"
        lines, seen = spark.read.text(f"{at}/frontier"), spark.read.schema("url string").parquet(f"{at}/seen")
        if lines.count() == h.frontier and seen.count() == h.seen:
            return parse_frontier_lines(lines), seen, h.asDict()
    raise ValueError("no complete checkpoint")


def unsigned(c: Column) -> Column:
    """A strict unsigned number: digits only, no sign or space; null else."""
    return F.when(c.rlike(r"^[0-9]+\z"), c.try_cast("long"))


def collect_words(spark: SparkSession, path: str, whole_lines: bool = False) -> DataFrame:
    """(word): the white-space tokens of text files, or their lines."""
    lines = spark.read.text(path)
    if whole_lines:
        return lines.select(F.col("value").alias("word"))
    return lines.select(F.explode(F.split("value", r"\s+")).alias("word")).where("word <> ''")


def walk(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of all files below a folder, sorted by path; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").orderBy("path")


def fetch(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The table's rows of the asked ids, each once; AQE broadcasts the ids when they are few."""
    return table.join(ids.select(key).distinct(), key, "left_semi")


def lookup(keys: DataFrame, blob: DataFrame, key: str, default) -> DataFrame:
    """The values of keys in a key/value table, ``default`` where absent; of a repeated key the first stored (least value order) counts."""
    first = blob.groupBy(key).agg(F.min("value").alias("value"))
    return keys.join(first, key, "left").withColumn("value", F.coalesce("value", F.lit(default)))
