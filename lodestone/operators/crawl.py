"""The crawl frontier as tables: filters, priorities, host queues, politeness and link distance."""

from __future__ import annotations

import math
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestone.functions import urls as U
from lodestone.functions.misc import fold_hash_udf
from lodestone.functions.text import ascii_lower
from lodestone.session import persist_table

DEFAULT_DELAY_MS = 500


def drop_blacklisted(df: DataFrame, blacklist: DataFrame, url_col: str = "url") -> DataFrame:
    """Without URLs whose host is a listed domain or below one.

    Each host is split into its parent domains, so the match is an equi-join whatever the list's size; AQE broadcasts a
    list that is small when measured."""
    h = ascii_lower(U.host(F.col(url_col)))
    labels = F.split("_h", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = df.select(h.alias("_h")).distinct().select("_h", F.explode(parents).alias("_d"))
    bad = hosts.join(blacklist.select(ascii_lower(F.col("domain")).alias("_d")).distinct(), "_d", "left_semi").select("_h").distinct()
    return df.withColumn("_h", h).join(bad, "_h", "left_anti").drop("_h")


def unseen(urls: DataFrame, seen: DataFrame, url_col: str = "url") -> DataFrame:
    """Distinct new URLs, exactly."""
    return urls.dropDuplicates([url_col]).join(seen.select(url_col).distinct(), url_col, "left_anti")


def first_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """Each key's first row; keys in order of first appearance come by sorting on ``order``."""
    return df.groupBy(key).agg(F.min(order).alias(order))


def owner(url: Column, machines: int) -> Column:
    """Which of n machines owns a URL; md5-based, so any engine can check it."""
    return (F.conv(F.substring(F.md5(url), 1, 8), 16, 10).cast("long") % machines).cast("long")


def owner_by_parity(url: Column, machines: int) -> Column:
    """The same by the crawler's own hash, h = 37 h + byte modulo 2**64."""
    return F.pmod(fold_hash_udf()(url).cast("decimal(20,0)"), F.lit(machines)).cast("long")


def route(items: DataFrame, machines: int, url_col: str = "url") -> DataFrame:
    """Items with their owner, each owner's in one partition."""
    return items.withColumn("owner", owner(F.col(url_col), machines)).repartition(machines, "owner")


def frontier(items: DataFrame) -> DataFrame:
    """(url, seed_distance, failed, ...) with its parsed host, suffix, base length, depth and score."""
    h, p = U.frontier_host_path(F.col("url"))
    kind, base = U.suffix_of(h)
    return items.withColumns({"host": h, "suffix": kind, "base_length": base, "frontier_depth": U.frontier_depth(p), "score": U.frontier_score(F.col("url"), F.col("seed_distance"), F.col("failed"))})


def promote(items: DataFrame, share: float = 0.25, chunk: str | None = None) -> DataFrame:
    """The best share of a sweep by score (ties by url), within each chunk, or of everything.

    Without chunks rows are range-partitioned and numbered part by part, so that no task sorts them all."""
    if chunk is None:
        ranked = global_rank(items, [F.desc("score"), F.col("url")])
        return ranked.where(F.col("rank") <= math.ceil(items.count() * share)).drop("rank")
    by = Window.partitionBy(chunk).orderBy(F.desc("score"), "url")
    counted = items.withColumns({"_r": F.row_number().over(by), "_n": F.count("*").over(Window.partitionBy(chunk))})
    return counted.where(F.col("_r") <= F.ceil(F.col("_n") * share)).drop("_r", "_n")


def global_rank(items: DataFrame, order: list[Column]) -> DataFrame:
    """``items`` with a 1-based rank over all rows.

    Without a sort in one task: rows are range-partitioned, numbered inside each part, and shifted by the parts before."""
    parted = items.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    numbered = persist_table(parted.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order))), "ranks")
    sizes = numbered.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    return numbered.join(before, "_p").withColumn("rank", F.col("_i") + F.col("_before")).drop("_p", "_i", "_before")


def rank_seeds(items: DataFrame) -> DataFrame:
    """Seeds (url, score) with a 1-based rank by score, then url."""
    return global_rank(frontier(items).select("url", "score"), [F.desc("score"), F.col("url")])


def host_queue(items: DataFrame, host: str = "host", order: str = "seq") -> DataFrame:
    """Each item's place in its host's first-in-first-out queue; place 1 may be fetched now."""
    return items.withColumn("place", F.row_number().over(Window.partitionBy(host).orderBy(order)).cast("long"))


def ready(items: DataFrame, now: Column, ready_at: str = "ready_at") -> DataFrame:
    """Delayed items whose time has come."""
    return items.where(F.col(ready_at) <= now)


def reserve_times(requests: DataFrame, key: str, at_ms: str, delay_ms: Column | None = None, tie: str | None = None) -> DataFrame:
    """When each request of an origin may go, if all wait their turn: start_i = max(at_i, start_(i-1) + delay).

    Unrolled, start_i = i*d + max over j <= i of (at_j - j*d): one running maximum, no fold."""
    d = delay_ms if delay_ms is not None else F.lit(DEFAULT_DELAY_MS)
    by = Window.partitionBy(key).orderBy(at_ms, *([tie] if tie else []))
    n = requests.withColumn("_i", F.row_number().over(by)).withColumn("_d", d.cast("long"))
    top = F.max(F.col(at_ms) - F.col("_i") * F.col("_d")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return n.withColumn("start_ms", top + F.col("_i") * F.col("_d")).drop("_i", "_d")


def accept_or_delay(requests: DataFrame, key: str, at_ms: str, delay_ms: int = DEFAULT_DELAY_MS) -> DataFrame:
    """Per key the times that are accepted when a request closer than the delay to the last accepted one is turned away."""
    schema = StructType([requests.schema[key], StructField(at_ms, LongType())])

    def run(name: tuple, table: pa.Table) -> pa.Table:
        t = np.sort(table.column(at_ms).to_numpy())
        accepted, at = [], 0
        while at < len(t):
            accepted.append(t[at])
            at = int(np.searchsorted(t, t[at] + delay_ms))
        return pa.table({key: pa.array([name[0].as_py()] * len(accepted), table.column(key).type), at_ms: pa.array(accepted, pa.int64())})

    # a jump an accepted time, over one key's sorted times
    return requests.select(key, F.col(at_ms).cast("long").alias(at_ms)).where(F.col(at_ms).isNotNull()).groupBy(key).applyInArrow(run, schema)


def seed_distances(seeds: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(url, seed_distance): breadth-first distance over (source, target) edges, of all that can be reached, or within ``most`` hops.

    Each round joins only the last round's new URLs with the edges and is cut by a written table."""
    seen = persist_table(seeds.select("url").distinct().withColumn("seed_distance", F.lit(0).cast("long")), "bfs")
    front = seen
    links = edges.select(F.col("source").alias("url"), F.col("target")).distinct()
    for hop in count(1) if most is None else range(1, most + 1):
        step = front.join(links, "url").select(F.col("target").alias("url")).distinct()
        new = persist_table(step.join(seen, "url", "left_anti").withColumn("seed_distance", F.lit(hop).cast("long")), "bfs")
        if not new.head(1):
            break
        seen, front = seen.union(new), new
    return seen


FORBIDDEN = ("cdn", "dns")
SEED_TLDS = ["com", "org", "net", "edu", "gov", "ca", "uk", "au", "co.uk", "com.au"]


def clean_seeds(seeds: DataFrame) -> DataFrame:
    """Seed lines without forbidden parts and with an accepted domain."""
    h = ascii_lower(U.host(F.col("url")))
    ok = h.rlike(r"(^|\.)(" + "|".join(t.replace(".", r"\.") for t in SEED_TLDS) + r")\z")
    for word in FORBIDDEN:
        ok = ok & ~F.contains(ascii_lower(F.col("url")), F.lit(word))
    return seeds.where(ok)


def seed_report(seeds: DataFrame) -> DataFrame:
    """lines, unique and removed."""
    return seeds.agg(F.count("*").alias("lines"), F.count_distinct("url").alias("unique_lines")).withColumn("removed", F.col("lines") - F.col("unique_lines"))
