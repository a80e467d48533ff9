"""Connected components: vectorised inside a task, and by alternating large and small stars across the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import drop_table, persist_table


def merge_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each the least row of its component) after joining rows i with rows j."""
    while len(i):
        a, b = label[i], label[j]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        live = lo != hi
        if not live.any():
            break
        i, j = i[live], j[live]
        np.minimum.at(label, hi[live], lo[live])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b): root is the least node that it's connected with.

    Every round is two windowed minima, so a hub costs a sort and never a collected list. Rounds grow
    with the logarithm of the longest chain; each is cut by a table in the shared folder.
    Loops (a = a) and nulls are dropped; no edges give no rows."""
    e = edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).where("u <> v")
    e = persist_table(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    by_u = Window.partitionBy("u")
    state = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.min(F.least("u", "v")).over(by_u)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.withColumn("m", F.min("v").over(by_u))
        small = low.select("u", F.col("m").alias("v")).union(low.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        old, e = e, persist_table(small.distinct(), "edges")
        drop_table(old)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        state = now
