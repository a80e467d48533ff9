"""URL filter: logistic regression on hashed character n-grams of host and path.

Features are the distinct 3-, 4- and 5-byte grams of "^host$" and of "/path$" (scheme, user, port, query and
fragment dropped, ASCII case folded), host and path hashed apart, in 2**16 cells, scaled to length 1. The weights are
fitted on a small labelled table of URLs, a DataFrame (url, blocked) or the list LABELLED of url_labels, by full-batch
gradient descent with momentum and L2; every page is scored, and blocked at p >= 0.5 (a tie is blocked). Of a labelled table at
most MOST_LABELS rows are used, those with the least hash of the URL.

Defined results. A null or empty URL, or one without a host, has no host grams and is scored by the bias and
what path it has; the bias favours keeping. Every row gives one row, whatever its page_id; repeated rows
repeat. Extra columns are carried, ones named like the results replaced. A labelled table with one class only
gives that class for every URL, an empty one keeps all. An empty table of pages gives no rows; a URL of any length is read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import arrays as A
from lodestone.llm.url_labels import LABELLED
from lodestone.session import ship

CELLS = 16
MOST_LABELS = 100_000


def host_and_path(url: pa.Array) -> tuple[pa.Array, pa.Array]:
    """("^host$", "/path$") of each URL, folded; empty where there is none."""
    low = pc.ascii_lower(pc.fill_null(url.cast(pa.string()), ""))
    got = pc.extract_regex(low, r"^\s*(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(?P<host>[^/?#:@]*)(?::[0-9]*)?(?P<path>[^?#]*)")
    host, path = pc.fill_null(pc.struct_field(got, "host"), ""), pc.fill_null(pc.struct_field(got, "path"), "")
    path = pc.if_else(pc.is_null(got), pc.fill_null(pc.struct_field(pc.extract_regex(low, r"^(?P<p>[^?#]*)"), "p"), ""), path)
    host = pc.if_else(pc.equal(host, ""), "", pc.binary_join_element_wise(pa.scalar("^"), host, pa.scalar("$"), ""))
    return host, pc.if_else(pc.equal(path, ""), "", pc.binary_join_element_wise(path, pa.scalar("$"), ""))


def features(url: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of the distinct grams."""
    keys = []
    for field, col in enumerate(host_and_path(url)):
        data, off = A.buffers(col)
        row = np.repeat(np.arange(len(off) - 1), np.diff(off))
        for n in (3, 4, 5):
            at = np.flatnonzero(np.arange(len(data)) + n <= off[1:][row]) if len(data) else np.zeros(0, np.int64)
            cell = A.mix(A.hashes(data, at, at + n), 10 * n + field) >> np.uint64(64 - CELLS)
            keys.append(row[at].astype(np.uint64) << np.uint64(CELLS) | cell)
    both = np.unique(np.concatenate(keys))
    return (both >> np.uint64(CELLS)).astype(np.int64), (both & np.uint64((1 << CELLS) - 1)).astype(np.int64)


def fit(labelled: DataFrame | list[tuple[str, int]] = LABELLED, steps: int = 400, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """(weights, bias). Labels that are null, or neither 0 nor 1, don't count."""
    if isinstance(labelled, DataFrame):
        known = labelled.select(F.col("url").cast("string"), F.col("blocked").cast("int")).where("blocked in (0, 1)")
        labelled = [tuple(r) for r in known.orderBy(F.xxhash64("url"), "url", "blocked").limit(MOST_LABELS).collect()]
    y = np.array([b for _, b in labelled], float)
    row, cell = features(pa.array([u for u, _ in labelled], pa.string()))
    scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))
    w, v = np.zeros(1 << CELLS), np.zeros(1 << CELLS)
    bias = vb = 0.0
    if not len(y) or y.min() == y.max():
        return w.astype(np.float32), (50.0 if len(y) and y[0] else -50.0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(np.bincount(row, w[cell], len(y)) * scale + bias)))
        g = (p - y) / len(y)
        v = 0.9 * v - 10.0 * (np.bincount(cell, (g * scale)[row], 1 << CELLS) + l2 * w)
        vb = 0.9 * vb - 1.0 * g.sum()
        w, bias = w + v, bias + vb
    return w.astype(np.float32), float(bias)


def probabilities(url: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    row, cell = features(url)
    n = len(url)
    z = np.bincount(row, weights[cell], n) / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1)) + bias
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def score(pages: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """``pages`` with p_block and blocked."""
    spark = pages.sparkSession
    ship(spark)
    pages = pages.drop("p_block", "blocked")
    fields = T.StructType([*pages.schema.fields]).add("p_block", "double").add("blocked", "boolean")
    shared = spark.sparkContext.broadcast(weights)  # 2**16 weights, whatever the table

    def run(batches):
        for batch in batches:
            p = probabilities(batch.column("url"), shared.value, bias)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array(p >= 0.5)], names=fields.names)

    return pages.mapInArrow(run, fields)
