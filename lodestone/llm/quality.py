"""Quality classifier: ordinal cumulative-link (proportional odds) regression on graded ratings.

Grades 0 < 1 < ... < K-1 share one weight vector w over hashed text features and have ordered thresholds
t_1 < ... < t_{K-1}:   P(grade >= k | x) = sigmoid(w.x - t_k).   Both are fitted together by maximum
likelihood (L2 on w) with L-BFGS; thresholds are kept ordered by fitting the logarithms of their gaps. The
tail probability P(grade >= k) selects documents, the expected grade sum_k P(grade >= k) ranks them.

Features are, of the whole text, the distinct hashed words, the distinct beginnings (PREFIXES
bytes) of longer words, the distinct shapes of its tokens' last three bytes (letters, capitals, digits; other
bytes stand for themselves), and which share of its words repeat the word before (in powers of two), in
2**22 cells; x is 1 for each cell that a text has. Only cells of three training texts or more whose
chi-square against the grades exceeds CHI2 get a weight: without that screen, the mass of rare words drowns the few telling ones.

Training reads at most ``most_per_grade`` labelled documents of each grade, those with the least hash of
doc_id: a documented bound on the sample, not on the data scored. Scoring covers every document whole.

Defined results. Null, empty and token-less texts have no features and score by the thresholds alone;
they are kept iff that prior is. Rows with null doc_id are scored like any other. Labels with a null in
doc_id or rating are ignored, contradicting labels of one doc_id are all used. With fewer than two
grades among the labels there is nothing to learn: every document gets that grade (0 without labels)
with certainty. Extra columns are carried, never read. Ties need no rule: every row is scored by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import arrays as A
from lodestone.session import ship

DIM_BITS = 22
MOST_PER_GRADE = 4000
CHI2 = 25.0
PREFIXES = (4, 6, 8)
_SHAPE = np.arange(256, dtype=np.uint64)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = 65, 97, 48, 97


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of the distinct features of each text, sorted."""
    data, off = A.buffers(col)
    row, s, e = A.spans(data, off, A.WORD)
    cell = A.hashes(data, s, e, A.FOLDED) >> np.uint64(64 - DIM_BITS)
    trow, ts, te = A.spans(data, off, A.GRAPH)
    shape = np.zeros(len(ts), np.uint64)
    for back in (3, 2, 1):
        at = te - back
        shape = shape * np.uint64(257) + np.where(at >= ts, _SHAPE[data[np.maximum(at, 0)]] + np.uint64(1), np.uint64(0)) if len(ts) else shape
    keys = [(row, cell), (trow, A.mix(shape, 3) >> np.uint64(64 - DIM_BITS))]
    for size in PREFIXES:
        longer = e - s > size
        at = s[longer]
        keys.append((row[longer], A.mix(A.hashes(data, at, at + size, A.FOLDED), size) >> np.uint64(64 - DIM_BITS)))
    n = len(off) - 1
    if len(row) > 1:
        again = np.bincount(row[1:], (cell[1:] == cell[:-1]) & (row[1:] == row[:-1]), n)
        share = again / np.maximum(np.bincount(row, minlength=n), 1)
        level = np.where(share > 0, np.maximum(np.floor(np.log2(np.maximum(share, 1e-9))), -8) + 9, 0).astype(np.uint64)
        keys.append((np.arange(n), A.mix(level, 11) >> np.uint64(64 - DIM_BITS)))
    both = np.concatenate([r.astype(np.uint64) << np.uint64(DIM_BITS) | c for r, c in keys])
    both.sort()
    if len(both):
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    return (both >> np.uint64(DIM_BITS)).astype(np.int64), (both & np.uint64((1 << DIM_BITS) - 1)).astype(np.int64)


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def shared(self, spark: SparkSession):
        """A broadcast of the cells that have a weight: far fewer than 2**22, whatever the corpus."""
        used = np.flatnonzero(self.weights).astype(np.int32)
        return spark.sparkContext.broadcast((used, self.weights[used], self.thresholds))

    @staticmethod
    def of(used: np.ndarray, values: np.ndarray, thresholds: np.ndarray) -> OrdinalModel:
        weights = np.zeros(1 << DIM_BITS, np.float32)
        weights[used] = values
        return OrdinalModel(weights, thresholds)

    def tails(self, col: pa.Array) -> np.ndarray:
        """P(grade >= k), k = 1 .. K-1, for each text."""
        n = len(col)
        score = np.zeros(n)
        for i, j in A.row_blocks(col):
            row, cell = features(col.slice(i, j - i))
            score[i:j] = np.bincount(row, self.weights[cell], j - i)
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -50, 50)))


def blocks_of_features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``features`` of a whole column, as 32-bit numbers."""
    rows, cells = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for i, j in A.row_blocks(col):
        r, c = features(col.slice(i, j - i))
        rows.append((r + i).astype(np.int32))
        cells.append(c.astype(np.int32))
    return np.concatenate(rows), np.concatenate(cells)


def fit(texts: pa.Array, grades: np.ndarray, steps: int = 60, l2: float = 1e-4) -> OrdinalModel:
    return fit_cells(*blocks_of_features(texts), grades, steps, l2)


def fit_cells(rows: np.ndarray, cells: np.ndarray, grades: np.ndarray, steps: int = 60, l2: float = 1e-4) -> OrdinalModel:
    """Maximum likelihood by L-BFGS over each row's cells; deterministic."""
    kinds = np.unique(grades)
    top = int(kinds[-1]) if len(kinds) else 0
    if len(kinds) < 2:
        return OrdinalModel(np.zeros(1 << DIM_BITS, np.float32), np.full(top, -np.inf))
    y = np.asarray(grades, np.int64)
    seen = np.bincount(cells, minlength=1 << DIM_BITS)
    often = np.flatnonzero(seen >= 3)
    seen = seen[often].astype(np.float64)
    strength = np.zeros(len(often))
    for g in kinds[1:]:
        high = y >= g
        a = np.bincount(cells[high[rows]], minlength=1 << DIM_BITS)[often]
        share = high.mean()
        strength = np.maximum(strength, (a - seen * share) ** 2 / np.maximum(seen * share * (1 - share) * (1 - seen / len(y)), 1e-9))
    chosen = np.zeros(1 << DIM_BITS, bool)
    chosen[often[strength > CHI2]] = True
    rows, cells = rows[chosen[cells]], cells[chosen[cells]]
    used, cells = np.unique(cells, return_inverse=True)
    n, k, f = len(y), top, len(used)
    balance = np.full(n, 1 / n)
    at = np.arange(n)

    def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
        w, gap = theta[:f], np.exp(theta[f + 1 :])
        cut = theta[f] + np.concatenate([[0.0], np.cumsum(gap)])
        s = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[cells], n)[:, None] - cut, -35, 35)))
        upper = np.concatenate([np.ones((n, 1)), s], 1)[at, y]
        lower = np.concatenate([s, np.zeros((n, 1))], 1)[at, y]
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p * balance, lower * (1 - lower) / p * balance
        gcut = np.bincount(np.maximum(y - 1, 0), np.where(y > 0, du, 0), k) - np.bincount(np.minimum(y, k - 1), np.where(y < k, dl, 0), k)
        tail = np.cumsum(gcut[::-1])[::-1]
        grad = np.concatenate([np.bincount(cells, (dl - du)[rows], f) + l2 * w, tail[:1], tail[1:] * gap])
        return float(-(balance * np.log(p)).sum() + l2 / 2 * (w @ w)), grad

    theta = np.concatenate([np.zeros(f), [-1.0], np.full(k - 1, np.log(2.0))])
    value, grad = loss(theta)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, alphas = grad.copy(), []
        for ds, dg, rho in reversed(past):
            alphas.append(rho * (ds @ q))
            q -= alphas[-1] * dg
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1e-12, np.abs(grad).sum())
        for (ds, dg, rho), alpha in zip(past, reversed(alphas), strict=True):
            q += ds * (alpha - rho * (dg @ q))
        size, slope = 1.0, -(grad @ q)
        while True:
            new_value, new_grad = loss(theta - size * q)
            if new_value <= value + 1e-4 * size * slope or size < 1e-6:
                break
            size /= 2
        ds, dg = -size * q, new_grad - grad
        if ds @ dg > 1e-12:
            past = [*past[-7:], (ds, dg, 1 / (ds @ dg))]
        done = value - new_value < 1e-6 * max(1e-3, value)
        theta, value, grad = theta + ds, new_value, new_grad
        if done:
            break
    weights = np.zeros(1 << DIM_BITS, np.float32)
    weights[used] = theta[:f]
    return OrdinalModel(weights, theta[f] + np.concatenate([[0.0], np.cumsum(np.exp(theta[f + 1 :]))]))


def training_features(docs: DataFrame, labels: DataFrame, grade: Column, most_per_grade: int = MOST_PER_GRADE, grades: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell) features and grades of the labelled documents that have, in each grade, the least hashes of doc_id.

    Tasks turn texts into cells; the driver gets the cells of the bounded sample only."""
    ship(docs.sparkSession)
    rated = labels.select(F.col("doc_id").cast("long").alias("_id"), grade.cast("int").alias("_grade")).where("_id is not null and _grade is not null")
    picked = None
    for g in range(grades):
        part = rated.where(F.col("_grade") == g).distinct().orderBy(F.xxhash64("_id"), "_id").limit(most_per_grade)
        picked = part if picked is None else picked.union(part)

    def run(batches):
        for batch in batches:
            row, cell = blocks_of_features(batch.column("text"))
            edges = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_id", "_grade", "_key")), pa.ListArray.from_arrays(pa.array(edges), pa.array(cell))], names=["_id", "_grade", "_key", "cells"])

    # the sample is bounded by its parameter, so sending its ids to every task is too
    text = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").where("text is not null").join(F.broadcast(picked), "_id")
    cells = text.select("_id", "_grade", F.xxhash64("text").alias("_key"), "text").mapInArrow(run, "_id long, _grade int, _key long, cells array<int>")
    got = cells.orderBy("_id", "_grade", "_key").toArrow()
    lists = got.column("cells").combine_chunks()
    size = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    return np.repeat(np.arange(len(size), dtype=np.int32), size), lists.flatten().to_numpy(), got.column("_grade").to_numpy()


def train(docs: DataFrame, labels: DataFrame, grade: Column, most_per_grade: int = MOST_PER_GRADE, grades: int = 3) -> OrdinalModel:
    return fit_cells(*training_features(docs, labels, grade, most_per_grade, grades))


def _tail(tails: np.ndarray, grade: int) -> np.ndarray:
    return tails[:, grade - 1] if 0 < grade <= tails.shape[1] else np.full(len(tails), float(grade <= 0))


def score(docs: DataFrame, model: OrdinalModel, select_grade: int, least: float = 0.5) -> DataFrame:
    """``docs`` with expected_grade, p_tail = P(grade >= select_grade) and keep = p_tail >= least (columns of these names are replaced)."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("expected_grade", "p_tail", "keep")
    shared = model.shared(spark)
    fields = T.StructType([*docs.schema.fields]).add("expected_grade", "double").add("p_tail", "double").add("keep", "boolean")

    def run(batches):
        m = OrdinalModel.of(*shared.value)
        for batch in batches:
            tails = m.tails(batch.column("text"))
            p = _tail(tails, select_grade)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tails.sum(1)), pa.array(p), pa.array(p >= least)], names=fields.names)

    return docs.mapInArrow(run, fields)


def select(docs: DataFrame, model: OrdinalModel, select_grade: int, least: float = 0.5) -> DataFrame:
    """The documents with P(grade >= select_grade) >= least; columns as given, whatever their names."""
    spark = docs.sparkSession
    ship(spark)
    shared = model.shared(spark)

    def run(batches):
        m = OrdinalModel.of(*shared.value)
        for batch in batches:
            yield batch.filter(pa.array(_tail(m.tails(batch.column("text")), select_grade) >= least))

    return docs.mapInArrow(run, docs.schema)


SELECT_GRADE, LEAST = 2, 0.6


def rating() -> Column:
    """The grade that the labels table gives, in points: one for quality and one for not being toxic.

    Points add up along the one weighted sum that all thresholds share; a rank such as junk < toxic < clean would ask
    marks of toxicity to speak for a text against junk and against it among clean ones."""
    known = F.col("quality").isin(0, 1) & F.col("toxic").isin(0, 1)
    return F.when(known, F.col("quality") + 1 - F.col("toxic"))
