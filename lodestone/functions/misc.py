"""Small stand-alone functions: parity hash, integer expressions, best subsequence."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold_hash(word: str | None) -> int | None:
    """h = 37 h + byte (bytes signed), modulo 2**64; 0 for the empty string."""
    if word is None:
        return None
    h = 0
    for b in word.encode():
        h = (h * 37 + (b - 256 if b > 127 else b)) % (1 << 64)
    return h


def fold_hash_udf():
    """``fold_hash`` in Arrow batches, as an unsigned decimal string; arithmetic that wraps has no ANSI built-in."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda w: None if w is None else str(fold_hash(w)))

    return run


_TOKEN = re.compile(r"\d+|[-+*/()]")


def evaluate(text: str) -> int:
    """An integer expression of + - * / and parentheses; unary minus; division truncates; all else is ignored."""
    tokens = _TOKEN.findall(text)
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def factor() -> int:
        t = peek()
        if t == "-":
            take()
            return -factor()
        if t == "(":
            take()
            v = total()
            if peek() == ")":
                take()
            return v
        if t.isdigit():
            return int(take())
        raise ValueError(f"no number at {t!r}")

    def term() -> int:
        v = factor()
        while peek() in ("*", "/"):
            if take() == "*":
                v *= factor()
            else:
                d = factor()
                if d == 0:
                    raise ZeroDivisionError(text)
                v = abs(v) // abs(d) * (1 if (v < 0) == (d < 0) else -1)
        return v

    def total() -> int:
        v = term()
        while peek() in ("+", "-"):
            v = v + term() if take() == "+" else v - term()
        return v

    return total()


def best_run(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Per key the contiguous run with the greatest sum: shortest, then leftmost on ties.

    Prefix sums and a running minimum, in two windows over one sort."""
    by = Window.partitionBy(*keys).orderBy(*order)
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    n = df.select(*keys, *order, F.row_number().over(by).cast("long").alias("_i"), F.sum(value).over(so_far).alias("_p"))
    # the latest start among the least prefixes gives the shortest run
    start = n.withColumn("_lo", F.max(F.struct((-F.col("_p")).alias("neg"), F.col("_i").alias("i"))).over(before))
    low = F.greatest(F.coalesce(F.col("_lo"), F.struct(F.lit(0).cast(df.schema[value].dataType).alias("neg"), F.lit(0).cast("long").alias("i"))), F.struct(F.lit(0).cast(df.schema[value].dataType).alias("neg"), F.lit(0).cast("long").alias("i")))
    runs = start.withColumn("_lo", low).select(*keys, (F.col("_p") + F.col("_lo.neg")).alias("best_sum"), (F.col("_lo.i") + 1).alias("first"), F.col("_i").alias("last"))
    ranked = runs.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("best_sum"), F.col("last") - F.col("first"), "first")))
    return ranked.where("_r = 1").drop("_r")


def best_run_array(values: Column) -> Column:
    """The greatest sum of a contiguous run of an array of doubles (null if empty)."""
    zero = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0.0).alias("here"))

    def step(acc: Column, x: Column) -> Column:
        here = F.greatest(acc["here"], F.lit(0.0)) + x
        return F.struct(F.greatest(acc["best"], here).alias("best"), here.alias("here"))

    return F.aggregate(values, zero, step, lambda acc: acc["best"])


def harness_summary(results: DataFrame, seconds: float) -> DataFrame:
    """(multiplier, urls, per_second, place, best, average_per_second) of a throughput harness (multiplier, urls): place 1 is the best; ties by multiplier."""
    every = Window.partitionBy(F.lit(0))  # one row a setting, some hundreds at most
    place = F.row_number().over(every.orderBy(F.desc("urls"), "multiplier"))
    return results.select("multiplier", "urls", (F.col("urls") / seconds).alias("per_second"), place.cast("long").alias("place"), (place == 1).alias("best"), (F.avg("urls").over(every) / seconds).alias("average_per_second"))
