"""Bounded samples by least hash that move about twice the sample, whatever the table.

A plain top-k sends k rows of every partition to one task. Here rows above a hash, at which about 2k rows lie
below, are dropped where they are read; the k least are the same ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def below(hashed: Column, k: int, n: int) -> Column:
    """Whether a 64-bit hash is among the least 2k of about n; true for all where n is small."""
    if n <= 4 * k:
        return F.lit(True)
    return hashed < int((1 << 64) * 2 * k // n) - (1 << 63)
