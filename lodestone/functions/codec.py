"""Variable-byte delta lists: ascending numbers as differences, seven bits a byte, the high bit set but on a number's last byte."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _bytes(v: Column) -> Column:
    """Hex of one number below 2**35."""
    byte = lambda k, more: F.lpad(F.hex(F.shiftright(v, 7 * k).bitwiseAND(F.lit(127)) + F.lit(128 if more else 0)), 2, "0")
    out = F.concat(*[byte(k, True) for k in range(4)], byte(4, False))
    for n in range(3, -1, -1):
        out = F.when(v < 1 << 7 * (n + 1), F.concat(*[byte(k, True) for k in range(n)], byte(n, False))).otherwise(out)
    return out


def encode_deltas(numbers: Column) -> Column:
    """Binary of an ascending array of longs (``numbers``, a plain column) below 2**35; built-ins only, one pass. Empty gives no bytes."""
    deltas = F.transform(numbers, lambda x, i: x - F.coalesce(F.get(numbers, i - 1), F.lit(0)))
    return F.unhex(F.array_join(F.transform(deltas, _bytes), ""))


def decode(data: bytes | None) -> list[int] | None:
    """The numbers of such bytes; an unfinished last number is dropped."""
    if data is None:
        return None
    b = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(b < 128)
    if not len(last):
        return []
    b = b[: last[-1] + 1].astype(np.int64)
    start = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(start, last - start + 1)
    return np.cumsum(np.add.reduceat((b & 127) << 7 * place, start)).tolist()


def decode_deltas():
    """``decode`` in Arrow batches: where a number ends depends on the bytes, which no built-in can follow in one pass."""

    @F.pandas_udf("array<long>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(decode, na_action="ignore")

    return run
