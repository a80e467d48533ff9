"""The Porter stemmer variant of the index: suffix tables in order, first match decides; bytes above 127 are consonants."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import ship

_TABLE_2 = [s.split(">") for s in "ational>ate tional>tion enci>ence anci>ance izer>ize abli>able alli>al entli>ent eli>e ousli>ous ization>ize ation>ate ator>ate alism>al iveness>ive fulness>ful ousness>ous aliti>al iviti>ive biliti>ble".split()]
_TABLE_3 = [s.split(">") for s in "icate>ic ative> alize>al iciti>ic ical>ic ful> ness>".split()]
_TABLE_4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def _shape(w: str) -> str:
    """v or c for each byte; y is a vowel behind a consonant."""
    out: list[str] = []
    for i, ch in enumerate(w):
        out.append("v" if ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c") else "c")
    return "".join(out)


def _measure(w: str) -> int:
    return _shape(w).count("vc")


def _cvc(w: str) -> bool:
    return len(w) >= 3 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _double(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _first_step(w: str) -> str:
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = next((n for e, n in (("eed", 0), ("ed", 2), ("ing", 3)) if w.endswith(e)), None)
    if cut == 0:
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif cut and "v" in _shape(w[:-cut]):
        w = w[:-cut]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    return w[:-1] + "i" if w.endswith("y") and "v" in _shape(w[:-1]) else w


def _replace(w: str, table: list[list[str]]) -> str:
    for suffix, new in table:
        if w.endswith(suffix):
            root = w[: -len(suffix)]
            return root + new if _measure(root) > 0 else w
    return w


def _stem_bytes(w: str) -> str:
    if len(w) <= 2:
        return w
    w = _first_step(w)
    if len(w) <= 2:
        return w
    w = _replace(_replace(w, _TABLE_2), _TABLE_3)
    suffix = next((s for s in _TABLE_4 if w.endswith(s)), None)
    if suffix:
        if _measure(w[: -len(suffix)]) > 1:
            w = w[: -len(suffix)]
    elif w.endswith("ion") and w[-4:-3] in ("s", "t") and _measure(w[:-3]) > 1:
        w = w[:-3]
    m = _measure(w[:-1])
    if w.endswith("e") and (m > 1 or (m == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stem(word: str) -> str:
    """The stem of a normalised word. Lengths count UTF-8 bytes."""
    return _stem_bytes(word.encode().decode("latin-1")).encode("latin-1").decode("utf-8", "replace")


def stem_udf():
    """Arrow-batched stemmer; use it on distinct words, for it keeps none in mind."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda w: None if w is None else stem(w))

    return run


def with_stems(tokens: DataFrame, column: str = "form") -> DataFrame:
    """``tokens`` with a column stem. Only the distinct words reach Python; the rest is an equi-join that AQE may broadcast."""
    ship(tokens.sparkSession)
    vocabulary = tokens.select(column).where(F.col(column).isNotNull()).distinct()
    return tokens.join(vocabulary.withColumn("stem", stem_udf()(F.col(column))), column, "left")
