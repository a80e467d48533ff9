"""Word normalisation, tokens and text measures as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STOP_WORDS = "the of and to in is for that it was on are as with be at this from or an".split()
_NON_LATIN = r"[\x{0370}-\x{03FF}\x{0400}-\x{052F}\x{0590}-\x{05FF}\x{0600}-\x{06FF}\x{0900}-\x{097F}\x{0E00}-\x{0E7F}\x{1100}-\x{11FF}\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]"
_LATIN = r"[A-Za-z\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{024F}]"
WHITE = r"[ \t\n\x0B\f\r]+"


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c evaluated once: Catalyst has no other binding inside a Column, and repeating a long expression in its users multiplies plans."""
    return F.transform(F.array(c), f)[0]


def ascii_lower(c: Column) -> Column:
    """A-Z folded, nothing else."""
    return F.translate(c, UPPER, LOWER)


def strip_edges(c: Column) -> Column:
    """Without the bytes at both ends that are no ASCII letter or digit."""
    return F.regexp_replace(c, r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")


def normal_word(c: Column) -> Column:
    """The searchable form of a raw word before stemming; empty if nothing is left."""
    return strip_edges(ascii_lower(c))


def word_forms(c: Column) -> Column:
    """Array of the forms that a raw word is indexed under (before stemming): itself and, at its first hyphen, its two parts; none of null."""

    def forms(w: Column) -> Column:
        at = F.instr(w, "-")
        split = F.array(w, F.substring(w, F.lit(1), at - 1), F.substring(w, at + 1, F.length(w)))
        return F.when(w.isNull() | (w == ""), F.array().cast("array<string>")).when((at > 1) & (at < F.length(w)), split).otherwise(F.array(w))

    return let(normal_word(c), forms)


def words(c: Column) -> Column:
    """The runs without ASCII white space, in order."""
    return F.filter(F.split(c, WHITE), lambda w: w != "")


def alnum_runs(c: Column) -> Column:
    """Runs of ASCII letters and digits (the anchor text's tokens)."""
    return F.regexp_extract_all(c, F.lit("([A-Za-z0-9]+)"), 1)


def sanitise(c: Column) -> Column:
    """Control characters, quotes and backslashes become spaces."""
    return F.regexp_replace(c, r"""[\x00-\x1f\x7f"'\\]""", " ")


def single_line(c: Column) -> Column:
    return F.translate(c, "\r\n", "  ")


def latin_letters(c: Column) -> Column:
    return F.regexp_count(c, F.lit(_LATIN)).cast("long")


def alphabet_letters(c: Column) -> Column:
    """Latin letters and those of the other alphabets known."""
    return (F.regexp_count(c, F.lit(_LATIN)) + F.regexp_count(c, F.lit(_NON_LATIN))).cast("long")


def stop_word_count(ws: Column) -> Column:
    """How many of an array of raw words are common English ones."""
    return F.size(F.filter(ws, lambda w: ascii_lower(w).isin(STOP_WORDS))).cast("long")


def is_english(html_lang: Column, body: Column, title: Column, threshold: float = 0.6) -> Column:
    """The declared language decides; else, of 50 words or more, a stop-word share of 3 %; else the Latin share of the letters."""
    lang = ascii_lower(F.coalesce(html_lang, F.lit("")))
    text = F.array_join(F.concat(body, title), " ")
    letters = alphabet_letters(text)
    return (
        F.when(lang != "", (lang == "en") | lang.startswith("en-"))
        .when(F.size(body) >= 50, stop_word_count(body) >= 0.03 * F.size(body))
        .when(letters < 50, F.lit(True))
        .otherwise(latin_letters(text) >= threshold * letters)
    )


def decode_query(c: Column) -> Column:
    """A query-string value: + is a space, %xx a byte; a % without two hex digits stands for itself, broken UTF-8 becomes U+FFFD."""
    whole = F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(whole)


def utf16(c: Column) -> Column:
    """UTF-16 with a byte order mark, also of an empty text, for which the encoder gives none."""
    return F.when(c == "", F.unhex(F.lit("FEFF"))).otherwise(F.encode(c, "UTF-16"))


def from_utf16(b: Column) -> Column:
    return F.decode(b, "UTF-16")


def transcode(data: bytes | None) -> str | None:
    """Text of bytes in UTF-8 or UTF-16: a byte order mark decides, else zero bytes in every second place; malformed parts become U+FFFD."""
    if data is None:
        return None
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    head = data[:64]
    if len(head) >= 4 and len(data) % 2 == 0:
        even, odd = head[0::2].count(0), head[1::2].count(0)
        if odd > len(head) // 4 and not even:
            return data.decode("utf-16-le", "replace")
        if even > len(head) // 4 and not odd:
            return data.decode("utf-16-be", "replace")
    return data.decode("utf-8", "replace")


def transcode_udf():
    """``transcode`` in Arrow batches: Spark's decode refuses malformed bytes instead of repairing them."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(transcode, na_action="ignore")

    return run


def md5_halves(c: Column) -> tuple[Column, Column]:
    """The two 64-bit halves of the MD5, as signed longs."""
    h = F.md5(c)
    return tuple(F.conv(F.substring(h, a, 16), 16, -10).cast("long") for a in (1, 17))


def bloom_size(n: float, p: float) -> tuple[int, int]:
    """(bits, hashes) for n keys at false-positive rate p."""
    import math

    m = math.ceil(-n * math.log(p) / math.log(2) ** 2)
    return m, max(1, round(m / n * math.log(2)))
