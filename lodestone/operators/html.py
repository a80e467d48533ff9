"""HTML to words, title, links and page signals, in Arrow batches.

One pass over the bytes. Recognised tags break words and are dropped, unknown ones are text; entities
stay as they are; script, style and svg are skipped up to their close. Words before a tag are filed under the
state before it. Defined: null and empty pages have empty lists and no signal set.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.session import bound_batches, ship

_PLAIN = """!doctype abbr acronym address applet area article aside audio b basefont bdi bdo bgsound big blink blockquote body br
button canvas caption center cite code col colgroup content data datalist dd del details dfn dialog dir div dl dt em fieldset
figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins isindex
kbd keygen label legend li link listing main map mark marquee menu menuitem meta meter nav nobr noframes noscript object ol
optgroup option output p param picture plaintext pre progress q rp rt rtc ruby s samp section select shadow slot small source
spacer span strike strong sub summary sup table tbody td template textarea tfoot th thead time tr track tt u ul var video wbr xmp"""
TAGS = dict.fromkeys((t.encode() for t in _PLAIN.split()), "plain") | {b"script": "skip", b"style": "skip", b"svg": "skip", b"title": "title", b"a": "anchor", b"base": "base", b"embed": "embed"}
_NAME_END = re.compile(rb"[ \t\n\x0b\f\r>/]")
_CLOSE = {n: re.compile(rb"</" + n + rb"[ \t\n\x0b\f\r]*>", re.I) for n, kind in TAGS.items() if kind == "skip"}
_WHITE = b" \t\n\x0b\f\r"
_QUOTE_OR_END, _RESET = re.compile(rb"[\"'>]"), re.compile(rb"[ \t\n\x0b\f\r=>]")

PARSED = T.StructType().add("words", T.ArrayType(T.StringType())).add("title_words", T.ArrayType(T.StringType())).add("links", T.ArrayType(T.StructType().add("url", "string").add("anchor", T.ArrayType(T.StringType())))).add("base", "string").add("html_lang", "string").add("saw_body", "boolean").add("saw_close_html", "boolean").add("truncated", "boolean").add("open_discard", "boolean")


def _tag_close(h: bytes, at: int) -> int:
    """Where the tag's > stands; quotes hide one, a stray quote right behind a closing one doesn't open."""
    j = h.find(b">", at)
    if j < 0:
        return -1
    if b'"' not in h[at:j] and b"'" not in h[at:j]:
        return j
    p, fresh = at, -1  # fresh: right behind a closing quote, where it ended
    while m := _QUOTE_OR_END.search(h, p):
        p = m.start()
        if h[p] == 62:
            return p
        if fresh >= 0 and not _RESET.search(h, fresh, p):
            p = fresh = p + 1
            continue
        end = h.find(h[p : p + 1], p + 1)
        if end < 0:
            return -1
        p = fresh = end + 1
    return -1


def attribute(attrs: bytes, name: bytes) -> bytes:
    """The first usable value of ``name`` in a tag's inside, found as a substring."""
    low, p = attrs.lower(), -1
    while True:
        p = low.find(name, p + 1)
        if p < 0 or p + len(name) >= len(attrs):
            return b""
        rest = attrs[p + len(name) :].lstrip(_WHITE)
        if not rest.startswith(b"="):
            continue
        rest = rest[1:].lstrip(_WHITE)
        if not rest:
            return b""
        if rest[:1] not in (b'"', b"'"):
            return b"" if rest[:1] == b"<" else re.match(rb"[^ \t\n\x0b\f\r><]*", rest)[0]
        end = rest.find(rest[:1], 1)
        if end > 0:
            return rest[1:end]


class Page:
    def __init__(self, html: bytes):
        self.words: list[bytes] = []
        self.title: list[bytes] = []
        self.links: list[tuple[bytes, list[bytes]]] = []
        self.base = self.lang = b""
        self.saw_body = self.saw_close = self.open_discard = False
        self.truncated = html.rfind(b"<") > html.rfind(b">")
        self._in_title, self._anchor = False, None
        self._parse(html)

    def _file(self, text: bytes) -> None:
        found = text.split()
        (self.title if self._in_title else self.words).extend(found)
        if self._anchor is not None:
            self._anchor.extend(found)

    def _parse(self, h: bytes) -> None:
        begin = p = 0
        while True:
            p = h.find(b"<", p)
            if p < 0:
                break
            closing = h[p + 1 : p + 2] == b"/"
            at = p + 1 + closing
            m = _NAME_END.search(h, at, at + 12)
            end = m.start() if m else min(len(h), at + 12)
            name = h[at:end].lower()
            if name.startswith(b"!--"):
                self._file(h[begin:p])
                j = h.find(b"-->", p + 4)
                begin = p = len(h) if j < 0 else j + 3
                continue
            kind = TAGS.get(name)
            close = _tag_close(h, end) if kind else -1
            if close < 0:
                p += 1
                continue
            self._file(h[begin:p])
            begin = p = close + 1
            alone = h[close - 1 : close] == b"/"
            if kind == "skip":
                if not closing and not alone:
                    m = _CLOSE[name].search(h, p)
                    if not m:
                        self.open_discard = True
                        return
                    begin = p = m.end()
            elif kind == "title":
                self._in_title = not closing and (self._in_title or not alone)
            elif kind == "anchor":
                if closing:
                    self._anchor = None
                elif href := attribute(h[end:close], b"href"):
                    self.links.append((href, []))
                    self._anchor = None if alone else self.links[-1][1]
            elif kind == "base":
                self.base = self.base or attribute(h[end:close], b"href")
            elif kind == "embed":
                if src := attribute(h[end:close], b"src"):
                    self.links.append((src, []))
            elif name == b"body":
                self.saw_body |= not closing
            elif name == b"html":
                if closing:
                    self.saw_close = True
                else:
                    self.lang = self.lang or attribute(h[end:close], b"lang")
        self._file(h[begin:])


def _text(b: bytes) -> str:
    return b.decode("utf-8", "replace")


#: Bytes of HTML that are parsed before their rows are handed on, unless one page is larger: a word takes some hundred bytes as Python objects.
SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose values of a column of texts or bytes have about ``most`` bytes, or one row."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    part = (np.cumsum(size) - size) // most
    at = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(at, [*at[1:], len(size)], strict=True):
        yield batch.slice(int(a), int(b - a))


def parse_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without the HTML, with the fields of PARSED."""
    ship(pages.sparkSession)
    bound_batches(pages.sparkSession)
    keep = [f for f in pages.schema.fields if f.name != html_col and f.name not in PARSED.names]
    fields = T.StructType([*keep, *PARSED.fields])
    words = pa.list_(pa.string())
    links = pa.list_(pa.struct([("url", pa.string()), ("anchor", words)]))

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, html_col)):
            found = [Page((x or "").encode() if not isinstance(x, bytes) else x) for x in batch.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(f.name) for f in keep),
                    pa.array([[_text(w) for w in d.words] for d in found], words),
                    pa.array([[_text(w) for w in d.title] for d in found], words),
                    pa.array([[{"url": _text(u), "anchor": [_text(w) for w in ws]} for u, ws in d.links] for d in found], links),
                    pa.array([_text(d.base) for d in found]),
                    pa.array([_text(d.lang) for d in found]),
                    *(pa.array([getattr(d, a) for d in found]) for a in ("saw_body", "saw_close", "truncated", "open_discard")),
                ],
                names=fields.names,
            )

    return pages.select(*[f"`{f.name}`" for f in keep], f"`{html_col}`").mapInArrow(run, fields)


def is_broken():
    """Two or more of: open skipped section, fewer than 20 words, no body tag, no closing html tag, cut inside a tag."""
    signals = [F.col("open_discard"), F.size("words") < 20, ~F.col("saw_body"), ~F.col("saw_close_html"), F.col("truncated")]
    return sum((s.cast("int") for s in signals[1:]), signals[0].cast("int")) >= 2


def document_url(source, base):
    return F.coalesce(F.nullif(source, F.lit("")), base)
