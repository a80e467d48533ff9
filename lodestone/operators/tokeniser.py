"""Postings of texts in Arrow batches: a document's words are told apart, counted and located without a row a token.

The same words, forms and locations as raw_tokens gives; only a batch's distinct words are looked at one by one."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import LOWER, UPPER
from lodestone.operators.html import slices
from lodestone.session import bound_batches, ship

SLICE_BYTES = 1 << 22
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_OTHER = bytes(b for b in range(256) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123))


def forms(word: bytes) -> list[bytes]:
    """word_forms of one raw word in UTF-8."""
    w = word.translate(_FOLD).strip(_OTHER)
    at = w.find(b"-")
    return [f for f in (w, w[:at], w[at + 1 :]) if f] if 0 < at < len(w) - 1 else [w] if w else []


def located(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(forms, and for each token in order of text, form and location: the text's number, the form's, the location)."""
    words, sizes = [], []
    for t in texts:
        ws = t.split() if t else []  # of bytes: the six ASCII white-space characters
        words += ws
        sizes.append(len(ws))
    coded = pa.array(words, pa.binary()).dictionary_encode()
    index = coded.indices.to_numpy()
    number: dict[bytes, int] = {}
    form = [[number.setdefault(f, len(number)) for f in forms(w)] for w in coded.dictionary.to_pylist()]
    doc = np.repeat(np.arange(len(texts)), sizes)
    loc = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes) if words else np.zeros(0, np.int64)
    parts = []
    for k in range(3):
        code = np.array([f[k] if len(f) > k else -1 for f in form], np.int64)[index] if words else np.zeros(0, np.int64)
        some = np.flatnonzero(code >= 0)
        parts.append((doc[some], code[some], loc[some]))
    doc, code, loc = (np.concatenate(p) for p in zip(*parts, strict=True))
    width, long = max(1, len(number)), int(loc.max(initial=0)) + 1
    key = np.sort((doc * width + code) * long + loc)
    rest = key // long
    return list(number), rest // width, rest % width, key % long


def _rows(docs: DataFrame, id_col: str, text_col: str, distinct: bool) -> DataFrame:
    """(term, id, locs, n) of each row by itself."""
    ship(docs.sparkSession)
    bound_batches(docs.sparkSession)
    ids = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "text", SLICE_BYTES)):
            names, doc, code, loc = located(batch.column("text").cast(pa.binary()).to_pylist())
            begins = np.flatnonzero(np.diff(doc * (len(names) + 1) + code, prepend=-1))
            n = np.diff(begins, append=len(doc))
            if distinct:
                own = np.ones(len(doc), bool)
                own[1:] = (np.diff(doc) != 0) | (np.diff(code) != 0) | (np.diff(loc) != 0)
                kept = np.cumsum(own)
                offsets = np.append(kept[begins] - 1, kept[-1] if len(kept) else 0)
                loc = loc[own]
            else:
                offsets = np.append(begins, len(doc))
            terms = pa.array(names, pa.binary()).cast(pa.string()).take(pa.array(code[begins]))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(loc))
            yield pa.RecordBatch.from_arrays([terms, batch.column("id").take(pa.array(doc[begins])), lists, pa.array(n)], names=["term", "id", "locs", "n"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return rows.mapInArrow(run, f"term string, id {ids}, locs array<long>, n long")


def text_postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distinct: bool = True) -> DataFrame:
    """(term, id, locs, n): ascending locations, each once or as often as it has the term, and how many there are with repeats.

    A document is whole in its row, so nothing is shuffled; only where an id has several rows are theirs united."""
    rows = _rows(docs, id_col, text_col, distinct)
    if not docs.groupBy(id_col).count().where("count > 1").isEmpty():
        every = F.flatten(F.collect_list("locs"))
        rows = rows.groupBy("term", "id").agg(F.sort_array(F.array_distinct(every) if distinct else every).alias("locs"), F.sum("n").alias("n"))
    return rows.select("term", F.col("id").alias(id_col), "locs", "n")


class _List:
    """One term's list as it streams by: counts, its first entry, and the hash of all entries so far."""

    def __init__(self, doc, loc: int):
        self.df = self.cf = 0
        self.doc, self.loc, self.hash = doc, loc, None

    def add(self, df: int, cf: int, entries: bytes | None) -> None:
        self.df += df
        self.cf += cf
        if entries is not None:
            if self.hash is None:
                self.hash = hashlib.md5(entries, usedforsecurity=False)
            else:
                self.hash.update(b"," + entries)


def _entries(batch: pa.RecordBatch, begins: np.ndarray) -> list[bytes | None]:
    """For the rows from each begin to the next: their entries id:location with commas between; those of null ids have none."""
    locs = batch.column("locs")
    name = batch.column("name").take(pc.list_parent_indices(locs))
    entry = pc.binary_join_element_wise(name, locs.flatten().cast(pa.string()), ":")
    some = np.append(0, np.cumsum(np.asarray(entry.is_valid())))
    ends = np.append(0, np.cumsum(np.asarray(pc.list_value_length(locs))))
    offsets = some[ends[np.append(begins, batch.num_rows)]]
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), entry.drop_null()), ",")
    return [x if b > a else None for a, b, x in zip(offsets[:-1], offsets[1:], joined.cast(pa.binary()).to_pylist(), strict=True)]


def list_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, df, cf, first_doc, first_loc, list_md5): the MD5 of a term's whole list id:location,id:location... in order.

    Rows are a term and document, sorted by Spark, which may spill; a list is hashed as it streams by and never held. Null ids come last:
    they count in cf only, and a term with no other has a null MD5."""
    rows = text_postings(docs, id_col, text_col, distinct=False).select("term", F.col(id_col).alias("id"), F.col("locs").cast("array<int>").alias("locs"))
    ids = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        term, now, kind = None, None, None

        def out(done):
            ts, ls = [t for t, _ in done], [x for _, x in done]
            columns = [pa.array(ts, pa.string()), *(pa.array([getattr(x, a) for x in ls], pa.int64()) for a in ("df", "cf")), pa.array([x.doc for x in ls], kind), pa.array([x.loc for x in ls], pa.int64()), pa.array([x.hash and x.hash.hexdigest() for x in ls], pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["term", "df", "cf", "first_doc", "first_loc", "list_md5"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kind, terms, locs = batch.schema.field("id").type, batch.column("term"), batch.column("locs")
            begins = np.append(0, 1 + np.flatnonzero(np.asarray(pc.not_equal(terms.slice(1), terms.slice(0, len(terms) - 1))))).astype(np.int64)
            df = np.add.reduceat(np.asarray(batch.column("id").is_valid()).astype(np.int64), begins)
            cf = np.add.reduceat(np.asarray(pc.list_value_length(locs)).astype(np.int64), begins)
            at = pa.array(begins)
            firsts = zip(terms.take(at).to_pylist(), batch.column("id").take(at).to_pylist(), pc.list_element(locs.take(at), 0).to_pylist(), strict=True)
            done = []
            for (t, doc, loc), d, c, entries in zip(firsts, df, cf, _entries(batch, begins), strict=True):
                if now is None or t != term:
                    if now is not None:
                        done.append((term, now))
                    term, now = t, _List(doc, loc)
                now.add(int(d), int(c), entries)
            if done:
                yield out(done)
        if now is not None:
            yield out([(term, now)])

    ordered = rows.repartition("term").sortWithinPartitions("term", F.col("id").asc_nulls_last())
    ordered = ordered.select("*", F.col("id").cast("string").alias("name"))  # not shuffled
    return ordered.mapInArrow(run, f"term string, df long, cf long, first_doc {ids}, first_loc long, list_md5 string")
