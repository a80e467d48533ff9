"""The boolean and phrase query language, from text to one DataFrame plan.

Lexer and parser run on the driver and give a small tree. A source is a table of postings
(id, term, locs), as build() writes it sorted by term, or of tokens (id, loc, term). The plan scans only the query's terms (of
postings, the Parquet scan reads only their row groups), aggregates once per (document, source) into a flag a term and a location
array a phrase term, filters by one predicate, unites the sources, joins the precomputed scores and keeps the top k: one
shuffle, no join per term.

Default semantics are the intended ones: a missing term is a false AND group, an unmatched ) is ignored. With
compat=True, terms missing from a source cut the parse short and a stray ) ends the query. In both, a group of
negatives only matches nothing, operators inside quotes drop out, NOT NOT x is x, an open quote runs to the end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.stem import stem
from lodestone.functions.text import LOWER, UPPER
from lodestone.operators import index
from lodestone.sources import io

_FOLD = str.maketrans(UPPER, LOWER)
_SPACE = " \t\n\x0b\f\r"
_OPERATORS = {"or": "OR", "and": "AND", "not": "NOT"}


def _normal(word: str) -> str:
    w = word.translate(_FOLD)
    keep = [i for i, ch in enumerate(w) if ch.isascii() and ch.isalnum()]
    return w[keep[0] : keep[-1] + 1] if keep else ""


def lex(query: str, stemmed: bool = True) -> list[tuple[str, str]]:
    """(kind, text) tokens: WORD, OR, AND, NOT, (, ), QUOTE. A word's first form only; a trailing hyphen ends its word."""
    out: list[tuple[str, str]] = []
    i, n = 0, len(query)
    while i < n:
        c = query[i]
        if c in _SPACE:
            i += 1
        elif c in '()"':
            out.append(("QUOTE" if c == '"' else c, c))
            i += 1
        elif c in "|&":
            i += 2 if query[i + 1 : i + 2] == c else 1
            out.append(("OR" if c == "|" else "AND",) * 2)
        elif c == "-" and (i == 0 or query[i - 1] in _SPACE or query[i - 1] in '("'):
            out.append(("NOT", "NOT"))
            i += 1
        else:
            j = i
            while j < n and query[j] not in _SPACE and query[j] not in '()"|&' and not (query[j] == "-" and (j + 1 == n or query[j + 1] in _SPACE)):
                j += 1
            word = query[i:j]
            i = j + 1 if j < n and query[j] == "-" else max(j, i + 1)
            low = word.translate(_FOLD)
            if low in _OPERATORS:
                out.append((_OPERATORS[low],) * 2)
            elif w := _normal(word):
                out.append(("WORD", stem(w) if stemmed else w))
    return out


@dataclass(frozen=True)
class Term:
    text: str


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]


@dataclass(frozen=True)
class And:
    positive: tuple
    negative: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


Node = Term | Phrase | And | Or


class _Parser:
    def __init__(self, tokens: list[tuple[str, str]], exists: Callable[[str], bool]):
        self.tokens, self.at, self.exists = tokens, 0, exists

    def kind(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else ""

    def either(self) -> Node | None:
        parts = [self.every()]
        while self.kind() == "OR":
            self.at += 1
            parts.append(self.every())
        found = [p for p in parts if p is not None]
        return found[0] if len(found) == 1 else Or(tuple(found)) if found else None

    def every(self) -> Node | None:
        positive: list[Node] = []
        negative: list[Node] = []
        while self.kind() not in ("", "OR", ")"):
            if self.kind() == "AND":
                self.at += 1
                if not self.kind():
                    break
            negated = self.kind() == "NOT"
            if negated:
                self.at += 1
                if not self.kind():
                    break
            node = self.single()
            if node is None:
                if not negated:
                    return None
            else:
                (negative if negated else positive).append(node)
        if not positive:
            return None
        return positive[0] if len(positive) == 1 and not negative else And(tuple(positive), tuple(negative))

    def single(self) -> Node | None:
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "WORD":
            return Term(text) if self.exists(text) else None
        if kind == "(":
            node = self.either()
            if self.kind() == ")":
                self.at += 1
            return node
        if kind == "QUOTE":
            terms = []
            while self.kind() not in ("", "QUOTE"):
                if self.kind() == "WORD":
                    terms.append(self.tokens[self.at][1])
                self.at += 1
            self.at += 1
            if not terms or not all(map(self.exists, terms)):
                return None
            return Term(terms[0]) if len(terms) == 1 else Phrase(tuple(terms))
        return None


def _balanced(tokens: list[tuple[str, str]]) -> list[tuple[str, str]]:
    depth, out = 0, []
    for t in tokens:
        depth += (t[0] == "(") - (t[0] == ")")
        if depth < 0:
            depth = 0
        else:
            out.append(t)
    return out


def parse(tokens: list[tuple[str, str]], exists: Callable[[str], bool] | None = None) -> Node | None:
    """The tree, or None if nothing can match. ``exists`` turns on the compat reading for that vocabulary."""
    return _Parser(tokens if exists else _balanced(tokens), exists or (lambda _: True)).either()


def terms(node: Node | None) -> list[str]:
    """Distinct terms, in order of appearance."""
    if node is None:
        return []
    if isinstance(node, Term):
        return [node.text]
    parts = node.terms if isinstance(node, Phrase) else node.positive + node.negative if isinstance(node, And) else node.parts
    flat = [t for p in parts for t in ([p] if isinstance(p, str) else terms(p))]
    return list(dict.fromkeys(flat))


def _phrase_terms(node: Node) -> set[str]:
    if isinstance(node, Phrase):
        return set(node.terms)
    if isinstance(node, Term):
        return set()
    return set().union(*map(_phrase_terms, node.positive + node.negative if isinstance(node, And) else node.parts))


def _shifted(locations: Column, k: int) -> Column:
    return F.transform(locations, lambda x: x - k)  # one parameter: a second would be the index


def predicate(node: Node, name: dict[str, str]) -> Column:
    """The tree as one Column over has_<term> flags and at_<term> location arrays."""
    if isinstance(node, Term):
        return F.col("has_" + name[node.text])
    if isinstance(node, Phrase):
        common = F.col("at_" + name[node.terms[0]])
        for k, t in enumerate(node.terms[1:], 1):
            common = F.array_intersect(common, _shifted(F.col("at_" + name[t]), k))
        return F.coalesce(F.size(common) > 0, F.lit(False))
    if isinstance(node, Or):
        out = predicate(node.parts[0], name)
        for p in node.parts[1:]:
            out = out | predicate(p, name)
        return out
    out = F.lit(True)
    for p in node.positive:
        out = out & predicate(p, name)
    for p in node.negative:
        out = out & ~predicate(p, name)
    return out


def evaluate(tokens: DataFrame, node: Node | None, id_col: str = "doc_id") -> DataFrame:
    """Distinct ids of the documents of one source (``tokens``: id, loc, term) that match."""
    if node is None:
        return tokens.select(id_col).limit(0)
    wanted = terms(node)
    name = {t: str(i) for i, t in enumerate(wanted)}
    located = _phrase_terms(node)
    aggs = []
    for t in wanted:
        aggs.append(F.max(F.col("term") == t).alias("has_" + name[t]))
        if t in located and "locs" in tokens.columns:
            aggs.append(F.first(F.when(F.col("term") == t, F.col("locs")), ignorenulls=True).alias("at_" + name[t]))
        elif t in located:
            aggs.append(F.collect_list(F.when(F.col("term") == t, F.col("loc"))).alias("at_" + name[t]))
    return tokens.where(F.col("term").isin(wanted)).groupBy(id_col).agg(*aggs).where(predicate(node, name)).select(id_col)


def build(tokens: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Writes a source's postings, sorted by term, and opens them; of tokens, or of postings (term, id, locs)."""
    io.write_chunks(tokens if "locs" in tokens.columns else index.postings(tokens, id_col), path, None, id_col)
    return open_index(tokens.sparkSession, path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """The postings (id, term, locs) that build() or an earlier job wrote; a filter on term reaches the scan."""
    return io.read_postings(spark, path)


def match(sources: list[DataFrame], query: str, id_col: str = "doc_id", compat: bool = False, stemmed: bool = True) -> DataFrame:
    """Ids that match in any source; the whole query is evaluated on each by itself, NOT included."""
    tokens = lex(query, stemmed)
    found = None
    for s in sources:
        exists = None
        if compat:
            words = list({t for k, t in tokens if k == "WORD"})
            there = {r[0] for r in s.where(F.col("term").isin(words)).select("term").distinct().collect()}  # at most the query's terms
            exists = there.__contains__
        part = evaluate(s, parse(tokens, exists), id_col)
        found = part if found is None else found.union(part)
    return found.distinct() if len(sources) > 1 else found


def clamp_k(text: str | None, default: int = 20, most: int = 10000) -> int:
    """k of a request: digits only, at least 1, at most ``most``; ``default`` for all else."""
    return min(most, max(1, int(text))) if text and text.isascii() and text.isdigit() else default


def search(sources: list[DataFrame], scored: DataFrame, query: str, k: int = 20, meta: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """The k best documents that match, by static score, ties by doc_id; metadata is joined after the cut."""
    if not 1 <= k <= 10000:
        raise ValueError("k must be in 1 .. 10000")
    if not query.strip():
        raise ValueError("empty query")
    ids = match(sources, query, compat=compat)
    top = scored.join(ids, "doc_id").select("doc_id", "url", "score").orderBy(F.desc("score"), "doc_id").limit(k)
    if meta is None:
        return top
    return top.join(meta.select("doc_id", "title", "snippet"), "doc_id", "left").orderBy(F.desc("score"), "doc_id")


def merge_top_k(parts: list[DataFrame], k: int) -> DataFrame:
    """The k best of several ranked results."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.desc("score"), "doc_id").limit(k)


def request(sources: list[DataFrame], scored: DataFrame, meta: DataFrame, params: dict[str, str]) -> DataFrame:
    """The answer to a request with parameters q and k, as one JSON text; of a request without a query, the error."""
    spark = scored.sparkSession
    q = params.get("q", "")
    if not q.strip():
        return spark.range(1).select(F.to_json(F.struct(F.lit("missing query").alias("error"))).alias("json"))
    return to_json(search(sources, scored, q, clamp_k(params.get("k")), meta), q)


def to_json(result: DataFrame, query: str) -> DataFrame:
    """One JSON text: query, total_results and results with four-digit scores."""
    rows = result.select(F.struct((-F.col("score")).alias("o"), "doc_id", F.struct("url", "title", "snippet", F.format_number("score", 4).alias("score")).alias("r")).alias("x"))
    agg = rows.agg(F.sort_array(F.collect_list("x")).alias("x"))
    return agg.select(F.to_json(F.struct(F.lit(query).alias("query"), F.size("x").alias("total_results"), F.col("x.r").alias("results"))).alias("json"))
