"""License scans: Aho-Corasick for identifier tags and notice phrases, shunting-yard for their expressions.

A scan of the whole text finds "SPDX-License-Identifier:" tags and the notices of license_data (ASCII case folded, runs of
white space as one space, commas ignored), whole words at both ends; of notices that begin at one place the longest counts.
Where a notice's licence has versions, one that follows ("version 2", "v2.0", also behind "as published by the Free Software
Foundation; either") joins its name. A tag's expression is the rest of its line, up to a comment end or the next tag; the parser applies WITH, then
AND, then OR, honours parentheses and a trailing "+", and evaluates whether the expression can be satisfied with permissive
licences alone: OR needs one side, AND both, WITH its licence (a single name on both sides, as the SPDX grammar has it).
Each notice is a licence by itself. A document's verdict: "permissive" if all its findings are, "restricted" if any isn't,
"none" without findings.

Defined results. A tag whose expression doesn't parse (empty, unbalanced, two names in a row) counts as the
licence "INVALID", which is restricted; unknown names are restricted. Null and empty texts have no findings.
Findings are distinct and sorted, so repeats and order don't matter. Every row gives one row, whatever its
doc_id; extra columns are carried, ones named like the results replaced. "All rights reserved" is a finding
and restricted. An empty table gives no rows. A text of any length is read whole, in time that grows with it: neither many tags
nor long lines are read twice.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm import arrays as A
from lodestone.llm.license_data import NOTICES, PERMISSIVE
from lodestone.session import ship

TAG = "spdx-license-identifier:"
_BY_FOLD = {x.lower(): x for x in PERMISSIVE}
_BINDS = {"or": 1, "and": 2, "with": 3}
_VERSION = re.compile(rb"(?: as published by the free software foundation)?[;:]? ?(?:either )?(?:version |ver\.? ?|v\.? ?)?([0-9]{1,2}(?:\.[0-9]{1,2})?)(?![0-9a-z])")
_TOKEN = re.compile(r"[()]|[^\s()]+")


def parse(expression: str) -> list[str] | None:
    """The expression in reverse Polish notation, or None if it isn't one."""
    out: list[str] = []
    stack: list[str] = []
    operand = True  # what must come next
    last = ""
    for t in _TOKEN.findall(expression):
        low = t.lower()
        if t == "(":
            if not operand or last == "with":
                return None
            stack.append(t)
        elif t == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif low in _BINDS:
            if operand or (low == "with" and last == ")"):
                return None
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[low]:
                out.append(stack.pop())
            stack.append(low)
            operand, last = True, low
            continue
        else:
            if not operand or not re.fullmatch(r"[A-Za-z0-9.\-:]+\+?", t):
                return None
            out.append(t)
        operand, last = t == "(", low
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(rpn: list[str], permissive: set[str] | None = None) -> bool:
    """Whether permissive licences alone satisfy the expression."""
    known = _BY_FOLD if permissive is None else {x.lower(): x for x in permissive}
    stack: list[bool] = []
    for t in rpn:
        if t in _BINDS:
            b, a = stack.pop(), stack.pop()
            stack.append(a or b if t == "or" else a and b if t == "and" else a)
        else:
            stack.append(t.lower().removesuffix("+") in known)
    return stack[0]


def names(rpn: list[str]) -> list[str]:
    """The licences in an expression, without the exceptions that follow WITH."""
    stack: list[list[str]] = []
    for t in rpn:
        if t in _BINDS:
            b, a = stack.pop(), stack.pop()
            stack.append(a if t == "with" else a + b)
        else:
            stack.append([_BY_FOLD.get(t.lower(), t)])
    return stack[0]


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase, (name, versioned) in NOTICES.items():
        a.add_word(phrase, (len(phrase), name, versioned))
    a.add_word(TAG, (len(TAG), "", False))
    a.make_automaton()
    return a


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def fold(data: np.ndarray, off: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Folded bytes with a newline after each text, where each came from, and the texts' offsets."""
    b = _FOLD[data]
    keep = b != 44
    b, at = b[keep], np.flatnonzero(keep)
    off = np.concatenate([[0], np.cumsum(keep)])[off]
    if len(b):
        space = b == 32
        keep = ~space
        keep[1:] |= ~space[:-1]
        starts = off[:-1][np.diff(off) > 0]
        keep[starts] = True
        b, at = b[keep], at[keep]
        off = np.concatenate([[0], np.cumsum(keep)])[off]
    size = np.diff(off)
    new = np.concatenate([[0], np.cumsum(size + 1)])
    out, origin = np.full(new[-1], 10, np.uint8), np.zeros(new[-1], np.int64)
    inner = A.ragged(new[:-1], size)
    out[inner], origin[inner] = b, at
    return out.tobytes(), origin, new


def findings(col: pa.Array, automaton: ahocorasick.Automaton) -> list[list[tuple[str, list[str], bool]]]:
    """For each text its distinct (expression, licences, permissive), sorted."""
    out: list[list] = []
    for i, j in A.row_blocks(col, 1 << 22):
        data, off = A.buffers(col.slice(i, j - i))
        raw, origin, new = fold(data, off)
        found: list[set] = [set() for _ in range(j - i)]
        ends = np.append(np.flatnonzero((data == 10) | (data == 13)), len(data))  # of lines
        hits: dict[int, tuple[int, str, bool]] = {}
        for end, (size, name, versioned) in automaton.iter(raw.decode("latin-1")):
            begin = end + 1 - size
            whole = not (begin and A.WORD[raw[begin - 1]]) and not (name and A.WORD[raw[end + 1]])
            if whole and hits.get(begin, (-1,))[0] < end:
                hits[begin] = (end, name, versioned)
        tags = np.sort(np.array([*(origin[k] for k, h in hits.items() if not h[1]), len(data)], np.int64))
        for end, name, versioned in hits.values():
            r = int(np.searchsorted(new, end, "right")) - 1
            if name:
                v = _VERSION.match(raw, end + 1) if versioned else None
                if v:
                    name = f"{name}-{v[1].decode()}" + ("" if b"." in v[1] else ".0")
                found[r].add((name, (name,), name in PERMISSIVE))
                continue
            at = int(origin[end]) + 1
            line = min(int(ends[np.searchsorted(ends, at)]), int(off[r + 1]), int(tags[np.searchsorted(tags, at)]))
            text = data[at:line].tobytes().decode("utf-8", "replace")
            expression = re.split(r"\*/|-->|#\}", text, maxsplit=1)[0].strip()
            rpn = parse(expression)
            found[r].add((expression, tuple(sorted(set(names(rpn)))), evaluate(rpn)) if rpn else (expression, ("INVALID",), False))
        out += [sorted(f) for f in found]
    return out


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, with licenses, expressions and verdict."""
    ship(docs.sparkSession)
    docs = docs.drop("licenses", "expressions", "verdict")
    columns = [c for c in docs.columns if c != "text"]
    fields = T.StructType([f for f in docs.schema.fields if f.name != "text"]).add("licenses", T.ArrayType(T.StringType())).add("expressions", T.ArrayType(T.StringType())).add("verdict", "string")

    def run(batches):
        automaton = _automaton()
        for batch in batches:
            found = findings(batch.column("text"), automaton)
            licences = pa.array([sorted({x for _, ls, _ in f for x in ls}) for f in found], pa.list_(pa.string()))
            expressions = pa.array([[e for e, _, _ in f] for f in found], pa.list_(pa.string()))
            verdict = pa.array(["none" if not f else "permissive" if all(ok for _, _, ok in f) else "restricted" for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), licences, expressions, verdict], names=fields.names)

    return docs.mapInArrow(run, fields)
