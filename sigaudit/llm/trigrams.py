"""Boolean trigram queries derived from regular expressions, and a trigram index of a segment of texts.

From the parse tree of a pattern come the strings that any match must contain, as a tree of AND, OR and trigrams. Texts and
trigrams are folded (A-Z as a-z), so that one index serves patterns in either case; folding never loses a match.
"""

from __future__ import annotations

from re import _constants as op
from re import _parser as parser

import numpy as np

from .words import lower_ascii

#: Any match at all: no trigram is mandatory.
ALL = ("all",)
#: Alternatives of exact text that are followed through a pattern before they are cut down to their trigrams.
EXACT = 64


def _fold(code: int) -> str | None:
    return chr(code).lower() if code < 128 else None


def _grams(texts: set[str]) -> tuple:
    """The query of: one of these texts occurs."""
    out = []
    for x in texts:
        parts = {x[i : i + 3] for i in range(len(x) - 2)}
        if not parts:
            return ALL
        out.append(_and([("gram", p) for p in sorted(parts)]))
    return _or(out)


def _and(parts: list[tuple]) -> tuple:
    parts = [p for p in dict.fromkeys(parts) if p != ALL]
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _or(parts: list[tuple]) -> tuple:
    parts = list(dict.fromkeys(parts))
    return ALL if ALL in parts or not parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _texts(items) -> tuple[set[str] | None, tuple]:
    """For a sequence of parse nodes: its exact alternatives (None if not few), and a query that holds for every match."""
    exact: set[str] | None = {""}
    queries: list[tuple] = []

    def broken():
        nonlocal exact
        if exact is not None:
            queries.append(_grams(exact))
        exact = None

    run: set[str] | None = {""}  # exact text since the last break
    for kind, value in items:
        part, query = _node(kind, value)
        if part is not None and run is not None and len(part) * len(run) <= EXACT:
            run = {a + b for a in run for b in part}
            continue
        if run is not None:
            queries.append(_grams(run))
        exact = None
        queries.append(query)
        run = part if part is not None and len(part) <= EXACT else {""}
    if exact is None:
        queries.append(_grams(run))
        return None, _and(queries)
    return run, _grams(run)


def _node(kind, value) -> tuple[set[str] | None, tuple]:
    if kind == op.LITERAL:
        c = _fold(value)
        return ({c}, ALL) if c else (None, ALL)
    if kind == op.SUBPATTERN:
        return _texts(value[3])
    if kind == op.BRANCH:
        exact: set[str] | None = set()
        queries = []
        for branch in value[1]:
            part, query = _texts(branch)
            queries.append(query)
            exact = exact | part if exact is not None and part is not None else None
        return (exact if exact is not None and len(exact) <= EXACT else None), _or(queries)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, body = value
        part, query = _texts(body)
        if part is not None and (low, high) == (0, 1):
            return {""} | part, ALL
        if part is not None and low == high == 1:
            return part, query
        return None, (query if low else ALL)
    if kind == op.IN and all(k == op.LITERAL and v < 128 for k, v in value) and len(value) <= 8:
        return {_fold(v) for _, v in value}, ALL
    if kind == op.AT:
        return {""}, ALL
    return None, ALL


def query_of(pattern: str) -> tuple:
    """The Boolean trigram query of a pattern; ALL if it has no mandatory trigram."""
    return _texts(parser.parse(pattern))[1]


def trigrams_in(query: tuple) -> set[str]:
    return {query[1]} if query[0] == "gram" else set().union(*(trigrams_in(q) for q in query[1:])) if query[0] in ("and", "or") else set()


class Segment:
    """Postings of the wanted trigrams over some texts (bytes raw, row offsets at): per trigram the rows that hold it."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, wanted: list[str]):
        self.rows = len(at) - 1
        base = at - at[0]
        b = lower_ascii(raw[at[0] : at[-1]]).astype(np.int32)
        codes = [int.from_bytes(g.encode(), "big") for g in wanted]
        table = np.zeros(1 << 24, np.uint16) if not hasattr(Segment, "_table") or Segment._wanted != wanted else Segment._table
        if getattr(Segment, "_wanted", None) != wanted:
            for i, c in enumerate(codes):
                table[c] = i + 1
            Segment._table, Segment._wanted = table, wanted
        found = table[(b[:-2] << 16) | (b[1:-1] << 8) | b[2:]] if len(b) > 2 else np.zeros(0, np.uint16)
        where = np.flatnonzero(found)
        row = np.searchsorted(base, where, "right") - 1
        inside = where + 3 <= base[row + 1]  # no trigram crosses from one text to the next
        self.postings = {g: np.zeros(self.rows, bool) for g in wanted}
        which = found[where[inside]]
        for i, g in enumerate(wanted):
            self.postings[g][row[inside][which == i + 1]] = True

    def search(self, query: tuple) -> np.ndarray:
        """Rows that may match: postings intersected for AND, united for OR."""
        if query == ALL:
            return np.ones(self.rows, bool)
        if query[0] == "gram":
            return self.postings[query[1]]
        parts = [self.search(q) for q in query[1:]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)
