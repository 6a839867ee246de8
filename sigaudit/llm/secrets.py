"""Operator 8: secret scan by a trigram index.

Each Arrow batch of texts is a segment with postings of the trigrams that the rules' Boolean queries name; postings are intersected
and united, and only candidate rows are verified by the rule's regular expression. A rule without mandatory trigrams scans fully.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, lean, slices, table, utf8
from .trigrams import Segment, query_of, trigrams_in


@dataclass(frozen=True)
class Rule:
    """Matches of pattern, leftmost and non-overlapping, whose group has at least least characters. finder, if given, finds the same
    matches in its first group, in time that is linear in the text's length."""

    kind: str
    pattern: str
    group: int
    least: int
    flags: int = re.ASCII
    finder: str = ""


#: The base kinds, in the order in which spans at one start are listed (fixed values).
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, re.ASCII | re.IGNORECASE),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Public credential formats that name themselves.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    # a run of token characters is tried once, from its first eyJ: whatever follows the run is the same for the later ones
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1, finder=r"(?<![A-Za-z0-9_-])(?:(?!eyJ)[A-Za-z0-9_-])*+(eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)"),
    Rule("forge", r"(ghp_|gho_|ghs_|github_pat_|glpat-)[A-Za-z0-9_-]{20,}", 0, 1),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}", 0, 1),
)
RULES = BASE + MORE


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.pattern, r.flags), query_of(r.pattern)) for r in rules]
        self.wanted = sorted(set().union(*(trigrams_in(q) for _, _, q in self.rules)))
        # a run of one class needs no shorter matches: they would be dropped
        self.plain = {r.kind: re.compile(r.finder, r.flags) for r in rules if r.finder}
        self.plain |= {r.kind: re.compile(r.pattern[:-1] + "{%d,}" % r.least, r.flags) for r in rules if re.fullmatch(r"\[[^\]]*\]\+", r.pattern) and r.group == 0}

    def spans(self, texts: list[str], raw: np.ndarray, at: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """Per text its (start, rule number, end), in code points and in order."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        segment = Segment(raw, at, self.wanted)
        for i, (rule, pattern, query) in enumerate(self.rules):
            finder, span = self.plain.get(rule.kind, pattern), int(bool(rule.finder))
            for row in np.flatnonzero(segment.search(query)).tolist():
                for m in finder.finditer(texts[row]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[row].append((m.start(span), i, m.end(span)))
        return [sorted(x) for x in out]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row doc_id, text and spans: array of (kind, start, end), code points, end exclusive, by start and then by rule.

    Null and empty texts have no spans. Each row is scanned by itself, repeated rows alike. An empty table gives no rows. Other
    columns, whatever their names, are not read.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            raw, at = utf8(batch.column(1))
            for lo, hi in slices(at):
                part = batch.slice(lo, hi - lo)
                texts = [x or "" for x in part.column(1).to_pylist()]
                found = [[{"kind": rules[i].kind, "start": s, "end": e} for s, i, e in x] for x in scanner.spans(texts, raw, at[lo : hi + 1])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, kind)], ["doc_id", "text", "spans"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id bigint, text string, spans array<struct<kind string, start int, end int>>")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every span of text replaced by its kind in square brackets and n_chars counted anew; overlapping spans are one, named
    by the first. All columns of docs are kept; the rows are handled one by one, so that nothing is shuffled."""
    bound_batches(docs.sparkSession)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            column = batch.schema.get_field_index("text")
            raw, at = utf8(batch.column(column))
            done: list[str | None] = []
            for lo, hi in slices(at):
                texts = batch.column(column).slice(lo, hi - lo).to_pylist()
                for text, spans in zip(texts, scanner.spans([x or "" for x in texts], raw, at[lo : hi + 1]), strict=True):
                    out, end = [], 0
                    for s, i, e in spans:
                        if s >= end:
                            out += [text[end:s], f"[{rules[i].kind}]"]
                        end = max(end, e)
                    done.append("".join([*out, text[end:]]) if spans else text)
            columns = list(batch.columns)
            columns[column] = pa.array(done, batch.schema.field(column).type)
            n = batch.schema.get_field_index("n_chars")
            if n >= 0:
                columns[n] = pa.array([None if x is None else len(x) for x in done], batch.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(lean(run), schema)


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    one = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    base = F.filter("spans", lambda x: x["kind"].isin([r.kind for r in BASE]))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    digest = F.sha2(F.concat_ws(",", F.transform(base, one)).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *(count(r.kind) for r in BASE), digest, F.concat_ws(",", F.transform("spans", one)).alias("spans"))


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


def rules_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL of the query for rules whose spans are whole matches. A text's matches are set off by two control characters (spaces
    where the text has those itself), so that the pieces between them give the places."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    found = []
    for place, r in enumerate(rules):
        # letters of either case are listed: the engine's own folding knows more than A-Z
        pattern = r.pattern
        if r.flags & re.IGNORECASE:
            keys, _, rest = pattern.partition(")")
            pattern = "(" + "|".join(map(_either_case, keys[1:].split("|"))) + ")" + rest
        size = f"len(regexp_extract(m, {quoted(pattern)}, {r.group}))" if r.group else "len(m)"
        found.append(f"""select doc_id, {place} as place, '{r.kind}' as kind, start, start + len(m) as stop from (
  select doc_id, m, head + coalesce(sum(len(m) + gap) over (partition by doc_id order by j rows between unbounded preceding and 1 preceding), 0) as start
  from (select doc_id, unnest(range(2, len(pieces) + 1)) as j, len(pieces[1]) as head, unnest(list_transform(pieces[2:], lambda p: string_split(p, chr(2))[1])) as m, unnest(list_transform(pieces[2:], lambda p: len(p) - 1 - len(string_split(p, chr(2))[1]))) as gap
    from (select doc_id, string_split(regexp_replace(t, {quoted("(" + pattern + ")")}, chr(1) || '\\1' || chr(2), 'g'), chr(1)) as pieces from texts))) where {size} >= {r.least}""")
    listed = "string_agg(kind || ':' || start || ':' || stop, ',' order by start, place)"
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    counts = ", ".join(f"count(*) filter (kind = '{r.kind}') as n_{r.kind}" for r in BASE)
    return f"""with texts as (select doc_id, replace(replace(coalesce(text, ''), chr(1), ' '), chr(2), ' ') as t from documents),
found as ({' union all '.join(found)})
select d.doc_id, {counts}, sha256(coalesce({listed} filter (kind in ({base})), '')) as base_sha256, coalesce({listed}, '') as spans
from documents d left join found using (doc_id) group by d.doc_id"""


OP8_SQL = rules_sql()
