"""Secret scan over a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over lower-cased trigrams that any match must contain.
Every Arrow batch of documents is a segment with an index of its own: postings of the trigrams that the queries name,
as sorted arrays of the segment's documents. A query intersects and unites postings; only its candidates are verified
with the expression. Rules without mandatory trigrams scan the whole segment. Segments need no shuffle and hold no
more than a batch.

Defined results: null and empty texts have no spans; the spans are in code points, end exclusive, by start and then
by the rules' order; an empty table gives an empty result; repeated rows are scanned row by row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as sre
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candleforge.llm.common import map_arrow, table, text_or_empty

#: Strings that the analysis of an expression carries before it turns them into trigrams.
MOST_STRINGS = 24


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # A run of 32 or more is what [0-9a-f]+ matches there; shorter runs are dropped without a match each.
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE_RULES = (
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("cloud", r"AIza[A-Za-z0-9_-]+", 0, 39),
)

#: A query is None (any text), a trigram, or ("and" | "or", queries).
Query = None | str | tuple[str, tuple]


def both(queries: Iterable[Query]) -> Query:
    parts = tuple(dict.fromkeys(q for q in queries if q is not None))
    return None if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def either(queries: Iterable[Query]) -> Query:
    parts = tuple(dict.fromkeys(queries))
    return None if not parts or None in parts else parts[0] if len(parts) == 1 else ("or", parts)


def of_strings(strings: set[str]) -> Query:
    """What a text that contains one of the strings must have."""
    return either(both(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(strings))


def analysed(items) -> tuple[set[str] | None, Query]:
    """The strings that a parsed expression matches, if they are few, and a query that any match satisfies."""
    done: list[Query] = []
    whole, run = True, {""}
    for op, arg in items:
        strings, query = one(op, arg)
        if strings is not None and len(strings) * len(run) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        done += [of_strings(run), of_strings(strings) if strings is not None else query]
        whole, run = False, {""}
    return (run, None) if whole else (None, both([*done, of_strings(run)]))


def one(op, arg) -> tuple[set[str] | None, Query]:
    if op is sre.LITERAL:
        return {chr(arg).lower()}, None
    if op is sre.IN:
        chars = [chr(x).lower() for kind, x in arg if kind is sre.LITERAL]
        return (set(chars), None) if len(chars) == len(arg) else (None, None)
    if op is sre.SUBPATTERN:
        return analysed(arg[3])
    if op is sre.BRANCH:
        parts = [analysed(x) for x in arg[1]]
        if all(s is not None for s, _ in parts):
            strings = set().union(*(s for s, _ in parts))
            return (strings, None) if len(strings) <= MOST_STRINGS else (None, of_strings(strings))
        return None, either(q if s is None else of_strings(s) for s, q in parts)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = arg
        strings, query = analysed(inner)
        if strings is not None and low == 0 and high == 1:
            return strings | {""}, None
        return None, (of_strings(strings) if strings is not None else query) if low else None
    return (set(("",)), None) if op is sre.AT else (None, None)


def trigram_query(rule: Rule) -> Query:
    strings, query = analysed(parser.parse(rule.pattern))
    return of_strings(strings) if strings is not None else query


def trigrams_of(query: Query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


@lru_cache(maxsize=8)
def plan(rules: tuple[Rule, ...]):
    """Compiled rules with their queries, and the number of each queried trigram by its code."""
    queries = [trigram_query(r) for r in rules]
    names = sorted(t for t in set().union(*map(trigrams_of, queries)) if t.isascii())
    code = np.zeros(1 << 24, np.uint8 if len(names) < 255 else np.uint16)
    for i, t in enumerate(names):
        code[(ord(t[0]) << 16) | (ord(t[1]) << 8) | ord(t[2])] = i + 1
    return [(r, r.compiled(), q) for r, q in zip(rules, queries, strict=True)], names, code


class Segment:
    """Postings of the queried trigrams over the texts of one batch."""

    def __init__(self, texts: pa.Array, names: list[str], code: np.ndarray):
        self.n = len(texts)
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + self.n + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.postings: dict[str, np.ndarray] = {}
        if len(data) < 3:
            return
        low = data + (((data >= 65) & (data <= 90)) << 5).astype(np.uint8)
        codes = (low[:-2].astype(np.int32) << 16) | (low[1:-1].astype(np.int32) << 8) | low[2:]
        found = code[codes]
        at = np.flatnonzero(found)
        docs = np.searchsorted(offsets - offsets[0], at, side="right") - 1
        inside = at + 3 <= (offsets - offsets[0])[docs + 1]
        pairs = np.unique(found[at[inside]].astype(np.int64) * self.n + docs[inside])
        which, docs = pairs // self.n, pairs % self.n
        for i in np.unique(which):
            self.postings[names[i - 1]] = docs[which == i]

    def candidates(self, query: Query) -> np.ndarray:
        if query is None:
            return np.arange(self.n)
        if isinstance(query, str):
            return self.postings.get(query, np.zeros(0, np.int64)) if query.isascii() else np.arange(self.n)
        parts = [self.candidates(q) for q in query[1]]
        if query[0] == "or":
            return np.unique(np.concatenate(parts))
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True)
        return out


def scan_secrets(
    df: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: id and ``found``, an array of (kind, start, end)."""

    def batch_spans(batch: pa.RecordBatch) -> pa.RecordBatch:
        compiled, names, code = plan(rules)
        texts = batch.column("text")
        segment = Segment(texts, names, code)
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(batch.num_rows)]
        for k, (rule, pattern, query) in enumerate(compiled):
            for i in segment.candidates(query).tolist():
                for m in pattern.finditer(texts[i].as_py()):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[i].append((m.start(), k, m.end()))
        spans = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in sorted(x)] for x in found]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "found"])

    rows = df.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, found array<struct<kind:string,start:long,end:long>>"
    return map_arrow(rows, batch_spans, schema)


def span_digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds and the joined spans, from ``scan_secrets``."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of_kind(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("found", lambda s: s["kind"].isin(*[r.kind for r in BASE_RULES]))
    return found.select(
        "doc_id",
        *[of_kind(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(scan_secrets(table(spark, sf_dir, "documents")))


def brute_force(text: str | None, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> list[tuple[str, int, int]]:
    """Spans of a text without an index, for tests."""
    out = []
    for k, rule in enumerate(rules):
        for m in rule.compiled().finditer(text or ""):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), k, m.end()))
    return [(rules[k].kind, a, b) for a, k, b in sorted(out)]


def digest_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
