"""Secret scan with a trigram inverted index.

Each rule's regular expression is parsed into a Boolean query of trigrams that any match must contain. The index is
sharded by document: a block of texts gets posting lists (sorted row numbers) of the rules' trigrams, the query
intersects and unites them, and only candidates are verified by the expression over their whole text. Rules without
mandatory trigrams scan every text. No posting leaves its task, so nothing is shuffled and no list grows with the corpus.

Nulls and empty texts have no spans; repeated rows are scanned each for itself; other columns are ignored.
Positions are code points, the end exclusive. Matches of one kind don't overlap (leftmost first).
"""

from __future__ import annotations

import re
import re._constants as c
import re._parser as parser
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from roadsift.llm.common import blocks, map_rows, slim

#: Most strings that a part of an expression may stand for before it is taken as "anything".
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """``group`` and ``least``: a match counts if that group has at least so many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    ignore_case: bool = False


#: The three base kinds first, in their order, then the added ones.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
)
RULES = BASE + ADDED


def trigrams_of(strings: set[str]):
    """Query that holds in a text with any of the strings; None: no demand."""
    options = []
    for s in strings:
        parts = sorted({s[i:i + 3] for i in range(len(s) - 2)})
        if not parts or not s.isascii() or "\0" in s:
            return None
        options.append(both(*parts))
    return either(*options)


def both(*parts):
    kept = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not kept else kept[0] if len(kept) == 1 else ("and", *kept)


def either(*parts):
    kept = list(dict.fromkeys(parts))
    return None if None in kept or not kept else kept[0] if len(kept) == 1 else ("or", *kept)


def _strings(kind, value) -> tuple[set[str] | None, object]:
    """The strings that a part of the parsed expression stands for, or None and the query it demands."""
    if kind is c.LITERAL:
        return {chr(value).lower()}, None
    if kind is c.IN:
        found = set()
        for k, v in value:
            if k is c.LITERAL:
                found.add(chr(v).lower())
            elif k is c.RANGE and v[1] - v[0] < MOST_STRINGS:
                found |= {chr(x).lower() for x in range(v[0], v[1] + 1)}
            else:
                return None, None
        return (found, None) if len(found) <= 8 else (None, None)
    if kind is c.SUBPATTERN:
        return _sequence(value[3])
    if kind is c.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        if all(s is not None for s, _ in parts):
            return set().union(*(s for s, _ in parts)), None
        return None, either(*(trigrams_of(s) if s is not None else q for s, q in parts))
    if kind in (c.MAX_REPEAT, c.MIN_REPEAT):
        least, most, inner = value
        strings, query = _sequence(inner)
        if strings is not None and (least, most) == (0, 1):
            return strings | {""}, None
        return None, None if not least else trigrams_of(strings) if strings is not None else query
    return ({""}, None) if kind is c.AT else (None, None)


def _sequence(parsed) -> tuple[set[str] | None, object]:
    demands, run, whole = [], {""}, True
    for kind, value in parsed:
        strings, query = _strings(kind, value)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        whole = False
        demands += [trigrams_of(run), query]
        run = strings if strings is not None else {""}
    return (run, None) if whole else (None, both(*demands, trigrams_of(run)))


def trigram_query(pattern: str):
    """Nested ("and" | "or", ...) of lower-case trigrams, a single trigram, or None: the rule has to scan every text."""
    strings, query = _sequence(parser.parse(pattern))
    return trigrams_of(strings) if strings is not None else query


def leaves(query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(leaves, query[1:]))


def postings(texts: list[str], wanted: dict[str, int], table: np.ndarray) -> dict[str, np.ndarray]:
    """Posting list of each wanted trigram over a block of texts (ASCII letters in lower case)."""
    coded = [t.encode("utf-8").lower() for t in texts]
    edges = np.cumsum([len(t) + 1 for t in coded])
    data = np.frombuffer(b"\0".join([*coded, b""]), np.uint8).astype(np.uint32)
    if len(data) < 3:
        return {name: np.zeros(0, np.int64) for name in wanted}
    code = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    number = table[code]
    at = np.flatnonzero(number)
    row = np.searchsorted(edges, at, "right")
    pairs = np.unique(number[at].astype(np.int64) * len(texts) + row)
    cuts = np.searchsorted(pairs, [(i + 1) * len(texts) for i in range(len(wanted) + 1)])
    return {name: pairs[cuts[i]:cuts[i + 1]] % len(texts) for name, i in wanted.items()}


def matching(query, lists: dict[str, np.ndarray]) -> np.ndarray:
    if isinstance(query, str):
        return lists[query]
    parts = [matching(q, lists) for q in query[1:]]
    return reduce(np.union1d, parts) if query[0] == "or" else reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), sorted(parts, key=len))


def scanner(rules: tuple[Rule, ...] = RULES):
    """A function from a block of texts to each text's spans (kind, start, end), by start, then kind as listed."""
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = {name: i for i, name in enumerate(sorted(set().union(*map(leaves, queries))))}
    table = np.zeros(1 << 24, np.uint8 if len(wanted) < 256 else np.uint16)
    for name, i in wanted.items():
        a, b, d = name.encode()
        table[a << 16 | b << 8 | d] = i + 1
    # an only repeated class meets its least length or has no match: that many may be asked for at once
    fast = [re.compile(r.pattern[:-1] + f"{{{r.least},}}" if r.group == 0 and re.fullmatch(r"\[[^\]]+\]\+", r.pattern) else r.pattern, re.ASCII | (re.IGNORECASE if r.ignore_case else 0)) for r in rules]

    def scan(texts: list[str]) -> list[list[tuple[str, int, int]]]:
        out: list[list] = [[] for _ in texts]
        lists = postings(texts, {k: i for k, i in wanted.items()}, table)
        for order, (rule, query, pattern) in enumerate(zip(rules, queries, fast)):
            for i in range(len(texts)) if query is None else matching(query, lists).tolist():
                for m in pattern.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[i].append((m.start(), order, m.end()))
        return [[(rules[k].kind, a, b) for a, k, b in sorted(spans)] for spans in out]

    return scan


SPANS = "array<struct<kind:string,start:long,end:long>>"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and ``spans`` of every row."""
    kept = slim(docs, text=text_col, doc_id=id_col)
    state: dict = {}

    def make(block):
        scan = state.get("scan") or state.setdefault("scan", scanner(rules))
        found = scan([t for t, _ in block])
        return {"doc_id": [d for _, d in block], "spans": [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in found]}

    return map_rows(kept, ["text", "doc_id"], make, f"doc_id {dict(kept.dtypes)['doc_id']}, spans {SPANS}")


def masked(text: str, spans: list[tuple[str, int, int]], mask: str) -> str:
    """``text`` with ``mask`` in place of each span; spans that overlap are one."""
    parts, at = [], 0
    for _, start, end in spans:
        if start >= at:
            parts += [text[at:start], mask]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, mask: str = "[secret]") -> DataFrame:
    """All rows and columns, with every span replaced by ``mask`` in the text; null stays null."""
    state: dict = {}

    def run(batches):
        scan = state.get("scan") or state.setdefault("scan", scanner(rules))
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            values = batch.column(at).to_pylist()
            for block in blocks((t, i) for i, t in enumerate(values) if t):
                for (text, i), spans in zip(block, scan([t for t, _ in block])):
                    if spans:
                        values[i] = masked(text, spans, mask)
            yield batch.set_column(at, batch.schema.field(at), pa.array(values, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
