"""Secret scanning: trigram queries over an inverted index pick candidate texts, regexes verify them.

From each rule's regex a Boolean query over trigrams is derived (case folded): texts that match the
regex satisfy it. A slice of texts gets an index of the trigrams that any rule asks for; postings are
intersected and united as the queries say, and only candidates are searched by the regex. A rule
without mandatory trigrams (such as a run of hex digits) searches every text.

Rules: the base rules assign, access and hex, and further kinds for keys of well-known form. Matches are leftmost and
don't overlap within a kind; those that are too short are dropped afterwards. Offsets are in code points.

Defined results: null text counts as empty and has no spans; a null doc_id is kept as it is; repeated rows
each give their own row; an empty table gives an empty result; redact() keeps all columns of its input,
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common, hashing
from loomgraph.llm.hashing import LOWER

#: Alternatives of literal text that are told apart before a query is cut.
MOST_EXACT = 64


@dataclass(frozen=True)
class Rule:
    """kind, a bytes regex (ASCII classes only), the group whose length counts and its least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
RULES = (
    *BASE,
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("git_token", r"gh[opsru]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)

# A query is True (no condition), ("tri", bytes), ("and", queries) or ("or", queries).


def _all(queries: list) -> object:
    queries = [q for q in queries if q is not True]
    return True if not queries else queries[0] if len(queries) == 1 else ("and", tuple(queries))


def _any(queries: list) -> object:
    return True if not queries or any(q is True for q in queries) else queries[0] if len(queries) == 1 else ("or", tuple(queries))


def _needs(exact: set[str]) -> object:
    """The query of texts that hold one of these strings."""
    return _any([_all([("tri", s[i : i + 3].encode("latin-1")) for i in range(len(s) - 2)]) for s in sorted(exact)])


Part = tuple[set[str] | None, object]
#: A part that stands for anything, and one that stands for the empty string.
ANY: Part = (None, True)
EMPTY: Part = ({""}, True)
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v"}


class _Regex:
    """Reads a regex; each part is (the few strings that it stands for, or None; a query for the part)."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def next_is(self, *starts: str) -> bool:
        return self.text.startswith(starts, self.at)

    def take(self, n: int = 1) -> str:
        self.at += n
        if self.at > len(self.text):
            raise ValueError(f"{self.text!r} ends too early")
        return self.text[self.at - n : self.at]

    def either(self) -> Part:
        parts = [self.sequence()]
        while self.next_is("|"):
            self.take()
            parts.append(self.sequence())
        if len(parts) == 1:
            return parts[0]
        if all(exact is not None for exact, _ in parts) and sum(len(e) for e, _ in parts) <= MOST_EXACT:
            return set().union(*(e for e, _ in parts)), True
        return None, _any([query if exact is None else _needs(exact) for exact, query in parts])

    def sequence(self) -> Part:
        exact, queries, whole = {""}, [], True
        while self.at < len(self.text) and not self.next_is("|", ")"):
            mine, query = self.repeated()
            if mine is not None and len(mine) * len(exact) <= MOST_EXACT:
                exact = {a + b for a in exact for b in mine}
                continue
            queries += [_needs(exact), query if mine is None else True]
            whole, exact = False, mine if mine is not None else {""}
        return (exact, True) if whole else (None, _all([*queries, _needs(exact)]))

    def repeated(self) -> Part:
        part = self.atom()
        while found := re.compile(r"[*+?]|\{(\d*)(,?)(\d*)\}").match(self.text, self.at):
            self.take(len(found[0]))
            if self.next_is("?", "+"):  # lazy or possessive
                self.take()
            least = {"*": 0, "+": 1, "?": 0}.get(found[0], int(found[1] or 0) if found[1] is not None else 0)
            most = {"*": None, "+": None, "?": 1}.get(found[0], least if not found[2] else int(found[3]) if found[3] else None)
            part = self.times(part, least, most)
        return part

    @staticmethod
    def times(part: Part, least: int, most: int | None) -> Part:
        exact, query = part
        if exact is not None and most == 1:
            return exact | ({""} if least == 0 else set()), True
        if least == 0:
            return ANY
        if exact is not None and least == most and len(exact) ** least <= MOST_EXACT:
            out = {""}
            for _ in range(least):
                out = {a + b for a in out for b in exact}
            return out, True
        return None, query if exact is None else _needs(exact)

    def atom(self) -> Part:
        c = self.take()
        if c == "(":
            opening = re.compile(r"\?(?:[=!]|<[=!])|\?P<\w+>|\?[a-zA-Z-]*:|").match(self.text, self.at)[0]
            self.take(len(opening))
            inner = self.either()
            if self.take() != ")":
                raise ValueError(f"{self.text!r} has a group that isn't closed")
            return EMPTY if opening in ("?=", "?!", "?<=", "?<!") else inner
        if c == "[":
            return self.chars()
        if c in "^$":
            return EMPTY
        if c == ".":
            return ANY
        if c == "\\":
            one = self.escaped()
            return EMPTY if one == "" else ANY if one is None else ({one.lower()}, True)
        return {c.lower()}, True

    def escaped(self) -> str | None:
        """The character behind a backslash; '' for a place, None for a class or a group that came before."""
        c = self.take()
        if c == "x":
            return chr(int(self.take(2), 16))
        if c in "bBAZ":
            return ""
        return _ESCAPED.get(c) if c.isalnum() else c

    def chars(self) -> Part:
        """A set of characters: those that it stands for, if they are few."""
        found, start, known = set(), self.at, not self.next_is("^")
        while self.at == start or not self.next_is("]"):
            c = self.take()
            c = self.escaped() if c == "\\" else c
            if self.next_is("-") and self.text[self.at + 1 : self.at + 2] != "]":
                self.take()
                last = self.take()
                last = self.escaped() if last == "\\" else last
                if not c or not last or ord(last) - ord(c) >= 8:
                    known = False
                else:
                    found |= {chr(k).lower() for k in range(ord(c), ord(last) + 1)}
            elif c:
                found.add(c.lower())
            else:
                known = False
        self.take()
        return (found, True) if known and len(found) <= 8 else ANY


def trigram_query(pattern: str) -> object:
    """The Boolean trigram query that every match of the pattern satisfies; True if there is none."""
    regex = _Regex(pattern)
    exact, query = regex.either()
    if regex.at < len(pattern):
        raise ValueError(f"{pattern!r} has a ')' too many")
    return query if exact is None else _needs(exact)


def _trigrams(query) -> set[bytes]:
    if query is True:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*(_trigrams(q) for q in query[1]))


class Index:
    """Postings of the trigrams that the rules' queries ask for, over a slice of texts."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.wanted = {t: k for k, t in enumerate(sorted(set().union(*(_trigrams(q) for q in self.queries))))}
        self.lookup = np.full(1 << 24, -1, np.int16)
        for t, k in self.wanted.items():
            self.lookup[t[0] << 16 | t[1] << 8 | t[2]] = k

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """For each rule the rows that may match."""
        rows = len(offsets) - 1
        postings = np.zeros((len(self.wanted), rows), bool)
        if len(data) > 2:
            low = LOWER[data].astype(np.int32)
            found = self.lookup[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
            at = np.flatnonzero(found >= 0)
            row = np.searchsorted(offsets, at, "right") - 1
            inside = at + 3 <= offsets[row + 1]
            postings[found[at[inside]], row[inside]] = True

        def holds(query) -> np.ndarray:
            if query is True:
                return np.ones(rows, bool)
            if query[0] == "tri":
                return postings[self.wanted[query[1]]]
            return (np.logical_and if query[0] == "and" else np.logical_or).reduce([holds(q) for q in query[1]])

        return [np.flatnonzero(holds(q)) for q in self.queries]


def spans_of(texts: list[bytes], index: Index, rules: tuple[Rule, ...], patterns: list[re.Pattern]) -> list[list[tuple[int, int, int]]]:
    """For each text (start, rule, end) in code points, in order."""
    offsets = np.cumsum([0, *map(len, texts)])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, pattern, rows) in enumerate(zip(rules, patterns, index.candidates(np.frombuffer(b"".join(texts), np.uint8), offsets), strict=True)):
        for row in rows.tolist():
            for m in pattern.finditer(texts[row]):
                a, b = m.span(rule.group)
                if b - a >= rule.least:
                    out[row].append((m.start(), k, m.end()))
    for row, spans in enumerate(out):
        if spans:
            spans.sort()
            if not texts[row].isascii():
                # a code point starts at every byte but 10xxxxxx
                point = np.concatenate([[0], np.cumsum((np.frombuffer(texts[row], np.uint8) & 0xC0) != 0x80)])
                out[row] = [(int(point[a]), k, int(point[b])) for a, k, b in spans]
    return out


def _scanner(rules: tuple[Rule, ...]):
    index = Index(rules)
    # maximal runs are found from their first byte, so the least length may stand in the regex of a single class
    patterns = [re.compile((f"{r.pattern[:-1]}{{{r.least},}}" if re.fullmatch(r"\[[^\]]+\]\+", r.pattern) and r.least else r.pattern).encode()) for r in rules]

    def scan(column) -> Iterator[tuple[int, int, list[list[tuple[int, int, int]]]]]:
        data, offsets = common.texts(column)
        for a, b in hashing.slices(offsets, common.SLICE_BYTES):
            part = data[offsets[a] : offsets[b]].tobytes()
            cuts = (offsets[a : b + 1] - offsets[a]).tolist()
            yield a, b, spans_of([part[x:y] for x, y in zip(cuts, cuts[1:], strict=False)], index, rules, patterns)

    return scan


def _named(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...], most: int | None = None) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans if most is None or k < most)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id long, spans array<struct<kind string, start long, end long>> in order of start, then of the rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for a, b, found in scan(batch.column(1)):
                spans = pa.array([[{"kind": rules[k].kind, "start": x, "end": y} for x, k, y in s] for s in found], kind)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), spans], names=["doc_id", "spans"])

    picked = common.bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_<kind> of the base rules, base_sha256 and spans (kind:start:end, comma-joined), from find_secrets()."""
    found = find_secrets(docs, rules)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    of_kind = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of text_col replaced by the mark (spans that overlap become one)."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scanner(rules)
        for batch in batches:
            for a, b, found in scan(batch.column(place)):
                part = batch.slice(a, b - a)
                if not any(found):
                    yield part
                    continue
                texts = part.column(place).to_pylist()
                for row, spans in enumerate(found):
                    if spans:
                        out, at = [], 0
                        for x, _, y in spans:
                            if x >= at:
                                out += [texts[row][at:x], mark]
                            at = max(at, y)
                        texts[row] = "".join([*out, texts[row][at:]])
                yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(place).type) if k == place else c for k, c in enumerate(part.columns)], schema=batch.schema)

    return common.bounded(docs).mapInArrow(run, docs.schema)


__all__ = ["BASE", "RULES", "Index", "Rule", "digest", "find_secrets", "redact", "spans_of", "trigram_query"]
