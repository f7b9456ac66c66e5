"""Benchmark decontamination by one Aho-Corasick automaton over normalised test items.

Items become windows of `window` consecutive words (an item with fewer words is one window). Each distinct
word of the items is one symbol, so a window is a short string of symbols and the automaton stays small. A document is
turned into symbols in one pass (words that no item has become one filler symbol) and scanned once;
matches are word ranges, which are mapped back to offsets of the original text.

The automaton is held by every worker, so its size is checked: up to PART_WINDOWS distinct pairs of window and item make one
automaton. More than that (some 6 MB of item text) are dealt to several by a hash, applied one after the other with the
hits staged in between; pairs are dealt, so neither one long item nor a repeated one makes a part larger.

Defined results: null or empty text has no words and no hits; null or empty items have no windows; items with
a null item_id count as one item without a name, which is null in `items` and not part of the joined names; repeated
items of one name count once; a null doc_id is kept; empty tables on either side give no hits; columns other than the named
ones are never looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common, hashing
from loomgraph.llm.common import stage

#: Pairs of a window and an item that has it in one automaton.
PART_WINDOWS = 1 << 20
#: Words are runs of [0-9a-z] and of bytes from 0x80, after lower-casing A-Z.
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_NORMAL = bytes(int(hashing.LOWER[b]) if IN_WORD[b] else 0x20 for b in range(256))
HITS = "doc_id long, text string, n_words long, hits binary, items array<string>"


def words_of(text: str | bytes | None) -> list[bytes]:
    if isinstance(text, str):
        text = text.encode()
    return (text or b"").translate(_NORMAL).split()


class Automaton:
    """Finds windows of items, given as (name, words of the window joined by a space), in lists of words."""

    def __init__(self, pairs: list[tuple[str | None, bytes]]):
        self.symbols: dict[bytes, str] = {}
        windows: dict[str, set[str | None]] = {}
        for name, window in pairs:
            windows.setdefault("".join(self._symbol(w) for w in window.split()), set()).add(name)
        self.tree = ahocorasick.Automaton() if windows else None
        for coded, names in windows.items():
            self.tree.add_word(coded, (len(coded), tuple(names)))
        if self.tree is not None:
            self.tree.make_automaton()

    def _symbol(self, word: bytes) -> str:
        code = len(self.symbols) + 1
        return self.symbols.setdefault(word, chr(code if code < 0xD800 else code + 0x800))

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Ranges of words (end exclusive) inside windows, merged, and the names of the items."""
        if self.tree is None or not words:
            return [], set()
        get = self.symbols.get
        coded = "".join([get(w, "\0") for w in words])
        ranges: list[tuple[int, int]] = []
        names: set[str | None] = set()
        for end, (length, found) in self.tree.iter(coded):
            names.update(found)
            a = end + 1 - length
            while ranges and ranges[-1][1] >= a:  # ends only grow
                a = min(a, ranges.pop()[0])
            ranges.append((a, end + 1))
        return ranges, names


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _code_points(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as ranges of code points."""
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = hashing.words(data, np.array([0, len(data)]), IN_WORD)
    point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return [(int(point[starts[a]]), int(point[ends[b - 1]])) for a, b in ranges]


def _parts(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> Iterator[tuple[list[tuple[str | None, bytes]], bool]]:
    """The distinct pairs (item, window) for each automaton in turn, and whether it is the last one."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1), strict=True):
                words = words_of(text.as_py())
                starts = range(max(len(words) - window, 0) + 1 if words else 0)
                for at in range(0, len(starts), 4096):
                    made = [b" ".join(words[i : i + window]) for i in starts[at : at + 4096]]
                    yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(made), pa.string()), pa.array(made, pa.binary())], names=["item", "window"])

    pairs = stage(items.mapInArrow(cut, "item string, window binary").distinct(), "windows")
    parts = max(1, math.ceil(pairs.count() / PART_WINDOWS))
    for k in range(parts):
        # bounded by PART_WINDOWS, so it may come to the driver
        part = pairs.where(F.pmod(F.xxhash64("item", "window"), F.lit(parts)) == k).toArrow()
        yield list(zip(part.column("item").to_pylist(), part.column("window").to_pylist(), strict=True)), k == parts - 1


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id long, n_words long, n_hit long, items array<string> (sorted, null last), spans array<struct<start long, end long>>
    (runs of hit words, as code points of the original text), one row for each row of docs."""
    picked = common.bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def scanner(pairs: list[tuple[str | None, bytes]], first: bool, last: bool):
        shared = docs.sparkSession.sparkContext.broadcast(pairs)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = Automaton(shared.value)
            for batch in batches:
                data, offsets = common.texts(batch.column(1))
                cuts = offsets.tolist()
                n_words, n_hit, hits, items, spans = [], [], [], [], []
                for row in range(batch.num_rows):
                    text = data[cuts[row] : cuts[row + 1]].tobytes()
                    words = words_of(text)
                    ranges, names = automaton.find(words)
                    if not first:
                        held = np.frombuffer(batch.column(3)[row].as_py(), np.int64).reshape(-1, 2).tolist()
                        ranges = _merged([*ranges, *map(tuple, held)])
                        names |= set(batch.column(4)[row].as_py())
                    n_words.append(len(words))
                    items.append(sorted(names, key=lambda x: (x is None, x or "")))
                    if last:
                        n_hit.append(sum(b - a for a, b in ranges))
                        spans.append([{"start": a, "end": b} for a, b in _code_points(text, ranges)] if ranges else [])
                    else:
                        hits.append(np.array(ranges, np.int64).tobytes())
                if last:
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, spans_type)], names=["doc_id", "n_words", "n_hit", "items", "spans"])
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "text", "n_words", "hits", "items"])

        return run

    for k, (pairs, last) in enumerate(_parts(benchmark, window, item_col, item_text_col)):
        picked = picked.mapInArrow(scanner(pairs, k == 0, last), "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>" if last else HITS)
        if not last:
            picked = stage(picked, "hits")
    return picked


def drop_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs without any hit word, with all their columns: a pass over docs for each automaton, and no shuffle."""
    place, context = docs.columns.index(text_col), common.bounded(docs).sparkSession.sparkContext

    def cleaner(pairs: list[tuple[str | None, bytes]]):
        shared = context.broadcast(pairs)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = Automaton(shared.value)
            for batch in batches:
                data, offsets = common.texts(batch.column(place))
                cuts = offsets.tolist()
                clean = [not automaton.find(words_of(data[a:b].tobytes()))[0] for a, b in zip(cuts, cuts[1:], strict=False)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    for pairs, last in _parts(benchmark, window, item_col, item_text_col):
        docs = docs.mapInArrow(cleaner(pairs), docs.schema)
        docs = docs if last else stage(docs, "clean")
    return docs


def digest(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, from find_leaks()."""
    found = find_leaks(docs, benchmark, window)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
