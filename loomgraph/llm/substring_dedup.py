"""Removal of repeated word windows, found through a count-min sketch.

1. Each block of documents hashes its windows and sends a partial count-min sketch: per sketch row, the
   cells it touched, with counts that saturate at two. The sketch grows with the corpus (four cells a
   word and row) and is cut into parts, so that no task or broadcast ever holds all of it.
2. Parts are merged by adding; a block gets back one bit for each cell it sent: two or more in all.
   A window whose cells all have that bit is *estimated* repeated. Counts are never too low, so no
   repeated window is lost.
3. A second pass groups exactly only the windows estimated repeated, on two hashes modulo the prime 2**61 - 1
   with bases of their own (two windows of 35 words agree in both for one pair in 2**108 at most).
4. Words covered by a repeated window are removed.

Copies are counted inside a block before anything is sent, so that a window with a third of all rows
comes at most once from each block.

Defined results: null or empty text has no words, nothing to remove and the hash of the empty string;
texts with fewer words than a window lose nothing; repeated rows are copies of each other like any
other rows; a null doc_id is kept as it is; an empty table gives an empty result; columns other than
the two named ones are never looked at.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common, hashing
from loomgraph.llm.common import blocks_only, by_part, pack_blocks, scale, sharded, stage, with_mail
from loomgraph.llm.hashing import NOT_SPACE, OTHER_BASE, U, WORD_BASE, mix

#: Rows of the sketch, and cells a word in each row before rounding up to a power of two.
DEPTH, CELLS_PER_WORD = 2, 4
#: Cells of one part of the sketch (a byte each while merging), and bytes of keys one exact group task gets at most, both
#: for a corpus of up to common.SCALE_BYTES.
PART_CELLS, SHARD_BYTES = 1 << 22, 48 << 20
MAIL = "block long, kind int, part long, data binary"
SENT = "part long, block long, data binary"


def _windows(table: pa.Table, window: int):
    """Of a block: two hashes and the document row of each window, and the number of words of each document."""
    data, offsets = common.texts(table.column("text"))
    first, second, counts = [], [], np.zeros(len(offsets) - 1, np.int64)
    owner = []
    for a, b in hashing.slices(offsets, common.SLICE_BYTES):
        part = data[offsets[a] : offsets[b]]
        starts, ends, before = hashing.words(part, offsets[a : b + 1] - offsets[a], NOT_SPACE)
        counts[a:b] = np.diff(before)
        h = hashing.word_hashes(part, starts, ends)
        n = len(h) - window + 1
        if n <= 0:
            continue
        doc = np.repeat(np.arange(a, b), counts[a:b])
        at = np.flatnonzero(doc[:n] == doc[window - 1 :])  # windows inside one document
        if len(at):
            first.append(hashing.grams(hashing.prefix(h, WORD_BASE), WORD_BASE, window, at))
            second.append(hashing.grams(hashing.prefix(mix(h ^ U(0x5851F42D4C957F2D)), OTHER_BASE), OTHER_BASE, window, at))
            owner.append(doc[at])
    none = [np.empty(0, np.uint64)]
    return np.concatenate(first or none), np.concatenate(second or none), np.concatenate(owner or [np.empty(0, np.int64)]), counts


def _cells(h: np.ndarray, bits: int):
    """The distinct cells (the top bits of the hashes) in order, which come twice or more, and each window's place in them."""
    cells, places, counts = np.unique(h >> U(64 - bits), return_inverse=True, return_counts=True)
    return cells, counts > 1, places


def _pack_gaps(values: np.ndarray) -> bytes:
    """Increasing whole numbers as gaps of as many bytes (1, 2 or 4) as the largest takes."""
    gaps = np.diff(values, prepend=U(0))
    width = 1 if (top := int(gaps.max(initial=0))) < 1 << 8 else 2 if top < 1 << 16 else 4
    return bytes([width]) + gaps.astype(f"<u{width}").tobytes()


def _unpack_gaps(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, f"<u{data[0]}", offset=1), dtype=np.uint64)


def _part_slices(cells: np.ndarray, bits: int, part_bits: int):
    if not len(cells):
        return []
    parts = cells >> U(part_bits)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(parts)) + 1, [len(cells)]])
    return [(int(parts[a]), slice(int(a), int(b))) for a, b in itertools.pairwise(cuts)]


def _bits(flags: np.ndarray) -> bytes:
    return len(flags).to_bytes(8, "little") + np.packbits(flags).tobytes()


def _flags(data: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8, offset=8), count=int.from_bytes(data[:8], "little")).astype(bool)


def _rows(schema: list[str], rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"data": pa.binary(), "kind": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds.get(c, pa.int64())) for k, c in enumerate(schema)], names=schema)


def _estimated(mail: dict, hashes: tuple[np.ndarray, np.ndarray], bits: int, part_bits: int) -> np.ndarray:
    """Which windows have a count of two or more in every row of the sketch."""
    out = np.ones(len(hashes[0]), bool)
    for row in range(DEPTH):
        cells, _, places = _cells(hashes[row], bits)
        hot = np.zeros(len(cells), bool)
        for part, where in _part_slices(cells, bits, part_bits):
            hot[where] = _flags(mail[row, part][0])
        out &= hot[places]
    return out


def _candidates(first: np.ndarray, second: np.ndarray, which: np.ndarray):
    """The distinct 128-bit hashes of the chosen windows in order, which come twice or more, and each window's place in them."""
    a, b = first[which], second[which]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    places = np.empty(len(a), np.int64)
    places[order] = np.cumsum(new) - 1
    counts = np.diff(np.append(np.flatnonzero(new), len(a)))
    return a[new], b[new], counts > 1, places


def repeated_windows(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[DataFrame], dict]:
    """Blocks, the mail that tells which of their windows are repeated, and the sketch's measures."""
    blocks, total = pack_blocks(docs, id_col, text_col)
    # a word has two bytes at least, with its separator; the sketch's size follows the corpus
    n_words = max(total // 4, 1 << 18)
    bits = min(max(20, math.ceil(math.log2(CELLS_PER_WORD * n_words))), 60)
    part_bits = min(bits, int(math.log2(PART_CELLS * scale(total))))
    shards = max(8, math.ceil(16 * n_words / (SHARD_BYTES * scale(total))))

    def sketch(block: int, table: pa.Table):
        hashes = _windows(table, window)[:2]
        for row in range(DEPTH):
            cells, twice, _ = _cells(hashes[row], bits)
            rows = []
            for part, where in _part_slices(cells, bits, part_bits):
                local = cells[where] & U((1 << part_bits) - 1)
                rows.append((part * DEPTH + row, block, _bits(twice[where]) + _pack_gaps(local)))
            if rows:
                yield _rows(["part", "block", "data"], rows)

    def split(data: bytes) -> tuple[np.ndarray, np.ndarray]:
        n = int.from_bytes(data[:8], "little")
        return _flags(data[: 8 + (n + 7) // 8]), _unpack_gaps(data[8 + (n + 7) // 8 :])

    def merge(table: pa.Table) -> pa.Table:
        """Adds the partial sketches of one part; counts stop at two."""
        counts = np.zeros(1 << part_bits, np.uint8)
        for data in table.column("data"):
            twice, cells = split(data.as_py())
            counts[cells] += np.where(twice, np.uint8(2), np.uint8(1))
            counts[cells] = np.minimum(counts[cells], 2)
        part = table.column("part")[0].as_py()
        back = [(block.as_py(), part % DEPTH, part // DEPTH, _bits(counts[split(data.as_py())[1]] > 1)) for block, data in zip(table.column("block"), table.column("data"), strict=True)]
        return pa.Table.from_batches([_rows(["block", "kind", "part", "data"], back)])

    sketched = stage(by_part(blocks_only(blocks, sketch, SENT), DEPTH << (bits - part_bits), merge, MAIL), "sketch")

    def candidates(block: int, table: pa.Table, mail: common.Mail):
        first, second, _, _ = _windows(table, window)
        a, b, twice, _ = _candidates(first, second, np.flatnonzero(_estimated(mail, (first, second), bits, part_bits)))
        rows = [(k, block, _bits(twice[s]) + a[s].tobytes() + b[s].tobytes()) for k, s in sharded(a, shards)]
        if rows:
            yield _rows(["part", "block", "data"], rows)

    def group(table: pa.Table) -> pa.Table:
        """Exact counts of the windows of one shard."""
        flags, one, two, sizes = [], [], [], []
        for data in table.column("data"):
            data = data.as_py()
            n = int.from_bytes(data[:8], "little")
            at = 8 + (n + 7) // 8
            flags.append(_flags(data[:at]))
            one.append(np.frombuffer(data, np.uint64, n, at))
            two.append(np.frombuffer(data, np.uint64, n, at + 8 * n))
            sizes.append(n)
        a, b, twice = np.concatenate(one), np.concatenate(two), np.concatenate(flags)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        more = np.zeros(len(a), bool)
        more[1:] |= same
        more[:-1] |= same
        twice[order] |= more
        cuts = np.cumsum([0, *sizes])
        part = table.column("part")[0].as_py()
        back = [(block.as_py(), DEPTH, part, _bits(twice[x:y])) for block, (x, y) in zip(table.column("block"), itertools.pairwise(cuts), strict=True)]
        return pa.Table.from_batches([_rows(["block", "kind", "part", "data"], back)])

    exact = stage(by_part(with_mail(blocks, [sketched], candidates, SENT), shards, group, MAIL), "exact")
    return blocks, [sketched, exact], {"bits": bits, "part_bits": part_bits, "shards": shards, "window": window}


def _covered(mail: dict, table: pa.Table, how: dict):
    """For each document of a block: the number of words and a mask of its words to remove."""
    window, shards = how["window"], how["shards"]
    first, second, owner, counts = _windows(table, window)
    which = np.flatnonzero(_estimated(mail, (first, second), how["bits"], how["part_bits"]))
    a, _, _, places = _candidates(first, second, which)
    hot = np.zeros(len(a), bool)
    for k, s in sharded(a, shards):
        hot[s] = _flags(mail[DEPTH, k][0])
    hits = which[hot[places]]
    # place of each window's first word among the words of the block
    before = np.cumsum(counts) - counts
    windows = np.maximum(counts - window + 1, 0)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = before[owner[hits]] + rank[hits]
    edges = np.zeros(int(counts.sum()) + 1, np.int32)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return counts, before, np.cumsum(edges)[:-1] > 0


def remove_repeated_windows(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id long, n_words long, n_removed long, kept string: the text's words without those that a
    repeated window of `window` words covers, joined by one space."""
    blocks, mails, how = repeated_windows(docs, window, id_col, text_col)

    def clean(_: int, table: pa.Table, mail: common.Mail):
        counts, before, gone = _covered(mail, table, how)
        removed, kept = [], []
        for i, text in enumerate(table.column("text")):
            mine = gone[before[i] : before[i] + counts[i]]
            words = (text.as_py() or "").encode().split()
            n = int(mine.sum())
            if n:
                words = itertools.compress(words, ~mine)
            removed.append(n)
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array(counts), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return with_mail(blocks, mails, clean, "doc_id long, n_words long, n_removed long, kept string")


def digest(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of remove_repeated_windows()."""
    out = remove_repeated_windows(docs, window)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


__all__ = ["digest", "remove_repeated_windows", "repeated_windows"]
