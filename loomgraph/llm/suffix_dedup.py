"""Removal of repeated byte strings by bucket-pointer refinement of suffixes.

Suffixes (byte positions) start in buckets by their q-grams, q = length / 4, and buckets are refined by sorting on
the bucket identifiers of later offsets: a suffix's bucket of depth 2 h is named by its identifiers of depth h at its
own offset and h later, so one refinement after another makes depth q, 2 q and 4 q = `length` (400) out of the identifiers
that the refinement before it made. A suffix that is alone in a bucket is final and drops out. q-grams are told apart by
fingerprints modulo the prime 2**61 - 1; every identifier after that is the number of a bucket in a sort (`refine`).

1. *Synchronising suffixes.* Each suffix belongs to the suffix with the smallest 16-gram among the
   `SYNC` positions from its own; suffixes of equal text belong to suffixes of equal text at equal
   distance. Only these few (2 %) are counted first, by a hash of length - SYNC bytes. If that comes once, no suffix that
   belongs to it can be repeated. Equal texts have equal hashes, so this loses nothing.
2. *Runs.* The suffixes belonging to one live synchronising suffix are a run lo..hi. Runs are refined
   as a whole, on the q-grams of T[lo..hi + length): if that comes twice, every suffix of the run is repeated.
3. *Single suffixes.* Those of the runs left over, and of one run for each repeated text whose
   synchronising bucket also holds a run left over, are refined one by one. What is still in a bucket of two is repeated.

A refinement takes place in tasks: suffixes travel with the q-grams of their later offsets to a task that their whole
text decides, so equal ones always meet, and one hot bucket of many different texts is spread over all tasks. Blocks
count their own copies first, and only distinct texts travel, once from each block. What a block has found out about its
live suffixes it writes down as a note to itself, which comes back with the answers.

Defined results: null or empty text has no bytes and nothing to remove; matches never cross documents;
repeated rows are copies of each other like any other rows; a null doc_id is kept as it is; an empty
table gives an empty result; columns other than the two named ones are never looked at.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common, hashing
from loomgraph.llm.common import blocks_only, by_part, pack_blocks, scale, sharded, stage, with_mail
from loomgraph.llm.hashing import BYTE_BASE, BYTE_VALUES, U, fingerprints, grams, mix, prefix

#: Positions among which a synchronising suffix is the smallest, and the length of the gram that is compared.
SYNC, GRAM = 100, 16
#: Bits for places in a piece; the others order its grams, alike in all pieces.
PLACE_BITS = 22
#: Bytes of text for each group of synchronising suffixes or runs, for a corpus of up to common.SCALE_BYTES, and how many times
#: more groups single suffixes have.
SHARD_BYTES, SINGLE_SHARDS = 48 << 20, 4
MAIL = "block long, kind int, part long, data binary"
SENT = "part long, block long, data binary"
BUCKETS, RUNS, MIXED, SINGLE, RUN_NOTE, SINGLE_NOTE = range(6)


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int):
    """Cuts the documents of a block into pieces: (place in data, bytes, offsets of documents in it). A long
    document is cut into pieces that overlap by length - 1 bytes."""
    for a, b in hashing.slices(offsets, common.SLICE_BYTES):
        lo, hi = int(offsets[a]), int(offsets[b])
        if b - a > 1 or hi - lo <= 2 * common.SLICE_BYTES:
            yield lo, data[lo:hi], offsets[a : b + 1] - lo
            continue
        for at in range(lo, hi - length + 1, common.SLICE_BYTES):
            end = min(at + common.SLICE_BYTES + length - 1, hi)
            yield at, data[at:end], np.array([0, end - at])


def _gram_order(data: np.ndarray) -> np.ndarray:
    """A number for the GRAM bytes from each place; its upper bits order them."""
    g = data.astype(np.uint64)
    for k in (1, 2, 4):
        g = g[:-k] | g[k:] << U(8 * k)
    return mix(g[:-8] * U(0x9E3779B97F4A7C15) ^ mix(g[8:]))


class _Piece:
    """Synchronising suffixes and runs of a piece of a block."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length, self.step = data, length, length // 4
        self.sums = prefix(BYTE_VALUES[data], BYTE_BASE)
        self.lo = self.hi = self.sync = np.empty(0, np.int64)

    def find_runs(self, offsets: np.ndarray):
        """Sets lo, hi and sync of the runs of the documents between the offsets."""
        length, sizes = self.length, np.diff(offsets)
        n = len(self.data) - length + 1
        if n <= 0 or not (sizes >= length).any():
            return
        order = _gram_order(self.data)
        shift = U(PLACE_BITS)
        low = (order >> shift << shift) | np.arange(len(order), dtype=np.uint64)
        width = 1
        while 2 * width <= SYNC:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < SYNC:
            low = np.minimum(low[: len(low) - (SYNC - width)], low[SYNC - width :])
        sync = (low[:n] & ((U(1) << shift) - U(1))).astype(np.int64)
        ends = np.repeat(offsets[1:], sizes)[:n]
        valid = np.flatnonzero(np.arange(n) + length <= ends)
        if not len(valid):
            return
        s = sync[valid]
        new = np.flatnonzero((np.diff(valid) > 1) | (np.diff(s) != 0)) + 1
        first = np.concatenate([[0], new])
        self.lo, self.sync = valid[first], s[first]
        self.hi = valid[np.concatenate([new, [len(valid)]]) - 1]

    def buckets(self) -> np.ndarray:
        """Hashes of the synchronising suffixes, for each run."""
        return grams(self.sums, BYTE_BASE, self.length - SYNC, self.sync)

    def _grams(self, at: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
        """q-grams at the offsets (in q) after each place, a row for each place."""
        return fingerprints(self.sums, BYTE_BASE, self.step, (at[:, None] + self.step * np.array(offsets)).ravel()).reshape(len(at), len(offsets))

    def runs(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """q-grams that cover the text of whole runs, lo .. hi + length, and how wide the run is."""
        return np.column_stack([self._grams(lo, (0, 1, 2, 3)), self._grams(hi, (2, 3)), (hi - lo).astype(np.uint64)])

    def single(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes of runs, with their q-grams at all offsets."""
        sizes = hi - lo + 1
        at = np.repeat(lo - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        return at, self._grams(at, (0, 1, 2, 3))


def _distinct(rows: np.ndarray):
    """Distinct rows of a matrix, in the order of a hash that decides which task gets them; that hash, how often each comes
    (2: or more), and each row's place in them."""
    route = np.zeros(len(rows), np.uint64)
    for column in rows.T:
        route = mix(route * U(0xC2B2AE3D27D4EB4F) + column)
    order = np.argsort(route, kind="stable")
    ordered = rows[order]
    new = np.ones(len(order), bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(1)
    places = np.empty(len(order), np.int64)
    places[order] = np.cumsum(new) - 1
    counts = np.diff(np.append(np.flatnonzero(new), len(order)))
    return ordered[new], route[order][new], np.minimum(counts, 2).astype(np.uint8), places


def refine(pointers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Refines the buckets of suffixes (rows) from the identifiers at their offsets (columns, in order) until one
    identifier stands for all of a row. Returns how many suffixes each row's last bucket holds (a row stands for
    `counts` of them) and that bucket's identifier, negative for rows that dropped out.

    Each round sorts the identifiers of all offsets and numbers the buckets; the next identifiers are pairs of these
    numbers, at an offset and the one after it, so a round reuses what the rounds before have refined."""
    total, bucket = counts.astype(np.int64), -1 - np.arange(len(counts))
    live, ids = np.arange(len(counts)), pointers
    while len(live):
        names, numbers = np.unique(ids, return_inverse=True)
        numbers = numbers.reshape(len(live), -1)
        if numbers.shape[1] == 1:
            last = numbers[:, 0]
            total[live] = np.bincount(last, counts[live])[last].astype(np.int64)
            bucket[live] = last
            break
        more = np.ones(len(live), bool)
        for column in numbers.T:
            more &= np.bincount(column, minlength=len(names))[column] > 1
        live, numbers = live[more], numbers[more]
        if numbers.shape[1] % 2:  # nothing comes after the last offset
            numbers = np.column_stack([numbers, numbers[:, -1]])
        ids = numbers[:, ::2] * len(names) + numbers[:, 1::2]
    return total, bucket


def _join(counts: np.ndarray, rows: np.ndarray) -> bytes:
    return len(counts).to_bytes(8, "little") + np.ascontiguousarray(rows.T).tobytes() + counts.tobytes()


def _split(data: bytes, columns: int) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(data, np.uint64, n * columns, 8).reshape(columns, n).T, np.frombuffer(data, np.uint8, n, 8 + 8 * n * columns)


def _gathered(table: pa.Table, columns: int):
    parts = [_split(d.as_py(), columns) for d in table.column("data")]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), list(itertools.pairwise(np.cumsum([0, *(len(p[1]) for p in parts)])))


def _batch(names: tuple[str, ...], rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"data": pa.binary(), "kind": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds.get(c, pa.int64())) for k, c in enumerate(names)], names=list(names))


_MAIL, _SENT = ("block", "kind", "part", "data"), ("part", "block", "data")


def _sent_rows(block: int, shards: int, route: np.ndarray, counts: np.ndarray, rows: np.ndarray):
    made = [(k, block, _join(counts[s], rows[s])) for k, s in sharded(route, shards)]
    if made:
        yield _batch(_SENT, made)


def _answers(mail: common.Mail, kind: int) -> np.ndarray:
    """What the groups sent back for a block's distinct rows, in the order of their hash: groups are ranges of it."""
    return np.concatenate([np.empty(0, np.uint8), *(np.frombuffer(mail[key][0], np.uint8) for key in sorted(mail) if key[0] == kind)])


def _back(table: pa.Table, kind: int, answers: np.ndarray, cuts) -> list[tuple]:
    part = table.column("part")[0].as_py()
    return [(block.as_py(), kind, part, answers[a:b].tobytes()) for block, (a, b) in zip(table.column("block"), cuts, strict=True)]


def _all_runs(table: pa.Table, length: int):
    """The pieces of a block with their runs, and for all runs (piece, lo, hi) and the hash of the synchronising suffix."""
    data, offsets = common.texts(table.column("text"))
    pieces = []
    for _, part, offs in _pieces(data, offsets, length):
        pieces.append(_Piece(part, length))
        pieces[-1].find_runs(offs)
    piece = np.repeat(np.arange(len(pieces)), [len(p.lo) for p in pieces])
    lo, hi = (np.concatenate([np.empty(0, np.int64), *(getattr(p, side) for p in pieces)]) for side in ("lo", "hi"))
    return pieces, piece, lo, hi, np.concatenate([np.empty(0, np.uint64), *(p.buckets() for p in pieces)])


def _by_piece(piece: np.ndarray):
    """(piece, slice) of runs in the order of their pieces."""
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(piece)]
    return [(int(piece[a]), slice(a, b)) for a, b in itertools.pairwise(cuts) if b > a]


class _Runs:
    """The live runs of a block: piece, lo, hi, bucket (hash of the synchronising suffix), and place among the distinct texts."""

    def __init__(self, piece, lo, hi, bucket, places):
        self.piece, self.lo, self.hi, self.bucket, self.places = piece, lo, hi, bucket, places

    def note(self) -> bytes:
        width = pa.array((self.hi - self.lo).astype(np.uint8))
        return common.pack_bytes(pa.table({"piece": pa.array(self.piece.astype(np.int32)), "lo": pa.array(self.lo.astype(np.int32)), "width": width, "bucket": pa.array(self.bucket), "place": pa.array(self.places.astype(np.int32))}))

    @classmethod
    def noted(cls, mail: common.Mail) -> _Runs | None:
        if (RUN_NOTE, 0) not in mail:
            return None
        t = common.unpack_bytes(mail[RUN_NOTE, 0][0])
        piece, lo, width, bucket, places = (t.column(k).to_numpy() for k in range(5))
        return cls(piece.astype(np.int64), lo.astype(np.int64), lo.astype(np.int64) + width, bucket, places.astype(np.int64))

    def leaders(self) -> np.ndarray:
        """For each distinct text, its first run."""
        return np.unique(self.places, return_index=True)[1]

    def settled(self, mail: common.Mail) -> tuple[np.ndarray, np.ndarray]:
        """Which runs are repeated as a whole, and the runs whose suffixes go on singly."""
        code = _answers(mail, RUNS)
        whole = code[self.places] > 0
        mixed = np.unique(np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(d, np.uint64) for (k, _), ds in mail.items() if k == MIXED for d in ds)]))
        leads = self.leaders()[code == 2]
        return whole, np.sort(np.concatenate([np.flatnonzero(~whole), leads[np.isin(self.bucket[leads], mixed)]]))


def repeated_suffixes(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[DataFrame]]:
    """Blocks, and the mail that tells which of their suffixes are repeated to `length` bytes."""
    if length < 2 * SYNC or length % 4:
        raise ValueError(f"length must be a multiple of 4 and at least {2 * SYNC}")
    blocks, total = pack_blocks(docs, id_col, text_col)
    shards = max(8, math.ceil(total / (SHARD_BYTES * scale(total))))
    single_shards = SINGLE_SHARDS * shards

    def send_buckets(block: int, table: pa.Table):
        keys, route, counts, _ = _distinct(_all_runs(table, length)[4][:, None])
        yield from _sent_rows(block, shards, route, counts, keys)

    def group_buckets(table: pa.Table) -> pa.Table:
        keys, counts, cuts = _gathered(table, 1)
        return pa.Table.from_batches([_batch(_MAIL, _back(table, BUCKETS, (refine(keys, counts)[0] > 1).astype(np.uint8), cuts))])

    buckets = stage(by_part(blocks_only(blocks, send_buckets, SENT), shards, group_buckets, MAIL), "buckets")

    def send_runs(block: int, table: pa.Table, mail: common.Mail):
        pieces, piece, lo, hi, bucket = _all_runs(table, length)
        live = np.flatnonzero(_answers(mail, BUCKETS)[_distinct(bucket[:, None])[3]] > 0)
        if not len(live):
            return
        piece, lo, hi, bucket = piece[live], lo[live], hi[live], bucket[live]
        rows, route, counts, places = _distinct(np.concatenate([pieces[k].runs(lo[s], hi[s]) for k, s in _by_piece(piece)]))
        runs = _Runs(piece, lo, hi, bucket, places)
        yield from _sent_rows(block, shards, route, counts, np.column_stack([rows, bucket[runs.leaders()]]))
        yield _batch(_SENT, [(shards + block, block, runs.note())])

    def returned(table: pa.Table, kind: int) -> pa.Table:
        return pa.Table.from_batches([_batch(_MAIL, [(block.as_py(), kind, 0, data.as_py()) for block, data in zip(table.column("block"), table.column("data"), strict=True)])])

    def group_runs(table: pa.Table) -> pa.Table:
        """Codes for runs: 0 comes once, 1 is repeated, 2 too and stands for its text; and the buckets of both
        sorts, as mail (kind MIXED) whose block is the group that compares them: two messages to each, however many blocks."""
        if table.column("part")[0].as_py() >= shards:
            return returned(table, RUN_NOTE)
        rows, counts, cuts = _gathered(table, 8)
        total, name = refine(rows[:, :7], counts)
        code, bucket = (total > 1).astype(np.uint8), rows[:, 7]
        first = np.zeros(len(code), bool)
        first[np.unique(name, return_index=True)[1]] = True
        code[first & (code == 1)] = 2  # of the rows of one text, the first stands for it
        out = _back(table, RUNS, code, cuts)
        once = np.unique(bucket[code == 0])
        out += [(k, MIXED, -1, once[s].tobytes()) for k, s in sharded(once, shards)]
        led = np.flatnonzero(code == 2)
        led = led[np.argsort(bucket[led], kind="stable")]
        of_block = np.repeat(table.column("block").to_numpy(), [b - a for a, b in cuts]).view(np.uint64)
        out += [(k, MIXED, 0, np.stack([bucket[led[s]], of_block[led[s]]]).tobytes()) for k, s in sharded(bucket[led], shards)]
        return pa.Table.from_batches([_batch(_MAIL, out)])

    runs = stage(by_part(with_mail(blocks, [buckets], send_runs, SENT), shards, group_runs, MAIL), "runs")

    def meet(table: pa.Table) -> pa.Table:
        """Which buckets of runs that stand for a repeated text also hold a run that comes once: a message for each block."""
        once, led = [np.empty(0, np.uint64)], [np.empty((2, 0), np.uint64)]
        for d, p in zip(table.column("data"), table.column("part").to_pylist(), strict=True):
            found = np.frombuffer(d.as_py(), np.uint64)
            once.append(found) if p < 0 else led.append(found.reshape(2, -1))
        bucket, of_block = np.concatenate(led, 1)
        hit = np.flatnonzero(np.isin(bucket, np.concatenate(once)))
        hit = hit[np.argsort(of_block[hit], kind="stable")]
        names, starts = np.unique(of_block[hit], return_index=True)
        group = table.column("block")[0].as_py()
        rows = [(block, MIXED, group, bucket[hit[a:b]].tobytes()) for block, (a, b) in zip(names.view(np.int64).tolist(), itertools.pairwise([*starts.tolist(), len(hit)]), strict=True)]
        return pa.Table.from_batches([_batch(_MAIL, rows)])

    mixed = stage(runs.where(F.col("kind") == MIXED).groupBy("block").applyInArrow(meet, MAIL), "mixed")
    runs = runs.where(F.col("kind") != MIXED)

    def send_single(block: int, table: pa.Table, mail: common.Mail):
        runs = _Runs.noted(mail)
        if runs is None:
            return
        which = runs.settled(mail)[1]
        piece, lo, hi = runs.piece[which], runs.lo[which], runs.hi[which]
        data, offsets = common.texts(table.column("text"))
        parts = list(_pieces(data, offsets, length))
        at, rows = [np.empty(0, np.int64)], [np.empty((0, 4), np.uint64)]
        for k, s in _by_piece(piece):
            start, part, _ = parts[k]
            places, found = _Piece(part, length).single(lo[s], hi[s])
            at.append(places + start)
            rows.append(found)
        rows, route, counts, places = _distinct(np.concatenate(rows))
        yield from _sent_rows(block, single_shards, route, counts, rows)
        note = pa.table({"at": pa.array(np.concatenate(at)), "place": pa.array(places.astype(np.int32))})
        yield _batch(_SENT, [(single_shards + block, block, common.pack_bytes(note))])

    def group_single(table: pa.Table) -> pa.Table:
        if table.column("part")[0].as_py() >= single_shards:
            return returned(table, SINGLE_NOTE)
        rows, counts, cuts = _gathered(table, 4)
        return pa.Table.from_batches([_batch(_MAIL, _back(table, SINGLE, (refine(rows, counts)[0] > 1).astype(np.uint8), cuts))])

    single = stage(by_part(with_mail(blocks, [runs, mixed], send_single, SENT), single_shards, group_single, MAIL), "single")
    return blocks, [runs, mixed, single]


def _repeated(table: pa.Table, mail: common.Mail, length: int) -> np.ndarray:
    """A mask of the bytes of a block that repeated suffixes cover."""
    data, offsets = common.texts(table.column("text"))
    edges = np.zeros(int(offsets[-1]) + 1, np.int32)
    runs = _Runs.noted(mail)
    if runs is not None:
        starts = np.array([at for at, _, _ in _pieces(data, offsets, length)])[runs.piece]
        whole = runs.settled(mail)[0]
        np.add.at(edges, (runs.lo + starts)[whole], 1)
        np.add.at(edges, (runs.hi + starts)[whole] + length, -1)
        note = common.unpack_bytes(mail[SINGLE_NOTE, 0][0])
        hits = note.column("at").to_numpy()[_answers(mail, SINGLE)[note.column("place").to_numpy()] > 0]
        np.add.at(edges, hits, 1)
        np.add.at(edges, hits + length, -1)
    return np.cumsum(edges)[:-1] > 0


def remove_repeated_strings(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", digest_only: bool = False) -> DataFrame:
    """doc_id long, n_bytes long, n_removed long, n_spans long, kept binary (what is left, concatenated; it
    may cut a character), or with digest_only kept_sha256 string in its place."""
    blocks, mails = repeated_suffixes(docs, length, id_col, text_col)
    last = "kept_sha256 string" if digest_only else "kept binary"

    def clean(_: int, table: pa.Table, mail: common.Mail):
        data, offsets = common.texts(table.column("text"))
        gone = _repeated(table, mail, length)
        removed, spans, kept = [], [], []
        for a, b in itertools.pairwise(offsets):
            mine = gone[a:b]
            n = int(mine.sum())
            removed.append(n)
            spans.append(int(mine[0]) + int((mine[1:] & ~mine[:-1]).sum()) if n else 0)
            rest = (data[a:b][~mine] if n else data[a:b]).tobytes()
            kept.append(hashlib.sha256(rest).hexdigest() if digest_only else rest)
        yield pa.RecordBatch.from_arrays(
            [table.column("doc_id").combine_chunks(), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string() if digest_only else pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", last.split()[0]],
        )

    return with_mail(blocks, mails, clean, f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}")
