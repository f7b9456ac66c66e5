"""Near-duplicate groups by SuperMinHash signatures, banding, verification and union-find.

1. Documents become sets of word shingles (64-bit hashes of them). Equal sets are one class from here on, named
   by its smallest doc_id, so that copies cost one row each and never meet in pairs.
2. A SuperMinHash signature of each set: every shingle deals correlated ranks 0, 1, 2, ... along its
   own random permutation of the components, and stops as soon as no component can get smaller.
3. Banding: classes that agree in all components of a band share a bucket.
4. Each class is compared with the centres of its buckets; a group's buckets mostly have the same few. Signatures
   rule out pairs that are far below the threshold, and the rest are verified on full sets. Verified pairs are grouped.
5. Buckets that still hold several groups compare their classes across groups, in a grid of bounded
   chunks, so no link between groups is lost; a pair comes from the first bucket that both share, and pairs
   inside a group can't change the result and are not made. The group of the centre, which holds most of a large bucket,
   is dealt apart from the rest and only meets the rest. Buckets of one centre mostly hold the same classes: they meet
   together, each class once, if that makes no more pairs than the buckets apart.

Buckets and classes of any size are joined by common.spread_join(), which no hot key makes uneven.

With 32 bands of 4 components a pair at similarity 0.8 misses every band with probability 5e-8.

Defined results: null or empty text has no shingles and is linked with nothing; texts with fewer words than a
shingle are one shingle; a null doc_id has component_id null and is kept; rows that repeat a doc_id are the same
document; an empty table gives an empty result; columns other than the two named ones are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common, hashing
from loomgraph.llm.common import spread_join, stage
from loomgraph.llm.components import connected_components
from loomgraph.llm.hashing import LOWER, NOT_SPACE, U, WORD_BASE, mix

BANDS, ROWS = 32, 4
#: Elements whose permutations are held at once.
ELEMENTS = 1 << 17
#: Estimated similarity under which a pair is not verified: over five standard deviations below 0.8.
FAR = 0.2
#: Members of a bucket that meet in one grid cell, from either side, if it has up to 16 times as many.
CHUNK = 256
#: Bits of the filter that keeps documents without candidates out of the shuffle; a full one lets all pass.
FILTER_BITS = 1 << 26


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles."""
    data = LOWER[data]
    starts, ends, before = hashing.words(data, offsets, NOT_SPACE)
    h = hashing.word_hashes(data, starts, ends)
    sums = hashing.prefix(h, WORD_BASE)
    full = hashing.grams(sums, WORD_BASE, size)
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(full[a : b - size + 1]))
        elif b > a:  # marked with its length, so that it differs from every full shingle
            out.append(hashing.grams(sums, WORD_BASE, b - a, np.array([a])) ^ U(b - a))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures (sets x m, uint64): rank in the upper half, random tie-break in the lower. Empty sets keep the largest value."""
    out = np.full((len(sets), m), np.iinfo(np.uint64).max, np.uint64)
    parts = [(k, s[a : a + ELEMENTS]) for k, s in enumerate(sets) for a in range(0, len(s), ELEMENTS)]
    at = 0
    while at < len(parts):
        end, held = at, 0
        while end < len(parts) and (end == at or held + len(parts[end][1]) <= ELEMENTS):
            held += len(parts[end][1])
            end += 1
        own, elements = [k for k, _ in parts[at:end]], [p for _, p in parts[at:end]]
        sig = _signatures(np.concatenate(elements), np.repeat(np.arange(len(own)), [len(e) for e in elements]), len(own), m)
        np.minimum.at(out, np.array(own), sig)
        at = end
    return out


def _signatures(h: np.ndarray, row: np.ndarray, rows: int, m: int) -> np.ndarray:
    sig = np.full(rows * m, np.iinfo(np.uint64).max, np.uint64)
    dealt = np.tile(np.arange(m, dtype=np.uint16 if m > 256 else np.uint8), (len(h), 1))
    live = np.arange(len(h))
    for j in range(m):
        u = mix(h[live] + U(j * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = j + ((u & U(0xFFFFFFFF)) * U(m - j) >> U(32)).astype(np.int64)
        p = dealt[live, k]
        dealt[live, k] = dealt[live, j]
        np.minimum.at(sig, row[live] * m + p, (U(j) << U(32)) | (u >> U(32)))
        # ranks to come are j + 1 and more: rows whose largest component is below are done
        open_rows = sig.reshape(rows, m).max(1) >= U(j + 1) << U(32)
        live = live[open_rows[row[live]]]
        if not len(live):
            break
    return sig.reshape(rows, m)


def _signed(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.texts(batch.column(1))
            for a, b in hashing.slices(offsets, common.SLICE_BYTES):
                sets = shingle_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                sig = superminhash(sets, bands * rows)
                keys = np.zeros((b - a, bands), np.uint64)
                for r in range(rows):
                    keys = mix(keys * U(0xC2B2AE3D27D4EB4F) + sig[:, r::rows] + np.arange(bands, dtype=np.uint64))
                byte = np.ascontiguousarray((mix(sig) >> U(56)).astype(np.uint8))
                n = np.array([len(s) for s in sets], np.int64)
                fp = [np.array([int(mix(s ^ U(salt)).sum(dtype=np.uint64)) for s in sets], np.uint64).view(np.int64) for salt in (0x1B873593, 0x85EBCA6B)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n), pa.array(fp[0]), pa.array(fp[1]), pa.array([x.tobytes() + k.tobytes() for x, k in zip(byte, (keys >> U(32)).astype(np.uint32), strict=True)], pa.binary()), pa.array(list(keys.view(np.int64)), pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "fp1", "fp2", "sig", "bands"],
                )

    return run


def _signature_bytes(column, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row a byte for each of the m components, and the upper halves of its band keys."""
    both = common.texts(column)[0].reshape(len(column), -1)
    return both[:, :m], np.ascontiguousarray(both[:, m:]).view(np.uint32)


def _near(threshold: float, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (_signature_bytes(batch.column(c), m)[0] for c in ("sig_a", "sig_b"))
            keep = (x == y).mean(1) >= threshold - FAR
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in ("a", "b")], names=["a", "b"])

    return run


def _bit_filter(ids: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS bits on ids; its size doesn't depend on their number."""
    slot = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    words = ids.select(F.floor(slot / 32).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(32)).cast("int")).alias("bit"))
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint32)
    return out


class _Verifier:
    """Verifies pairs of classes on their full shingle sets; sets are worked out anew for the classes that need it."""

    def __init__(self, docs: DataFrame, reps: DataFrame, size: int, percent: int):
        self.docs, self.reps, self.size, self.percent = docs, reps, size, percent

    def sets(self, ids: DataFrame) -> DataFrame:
        """(id, shingles) of the ids, staged."""
        ids = ids.distinct()
        words, size = self.docs.sparkSession.sparkContext.broadcast(_bit_filter(ids)), self.size
        slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))

        def make(batches):
            for batch in batches:
                at = batch.column("slot").to_numpy()
                keep = words.value[at >> 5] >> (at & 31).astype(np.uint32) & np.uint32(1)
                batch = batch.select(["doc_id", "text"]).filter(pa.array(keep.astype(bool)))
                data, offsets = common.texts(batch.column(1))
                for a, b in hashing.slices(offsets, common.SLICE_BYTES):
                    sets = shingle_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"])

        found = self.docs.where("doc_id is not null").withColumn("slot", slot).mapInArrow(make, "id long, shingles binary")
        return stage(found.join(ids, "id", "left_semi").dropDuplicates(["id"]), "sets")

    def __call__(self, pairs: DataFrame) -> DataFrame:
        percent = self.percent
        sets = self.sets(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))))

        def verify(batches):
            for batch in batches:
                keep = []
                for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                    x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (x, y))
                    both = np.concatenate([x, y])
                    both.sort(kind="stable")
                    shared = int((both[1:] == both[:-1]).sum())
                    keep.append(100 * shared >= percent * (len(both) - shared))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        paired = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")), "b")
        return stage(paired.select("a", "b", "set_a", "set_b").mapInArrow(verify, "a long, b long"), "links")


def near_duplicates(docs: DataFrame, shingle_words: int = 2, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id long, n_shingles long, component_id long, kept boolean, one row for each row of docs.

    Documents are linked if 100 * shared shingles >= percent * shingles of either; component_id is the
    smallest doc_id that links reach."""
    docs = common.bounded(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    signed = stage(docs.mapInArrow(_signed(shingle_words, bands, rows), "doc_id long, n_shingles long, fp1 long, fp2 long, sig binary, bands array<long>").withColumn("row", F.monotonically_increasing_id()), "signed")
    with_set = signed.where("n_shingles > 0 and doc_id is not null")
    same = ["fp1", "fp2", "n_shingles"]
    # any row of a class has its signature: the class is counted on whole numbers, and takes the rest from one row
    found = with_set.groupBy(*same).agg(F.min("doc_id").alias("id"), F.min("row").alias("row"), F.count("*").alias("n_rows"))
    classes = stage(found.join(signed.select("row", "sig", "bands"), "row").drop("row"), "classes")
    signatures = classes.select("id", "sig")
    near = _near(percent / 100, bands * rows)

    def promising(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose signatures are near enough."""
        both = pairs.join(signatures.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a").join(signatures.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")
        return both.select("a", "b", "sig_a", "sig_b").mapInArrow(near, "a long, b long")

    members = classes.select("id", F.posexplode("bands").alias("band", "key"))
    # the centre of a bucket is its member with the smallest hash, the same for all bands that a group shares
    buckets = members.groupBy("band", "key").agg(F.count("*").alias("n"), F.min(F.xxhash64("id")).alias("h")).where("n > 1")
    buckets = stage(buckets, "buckets")
    members = spread_join(members.withColumn("own", F.xxhash64("id")), buckets, ["band", "key"], "n")
    members = stage(members, "members")

    # equal hashes of two ids would only make two centres
    centres = members.where("own = h").select("id", "h").distinct()
    star = members.where("own <> h").select("id", "h").distinct().join(centres.withColumnRenamed("id", "centre"), "h")
    star = star.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    verify = _Verifier(docs, classes, shingle_words, percent)
    links = verify(stage(promising(star), "pairs"))
    groups = stage(connected_components(links), "groups")

    def grouped(frame: DataFrame) -> DataFrame:
        return frame.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))

    left = stage(grouped(members.select("id", "band", "key", "own", "h")), "left")
    left = left.withColumn("centre", F.col("own") == F.col("h")).drop("own")
    several = stage(_several(left), "several")
    # what meets around one centre: the buckets apart, or all of them at once if that makes no more pairs
    around = spread_join(left, several.select("band", "key", "n"), ["band", "key"], "n").groupBy("h", "id")
    around = around.agg(F.min("component").alias("component"), F.max("centre").alias("centre"), F.bit_or(_bit("band")).alias("mask"))
    around = stage(around.withColumn("band", F.lit(-1)).withColumn("key", F.col("h")), "around")
    squares = several.groupBy("h").agg(F.sum(F.col("n").cast("double") ** 2).alias("squares"))
    merged = stage(_several(around).join(squares, "h").where("double(n) * n <= squares").drop("squares"), "merged")
    apart = spread_join(left.withColumn("mask", _bit("band")).drop("h", "centre"), several.join(merged, "h", "left_anti").drop("h"), ["band", "key"], "n")
    joint = spread_join(around.drop("h", "centre"), merged.drop("h"), ["band", "key"], "n")
    members_left = _promising_members(apart.unionByName(joint), signatures, percent / 100, bands * rows)
    members_left = stage(members_left, "promising")
    if not members_left.isEmpty():
        more = _verified_across(members_left, verify.sets(members_left.select("id")), percent, percent / 100, bands * rows)
        groups = stage(connected_components(links.unionByName(stage(more, "links"))), "groups")

    reps = grouped(classes.select(*same, "id", "n_rows")).select(*same, "component", "n_rows")
    out = spread_join(with_set.select("doc_id", *same), reps, same, "n_rows").select("doc_id", "n_shingles", "component")
    # texts without shingles and rows without an id are linked with nothing
    alone = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    out = out.unionByName(alone)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def _bit(band: str):
    """The bit of a band in a mask; bands that are 64 apart share one."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col(band), F.lit(64)))


def _several(members: DataFrame) -> DataFrame:
    """Of the buckets (band, key) that hold several groups: h of their centre, members, the centre's group and its members."""
    parts = members.groupBy("band", "key", "component").agg(F.min("h").alias("h"), F.count("*").alias("n"), F.max("centre").alias("major"))
    buckets = parts.groupBy("band", "key").agg(F.count("*").alias("parts"), F.min("h").alias("h"), F.sum("n").alias("n"), F.max(F.when(F.col("major"), F.col("component"))).alias("major"), F.max(F.when(F.col("major"), F.col("n"))).alias("n_major"))
    return buckets.where("parts > 1").drop("parts")


def _candidates(table: pa.Table, threshold: float, m: int):
    """For each class i of the first chunk of a grid cell (i, classes j of the second): pairs of different groups whose
    signatures are near, and whose first shared band is one of those that meet in the cell."""
    ids, component, mask = (table.column(c).to_numpy() for c in ("id", "component", "mask"))
    sig, keys = _signature_bytes(table.column("sig"), m)
    chunk = table.column("chunk").to_numpy()
    x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
    cols = np.flatnonzero(chunk == y)
    for i in np.flatnonzero(chunk == x):
        js = cols[(component[cols] != component[i]) & ((ids[cols] > ids[i]) if x == y else True)]
        js = js[(sig[js] == sig[i]).mean(1) >= threshold - FAR] if len(js) else js
        if len(js):
            shared = keys[js] == keys[i]
            js = js[shared.any(1) & ((mask[i] & mask[js]) >> (shared.argmax(1) & 63) & 1 == 1)]
        if len(js):
            yield int(i), js


_CELL = "band int, key long, cell long, x int, y int, id long, component long, mask long, sig binary, chunk int"


def _by_cell(rows: DataFrame, work, schema: str) -> DataFrame:
    """What work() makes of the rows of each cell. The cells of a bucket have numbers in a row, and are dealt out by these: a hash
    would pile up several in one task."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("slot", F.pmod(F.col("cell"), F.lit(tasks)).cast("int")).repartitionById(tasks, "slot")
    return dealt.groupBy("slot", "band", "key", "x", "y").applyInArrow(work, schema)


def _promising_members(left: DataFrame, signatures: DataFrame, threshold: float, m: int) -> DataFrame:
    """Members of buckets that hold several groups, dealt into a grid of chunks; of each cell, those that are near a
    member of another group. A row for each member and cell, however many pairs there are. Chunks have CHUNK members, and
    grow with the root of larger buckets, so n members make rows as n**1.5.

    The centre's group has chunks -1, -2, ... that only meet those of the other groups, 0, 1, ..."""
    size = CHUNK * F.greatest(F.lit(1.0), F.sqrt(F.col("n") / (16 * CHUNK)))
    chunks = lambda n: F.ceil(n / size).cast("int")
    rest, own = chunks(F.col("n") - F.col("n_major")), chunks(F.col("n_major"))
    major = F.col("component") == F.col("major")
    dealt = lambda n: F.pmod(F.xxhash64("id", F.lit(7)), n).cast("int")
    others = F.sequence(F.lit(0), rest - 1)
    rows = left.withColumn("chunk", F.when(major, -1 - dealt(own)).otherwise(dealt(rest)))
    rows = rows.withColumn("other", F.explode(F.when(major, others).otherwise(F.concat(others, F.sequence(-own, F.lit(-1))))))
    rows = rows.withColumn("first", F.pmod(F.xxhash64("band", "key"), F.lit(1 << 32))).withColumn("own", F.coalesce(own, F.lit(0)).cast("long")).withColumn("rest", rest.cast("long"))
    rows = rows.select("band", "key", "first", "own", "rest", "id", "component", "mask", "chunk", "other").join(signatures, "id")
    x, y = F.least("chunk", "other"), F.greatest("chunk", "other")
    rows = rows.select("band", "key", (F.col("first") + (x + F.col("own")) * F.col("rest") + y).alias("cell"), x.alias("x"), y.alias("y"), "id", "component", "mask", "sig", "chunk")

    def meet(table: pa.Table) -> pa.Table:
        hit = np.zeros(table.num_rows, bool)
        for i, js in _candidates(table, threshold, m):
            hit[i] = True
            hit[js] = True
        return table.drop_columns("slot").filter(pa.array(hit))

    return _by_cell(rows, meet, _CELL)


def _verified_across(members: DataFrame, sets: DataFrame, percent: int, threshold: float, m: int) -> DataFrame:
    """Links (a, b) between groups, verified in their grid cell on full sets; a pair whose groups have been linked in the
    cell before is left out, as it can't change the components."""

    def verify(table: pa.Table) -> pa.Table:
        ids, component = table.column("id").to_numpy(), table.column("component").to_pylist()
        full = [np.frombuffer(s.as_py(), np.uint64) for s in table.column("shingles")]
        parent = {c: c for c in component}

        def find(c):
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        a, b = [], []
        for i, js in _candidates(table, threshold, m):
            for j in js.tolist():
                p, q = find(component[i]), find(component[j])
                if p == q:
                    continue
                both = np.concatenate([full[i], full[j]])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    parent[max(p, q)] = min(p, q)
                    a.append(min(ids[i], ids[j]))
                    b.append(max(ids[i], ids[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return _by_cell(members.join(sets, "id").select("band", "key", "cell", "x", "y", "id", "component", "mask", "sig", "chunk", "shingles"), verify, "a long, b long")


def distinct_groups(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that near_duplicates() keeps, one for each kept document; rows without an id all stay.

    Join and deduplication have the same key, so the texts are shuffled once."""
    own = "kept_id"
    while own in docs.columns:
        own += "_"
    kept = found.where("kept and doc_id is not null").select(F.col("doc_id").alias(own)).distinct()
    rows = docs.withColumn(own, F.col(id_col).cast("long"))
    once = rows.where(F.col(own).isNotNull()).join(kept, own, "left_semi").dropDuplicates([own])
    return once.select(*docs.columns).unionByName(rows.where(F.col(own).isNull()).select(*docs.columns))


__all__ = ["distinct_groups", "near_duplicates", "shingle_hashes", "superminhash"]
