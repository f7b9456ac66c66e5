"""Toxicity by averaged subword embeddings and a linear softmax, trained jointly in numpy.

A word is a bag of byte n-grams of its lower-cased spelling with boundary marks, hashed into buckets with embeddings.
The embeddings of a text's bag are averaged, and a linear softmax gives the odds of label 1; a misspelling
shares most n-grams with the word it distorts. The odds are calibrated on the training rows.

With `window_words` a text is not one bag but a bag for each window of that many words, and it is as toxic as its worst
window: a few toxic words don't vanish in the average of a long text. The windows of a toxic text bear its label first;
then the embeddings are trained on its worst windows only, as most of its windows are harmless.

The score of a bag is linear in its n-grams, so prediction needs one number for each bucket.

Training takes a bounded sample of labelled rows (TRAIN_ROWS of each label, in the order of a hash, with at most
TRAIN_CHARS characters, one text for each id); prediction sees the whole text and nothing else.

Defined results: null or empty texts, and texts without words, have the score of an empty bag, that of bias and prior
alone; so has every text if no row is labelled; rows of labels that repeat a doc_id count as toxic if any is; of rows of
docs that repeat a labelled id the smallest text is learned from; repeated rows and null ids are kept as they are; an empty
table gives an empty result; columns other than the named ones are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common, hashing

#: Labelled rows of each label used for training at most, and their longest text in characters.
TRAIN_ROWS, TRAIN_CHARS = 3000, 20_000
#: Lengths of n-grams, buckets (as a power of two) and embedding dimensions.
GRAMS, BUCKET_BITS, DIM = (3, 4, 5, 6), 18, 12
#: A bucket learns only if this many training texts have it, whatever their number: rarer ones would memorise texts.
LEAST_TEXTS = 5
#: Words of a window where whole texts lose too many toxic ones (README has the figures of both forms).
WORST_WINDOW = 3
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_SPACE = np.uint8(32)


@dataclass
class Model:
    """A number for each bucket (embedding times softmax weights), the bias, and the calibration of the worst window."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    window_words: int | None = None


def _spelled(column) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with one space for every byte outside words, and a space before each row; offsets of rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    low = pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))
    data, offsets = common.texts(pc.binary_join_element_wise(pa.scalar("", pa.large_string()), low, pa.scalar(" ", pa.large_string())))
    # " " + text of each row: the joiner stands before it
    return np.where(IN_WORD[data], data, _SPACE), offsets


class _Bags:
    """n-gram buckets of a slice of texts, whole or in windows of window_words words. A space ends the slice, so that last
    words have an end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window_words: int | None):
        data = np.append(data, _SPACE)
        word = data != _SPACE
        first = word.copy()
        first[1:] &= ~word[:-1]
        self.starts = np.flatnonzero(first)
        before = np.searchsorted(self.starts, offsets)
        counts = np.diff(before)
        self.valid, self.bucket = [], []
        n = len(data)
        d = data.astype(np.uint32)
        h = np.zeros(n, np.uint32)
        inner = np.ones(n, bool)  # bytes 1 .. length - 2 of the gram are in one word
        for length in range(1, max(GRAMS) + 1):
            m = n - length + 1
            if m <= 0:
                break
            h = h[:m] * np.uint32(0x01000193) + d[length - 1 :][:m] + np.uint32(1)
            if length >= 3:
                inner = inner[:m] & word[length - 2 :][:m]
                if length in GRAMS:
                    self.valid.append(inner)
                    mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                    self.bucket.append((mixed >> np.uint32(32 - BUCKET_BITS)).astype(np.int32))
        size = window_words or len(data)
        self.windows = np.maximum(-(-counts // size), 1)
        self.row = np.repeat(np.arange(len(counts)), self.windows)
        place = np.arange(len(self.row)) - np.repeat(np.cumsum(self.windows) - self.windows, self.windows)
        k = before[:-1][self.row] + size * place
        # a window goes from the space before its first word to that of the next window's
        self.lo = np.where(place > 0, self.starts[np.minimum(k, len(self.starts) - 1)] - 1 if len(self.starts) else 0, offsets[:-1][self.row])
        last = np.append(self.row[1:] != self.row[:-1], True)
        self.hi = np.where(last, offsets[1:][self.row], np.append(self.lo[1:], 0))

    def sums(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window the sum of the weights of its n-grams, and their number."""
        n = len(self.valid[0]) if self.valid else 0
        value, count = np.zeros(n + 1), np.zeros(n + 1, np.int64)
        for valid, bucket in zip(self.valid, self.bucket, strict=True):
            value[1 : len(bucket) + 1] += np.where(valid, weights[bucket], 0)
            count[1 : len(bucket) + 1] += valid
        np.cumsum(value, out=value)
        np.cumsum(count, out=count)
        lo, hi = np.minimum(self.lo, n), np.minimum(self.hi, n)
        return value[hi] - value[lo], count[hi] - count[lo]

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, window) of every n-gram."""
        at = [np.flatnonzero(v) for v in self.valid]
        places = np.concatenate(at) if at else np.empty(0, np.int64)
        buckets = np.concatenate([b[a] for a, b in zip(at, self.bucket, strict=True)]) if at else np.empty(0, np.int32)
        return buckets, np.searchsorted(self.lo, places, "right") - 1


def _logits(bags: _Bags, model_weights: np.ndarray, bias: float) -> np.ndarray:
    total, count = bags.sums(model_weights)
    return total / np.maximum(count, 1) + bias


def _worst(bags: _Bags, logits: np.ndarray) -> np.ndarray:
    return np.maximum.reduceat(logits, np.cumsum(bags.windows) - bags.windows)


def train(texts: list[str], labels: list[int], prior: float = 0.5, epochs: int = 5, batch: int = 48, rate: float = 1.5, seed: int = 0, window_words: int | None = None) -> Model:
    """Fits embeddings and softmax to texts; prior is the share of label 1 among all labelled rows."""
    weights = np.zeros(1 << BUCKET_BITS, np.float32)
    if not texts:
        return Model(weights, 0.0, 1.0, -1.0, window_words)
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, float)
    embed = rng.normal(0, 0.05, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.5, DIM).astype(np.float32)  # of label 1 against label 0
    bias, seen = 0.0, np.full(1 << BUCKET_BITS, 1e-6, np.float32)
    column = pa.array(texts, pa.large_string())
    frequent = _text_counts(column, batch, window_words) >= LEAST_TEXTS
    embed[~frequent] = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), batch):
            pick = np.sort(order[k : k + batch])
            bags = _Bags(*_spelled(column.take(pa.array(pick))), window_words)
            bucket, window = bags.items()
            n = len(bags.row)
            count = np.maximum(np.bincount(window, minlength=n), 1)
            now = embed @ out
            logit = np.bincount(window, now[bucket], n) / count + bias
            target = y[pick][bags.row]
            share = 1 / bags.windows[bags.row]
            if epoch:
                # of a toxic text, the worst window and those that already look toxic
                worst = _worst(bags, logit)[bags.row]
                share = np.where(target > 0, (logit >= np.minimum(worst, 2.0)).astype(float), 1 / np.sqrt(bags.windows[bags.row]))
            delta = (1 / (1 + np.exp(-logit)) - target) * share
            pull = np.bincount(bucket, (delta / count)[window], 1 << BUCKET_BITS).astype(np.float32) * frequent
            mean = np.zeros(DIM)
            for d in range(DIM):
                mean[d] = float(pull @ embed[:, d])
            touched = np.flatnonzero(pull)
            seen[touched] += pull[touched] ** 2
            embed[touched] -= rate * (pull[touched] / np.sqrt(seen[touched]))[:, None] * out
            out -= (rate * 0.05 * mean / max(len(pick), 1)).astype(np.float32)
            bias -= rate * 0.2 * float(delta.mean())
    weights = (embed @ out).astype(np.float32)
    worst = np.empty(len(texts))
    for k in range(0, len(texts), batch):
        bags = _Bags(*_spelled(column.slice(k, batch)), window_words)
        worst[k : k + batch] = _worst(bags, _logits(bags, weights, bias))
    slope, shift = _calibrated(worst, y, prior)
    return Model(weights, bias, slope, shift, window_words)


def _text_counts(column: pa.Array, batch: int, window_words: int | None) -> np.ndarray:
    """For each bucket the number of texts that have it."""
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    for k in range(0, len(column), batch):
        bags = _Bags(*_spelled(column.slice(k, batch)), window_words)
        bucket, window = bags.items()
        pairs = np.unique(bags.row[window].astype(np.int64) << BUCKET_BITS | bucket)
        out += np.bincount(pairs & ((1 << BUCKET_BITS) - 1), minlength=1 << BUCKET_BITS)
    return out


def _calibrated(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Logistic regression of y on x, with the labels weighted to their prior; slope is positive."""
    share = y.mean()
    if share in (0, 1):
        return 1.0, 4.0 if share else -4.0
    weight = np.where(y > 0, prior / share, (1 - prior) / (1 - share))
    mid, spread = x.mean(), x.std() + 1e-9
    z, a, b = (x - mid) / spread, 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([(weight * (p - y) * z).mean() + 1e-4 * a, (weight * (p - y)).mean()])
        s = weight * p * (1 - p)
        hess = np.array([[(s * z * z).mean() + 1e-4, (s * z).mean()], [(s * z).mean(), s.mean()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    a = max(a, 1e-3)
    return float(a / spread), float(b - a * mid / spread)


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", window_words: int | None = None) -> Model:
    """Trains on labelled rows; usable (on labels) says which may be learned from."""
    rows = labels if usable is None else labels.where(usable)
    rows = rows.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("_y"))
    n, n_toxic = rows.agg(F.count("*"), F.sum("_y")).first()
    if not n:
        return train([], [], window_words=window_words)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).where(F.length("_text").between(1, TRAIN_CHARS))
    # a fixed number of ids is broadcast, and as many texts of bounded length are learned from
    picked = rows.where("_y = 1").orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_ROWS).unionByName(rows.where("_y = 0").orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_ROWS))
    once = texts.join(F.broadcast(picked), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text"))
    prior = (n_toxic + 1) / (n + 2)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in ("_id", "_text", "_y")), strict=True))
        model = train([t for _, t, _ in found], [y for _, _, y in found], prior, window_words=window_words)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), *(pa.array([x], pa.float64()) for x in (model.bias, model.slope, model.shift))], names=["weights", "bias", "slope", "shift"])

    # one task learns, so that neither the texts nor what training needs are in the driver's memory
    row = common.bounded(once).coalesce(1).mapInArrow(learn, "weights binary, bias double, slope double, shift double").first()
    if row is None:  # no rows, no task
        return train([], [], prior, window_words=window_words)
    return Model(np.frombuffer(row.weights, np.float32), row.bias, row.slope, row.shift, window_words)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id long, score double between 0 and 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1), shared.value))], names=["doc_id", "score"])

    return common.bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is below the threshold, with all their columns."""
    place, shared = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(place), shared.value) < threshold))

    return common.bounded(docs).mapInArrow(run, docs.schema)


def scores(column, model: Model) -> np.ndarray:
    """Scores of an Arrow string column."""
    out = np.empty(len(column))
    _, offsets = common.texts(column)
    for a, b in hashing.slices(offsets, common.SLICE_BYTES):
        bags = _Bags(*_spelled(column.slice(a, b - a)), model.window_words)
        out[a:b] = _worst(bags, _logits(bags, model.weights, model.bias))
    return 1 / (1 + np.exp(-np.clip(model.slope * out + model.shift, -40, 40)))
