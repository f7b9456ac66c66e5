"""Language identification by a small byte convolutional network, trained in numpy.

Text is cut into windows of WINDOW bytes. Filters of several widths run over the embedded bytes of a window, the
maximum over the window is taken, and a linear softmax names the language; a text's probabilities are
the mean over all its windows, weighted by their bytes. For prediction the embedding and the filters are
multiplied out into tables by byte pairs, so that a filter costs one or two lookups a byte.

Training takes windows at hashed places of a bounded sample of labelled rows (TRAIN_ROWS, dealt evenly by language and
ordered by a hash, so the same for any partitioning). Prediction sees the whole text and nothing else.

Defined results: a text that is null or has no letter is `und` with score 0; so is every text if no row is labelled;
the longest texts are worked through in slices; repeated rows and a null doc_id are kept as they are; an empty table
gives an empty result; columns other than the named ones are never looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm import common, hashing

#: Bytes of a window; labelled rows used for training at most, and windows taken from each.
WINDOW, TRAIN_ROWS, WINDOWS_EACH = 256, 6000, 2
WIDTHS, FILTERS, EMBED = (2, 3, 4), 8, 8


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter (Unicode category L), as \\p{L} in Spark."""
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Network:
    """Byte embedding, filters by width (width * EMBED x FILTERS), and the softmax layer."""

    labels: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """For each width, tables (FILTERS x 256 or 65536) of what one byte or a pair of bytes adds."""
        made = []
        for width, w in zip(WIDTHS, self.filters, strict=True):
            single = [(self.embed @ w[j * EMBED : (j + 1) * EMBED]).T.astype(np.float32) for j in range(width)]
            made.append([np.ascontiguousarray((a[:, None, :] + b[:, :, None]).reshape(FILTERS, -1)) for a, b in zip(single[::2], single[1::2], strict=False)] + ([np.ascontiguousarray(single[-1])] if width % 2 else []))
        return made

    def probabilities(self, tables, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of the windows data[start:end]; windows follow each other and cover data."""
        n = len(data)
        pair = data[:-1].astype(np.uint16) | (data[1:].astype(np.uint16) << np.uint16(8)) if n > 1 else np.empty(0, np.uint16)
        features = np.zeros((len(starts), len(WIDTHS) * FILTERS), np.float32)
        for w, width in enumerate(WIDTHS):
            if n < width:
                continue
            m = n - width + 1
            codes = [(pair if t.shape[1] > 256 else data)[2 * k : 2 * k + m] for k, t in enumerate(tables[w])]
            # places whose gram would leave its window
            over = (ends[:, None] - np.arange(1, width)[None, :]).ravel()
            over = over[(over >= 0) & (over < m)]
            first = np.minimum(starts, m - 1)
            fits = ends - starts >= width
            for f in range(FILTERS):
                value = tables[w][0][f][codes[0]]
                for t, c in zip(tables[w][1:], codes[1:], strict=True):
                    value += t[f][c]
                value[over] = -np.inf
                top = np.maximum.reduceat(value, first)
                features[:, w * FILTERS + f] = np.where(fits, np.maximum(top + self.bias[w][f], 0), 0)
        z = features @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train(windows: list[bytes], labels: list[str], steps: int = 700, batch: int = 96, rate: float = 0.01, seed: int = 0) -> Network | None:
    """A network fitted by Adam to windows and their labels; None without any."""
    names = sorted(set(labels))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    x = np.zeros((len(windows), WINDOW), np.uint8)
    for i, w in enumerate(windows):
        x[i, : len(w[:WINDOW])] = np.frombuffer(w[:WINDOW], np.uint8)
    y = np.searchsorted(names, labels)
    net = Network(names, rng.normal(0, 0.5, (256, EMBED)), [rng.normal(0, (2 / (k * EMBED)) ** 0.5, (k * EMBED, FILTERS)) for k in WIDTHS], [np.zeros(FILTERS) for _ in WIDTHS], rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(names))), np.zeros(len(names)))
    params = [net.embed, *net.filters, *net.bias, net.out, net.out_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(x), batch)
        xb, rows = x[pick], np.arange(batch)
        e = net.embed[xb]
        pooled, tops, grams = [], [], []
        for k, w, b in zip(WIDTHS, net.filters, net.bias, strict=True):
            m = WINDOW - k + 1
            cols = np.concatenate([e[:, j : j + m] for j in range(k)], axis=2)
            z = cols @ w + b
            top = z.argmax(1)
            grams.append(cols[rows[:, None], top])  # batch x FILTERS x k * EMBED
            tops.append(top)
            pooled.append(np.take_along_axis(z, top[:, None], 1)[:, 0])
        h = np.concatenate(pooled, 1)
        act = np.maximum(h, 0)
        p = act @ net.out + net.out_bias
        p = np.exp(p - p.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[rows, y[pick]] -= 1
        p /= batch
        back = (p @ net.out.T) * (h > 0)
        g_embed, g_filters, g_bias = np.zeros_like(net.embed), [], []
        for w, (k, top, gram) in enumerate(zip(WIDTHS, tops, grams, strict=True)):
            g = back[:, w * FILTERS : (w + 1) * FILTERS]
            g_filters.append(np.einsum("bf,bfc->cf", g, gram))
            g_bias.append(g.sum(0))
            to = (g[:, :, None] * net.filters[w].T[None]).reshape(batch, FILTERS, k, EMBED)
            at = xb[rows[:, None, None], top[:, :, None] + np.arange(k)]
            np.add.at(g_embed, at.ravel(), to.reshape(-1, EMBED))
        grads = [g_embed, *g_filters, *g_bias, act.T @ p, p.sum(0)]
        now = rate * (1 - step / (steps + 1))
        for q, g, a, s in zip(params, grads, first, second, strict=True):
            a += 0.1 * (g - a)
            s += 0.001 * (g * g - s)
            q -= now * (a / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


def _quotas(counts: dict[str, int]) -> dict[str, int]:
    """Of TRAIN_ROWS rows an equal part for each language, and one row at least; what small ones leave goes to the others."""
    out, left = {}, TRAIN_ROWS
    for k, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, max(left // (len(counts) - k), 1))
        left -= out[lang]
    return out


def fit(docs: DataFrame, usable: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Network | None:
    """Trains on the usable rows that have an id, a label and a text: excerpts of TRAIN_ROWS rows, dealt by label, come to the driver."""
    text, key = F.col(text_col), F.col(id_col).cast("string")
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & text.rlike(r"\p{L}"))
    place = lambda k: F.pmod(F.xxhash64(F.lit(k), key), F.greatest(F.length(text) - WINDOW, F.lit(0)) + 1) + 1
    cut = lambda k: F.encode(F.substring(text, place(k).cast("int"), F.lit(WINDOW)), "UTF-8").alias(f"w{k}")
    hashed = rows.select(F.xxhash64(F.lit("train"), key).alias("h"), F.col(lang_col).cast("string").alias("lang"), *(cut(k) for k in range(WINDOWS_EACH)))
    # every task would send TRAIN_ROWS rows: only hashes that some 2 * quota rows of a language fall below are sent, more if too few are found
    counts = {r[0]: r[1] for r in docs.where(usable & F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).cast("string")).count().collect()}
    quota, picked = _quotas(counts), []
    share = {lang: 2 * quota[lang] / counts[lang] for lang in quota}
    todo = set(quota)
    while todo:
        bounds = [(lang, quota[lang], min(int(share[lang] * 2.0**64) - 2**63, 2**63 - 1)) for lang in sorted(todo)]
        limits = docs.sparkSession.createDataFrame(bounds, "lang string, quota int, bound long")  # a row for each language
        place_in = F.row_number().over(Window.partitionBy("lang").orderBy("h", *(f"w{k}" for k in range(WINDOWS_EACH))))
        rows_now = hashed.join(F.broadcast(limits), "lang").where("h <= bound").withColumn("k", place_in).where("k <= quota").drop("quota", "bound").collect()
        found = Counter(r.lang for r in rows_now)
        done = {lang for lang in todo if found[lang] >= quota[lang] or share[lang] >= 1}
        picked += [r for r in rows_now if r.lang in done]
        todo -= done
        share = {lang: 4 * x for lang, x in share.items()}
    picked.sort(key=lambda r: (r.h, r.lang, r.k))
    pairs = [(bytes(r[f"w{k}"]), r.lang) for r in picked for k in range(WINDOWS_EACH)]
    return train([w for w, _ in pairs], [lang for _, lang in pairs])


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id long, lang_pred string, score double (the mean probability of lang_pred)."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size, but for a column for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.tables() if net else None
        for batch in batches:
            texts = batch.column(1)
            data, offsets = common.texts(texts)
            for a, b in hashing.slices(offsets, common.SLICE_BYTES):
                names, scores = ["und"] * (b - a), np.zeros(b - a)
                letters = [k for k in range(b - a) if has_letter(texts[a + k].as_py())]
                if net and letters:
                    total = _means(net, tables, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    best = total.argmax(1)
                    for k in letters:
                        names[k], scores[k] = net.labels[best[k]], min(max(float(total[k, best[k]]), 0.0), 1.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return common.bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def _means(net: Network, tables, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probabilities of each row, as the mean over its windows; a row longer than a slice is worked through in pieces."""
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), len(net.labels)))
    counts = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), counts)
    starts = offsets[:-1][row] + WINDOW * (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts))
    ends = np.minimum(starts + WINDOW, offsets[1:][row])
    step = max(common.SLICE_BYTES // WINDOW, 1)
    for k in range(0, len(starts), step):
        s, e = starts[k : k + step], ends[k : k + step]
        p = net.probabilities(tables, data[s[0] : e[-1]], s - s[0], e - s[0])
        np.add.at(out, row[k : k + step], p * (e - s)[:, None])
    return out / np.maximum(sizes, 1)[:, None]
