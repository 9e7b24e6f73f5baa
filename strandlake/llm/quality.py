"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are counted from the bytes of whole texts, many texts at a time.
Trees are grown on the driver from a bounded sample of labelled rows
(``TRAIN_ROWS``, those of smallest hash) and flattened into arrays of features,
thresholds and leaf values, which numpy walks level by level for a batch of
documents and all trees.

Null and empty texts get the score of their statistics, all zero. Labels that
are null, and rows of labels without a document, are not learned from; of
several labels of a document the largest counts, and of several texts of one id one is learned from.
Repeated rows are scored each. With no
label, or one kind only, every score is the share of label 1, or 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import held_out, mix64, text_steps, word_hashes
from strandlake.session import ship

TRAIN_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAST = 80, 4, 0.15, 64, 20.0

_KIND = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:?'\"-()", b"!", b"|", b"#$%&*@+=~^_/\\<>[]{}`")):
    _KIND[list(_chars)] = _k + 1
KINDS = 10
_CONTINUES = (np.arange(256) & 0xC0) == 0x80


def _by_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values by text, from offsets."""
    total = np.concatenate(([0], np.cumsum(values)))
    return (total[at[1:]] - total[at[:-1]]).astype(np.float64)


def _repeats(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and the count of the most frequent one, by text."""
    n = len(at) - 1
    text = np.repeat(np.arange(n), np.diff(at))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    most = np.zeros(n)
    np.maximum.at(most, text[begin], np.diff(np.append(begin, len(h))))
    return np.bincount(text[begin], minlength=n).astype(np.float64), most


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Statistics of each text, (n, features)."""
    n = len(off) - 1
    size = np.diff(off).astype(np.float64)
    per = np.maximum(size, 1)
    text = np.repeat(np.arange(n), np.diff(off))
    kinds = np.bincount(text * KINDS + _KIND[data], minlength=n * KINDS).reshape(n, KINDS) / per[:, None]
    h, at = word_hashes(data, off)
    words = np.diff(at).astype(np.float64)
    some = np.maximum(words, 1)
    distinct, most = _repeats(h, at)
    first = np.zeros(len(h) + 1, bool)
    first[at] = True
    begins = np.flatnonzero(~first[1:-1]) if len(h) > 1 else np.zeros(0, np.int64)  # pairs within a text
    pairs, most_pair = _repeats(mix64(h[begins] * np.uint64(3) ^ h[begins + 1]) if len(begins) else h[:0], np.searchsorted(begins, at))
    # lines, from the bytes between line ends
    ends = np.flatnonzero((data == 10) | (np.bincount(off[1:][size > 0] - 1, minlength=len(data)) > 0)) if len(data) else np.zeros(0, np.int64)
    if len(ends):
        starts = np.concatenate(([0], ends[:-1] + 1))
        weight = np.concatenate(([np.uint64(0)], np.cumsum(mix64(data.astype(np.uint64) + np.uint64(257)) * (np.arange(len(data), dtype=np.uint64) + np.uint64(1)))))
        once = np.concatenate(([np.uint64(0)], np.cumsum(mix64(data.astype(np.uint64) + np.uint64(257)))))
        line = weight[ends + 1] - weight[starts] - (once[ends + 1] - once[starts]) * starts.astype(np.uint64)
        line_at = np.searchsorted(ends, off)
        line_at[-1] = len(ends)
        lines, most_line = _repeats(line, line_at)
        count = np.diff(line_at).astype(np.float64)
    else:
        lines = most_line = count = np.zeros(n)
    after = np.zeros(len(data), bool)
    if len(data) > 1:
        spaced = np.isin(data[1:], (32, 10))
        after[:-1] = spaced & np.isin(_KIND[data[:-1]], (7, 8, 9))
        after[off[1:][size > 0] - 1] = False  # what follows there is another text
    letters = np.maximum(kinds[:, 1] + kinds[:, 2], 1e-9)
    return np.column_stack((
        np.log1p(size), np.log1p(words), kinds, kinds[:, 2] / letters, (size - kinds[:, 4] * size) / some, distinct / some, most / some,
        pairs / some, most_pair / some, np.log1p(count), lines / np.maximum(count, 1), most_line / np.maximum(count, 1), words / np.maximum(count, 1),
        _by_text(after, off) / some, _by_text(_CONTINUES[data], off) / per,
    ))


class Trees:
    """Flattened boosted trees: feature and threshold of every inner node, value of every leaf, base score."""

    def __init__(self, base: float, feature: np.ndarray, limit: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.limit, self.value = base, feature, limit, value

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        depth = self.feature.shape[1].bit_length() if len(self.feature) else 0
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.limit, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - len(f)]
        return 1 / (1 + np.exp(-out))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Boosted trees of logistic loss, split by histograms of gradients."""
    inner = (1 << depth) - 1
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Trees(float(np.log(share / (1 - share))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.column_stack([np.searchsorted(q, c, "left") for q, c in zip(cuts, x.T)])
    base, m, rows = float(np.log(share / (1 - share))), x.shape[1], np.arange(len(x))
    raw = np.full(len(x), base)
    feature, limit, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for k in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * m + np.arange(m)) * BINS + bins
            gs, hs = (np.bincount(at.ravel(), np.repeat(w, m), width * m * BINS).reshape(width, m, BINS).cumsum(2) for w in (g, h))
            ga, ha = gs[:, :1, -1:], hs[:, :1, -1:]
            gain = gs**2 / (hs + 1) + (ga - gs) ** 2 / (ha - hs + 1) - ga**2 / (ha + 1)
            gain[(hs < LEAST / 4) | (ha - hs < LEAST / 4)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for j in range(width):
                f, b = divmod(int(best[j]), BINS)
                if gain[j, f, b] > 1e-9 and b < len(cuts[f]):
                    feature[k, first + j], limit[k, first + j] = f, cuts[f][b]
            node = 2 * node + 1 + (x[rows, feature[k][node]] > limit[k][node])
        leaf = node - inner
        step = -np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        value[k] = rate * step
        raw += value[k][leaf]
    return Trees(base, feature, limit, value)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, off in text_steps(batch):
            x = statistics(data, off)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(part.schema.get_field_index("quality")), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "quality", "x"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Trees from at most ``rows`` labelled documents, none of them held out."""
    ship(docs.sparkSession)
    known = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # at most `rows` narrow rows, so small enough to broadcast
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text")
    # one row an id, so at most `rows`; of an id's texts the one of least statistics, whatever order rows arrive in
    got = chosen.mapInArrow(_features, "doc_id long, quality int, x binary").groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("m")).select("m.*").collect()
    if not got:
        return grow(np.zeros((0, 1)), np.zeros(0))
    x = np.array([np.frombuffer(r["x"]) for r in got])
    y = np.array([float(r["quality"] == 1) for r in got])
    order = np.lexsort((*x.T, y))  # the same trees in whatever order rows arrive
    return grow(x[order], y[order])


def with_scores(docs: DataFrame, model: Trees) -> DataFrame:
    """(doc_id, score) of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in text_steps(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(statistics(data, off)))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def kept(docs: DataFrame, model: Trees, least: float) -> DataFrame:
    """Rows of ``docs``, all columns, with a score of at least ``least``."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in text_steps(batch):
                yield part.filter(pa.array(model.scores(statistics(data, off)) >= least))

    return docs.mapInArrow(run, docs.schema)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    out = with_scores(docs, train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
