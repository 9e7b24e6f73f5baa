"""Ranked lexical search over impact vectors in norm buckets.

A document is a vector over the terms of the items asked: each coordinate is the
term's weight times the document's integer impact. An item is a vector of ones
over its terms, so an inner product is a score. Documents are range-sorted by
falling norm and cut into buckets of ``BUCKET``. By Cauchy-Schwarz no document of
a bucket scores more than the bucket's largest norm times the root of the item's
number of terms; an item opens only buckets where that reaches its threshold,
the least of the k best scores known. Within an opened bucket the coordinates of
an item's rarer terms are added up exactly, and those of its c common ones (in
more than one of ``COMMON`` documents) are bounded by the document's c largest
common coordinates and, by Cauchy-Schwarz, by the norm over common coordinates
times the root of c. What passes is scored anew in 64-bit
integers. Bounds are doubles, let through from a little below.

The ``FIRST`` documents of largest norm give the items' first thresholds; then
each task takes its own buckets with those, raises them as it goes, and returns
k rows an item at most. Items are taken in groups whose terms are ``TERMS`` at
most (or one item's), so that what travels to the tasks is bounded; each group
is a pass of its own over the documents.

Terms are the matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` in the
whole text, A-Z lower-cased, as 64-bit hashes. Null and empty texts have none; a
document without terms isn't counted. Repeated rows are documents each, in the
counts and in the ranks. Rows without doc_id are counted and ranked; among equal
scores they come last. Rows of one item_id are one item with the terms of all;
rows without item_id are not asked. An item without terms, or with scores of 0
only, has no rows. Other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import NOT_IN_TERMS, released, text_steps, word_hashes, written
from strandlake.session import ship

#: Terms of a group of items; documents of a bucket; documents that give first thresholds; items bounded at once.
TERMS, BUCKET, FIRST, ITEMS = 20_000, 512, 4096, 1024
#: A term in more than one of so many documents is common.
COMMON = 4
#: Largest common coordinates of a document that are added up; items with more common terms have the other bound alone.
LARGEST = 256
SLACK = 1e-9


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, off in text_steps(batch):
            h, at = word_hashes(data, off, NOT_IN_TERMS)
            each = [np.unique(h[a:b]).view(np.int64) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(each, pa.list_(pa.int64()))], names=["item_id", "terms"])


def _counted(terms: np.ndarray):
    """Each document's number of terms, and those asked with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in text_steps(batch):
                h, at = word_hashes(data, off, NOT_IN_TERMS)
                place = np.searchsorted(terms, h)
                place[place == len(terms)] = 0
                hit = np.flatnonzero(terms[place] == h)
                row = np.searchsorted(at, hit, "right") - 1
                key, tf = np.unique(row * len(terms) + place[hit], return_counts=True)
                cut = np.searchsorted(key // len(terms), np.arange(1, len(part)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(at), pa.int64()), pa.array(np.split((key % len(terms)).astype(np.int32), cut), pa.list_(pa.int32())), pa.array(np.split(tf.astype(np.int64), cut), pa.list_(pa.int64()))],
                    names=["doc_id", "n", "terms", "tfs"],
                )

    return run


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """Integer impacts of counts ``tf`` in documents of ``n`` terms."""
    m = np.array([100 - 90 + (90 * int(v) * docs) // total for v in n.tolist()], np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Items:
    """The items of a group by place, with their terms, and for each term the items that ask it."""

    def __init__(self, ids: np.ndarray, item: np.ndarray, term: np.ndarray, weights: np.ndarray, common: np.ndarray):
        self.ids, self.weights, self.common = ids, weights, common
        order = np.argsort(term, kind="stable")
        self.by_term, self.at = item[order], np.searchsorted(term[order], np.arange(len(weights) + 1))
        self.size = np.bincount(item, minlength=len(ids)).astype(np.float64)
        self.often = np.bincount(item, common[term], len(ids))

    def pairs(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, place in ``term``) for every item that asks one of ``term``."""
        many = self.at[term + 1] - self.at[term]
        place = np.repeat(np.arange(len(term)), many)
        first = np.cumsum(many) - many
        return self.by_term[np.arange(int(many.sum())) - np.repeat(first, many) + np.repeat(self.at[term], many)], place


class Best:
    """The k best of every item so far, and the score that a document must reach."""

    def __init__(self, items: Items, k: int, least: np.ndarray):
        self.items, self.k, self.least = items, k, least.astype(np.float64)
        self.found: dict[int, list[tuple[int, float, int | None]]] = {}
        self.pairs = self.opened = self.rescored = 0

    def bucket(self, ids: list[int | None], norm: np.ndarray, often: np.ndarray, row: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
        """Documents ``ids`` with postings (row, term, impact)."""
        q, n = self.items, len(ids)
        self.pairs += n * len(q.ids)
        open_ = np.flatnonzero(norm.max() * np.sqrt(q.size) * (1 + SLACK) >= self.least)
        if not len(open_):
            return
        value = q.weights[term] * impact
        # sums of each document's largest common coordinates, by how many
        own = np.flatnonzero(q.common[term])
        own = own[np.lexsort((-value[own], row[own]))]
        nth = np.arange(len(own)) - np.searchsorted(row[own], row[own])
        own, nth = own[nth < LARGEST], nth[nth < LARGEST]
        largest = np.zeros((n, LARGEST + 1))
        largest[row[own], nth + 1] = value[own]
        largest = np.cumsum(largest, axis=1)
        for at in range(0, len(open_), ITEMS):
            self._opened(open_[at : at + ITEMS], ids, often, largest, row, term, value)

    def _opened(self, some: np.ndarray, ids: list, often: np.ndarray, largest: np.ndarray, row: np.ndarray, term: np.ndarray, value: np.ndarray) -> None:
        q, n = self.items, len(ids)
        self.opened += n * len(some)
        slot = np.full(len(q.ids), -1)
        slot[some] = np.arange(len(some))
        rare = np.flatnonzero(~q.common[term])
        item, place = q.pairs(term[rare])
        own = slot[item] >= 0
        item, place = slot[item[own]], rare[place[own]]
        bound = np.bincount(item * n + row[place], value[place].astype(np.float64), len(some) * n).reshape(len(some), n).astype(np.float64)  # counts of nothing are integers
        many = q.often[some].astype(np.int64)
        most = np.where(many <= LARGEST, largest[:, np.minimum(many, LARGEST)], np.inf).T
        bound += np.minimum(most, often[None, :] * np.sqrt(q.often[some])[:, None])
        passes = (bound * (1 + SLACK) >= self.least[some][:, None]) & (bound > 0)
        self.rescored += int(passes.sum())
        if not passes.any():
            return
        near = passes.any(0)[row]
        near[near] = (q.at[term[near] + 1] > q.at[term[near]])
        near = np.flatnonzero(near)
        item, place = q.pairs(term[near])
        place, item = near[place], slot[item]
        own = item >= 0
        own[own] = passes[item[own], row[place[own]]]
        item, place = item[own], place[own]
        key = item * n + row[place]
        order = np.argsort(key, kind="stable")
        key = key[order]
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        score = np.add.reduceat(value[place[order]], begin) if len(begin) else np.zeros(0, np.int64)
        key = key[begin]
        keep = (score >= self.least[some[key // n]]) & (score > 0)
        key, score = key[keep], score[keep]
        cut = np.searchsorted(key // n, np.arange(len(some) + 1))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            a, b = cut[s], cut[s + 1]
            whole = self.found.get(int(some[s]), []) + [(-v, math.inf if (i := ids[d]) is None else i, i) for v, d in zip(score[a:b].tolist(), (key[a:b] % n).tolist())]
            whole.sort(key=lambda x: x[:2])
            self.found[int(some[s])] = whole[: self.k]
            if len(whole) >= self.k:
                self.least[some[s]] = max(self.least[some[s]], -whole[self.k - 1][0])

    def batch(self) -> pa.RecordBatch:
        rows = [(int(self.items.ids[s]), i, -v) for s, own in self.found.items() for v, _, i in own]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows] + [None], pa.int64()), pa.array([r[1] for r in rows] + [None], pa.int64()), pa.array([r[2] for r in rows] + [None], pa.int64())]
            + [pa.array([0] * len(rows) + [v], pa.int64()) for v in (self.pairs, self.opened, self.rescored)],
            names=["item_id", "doc_id", "score", "pairs", "opened", "rescored"],
        )


FOUND = "item_id long, doc_id long, score long, pairs long, opened long, rescored long"
VECTORS = "doc_id long, norm double, often double, terms array<int>, impacts array<long>"


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of a column of lists."""
    size = np.array([len(v) for v in lists], np.int64) if lists.null_count else np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(len(lists)), size), lists.flatten().to_numpy(zero_copy_only=False)


def _valued(weights: np.ndarray, common: np.ndarray, docs: int, total: int):
    """Impacts, the norm of weighted impacts, and the norm over common terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            row, term = _flat(batch.column(2))
            _, tf = _flat(batch.column(3))
            n = batch.column(1).to_numpy()
            impact = impacts(tf, n[row], docs, total)
            square = (weights[term] * impact.astype(np.float64)) ** 2
            norm, often = (np.sqrt(np.bincount(row, w, len(batch))) for w in (square, square * common[term]))
            cut = np.searchsorted(row, np.arange(1, len(batch)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(norm), pa.array(often), batch.column(2), pa.array(np.split(impact, cut), pa.list_(pa.int64()))], names=["doc_id", "norm", "often", "terms", "impacts"]
            )

    return run


def _searched(items: Items, k: int, least: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(items, k, least)
        for batch in batches:
            for at in range(0, len(batch), BUCKET):
                part = batch.slice(at, BUCKET)
                row, term = _flat(part.column(3))
                best.bucket(part.column(0).to_pylist(), part.column(1).to_numpy(), part.column(2).to_numpy(), row, term, _flat(part.column(4))[1])
        yield best.batch()

    return run


def _group(docs: DataFrame, rows: pa.Table, k: int) -> DataFrame:
    """(item_id, doc_id, score, ..) of one group of items: each task's best."""
    ids, item = np.unique(rows["item_id"].to_numpy(), return_inverse=True)
    terms, term = np.unique(rows["term"].to_numpy().view(np.uint64), return_inverse=True)
    held = written(docs.mapInArrow(_counted(terms), "doc_id long, n long, terms array<int>, tfs array<long>"), "lex-docs")
    whole = held.where("n > 0").agg(F.count("*").alias("n"), F.sum("n").alias("total")).first()
    df = held.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # a row a term of the group
    many = np.zeros(len(terms), np.int64)
    many[df["term"].to_numpy()] = df["count"].to_numpy()
    docs_n, total = whole["n"], whole["total"] or 0
    weights = np.array([weight(docs_n, d) for d in many.tolist()], np.int64)
    common = many * COMMON > docs_n
    items = Items(ids, item, term, weights, common)
    vectors = held.where(F.size("terms") > 0).mapInArrow(_valued(weights, common, docs_n, max(total, 1)), VECTORS).where("norm > 0")
    order = [F.desc("norm"), F.asc("doc_id")]
    sorted_ = written(vectors.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "lex-vectors")
    released(held)
    none = np.zeros(len(ids))
    # the first partitions that hold FIRST rows together; a row a partition
    seen, parts = 0, []
    for r in sorted_.groupBy("part").count().orderBy("part").collect():
        parts.append(r["part"])
        if (seen := seen + r["count"]) >= FIRST:
            break
    sorted_, top = sorted_.drop("part"), sorted_.where(F.col("part") <= max(parts, default=0)).drop("part")
    first = top.orderBy(*order).limit(FIRST).mapInArrow(_searched(items, k, none), FOUND).where("item_id is not null")
    kth = Window.partitionBy("item_id").orderBy(F.desc("score"))
    for r in first.select("item_id", "score", F.row_number().over(kth).alias("rank")).where(F.col("rank") == k).collect():  # a row an item
        none[np.searchsorted(ids, r["item_id"])] = r["score"]
    return sorted_.mapInArrow(_searched(items, k, none), FOUND)


def search(docs: DataFrame, items: DataFrame, k: int = 10, report: bool = False) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for every item, ties to smaller doc_id.

    With ``report`` instead one row: (pairs, opened, rescored), pairs of an item and a document with one of the terms asked,
    those in opened buckets, and those scored exactly.
    """
    spark = docs.sparkSession
    ship(spark)
    asked = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_asked, "item_id long, terms array<long>")
    asked = written(asked.select("item_id", F.explode("terms").alias("term")).distinct(), "lex-items")
    groups = max(1, -(-asked.count() // TERMS))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for g in range(groups):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).toArrow()
        if len(rows):
            own = _group(texts, rows, k)
            found = own if found is None else found.unionByName(own)
    if found is None:
        found = spark.createDataFrame([], FOUND)
    if report:
        return found.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pairs", "opened", "rescored")))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.where("item_id is not null").select("item_id", place.cast("int").alias("rank"), "doc_id", "score").where(F.col("rank") <= k)
