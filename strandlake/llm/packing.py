"""Packing along a space-filling curve.

A document's token ids are counted into hashed bins, centred, scaled to length
one and projected to four dimensions; the coordinates become cells of a grid by
the normal distribution, and the cell's place on the Hilbert curve is the key.
Documents are range-sorted by (key, row); their ids form one stream along the
curve, cut every ``length`` ids, so that neighbours on the curve share
sequences and only the last sequence of the corpus can be short: it is padded,
unless its length is a power of two.

The ids are encoded once and written; the sort moves only (key, row, length).
Each range partition adds up its own lengths, and partitions get their bases from
their totals, of which there is one a partition.

Null texts are empty: they hold the end id alone. Equal keys go by row, so that
copies are dealt over partitions; repeated rows and repeated doc_ids, and null
ones, are packed each. Long documents span sequences. Other columns are left out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import vocab as V
from strandlake.llm.common import mix64, released, rest, STEP_BYTES, written
from strandlake.session import ship

DIMS, BITS, BINS = 4, 14, 256
_erf = np.frompyfunc(math.erf, 1, 1)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (n, dims), coordinates below 2^bits."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    # undo the curve's rotations and reflections from the coarsest bit down
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[-1] & q) > 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_keys(counts: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents from their binned token counts (n, BINS)."""
    v = np.sqrt(counts)
    v -= v.mean(1, keepdims=True)
    v /= np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)
    z = v @ np.random.default_rng(7).standard_normal((BINS, DIMS))
    u = (1 + _erf(z / math.sqrt(2)).astype(np.float64)) / 2
    return hilbert_key(np.clip((u * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1))


def runs(sizes: np.ndarray, most: int = 256, reach: int = STEP_BYTES):
    """(start, stop) of runs of at most so many texts and, but for a text that is longer alone, so many bytes."""
    total = np.concatenate(([0], np.cumsum(sizes)))
    at = 0
    while at < len(sizes):
        stop = min(len(sizes), at + most, max(at + 1, int(np.searchsorted(total, total[at] + reach, "right")) - 1))
        yield at, stop
        at = stop


def _encoded(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = V.load(path)
        bin_of = (mix64(np.arange(v.size, dtype=np.uint64) + np.uint64(1)) % np.uint64(BINS)).astype(np.int64)
        kind = np.dtype("<u2") if v.size <= 1 << 16 else np.dtype("<u4")
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts, ids = batch.column(1), batch.column(0)
            for at, stop in runs(pc.fill_null(pc.binary_length(texts), 0).to_numpy()):
                run_ids = [np.array([*v.encode(t or ""), end], kind) for t in texts.slice(at, stop - at).to_pylist()]
                counts = np.zeros((len(run_ids), BINS))
                for k, x in enumerate(run_ids):
                    counts[k] = np.bincount(bin_of[x], minlength=BINS)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, stop - at), pa.array(np.arange(row, row + len(run_ids)) + (part << 33), pa.int64()), pa.array(curve_keys(counts), pa.int64()),
                        pa.array([len(x) for x in run_ids], pa.int64()), pa.array([x.tobytes() for x in run_ids], pa.binary()),
                    ],
                    names=["doc_id", "row", "key", "n", "ids"],
                )
                row += len(run_ids)
            del texts, ids
            rest()

    return run


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places within a range partition, in its order."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column(1).to_numpy()
        ends = at + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part), pa.int32()), pa.array(ends - n, pa.int64()), batch.column(1)], names=["row", "part", "place", "n"])
        at = int(ends[-1]) if len(n) else at


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, start, size, crc, whole, seq, off = [], [], [], [], [], [], []
            rows = zip(*(batch.column(k).to_pylist() for k in ("doc_id", "place", "n")), batch.column("ids"))
            for doc_id, place, n, raw in rows:
                raw = raw.as_buffer()
                ids = np.frombuffer(raw, "<u2" if raw.size == 2 * n else "<u4").astype("<u4")
                at = 0
                while at < n:
                    s, o = divmod(place + at, length)
                    take = min(n - at, length - o)
                    doc.append(doc_id), start.append(at), size.append(take), whole.append(n), seq.append(s), off.append(o)
                    crc.append(zlib.crc32(ids[at : at + take].tobytes()))
                    at += take
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (doc, start, size, crc, whole, seq, off)], names=list(names))
            rest()

    return run


def pack(docs: DataFrame, length: int = 2048, path: str | None = None, end: int = 1) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    spark, path = docs.sparkSession, path or V.default_path()
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(rows.mapInArrow(_encoded(path, end), "doc_id long, row long, key long, n long, ids binary"), "pack-ids")
    ranged = rows.select("row", "key", "n").repartitionByRange("key", "row").sortWithinPartitions("key", "row").select("row", "n")
    places = written(ranged.mapInArrow(_placed, "row long, part int, place long, n long"), "pack-places")
    totals = places.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # one row a partition
    base, at = [], 0
    for r in totals:
        base.append((r["part"], at))
        at += r["n"]
    bases = spark.createDataFrame(base, "part int, base long")
    places = places.join(F.broadcast(bases), "part").select("row", (F.col("place") + F.col("base")).alias("place"))
    out = rows.select("doc_id", "row", "n", "ids").join(places, "row").select("doc_id", "place", "n", "ids")
    return out.mapInArrow(_cut(length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
