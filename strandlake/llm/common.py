"""Shared helpers: written intermediates, byte-level text access, components.

Intermediates are Parquet tables in the shared folder that the session names
in ``spark.checkpoint.dir``: they cut lineage, survive lost executors, and are
read back with column pruning.
"""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import re
import tempfile
import time
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.session import CLEANUP, ship, shuffles_dropped, spread  # noqa: F401  others take these from here

#: Text bytes, and texts, that one vectorised step handles at most; a longer text is a step alone.
STEP_BYTES, STEP_ROWS = 1 << 18, 1024

_written: dict[str, SparkSession] = {}


def shared_root(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of its own only where that is unset and driver and executors are one process."""
    ship(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="strandlake-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; the shuffles that it took are gone then."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    if not _written:
        atexit.register(_clean)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def released(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again."""
    for df in tables:
        _delete(df._written_at)


def _delete(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is None:
        return
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the folder is the cluster's to clean
        return


def _clean() -> None:
    for path in list(_written):
        _delete(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, over as many tasks as run at once at least."""
    ship(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def held_out(doc_id: F.Column) -> F.Column:
    """Rows whose crc32(doc_id as text) mod 4 is 2; null ids count as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def held_out_py(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


_rest_at = [0.0]
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library


def rest() -> None:
    """Give memory that a batch or group has left free back to the machine, a few times a second at most: idle workers hold no more than they need."""
    if time.monotonic() - _rest_at[0] > 0.3:
        pa.default_memory_pool().release_unused()
        if _trim is not None:
            _trim(0)
        _rest_at[0] = time.monotonic()


def text_steps(batch: pa.RecordBatch, column: str = "text", step: int = STEP_BYTES):
    """Slices of a record batch of about ``step`` text bytes and ``STEP_ROWS`` rows at most: (slice, bytes, offsets).

    bytes is a uint8 array, offsets int64 with one entry more than rows; null
    texts are empty.
    """
    texts = batch.column(batch.schema.get_field_index(column))
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(off, off[start] + step, "right")) - 1)
        stop = min(stop, start + STEP_ROWS, n)
        yield batch.slice(start, stop - start), data[off[start] : off[stop]], off[start : stop + 1] - off[start]
        start = stop
    del texts, off, data
    rest()


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a uint64 over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes between terms: ASCII but digits and letters.
NOT_IN_TERMS = np.arange(256) < 128
NOT_IN_TERMS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_BASE = 0x5851F42D4C957F2D
#: Bytes of a word that the polynomial hash takes; it has known collisions among much longer ones, which are digested instead.
LONG_WORD = 64
_UP = np.multiply.accumulate(np.array([1] + [_BASE] * (LONG_WORD - 1), np.uint64))


def _hashed(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of the words at [s, e)."""
    size = np.minimum(e - s, LONG_WORD)
    first = np.cumsum(size) - size
    place = np.arange(first[-1] + size[-1]) - np.repeat(first, size)
    h = np.add.reduceat(_BYTE_LOWER[data[place + np.repeat(s, size)]] * _UP[place], first)
    h = mix64(h + (e - s).astype(np.uint64))
    for k in np.flatnonzero(e - s > LONG_WORD).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(_LOWER[data[s[k] : e[k]]].tobytes(), digest_size=8).digest(), "little")
    return h


def word_hashes(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z lower-cased) of all texts, ``[^ \\t-\\r]+`` unless other bytes are ``between``, and word offsets by text."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~between[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | first[1:-1]
    end = word
    end[:-1] &= ~word[1:] | first[1:-1]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    h, a = np.empty(len(s), np.uint64), 0
    while a < len(s):
        b = max(a + 1, int(np.searchsorted(e, s[a] + STEP_BYTES, "right")))
        h[a:b] = _hashed(data, s[a:b], e[a:b])
        a = b
    return h, np.searchsorted(s, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; shorter texts are one shingle, wordless ones none."""
    h, at = word_hashes(data, offsets)
    keys = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) & (1 << 64) - 1) for k in range(width)]
    room = max(0, len(h) - width + 1)
    full = np.zeros(room, np.uint64)
    for k in range(width):
        full += mix64(h[k : k + room] ^ keys[k])
    full = mix64(full)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(full[a : b - width + 1]))
        elif b > a:
            seed = sum(int(mix64(h[i : i + 1] ^ keys[i - a])[0]) for i in range(a, b)) + (b - a)
            out.append(mix64(np.array([seed & (1 << 64) - 1], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst); component is its smallest node.

    Each round hooks every node to the neighbour of smallest hash, follows two
    hooks more, and contracts the graph; in the random order of hashes runs of
    hooks are short, so rounds grow with the logarithm of a component's size.
    Edges and labels stay distributed; each round's tables are written, and its
    joins are between written tables, so that a hub is dealt out by adaptive
    execution.
    """
    e = written(
        edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(),
        "cc-edges",
    )
    if e.isEmpty():
        return e.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    drawn = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    labels = base = None
    while True:
        both = e.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(
            e.select(F.col("dst").alias("node"), F.col("src").alias("other"))
        )
        hook = both.groupBy("node").agg(F.min(drawn("other")).alias("m")).select("node", F.least(F.col("m"), drawn("node"))["id"].alias("up"))
        near = written(hook, "cc-hook")
        then, far = near.select(F.col("node").alias("up"), F.col("up").alias("next")), near
        for _ in range(2):
            far = far.join(then, "up").select("node", F.col("next").alias("up"))
        hook = written(far, "cc-hook")
        released(near)
        if labels is None:
            labels, table_of = hook.select("node", F.col("up").alias("root")), hook
        else:
            step = hook.select(F.col("node").alias("root"), "up")
            labels = written(labels.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "cc-labels")
            released(base)
            table_of = labels
        a = hook.select(F.col("node").alias("src"), F.col("up").alias("a"))
        b = hook.select(F.col("node").alias("dst"), F.col("up").alias("b"))
        left = written(
            e.join(a, "src").join(b, "dst").where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(),
            "cc-edges",
        )
        released(e)
        if table_of is not hook:
            released(hook)
        e, base = left, table_of
        if e.isEmpty():
            break
    least = written(labels.groupBy("root").agg(F.min("node").alias("component")), "cc-least")
    return labels.join(least, "root").select("node", "component")


class Forest:
    """Union-find over local indices; ``join`` tells whether it merged two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        return True
