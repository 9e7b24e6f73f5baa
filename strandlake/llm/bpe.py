"""BPE encoding by a segment tree over the ranks of adjacent pairs, and decoding.

The leaves of a tree are the positions of a pre-token's symbols; a leaf holds the
rank of the pair that begins there and its position, an inner node the least of
its two children. The root so is the leftmost pair of lowest rank; a merge
rewrites three leaves and their paths. Pre-tokens of like length share one
two-dimensional array of trees, so that a step merges in all of them at once.

Each worker keeps the ids of the pre-tokens it has met lately, in tables of bounded
size. Null texts are empty: no ids, the empty string. Any other columns are
left alone; repeated rows are encoded each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import vocab as V
from strandlake.session import ship

NONE = np.int64(1) << 60
#: Pre-tokens whose ids a worker keeps in each of two generations.
KEPT = 250_000


class PairTrees:
    """Segment trees for many symbol rows of up to ``width`` (a power of two) symbols."""

    def __init__(self, vocabulary: V.Vocabulary):
        size = np.int64(vocabulary.size)
        key = vocabulary.left * size + vocabulary.right
        self.order = np.argsort(key)
        self.keys, self.size, self.merged = key[self.order], size, vocabulary.merged

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where there is no merge; a negative symbol is the end."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (right >= 0) & (left >= 0), self.order[at], NONE)

    def run(self, symbols: np.ndarray) -> np.ndarray:
        """``symbols``: rows padded with -1. Returns them after all merges, gone positions -1."""
        n, width = symbols.shape
        bits = max(1, width.bit_length() - 1)
        sym = symbols.astype(np.int64)
        held = (sym >= 0).sum(1)
        nxt = np.tile(np.arange(1, width + 1), (n, 1))
        nxt[nxt >= held[:, None]] = width
        prv = np.tile(np.arange(-1, width - 1), (n, 1))
        ahead = np.full_like(sym, -1)
        ahead[:, :-1] = sym[:, 1:]
        tree = np.full((n, 2 * width), NONE)
        leaf = self.ranks(sym.ravel(), ahead.ravel()).reshape(n, width)
        tree[:, width:] = np.where(leaf == NONE, NONE, leaf << bits | np.arange(width))
        for level in range(bits - 1, -1, -1):
            a = 1 << level
            tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            root = tree[rows, 1]
            i = root & (1 << bits) - 1
            j = nxt[rows, i]
            k = nxt[rows, j]
            new = self.merged[root >> bits]
            sym[rows, i], sym[rows, j] = new, -1
            nxt[rows, i] = k
            more = k < width
            prv[rows[more], k[more]] = i[more]
            right = np.where(more, sym[rows, np.minimum(k, width - 1)], -1)
            p = prv[rows, i]
            left = np.where(p >= 0, sym[rows, np.maximum(p, 0)], -1)
            here, before = self.ranks(new, right), self.ranks(left, new)
            tree[rows, width + j] = NONE
            tree[rows, width + i] = np.where(here == NONE, NONE, here << bits | i)
            has = p >= 0
            tree[rows[has], width + p[has]] = np.where(before == NONE, NONE, before << bits | p)[has]
            three = np.concatenate((rows, rows, rows[has]))
            node = np.concatenate((i, j, p[has])) + width
            for _ in range(bits):
                node >>= 1
                tree[three, node] = np.minimum(tree[three, 2 * node], tree[three, 2 * node + 1])
            rows = rows[tree[rows, 1] < NONE]
        return sym


def long_word(trees: PairTrees, symbols: list[int]) -> list[int]:
    """The same for one very long pre-token, by a tree of plain integers."""
    n = len(symbols)
    bits = max(1, (n - 1).bit_length())
    width, none = 1 << bits, int(NONE)
    sym, nxt, prv = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    s = np.array(symbols, np.int64)
    first = trees.ranks(s[:-1], s[1:])
    known: dict[tuple[int, int], int] = {}

    def leaf(a: int, at: int, b: int) -> int:
        if (a, b) not in known:
            known[a, b] = int(trees.ranks(np.array([a]), np.array([b]))[0])
        return none if known[a, b] == none else known[a, b] << bits | at

    tree = [none] * (2 * width)
    tree[width : width + n - 1] = np.where(first == NONE, NONE, first << bits | np.arange(n - 1)).tolist()
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(at: int, value: int) -> None:
        node = width + at
        tree[node] = value
        node >>= 1
        while node:
            best = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                return
            tree[node] = best
            node >>= 1

    while tree[1] != none:
        i, rank = tree[1] & width - 1, tree[1] >> bits
        j = nxt[i]
        k = nxt[j]
        sym[i], sym[j] = int(trees.merged[rank]), -1
        nxt[i] = k
        put(j, none)
        put(i, leaf(sym[i], i, sym[k]) if k < n else none)
        if k < n:
            prv[k] = i
        if prv[i] >= 0:
            put(prv[i], leaf(sym[prv[i]], prv[i], sym[i]))
    return [x for x in sym if x >= 0]


class Encoder:
    """Encodes texts; pre-tokens not met before are merged together, in batches by length."""

    def __init__(self, path: str):
        self.v = V.load(path)
        self.trees = PairTrees(self.v)
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.ends = np.array([len(self.v.bytes.get(i, b"")) for i in range(self.v.size)], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.ends)[:-1]))
        self.blob = np.frombuffer(b"".join(self.v.bytes.get(i, b"") for i in range(self.v.size)), np.uint8)

    def words(self, words: list[str]) -> list[list[int]]:
        """ids of each pre-token."""
        raw = [w.encode() for w in words]
        out: list[list[int]] = [[]] * len(words)
        sizes = np.array([len(r) for r in raw])
        width = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(sizes, 2))).astype(int))
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            if w > 2048:
                for k in at.tolist():
                    out[k] = long_word(self.trees, self.v.byte_id[np.frombuffer(raw[k], np.uint8)].tolist())
                continue
            for cut in range(0, len(at), max(1, (1 << 18) // w)):
                some = at[cut : cut + max(1, (1 << 18) // w)]
                grid = np.full((len(some), w), -1, np.int64)
                grid[np.arange(w) < sizes[some][:, None]] = self.v.byte_id[np.frombuffer(b"".join(raw[k] for k in some.tolist()), np.uint8)]
                done = self.trees.run(grid)
                held = done >= 0
                flat, ends = done[held].tolist(), np.cumsum(held.sum(1)).tolist()
                for k, a, b in zip(some.tolist(), [0, *ends[:-1]], ends):
                    out[k] = flat[a:b]
        return out

    def batch(self, texts: list[str]) -> Iterator[tuple[str, int]]:
        """(decimal ids joined by commas, number of ids) of each text."""
        split = [[([piece] if special else self.v.pretokens(piece), special) for piece, special in self.v.pieces(t)] for t in texts]
        young = self.young
        new: list[str] = []
        for w in set().union(*(ws for t in split for ws, special in t if not special)).difference(young):
            if (known := self.old.get(w)) is None:
                new.append(w)
            else:
                young[w] = known
        for w, ids in zip(new, self.words(new)):
            young[w] = ",".join(map(str, ids))
        for t in split:
            joined = ",".join([",".join([str(self.v.special[ws[0]])] if special else [young[w] for w in ws]) for ws, special in t])
            yield joined, joined.count(",") + 1 if joined else 0
        if len(young) > KEPT:  # what was used since the last change stays for one generation more
            self.old, self.young = young, {}

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        n = self.ends[ids]
        total = int(n.sum())
        at = np.repeat(self.starts[ids] - (np.cumsum(n) - n), n) + np.arange(total)
        return self.blob[at].tobytes().decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def steps(texts: list[str], chars: int = 1 << 19) -> Iterator[list[str]]:
    """Runs of at most 256 texts and, but for a text that is longer alone, so many characters."""
    run, held = [], 0
    for t in texts:
        if run and (held + len(t) > chars or len(run) >= 256):
            yield run
            run, held = [], 0
        run.append(t)
        held += len(t)
    if run:
        yield run


def encode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with a column ``ids`` (array<int>)."""
    path = path or V.default_path()
    ship(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def ids(s: pd.Series) -> pd.Series:
        e = encoder(path)
        return pd.Series([np.fromstring(x, np.int32, sep=",") if x else np.zeros(0, np.int32) for t in steps(s.fillna("").tolist()) for x, _ in e.batch(t)], dtype=object)

    return docs.withColumn("ids", ids(F.col(text)))


def decode(df: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """``df`` with a column ``decoded``; null ids are the empty string."""
    path = path or V.default_path()
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def text(s: pd.Series) -> pd.Series:
        e = encoder(path)
        return pd.Series(["" if x is None or not len(x) else e.decode(np.asarray(x, np.int64)) for x in s], dtype=object)

    return df.withColumn("decoded", text(F.col(ids)))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, decode and digest in one pass over the texts."""
    path = path or V.default_path()
    ship(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for pdf in frames:
            rows = []
            for part in steps(pdf["text"].fillna("").tolist()):
                for joined, n in e.batch(part):
                    text = e.decode(np.fromstring(joined, np.int64, sep=",")) if n else ""
                    rows.append((n, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], **{k: [r[i] for r in rows] for i, k in enumerate(("n_tokens", "ids_sha256", "decoded_sha256"))}})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
