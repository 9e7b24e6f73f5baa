"""Edit-aware token counts over segment trees that are kept per document.

A document's tree has its pre-tokens as leaves, with their characters and tokens;
inner nodes hold sums. ``with_trees`` makes the trees once, by encoding whole
texts; their leaves are two plain arrays, which any table can store. ``edited``
takes texts with such trees, applies edits and gives texts and trees back, so that
the next edits start from there: only what an edit touches is encoded again.

An edit (offset, number of characters removed, text put in) descends to the leaves
that it touches and takes some pre-tokens more on either side as context, encodes
that region alone, and goes on outwards while the region's first or last pre-token
differs from the one it had. The region's pre-tokens are put into its leaves and
the sums above them updated; all other leaves stay. A leaf can hold several
pre-tokens; a region counts by pre-tokens all the same, and where a leaf gets more
than ``FULL`` of them the tree is laid out anew from the sums it has, with no
encoding.

A null text is empty; null or absent edits change nothing; an edit is clipped to
the text it finds. Edits of a document apply in the order given, each to the text
as the ones before left it. Repeated rows are counted each. A tree that doesn't
fit its text (other numbers of characters, or null) is made anew, which counts as
encoded. Other columns stay; columns named tree or after are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from strandlake.llm import vocab as V
from strandlake.llm.common import text_steps
from strandlake.session import ship

KEPT = 150_000
CONTEXT = 2
FULL = 64

TREE = "struct<chars:array<int>,toks:array<int>>"
AFTER_NAMES = ["text", "chars", "toks", "n_edits", "tokens_before", "tokens_after", "chars_after", "chars_encoded"]
AFTER = "struct<text:string,chars:array<int>,toks:array<int>,n_edits:bigint,tokens_before:bigint,tokens_after:bigint,chars_after:bigint,chars_encoded:bigint>"


class Counter:
    """Tokens of pre-tokens, with a table of bounded size."""

    def __init__(self, path: str):
        self.v = V.load(path)
        self.known: dict[str, int] = {}
        self.reach = max(map(len, self.v.special), default=0)

    def split(self, text: str) -> list[str]:
        return [w for piece, special in self.v.pieces(text) for w in ([piece] if special else self.v.pretokens(piece))]

    def tokens(self, words: list[str]) -> list[int]:
        known, out = self.known, list(map(self.known.get, words))
        if None in out:
            fast, special = self.v.fast, self.v.special
            for k, w in enumerate(words):
                if out[k] is None:
                    n = known.get(w)
                    if n is None:
                        if len(known) >= KEPT:
                            known.clear()
                        # a pre-token holds no special token unless it is one
                        n = known[w] = len(fast.encode_ordinary(w)) if fast is not None and w not in special else len(self.v.encode(w))
                    out[k] = n
        return out


_counters: dict[str, Counter] = {}


def counter_of(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


class PretokenTree:
    """Segment tree over the pre-tokens of one document, from its text and the leaves' arrays."""

    def __init__(self, text: str, chars, toks, counter: Counter):
        self.counter, self.encoded = counter, 0  # characters encoded again by edits
        self._lay(text, chars, toks)

    @classmethod
    def of(cls, text: str, counter: Counter) -> PretokenTree:
        words = counter.split(text)
        return cls(text, list(map(len, words)), counter.tokens(words), counter)

    def _lay(self, text: str, chars, toks) -> None:
        self.base, self.size = text, max(1, len(chars))
        self.width = 1 << (self.size - 1).bit_length()
        self.start = [0, *np.cumsum(chars, dtype=np.int64).tolist()] if len(chars) else [0, 0]
        self.chars, self.toks = self._sums(chars), self._sums(toks)
        self.own: dict[int, tuple[list[str], list[int]]] = {}  # leaves that edits have changed

    def _sums(self, leaves) -> list[int]:
        """Sums by node, the root at 1 and a node's children at twice its place and after."""
        out, w = np.zeros(2 * self.width, np.int64), self.width
        out[w : w + len(leaves)] = leaves
        while w > 1:
            out[w // 2 : w] = out[w : 2 * w : 2] + out[w + 1 : 2 * w : 2]
            w //= 2
        return out.tolist()

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.toks[1]

    def words(self, leaf: int) -> tuple[list[str], list[int]]:
        """Pre-tokens of a leaf and their tokens."""
        if leaf in self.own:
            return self.own[leaf]
        n = self.chars[self.width + leaf]
        return ([self.base[self.start[leaf] : self.start[leaf] + n]], [self.toks[self.width + leaf]]) if n else ([], [])

    def leaves(self) -> tuple[str, list[int], list[int]]:
        """Text, and characters and tokens of all pre-tokens: what a table keeps."""
        if not self.own:
            n = self.size if self.chars[1] else 0
            return self.base, self.chars[self.width : self.width + n], self.toks[self.width : self.width + n]
        words, toks = [], []
        for leaf in range(self.size):
            w, t = self.words(leaf)
            words += w
            toks += t
        return "".join(words), list(map(len, words)), toks

    def text(self) -> str:
        out, at = [], 0
        for leaf in sorted(self.own):  # what lies between them stands in the text as it was
            out.append(self.base[at : self.start[leaf]])
            out += self.own[leaf][0]
            at = self.start[leaf + 1]
        return "".join((*out, self.base[at:]))

    def apply(self, edits) -> int:
        """Apply edits in order; how many there were."""
        n = 0
        for e in edits if edits is not None else ():
            if e is not None and e["offset"] is not None:
                self.edit(int(e["offset"]), int(e["removed"] or 0), e["added"] or "")
                n += 1
        return n

    def find(self, offset: int) -> tuple[int, int]:
        """Leaf that holds the character at ``offset``, and the characters before it."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if offset >= before + self.chars[node]:
                before += self.chars[node]
                node += 1
        return min(node - self.width, self.size - 1), before

    def near(self, leaf: int, step: int) -> int:
        """The next leaf in that direction that holds characters, or past the end."""
        leaf += step
        while 0 <= leaf < self.size and not self.chars[self.width + leaf]:
            leaf += step
        return leaf

    def put(self, leaf: int, words: list[str], toks: list[int]) -> None:
        self.own[leaf] = words, toks
        node = self.width + leaf
        self.chars[node], self.toks[node] = sum(map(len, words)), sum(toks)
        node >>= 1
        while node:
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.toks[node] = self.toks[2 * node] + self.toks[2 * node + 1]
            node >>= 1

    def edit(self, offset: int, removed: int, added: str) -> None:
        offset = min(max(offset, 0), self.n_chars)
        removed = min(max(removed, 0), self.n_chars - offset)
        if not removed and not added:
            return
        last = max(self.n_chars - 1, 0)
        a, before = self.find(min(offset, last))
        b, _ = self.find(min(max(offset + removed - 1, offset), last))
        words, toks = [], []
        for leaf in range(a, b + 1):
            w, t = self.words(leaf)
            words, toks = words + w, toks + t
        # the pre-tokens touched: words[lo:hi], with ``first`` characters of the document before them
        lo, first = 0, before
        while lo + 1 < len(words) and first + len(words[lo]) <= offset:
            first += len(words[lo])
            lo += 1
        hi, end = lo, first
        while hi < len(words) and (hi == lo or end < offset + removed):
            end += len(words[hi])
            hi += 1

        def left() -> bool:
            """One pre-token more on the left, from the next leaf if need be."""
            nonlocal a, words, toks, lo, hi, first
            if not lo:
                p = self.near(a, -1)
                if p < 0:
                    return False
                w, t = self.words(p)
                a, words, toks, lo, hi = p, w + words, t + toks, len(w), hi + len(w)
            lo -= 1
            first -= len(words[lo])
            return True

        def right() -> bool:
            nonlocal b, words, toks, hi, end
            if hi == len(words):
                n = self.near(b, 1)
                if n >= self.size:
                    return False
                w, t = self.words(n)
                b, words, toks = n, words + w, toks + t
            end += len(words[hi])
            hi += 1
            return True

        # context: some pre-tokens, and as many characters as could become a special token
        more = 0
        while (more < CONTEXT or offset - first < self.counter.reach) and left():
            more += 1
        more = 0
        while (more < CONTEXT or end - offset - removed < self.counter.reach) and right():
            more += 1
        step = 1
        while True:
            old = words[lo:hi]
            whole = "".join(old)
            new = whole[: offset - first] + added + whole[offset - first + removed :]
            now = self.counter.split(new)
            self.encoded += len(new)
            grown = False
            for settled, further in ((self._settled(now, old), left), (self._settled(now[::-1], old[::-1]), right)):
                for _ in range(0 if settled else step):
                    if not further():
                        break
                    grown = True
            if not grown:
                break
            step *= 2
        words[lo:hi], toks[lo:hi] = now, self.counter.tokens(now)
        per = max(1, -(-len(words) // (b - a + 1)))
        for k, leaf in enumerate(range(a, b + 1)):
            self.put(leaf, words[k * per : (k + 1) * per], toks[k * per : (k + 1) * per])
        if per > FULL:
            self._lay(*self.leaves())

    @staticmethod
    def _settled(new: list[str], old: list[str]) -> bool:
        """Whether the region begins with a pre-token that the edit left alone, and so joins its neighbour as before."""
        return bool(new) and bool(old) and new[0] == old[0] and not new[0].isspace()


def _texts(part: pa.RecordBatch) -> list[str]:
    return [t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()]


def _trees_of(part: pa.RecordBatch, texts: list[str], counter: Counter) -> Iterator[tuple[PretokenTree, bool]]:
    """The tree of each text, from the column ``tree`` where it is there and fits, and whether it did."""
    place = part.schema.get_field_index("tree")
    if place < 0:
        yield from ((PretokenTree.of(t, counter), False) for t in texts)
        return
    trees = part.column(place)
    for text, chars, toks in zip(texts, trees.field("chars"), trees.field("toks")):
        own = [v.values.to_numpy(zero_copy_only=False) if v.is_valid else None for v in (chars, toks)]
        fits = own[0] is not None and own[1] is not None and len(own[0]) == len(own[1]) and int(own[0].sum()) == len(text)
        yield (PretokenTree(text, own[0], own[1], counter), True) if fits else (PretokenTree.of(text, counter), False)


def with_trees(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ``tree``: characters and tokens of every pre-token of ``text``."""
    path = path or V.default_path()
    ship(docs.sparkSession)
    docs = docs.drop("tree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for batch in batches:
            for part, _, _ in text_steps(batch):
                words = [counter.split(t) for t in _texts(part)]
                cells = [(np.array(list(map(len, w)), np.int32), np.array(counter.tokens(w), np.int32)) for w in words]
                tree = pa.StructArray.from_arrays([pa.array([c[k] for c in cells], pa.list_(pa.int32())) for k in (0, 1)], ["chars", "toks"])
                yield pa.RecordBatch.from_arrays([*part.columns, tree], names=[*part.schema.names, "tree"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("tree", docs.select(F.lit(None).cast(TREE)).schema[0].dataType)]))


def edited(docs: DataFrame, path: str | None = None, edits: str = "edits") -> DataFrame:
    """``docs`` (text, tree, edits: array<struct<offset,removed,added>>) with ``after``: the new text and tree, counts, and characters encoded."""
    path = path or V.default_path()
    ship(docs.sparkSession)
    docs = docs.drop("after")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for batch in batches:
            for part, _, _ in text_steps(batch):
                texts, rows = _texts(part), []
                for (tree, kept), text, own in zip(_trees_of(part, texts, counter), texts, part.column(part.schema.get_field_index(edits)).to_pylist()):
                    tree.encoded, before = 0 if kept else len(text), tree.n_tokens
                    n = tree.apply(own)
                    whole, *cells = tree.leaves()
                    rows.append((whole, *(np.array(c, np.int32) for c in cells), n, before, tree.n_tokens, tree.n_chars, tree.encoded))
                kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.int64()] * 5]
                after = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], AFTER_NAMES)
                yield pa.RecordBatch.from_arrays([*part.columns, after], names=[*part.schema.names, "after"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("after", docs.select(F.lit(None).cast(AFTER)).schema[0].dataType)]))


def apply_edits(docs: DataFrame, path: str | None = None, edits: str = "edits") -> DataFrame:
    """Counts before and after the edits of each row (doc_id, text, edits), from its kept ``tree`` if there is that column; else each row's tree is made, edited and let go.

    (doc_id, n_edits, tokens_before, tokens_after, chars_after, chars_encoded, text_sha256)
    """
    path = path or V.default_path()
    ship(docs.sparkSession)
    schema = "doc_id long, n_edits long, tokens_before long, tokens_after long, chars_after long, chars_encoded long, text_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for batch in batches:
            for part, _, _ in text_steps(batch):
                texts, rows = _texts(part), []
                made = "tree" in part.schema.names
                for (tree, kept), text, own in zip(_trees_of(part, texts, counter), texts, part.column(part.schema.get_field_index(edits)).to_pylist()):
                    tree.encoded, before = 0 if kept or not made else len(text), tree.n_tokens
                    n = tree.apply(own)
                    rows.append((n, before, tree.n_tokens, tree.n_chars, tree.encoded, hashlib.sha256(tree.text().encode("utf-8", "surrogatepass")).hexdigest()))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), [*[pa.int64()] * 5, pa.string()])]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=[c.split()[0] for c in schema.split(", ")])

    trees = ["tree"] if "tree" in docs.columns else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(edits).alias(edits), *trees).mapInArrow(run, schema)


def standing_edits(docs: DataFrame) -> DataFrame:
    """``docs`` with an ``edits`` column made from each row alone: a header, a replaced passage, a deletion, an insertion and a footer."""
    n = F.length(F.coalesce("text", F.lit("")))
    at = lambda k: F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(k)), F.greatest(n, F.lit(1))).cast("int")
    one = lambda offset, removed, added: F.struct(offset.alias("offset"), F.lit(removed).cast("int").alias("removed"), F.lit(added).alias("added"))
    edits = F.array(
        one(at(1), 12, "[redacted]"), one(at(2), 7, ""), one(at(3), 0, " it's 42 more\n"), one(F.lit(0), 0, "Title:\n\n"), one(n + F.lit(100), 0, "\n\n-- end")
    )
    return docs.withColumn("edits", edits)
