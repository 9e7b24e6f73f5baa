"""Embedding near-dedup: random-hyperplane signs in several tables, exact cosine, components.

Vectors are compared only with vectors of the same, non-null label and length.
Equal vectors of a label are one class with a size, so that copies cost one row.
Every class gets one signature a table; its length grows with the logarithm of
the largest label so that buckets stay small, and the number of tables follows
from the recall asked for at the threshold. A bucket is cut into blocks of
bounded size and each pair of blocks is a task of its own, so that large
buckets are compared whole. A pair is counted in the first table that it shares.

Null, zero and non-finite vectors, and null labels, link with nothing and are
components of their own. Rows without vec_id take part under no id: they get no
links and a null component. Repeated rows are one class and link with each
other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import Forest, connected_components, written
from strandlake.session import ship

BLOCK = 2048
CELL_ROWS = 2000
RECALL = 0.998
SEED = 20240229


def tables_for(threshold: float, largest: int, recall: float = RECALL) -> tuple[int, int]:
    """(bits a signature, tables): a pair at the threshold shares one of the tables with probability ``recall``."""
    bits = min(62, max(10, math.ceil(math.log2(max(largest, 2))) + 2))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def _planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, bits * tables))


def _signatures(bits: int, tables: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            dims = pdf["embedding"].map(len)
            for dim, part in pdf.groupby(dims):
                x = np.array(part["embedding"].tolist(), np.float64)
                sign = (x @ _planes(int(dim), bits, tables) > 0).reshape(len(part), tables, bits)
                sigs = sign @ (1 << np.arange(bits, dtype=np.int64))
                yield pd.DataFrame({"rep": part["rep"].to_numpy(), "label": part["label"].to_numpy(), "dim": dim, "copies": part["copies"].to_numpy(), "sigs": list(sigs), "vector": [v.tobytes() for v in x]})

    return run


def _compared(threshold: float):
    def cell(x, sigs, reps, copies, table: int, left: np.ndarray, right: np.ndarray, out: tuple[list, list, list]) -> None:
        """Links between two blocks of a bucket, or within one (left is right)."""
        near = x[left] @ x[right].T >= threshold
        if left is right:
            near &= np.arange(len(left))[:, None] < np.arange(len(left))[None, :]
        a, b = np.nonzero(near)
        if not len(a):
            return
        fresh = ~(sigs[left[a], :table] == sigs[right[b], :table]).any(1)
        a, b = left[a[fresh]], right[b[fresh]]
        rows, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        links = np.bincount(at, np.concatenate((copies[b], copies[a])), len(rows))
        forest = Forest(len(rows))
        out[0].extend(reps[rows].tolist()), out[1].extend([None] * len(rows)), out[2].extend(links.astype(np.int64).tolist())
        for p, q in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
            if forest.join(p, q):
                out[0].append(int(reps[rows[p]])), out[1].append(int(reps[rows[q]])), out[2].append(0)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: tuple[list, list, list] = ([], [], [])
        for _, own in pdf.groupby("dim"):
            own = own.sort_values(["label", "tbl", "sig", "i", "j", "block", "rep"], ignore_index=True)
            x = np.frombuffer(b"".join(own["vector"]), np.float64).reshape(len(own), -1)
            x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
            x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
            sigs, reps, copies = np.array(own["sigs"].tolist()), own["rep"].to_numpy(), own["copies"].to_numpy()
            label, tbl, sig, i, j, block = (own[c].to_numpy() for c in ("label", "tbl", "sig", "i", "j", "block"))
            new = np.ones(len(own), bool)
            new[1:] = (label[1:] != label[:-1]) | (tbl[1:] != tbl[:-1]) | (sig[1:] != sig[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            cuts = [*np.flatnonzero(new).tolist(), len(own)]
            for a, b in zip(cuts, cuts[1:]):
                if i[a] == j[a]:
                    left = right = np.arange(a, b)
                else:
                    middle = a + int(np.searchsorted(block[a:b], j[a]))  # blocks i come first
                    left, right = np.arange(a, middle), np.arange(middle, b)
                cell(x, sigs, reps, copies, int(tbl[a]), left, right, out)
        return pd.DataFrame({"src": np.array(out[0], np.int64), "dst": pd.array(out[1], dtype="Int64"), "links": np.array(out[2], np.int64)})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label)."""
    ship(vectors.sparkSession)
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), x.alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite, F.lit(False))
    plain = F.transform("embedding", lambda v: v + F.lit(0.0))  # one zero
    rows = rows.withColumn("class_a", F.when(usable, F.xxhash64("label", plain))).withColumn("class_b", F.when(usable, F.xxhash64(F.reverse(plain), "label")))
    ids = rows.select("vec_id", "class_a", "class_b")
    classes = rows.where("class_a is not null").groupBy("class_a", "class_b").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding")
    )
    classes = written(classes, "vec-classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = tables_for(threshold, largest, recall)
    signed = written(
        classes.select("rep", "label", "copies", "embedding").mapInPandas(_signatures(bits, tables), "rep long, label string, dim int, copies long, sigs array<long>, vector binary"),
        "vec-signed",
    )
    entries = signed.select("rep", "label", "dim", F.posexplode("sigs").alias("tbl", "sig"))
    key = ["label", "dim", "tbl", "sig"]
    full = written(entries.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "vec-buckets")
    entries = entries.join(full, key).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    entries = entries.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = written(entries.select(*key, "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep"), "vec-cells")
    # a task takes as many whole cells as make about CELL_ROWS rows
    shares = max(1, cells.count() // CELL_ROWS)
    found = (
        cells.withColumn("share", F.pmod(F.xxhash64(*key, "i", "j"), F.lit(shares))).join(signed.select("rep", "copies", "sigs", "vector"), "rep")
        .groupBy("share").applyInPandas(_compared(threshold), "src long, dst long, links long")
    )
    found = written(found, "vec-found")
    linked = found.where("dst is null").groupBy(F.col("src").alias("rep")).agg(F.sum("links").alias("links"))
    parent = connected_components(found.where("dst is not null").select("src", "dst"))
    out = classes.select("class_a", "class_b", "rep", "copies").join(linked, "rep", "left").join(parent.withColumnRenamed("node", "rep"), "rep", "left")
    out = written(out.select("class_a", "class_b", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component")), "vec-classes")
    component = F.coalesce("component", "vec_id")
    return ids.join(out, ["class_a", "class_b"], "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept")
    )
