"""Transforms of cells (arrays), per row and without a shuffle: built-in expressions, and running ones by Arrow batches in linear time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(cells: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a batch's cells behind each other (null elements are NaN), and where each cell starts, with the end; a null cell is empty."""
    parts = [np.zeros(0, np.int64) if c is None else np.asarray(c) for c in cells]
    at = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int64)
    data = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return (data.astype(np.float64) if data.dtype == object else data), at


def cells_of(data: np.ndarray, at: np.ndarray, like: pd.Series) -> pd.Series:
    """The batch's cells again; those that were null are null."""
    return pd.Series([None if c is None else data[a:b] for a, b, c in zip(at[:-1].tolist(), at[1:].tolist(), like)], dtype=object)


def deriv(c: Column) -> Column:
    """First element, then each element minus the one before."""
    return F.transform(c, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(c, i - 1)))


@F.pandas_udf(T.ArrayType(T.LongType()))
def integral(c: pd.Series) -> pd.Series:
    """Running sums within the cell; from a null element on all are null."""
    data, at = flat(c)
    if data.dtype.kind == "f":
        sums = [None if x is None else np.cumsum(np.asarray(x, np.float64)) for x in c]
        return pd.Series([None if x is None else [None if np.isnan(v) else int(v) for v in x] for x in sums], dtype=object)
    total = np.concatenate(([0], np.cumsum(data.astype(np.int64))))
    return cells_of(total[1:] - np.repeat(total[at[:-1]], np.diff(at)), at, c)


def clip(c: Column, lower, upper) -> Column:
    return F.greatest(F.lit(lower), F.least(F.lit(upper), c))


def vclip(c: Column, lower, upper) -> Column:
    return F.transform(c, lambda x: clip(x, lower, upper))


def pairwise_max(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def pairwise_min(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.least(x, y))


def cut(c: Column, at: Sequence[int]) -> Column:
    """The elements at these places (from 0), in this order."""
    return F.array(*[F.get(c, F.lit(k)) for k in at])


def paste(*cells: Column) -> Column:
    return F.arrays_zip(*cells)


def trim(c: Column, value, side: int = 0) -> Column:
    """Without the run of ``value`` at the start (side 0) or the end (side 1)."""
    n = F.size(c)
    other = F.filter(F.transform(c, lambda x, i: F.when(x != value, i)), lambda i: i.isNotNull())
    first, last = F.array_min(other), F.array_max(other)
    empty = F.slice(c, 1, 0)
    if side == 0:
        return F.when(F.size(other) == 0, empty).otherwise(F.slice(c, first + 1, n - first))
    return F.when(F.size(other) == 0, empty).otherwise(F.slice(c, F.lit(1), last + 1))


def not_my_row(ids: Column, row_id: Column) -> Column:
    return F.filter(ids, lambda x: (x != row_id) & (x > 0))


def vec_sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def redimension(c: Column, dim: int) -> Column:
    """Consecutive sub-vectors of ``dim`` elements; a short rest is the last."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(c) / dim).cast("int") - 1, F.lit(0)))
    return F.when(F.size(c) == 0, F.array()).otherwise(F.transform(starts, lambda k: F.slice(c, k * dim + 1, F.lit(dim))))


def fixed_vec_sum(c: Column, dim: int) -> Column:
    return F.transform(redimension(c, dim), vec_sum)


def bit_or(a: Column, b: Column, align: int = 0) -> Column:
    """Element-wise OR; the shorter cell is filled with 0 on the right (align 0) or on the left (1)."""
    n = F.greatest(F.size(a), F.size(b))
    fill = lambda c: F.array_repeat(F.lit(0), n - F.size(c))
    wide = (lambda c: F.concat(c, fill(c))) if align == 0 else (lambda c: F.concat(fill(c), c))
    return F.zip_with(wide(a), wide(b), lambda x, y: x.bitwiseOR(y))


def outlier_encode(c: Column, outlier: int) -> Column:
    """Ordinary y becomes 2 y; the outlier becomes 1, or 2 y + 1 of the last ordinary y before it."""

    def run(cells: pd.Series) -> pd.Series:
        data, at = flat(cells)
        data = data.astype(np.int64)
        place = np.arange(len(data))
        last = np.maximum.accumulate(np.where(data != outlier, place, -1)) if len(data) else place
        known = last >= np.repeat(at[:-1], np.diff(at))  # an ordinary one within the cell
        return cells_of(np.where(data != outlier, 2 * data, np.where(known, 2 * data[np.maximum(last, 0)] + 1, 1)), at, cells)

    return F.pandas_udf(run, "array<long>")(c.cast("array<long>"))


def outlier_decode(c: Column, outlier: int) -> Column:
    return F.transform(c, lambda y: F.when(y.bitwiseAND(F.lit(1)) == 1, F.lit(outlier).cast("long")).otherwise(F.shiftright(y, 1).cast("long")))


def range_validate(c: Column, lower, upper) -> Column:
    """The cell itself; an element outside the range is an error."""
    return F.transform(c, lambda x: F.when(x.between(lower, upper), x).otherwise(F.raise_error(F.lit(f"value outside {lower}..{upper}"))))


def compare(a: Column, b: Column, sig_bits: int) -> Column:
    """Whether two doubles agree in so many bits of mantissa."""
    scale = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.abs(a), F.abs(b)))) - sig_bits)
    return F.coalesce((a == b) | (F.abs(a - b) <= scale), F.lit(False))


def truncate(c: Column) -> Column:
    return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))


def echo(value, n: Column) -> Column:
    return F.array_repeat(F.lit(value), n)


def restore_quality(quality: Column, mismatch: Column, matched: int) -> Column:
    """Stored qualities where the read differs from the reference, ``matched`` elsewhere; null where too few are stored."""

    def run(stored: pd.Series, differs: pd.Series) -> pd.Series:
        q, q_at = flat(stored)
        m, at = flat(differs)
        m = m.astype(bool)
        nth = np.cumsum(m) - np.repeat(np.concatenate(([0], np.cumsum(m)))[at[:-1]], np.diff(at)) - 1
        have = np.repeat(np.diff(q_at), np.diff(at))
        place = np.repeat(q_at[:-1], np.diff(at)) + nth
        found = m & (nth < have)
        out = np.full(len(m), matched, np.int64)
        out[found] = q[place[found]]
        if (m & ~found).any():
            out = np.where(m & ~found, None, out)
        return cells_of(out, at, differs)

    return F.pandas_udf(run, "array<int>")(quality, mismatch)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
