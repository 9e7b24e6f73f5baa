"""Stretches of low complexity, antigenic sites and frequent words; numpy over whole sequences, one Arrow batch at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Spans = list[tuple[int, int]]

#: Antigenic propensity of each residue: fixed values.
PROPENSITY = {
    "A": 1.06383, "B": 0.77624, "C": 1.41226, "D": 0.86646, "E": 0.85083, "F": 1.09132, "G": 0.87413, "H": 1.10505, "I": 1.15173,
    "K": 0.93026, "L": 1.25039, "M": 0.82567, "N": 0.77624, "P": 1.06383, "Q": 1.01542, "R": 0.87254, "S": 1.01219, "T": 0.90884,
    "V": 1.38428, "W": 0.89290, "X": 0.77624, "Y": 1.16148, "Z": 0.85083,
}


def runs(hit: np.ndarray) -> Spans:
    """Inclusive stretches of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    return [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2])]


def _covered(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Places that windows at these starts cover."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + window, -1)
    return np.cumsum(d)[:n] > 0


def window_entropy(seq: str, window: int) -> np.ndarray:
    """Bits of residue entropy of each window."""
    s = np.frombuffer(seq.upper().encode("latin-1", "replace"), np.uint8)
    if len(s) < window:
        return np.zeros(0)
    bits = np.zeros(len(s) - window + 1)
    for ch in np.unique(s):
        total = np.concatenate(([0], np.cumsum(s == ch)))
        p = (total[window:] - total[:-window]) / window
        bits -= np.where(p > 0, p * np.log2(np.where(p > 0, p, 1)), 0)
    return bits


def low_complexity(seq: str, window: int = 12, locut: float = 2.2, hicut: float = 2.5) -> Spans:
    """Stretches of windows of entropy up to ``hicut`` that contain one of entropy up to ``locut``."""
    bits = window_entropy(seq, window)
    starts = [k for a, b in runs(bits <= hicut + 1e-9) if bits[a : b + 1].min() <= locut + 1e-9 for k in range(a, b + 1)]
    return runs(_covered(np.array(starts, np.int64), window, len(seq))) if starts else []


def triplet_scores(seq: str, window: int) -> np.ndarray:
    """Of each window of bases: sum of c (c - 1) over its triplets, by 2 (window - 3); 0 for windows of 3 or less."""
    s = np.frombuffer(seq.upper().encode("latin-1", "replace"), np.uint8).astype(np.int64)
    if len(s) < window:
        return np.zeros(0)
    if window <= 3:
        return np.zeros(len(s) - window + 1)
    t = (s[:-2] << 16) | (s[1:-1] << 8) | s[2:]
    m = window - 2
    score = np.zeros(len(t) - m + 1)
    for v in np.unique(t):
        total = np.concatenate(([0], np.cumsum(t == v)))
        c = total[m:] - total[:-m]
        score += c * (c - 1)
    return score / (2.0 * (window - 3))


def triplet_mask(seq: str, window: int = 64, level: float = 2.0) -> Spans:
    """Places of windows whose triplet score exceeds the level; a shorter sequence is one window."""
    w = min(window, len(seq))
    starts = np.flatnonzero(triplet_scores(seq, w) > level) if w > 3 else np.zeros(0, np.int64)
    return runs(_covered(starts, w, len(seq))) if len(starts) else []


def antigenic(seq: str, least: int = 6) -> Spans:
    """Runs of ``least`` centres or more where the mean propensity of 7 residues reaches the protein's mean, or 1 if that is less."""
    if len(seq) < 7:
        return []
    p = np.array([PROPENSITY.get(ch, 0.0) for ch in seq.upper()])
    local = np.convolve(p, np.ones(7), "valid") / 7
    return [(a + 3, b + 3) for a, b in runs(local >= min(p.mean(), 1.0)) if b - a + 1 >= least]


def span_table(df: DataFrame, key: str, seq: str, find, **options) -> DataFrame:
    """(key, lo, hi) of the stretches that a function of this module finds in each sequence, from 0 and inclusive; none of null."""

    def rows(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [] if x is None else find(x, **options))

    udf = F.pandas_udf(rows, "array<struct<lo:int,hi:int>>")
    return df.select(key, F.explode(udf(F.col(seq))).alias("m")).select(key, "m.lo", "m.hi")


def word_thresholds(counts: DataFrame, shares: tuple[float, ...] = (0.9, 0.95, 0.99, 0.995)) -> list[int]:
    """Counts below which these shares of the distinct words lie; exact, from one row a distinct count."""
    freq = counts.groupBy("n").agg(F.count("*").alias("words"))
    return list(freq.agg(*[F.percentile("n", F.lit(s), F.col("words")).cast("int").alias(f"t{k}") for k, s in enumerate(shares)]).first())
