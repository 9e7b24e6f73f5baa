"""Per-sequence algorithms against plain versions and known values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import algorithms as A


def slow_local(a, b):
    """Affine local alignment, cell by cell."""
    none = -(10**9)
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    e = [[none] * (len(b) + 1) for _ in range(len(a) + 1)]
    f = [[none] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            e[i][j] = max(e[i][j - 1], h[i][j - 1] - 3) - 2
            f[i][j] = max(f[i - 1][j], h[i - 1][j] - 3) - 2
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1), e[i][j], f[i][j])
            best = max(best, h[i][j])
    return best


def slow_global(a, b):
    row = [-2 * j for j in range(len(b) + 1)]
    for i, ch in enumerate(a, 1):
        new = [-2 * i]
        for j, other in enumerate(b, 1):
            new.append(max(row[j - 1] + (1 if ch == other else -1), row[j] - 2, new[-1] - 2))
        row = new
    return row[-1]


def test_alignments():
    rng = random.Random(1)
    for _ in range(150):
        a, b = ("".join(rng.choices("ACGT"[: rng.randrange(1, 5)], k=rng.randrange(0, 40))) for _ in range(2))
        assert A.local_alignment(a, b) == slow_local(a, b)
        assert A.global_alignment(a, b) == slow_global(a, b)
    assert A.local_alignment("ACGTACGTAAACGTACGT", "ACGTACGTACGTACGT") == 9 and A.local_alignment("", "A") == 0


def test_orfs():
    assert A.orfs("CCATGAAATAACC") == [(2, 10, "+")]
    rc = "CCATGAAATAACC"[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert A.orfs(rc) == [(2, 10, "-")]
    assert A.orfs("ATGAAA") == []


def test_protein(spark):
    # charges by the formula, residue by residue, and points worked out by hand from it
    def charge(seq, ph):
        first = {"A": 7.59, "E": 7.7, "M": 7.0, "P": 8.36, "S": 6.93, "T": 6.82, "V": 7.44}.get(seq[0], 7.5)
        last = {"D": 4.55, "E": 4.75}.get(seq[-1], 3.55)
        total = 1 / (1 + 10 ** (ph - first)) - 1 / (1 + 10 ** (last - ph))
        for c in seq:
            if c in "KRH":
                total += 1 / (1 + 10 ** (ph - {"K": 10.0, "R": 12.0, "H": 5.98}[c]))
            if c in "DECY":
                total -= 1 / (1 + 10 ** ({"D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0}[c] - ph))
        return total

    seqs = ["ACDK", "GG", "MKRHE", "PPPD", "STVWY", "E", "KKKKKKKK", "DDDD"]
    df = spark.createDataFrame([(s,) for s in [*seqs, "", None]], "s string")
    got = {r.s: r for r in df.select("s", A.isoelectric_point("s").alias("p"), A.net_charge(F.col("s"), F.lit(7.0)).alias("c")).collect()}
    for s in seqs:
        low, high = 0.0, 14.0
        while high - low > 0.0001:
            mid = low + (high - low) / 2
            low, high = (mid, high) if charge(s, mid) > 0 else (low, mid)
        assert abs(got[s].p - mid) < 1e-9 and abs(got[s].c - charge(s, 7.0)) < 1e-9
    assert abs(got["GG"].p - (7.5 + 3.55) / 2) < 1e-3 and got[""].p is None and got[None].p is None and got[""].c is None
    row = spark.sql("select 'GG' as s").select(F.round(A.molecular_weight(F.col("s")), 3).alias("w")).first()
    assert row.w == 132.119
    with pytest.raises(Exception, match="no mass"):
        spark.sql("select 'G1' as s").select(A.molecular_weight(F.col("s"))).collect()


def test_neighbor_joining_recovers_an_additive_tree():
    # ((a:2,b:3):1,(c:4,d:1))
    d = np.array([[0, 5, 7, 4], [5, 0, 8, 5], [7, 8, 0, 5], [4, 5, 5, 0]], float)
    edges = A.neighbor_joining(list("abcd"), d)
    near = {}
    for p, c, n in edges:
        near.setdefault(p, {})[c] = near.setdefault(c, {})[p] = n

    def path(x, goal, seen=()):
        return 0.0 if x == goal else min((n + path(y, goal, (*seen, x)) for y, n in near[x].items() if y not in seen), default=float("inf"))

    assert all(abs(path(x, y) - d[i, j]) < 1e-9 for i, x in enumerate("abcd") for j, y in enumerate("abcd"))


def test_cpg_islands():
    seq = "AT" * 200 + "CG" * 150 + "AT" * 200
    [(lo, hi)] = A.cpg_islands(seq)
    assert 200 < lo < 400 and 700 < hi < 900 and A.cpg_islands("ACGT") == []
