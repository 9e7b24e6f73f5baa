"""Per-sequence algorithms that built-in expressions can't say; Arrow functions and plain numpy."""

from __future__ import annotations

import re
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.functions.batch import linear_ops
from strandlake.functions.seq import CODE_1, count_of

#: pK values of side chains, of a chain's first and last residue, and residue masses: fixed values.
PK_POSITIVE = {"K": 10.0, "R": 12.0, "H": 5.98}
PK_NEGATIVE = {"D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0}
PK_FIRST = {"A": 7.59, "E": 7.7, "M": 7.0, "P": 8.36, "S": 6.93, "T": 6.82, "V": 7.44}
PK_LAST = {"D": 4.55, "E": 4.75}
PK_FIRST_ELSE, PK_LAST_ELSE = 7.5, 3.55
PI_PRECISION = 0.0001
MASS = {"A": 71.0788, "R": 156.1875, "N": 114.1038, "D": 115.0886, "C": 103.1388, "E": 129.1155, "Q": 128.1307, "G": 57.0519, "H": 137.1411, "I": 113.1594, "L": 113.1594, "K": 128.1741, "M": 131.1926, "F": 147.1766, "P": 97.1167, "S": 87.0782, "T": 101.1051, "W": 186.2132, "Y": 163.1760, "V": 99.1326, "U": 150.0388}
WATER = 18.01528


def net_charge(seq: Column, ph: Column) -> Column:
    """Henderson-Hasselbalch sum over the charged residues and both ends; null without a residue."""
    plus = lambda n, pk: n / (1 + F.pow(F.lit(10.0), ph - pk))
    minus = lambda n, pk: -n / (1 + F.pow(F.lit(10.0), pk - ph))
    pk_of = lambda residue, known, other: F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in known.items() for v in kv]), residue), F.lit(other))
    total = plus(F.lit(1.0), pk_of(F.substring(seq, 1, 1), PK_FIRST, PK_FIRST_ELSE)) + minus(F.lit(1.0), pk_of(F.substring(seq, -1, 1), PK_LAST, PK_LAST_ELSE))
    for aa, pk in PK_POSITIVE.items():
        total = total + plus(count_of(seq, aa), F.lit(pk))
    for aa, pk in PK_NEGATIVE.items():
        total = total + minus(count_of(seq, aa), F.lit(pk))
    return F.when(F.length(seq) > 0, total)


def isoelectric_points(seqs: list[str]) -> np.ndarray:
    """pH at which each chain's charge is nil, by bisection over 0 to 14 for all chains at once; NaN without a residue."""
    n = len(seqs)
    counts = np.array([[s.count(a) for a in (*PK_POSITIVE, *PK_NEGATIVE)] for s in seqs], np.float64).reshape(n, -1)
    first = np.array([PK_FIRST.get(s[:1], PK_FIRST_ELSE) for s in seqs])
    last = np.array([PK_LAST.get(s[-1:], PK_LAST_ELSE) for s in seqs])
    pos, neg = np.array(list(PK_POSITIVE.values())), np.array(list(PK_NEGATIVE.values()))
    low, high = np.zeros(n), np.full(n, 14.0)
    mid = (low + high) / 2
    width = 14.0
    while width > PI_PRECISION and n:
        mid = (low + high) / 2
        charge = 1 / (1 + 10 ** (mid - first)) - 1 / (1 + 10 ** (last - mid))
        charge += (counts[:, : len(pos)] / (1 + 10 ** (mid[:, None] - pos))).sum(1) - (counts[:, len(pos) :] / (1 + 10 ** (neg - mid[:, None]))).sum(1)
        low, high = np.where(charge > 0, mid, low), np.where(charge > 0, high, mid)
        width /= 2
    return np.where([len(s) > 0 for s in seqs], mid, np.nan)


@F.pandas_udf(T.DoubleType())
def isoelectric_point(s: pd.Series) -> pd.Series:
    """Isoelectric point to a precision of 0.0001; null without a residue."""
    p = isoelectric_points([x or "" for x in s])
    return pd.Series(p).astype(object).where(~np.isnan(p), None)


def molecular_weight(seq: Column) -> Column:
    """Sum of residue masses and one water; a residue without mass is an error."""
    masses = F.create_map(*[F.lit(v) for kv in MASS.items() for v in kv])
    each = F.transform(F.filter(F.split(seq, ""), lambda x: x != ""), lambda x: F.coalesce(F.element_at(masses, x), F.raise_error(F.concat(F.lit("no mass for "), x)).cast("double")))
    return F.aggregate(each, F.lit(WATER), lambda a, x: a + x)


def local_alignment(a: str, b: str, match: int = 1, mismatch: int = -1, gap_open: int = -3, gap_extend: int = -2) -> int:
    """Best local score with affine gaps (a gap of n costs open + n extend); rows by numpy, gaps along a row by a running maximum."""
    if not a or not b:
        return 0
    t = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    n = len(t)
    h, down, best = np.zeros(n + 1, np.int64), np.full(n + 1, -(1 << 40), np.int64), 0
    at = np.arange(n + 1) * gap_extend
    for ch in a:
        diagonal = np.concatenate(([0], h[:-1] + np.where(t == ord(ch), match, mismatch)))
        down = np.maximum(down, h + gap_open) + gap_extend
        row = np.maximum(np.maximum(diagonal, down), 0)
        # a gap along the row begins at some earlier cell of it
        run = np.maximum.accumulate(row - at + gap_open)
        row[1:] = np.maximum(row[1:], run[:-1] + at[1:])
        h, best = row, max(best, int(row.max()))
    return best


def global_alignment(a: str, b: str, match: int = 1, mismatch: int = -1, gap: int = -2) -> int:
    """Score of the best global alignment with linear gaps."""
    t = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    at = np.arange(len(t) + 1) * gap
    row = at.copy()
    for ch in a:
        new = np.concatenate(([row[0] + gap], np.maximum(row[:-1] + np.where(t == ord(ch), match, mismatch), row[1:] + gap)))
        row = np.maximum.accumulate(new - at) + at
    return int(row[-1])


def orfs(seq: str, least: int = 3, starts: tuple[str, ...] = ("ATG",), code: str = CODE_1) -> list[tuple[int, int, str]]:
    """(from, to, strand) of open reading frames on both strands, inclusive places on the given strand; to includes the stop."""
    out = []
    stops = {"TCAG"[k // 16] + "TCAG"[k // 4 % 4] + "TCAG"[k % 4] for k in range(64) if code[k] == "*"}
    for strand, s in (("+", seq.upper()), ("-", seq.upper()[::-1].translate(str.maketrans("ACGT", "TGCA")))):
        for frame in range(3):
            begin = None
            for i in range(frame, len(s) - 2, 3):
                codon = s[i : i + 3]
                if begin is None and codon in starts:
                    begin = i
                elif begin is not None and codon in stops:
                    if i - begin >= least:
                        a, b = begin, i + 2
                        out.append((a, b, strand) if strand == "+" else (len(s) - 1 - b, len(s) - 1 - a, strand))
                    begin = None
    return sorted(out)


def _orf_rows(s: pd.Series) -> pd.Series:
    return s.map(lambda x: [] if x is None else orfs(x))


def orf_table(df, seq: str, key: str):
    """One row for each open reading frame: (key, lo, hi, strand)."""
    udf = F.pandas_udf(_orf_rows, "array<struct<lo:int,hi:int,strand:string>>")
    return df.select(key, F.explode(udf(F.col(seq))).alias("o")).select(key, "o.*")


def neighbor_joining(names: list[str], d: np.ndarray) -> list[tuple[str, str, float]]:
    """Edges (parent, child, length) of the neighbour-joining tree of a distance matrix."""
    names, d, edges, made = list(names), d.astype(np.float64).copy(), [], 0
    while len(names) > 2:
        n = len(names)
        total = d.sum(1)
        q = (n - 2) * d - total[:, None] - total[None, :]
        np.fill_diagonal(q, np.inf)
        i, j = divmod(int(q.argmin()), n)
        half = d[i, j] / 2 + (total[i] - total[j]) / (2 * (n - 2))
        parent = f"node{made}"
        made += 1
        edges += [(parent, names[i], float(half)), (parent, names[j], float(d[i, j] - half))]
        new = (d[i] + d[j] - d[i, j]) / 2
        keep = [k for k in range(n) if k not in (i, j)]
        d = np.vstack((np.column_stack((d[np.ix_(keep, keep)], new[keep])), np.append(new[keep], 0)))
        names = [names[k] for k in keep] + [parent]
    if len(names) == 2:
        edges.append((names[1], names[0], float(d[0, 1])))
    return edges


def cpg_islands(seq: str, window: int = 200, least: int = 200, gc: float = 50.0, ratio: float = 60.0) -> list[tuple[int, int]]:
    """Inclusive stretches, of at least ``least``, made of windows with enough G+C and enough observed over expected CG."""
    s = np.frombuffer(seq.upper().encode("latin-1", "replace"), np.uint8)
    if len(s) < window:
        return []
    total = lambda hit: np.concatenate(([0], np.cumsum(hit)))
    c, g = total(s == 67), total(s == 71)
    pair = total(np.append((s[:-1] == 67) & (s[1:] == 71), False))
    lo = np.arange(len(s) - window + 1)
    nc, ng, npair = c[lo + window] - c[lo], g[lo + window] - g[lo], pair[lo + window - 1] - pair[lo]
    ok = (100.0 * (nc + ng) >= gc * window) & (100.0 * npair * window >= ratio * nc * ng) & (nc * ng > 0)
    out: list[list[int]] = []
    for k in np.flatnonzero(ok).tolist():
        if out and k <= out[-1][1] + 1:
            out[-1][1] = k + window - 1
        else:
            out.append([k, k + window - 1])
    return [(a, b) for a, b in out if b - a + 1 >= least]


def traceback(a: str, b: str, match: int = 1, mismatch: int = -1, gap: int = -2) -> tuple[int, str]:
    """(score, CIGAR) of a best global alignment of read ``a`` to reference ``b``; ties go to the diagonal, then to the insertion."""
    t = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    at = np.arange(len(t) + 1) * gap
    rows = [at.copy()]
    for ch in a:
        row = rows[-1]
        new = np.concatenate(([row[0] + gap], np.maximum(row[:-1] + np.where(t == ord(ch), match, mismatch), row[1:] + gap)))
        rows.append(np.maximum.accumulate(new - at) + at)
    i, j, ops = len(a), len(b), []
    while i or j:
        if i and j and rows[i][j] == rows[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
            ops.append("M")
            i, j = i - 1, j - 1
        elif i and rows[i][j] == rows[i - 1][j] + gap:
            ops.append("I")
            i -= 1
        else:
            ops.append("D")
            j -= 1
    cigar, k = "", len(ops)
    while k:
        n = 1
        while n < k and ops[k - 1 - n] == ops[k - 1]:
            n += 1
        cigar += f"{n}{ops[k - 1]}"
        k -= n
    return int(rows[-1][-1]), cigar


@F.pandas_udf(T.StructType().add("score", T.LongType()).add("cigar", T.StringType()))
def global_cigar(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Score and CIGAR of a best global alignment; long pairs by halves, in memory linear in their lengths."""

    def one(x: str, y: str) -> tuple[int, str]:
        if len(x) * len(y) <= 1 << 20:
            return traceback(x, y)
        score, ops = linear_ops(x, y)
        return score, "".join(f"{len(list(own))}{op}" for op, own in groupby(ops))

    return pd.DataFrame([one(x, y) for x, y in zip(a, b)], columns=["score", "cigar"])


def length_adjustment(query: int, subjects: int, count: int, k: float = 0.711, h: float = 1.31) -> int:
    """Largest whole l with l <= ln(k (query - l)(subjects - count l)) / h that leaves k (query - l)(subjects - count l) > max(query, subjects)."""

    def fits(x: int) -> bool:
        m, n = query - x, subjects - count * x
        return m > 0 and n > 0 and k * m * n > max(query, subjects) and x <= np.log(k * m * n) / h

    lo, hi = 0, min(query, subjects // max(count, 1))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if fits(mid) else (lo, mid - 1)
    return lo


def effective_space(query: int, subjects: int, count: int, k: float = 0.711, h: float = 1.31) -> int:
    """Search space after the adjustment of both lengths."""
    x = length_adjustment(query, subjects, count, k, h)
    return (query - x) * (subjects - count * x)


def bit_score(raw, lam: float = 1.374, k: float = 0.711):
    return (raw * lam - float(np.log(k))) / float(np.log(2))


def expect(bits, space: float):
    """Hits of this bit score or better that chance gives in a search space."""
    return F.lit(float(space)) * F.pow(F.lit(2.0), -bits)


def patristic(edges: list[tuple[str, str, float]]) -> dict[tuple[str, str], float]:
    """Distance along a tree of every pair of leaves, the smaller name first."""
    near: dict[str, list[tuple[str, float]]] = {}
    for a, b, n in edges:
        near.setdefault(a, []).append((b, n))
        near.setdefault(b, []).append((a, n))
    leaves = sorted(x for x, to in near.items() if len(to) == 1)
    out = {}
    for x in leaves:
        todo, seen = [(x, 0.0)], {x}
        while todo:
            at, far = todo.pop()
            if at > x and len(near[at]) == 1:
                out[x, at] = far
            for b, n in near[at]:
                if b not in seen:
                    seen.add(b)
                    todo.append((b, far + n))
    return out


def zero_negative(edges: list[tuple[str, str, float]]) -> list[tuple[str, str, float]]:
    return [(a, b, max(n, 0.0)) for a, b, n in edges]


def rerooted(edges: list[tuple[str, str, float]], leaf: str) -> list[tuple[str, str, float]]:
    """The same tree with a root in the middle of the edge to this leaf; edges are (parent, child, length)."""
    near: dict[str, list[tuple[str, float]]] = {}
    for a, b, n in edges:
        near.setdefault(a, []).append((b, n))
        near.setdefault(b, []).append((a, n))
    (other, n), = near[leaf]
    out, todo, seen = [("root", leaf, n / 2), ("root", other, n / 2)], [other], {leaf, other}
    while todo:
        at = todo.pop()
        for b, n in near[at]:
            if b not in seen:
                seen.add(b)
                out.append((at, b, n))
                todo.append(b)
    return out


#: Molecules of query and subject of each search program, and whether it translates either: fixed values.
PROGRAMS = {
    "blastn": ("nucleotide", "nucleotide", False, False), "blastp": ("protein", "protein", False, False), "blastx": ("nucleotide", "protein", True, False),
    "tblastn": ("protein", "nucleotide", False, True), "tblastx": ("nucleotide", "nucleotide", True, True), "psiblast": ("protein", "protein", False, False),
    "rpsblast": ("protein", "protein", False, False), "rpstblastn": ("nucleotide", "protein", True, False), "phiblastp": ("protein", "protein", False, False),
    "deltablast": ("protein", "protein", False, False), "rmblastn": ("nucleotide", "nucleotide", False, False),
}


def center_star(seqs: list[str]) -> list[str]:
    """Rows of one length of a multiple alignment: all are aligned to the sequence of best summed scores, and gaps once opened stay."""
    if not seqs:
        return []
    total = [sum(global_alignment(a, b) for b in seqs) for a in seqs]
    center = int(np.argmax(total))
    ins, edits = [0] * (len(seqs[center]) + 1), []
    for s in seqs:
        ops = [op for n, op in re.findall(r"(\d+)([MID])", traceback(s, seqs[center])[1]) for _ in range(int(n))]
        edits.append(ops)
        j = run = 0
        for op in [*ops, "M"]:
            if op == "I":
                run += 1
            else:
                ins[j] = max(ins[j], run)
                j, run = j + 1, 0
    out = []
    for s, ops in zip(seqs, edits):
        row, i, j, run = "", 0, 0, 0
        for op in [*ops, "end"]:
            if op == "I":
                row, i, run = row + s[i], i + 1, run + 1
                continue
            row += "-" * (ins[j] - run)
            if op != "end":
                row, i = (row + s[i], i + 1) if op == "M" else (row + "-", i)
            j, run = j + 1, 0
        out.append(row)
    return out
