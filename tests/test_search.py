"""Seeds, extensions, chains and statistics against plain versions."""

import itertools
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake import queries as own, search_queries as Q
from strandlake.functions import algorithms as A
from strandlake.functions import batch as B
from strandlake.functions import statistics as S
from strandlake.operators import search as H


def extension(q, s, qp, sp, word, match, mismatch, drop):
    """One letter at a time."""

    def side(step, i, j):
        total = best = length = n = 0
        while 0 <= i < len(q) and 0 <= j < len(s):
            total += match if q[i] == s[j] else mismatch
            n += 1
            if total > best:
                best, length = total, n
            if best - total > drop:
                break
            i, j = i + step, j + step
        return best, length

    up, far = side(1, qp + word, sp + word)
    down, back = side(-1, qp - 1, sp - 1)
    return (qp - back, qp + word - 1 + far, sp - back, sp + word - 1 + far, word * match + up + down)


def segments(queries, subjects, k, window, cutoff, match=1, mismatch=-2, drop=10):
    at = defaultdict(list)
    for j, s in subjects:
        for p in range(len(s) - k + 1):
            at[s[p : p + k]].append((j, p))
    hits = defaultdict(list)
    for i, q in queries:
        for p in range(len(q) - k + 1):
            for j, r in at[q[p : p + k]]:
                if i != j:
                    hits[i, j, p - r].append(p)
    q, s, out = dict(queries), dict(subjects), set()
    for (i, j, diagonal), places in hits.items():
        for p in places:
            if any(k <= p - o < window for o in places):
                x = extension(q[i], s[j], p, p - diagonal, k, match, mismatch, drop)
                if x[4] >= cutoff:
                    out.add((i, j, *x))
    return out


def test_extensions():
    rng = random.Random(3)
    draw = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    cases = []
    for n in (8, 9, 60, 200, 700):
        for _ in range(12):
            core = draw(n)
            left, right = draw(rng.randrange(0, 90)), draw(rng.randrange(0, 90))
            changed = "".join(rng.choice("ACGT") if rng.random() < 0.06 else c for c in core)
            q, s = left + core + right, draw(rng.randrange(0, 90)) + changed + draw(rng.randrange(0, 90))
            for p in range(0, len(q) - 3):
                r = s.find(q[p : p + 4])
                if r >= 0:
                    cases.append((q, s, p, r))
                    break
    for match, mismatch, drop in ((1, -2, 10), (1, -1, 0), (5, -4, 30)):
        got = B.extended([c[0] for c in cases], [c[1] for c in cases], [c[2] for c in cases], [c[3] for c in cases], 4, match, mismatch, drop)
        assert [tuple(r) for r in got.tolist()] == [extension(*c, 4, match, mismatch, drop) for c in cases]


def test_segments(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("ACGT") for _ in range(300))
    changed = lambda x, share: "".join(rng.choice("ACGT") if rng.random() < share else c for c in x)
    rows = [(k, changed(base[rng.randrange(0, 150) :][: rng.randrange(5, 150)], 0.1)) for k in range(14)] + [(20, None), (21, ""), (22, "ACG"), (23, base[:60]), (24, base[:60]), (25, "A" * 90)]
    df = spark.createDataFrame(rows, "id long, seq string").repartition(3)
    want = segments([r for r in rows if r[1]], [r for r in rows if r[1]], 5, 30, 8)
    assert want and set(map(tuple, H.segments(df, df, "id", "seq", 5, 30, 8).collect())) == want
    none = df.where("false")
    assert H.segments(none, df, "id", "seq", 5, 30, 8).count() == 0


def test_seeded_similarity(spark, sf):
    seqs = sorted((r.p_partkey, r.seq) for r in own.dna(spark, sf).collect())
    pairs = {(q, s) for q, s, *_ in segments(seqs, seqs, Q.WORD, Q.WINDOW, 10)}
    assert any(q > s for q, s in pairs)
    by, want = dict(seqs), defaultdict(list)
    for q, s in pairs:
        want[q].append((-A.local_alignment(by[q], by[s]), s))
    got = {(r.q, r["rank"]): (r.s, r.score) for r in own.queries()["seeded_similarity"](spark, sf).collect()}
    assert got == {(q, k): (s, -n) for q, own_ in want.items() for k, (n, s) in enumerate(sorted(own_)[:3], 1)}


def test_local_scores_of_many_pairs():
    rng = random.Random(1)
    draw = lambda: "".join(rng.choice("ACG日") for _ in range(rng.choice((0, 1, 5, 30, 31, 70, 200))))
    a, b = [draw() for _ in range(150)], [draw() for _ in range(150)]
    assert B.local_scores(a, b).tolist() == [A.local_alignment(x, y) for x, y in zip(a, b)]
    assert B.local_scores([], []).tolist() == []


def test_linear_memory_alignment():
    rng = random.Random(2)
    for _ in range(120):
        a, b = ("".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 40))) for _ in range(2))
        score, ops = B.linear_ops(a, b)
        assert score == A.traceback(a, b)[0] and ops.count("M") + ops.count("I") == len(a) and ops.count("M") + ops.count("D") == len(b)
        i = j = total = 0
        for op in ops:
            if op == "M":
                total, i, j = total + (1 if a[i] == b[j] else -1), i + 1, j + 1
            else:
                total, i, j = total - 2, i + (op == "I"), j + (op == "D")
        assert total == score


def follows(a, b, gap):
    return all(0 < lo - hi <= gap + 1 for lo, hi in ((b[0], a[1]), (b[2], a[3])))


def test_best_chain_of_all_subsets():
    rng = random.Random(7)
    for gap in (0, 3, 12, 1000):
        for _ in range(25):
            hits = []
            for _ in range(rng.randrange(1, 10)):
                q, s = rng.randrange(0, 30), rng.randrange(0, 30)
                hits.append((q, q + rng.randrange(0, 6), s, s + rng.randrange(0, 6), rng.randrange(-2, 9)))
            best, before = H.chained(*(np.array(c) for c in list(zip(*hits))[:4]), np.array([h[4] for h in hits], float), gap)
            most = {}
            for n in range(1, len(hits) + 1):
                for some in itertools.permutations(range(len(hits)), n) if n < 5 else ():
                    if all(follows(hits[x], hits[y], gap) for x, y in zip(some, some[1:])):
                        most[some[-1]] = max(most.get(some[-1], -(10**9)), sum(hits[k][4] for k in some))
            # chains of any length, by the plain recursion
            whole = {}
            for k in sorted(range(len(hits)), key=lambda k: hits[k][0]):
                whole[k] = hits[k][4] + max([0, *(whole[j] for j in whole if follows(hits[j], hits[k], gap))])
            assert best.tolist() == [whole[k] for k in range(len(hits))]
            assert all(whole[k] >= v for k, v in most.items())
            for k, j in enumerate(before.tolist()):
                assert j < 0 or follows(hits[j], hits[k], gap) and best[k] == hits[k][4] + best[j]
            chain = H.chains_of(best, before)
            assert set(chain) == set(range(chain.max() + 1))
            top = [k for k in range(len(hits)) if chain[k] == 0]
            assert math.isclose(sum(hits[k][4] for k in top), max(whole.values()))


LINKED = "q string, s string, q_lo int, q_hi int, s_lo int, s_hi int, score long, q_len int, s_len int"


def test_linked(spark):
    rng = random.Random(9)
    rows = []
    for q in "ab":
        for s in "xy":
            for _ in range(60):
                i, j = rng.randrange(0, 900), rng.randrange(0, 900)
                rows.append((q, s, i, i + 20, j, j + 20, rng.randrange(10, 40), 1000, 1000))
    rows += [rows[0], ("c", "x", 5, 9, 5, 9, 9, 1000, 1000), ("c", None, 5, 9, 5, 9, 9, 1000, 1000), ("c", "x", 5, 9, None, 9, 9, 1000, 1000)]
    gap, lam, k = 40, 1.33, 0.621
    got = H.linked(spark.createDataFrame(rows, LINKED).repartition(4), gap, lam, k).collect()
    assert sorted(tuple(r)[:7] for r in got) == sorted(r[:7] for r in rows if None not in r)
    link = math.log(k) + 2 * math.log(gap)
    parts = defaultdict(list)
    for r in got:
        parts[r.q, r.s, r.part].append(r)
    reach = {}
    for (q, s, _), own_ in sorted(parts.items(), key=lambda x: (x[0][0], x[0][1], x[0][2])):
        # no link leaves a stretch
        assert min(r.q_lo for r in own_) > reach.get((q, s), -(10**9)) + gap
        reach[q, s] = max(r.q_hi for r in own_)
        hits = [(r.q_lo, r.q_hi, r.s_lo, r.s_hi, lam * r.score - link) for r in own_]
        whole = {}
        for n in sorted(range(len(hits)), key=lambda n: hits[n][0]):
            whole[n] = hits[n][4] + max([0, *(whole[m] for m in whole if follows(hits[m], hits[n], gap))])
        chains = defaultdict(list)
        for r, h in zip(own_, hits):
            chains[r.chain].append((h, r))
        assert math.isclose(sum(h[4] for h, _ in chains[0]), max(whole.values()))
        for members in chains.values():
            members.sort(key=lambda m: m[0][0])
            assert all(follows(a[0], b[0], gap) for a, b in zip(members, members[1:]))
            want = S.linked_expect(len(members), lam * sum(r.score for _, r in members), k * 1e6, link)
            assert all(r.links == len(members) and math.isclose(r.expect, want, rel_tol=1e-2) for _, r in members)
    assert H.linked(spark.createDataFrame([], LINKED), gap, lam, k).collect() == []


def test_linked_queries_keep_every_hit(spark, sf):
    out = own.queries()["linked_lines"](spark, sf)
    assert out.count() == spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert out.agg(F.max("links")).first()[0] > 1
    items, docs = ({r.id: r.text for r in df.collect()} for df in Q._passages(spark, sf))
    got = own.queries()["passage_segments"](spark, sf).collect()
    for r in got:
        a, b = items[r.q][r.q_lo : r.q_hi + 1], docs[r.s][r.s_lo : r.s_hi + 1]
        assert len(a) == len(b) and sum(1 if x == y else -2 for x, y in zip(a, b)) == r.score >= 40
    # a document that holds a whole item has a segment of all of it
    whole = {(i, j) for i, t in items.items() for j, u in docs.items() if len(t) >= 48 and t in u}
    held = {(r.q, r.s) for r in got if r.q_lo == 0 and r.q_hi == len(items[r.q]) - 1}
    assert whole <= held
    chains = own.queries()["linked_passages"](spark, sf).collect()
    best = {(r.q, r.s): r for r in sorted(chains, key=lambda r: -r.expect)}
    assert all(best[p].expect < 1e-10 for p in whole)


def test_statistics_of_scores():
    # published values for nucleotide scores of even letters
    for mismatch, want in ((-1, (1.10, 0.333, 0.549)), (-2, (1.33, 0.621, 1.12)), (-3, (1.374, 0.711, 1.31)), (-4, (1.383, 0.738, 1.36))):
        assert [round(float(v[0]), len(str(w).split(".")[1])) for v, w in zip(S.karlin([1, mismatch], [0.25, 0.75]), want)] == list(want)
    lam = S.lambda_of([-2, 1, 5], [[0.8, 0.15, 0.05], [0.1, 0.8, 0.1], [1.0, 0.0, 0.0]])
    assert abs(0.8 * math.exp(-2 * lam[0]) + 0.15 * math.exp(lam[0]) + 0.05 * math.exp(5 * lam[0]) - 1) < 1e-9 and np.isnan(lam[1:]).all()
    # scores in steps of two are the same walk at half the rate
    a, b = S.karlin([1, -2], [0.3, 0.7]), S.karlin([2, -4], [0.3, 0.7])
    assert np.isclose(a[0] / 2, b[0]) and np.isclose(a[1], b[1]) and np.isclose(a[2], b[2])


def test_sums_of_scores():
    # tails fall from one, and the largest agree with the leading term
    for r in (2, 3, 5):
        tail = [S.sum_tail(r, float(s)) for s in range(-30, 60, 5)]
        assert abs(tail[0] - 1) < 1e-3 and all(x >= y - 1e-3 for x, y in zip(tail, tail[1:]))
    assert math.isclose(S.sum_tail(2, 40.0), math.exp(-40) * 40 / 2, rel_tol=0.05)
    # against sums of the largest of many draws: normalised scores are a Poisson process of rate e^-x
    rng = np.random.default_rng(4)
    top = -np.log(np.cumsum(rng.exponential(size=(200_000, 3)), 1))
    for r in (1, 2, 3):
        for s in (1.0, 3.0):
            assert abs((top[:, :r].sum(1) >= s).mean() - S.sum_tail(r, s)) < 0.004
    assert S.linked_expect(1, 30.0, 1e6, 5.0) < S.linked_expect(1, 20.0, 1e6, 5.0)


def test_target_frequencies():
    rng = np.random.default_rng(3)
    q = rng.random((4, 4)) + 0.05
    q = (q + q.T) / (q + q.T).sum()
    rows, cols = np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.4, 0.25, 0.25, 0.1])
    x = S.target_frequencies(q, rows, cols)
    assert np.allclose(x.sum(1), rows) and np.allclose(x.sum(0), cols)
    far = lambda y: float((y * np.log(y / q)).sum())
    for _ in range(50):  # no other table of these sums is nearer
        i, j, k, l = (*rng.choice(4, 2, replace=False), *rng.choice(4, 2, replace=False))
        y = x.copy()
        step = 1e-3 * min(x[i, k], x[j, l], x[i, l], x[j, k])
        y[[i, j], [k, l]] += step
        y[[i, j], [l, k]] -= step
        assert far(y) >= far(x) - 1e-12
    product = np.outer(rows, cols)
    told = lambda y: float((y * np.log(y / product)).sum())
    for share in (0.5, 1.4):
        y = S.target_frequencies(q, rows, cols, told(x) * share)
        assert np.isclose(told(y), told(x) * share) and np.allclose(y.sum(1), rows) and np.allclose(y.sum(0), cols)


def test_statistics_by_sequence(spark, sf):
    from strandlake.coding_queries import genome

    seqs = {r.item_id: r.seq for r in genome(spark, sf).collect()}
    counts = {i: np.array([s.count(b) + 1 for b in "ACGT"], float) for i, s in seqs.items()}
    whole = sum(counts.values())
    whole = whole / whole.sum()
    got = {r.item_id: r for r in own.queries()["score_statistics"](spark, sf).collect()}
    cells = defaultdict(dict)
    for r in own.queries()["adjusted_frequencies"](spark, sf).collect():
        cells[r.item_id][r.n] = r
    assert set(got) == set(cells) == set(seqs)
    for i, c in counts.items():
        share = c / c.sum()
        same = float(share @ whole)
        lam = got[i]["lambda"]
        assert abs(same * math.exp(lam) + (1 - same) * math.exp(-2 * lam) - 1) < 1e-4
        f = np.array([[cells[i][4 * a + b].f for b in range(4)] for a in range(4)])
        assert np.allclose(f.sum(1), share, atol=1e-7) and np.allclose(f.sum(0), whole, atol=1e-7)
        bits = np.array([[cells[i][4 * a + b].bits for b in range(4)] for a in range(4)])
        assert np.allclose(bits, np.log2(f / np.outer(share, whole)), atol=1e-3) and (np.diag(bits) > 0).all()


@pytest.mark.parametrize("name", ["two_hit_seeds", "passage_segments", "linked_passages", "linked_lines", "score_statistics", "adjusted_frequencies", "seeded_similarity"])
def test_search_queries_run(spark, sf, name):
    assert own.queries()[name](spark, sf).columns
