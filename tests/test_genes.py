"""Spliced alignment, gene prediction, collapsing and chaining against plain versions."""

import itertools
import random
from functools import lru_cache

import pytest

from strandlake import queries as own, restore_queries as Q
from strandlake.functions import genes as G
from strandlake.functions import splicing as P
from strandlake.operators import genes as N

NONE = -(10**9)


def best_spliced(q, g, s):
    """Score of the best alignment of all of q with some of g, cell by cell."""
    m = len(g)
    whole, gap = [0] * (m + 1), [NONE] * (m + 1)
    for c in q:
        gap = [max(whole[j] + s.gap_open, gap[j]) + s.gap_extend for j in range(m + 1)]
        base = [max(gap[j], whole[j - 1] + (s.match if g[j - 1] == c else s.mismatch) if j else NONE) for j in range(m + 1)]
        whole = base[:]
        for j in range(m + 1):
            for k in range(j):
                whole[j] = max(whole[j], base[k] + s.gap_open + s.gap_extend * (j - k))
                if j - k >= s.least:
                    whole[j] = max(whole[j], base[k] + max([s.introns[t] for t, x in enumerate(P.SITES) if x == (g[k : k + 2], g[j - 2 : j])] + [s.other]))
    return max(whole)


def test_spliced_alignment():
    rng = random.Random(1)
    draw = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    schemes = (P.Scheme(least=4, introns=(-3, -4, -5), other=-7), P.Scheme(least=3, introns=(-2, -3, -4), other=-6, gap_open=-1), P.Scheme(gap_open=-5, least=5, introns=(-4, -4, -4), other=-5))
    for k in range(90):
        s = schemes[k % 3]
        parts = [draw(rng.randrange(3, 12)) for _ in range(3)]
        g = draw(5) + parts[0] + "GT" + draw(6) + "AG" + parts[1] + "GC" + draw(5) + "AG" + parts[2] + draw(4)
        q = "".join(c + (draw(1) if rng.random() < 0.05 else "") for c in "".join(parts) if rng.random() > 0.05)
        if k % 5 == 0:
            q, g = draw(rng.randrange(1, 10)), draw(rng.randrange(1, 25))
        score, a, b = P.best_place(q, g, s)
        assert score == best_spliced(q, g, s)
        for cells in (1, 40, 1 << 18):  # by halves down to single rows, and whole
            ops = P.spliced_ops(q, g[a:b], s, cells)
            assert P.score_of(ops, q, g[a:b], s) == score
            assert sum(n for o, n in ops if o in "MI") == len(q) and sum(n for o, n in ops if o in "MDN") == b - a
    assert P.exons("", "ACGT") == P.exons("ACGT", "") == (0, "", [])


def test_exons_of_a_long_gene():
    rng = random.Random(5)
    draw = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    parts = [draw(90) for _ in range(4)]
    g = draw(300) + parts[0] + "GT" + draw(500) + "AG" + parts[1] + "GT" + draw(700) + "AG" + parts[2] + "GC" + draw(300) + "AG" + parts[3] + draw(200)
    score, cigar, exons = P.exons("".join(parts), g.lower())
    assert (score, cigar) == (360 - 8 - 8 - 12, "90M504N90M704N90M304N90M")
    assert [(e[0], e[1], e[4], e[5][:2] if k else "", e[5][3:] if k < 3 else "") for k, e in enumerate(exons)] == [
        (0, 89, 90, "", "GT"), (90, 179, 90, "AG", "GT"), (180, 269, 90, "AG", "GC"), (270, 359, 90, "AG", "")]
    assert all(g[e[2] : e[3] + 1] == parts[k] for k, e in enumerate(exons))


def best_parse(seq, mo):
    """Score of the best parse by plain recursion over the rest of the sequence."""
    m, most = len(seq), len(mo.lengths) - 1

    @lru_cache(None)
    def between(p):
        if p >= m:
            return 0.0
        return max(between(p + 1), mo.gene + exon(p, 0, True) if seq[p : p + 3] == "ATG" else -1e18)

    @lru_cache(None)
    def exon(i, phase, opens=False):
        first = i + (3 - phase) % 3
        stop = next((x for x in range(first, m - 2, 3) if seq[x : x + 3] in G.STOPS), None)
        told = lambda end: sum(mo.coding.get(seq[x : x + 3], 0.0) for x in range(first, end, 3))
        best = -1e18
        for j in range(max(i + 1, first, i + 3 if opens else 0), min(m, i + most) + 1):
            if stop is not None and j > stop + 2:
                break
            if seq[j : j + 2] == "GT":
                best = max(best, mo.lengths[j - i] + told(j - 2) + intron(j, (phase + j - i) % 3))
        if stop is not None and stop + 3 - i <= most:
            best = max(best, mo.lengths[stop + 3 - i] + told(stop) + between(stop + 3))
        return best

    @lru_cache(None)
    def intron(j, phase):
        return max([-1e18, *(mo.intron + mo.intron_base * (e - j) + exon(e, phase) for e in range(j + mo.least_intron, m + 1) if seq[e - 2 : e] == "AG")])

    return between(0)


def test_gene_prediction():
    rng, found = random.Random(2), 0
    for _ in range(250):
        seq = "".join(rng.choice(["A", "C", "G", "T", "ATG", "GT", "AG", "TAA"]) for _ in range(rng.randrange(3, 50)))
        coding = {c: rng.uniform(-1, 1.5) for c in G.CODONS if c not in G.STOPS}
        lengths = (G.NONE, *(rng.uniform(-1, 0.5) for _ in range(rng.choice([12, 60]))))
        mo = G.Model(coding, rng.choice([-1.0, 0.0, -0.3]), -0.4, -0.01, rng.choice([4, 6]), lengths)
        got = G.predicted(seq, mo)
        assert abs(sum(s for s, _ in got) - max(0, best_parse(seq, mo))) < 1e-9
        end = -1
        for _, exons in got:
            cds = "".join(seq[a : b + 1] for a, b in exons)
            assert cds[:3] == "ATG" and cds[-3:] in G.STOPS and len(cds) % 3 == 0
            assert all(a[1] + mo.least_intron < b[0] + 1 and seq[a[1] + 1 : a[1] + 3] == "GT" and seq[b[0] - 2 : b[0]] == "AG" for a, b in zip(exons, exons[1:]))
            assert exons[0][0] > end
            end, found = exons[-1][1], found + 1
    assert found > 100 and G.predicted("", G.Model()) == G.predicted("ATGTAA", G.Model()) == []


def test_genes_of_both_strands(spark):
    cds = "ATGGCTGCTGCTGCTGCTTAA"
    mo = G.Model({"GCT": 2.0}, gene=-1.0, lengths=G.length_chances(20.0, 0.7, 100))
    back = cds[::-1].translate(str.maketrans("ACGT", "TGCA"))
    df = spark.createDataFrame([(1, "CC" + cds + "CC"), (2, "CCC" + back), (3, None), (4, ""), (5, "CCCC")], "id long, seq string")
    got = sorted((r.id, r.strand, [(e.lo, e.hi) for e in r.exons]) for r in N.predicted_genes(df, "id", "seq", mo).collect())
    assert got == [(1, "+", [(2, 22)]), (2, "-", [(3, 23)])]
    assert N.codon_counts(spark.createDataFrame([("ATGGCTGC",), (None,), ("AT",), ("NNNGCT",)], "c string"), "c") == {"ATG": 1, "GCT": 2}
    shares = N.base_shares(df, "seq")
    assert abs(sum(shares.values()) - 1) < 1e-12


MODELS = "ref string, strand string, lo long, hi long, introns array<struct<lo:bigint,hi:bigint>>, n long"


def test_chained_models(spark):
    rng = random.Random(3)
    rows = []
    for ref in "ab":
        for _ in range(9):
            lo = rng.randrange(0, 60)
            hi = lo + rng.randrange(20, 60)
            introns = [(a, b) for a, b in ((25, 30), (45, 50), (70, 75), (47, 52)) if lo < a and b < hi and rng.random() < 0.8]
            introns = [x for k, x in enumerate(introns) if not k or introns[k - 1][1] < x[0]]
            rows.append((ref, "+", lo, hi, introns, rng.randrange(1, 9)))
    rows.append(("a", "-", 0, 99, [(25, 30)], 3))
    got = N.chained_models(spark.createDataFrame(rows, MODELS).repartition(3)).collect()
    assert sum(r.members for r in got) == len(rows) and sum(r.n for r in got) == sum(r[5] for r in rows)
    for ref in "ab":
        own_ = [(r[2], r[3], r[4], r[5]) for r in rows if r[0] == ref and r[1] == "+"]
        worth = 0
        for n in range(1, 6):
            for some in itertools.permutations(own_, n) if n < 5 else ():
                if all(N._agree(a, b) for a, b in zip(some, some[1:])):
                    worth = max(worth, sum(x[3] for x in some))
        best = max(r.n for r in got if r.ref == ref and r.strand == "+" and r.chain == 0)
        assert best >= worth
        # the plain recursion over all members
        order = sorted(own_)
        whole = []
        for k, b in enumerate(order):
            whole.append(b[3] + max([0, *(whole[j] for j in range(k) if N._agree(order[j], b))]))
        assert best == max(whole)
    assert N.chained_models(spark.createDataFrame([], MODELS)).count() == 0


def test_transcripts_by_query(spark, sf):
    c = own.queries()["collapsed_alignments"](spark, sf)
    chains = own.queries()["chained_transcripts"](spark, sf)
    assert chains.groupBy().sum("n").first()[0] == c.groupBy().sum("n").first()[0]
    assert chains.groupBy().sum("members").first()[0] == c.count()
    seqs = {r.item_id: r.seq for r in Q.genome(spark, sf).collect()}
    rows = own.queries()["spliced_alignments"](spark, sf).collect()
    assert len(rows) > 10
    for r in rows[:6]:
        seq, filler = seqs[r.item_id], seqs[r.item_id + 1][20:80]
        g = filler[:25] + seq[:70] + "GT" + filler + "AG" + seq[70:120] + filler[29:49]
        assert r.score == best_spliced(seq[:120], g, P.Scheme())
    for r in own.queries()["predicted_genes"](spark, sf).collect():
        x = seqs[r.item_id] if r.strand == "+" else seqs[r.item_id][::-1].translate(str.maketrans("ACGT", "TGCA"))
        places = [tuple(map(int, e.split(".."))) for e in r.exons.split(",")]
        if r.strand == "-":
            places = [(len(x) - 1 - b, len(x) - 1 - a) for a, b in reversed(places)]
        cds = "".join(x[a : b + 1] for a, b in places)
        assert cds[:3] == "ATG" and cds[-3:] in G.STOPS and len(cds) % 3 == 0 and r.score > 0


@pytest.mark.parametrize("cigar, want", [("5M", []), ("3S5M10N4M2D7N1M", [(15, 24), (31, 37)]), ("2N3M", [(10, 11)])])
def test_introns(spark, cigar, want):
    from pyspark.sql import functions as F

    (r,) = spark.createDataFrame([(10, cigar)], "pos long, cigar string").select(N.introns(F.col("pos"), F.col("cigar")).alias("i")).collect()
    assert [(x.lo, x.hi) for x in r.i] == want
