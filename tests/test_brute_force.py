"""Queries that SQL can't express, against brute force on the small tables."""

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from strandlake import coding_queries, domain_queries, format_queries, lookup_queries, queries as own, read_queries, restore_queries, search_queries  # noqa: F401  the others register their own
from strandlake.functions import coding as K
from strandlake.functions import text as X


def rows(spark, sf, name):
    return [tuple(r) for r in own.queries()[name](spark, sf).collect()]


def table(spark, sf, name, *cols):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*cols).collect()]


def sequences(spark, sf):
    return {r.p_partkey: r.seq for r in own.dna(spark, sf).collect()}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def words_of(text):
    return [w for w in re.split(r"[^\w]|_", text.lower()) if w]


def test_stems(spark, sf):
    want = Counter()
    for (text,) in table(spark, sf, "documents", "text"):
        for w in words_of(text or ""):
            want[X.porter(w)] += 1
    assert dict(rows(spark, sf, "text_stems")) == dict(want)


def test_edit_distances(spark, sf):
    items = table(spark, sf, "benchmark", "item_id", "text")
    want = {(a, b, distance(x, y)) for a, x in items for b, y in items if a < b}
    assert set(rows(spark, sf, "text_edit_distance_all")) == want


def test_alternates_and_suggestions(spark, sf):
    docs = defaultdict(set)
    for i, text in table(spark, sf, "documents", "doc_id", "text"):
        for w in words_of(text or ""):
            docs[w].add(i)
    # some words against all others
    some = sorted(docs)[::300]
    got = defaultdict(list)
    for r in own.queries()["dictionary_alternates_all"](spark, sf).collect():
        got[r.w].append((r.dist, r.alternate))
    for w in some:
        near = sorted((d, v) for v in docs if v != w and abs(len(v) - len(w)) <= 2 and (d := distance(w, v)) <= 2)
        assert sorted(got[w]) == near[:20]
    got = defaultdict(list)
    for r in own.queries()["dictionary_suggestions"](spark, sf).collect():
        got[r.w].append((r.rank, r.suggestion, r.score))
    words = spark.createDataFrame([(w,) for w in docs], "w string")
    key = {r.w: r.k for r in words.select("w", K.metaphone(F.col("w")).alias("k")).collect()}
    asked = sorted(w for w in docs if len(docs[w]) == 1)
    known = defaultdict(list)
    for v in docs:
        if len(docs[v]) > 1:
            known[len(v)].append(v)
    for w in asked[::200] + [w for w in asked if len(w) < 3][:20]:
        near = [(-(max(len(w), len(v)) - d - distance(key[w], key[v])), v) for n in range(len(w) - 2, len(w) + 3) for v in known[n] if (d := distance(w, v)) <= 2]
        assert sorted(got[w]) == [(k, v, -s) for k, (s, v) in enumerate(sorted(near)[:3], 1)]
    assert set(got) <= set(asked)


def test_approximate_search(spark, sf):
    got = dict(rows(spark, sf, "text_approximate_search"))
    for i, text in table(spark, sf, "documents", "doc_id", "text")[:25]:
        # fewest edits of the phrase at any end, by the plain table
        row = [0] * (len(text) + 1)
        for k, ch in enumerate("tokens"):
            new = [k + 1]
            for j, t in enumerate(text):
                new.append(min(row[j] + (t != ch), row[j + 1] + 1, new[j] + 1))
            row = new
        best = min(row)
        assert got.get(i) == (row.index(best) - 1 if best <= 2 else None)


def test_repeats(spark, sf):
    want = set()
    for p, s in sequences(spark, sf).items():
        for m in re.finditer(r"([ACGT]{2})\1+", s):
            want.add((p, m.group(0)))
    got = own.queries()["dinucleotide_repeats"](spark, sf)
    x = got.join(own.dna(spark, sf), "p_partkey")
    cols = [c for c in got.columns if c != "p_partkey"]
    assert got.count() == len([1 for s in sequences(spark, sf).values() for _ in re.finditer(r"([ACGT]{2})\1+", s)]), cols
    assert x.count() == got.count()


def test_global_alignments(spark, sf):
    seqs = sequences(spark, sf)
    for p, score, cigar in rows(spark, sf, "global_alignments")[:40]:
        a, b = seqs[p], seqs[p + 1]
        row = [-2 * j for j in range(len(b) + 1)]
        for i, x in enumerate(a):
            new = [-2 * (i + 1)]
            for j, y in enumerate(b):
                new.append(max(row[j] + (1 if x == y else -1), row[j + 1] - 2, new[j] - 2))
            row = new
        assert score == row[-1]
        # the path spells both sequences and has the score that it claims
        i = j = total = 0
        for n, op in re.findall(r"(\d+)([MID=X])", cigar):
            for _ in range(int(n)):
                if op in "M=X":
                    total += 1 if a[i] == b[j] else -1
                    i, j = i + 1, j + 1
                elif op == "I":
                    total, i = total - 2, i + 1
                else:
                    total, j = total - 2, j + 1
        assert {(i, j), (j, i)} & {(len(a), len(b))} and total == score


def merged(spans_):
    out = []
    for lo, hi in sorted(spans_):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def kind_of(a, b):
    """How b lies to a on the forward strand, told rule by rule."""
    if a[-1][1] < b[0][0] or b[-1][1] < a[0][0]:
        return "missing"
    if a == b:
        return "same"
    if len(a) == len(b):
        if [(0, a[0][1]), *a[1:]] == [(0, b[0][1]), *b[1:]]:
            return "5'_extension"
        if [*a[:-1], (a[-1][0], 0)] == [*b[:-1], (b[-1][0], 0)]:
            return "3'_extension"
    shared, extra, missing = set(a) & set(b), [e for e in b if e not in a], [e for e in a if e not in b]
    if shared and not extra:
        return "missing_exon"
    if shared and not missing and extra:
        if all(e[1] < a[0][0] for e in extra):
            return "5'_extra_exon"
        if all(e[0] > a[-1][1] for e in extra):
            return "3'_extra_exon"
    if all(any(x[0] <= y[0] and x[1] >= y[1] for x in a) for y in b):
        return "subset"
    if shared:
        return "complex"
    return "overlap" if any(x[0] <= y[1] and y[0] <= x[1] for x in a for y in b) else "region_overlap"


def test_annotation_compare(spark, sf):
    status = dict(table(spark, sf, "orders", "o_orderkey", "o_orderstatus"))
    sides = defaultdict(lambda: ([], []))
    for r in own.spans(spark, sf).collect():
        if status[r.o_orderkey] in "FO":
            sides[r.o_custkey][status[r.o_orderkey] == "O"].append((r.lo, r.hi))
    want = Counter(kind_of(merged(a), merged(b)) for a, b in sides.values() if a and b)
    assert len(want) > 1 and dict(rows(spark, sf, "annotation_compare")) == dict(want)


def test_label_tree(spark, sf):
    """The whole tree against neighbour joining by dictionaries, one sum at a time."""
    sums = defaultdict(lambda: [0, None])
    for label, v in table(spark, sf, "embeddings", "label", "embedding"):
        n, s = sums[str(label)]
        sums[str(label)] = [n + 1, [float(x) for x in v] if s is None else [x + y for x, y in zip(s, v)]]
    mean = {k: [x / n for x in s] for k, (n, s) in sums.items()}
    d = {(a, b): sum((x - y) ** 2 for x, y in zip(mean[a], mean[b])) ** 0.5 for a in mean for b in mean}
    live, want, made = sorted(mean, key=int), [], 0
    while len(live) > 2:
        total = {a: sum(d[a, b] for b in live) for a in live}
        _, a, b = min(((len(live) - 2) * d[a, b] - total[a] - total[b], a, b) for i, a in enumerate(live) for b in live[i + 1 :])
        half = d[a, b] / 2 + (total[a] - total[b]) / (2 * (len(live) - 2))
        new, made = f"node{made}", made + 1
        want += [(new, a, half), (new, b, d[a, b] - half)]
        rest_ = [c for c in live if c not in (a, b)]
        for c in rest_:
            d[new, c] = d[c, new] = (d[a, c] + d[b, c] - d[a, b]) / 2
        d[new, new] = 0.0
        live = rest_ + [new]
    want.append((live[1], live[0], d[live[0], live[1]]))
    got = rows(spark, sf, "label_tree")
    assert {(p, c) for p, c, _ in got} == {(p, c) for p, c, _ in want}
    length = {(p, c): n for p, c, n in want}
    assert all(abs(length[p, c] - n) < 1e-6 for p, c, n in got)
