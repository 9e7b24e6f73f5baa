"""Reads as differences, and re-sorted tables, against plain versions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import differences as D
from strandlake.operators import restore as R


def drawn(rng):
    """(read, cigar, window) with every kind of part, insertions next to gaps and clips included."""
    ops = [(rng.choice("MMMMIDN=X"), rng.randrange(1, 6)) for _ in range(rng.randrange(1, 8))]
    ops = [o for k, o in enumerate(ops) if not k or ops[k - 1][0] != o[0]]
    while ops and ops[-1][0] in "DN":
        ops.pop()
    ops = ops or [("M", 4)]
    if rng.random() < 0.4:
        ops.insert(0, ("S", rng.randrange(1, 5)))
    if rng.random() < 0.4:
        ops.append(("S", rng.randrange(1, 5)))
    window = "".join(rng.choice("ACGT") for _ in range(sum(n for o, n in ops if o in "MDN=X") + rng.randrange(0, 3)))
    read, at = "", 0
    for o, n in ops:
        if o in "M=X":
            read += "".join(c if o == "=" or o == "M" and rng.random() < 0.8 else "TGCA"["ACGT".index(c)] for c in window[at : at + n])
        elif o in "IS":
            read += "".join(rng.choice("ACGT") for _ in range(n))
        at += n if o in "MDN=X" else 0
    return read, "".join(f"{n}{o}" for o, n in ops), window


def plain(read, cigar, window):
    """What a read's CIGAR tells, one base at a time: (normalised CIGAR, with = and X, clips, edits)."""
    parts = [[o, int(n)] for n, o in re.findall(r"(\d+)(\D)", cigar)]
    for _ in parts:  # insertions and clips before the gaps that they follow
        for k in range(len(parts) - 1):
            if parts[k][0] in "DN" and parts[k + 1][0] in "IS":
                parts[k], parts[k + 1] = parts[k + 1], parts[k]
    states, i, r, edits = [], 0, 0, 0
    for o, n in parts:
        if o in "DN":
            states.append((o, n))
            r, edits = r + n, edits + (n if o == "D" else 0)
            continue
        for _ in range(n):
            if o in "M=X":
                states.append(("=" if read[i] == window[r] else "X", 1))
                r += 1
            else:
                states.append((o, 1))
            edits += states[-1][0] in "XI"
            i += 1
    while states and states[-1][0] in "DN":
        o, n = states.pop()
        edits -= n if o == "D" else 0

    def text(named):
        out = []
        for o, n in named:
            if out and out[-1][0] == o and o not in "DN":
                out[-1][1] += n
            elif out and out[-1][0] in "DN" and o in "DN":
                out[-1] = [o, out[-1][1] + n]
            else:
                out.append([o, n])
        return "".join(f"{n}{o}" for o, n in out)

    return text([("M" if o in "=X" else o, n) for o, n in states]), text(states), edits


def test_differences_and_back():
    rng = random.Random(8)
    cases = [drawn(rng) for _ in range(600)] + [("", "", "ACG"), ("ACGT", "4S", ""), ("AC", "2I", ""), ("日本", "2M", "日米")]
    reads, cigars, windows = zip(*cases)
    h = D.differences(reads, cigars, windows)
    x = D.Held(*(h[k] for k in ("has_mismatch", "mismatch", "has_offset", "offsets", "kinds")))
    assert x.reads(windows) == list(reads)
    for k, (read, cigar, window) in enumerate(cases):
        assert h["ref_len"][k] == sum(int(n) for n, o in re.findall(r"(\d+)(\D)", cigar) if o in "MDN=X")
        # the place of a base is its place in the read plus the offsets so far, and what differs is held
        moved = mm = oi = 0
        for i, c in enumerate(read):
            if h["has_offset"][k][i]:
                moved, oi = moved + h["offsets"][k][oi], oi + 1
            if h["has_mismatch"][k][i]:
                assert h["mismatch"][k][mm] == c
                mm += 1
            else:
                assert window[i + moved] == c
    summary = x.summary()
    for k, (cigar, exact, read, case) in enumerate(zip(x.cigars(), x.cigars(exact=True), x.mismatch_reads(), cases)):
        mixed = re.search(r"\d+[DN]\d+[DN]|[IS]\d+[DN]?\d*[IS]", case[1])  # told as one offset, or by two of which the plain version makes one
        want = plain(*case)
        if not mixed:
            assert (cigar, exact, summary["edit_distance"][k]) == want, case
        assert "".join(c if m == "=" else m for c, m in zip(case[0], read)) == case[0]
        clips = re.findall(r"(\d+)S", case[1])
        if case[1].endswith("S") and case[1].count("S") == 1 and re.search("[MI=X]", case[1]):
            assert summary["right_clip"][k] == int(clips[-1])
        assert x.cigars(clipped=True)[k] == re.sub(r"\d+S", "", cigar)


def test_what_does_not_fit_is_an_error():
    with pytest.raises(ValueError, match="does not fit a read"):
        D.differences(["ACG"], ["4M"], ["ACGT"])
    with pytest.raises(ValueError, match="does not fit a read"):
        D.differences(["ACGT"], ["4M"], ["ACG"])
    with pytest.raises(ValueError, match="do not fit each other"):
        D.Held([[True, False]], ["AC"], [[False, False]], [[]], [""])
    with pytest.raises(ValueError, match="beyond the reference"):
        D.Held([[False, False]], [""], [[True, False]], [[3]], ["D"]).reads(["ACG"])
    assert D.Held([], [], [], [], []).reads([]) == [] and D.Held([], [], [], [], []).cigars() == []


def test_held_reads_over_chunks(spark):
    rng = random.Random(4)
    ref = "".join(rng.choice("ACGT") for _ in range(900))
    rows = []
    for k in range(120):
        read, cigar, window = drawn(rng)
        at = rng.randrange(0, 900 - 60)
        n = sum(int(a) for a, o in re.findall(r"(\d+)(\D)", cigar) if o in "MDN=X")
        # the same changes against the whole reference
        i, r, out = 0, at, ""
        for a, o in re.findall(r"(\d+)(\D)", cigar):
            for _ in range(int(a)):
                if o in "M=X":
                    out += ref[r] if rng.random() < 0.8 else "N"
                    r += 1
                elif o in "IS":
                    out += "G"
                else:
                    r += 1
        assert r == at + n
        rows.append((k, "r", at + 1, cigar, out))
    rows += [(900, "unknown", 1, "2M", "AC"), (901, None, 1, "2M", "AC"), (902, "r", None, "2M", "AC"), (903, "r", 1, "2M", None), (904, "r", 5, "2S", "AC")]
    aln = spark.createDataFrame(rows, "id long, ref string, pos long, cigar string, seq string")
    refs = spark.createDataFrame([("r", ref.lower()), ("none", None)], "ref string, seq string")
    held = R.held_reads(aln, refs, "id", width=7)
    got = {r.id: r.seq for r in R.restored_reads(held, refs, "id", width=50).collect()}
    assert got == {k: s for k, f, p, c, s in rows if k < 900 or k == 904}
    assert R.held_reads(aln.where("false"), refs, "id").count() == 0
    q = spark.createDataFrame([("IIII", [True, False, False, True]), ("II", [True])], "q string, m array<boolean>").select(D.kept_quality(F.col("q"), F.col("m")).alias("k")).collect()
    assert [r.k for r in q] == ["I??I", None]


def test_dense_ids_over_partitions(spark):
    rng = random.Random(6)
    rows = [(k, rng.randrange(0, 40), None if rng.random() < 0.1 else rng.random()) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, a int, b double").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        table, mapping = R.resorted(df, "id", ["a", F.desc("b")], ["a", "b"])
        want = sorted(rows, key=lambda r: (r[1], r[2] is None, -(r[2] or 0), r[0]))
        new = {r.id: r.new_id for r in mapping.collect()}
        assert new == {r[0]: k for k, r in enumerate(want, 1)}
        assert sorted(map(tuple, table.select("id", "a", "b").collect())) == [(k, r[1], r[2]) for k, r in enumerate(want, 1)]
        back = R.referred(spark.createDataFrame([(5, "x"), (2999, "y"), (4000, "z"), (None, "n")], "id long, v string"), "id", mapping, "id").collect()
        assert {r.v: r.id for r in back} == {"x": new[5], "y": new[2999], "z": None, "n": None}
        assert R.dense_ids(df.where("false"), ["id"], "n").count() == 0
        whole = R.dense_ids(df, ["id"], "n", start=0).collect()
        assert all(r.id == r.n for r in whole)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_parsed_cigars():
    row, n, op = D.parsed(["10M2I", "", "3H5S1000000M2P", "0M7="])
    assert row.tolist() == [0, 0, 2, 2, 3] and n.tolist() == [10, 2, 5, 1_000_000, 7] and bytes(op.astype(np.uint8)) == b"MISM="
