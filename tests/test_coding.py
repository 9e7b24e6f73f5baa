"""Codings, words, dates and lookups against fixed cases and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions import coding as K
from strandlake.operators import lookups as L


def one(spark, *cols):
    return list(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first())


def arr(*v):
    return F.array(*[F.lit(x) for x in v])


def test_packing_of_bits(spark):
    rng = random.Random(4)
    for bits in (1, 3, 5, 8, 13):
        v = [rng.randrange(1 << bits) for _ in range(rng.randrange(1, 30))]
        text = "".join(format(x, f"0{bits}b") for x in v)
        packed, back = one(spark, K.pack(arr(*v), bits), K.unpack(K.pack(arr(*v), bits), bits, F.lit(len(v))))
        assert bytes(packed) == int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big") and back == v
    none = F.array().cast("array<int>")
    assert one(spark, K.pack(none, 4), K.unpack(K.pack(none, 4), 4, F.lit(0))) == [bytearray(b""), []]


def test_numbers(spark):
    assert one(spark, *[K.number_of(F.lit(x)) for x in ("0x1F", "017", "42", "-3", "x", "0", "99999999999999999999", "")]) == [31, 15, 42, -3, None, 0, None, None]
    assert one(spark, K.all_finite(arr(1.0, 2.0)), K.all_finite(arr(1.0, float("nan"))), K.all_finite(arr(float("inf")))) == [True, False, False]


def test_residues(spark):
    for s in ("ACGT", "A", "", "ACGTNRY-"):
        assert one(spark, K.from_4na(K.to_4na(F.lit(s)), F.lit(len(s)))) == [s]
    for s in ("ACGT", "TTTTT", "G", "CA"):
        packed, back = one(spark, K.to_2na(F.lit(s)), K.from_2na(K.to_2na(F.lit(s)), F.lit(len(s))))
        assert back == s and len(packed) == -(-len(s) // 4)
        assert packed[0] >> 6 == "ACGT".index(s[0])
    (got,) = one(spark, K.resolved(F.lit("ANRYNNA"), F.lit(7)))
    assert len(got) == 7 and got[0] == got[6] == "A" and got[2] in "AG" and got[3] in "CT"
    fits = lambda seq, text: one(spark, K.expression(F.lit(seq), text))[0]
    assert fits("AACGTT", "ACG & !GGG") and not fits("AACGGGTT", "ACG & !GGG") and fits("TTT", "(AAA | TTT) & !C") and fits("ACAT", "ARAT | AYAT")
    for bad in ("A &", "(A", "A B", "A $"):
        with pytest.raises(ValueError):
            K.expression(F.lit("A"), bad)


def test_words(spark):
    # keys of well-known words: consonants by sound, silent letters gone
    keys = {"Thompson": "0mpsn", "asthma": "astm", "match": "mx", "watch": "wx", "kitchen": "kxn", "bathmat": "btmt", "edge": "aj", "back": "bk", "phone": "fn", "knight": "nt", "which": "wx", "school": "skl", "judge": "jj", "wrack": "rk", "xylophone": "slfn", "apple": "apl", "cat": "kt", "nation": "nxn", "thing": "0nk"}
    got = dict(zip(keys, one(spark, *[K.metaphone(F.lit(w)) for w in keys])))
    assert got == keys
    assert one(spark, K.word_score(F.lit("phone"), F.lit("fone")) > K.word_score(F.lit("phone"), F.lit("stone")))[0]
    assert one(spark, K.joined("-", F.lit("a"), F.lit(None).cast("string"), F.lit(""), F.lit("b"))) == ["a-b"]
    assert one(spark, K.name_at(arr("x", "Y"), F.lit("y")), K.name_at(arr("x", "Y"), F.lit("y"), True), K.names_sorted(arr("b", "A", "a"), True)) == [-1, 1, ["A", "a", "b"]]


def test_dates(spark):
    d = lambda y, m, day, text="": F.struct(F.lit(y).cast("int").alias("year"), F.lit(m).cast("int").alias("month"), F.lit(day).cast("int").alias("day"), F.lit(text).alias("text"))
    f = "%N %D, %Y (%n %y %M)"
    assert one(spark, K.format_date(d(2009, 3, 7), f), K.format_date(d(2009, None, None), f), K.format_date(d(None, 1, 1, "spring"), f)) == ["March 07, 2009 (Mar 09 03)", " , 2009 ( 09 )", "spring"]


def test_locations_and_reads(spark):
    loc = F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi"), F.lit(s).alias("strand")) for a, b, s in ((1, 5, "+"), (9, 9, "-"))])
    length, back, part = one(spark, K.location_length(loc), K.location_reversed(loc), K.location_clipped(loc, F.lit(4), F.lit(20)))
    assert (length, [tuple(x) for x in back], [tuple(x) for x in part]) == (6, [(9, 9, "+"), (1, 5, "-")], [(4, 5, "+"), (9, 9, "-")])
    reads = K.spot_reads(arr(2, 3), arr("technical", "biological"))
    assert one(spark, K.bio_start(reads), K.technical_in_lower_case(F.lit("ACGTA"), reads), K.bio_start(K.spot_reads(arr(2), arr("technical")))) == [2, "acGTA", 0]
    bins = [r.b for r in spark.range(12_000).select(K.position_bin(F.col("id")).alias("b")).orderBy("id").collect()]
    assert bins == sorted(bins) and set(bins) == set(range(49))


def test_sets_of_ids(spark):
    rng = random.Random(2)
    ids = sorted({rng.randrange(400) for _ in range(250)} | set(range(60, 140)) | {0, 32768, 32769, 70_000})
    df = spark.createDataFrame([(i,) for i in ids + ids[:9]], "id long")
    assert sorted(r.id for r in L.ids_of_bitsets(L.bitsets(df, "id"), "id").collect()) == ids
    half = L.merged_bitsets(L.bitsets(df.where("id % 2 = 0"), "id"), L.bitsets(df.where("id % 3 <> 1"), "id"))
    assert sorted(r.id for r in L.ids_of_bitsets(half, "id").collect()) == [i for i in ids if i % 2 == 0 or i % 3 != 1]
    for width in (16, 64, 1 << 20):
        got = {r.id: (r.before, r.after, r.gap) for r in L.neighbours(df, "id", width).collect()}
        have = set(ids)
        for k, i in enumerate(ids):
            gap = i + 1
            while gap in have:
                gap += 1
            assert got[i] == (ids[k - 1] if k else None, ids[k + 1] if k + 1 < len(ids) else None, gap)


def test_jobs_and_ids(spark):
    jobs = spark.createDataFrame([(1, "Pending", 0, "a"), (2, "Running", 9, "a"), (3, "Pending", 5, None), (4, "Pending", 5, "b"), (5, "Pending", 1, "b")], "job long, state string, priority int, affinity string")
    assert [r.job for r in L.next_jobs(jobs, 3, ["a"]).collect()] == [1, 3, 4] and [r.job for r in L.next_jobs(jobs, 9, ["b"], True).collect()] == [4, 5]
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "id string")
    got = {tuple(r) for r in L.matching_ids(ids("N.1", "N", "M.2"), ids("N.1", "N.2", "N", "M.1")).collect()}
    assert got == {("N.1", "N.1"), ("N.1", "N"), ("N", "N.1"), ("N", "N.2"), ("N", "N")}
