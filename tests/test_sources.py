"""Readers, round trips through the writers, and streams."""

import pytest
from pyspark.sql import functions as F

from strandlake.sources import readers as R
from strandlake.sources import writers as W
from strandlake.streaming import jobs as J


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    return write


def values(df):
    return sorted(r.value for r in df.collect())


def test_gff_gtf_bed(spark, put):
    gff = "##gff-version 3\nc1\tsrc\tgene\t1\t90\t.\t+\t.\tID=g1;Name=x\nc1\tsrc\tmRNA\t1\t90\t2.5\t+\t0\tID=t1;Parent=g1\nbroken line\n"
    df = R.read_gff3(spark, put("a.gff3", gff))
    rows = df.collect()
    assert [r.bad_line for r in rows if r.bad_line] == ["broken line"]
    child = df.where(F.col("attrs")["Parent"] == "g1").first()
    assert (child.start, child.stop, child.score, child.attrs["ID"]) == (1, 90, 2.5, "t1")
    assert values(W.gff3_lines(df.where("type = 'mRNA'"))) == ["c1\tsrc\tmRNA\t1\t90\t2.5\t+\t0\tID=t1;Parent=g1"]
    with pytest.raises(Exception, match="bad line"):
        R.read_gff3(spark, put("b.gff3", gff), mode="failfast").collect()
    line = 'c1\ts\texon\t5\t9\t.\t-\t.\tgene_id "g"; transcript_id "t";'
    gtf = R.read_gtf(spark, put("a.gtf", line + "\n"))
    assert (gtf.first().gene_id, gtf.first().transcript_id) == ("g", "t") and values(W.gtf_lines(gtf)) == [line]
    bed = R.read_bed(spark, put("a.bed", "track name=x\nc1\t0\t10\nc2\t5\t9\tn\t1.0\t-\n"))
    assert [(r.chrom, r.start, r.stop, r.name) for r in bed.collect()] == [("c1", 0, 10, None), ("c2", 5, 9, "n")]
    assert "c2\t5\t9\tn\t1.0\t-" in values(W.bed_lines(bed))


def test_vcf(spark, put):
    text = "##fileformat=VCFv4\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\n1\t7\t.\tA\tC,G\t50.0\tPASS\tDB;DP=3\tGT:DP\t0/1:3\n"
    df = R.read_vcf(spark, put("a.vcf", text))
    r = df.first()
    assert (r.pos, r.alt, r["filter"], r.info, r.genotypes) == (7, ["C", "G"], ["PASS"], {"DB": "", "DP": "3"}, [{"GT": "0/1", "DP": "3"}])
    assert values(W.vcf_lines(df)) == ["1\t7\t.\tA\tC,G\t50.0\tPASS\tDB;DP=3"]


def test_agp(spark, put):
    text = "#c\nchr1\t1\t100\t1\tF\tctg1\t1\t100\t+\nchr1\t101\t150\t2\tN\t50\tcontig\tyes\tmap\nchr1\t151\t260\t3\tF\tctg2\t1\t100\t+\nchr1\t261\t300\t4\tU\t40\tcontig\tno\tna\n"
    agp = R.read_agp(spark, put("a.agp", text))
    assert agp.where("part = 2").first().gap_length == 50
    assert values(W.agp_lines(agp)) == sorted(text.split("\n")[1:-1])
    assert {(r.part, r.problem) for r in R.agp_problems(agp).collect()} == {(3, "component and object lengths differ"), (4, "gap of unknown length is not 100")}


def test_fasta_fastq_sam_hits(spark, put):
    fa = ">a first one\nACGT\nAC\n>b\n>c x\nGG\n"
    df = R.read_fasta(spark, put("a.fa", fa))
    assert sorted(map(tuple, df.collect())) == [("a", "first one", "ACGTAC"), ("b", "", ""), ("c", "x", "GG")]
    assert values(W.fasta_lines(df, 4)) == [">a first one\nACGT\nAC", ">b", ">c x\nGG"]
    fq = R.read_fastq(spark, put("a.fq", "@r1\nACG\n+\nIII\n@r2\nT\n+r2\nJ\n"))
    assert sorted(map(tuple, fq.collect())) == [("r1", "ACG", "III"), ("r2", "T", "J")]
    line = "r\t0\tc\t5\t60\t3M\t*\t0\t0\tACG\tIII"
    sam = R.read_sam(spark, put("a.sam", "@HD\tVN:1\n" + line + "\n"))
    assert sam.first().pos == 5 and values(W.sam_lines(sam)) == [line]
    hits = R.read_hits(spark, put("a.m8", "q\ts\t99.0\t10\t0\t0\t1\t10\t5\t14\t1e-5\t20.5\n"))
    assert hits.first().evalue == 1e-5


def test_wiggle(spark, put):
    text = "track x\nfixedStep chrom=c1 start=10 step=5\n1\n2\nvariableStep chrom=c2 span=3\n7 0.5\n"
    df = R.read_wiggle(spark, put("a.wig", text))
    assert sorted(map(tuple, df.collect())) == [("c1", 10, 1, 1.0), ("c1", 15, 1, 2.0), ("c2", 7, 3, 0.5)]
    assert values(W.wiggle_lines(df))[1] == "variableStep chrom=c2 span=3\n7 0.5"


def test_bad_fields_and_failfast(spark, put):
    """A field of another type makes a line bad, and an error whatever columns are read."""
    path = put("x.bed", "c1\tXX\t10\nc2\t5\t9\n")
    rows = R.read_bed(spark, path).collect()
    assert [(r.chrom, r.start, r.bad_line) for r in rows] == [(None, None, "c1\tXX\t10"), ("c2", 5, None)]
    for look in (lambda d: d.count(), lambda d: d.select("chrom").collect(), lambda d: d.select("stop").collect()):
        with pytest.raises(Exception, match="bad line"):
            look(R.read_bed(spark, path, mode="failfast"))
    assert R.read_bed(spark, put("y.bed", "c2\t5\t9\n"), mode="failfast").count() == 1


def test_gff3_repeats_codes_and_sequences(spark, put):
    text = "##gff-version 3\nc1\ts\tgene\t1\t9\t.\t+\t.\tID=g1;Alias=a;Alias=b%2Cc;Note=a%3Bb+c %zz;;flag\n##FASTA\n>c1\nACGT\nACGT\n"
    (r,) = R.read_gff3(spark, put("a.gff3", text)).collect()
    assert r.attrs == {"ID": "g1", "Alias": "a,b,c", "Note": "a;b+c %zz", "flag": ""} and r.bad_line is None
    (line,) = values(W.gff3_lines(R.read_gff3(spark, put("b.gff3", text))))
    assert line.endswith("Alias=a%2Cb%2Cc;ID=g1;Note=a%3Bb+c %25zz;flag=")
    vcf = "1\t7\t.\tA\tC\t50\tPASS\tDP=3;DP=4;DB\n"
    assert R.read_vcf(spark, put("a.vcf", vcf)).first().info == {"DP": "3,4", "DB": ""}
    head = '##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth, total">\n##FILTER=<ID=q10,Description="low">\n#CHROM\n' + vcf
    assert sorted(map(tuple, R.read_vcf_specs(spark, put("h.vcf", head)).collect())) == [("FILTER", "q10", None, None, "low"), ("INFO", "DP", "1", "Integer", "Depth, total")]


def test_sam_tags_headers_and_bed12(spark, put):
    rows = "@HD\tVN:1.0\tSO:queryname\n@SQ\tSN:c\tLN:90\n@CO\tfree text: x\n"
    line = "r\t0\tc\t5\t60\t3M\t*\t0\t0\tACG\t.II\tRG:Z:a:b\tNM:i:0"
    path = put("t.sam", rows + line + "\n")
    sam = R.read_sam(spark, path)
    assert [tuple(t) for t in sam.first().tags] == [("RG", "Z", "a:b"), ("NM", "i", "0")] and values(W.sam_lines(sam)) == [line]
    head = {r.kind: r.fields for r in R.read_sam_header(spark, path).collect()}
    assert head == {"HD": {"VN": "1.0", "SO": "queryname"}, "SQ": {"SN": "c", "LN": "90"}, "CO": {}}
    bed = "c1\t0\t50\tn\t1.0\t+\t5\t40\t0,0,0\t2\t10,20\t0,30"
    df = R.read_bed(spark, put("b.bed", bed + "\n"))
    assert (df.first().block_sizes, df.first().thick_stop) == ([10, 20], 40) and values(W.bed_lines(df)) == [bed]


def test_agp_against_sequences(spark, put):
    agp = R.read_agp(spark, put("a.agp", "o\t1\t10\t1\tF\ta\t1\t10\t+\no\t11\t20\t2\tF\tb\t5\t14\t+\no\t21\t25\t3\tF\tc\t1\t5\t+\n"))
    seqs = spark.createDataFrame([("a", "A" * 10), ("b", "C" * 13), ("d", "G")], "id string, seq string")
    assert sorted((r.component, r.problem) for r in R.agp_against_sequences(agp, seqs).collect()) == [("b", "ends beyond its sequence"), ("c", "no sequence"), ("d", "not placed")]


@pytest.mark.parametrize(
    ("kind", "text"),
    [("vcf", "##fileformat=VCFv4\n"), ("gff3", "##gff-version 3\n"), ("fasta", ">a\nA\n"), ("fastq", "@a\nA\n+\nI\n"), ("sam", "@HD\tVN:1\n"), ("wiggle", "fixedStep chrom=1\n1\n"), ("bed", "c\t1\t2\n"), ("json", '{"a": 1}\n'), ("text", "plain\n"), ("agp", "o\t1\t2\t1\tF\tc\t1\t2\t+\n"), ("gtf", 'c\ts\te\t1\t2\t.\t+\t.\tgene_id "g";\n')],
)
def test_guess(spark, put, kind, text):
    assert R.guess_format(spark, put("x", text)) == kind


def test_write_many(spark, tmp_path):
    df = spark.range(3)
    W.write_many(df, [lambda x: x.write.parquet(f"{tmp_path}/a"), lambda x: W.write_lines(x.select(F.col("id").cast("string").alias("value")), f"{tmp_path}/b")])
    assert spark.read.parquet(f"{tmp_path}/a").count() == spark.read.text(f"{tmp_path}/b").count() == 3


def test_jobs(spark):
    e = spark.createDataFrame([(1, 1, "Pending"), (1, 2, "Running"), (1, 3, "Done"), (2, 1, "Pending"), (2, 5, "Done")], "job long, at long, state string")
    assert {(r.before, r.after) for r in J.invalid_moves(e, "job", ["at"]).collect()} == {("Pending", "Done")}
    log = spark.createDataFrame([("k", 5, 1, "write", "a"), ("k", 5, 1, "remove", "b"), ("k", 4, 9, "write", "a")], "key string, time long, record long, op string, server string")
    assert J.sync_log(log).first().op == "write"


def test_stream_of_jobs(spark, sf, tmp_path):
    whole = spark.read.parquet(f"{sf}/events.parquet")
    whole.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").select(F.col("event_type").alias("state"))
    q = J.state_counts(stream).writeStream.outputMode("complete").format("memory").queryName("job_states").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {r.event_type: r["count"] for r in whole.groupBy("event_type").count().collect()}
    assert {r.state: r.n for r in spark.table("job_states").collect()} == want


def test_lines_of_files_that_are_cut_in_blocks(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        (tmp_path / "q").mkdir()
        want = []
        for f in range(2):
            recs = [(f"r{f}.{k}", "ACGT"[: k % 5] * (1 + k % 3), "@I+>"[: k % 5] * (1 + k % 3)) for k in range(40)]
            want += recs
            (tmp_path / "q" / f"{f}.fq").write_text("".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in recs) + "\n\n")
        lines = R.numbered_lines(spark, f"{tmp_path}/q")
        assert lines.select("file", "block").distinct().count() > 4
        assert sorted(map(tuple, R.read_fastq(spark, f"{tmp_path}/q").collect())) == sorted(want)
        values_ = "\n".join(str(k) for k in range(60))
        (tmp_path / "a.wig").write_text(f"fixedStep chrom=c1 start=10 step=5\n{values_}\nvariableStep chrom=c2 span=3\n7 0.5\n")
        got = sorted(map(tuple, R.read_wiggle(spark, f"{tmp_path}/a.wig").collect()))
        assert got == [("c1", 10 + 5 * k, 1, float(k)) for k in range(60)] + [("c2", 7, 3, 0.5)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_more_formats(spark, put):
    gvf = R.read_gvf(spark, put("a.gvf", "##gvf-version 1\nc\ts\tSNV\t5\t5\t.\t+\t.\tID=1;Variant_seq=A,G;Reference_seq=C\n")).first()
    assert (gvf.reference_seq, gvf.variant_seqs) == ("C", ["A", "G"])
    bed = R.read_bed15(spark, put("a.bed15", "c\t1\t9\tn\t5\t+\t1\t9\t0\t2\t3,2,\t0,6,\t2\t0,1,\t-0.5,1.5,\n")).first()
    assert (bed.block_sizes, bed.exp_ids, bed.exp_scores) == ([3, 2], [0, 1], [-0.5, 1.5])
    genes = R.read_glimmer3(spark, put("g", ">s1 x\norf1 10 40 +1 5.5\norf2 90 60 -2 7\n>s2\norf1 1 9 +3 1\n")).collect()
    assert sorted((g.seqid, g.name, g.start, g.stop, g.strand) for g in genes) == [("s1", "orf1", 10, 40, "+"), ("s1", "orf2", 60, 90, "-"), ("s2", "orf1", 1, 9, "+")]
    table = ">Feature s1\n<1\t90\tgene\n\t\t\tgene\tx\n90\t50\tCDS\n40\t10\n\t\t\tproduct\tp q\n\t\t\tpseudo\n>Feature s2 t\n3\t>4\tgene\n"
    df = R.read_feature_table(spark, put("t.tbl", table))
    got = {(r.seqid, r.run): (r.type, [tuple(s) for s in r.spans], [tuple(q) for q in r.qualifiers]) for r in df.collect()}
    assert got == {("s1", 1): ("gene", [(1, 90, "+")], [("gene", "x")]), ("s1", 2): ("CDS", [(50, 90, "-"), (10, 40, "-")], [("product", "p q"), ("pseudo", None)]), ("s2", 1): ("gene", [(3, 4, "+")], [])}
    assert "90\t50\tCDS\n40\t10\n\t\t\tproduct\tp q\n\t\t\tpseudo" in values(W.feature_table_lines(df))
    ace = R.read_ace(spark, put("a.ace", "AS 2 3\n\nCO c1 6 2 1 U\nACG\nT*A\n\nBQ\n20 20\n\nAF r1 U 1\nAF r2 C -3\nRD r1 3 0 0\nACG\n\nCO c2 2 1 0 U\nGG\n\nBQ\n9 9\n\nAF r3 U 1\n")).collect()
    assert [(r.contig, r.bases, r.seq, [tuple(x) for x in r.reads]) for r in ace] == [("c1", 6, "ACGT*A", [("r1", "+", 1), ("r2", "-", -3)]), ("c2", 2, "GG", [("r3", "+", 1)])]
    row = spark.range(1).select(R.aligned_pair(F.lit("A--C"), F.lit("A-GC")).alias("p"), R.feature_kind(F.lit("GAP"), ["gap"], ["x"]).alias("k"), R.feature_kind(F.lit("X"), ["gap"], ["x"]).alias("d")).first()
    assert (tuple(row.p), row.k, row.d) == (("A-C", "AGC"), "warn", "disallowed")
    seqs = spark.createDataFrame([("a", "t", "ACGTACGT"), ("b", "", "GG")], "id string, title string, seq string")
    spans = spark.createDataFrame([("a", 1, 2), ("a", 2, 4), ("a", 7, 7)], "seqid string, lo long, hi long")
    assert [r.seq for r in W.masked_fasta(seqs, spans).orderBy("id").collect()] == ["AcgtaCGt", "GG"] and W.masked_fasta(seqs, spans, hard=True).orderBy("id").first().seq == "ANNNNCGN"
    assert values(W.mask_lines(spans)) == [">a\n1 - 2\n2 - 4\n7 - 7"] and values(W.mask_lines(spans, "acclist"))[0] == "a\t1\t2"


def test_cache_newest_of_all_keys(spark, sf):
    from strandlake import queries as own, read_queries  # noqa: F401  registers its queries

    e = spark.read.parquet(f"{sf}/events.parquet")
    got = {(r.cache_key, r.subkey) for r in own.queries()["cache_newest_all"](spark, sf).collect()}
    assert got == {tuple(r) for r in e.select("user_id", "event_type").collect()}
