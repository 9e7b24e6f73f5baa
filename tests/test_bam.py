"""The BAM source: blocks, guesses, splits, filters, and records of SAM lines written and read again."""

import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from strandlake.sources import bam as B
from strandlake.sources.readers import read_sam

HEAD = "@HD\tVN:1.0\tSO:coordinate\n@SQ\tSN:20\tLN:63025520\n@SQ\tSN:x\tLN:5000\n@CO\ta comment\n"
#: Two mates in the shape of a loader's test: one aligned, one not.
SAM = [
    "r1\t99\t20\t60025\t60\t35M16S\t=\t60079\t89\tAGCTTGGAACCCTATAGAGTTGCTGAGTGCCAGGACCAGATCCTGGCCCTA\t=;>@?;%=<>@AC@B79,>2C4B;7877%7%58:6%96.%8#$%//.%2:%\tXC:i:35\tXT:A:U\tNM:i:0\tXZ:Z:two words\tXB:B:c,-1,2\tXF:f:0.5\tXH:H:1AE3",
    "r1\t147\t*\t60079\t60\t16S35M\t20\t60025\t-89\tGATCCTGTCAAAAAACAGGTGGTAAGGAAGGAGAGAGTGAAGGCACTGCCA\t%.\"%/#:#9#\"\"9%7$3<A%%A<#:@$@>AA>=57:<5=$<5)%4<?-:=;\tNM:i:1",
    "odd\t4\t*\t0\t0\t*\t*\t0\t0\tNACGT\t*",
    "none\t4\tx\t5\t0\t*\t=\t1\t0\t*\t*",
]


def key(r):
    return tuple(tuple(tuple(t) for t in v) if isinstance(v, list) else v for v in r)


@pytest.fixture(scope="module")
def source(spark):
    B.register(spark)
    return spark


def rows_of(n, seed=3):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        size = rng.choice((0, 1, 36, 101, 2500))
        seq = "".join(rng.choice("ACGTN") for _ in range(size)) or None
        qual = "".join(chr(rng.randrange(33, 90)) for _ in range(size)) or None
        where = rng.choice(("20", "x", None))
        tags = [{"tag": "NM", "type": "i", "value": str(rng.randrange(-5, 70_000))}, {"tag": "MD", "type": "Z", "value": "m" * rng.randrange(0, 40)}][: rng.randrange(0, 3)]
        out.append((f"read{k}", rng.randrange(0, 4096), where, rng.randrange(1, 5000) if where else 0, rng.randrange(0, 61), f"{size}M" if where and size else None, rng.choice(("=", "x", None)) if where else None, rng.randrange(0, 5000), rng.randrange(-900, 900), seq, qual, tags))
    return out


def same(a, b):
    """Rows as they come back: a mate's reference of the same name is =, and no tags are an empty list."""
    want = sorted((*r[:6], "=" if r[6] is not None and r[6] in ("=", r[2]) else r[6], *r[7:11], tuple((t["tag"], t["type"], t["value"]) for t in r[11] or [])) for r in b)
    got = sorted((*r[:11], tuple((t.tag, t.type, t.value) for t in r.tags)) for r in a)
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_lines_written_and_read(source, tmp_path):
    (tmp_path / "a.sam").write_text(HEAD + "\n".join(SAM) + "\n")
    sam = read_sam(source, str(tmp_path / "a.sam"))
    names = [f.split()[0] for f in re.sub("<.*>", "", B.SCHEMA).split(", ")]
    star = [F.when(F.col(c) != "*", F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in sam.select(*names).dtypes]
    sam = sam.select(*star)
    sam.repartition(1).write.format("bam").option("header", HEAD).mode("append").save(f"{tmp_path}/bam")
    back = source.read.format("bam").load(f"{tmp_path}/bam")
    assert B.header_text(f"{tmp_path}/bam") == HEAD
    assert sorted(map(key, back.collect()), key=repr) == sorted(map(key, sam.collect()), key=repr)


def test_splits_filters_and_columns(source, tmp_path):
    rows = rows_of(1500)
    df = source.createDataFrame(rows, B.SCHEMA)
    df.repartition(3).write.format("bam").option("header", HEAD).mode("append").save(f"{tmp_path}/b")
    files = B._files(f"{tmp_path}/b")
    assert len(files) == 3
    whole = source.read.format("bam").load(f"{tmp_path}/b")
    same(whole.collect(), rows)
    # each record in one split, whatever their size
    for split in (max(n for _, n in files) // 2, 70_000, 9_001, 1_000):
        cut = source.read.format("bam").option("split", split).load(f"{tmp_path}/b")
        assert cut.rdd.getNumPartitions() == sum(-(-n // split) for _, n in files)
        same(cut.collect(), rows)
    few = source.read.format("bam").schema("pos long, qname string").option("split", 30_000).load(f"{tmp_path}/b")
    assert sorted(map(tuple, few.collect())) == sorted((r[3], r[0]) for r in rows)
    near = whole.where("rname = 'x' and pos between 1000 and 3000 and mapq > 20 and flag in (1, 2, 3, 4, 1000) or rname is null").select("qname")
    assert {r.qname for r in near.collect()} == {r[0] for r in rows if r[2] == "x" and 1000 <= r[3] <= 3000 and r[4] > 20 and r[1] in (1, 2, 3, 4, 1000) or r[2] is None}
    got = whole.where("rname = 'x' and pos >= 1000 and pos < 3000 and mapq > 20").select("qname")
    assert {r.qname for r in got.collect()} == {r[0] for r in rows if r[2] == "x" and 1000 <= r[3] < 3000 and r[4] > 20}
    with pytest.raises(Exception, match="no columns"):
        source.read.format("bam").schema("depth long").load(f"{tmp_path}/b").collect()


def test_records_over_blocks(tmp_path):
    """Blocks that end within records, as other writers make them: a split begins with the first whole record."""
    rows = [dict(zip([f.split()[0] for f in re.sub("<.*>", "", B.SCHEMA).split(", ")], r)) for r in rows_of(400, 9)]
    first, refs = B.head(HEAD)
    records = [B.encoded(r, refs) for r in rows]
    data, out, places, at = first + b"".join(records), b"", [], 0
    for size in [300, 5000, 777] * 2000:
        places.append(len(out))
        out += B.deflated(data[at : at + size])
        at += size
        if at >= len(data):
            break
    out += B.END_BLOCK
    path = tmp_path / "c.bam"
    path.write_bytes(out)
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(B.SCHEMA)
    for split in (len(out), 20_000, 4_000):
        reader = B.BamReader({"path": str(path), "split": str(split)}, schema)
        got = [r[0] for p in reader.partitions() for r in reader.read(p)]
        assert got == [r["qname"] for r in rows]


def test_damage_is_an_error(tmp_path):
    first, refs = B.head(HEAD)
    with pytest.raises(ValueError, match="not a BAM file"):
        (tmp_path / "x.bam").write_bytes(B.deflated(b"SAM\x01" + bytes(20)) + B.END_BLOCK)
        B.header_text(str(tmp_path / "x.bam"))
    with pytest.raises(FileNotFoundError):
        B._files(str(tmp_path / "nothing"))
    with pytest.raises(ValueError, match="different lengths"):
        B.encoded({"qname": "a", "flag": 0, "rname": None, "pos": 0, "mapq": 0, "cigar": None, "rnext": None, "pnext": 0, "tlen": 0, "seq": "ACG", "qual": "II", "tags": []}, refs)
    assert struct.unpack_from("<i", B.encoded({"qname": None, "flag": 4, "rname": None, "pos": None, "mapq": None, "cigar": None, "rnext": None, "pnext": None, "tlen": None, "seq": None, "qual": None, "tags": None}, refs), 0)[0] == 34
