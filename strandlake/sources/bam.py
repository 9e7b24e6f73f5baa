"""Binary alignment files (BAM) as a data source: read in splits, with filters and only the columns asked for; written in parts.

A file is blocks of compressed bytes of at most 64 KB. A split begins at the first block that starts within it, and there at the first
place that reads as a record, several in a row; it ends with the last record that begins in one of its blocks. Nothing
reads a file whole, and no index is needed. Paths are of any store that Arrow's file systems reach.

    register(spark)
    spark.read.format("bam").option("split", 16 << 20).load(path)
    df.write.format("bam").option("header", text).mode("append").save(folder)

Columns are those of SAM rows (see ``SCHEMA``); a schema given by the reader with fewer of them decodes no more. Comparisons of
rname, pos, flag and mapq with constants are told by each record's fixed fields, before any other is decoded.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen int, seq string, qual string, tags array<struct<tag:string,type:string,value:string>>"
#: Letters of bases and of CIGAR operations by code, the block that ends a file, and sizes of tag values: fixed values of the format.
BASES, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
NUMBERS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}
#: Comparisons that the reader tells itself, by the name of Spark's filter.
WAYS = {
    "EqualTo": lambda v: lambda x: x == v, "GreaterThan": lambda v: lambda x: x > v, "GreaterThanOrEqual": lambda v: lambda x: x >= v,
    "LessThan": lambda v: lambda x: x < v, "LessThanOrEqual": lambda v: lambda x: x <= v, "In": lambda v: lambda x: x in v,
}
_FIXED = struct.Struct("<iiBBHHHiiii")
_PAIRS = [BASES[b >> 4] + BASES[b & 15] for b in range(256)]
#: Uncompressed bytes of a block; records that must follow each other for a place to be one.
BLOCK, SURE = 0xFF00, 4


def _store(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if re.match("file:/[^/]", path) else path)
    return fs.LocalFileSystem(), path


def _files(path: str) -> list[tuple[str, int]]:
    """(path, size) of the files that a path names; one of a folder unless its name begins with . or _."""
    from pyarrow import fs

    store, at = _store(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(at, info.size)]
    found = store.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not re.search(r"/[._][^/]*$", f.path))


def deflated(data: bytes) -> bytes:
    """One block of a file."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff\x06\x00BC\x02\x00" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def _block_size(head: bytes) -> int | None:
    """Bytes of the block that begins here, or None where none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        n = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"BC" and n == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + n
    return None


class Blocks:
    """The blocks of a file from a place on: (their own place, their bytes)."""

    def __init__(self, stream, size: int, start: int = 0):
        self.stream, self.size, self.at = stream, size, start
        if start:
            stream.seek(start)
            near = stream.read(min(2 * 65536 + 64, size - start))
            self.at = start + next((k for k in range(len(near)) if self._begins(near, k, start)), len(near))

    def _begins(self, near: bytes, k: int, start: int) -> bool:
        n = _block_size(near[k : k + 64])
        if n is None:
            return False
        return start + k + n == self.size or _block_size(near[k + n : k + n + 64]) is not None

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        while self.at < self.size:
            self.stream.seek(self.at)
            raw = self.stream.read(65536 + 64)
            n = _block_size(raw)
            if n is None or n > len(raw):
                raise ValueError(f"no block of a BAM file at {self.at}")
            data = zlib.decompressobj(31).decompress(raw[:n])
            place, self.at = self.at, self.at + n
            yield place, data


def header(stream, size: int) -> tuple[str, list[tuple[str, int]], int, int]:
    """(text, references and lengths, place of the block and place in it where records begin)."""
    data, ends = b"", []

    blocks = iter(Blocks(stream, size))

    def need(n: int) -> None:
        nonlocal data
        while len(data) < n:
            place, more = next(blocks, (None, None))
            if more is None:
                raise ValueError("a BAM file ends within its header")
            ends.append((len(data), place, len(more)))
            data += more

    need(12)
    if data[:4] != b"BAM\x01":
        raise ValueError("not a BAM file")
    n = struct.unpack_from("<i", data, 4)[0]
    need(12 + n)
    text, count, at, refs = data[8 : 8 + n].split(b"\0")[0].decode("utf-8", "replace"), struct.unpack_from("<i", data, 8 + n)[0], 12 + n, []
    for _ in range(count):
        need(at + 4)
        k = struct.unpack_from("<i", data, at)[0]
        need(at + 8 + k)
        refs.append((data[at + 4 : at + 3 + k].decode(), struct.unpack_from("<i", data, at + 4 + k)[0]))
        at += 8 + k
    begin, place, k = next(e for e in reversed(ends) if e[0] <= at)
    return text, refs, place, at - begin


def plausible(data: bytes, at: int, refs: list[tuple[str, int]], sure: int = SURE) -> bool:
    """Whether records follow each other from here: ``sure`` of them, or to the end of the bytes."""
    for n in range(sure):
        if at == len(data) and n:
            return True
        if at + 36 > len(data):
            return n > 0
        size, = struct.unpack_from("<i", data, at)
        ref, pos, l_name, _, _, n_cigar, _, l_seq, next_ref, next_pos, _ = _FIXED.unpack_from(data, at + 4)
        if not (32 < size < 1 << 28 and -1 <= ref < len(refs) and -1 <= next_ref < len(refs) and pos >= -1 and next_pos >= -1 and l_name > 0 and l_seq >= 0):
            return False
        if ref >= 0 and pos > refs[ref][1] or 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq > size:
            return False
        name = data[at + 36 : at + 36 + l_name]
        if len(name) == l_name and (name[-1] or any(c < 33 or c > 126 for c in name[:-1])):
            return False
        at += 4 + size
        if at > len(data):
            return True
    return True


def _tags(data: bytes, at: int, end: int) -> list[tuple[str, str, str]]:
    out = []
    while at + 3 <= end:
        tag, kind = data[at : at + 2].decode("latin-1"), chr(data[at + 2])
        at += 3
        if kind in NUMBERS:
            v = struct.unpack_from(NUMBERS[kind], data, at)[0]
            at += struct.calcsize(NUMBERS[kind])
            out.append((tag, "f", f"{v:g}") if kind == "f" else (tag, "i", str(v)))
        elif kind == "A":
            out.append((tag, "A", chr(data[at])))
            at += 1
        elif kind in "ZH":
            stop = data.index(b"\0", at, end)
            out.append((tag, kind, data[at:stop].decode("utf-8", "replace")))
            at = stop + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            values = struct.unpack_from(f"<{n}{NUMBERS[sub][1]}", data, at + 5)
            at += 5 + n * struct.calcsize(NUMBERS[sub])
            out.append((tag, "B", ",".join([sub, *(f"{v:g}" if sub == "f" else str(v) for v in values)])))
        else:
            raise ValueError(f"a tag of unknown type {kind}")
    return out


def decoded(data: bytes, at: int, size: int, refs: list[tuple[str, int]], names: list[str], tests: list) -> tuple | None:
    """The columns of the record at ``at`` (after its size), or None where a test of its fixed fields fails."""
    ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, next_ref, next_pos, tlen = _FIXED.unpack_from(data, at)
    known = {"flag": flag, "rname": refs[ref][0] if ref >= 0 else None, "pos": pos + 1, "mapq": mapq}
    for name, test in tests:
        if known[name] is None or not test(known[name]):
            return None
    cigar_at = at + 32 + l_name
    seq_at = cigar_at + 4 * n_cigar
    qual_at = seq_at + (l_seq + 1) // 2
    out = []
    for name in names:
        if name in known:
            out.append(known[name])
        elif name == "qname":
            v = data[at + 32 : cigar_at - 1].decode("latin-1")
            out.append(None if v == "*" else v)
        elif name == "cigar":
            out.append("".join(f"{v >> 4}{OPS[v & 15]}" for v in struct.unpack_from(f"<{n_cigar}I", data, cigar_at)) or None)
        elif name == "rnext":
            out.append(None if next_ref < 0 else "=" if next_ref == ref else refs[next_ref][0])
        elif name == "pnext":
            out.append(next_pos + 1)
        elif name == "tlen":
            out.append(tlen)
        elif name == "seq":
            out.append("".join(map(_PAIRS.__getitem__, data[seq_at:qual_at]))[:l_seq] or None)
        elif name == "qual":
            q = data[qual_at : qual_at + l_seq]
            out.append(None if not q or q[0] == 255 else q.translate(_SHOWN).decode("ascii"))
        else:
            out.append([{"tag": a, "type": b, "value": c} for a, b, c in _tags(data, qual_at + l_seq, at + size)])
    return tuple(out)


_SHOWN = bytes(min(b + 33, 126) for b in range(256))


@dataclass
class Split(InputPartition):
    path: str
    size: int
    start: int
    end: int


class BamReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.names, self.files = [f.name for f in schema.fields], _files(options["path"])
        self.root, self.split, self.tests = options["path"], int(options.get("split", 32 << 20)), []
        known = {f.split()[0] for f in re.sub(r"<.*>", "", SCHEMA).split(", ")}
        if odd := [n for n in self.names if n not in known]:
            raise ValueError(f"a BAM file has no columns {odd}")

    def pushFilters(self, filters):
        """Comparisons of the fixed fields are told here; all others, and those of null, are left to Spark."""
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            if type(f).__name__ in WAYS and name in ("rname", "pos", "flag", "mapq") and f.value is not None:
                self.tests.append((name, f.value, type(f).__name__))
            else:
                yield f

    def partitions(self) -> list[Split]:
        return [Split(p, n, a, min(n, a + self.split)) for p, n in self.files for a in range(0, max(n, 1), self.split)]

    def read(self, part: Split):
        store, _ = _store(self.root)
        tests = [(name, WAYS[kind](v)) for name, v, kind in self.tests]
        with store.open_input_file(part.path) as f:
            _, refs, first, inside = header(f, part.size)
            if part.start <= first:
                blocks, at = Blocks(f, part.size), inside
                blocks.at = first
                if first >= part.end:
                    return
            else:
                blocks, at = Blocks(f, part.size, part.start), None
            data, begins = b"", []  # bytes in hand, and where each block's begin in them
            stream = iter(blocks)
            while True:
                while at is None or at + 4 > len(data) or at + 4 + struct.unpack_from("<i", data, at)[0] > len(data):
                    block = next(stream, None)
                    if block is None:
                        if at is not None and at < len(data):
                            raise ValueError(f"{part.path} ends within a record")
                        return
                    if at is not None and at > BLOCK:
                        data, begins, at = data[at:], [(max(b - at, 0), p) for k, (b, p) in enumerate(begins) if k + 1 == len(begins) or begins[k + 1][0] > at], 0
                    begins.append((len(data), block[0]))
                    data += block[1]
                    if at is None:
                        # wait for some bytes more than a block, so that several records can be told
                        if len(data) < 4 * BLOCK and blocks.at < part.size:
                            continue
                        at = next((k for k in range(len(data)) if plausible(data, k, refs)), None)
                        if at is None and begins[-1][1] >= part.end:
                            return
                        if at is None:
                            data, begins = data[-BLOCK:], [(0, begins[-1][1])]
                place = next(p for b, p in reversed(begins) if b <= at)
                if place >= part.end:
                    return
                size, = struct.unpack_from("<i", data, at)
                row = decoded(data, at + 4, size, refs, self.names, tests)
                if row is not None:
                    yield row
                at += 4 + size


def _bin(lo: int, hi: int) -> int:
    """Bin of the smallest of six sizes that holds lo to hi - 1: the format's own numbering."""
    hi = max(hi - 1, lo)
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if lo >> shift == hi >> shift:
            return first + (lo >> shift)
    return 0


#: Codes of bases by byte, as hexadecimal digits, and qualities by theirs.
_CODES = bytes(b"0123456789abcdef"[BASES.index(chr(b)) if chr(b) in BASES else 15] for b in range(256))
_QUALITIES = bytes((b - 33) % 256 for b in range(256))


@lru_cache(1 << 14)
def _cigar(text: str) -> tuple[int, bytes, int]:
    """Parts of a CIGAR string, their bytes, and the bases of the reference that they take."""
    ops = [(int(n), OPS.index(o)) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", text)]
    return len(ops), b"".join(struct.pack("<I", n << 4 | o) for n, o in ops), sum(n for n, o in ops if OPS[o] in "MDN=X")


def _qualities(text: str) -> bytes:
    if not text.isascii() or min(text) < "!":
        return bytes(ord(c) - 33 for c in text)
    return text.encode().translate(_QUALITIES)


def encoded(row, refs: dict[str, int]) -> bytes:
    """One record with its size."""
    n_ops, ops, span = _cigar(row["cigar"] or "")
    ref = refs[row["rname"]] if row["rname"] not in (None, "*") else -1
    nxt = ref if row["rnext"] == "=" else refs[row["rnext"]] if row["rnext"] not in (None, "*") else -1
    name, seq = (row["qname"] or "*").encode() + b"\0", (row["seq"] or "").upper()
    if len(name) > 255:
        raise ValueError("a read name of more than 254 bytes")
    packed = bytes.fromhex((seq.encode("ascii", "replace").translate(_CODES) + b"0" * (len(seq) % 2)).decode())
    qual = _qualities(row["qual"]) if row["qual"] else b"\xff" * len(seq)
    if len(qual) != len(seq):
        raise ValueError("bases and qualities of different lengths")
    pos = (row["pos"] or 0) - 1
    tags = b""
    for x in row["tags"] or ():
        kind, value = x["type"], x["value"]
        tags += x["tag"].encode() + kind.encode()
        if kind == "A":
            tags += value.encode("latin-1")[:1]
        elif kind == "B":
            sub, *values = value.split(",")
            tags += sub.encode() + struct.pack("<i", len(values)) + struct.pack(f"<{len(values)}{NUMBERS[sub][1]}", *(float(v) if sub == "f" else int(v) for v in values))
        elif kind in NUMBERS:
            tags += struct.pack(NUMBERS[kind], float(value) if kind == "f" else int(value))
        else:
            tags += value.encode() + b"\0"
    fixed = _FIXED.pack(ref, pos, len(name), row["mapq"] or 0, _bin(max(pos, 0), max(pos, 0) + max(span, 1)), n_ops, row["flag"] or 0, len(seq), nxt, (row["pnext"] or 0) - 1, row["tlen"] or 0)
    body = fixed + name + ops + packed + qual + tags
    return struct.pack("<i", len(body)) + body


def head(text: str) -> tuple[bytes, dict[str, int]]:
    """Bytes of a header, and the places of its references, which its @SQ lines name."""
    refs = [(re.search(r"\tSN:([^\t]+)", line)[1], int(re.search(r"\tLN:(\d+)", line)[1])) for line in text.splitlines() if line.startswith("@SQ\t")]
    raw = text.encode()
    out = b"BAM\x01" + struct.pack("<i", len(raw)) + raw + struct.pack("<i", len(refs))
    for name, n in refs:
        out += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", n)
    return out, {name: k for k, (name, _) in enumerate(refs)}


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


class BamWriter(DataSourceArrowWriter):
    """A file a task, under a hidden name until the job commits; a task that is tried again writes another file, and only committed ones get their name."""

    def __init__(self, options: dict, overwrite: bool):
        if overwrite:
            raise ValueError("BAM files are added to a folder; use mode append")
        self.path, self.text = options["path"], options.get("header", "")

    def write(self, batches) -> Part:
        store, at = _store(self.path)
        store.create_dir(at, recursive=True)
        first, refs = head(self.text)
        name, held, n = f"part-{uuid.uuid4().hex}.bam", bytearray(), 0
        with store.open_output_stream(f"{at}/.{name}", compression=None) as out:
            for k in range(0, len(first), BLOCK):
                out.write(deflated(first[k : k + BLOCK]))
            for row in (dict(zip(b.schema.names, values)) for b in batches for values in zip(*(c.to_pylist() for c in b.columns))):
                r, n = encoded(row, refs), n + 1
                if held and len(held) + len(r) > BLOCK:  # a record begins a block if it doesn't fit in the one before
                    out.write(deflated(held))
                    held.clear()
                held += r
                while len(held) > BLOCK:
                    out.write(deflated(held[:BLOCK]))
                    del held[:BLOCK]
            out.write(deflated(held) if held else b"")
            out.write(END_BLOCK)
        return Part(name, n)

    def commit(self, messages) -> None:
        store, at = _store(self.path)
        for m in messages:
            if m is not None:
                store.move(f"{at}/.{m.name}", f"{at}/{m.name}")

    def abort(self, messages) -> None:
        store, at = _store(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{at}/.{m.name}")


class BamDataSource(DataSource):
    """``spark.read.format("bam")`` and ``df.write.format("bam")``; see the module."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> BamReader:
        return BamReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> BamWriter:
        return BamWriter(self.options, overwrite)


def register(spark) -> None:
    """The source under its name, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamDataSource)


def header_text(path: str) -> str:
    """The header of the first file that a path names."""
    store, _ = _store(path)
    name, size = _files(path)[0]
    with store.open_input_file(name) as f:
        return header(f, size)[0]
