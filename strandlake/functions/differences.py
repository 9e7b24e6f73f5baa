"""Reads as differences from the reference: flags and lists of mismatches and offsets, and back; all rows of a batch at once.

A base's place on the reference is its place in the read plus all offsets up to it. An offset above 0 skips
bases of the reference (a deletion D, or a gap N); one of -n goes back for n bases that the reference lacks (an insertion I, or
a clip S), all of which are mismatches. Bases that agree with the reference are held nowhere.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.functions.batch import codes

FIELDS = "has_mismatch array<boolean>, mismatch string, has_offset array<boolean>, offsets array<int>, kinds string, ref_len int"
_IN_READ, _IN_REF = np.zeros(128, bool), np.zeros(128, bool)
_IN_READ[[ord(c) for c in "MIS=X"]] = True
_IN_REF[[ord(c) for c in "MDN=X"]] = True


def parsed(cigars: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n, op) of all parts of all CIGAR strings, in order; H and P, and parts of no base, are left out."""
    at = np.concatenate(([0], np.cumsum([len(c) for c in cigars]))).astype(np.int64)
    return _parts(np.frombuffer("".join(cigars).encode("ascii"), np.uint8), at)


def _parts(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    op_at = np.flatnonzero((raw < 48) | (raw > 57))
    before = np.concatenate(([-1], op_at[:-1]))
    n, value = np.zeros(len(op_at), np.int64), 1
    for k in range(1, 1 + int((op_at - before - 1).max(initial=0))):
        there = op_at - k > before
        n[there] += value * (raw[op_at[there] - k].astype(np.int64) - 48)
        value *= 10
    row, op = np.searchsorted(at[1:], op_at, "right"), raw[op_at]
    keep = (n > 0) & (_IN_READ[op] | _IN_REF[op])
    return row[keep], n[keep], op[keep]


def _reordered(row: np.ndarray, n: np.ndarray, op: np.ndarray) -> None:
    """Insertions and clips before the gaps that they follow, which says the same; in place."""
    gap, lacking = np.isin(op, (68, 78)), np.isin(op, (73, 83))
    while True:
        swap = np.flatnonzero(gap[:-1] & lacking[1:] & (row[:-1] == row[1:]))
        if not len(swap):
            return
        for a in (n, op, gap, lacking):
            a[swap], a[swap + 1] = a[swap + 1].copy(), a[swap].copy()


def _split(values: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    return np.split(values, at[1:-1]) if len(at) > 1 else []


def differences(reads: Sequence[str], cigars: Sequence[str], windows: Sequence[str]) -> dict[str, list]:
    """The ``FIELDS`` of each read from its CIGAR and the reference's bases under it, from its first aligned base on.

    A CIGAR that asks for other bases than read and window have is an error. A gap at the end of a read has no base to
    stand before: it counts in ref_len only. Next to each other, D and N are one offset of the last one's kind.
    """
    base_at = codes(reads)[1]
    differs, letters, cut, has_offset, offsets, kind, at, ref_len = _differences(*codes(reads), *parsed(cigars), *codes(windows), lambda k: cigars[k])
    held = letters.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    kinds = kind.tobytes().decode("ascii")
    return {
        "has_mismatch": _split(differs, base_at), "mismatch": [held[a:b] for a, b in zip(cut, cut[1:])], "has_offset": _split(has_offset, base_at),
        "offsets": _split(offsets, at), "kinds": [kinds[a:b] for a, b in zip(at, at[1:])], "ref_len": ref_len.tolist(),
    }


def _differences(base: np.ndarray, base_at: np.ndarray, row: np.ndarray, n: np.ndarray, op: np.ndarray, under: np.ndarray, under_at: np.ndarray, cigar) -> tuple[np.ndarray, ...]:
    """The values of ``differences`` in flat arrays: flags by base, mismatches and their ends by row, flags by base, offsets, their kinds and ends by row, lengths by row."""
    rows = len(base_at) - 1
    _reordered(row, n, op)
    ref_len = np.bincount(row, n * _IN_REF[op], rows).astype(np.int64)
    bad = (np.bincount(row, n * _IN_READ[op], rows).astype(np.int64) != np.diff(base_at)) | (ref_len > np.diff(under_at))
    if bad.any():
        k = int(np.flatnonzero(bad)[0])
        raise ValueError(f"CIGAR {cigar(k)} does not fit a read of {base_at[k + 1] - base_at[k]} and {under_at[k + 1] - under_at[k]} bases of reference")
    new = np.ones(len(row), bool)
    new[1:] = row[1:] != row[:-1]
    # what a gap skips belongs to the next part of the read
    gap = np.isin(op, (68, 78))
    skipped = np.cumsum(np.where(gap, n, 0))
    own = np.flatnonzero(~gap)
    last = np.concatenate(([-1], own[:-1]))
    start = np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
    since = np.maximum(last, start[own] - 1)
    pending = skipped[own] - np.where(since >= 0, skipped[since], 0)
    lacking = np.isin(op[own], (73, 83))
    offset = np.where(lacking, -n[own], pending)
    kind = np.where(lacking, op[own], op[np.maximum(own - 1, 0)])
    first = np.cumsum(n[own]) - n[own]  # in the flat array of all bases
    has_offset, step = np.zeros(len(base), bool), np.zeros(len(base), np.int64)
    some = offset != 0
    has_offset[first[some]], step[first[some]] = True, offset[some]
    text = np.repeat(np.arange(rows), np.diff(base_at))
    place = _places(step, base_at, text)
    absent = np.repeat(lacking, n[own])
    reach = np.where(absent, 0, under_at[text] + place)
    differs = absent.copy()
    differs[~absent] = under[reach[~absent]] != base[~absent]
    cut = np.searchsorted(np.flatnonzero(differs), base_at)
    at = np.searchsorted(np.flatnonzero(has_offset), base_at)
    return differs, base[differs], cut, has_offset, offset[some].astype(np.int32), kind[some].astype(np.uint8), at, ref_len.astype(np.int32)


def _places(step: np.ndarray, at: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Places on the reference, from 0 at each row's first aligned base."""
    moved = np.cumsum(step)
    before = np.concatenate(([0], moved))[at[:-1]]
    return moved - before[text] + np.arange(len(step)) - at[:-1][text]


def _flat(lists: Sequence, dtype) -> tuple[np.ndarray, np.ndarray]:
    at = np.concatenate(([0], np.cumsum([len(v) for v in lists]))).astype(np.int64)
    return (np.concatenate([np.asarray(v, dtype) for v in lists]) if len(lists) else np.zeros(0, dtype)), at


class Held:
    """Reads of a batch as they are held."""

    def __init__(self, has_mismatch: Sequence, mismatch: Sequence[str], has_offset: Sequence, offsets: Sequence, kinds: Sequence[str]):
        self._told(*_flat(has_mismatch, bool), *codes(mismatch), *_flat(has_offset, bool), *_flat(offsets, np.int64), np.frombuffer("".join(kinds).encode("ascii"), np.uint8))

    @classmethod
    def of(cls, h: pa.StructArray) -> Held:
        """From a column of structs of ``FIELDS``."""
        out = cls.__new__(cls)
        out._told(*_values(h.field("has_mismatch")), *_text(h.field("mismatch")), *_values(h.field("has_offset")), *_values(h.field("offsets")), _text(h.field("kinds"))[0].astype(np.uint8))
        return out

    def _told(self, differs: np.ndarray, at: np.ndarray, letters: np.ndarray, letters_at: np.ndarray, has_offset: np.ndarray, other: np.ndarray, offsets: np.ndarray, per_row: np.ndarray, kinds: np.ndarray) -> None:
        self.differs, self.at, self.has_offset, self.offsets, self.letters, self.kinds = differs, at, has_offset, offsets.astype(np.int64), letters, kinds
        told = np.concatenate(([0], np.cumsum(self.has_offset)))
        missed = np.concatenate(([0], np.cumsum(self.differs)))
        if not (np.array_equal(self.at, other) and np.array_equal(told[self.at], per_row) and np.array_equal(missed[self.at], letters_at) and len(self.kinds) == len(self.offsets)):
            raise ValueError("flags and lists of differences do not fit each other")
        self.text = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
        self.step = np.zeros(len(self.differs), np.int64)
        self.step[self.has_offset] = self.offsets
        self.kind = np.zeros(len(self.differs), np.uint8)
        self.kind[self.has_offset] = self.kinds
        # bases that the reference lacks, and which kind they are
        first = np.flatnonzero(self.step < 0)
        size = np.minimum(-self.step[first], self.at[self.text[first] + 1] - first)
        every = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        self.absent = np.zeros(len(self.differs), np.uint8)
        self.absent[every] = np.repeat(self.kind[first], size)

    def reads(self, windows: Sequence[str]) -> list[str]:
        """The bases again; one that is said to agree where the window has none is an error."""
        whole = self._bases(*codes(windows)).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        return [whole[a:b] for a, b in zip(self.at, self.at[1:])]

    def _bases(self, under: np.ndarray, under_at: np.ndarray) -> np.ndarray:
        place = _places(self.step, self.at, self.text)
        out = np.zeros(len(self.differs), np.uint32)
        out[self.differs] = self.letters
        same = ~self.differs
        if ((place < 0) | (place >= np.diff(under_at)[self.text]))[same].any():
            raise ValueError("a base agrees with a place beyond the reference")
        out[same] = under[under_at[self.text[same]] + place[same]]
        return out

    def cigars(self, exact: bool = False, clipped: bool = False) -> list[str]:
        """CIGAR strings, with = and X for M where ``exact``, without clips where ``clipped``."""
        raw, at = self._cigars(exact, clipped)
        whole = raw.tobytes().decode("ascii")
        return [whole[a:b] for a, b in zip(at, at[1:])]

    def _cigars(self, exact: bool = False, clipped: bool = False) -> tuple[np.ndarray, np.ndarray]:
        state = np.where(self.absent > 0, self.absent, np.where(self.differs, 88, 61) if exact else 77)
        new = np.ones(len(state), bool)
        new[1:] = (state[1:] != state[:-1]) | (self.text[1:] != self.text[:-1]) | (self.step[1:] != 0)
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(state)))
        gaps = np.flatnonzero(self.step > 0)
        where = np.concatenate((2 * begin + 1, 2 * gaps))
        order = np.argsort(where, kind="stable")
        n = np.concatenate((size, self.step[gaps]))[order]
        op = np.concatenate((state[begin], self.kind[gaps]))[order]
        row = self.text[where[order] // 2] if len(order) else np.zeros(0, np.int64)
        if clipped:
            keep = op != 83
            n, op, row = n[keep], op[keep], row[keep]
        digits = np.ones(len(n), np.int64)
        while (more := n >= 10**digits).any():
            digits[more] += 1
        end = np.cumsum(digits + 1)
        raw = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
        raw[end - 1] = op
        for k in range(int(digits.max(initial=0))):
            there = digits > k
            raw[end[there] - 2 - k] = 48 + n[there] // 10**k % 10
        return raw, np.concatenate(([0], end))[np.searchsorted(row, np.arange(len(self.at)))]

    def summary(self) -> dict[str, list]:
        """left_clip, right_clip and edit_distance: bases that differ outside clips, and those deleted; gaps N cost nothing."""
        clip = self.absent == 83
        size = np.diff(self.at)
        inside = np.where(clip, 0, 1)
        within = np.concatenate(([0], np.cumsum(inside)))
        total = within[self.at[1:]] - within[self.at[:-1]]
        before = within[:-1] - within[self.at[:-1]][self.text]
        left = np.bincount(self.text, clip & (before == 0), len(size)).astype(np.int64)
        right = np.bincount(self.text, clip & (before == total[self.text]) & (before > 0), len(size)).astype(np.int64)
        deleted = np.where((self.step > 0) & (self.kind == 68), self.step, 0)
        edits = np.bincount(self.text, (self.differs & ~clip) + deleted, len(size)).astype(np.int64)
        return {"left_clip": left.tolist(), "right_clip": right.tolist(), "edit_distance": edits.tolist()}

    def _mismatch_reads(self) -> np.ndarray:
        out = np.full(len(self.differs), ord("="), np.uint32)
        out[self.differs] = self.letters
        return out

    def mismatch_reads(self) -> list[str]:
        """The reads with = where they agree with the reference."""
        whole = self._mismatch_reads().astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        return [whole[a:b] for a, b in zip(self.at, self.at[1:])]


def _text(c: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a text column behind each other, and offsets by row; a null is an error."""
    if c.null_count:
        raise ValueError("a text is null")
    c = c.cast(pa.string())
    if not len(c):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)
    raw = np.frombuffer(c.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return (raw, at - at[0]) if raw.max(initial=0) < 128 else codes(c.to_pylist())


def _upper(c: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``_text`` in upper case."""
    raw, at = _text(c)
    if raw.dtype != np.uint8:
        return codes([t.upper() for t in c.to_pylist()])
    return np.where((raw > 96) & (raw < 123), raw - 32, raw), at


def _values(c: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists behind each other, and offsets by row."""
    at = c.offsets.to_numpy().astype(np.int64)
    return c.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False), at - at[0]


def _texts(values: np.ndarray, at: np.ndarray) -> pa.Array:
    if values.max(initial=0) < 128:
        return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(values.astype(np.uint8)))
    whole = values.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return pa.array([whole[a:b] for a, b in zip(at, at[1:])], pa.string())


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))


def held(read: Column, cigar: Column, window: Column) -> Column:
    """The differences of a read from the reference under it, both in upper case, a struct of ``FIELDS``; see ``differences``."""

    def run(read: pa.Array, cigar: pa.Array, window: pa.Array) -> pa.Array:
        base, base_at = _upper(read)
        differs, letters, cut, has_offset, offsets, kind, at, ref_len = _differences(base, base_at, *_parts(*_text(cigar)), *_upper(window), lambda k: cigar[k].as_py())
        columns = {
            "has_mismatch": _lists(differs, base_at), "mismatch": _texts(letters, cut), "has_offset": _lists(has_offset, base_at),
            "offsets": _lists(offsets, at), "kinds": _texts(kind, at), "ref_len": pa.array(ref_len, pa.int32()),
        }
        return pa.StructArray.from_arrays(list(columns.values()), list(columns))

    return F.arrow_udf(run, f"struct<{FIELDS.replace(', ', ',').replace(' ', ':')}>")(read, cigar, window)


_DESCRIBED = "cigar:string,exact_cigar:string,clipped_cigar:string,left_clip:int,right_clip:int,edit_distance:int,mismatch_read:string"


def _described(x: Held) -> dict[str, pa.Array]:
    clips = {k: pa.array(v, pa.int32()) for k, v in x.summary().items()}
    return {"cigar": _texts(*x._cigars()), "exact_cigar": _texts(*x._cigars(exact=True)), "clipped_cigar": _texts(*x._cigars(clipped=True))} | clips | {"mismatch_read": _texts(x._mismatch_reads(), x.at)}


def restored(h: Column, window: Column) -> Column:
    """A read from its differences and the reference under it in upper case, with all that ``described`` tells: a struct of seq and that."""

    def run(h: pa.Array, window: pa.Array) -> pa.Array:
        x = Held.of(h)
        columns = {"seq": _texts(x._bases(*_upper(window)), x.at)} | _described(x)
        return pa.StructArray.from_arrays(list(columns.values()), list(columns))

    return F.arrow_udf(run, f"struct<seq:string,{_DESCRIBED}>")(h, window)


def described(h: Column) -> Column:
    """CIGARs, clips, edit distance and mismatches of a read, from its differences alone."""

    def run(h: pa.Array) -> pa.Array:
        columns = _described(Held.of(h))
        return pa.StructArray.from_arrays(list(columns.values()), list(columns))

    return F.arrow_udf(run, f"struct<{_DESCRIBED}>")(h)


def kept_quality(quality: Column, has_mismatch: Column, fill: str = "?") -> Column:
    """The qualities of bases that differ, others as ``fill``: what is worth keeping of them; null where the lengths differ."""
    marks = F.zip_with(F.split(quality, ""), has_mismatch, lambda q, m: F.when(m, q).otherwise(fill))
    return F.when(F.length(quality) == F.size(has_mismatch), F.array_join(F.slice(marks, 1, F.size(has_mismatch)), ""))
