"""Alignment kernels over many pairs at once: the pair is the arrays' first axis."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Pairs, and cells of a row of all pairs, that a kernel takes at once; columns that an extension looks at in one step.
PAIRS, CELLS, COLUMNS = 4096, 1 << 20, 64
_LOW = np.int64(-(1 << 40))


def codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts behind each other, and offsets by text."""
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), at


def _padded(flat: np.ndarray, at: np.ndarray, rows: np.ndarray, fill: int) -> np.ndarray:
    size = at[rows + 1] - at[rows]
    out = np.full((len(rows), int(size.max(initial=0))), fill, np.uint32)
    inside = np.arange(out.shape[1]) < size[:, None]
    out[inside] = flat[(at[rows, None] + np.arange(out.shape[1]))[inside]]
    return out


def _classes(la: np.ndarray, lb: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of like lengths, in parts of bounded size."""
    order = np.lexsort((la, lb))
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and stop - start < PAIRS and (stop - start) * (int(lb[order[stop]]) + 1) < CELLS and lb[order[stop]] <= 2 * max(8, lb[order[start]]):
            stop += 1
        yield order[start:stop]
        start = stop


def local_scores(a: Sequence[str], b: Sequence[str], match: int = 1, mismatch: int = -1, gap_open: int = -3, gap_extend: int = -2) -> np.ndarray:
    """Best local score of each pair with affine gaps (a gap of n costs open + n extend); two rows a pair are held."""
    fa, aa = codes(a)
    fb, ab = codes(b)
    out = np.zeros(len(a), np.int64)
    for rows in _classes(np.diff(aa), np.diff(ab)):
        x, y = _padded(fa, aa, rows, 0x110000), _padded(fb, ab, rows, 0x110001)  # what fills up matches nothing
        n, m = len(rows), y.shape[1]
        if not x.shape[1] or not m:
            continue
        at = np.arange(m + 1) * gap_extend
        h, down, best = np.zeros((n, m + 1), np.int64), np.full((n, m + 1), _LOW), np.zeros(n, np.int64)
        for i in range(x.shape[1]):
            down = np.maximum(down, h + gap_open) + gap_extend
            new = np.maximum(down, 0)
            new[:, 1:] = np.maximum(new[:, 1:], h[:, :-1] + np.where(y == x[:, i : i + 1], match, mismatch))
            run = np.maximum.accumulate(new - at + gap_open, axis=1)  # a gap along the row begins at some earlier cell of it
            new[:, 1:] = np.maximum(new[:, 1:], run[:, :-1] + at[1:])
            h = new
            best = np.maximum(best, h.max(1))
        out[rows] = best
    return out


def _side(q: np.ndarray, q_at: np.ndarray, s: np.ndarray, s_at: np.ndarray, step: int, room: np.ndarray, match: int, mismatch: int, drop: int) -> tuple[np.ndarray, np.ndarray]:
    """(gain, length) of the best ungapped extension to one side, which ends once the sum is more than ``drop`` below its best."""
    n = len(room)
    total, best, length = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    alive, at = np.flatnonzero(room > 0), 0
    while len(alive):
        col = at + np.arange(COLUMNS)
        there = col < room[alive, None]
        qi = np.where(there, q_at[alive, None] + step * col, 0)
        si = np.where(there, s_at[alive, None] + step * col, 0)
        score = np.where(there, np.where(q[qi] == s[si], match, mismatch), _LOW >> 10)
        run = total[alive, None] + np.cumsum(score, 1)
        top = np.maximum.accumulate(np.maximum(run, best[alive, None]), 1)
        ended = top - run > drop
        stops = np.where(ended.any(1), ended.argmax(1), COLUMNS)
        run = np.where(np.arange(COLUMNS) < stops[:, None], run, _LOW)
        here, gain = run.argmax(1), run.max(1)
        more = gain > best[alive]
        best[alive[more]], length[alive[more]] = gain[more], at + here[more] + 1
        total[alive] = run[:, -1]
        alive, at = alive[stops == COLUMNS], at + COLUMNS
    return best, length


def extended(q: Sequence[str], s: Sequence[str], q_pos: np.ndarray, s_pos: np.ndarray, word: int, match: int = 1, mismatch: int = -2, drop: int = 10, row: np.ndarray | None = None) -> np.ndarray:
    """(q_lo, q_hi, s_lo, s_hi, score) by word: each exact word's ungapped extension to both sides, places from 0 and inclusive. ``row`` tells the pair of texts of each word, where there isn't one each."""
    fq, aq = codes(q)
    fs, as_ = codes(s)
    q_pos, s_pos = np.asarray(q_pos, np.int64), np.asarray(s_pos, np.int64)
    row = np.arange(len(q_pos)) if row is None else row
    right = np.minimum(np.diff(aq)[row] - q_pos, np.diff(as_)[row] - s_pos) - word
    up, far = _side(fq, aq[row] + q_pos + word, fs, as_[row] + s_pos + word, 1, right, match, mismatch, drop)
    down, back = _side(fq, aq[row] + q_pos - 1, fs, as_[row] + s_pos - 1, -1, np.minimum(q_pos, s_pos), match, mismatch, drop)
    return np.column_stack((q_pos - back, q_pos + word - 1 + far, s_pos - back, s_pos + word - 1 + far, word * match + up + down))


def _last_rows(x: np.ndarray, y: np.ndarray, match: int, mismatch: int, gap: int) -> np.ndarray:
    at = np.arange(len(y) + 1) * gap
    row = at.copy()
    for ch in x:
        new = np.concatenate(([row[0] + gap], np.maximum(row[:-1] + np.where(y == ch, match, mismatch), row[1:] + gap)))
        row = np.maximum.accumulate(new - at) + at
    return row


def linear_ops(a: str, b: str, match: int = 1, mismatch: int = -1, gap: int = -2) -> tuple[int, str]:
    """(score, operations M, I, D) of a best global alignment of ``a`` to ``b`` in memory linear in their lengths, by divide and conquer."""
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    out: list[str] = []
    total = 0
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        n, m = a1 - a0, b1 - b0
        if not n or not m:
            out.append("I" * n + "D" * m)
            total += gap * (n + m)
        elif n == 1:
            hit = np.flatnonzero(y[b0:b1] == x[a0])
            best = match if len(hit) else mismatch
            if best + gap * (m - 1) >= gap * (m + 1):
                k = int(hit[0]) if len(hit) else 0
                out.append("D" * k + "M" + "D" * (m - 1 - k))
                total += best + gap * (m - 1)
            else:
                out.append("I" + "D" * m)
                total += gap * (m + 1)
        else:
            mid = a0 + n // 2
            fore = _last_rows(x[a0:mid], y[b0:b1], match, mismatch, gap)
            aft = _last_rows(x[mid:a1][::-1], y[b0:b1][::-1], match, mismatch, gap)[::-1]
            cut = b0 + int((fore + aft).argmax())
            todo += [(mid, a1, cut, b1), (a0, mid, b0, cut)]
    return total, "".join(out)
