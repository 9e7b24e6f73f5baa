"""Language identification by family first, then by pairs within the family.

Texts are lower-cased byte n-grams (two to four bytes) hashed into bins. One
linear support vector machine for each family tells it from the others; within a
family one machine for each pair of languages votes, and the language with most
votes, then the largest sum of margins, wins. Machines are trained here, by
accelerated gradient descent on the squared hinge loss, from a bounded sample of
labelled documents: ``PER_LANG`` at most of each language. More languages than
``MAX_LANGS``, of which weights would no longer fit in a worker, are an error; so none is left out unsaid. Every machine is fitted in a task of its own from the rows that it
tells apart (of other families a share, about as many as its own); only weights
reach the driver.

A text that is null or has no letter is ``und`` with score 0. The score is the
smaller of the logistic values of half the family's lead over the second family
(with two families, its margin) and of the language's least margin in its pairs.
Repeated rows are told each. Null langs and texts without a letter are not learned
from; with no language to learn every text is ``und``, with one language every text
with a letter is that language with score 1.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import held_out, released, rest, text_steps, written
from strandlake.session import ship

PER_LANG, MAX_LANGS = 500, 4000
BITS = 12
GRAMS = (2, 3, 4)
SHARP = 4.0

#: Families of closely related languages: fixed values. Any other language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
}

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def gram_codes(data: np.ndarray) -> list[np.ndarray]:
    """Bins of the n-grams that begin at each byte, for each n."""
    low = _LOWER[data]
    out, code = [], np.zeros(len(low), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        if len(low) < n:
            out += [np.zeros(0, np.int64)] * (n in GRAMS)
            continue
        code = code[: len(low) - n + 1] * np.uint64(256) + low[n - 1 :]
        if n in GRAMS:
            mixed = (code + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)
            out.append((mixed >> np.uint64(64 - BITS)).astype(np.int64))
    return out


def _letters(part: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text has a letter."""
    total = np.concatenate(([0], np.cumsum(_LETTER[data])))
    has = total[off[1:]] > total[off[:-1]]
    for k in np.flatnonzero(~has & (np.diff(off) > 0)).tolist():
        has[k] = any(map(str.isalpha, data[off[k] : off[k + 1]].tobytes().decode("utf-8", "replace")))
    return has


def fit_machine(x: np.ndarray, y: np.ndarray, cost: float = 30.0, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine; y is 1 or -1, both kinds weigh the same."""
    c = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    y = y.astype(x.dtype)
    # the bias is the last weight, of a feature that is always one
    reach = 1 + 2 * cost * float(c @ (np.einsum("ij,ij->i", x, x) + 1))
    w = ahead = np.zeros(x.shape[1] + 1)
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead[:-1].astype(x.dtype) + x.dtype.type(ahead[-1])))
        pull = c * y * slack
        new = ahead - (ahead - 2 * cost * np.append(pull @ x, pull.sum())) / reach
        ahead, w = new + t / (t + 3) * (new - w), new
    return w[:-1], float(w[-1])


def machines_of(langs: list[str]) -> tuple[list[str], list[tuple[str, str]]]:
    """Families, and pairs of languages within one, that have a machine each (a single family has none)."""
    families = sorted({family_of(v) for v in langs})
    return families, [p for p in combinations(sorted(langs), 2) if family_of(p[0]) == family_of(p[1])]


class Model:
    """Machines of families and of pairs within them, their weights side by side."""

    def __init__(self, langs: list[str], weights: np.ndarray | None = None, bias: np.ndarray | None = None):
        self.langs = sorted(langs)
        self.families, self.pairs = machines_of(self.langs)
        self.weights = np.zeros((0, 1 << BITS)) if weights is None else weights
        self.bias = np.zeros(0) if bias is None else bias

    def margins(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Margins of all machines for each text, (n, machines)."""
        n = len(off) - 1
        out = np.zeros((n, len(self.bias)))
        for size, codes in zip(GRAMS, gram_codes(data)):
            ends = np.maximum(off[1:] - size + 1, off[:-1])
            count = np.maximum(ends - off[:-1], 1)
            a, b = np.minimum(off[:-1], len(codes)), np.minimum(ends, len(codes))
            for m, w in enumerate(self.weights):
                total = np.concatenate(([0.0], np.cumsum(w[codes])))
                out[:, m] += (total[b] - total[a]) / count * SCALE
        return out + self.bias

    def predict(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each text."""
        n = len(off) - 1
        if not self.langs:
            return np.full(n, "und", object), np.zeros(n)
        margins = self.margins(data, off)
        several = len(self.families) > 1
        fam = margins[:, : len(self.families)] if several else np.full((n, 1), np.inf)
        best = fam.argmax(1)
        ranked = np.sort(fam, axis=1)
        sure = (ranked[:, -1] - ranked[:, -2]) / 2 if several else np.full(n, np.inf)
        lang = np.full(n, "", object)
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(best == k)
            own = [v for v in self.langs if family_of(v) == f]
            votes, least, total = (np.full((len(rows), len(own)), v) for v in (0.0, np.inf, 0.0))
            for m, (a, b) in enumerate(self.pairs):
                if family_of(a) == f:
                    d = margins[rows, len(self.families) * several + m]
                    for at, s in ((own.index(a), d), (own.index(b), -d)):
                        votes[:, at] += s > 0
                        least[:, at] = np.minimum(least[:, at], s)
                        total[:, at] += np.tanh(s)
            won = (votes * 1000 + total).argmax(1)
            lang[rows] = np.array(own, object)[won]
            sure[rows] = np.minimum(sure[rows], least[np.arange(len(rows)), won])
        return lang, 1 / (1 + np.exp(-SHARP * np.clip(sure, -20, 20)))


SCALE = 100.0


def bags(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Scaled n-gram shares of each text, (n, 2^BITS)."""
    out = np.zeros((len(off) - 1, 1 << BITS))
    codes = gram_codes(data)
    for k, (a, b) in enumerate(zip(off[:-1], off[1:])):
        for size, c in zip(GRAMS, codes):
            if b - a >= size:
                out[k] += np.bincount(c[a : b - size + 1], minlength=1 << BITS) * (SCALE / (b - a - size + 1))
    return out


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, off in text_steps(batch, step=1 << 17):
            has = np.flatnonzero(_letters(part, data, off))
            x = bags(data, off)[has].astype(np.float32)
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("lang")).take(pa.array(has)), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])


def train(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """Machines from ``per_lang`` documents at most of each language, none of them held out."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages: give MAX_LANGS a larger value, or merge names of the same language")
    if not counts:
        return Model([])
    # hash draws of somewhat more than wanted, of which the lowest stay; rows of one draw in order of their texts
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = F.create_map(*[F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, min(1.0, 1.2 * per_lang / n + 20 / n))])[F.col("lang")]
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("draw", F.xxhash64("text")))
    some = rows.withColumn("draw", draw).where(F.col("draw") / float(1 << 30) < share).withColumn("nth", nth).where(F.col("nth") <= per_lang)
    bagged = written(some.select("lang", "text").mapInArrow(_sampled, "lang string, x binary"), "lang-bags")
    sizes = {r["lang"]: r["count"] for r in bagged.groupBy("lang").count().collect()}  # one row a language, at most MAX_LANGS
    families, pairs = machines_of(list(sizes))
    if len(sizes) < 2:
        return Model(list(sizes))
    # the machines that a row helps to fit, and on which side; other families' rows are thinned to about a family's own number
    size_of = {f: sum(n for v, n in sizes.items() if family_of(v) == f) for f in families}
    several, whole = len(families) > 1, sum(sizes.values())

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, at, machine, side = batch.column(0).to_pylist(), [], [], []
            for k, (lang, x) in enumerate(zip(langs, batch.column(1))):
                lot = zlib.crc32(x.as_buffer()) / 2.0**32
                for m, f in enumerate(families if several else ()):
                    own = family_of(lang) == f
                    if own or lot < max(size_of[f], per_lang) / max(1, whole - size_of[f]):
                        at.append(k), machine.append(m), side.append(1 if own else -1)
                for m, p in enumerate(pairs):
                    if lang in p:
                        at.append(k), machine.append(len(families) * several + m), side.append(1 if lang == p[0] else -1)
            for a in range(0, len(at), 512):
                yield pa.RecordBatch.from_arrays([pa.array(machine[a : a + 512], pa.int32()), pa.array(side[a : a + 512], pa.int32()), batch.column(1).take(pa.array(at[a : a + 512]))], names=["machine", "side", "x"])

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "x"], ignore_index=True)  # the same machine in whatever order rows arrive
        rest()
        w, b = fit_machine(np.frombuffer(b"".join(pdf["x"]), np.float32).reshape(len(pdf), -1), pdf["side"].to_numpy())
        return pd.DataFrame({"machine": [int(pdf["machine"].iloc[0])], "w": [w.tobytes()], "b": [b]})

    got = bagged.mapInArrow(dealt, "machine int, side int, x binary").groupBy("machine").applyInPandas(fitted, "machine int, w binary, b double")
    got = sorted(got.collect(), key=lambda r: r["machine"])  # weights alone
    released(bagged)
    return Model(list(sizes), np.array([np.frombuffer(r["w"]) for r in got]), np.array([r["b"] for r in got]))


def _told(model: Model, part: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lang, score = model.predict(data, off)
    none = ~_letters(part, data, off)
    lang[none], score[none] = "und", 0.0
    return lang, score


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in text_steps(batch):
                lang, score = _told(model, part, data, off)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def kept(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """Rows of ``docs``, all columns, whose language is told with a score of at least ``least``."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in text_steps(batch):
                lang, score = _told(model, part, data, off)
                yield part.filter(pa.array((lang != "und") & (score >= least)))

    return docs.mapInArrow(run, docs.schema)


def told(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``."""
    return identified(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
