"""Centroids, language model and lexical search against brute-force versions, and the cases that their docstrings define."""

import hashlib
import math
import pickle
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import bloom_lm, centroids, lexical_search, queries

VECTORS = "vec_id long, embedding array<float>, label int, x int, cluster int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "a", "Ein Wort", "lang " * 30_000, "tie tie tie", "tie tie tie", "日本語 テキスト ꟎", "1234 5678!!", "a\x00b �", "İ ſtraße ÄÖ"]


@pytest.fixture(scope="module")
def docs(spark, sf):
    odd = [(10_000 + k, t, None, None, None) for k, t in enumerate(ODD)] + [(None, "no id here at all", "en", "s", 1), (10_003, "a", None, None, None)]
    real = spark.read.parquet(f"{sf}/documents.parquet")
    return real.unionByName(spark.createDataFrame(odd, DOCS)).withColumns({c: F.lit(1) for c in ("norm", "terms", "n", "score", "held_out", "item_id", "shard", "row")}).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


# --- centroids -----------------------------------------------------------------


def clusters(vectors, k, rounds, dim, scale, seed="2"):
    """The same by plain Python: a list of (vec_id, cluster, distance), and the centroids."""
    kept = [(i, [math.floor(scale * float(c)) for c in v]) for i, v in vectors if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    drawn = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[0] or 0, np.array(r[1], np.float64).tobytes())
    points = [x for _, x in sorted(kept, key=drawn)[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(points))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, x in kept:
            own[near(x)[1]].append(x)
        points = [[sum(c) // len(own[j]) for c in zip(*own[j])] if own[j] else p for j, p in enumerate(points)]
    return [(i, *reversed(near(x))) for i, x in kept], points


def compared(spark, vectors, k, rounds, dim, scale=256):
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in vectors], VECTORS).repartition(3)
    plain = [(r.vec_id, r.embedding) for r in df.collect()]
    want, points = clusters(plain, k, rounds, dim, scale)
    by = Counter()
    for _, c, d in want:
        by[c] += d
    fits = lambda d: d if d < 1 << 63 else None
    whole = fits(sum(by.values()))
    wide = {c for _, c, d in want if d >= 1 << 63}
    digest = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    got = centroids.clustered(df, k, rounds, dim, scale).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(((i, c, fits(d), None if c in wide else fits(by[c]), None if wide else whole, digest[c]) for i, c, d in want), key=key)


def test_centroids(spark, sf):
    real = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    compared(spark, real, 40, 5, 64)
    rng = np.random.default_rng(5)
    small = [(i, v) for i, v in enumerate((rng.integers(-3, 4, (120, 5)) / 256).tolist())]  # many ties and equal rows
    odd = [(500, None), (501, []), (502, [1.0] * 4), (503, [None, 1.0, 1.0, 1.0, 1.0]), (504, [math.nan] * 5), (505, [math.inf] * 5), (None, [0.25] * 5), (7, small[7][1]), (7, [0.5] * 5)]
    compared(spark, small + odd, 9, 3, 5)
    compared(spark, small[:4] + odd, 40, 2, 5)


def test_centroids_beyond_64_bits(spark):
    """Distances that no 64-bit integer holds are null; clusters are exact all the same."""
    vast = [(i, [x, -x, 3.0 * i]) for i, x in enumerate((1e30, 1.5e30, 3e38, 2.0, 7e4, 1e8, 1e9, 0.0))]
    compared(spark, vast, 3, 4, 3)


def test_centroids_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    assert centroids.clustered(none).collect() == [] and centroids.clustered(none).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_the_walk_stops_early(spark):
    """In few dimensions most centroids are never met, and what is nearest is told all the same."""
    rng = np.random.default_rng(1)
    x, c = rng.integers(0, 10_000, (3000, 2)), rng.integers(0, 10_000, (200, 2))
    number, distance, opened = centroids.nearest(x, c)
    whole = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (number == whole.argmin(1)).all() and (distance == whole.min(1)).all() and opened < 0.25 * whole.size
    df = spark.createDataFrame([(i, [float(a) / 10_000, float(b) / 10_000], 1, 1, 1) for i, (a, b) in enumerate(x.tolist())], VECTORS)
    assert all(r.opened < 0.5 * r.distances for r in centroids.clustered(df, 100, 2, 2, 10_000, report=True).collect())


# --- language model ------------------------------------------------------------


def plain_model(rows, folds=7, held=2):
    """Exact counts by plain Python, levels as the docstring tells them."""
    words = lambda t: [w.translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})) for w in re.findall(r"[^\x20\x09-\x0D]+", t)] + [None]
    learned = lambda i: i is not None and zlib.crc32(str(i).encode()) % folds != held
    one, two = Counter(), Counter()
    for i, t in rows:
        if learned(i):
            w = words(t)
            one.update(w)
            two.update(zip(["<start>", *w], w))

    def stands_for(c):
        if not c:
            return 0.0
        level = 1
        while bloom_lm.BASE**level <= c:
            level += 1
        whole = [x for x in range(math.ceil(bloom_lm.BASE ** (level - 1)), math.ceil(bloom_lm.BASE**level))]
        assert whole[0] <= c <= whole[-1]
        return sum(whole) / len(whole)

    n, v = sum(one.values()), len(one)
    out = []
    for i, t in rows:
        w = words(t)
        base = score = 0.0
        for h, x in zip(["<start>", *w], w):
            base += math.log10((one[x] + 1) / (n + v + 1))
            ch, cw = stands_for(one[None] if h == "<start>" else one[h]), stands_for(one[x])
            p = (min(stands_for(two[h, x]), ch, cw) + bloom_lm.MU * (cw + 1) / (n + v + 1)) / (ch + bloom_lm.MU)
            score += math.log10(p)
        out.append((i, not learned(i), len(w), sum(one[x] > 0 for x in w), n, base, score))
    return out


def alike(got, want, which=slice(None)):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 4))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:][which] for r in got], [r[5:][which] for r in want], rtol=1e-9, atol=1e-9)


def test_language_model(spark, docs, rows):
    want = plain_model(rows)
    alike(bloom_lm.scored(docs, bits=64).collect(), want)  # so many bits that no probe goes wrong
    alike(bloom_lm.scored(docs, broadcast=0).collect(), want)  # by joins
    usual = bloom_lm.scored(docs).collect()
    alike(usual, want, slice(0, 1))
    # with the usual bits few probes go wrong, and the model tells unseen text better than words alone
    score = {r.doc_id: r.score for r in usual}
    assert sum(abs(score[w[0]] - w[6]) for w in want if w[0] != 10_003) < 0.02 * sum(-w[6] for w in want)
    unseen = [r for r in usual if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_model_is_the_same_by_filter_and_by_joins(spark, docs):
    """Scores don't depend on whether the filter is within what may be broadcast, to the last bit; few bits change nothing either."""
    want = sorted(map(repr, bloom_lm.scored(docs, broadcast=0).collect()))
    assert sorted(map(repr, bloom_lm.scored(docs).collect())) == want
    assert sorted(map(repr, bloom_lm.scored(docs, bits=2).collect())) == want


def test_model_travels_in_parts(spark, docs, monkeypatch):
    """No worker holds filter and words whole, and scores don't depend on how they are cut, nor on how many tokens are asked about at once."""
    want = {order: sorted(map(repr, bloom_lm.scored(docs, order=order).collect())) for order in (1, 2, 3)}
    sent, send = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda sc, x: sent.append(len(pickle.dumps(x))) or send(sc, x))
    monkeypatch.setattr(bloom_lm, "RANGE_BYTES", 20_000)
    monkeypatch.setattr(bloom_lm, "PART", 40_000, raising=False)
    monkeypatch.setattr(bloom_lm, "ASKED", 3_000, raising=False)
    for order in want:
        sent.clear()
        assert sorted(map(repr, bloom_lm.scored(docs, order=order).collect())) == want[order]
        assert len(sent) > 1 and max(sent) < sum(sent) / 2


def test_model_orders(spark, docs):
    """Every order's probabilities are below one and add up to about one over all words after a history."""
    for order in (1, 2, 3):
        assert all(r.score < 0 for r in bloom_lm.scored(docs, order=order, bits=64).collect())
    texts = ["a b a c", "a b", "c a b b"]
    df = spark.createDataFrame([(k, t, None, None, None) for k, t in zip([i for i in range(20) if not bloom_lm.held_out_py(i)], texts)], DOCS)
    assert not any(r.held_out for r in bloom_lm.scored(df).collect())
    table, shards = bloom_lm.counted(df)
    got = table.collect()
    n, v = sum(r.n for r in got), sum(r.v for r in got)
    assert (n, v, shards) == (13, 4, 1)  # with three ends
    bloom = bloom_lm.Filter.of([bloom_lm.piece(np.frombuffer(r.word_keys + r.gram_keys, np.uint64), bloom_lm.levels(np.frombuffer(r.word_counts + r.gram_counts, np.int64)), 64) for r in got])
    h = {w: bloom_lm.tokens(np.frombuffer(w.encode(), np.uint8), np.array([0, 1]))[0][0] for w in "abc"} | {None: bloom_lm.END}
    count = lambda k: bloom_lm.COUNTS[bloom.levels(np.array([k], np.uint64))]
    assert [float(count(h[w])[0]) for w in ("a", "b", "c", None)] == [4.5, 4.5, 2.0, 3.0]
    whole = sum(float(bloom_lm.smoothed([count(h[w]), count(bloom_lm.joined(np.array([h["c"]]), np.array([h[w]]))[0])], [count(h["c"])], n, v)[0]) for w in h)
    assert 0.9 < whole < 1.1


def test_model_of_odd_tables(spark, docs):
    assert bloom_lm.scored(docs.where("false")).collect() == []
    held = spark.createDataFrame([(None, "only rows without id", None, None, None)], DOCS)
    (r,) = bloom_lm.scored(held).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 5, 0, 0, 0.0)


def test_pieces_never_miss(spark):
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 63, 40_000, dtype=np.int64).view(np.uint64) * np.uint64(2)
    level = rng.integers(1, 9, len(keys))
    keys = np.sort(keys)
    shard = bloom_lm._shard(keys, 5)
    bloom = bloom_lm.Filter.of([bloom_lm.piece(keys[shard == s], level[shard == s]) for s in range(5)])
    got = bloom.levels(keys)
    assert (got >= level).all() and (got == level).mean() > 0.99
    assert (bloom.levels(keys + np.uint64(1)) > 0).mean() < 0.01


def test_many_ranges_and_flushes(spark, docs, rows, monkeypatch):
    """Small ranges and small holds give the same counts."""
    whole = bloom_lm.counted(docs)[0].collect()
    monkeypatch.setattr(bloom_lm, "RANGE_BYTES", 50_000)
    parts, shards = bloom_lm.counted(docs)
    got = parts.collect()
    assert shards > 5 and sum(r.n for r in got) == sum(r.n for r in whole) and sum(r.v for r in got) == sum(r.v for r in whole)
    counts = lambda rs, kind: sorted((k, n) for r in rs for k, n in zip(np.frombuffer(r[f"{kind}_keys"], np.uint64).tolist(), np.frombuffer(r[f"{kind}_counts"], np.int64).tolist()))
    assert counts(got, "word") == counts(whole, "word") and counts(got, "gram") == counts(whole, "gram")


# --- lexical search ------------------------------------------------------------


def ranked(rows, items, k=10):
    terms = lambda t: [w.translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    held = [(i, Counter(terms(t))) for i, t in rows]
    n, total, df = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held), Counter(w for _, c in held for w in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(terms(t))
    out = []
    for i, own in asked.items():
        found = []
        for d, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * n) // total if c else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 8 * m)) for w in own if c[w])
            if score > 0:
                found.append((-score, math.inf if d is None else d, d))
        out += [(i, r, d, -s) for r, (s, _, d) in enumerate(sorted(found, key=lambda x: x[:2])[:k], 1)]
    return sorted(out, key=lambda r: (r[0], r[1]))


ITEMS = "item_id long, text string, doc_id long"


def test_lexical_search(spark, sf, docs, rows, monkeypatch):
    real = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    odd = [(900, None), (901, ""), (902, "?!"), (903, "nowhere zzzzqqq"), (904, "a"), (905, "tie TIE Tie"), (905, "no id here"), (None, "tie"), (906, "テキスト Lang wort"), (907, "i̇ İ")]
    items = spark.createDataFrame([(i, t, 1) for i, t in real + odd], ITEMS)
    want = ranked(rows, real + odd)
    order = lambda df: sorted(map(tuple, df.collect()), key=lambda r: (r[0], r[1]))
    assert order(lexical_search.search(docs, items)) == want
    monkeypatch.setattr(lexical_search, "TERMS", 200)  # several groups, small buckets, first thresholds of few documents
    monkeypatch.setattr(lexical_search, "BUCKET", 16)
    monkeypatch.setattr(lexical_search, "FIRST", 20)
    monkeypatch.setattr(lexical_search, "ITEMS", 4)
    assert order(lexical_search.search(docs, items, 3)) == ranked(rows, real + odd, 3)
    (r,) = lexical_search.search(docs, items, 3, report=True).collect()
    assert 0 < r.rescored <= r.opened <= r.pairs and r.rescored < 0.7 * r.pairs


def test_lexical_search_of_nothing(spark, docs):
    none, items = docs.where("false"), spark.createDataFrame([(1, "tie", 1)], ITEMS)
    assert lexical_search.search(none, items).collect() == [] and lexical_search.search(docs, items.where("false")).collect() == []
    assert lexical_search.search(docs, spark.createDataFrame([(1, None, 1)], ITEMS)).columns == ["item_id", "rank", "doc_id", "score"]


def test_many_equal_documents(spark, sf):
    """A third of the rows have one text; ties go to the smallest ids."""
    texts = [(i, "common words here " + ("rare gem" if i % 3 == 0 else f"w{i}")) for i in range(3000)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in texts], DOCS)
    items = [(1, "rare gem"), (2, "common words"), (3, "w10 w11")]
    got = lexical_search.search(df, spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)).collect()
    assert sorted(map(tuple, got)) == ranked(texts, items)


def test_the_queries_have_sql():
    assert {"op11_centroids", "op13_lexical"} <= set(queries.oracle_sql())
