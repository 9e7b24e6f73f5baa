"""Every operator against a brute-force version, and the cases that its docstring defines."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandlake.llm import bpe, chat, edit_counts, langid, near_vectors, ngram_join, packing, quality, sharding, topk_search, vocab
from strandlake.llm.common import connected_components, held_out, held_out_py, shingle_sets

LONG = "lang " * 30_000
ODD = [None, "", " \n\t ", "a", "Ein Wort", LONG, "x" * 5000, "tie tie tie", "tie tie tie", "日本語 テキスト ꟎", "<|endoftext|> x<|endoftext|>", "1234 5678!!", "a\x00b �"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tk():
    return Tokenizer.from_file(vocab.default_path())


@pytest.fixture(scope="module")
def docs(spark, sf):
    """The small table with odd rows, a repeated row, a repeated id and a null id; extra columns clash with working names."""
    odd = [(10_000 + k, t, None, None, None) for k, t in enumerate(ODD)] + [(None, "no id here at all", "en", "s", 1), (10_003, "a", None, None, None)]
    real = spark.read.parquet(f"{sf}/documents.parquet")
    return real.unionByName(spark.createDataFrame(odd, DOCS)).withColumns({c: F.lit(1) for c in ("ids", "row", "key", "label", "shard", "rep", "token", "score")}).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def empty(spark):
    return spark.createDataFrame([], DOCS)


def ids_of(tk, text):
    return tk.encode(text or "", add_special_tokens=False).ids


def test_packing(spark, docs, rows, tk):
    out = packing.pack(docs).collect()
    want = Counter()
    for i, t in rows:
        want[(i, len(ids_of(tk, t)) + 1)] += 1
    assert Counter((r.doc_id, r.doc_tokens) for r in out if r.start == 0) == want
    text = dict(rows)
    at = defaultdict(list)
    for r in out:
        at[r.sequence_id].append((r.offset, r.length))
        if r.doc_id not in (None, 10_003):
            ids = np.array([*ids_of(tk, text[r.doc_id]), 1], "<u4")
            assert len(ids) == r.doc_tokens and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    pieces = defaultdict(int)
    for r in out:
        pieces[r.doc_id] += r.length
    assert all(pieces[i] == (len(ids_of(tk, t)) + 1) * sum(1 for x, _ in rows if x == i) for i, t in rows)
    full = [sum(n for _, n in v) for _, v in sorted(at.items())]
    assert sorted(at) == list(range(len(at))) and set(full[:-1]) <= {2048} and full[-1] <= 2048
    for v in at.values():
        v.sort()
        assert [o for o, _ in v] == [0, *np.cumsum([n for _, n in v])[:-1]]
    assert packing.pack(empty(spark)).count() == 0


def test_packing_follows_the_curve(docs, rows, tk):
    """Documents lie in the stream by their keys, worked out one at a time; texts of nearly the same words are neighbours."""
    text = dict(rows)
    got = sorted((r.sequence_id * 2048 + r.offset, r.doc_id) for r in packing.pack(docs).where("start = 0").collect() if r.doc_id is not None)
    size = max(tk.get_vocab().values()) + 1
    mixed = [packing.mix64(np.array([i + 1], np.uint64))[0] % np.uint64(packing.BINS) for i in range(size)]

    def key(i):
        counts = np.zeros((1, packing.BINS))
        for t in [*ids_of(tk, text[i]), 1]:
            counts[0, int(mixed[t])] += 1
        return int(packing.curve_keys(counts)[0])

    keys = [key(i) for _, i in got]
    assert keys == sorted(keys) and len(set(keys)) > len(keys) / 2


def test_packing_runs_are_bounded_by_bytes():
    sizes = np.array([10, 10, 5000, 1, 0, 0, 900, 900])
    got = list(packing.runs(sizes, most=3, reach=1000))
    assert [list(range(a, b)) for a, b in got] == [[0, 1], [2], [3, 4, 5], [6], [7]] and list(packing.runs(np.zeros(0))) == []
    assert [len(r) for r in bpe.steps(["x" * 10] * 5 + ["y" * 400] + ["z"] * 2, chars=25)] == [2, 2, 1, 1, 2]


def test_hilbert_curve_steps_to_neighbours():
    bits, dims = 3, 3
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    key = packing.hilbert_key(cells, bits)
    assert sorted(key.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def edited(text, edits):
    for e in edits:
        o = min(max(e["offset"], 0), len(text))
        n = min(max(e["removed"], 0), len(text) - o)
        text = text[:o] + e["added"] + text[o + n :]
    return text


def test_edit_counts(spark, docs, tk):
    df = edit_counts.standing_edits(docs)
    got = {r.doc_id: r for r in edit_counts.apply_edits(df).collect()}
    for r in df.collect():
        if r.doc_id == 10_003:
            continue
        text, g = edited(r.text or "", r.edits), got[r.doc_id]
        assert g.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (g.tokens_before, g.tokens_after, g.n_edits) == (len(ids_of(tk, r.text)), len(ids_of(tk, text)), 5)
        if len(text) > 3000 and " " in (r.text or ""):
            assert g.chars_encoded < len(text) / 2
    assert edit_counts.apply_edits(edit_counts.standing_edits(empty(spark))).count() == 0


def test_edits_at_random(tk):
    rng, counter = random.Random(5), edit_counts.Counter(vocab.default_path())
    parts = ["a", " ", "  ", "\n", "'", "'ll", "l", "9", "!", "<|endoftext|>", "<|", "endof", "text", "|>", "Wort", "é"]
    for _ in range(150):
        text = "".join(rng.choices(parts, k=rng.randrange(0, 40)))
        tree = edit_counts.PretokenTree.of(text, counter)
        for _ in range(6):
            o, n, add = rng.randrange(0, len(text) + 3), rng.randrange(0, 6), "".join(rng.choices(parts, k=rng.randrange(0, 4)))
            tree.edit(o, n, add)
            text = edited(text, [{"offset": o, "removed": n, "added": add}])
            assert tree.leaves()[0] == text and tree.n_tokens == len(ids_of(tk, text)) and tree.n_chars == len(text)
            chars, toks = tree.leaves()[1:]
            if rng.random() < 0.3:  # as if stored and read again
                tree = edit_counts.PretokenTree(text, chars, toks, counter)


def test_edits_stay_small_after_a_large_one(tk):
    """Leaves that a large edit fills are laid out anew, and a small edit there encodes little; so does one of many in one place."""
    rng, counter = random.Random(6), edit_counts.Counter(vocab.default_path())
    text = "word " * 500
    tree = edit_counts.PretokenTree.of(text, counter)
    added = " ".join(f"new{k % 97}" for k in range(20_000))
    tree.edit(1000, 10, added)
    text = edited(text, [{"offset": 1000, "removed": 10, "added": added}])
    assert max(len(w) for w, _ in tree.own.values()) <= edit_counts.FULL if tree.own else True
    for _ in range(300):
        o, before = rng.choice((5000, rng.randrange(len(text)))), tree.encoded
        tree.edit(o, 1, "q z")
        text = edited(text, [{"offset": o, "removed": 1, "added": "q z"}])
        assert tree.encoded - before < 200
    assert tree.leaves()[0] == text and tree.n_tokens == len(ids_of(tk, text))


def test_trees_are_kept(spark, docs, tk, tmp_path):
    """Trees written, read again and edited twice: counts and texts as by whole encoding, and little encoded."""
    edit_counts.with_trees(docs.select("doc_id", "text", "score")).write.parquet(f"{tmp_path}/one")
    one = edit_counts.edited(edit_counts.standing_edits(spark.read.parquet(f"{tmp_path}/one")))
    one.select("doc_id", F.col("after.text").alias("text"), F.struct("after.chars", "after.toks").alias("tree"), F.col("after.tokens_after").alias("n")).write.parquet(f"{tmp_path}/two")
    two = edit_counts.edited(edit_counts.standing_edits(spark.read.parquet(f"{tmp_path}/two")))
    for r in two.collect():
        want = edited(r.text, r.edits)
        assert r.after.text == want and r.after.tokens_before == r.n == len(ids_of(tk, r.text)) and r.after.tokens_after == len(ids_of(tk, want)) == sum(r.after.toks)
        if len(want) > 3000 and max(map(len, want.split())) < 200:
            assert r.after.chars_encoded < len(want) / 2
    # the registered way: counts from kept trees are those of whole encoding
    plain = {(r.doc_id, r.text_sha256): r for r in edit_counts.apply_edits(edit_counts.standing_edits(spark.read.parquet(f"{tmp_path}/one").drop("tree"))).collect()}
    for r in edit_counts.apply_edits(edit_counts.standing_edits(spark.read.parquet(f"{tmp_path}/one"))).collect():
        assert plain[r.doc_id, r.text_sha256] == r
    # a tree that doesn't fit is made anew
    bad = spark.read.parquet(f"{tmp_path}/two").withColumn("text", F.concat("text", F.lit("!"))).withColumn("edits", F.lit(None).cast("array<struct<offset:int,removed:int,added:string>>"))
    assert all(r.after.tokens_after == len(ids_of(tk, r.text)) and r.after.n_edits == 0 for r in edit_counts.edited(bad).collect())


def test_bpe(spark, docs, rows, tk):
    want = Counter()
    for i, t in rows:
        ids = ids_of(tk, t)
        text = tk.decode(ids, skip_special_tokens=False)
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter(map(tuple, bpe.digests(docs).collect())) == want
    back = bpe.decode(bpe.encode(docs.select("doc_id", "text")).select("text", "ids"))
    assert all((r.text or "") == r.decoded for r in back.collect())
    assert bpe.digests(empty(spark)).count() == 0


def test_bpe_trees_agree(tk):
    rng, e = random.Random(3), bpe.encoder(vocab.default_path())
    words = ["".join(rng.choices("abcdeth in", k=rng.randrange(1, 300))).strip() or "q" for _ in range(300)]
    for w, ids in zip(words, e.words(words)):
        assert bpe.long_word(e.trees, e.v.byte_id[list(w.encode())].tolist()) == ids
    solid = [w.replace(" ", "") for w in words]
    assert e.words(solid) == [ids_of(tk, w) for w in solid]


def brute_classes(rows, width, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    inverted = defaultdict(list)
    for i, s in sets.items():
        both = Counter()
        for k in s:
            both.update(inverted[k])
            inverted[k].append(i)
        for j, n in both.items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {(i, len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80)])
def test_jaccard_classes(spark, docs, rows, sf1, width, num):
    known = [(i, t) for i, t in rows if i is not None]
    got = {tuple(r) for r in ngram_join.jaccard_classes(docs, width, num, 100).collect()}
    assert {r for r in got if r[0] is not None} == brute_classes(known, width, num, 100)
    # chains of texts that differ in a word or two, so that links cross groups
    rng, chain = random.Random(width), []
    words = [f"w{rng.randrange(900)}" for _ in range(80)]
    for k in range(400):
        if k % 40 == 0:
            words = [f"w{rng.randrange(900)}" for _ in range(80)]
        words[rng.randrange(len(words))] = f"v{k}"
        chain.append((k, " ".join(words)))
    df = spark.createDataFrame(chain, "doc_id long, text string")
    assert {tuple(r) for r in ngram_join.jaccard_classes(df, width, num, 100).collect()} == brute_classes(chain, width, num, 100)


def test_jaccard_small_groups(spark, monkeypatch):
    """The same with groups cut to a few documents, so that nearly every link crosses groups."""
    monkeypatch.setattr(ngram_join, "GROUP_TOKENS", 200)
    monkeypatch.setattr(ngram_join, "MANY_GROUPS", 1000)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    near = []
    for k in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(60)] = f"x{rng.randrange(40)}"
        near.append((k, " ".join(w)))
    df = spark.createDataFrame(near, "doc_id long, text string")
    assert {tuple(r) for r in ngram_join.jaccard_classes(df, 3, 90, 100).collect()} == brute_classes(near, 3, 90, 100)
    assert ngram_join.jaccard_classes(df.limit(0)).count() == 0


def test_keep_one_of_each_group(spark, docs, rows):
    kept = ngram_join.keep_one_of_each_group(docs)
    assert kept.columns == docs.columns
    known = [(i, t) for i, t in rows if i is not None]
    want = {i for i, _, c in brute_classes(known, 5, 80, 100) if i == c}
    got = Counter(r.doc_id for r in kept.select("doc_id").collect())
    assert got == Counter(dict.fromkeys([*want, None], 1))


@pytest.mark.parametrize("width", [1, 3, 5])
def test_shingles_of_a_step_of_few_words(width):
    """A step of one text with fewer words than a shingle, or with a few more."""
    for n in range(8):
        text = " ".join(f"w{k}" for k in range(n)).encode()
        (got,) = shingle_sets(np.frombuffer(text, np.uint8), np.array([0, len(text)]), width)
        assert len(got) == (max(1, n - width + 1) if n else 0)
        # the same as in a step with a long text
        more = text + b" ".join(b"v%d" % k for k in range(20))
        assert got.tolist() == shingle_sets(np.frombuffer(more, np.uint8), np.array([0, len(text), len(more)]), width)[0].tolist()


def test_repeated_ids_of_different_texts_stay(spark):
    """No row goes because another row has its id; of a group one row stays, of equal rows one."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a, 1), (2, a, 2), (2, b, 3), (3, c, 4), (4, b + " more", 5), (5, c, 6), (3, c, 7), (3, c, 7), (None, a, 8), (None, "d " * 9, 9), (None, "d " * 9, 10), (6, None, 11), (6, None, 11), (6, " ", 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, dig long")
    got = Counter((r.doc_id, r.text) for r in ngram_join.keep_one_of_each_group(df).collect())
    assert got == Counter({(1, a): 1, (2, b): 1, (3, c): 1, (None, "d " * 9): 1, (6, None): 2, (6, " "): 1})
    # two texts of one id that link two others
    e = " ".join(f"e{k}" for k in range(60))
    rows = [(9, e + " x"), (9, e + " x y"), (10, e), (11, "apart from all")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in ngram_join.jaccard_classes(df, 3, 90, 100).collect()) == [(9, 9), (9, 9), (10, 9), (11, 11)]
    assert [r.doc_id for r in ngram_join.keep_one_of_each_group(df).orderBy("doc_id").collect()] == [9, 11]


def test_jaccard_contraction(spark, monkeypatch):
    """Clusters cut into many groups, some of one component and some of several, and outsiders that link to a few members."""
    monkeypatch.setattr(ngram_join, "GROUP_TOKENS", 600)
    monkeypatch.setattr(ngram_join, "MANY_GROUPS", 1)
    rng, rows = random.Random(12), []
    for c in range(3):
        base = [f"c{c}w{k}" for k in range(60)]
        for _ in range(120):
            w = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 4))):
                w[rng.randrange(60)] = f"x{rng.randrange(200)}"
            rows.append((len(rows), " ".join(w)))
    half = [f"c0w{k}" for k in range(30)]
    rows += [(len(rows) + k, " ".join(half + [f"y{k}z{j % (5 + k)}" for j in range(30)])) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in ngram_join.jaccard_classes(df, 3, 90, 100).collect()} == brute_classes(rows, 3, 90, 100)
    assert {tuple(r) for r in ngram_join.jaccard_classes(df, 5, 80, 100).collect()} == brute_classes(rows, 5, 80, 100)


def test_keep_one_of_a_three_word_table(spark):
    df = spark.createDataFrame([(7, "one two three")], "doc_id long, text string")
    assert [r.doc_id for r in ngram_join.keep_one_of_each_group(df).collect()] == [7]


def test_rows_without_id_link_others(spark):
    base = [f"w{k}" for k in range(60)]
    change = lambda *at: " ".join("x" if k in at else w for k, w in enumerate(base))
    rows = [(7, change()), (None, change(59)), (9, change(59, 0)), (-3, "some other text of words"), (None, "no other text is like it at all"), (None, "a near pair without any id x y z " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    apart = {r.doc_id: r.component_id for r in ngram_join.jaccard_classes(df.where("doc_id is not null"), 3, 96, 100).collect()}
    assert apart == {7: 7, 9: 9, -3: -3}
    got = sorted((r.doc_id is None, r.doc_id, r.component_id) for r in ngram_join.jaccard_classes(df, 3, 96, 100).collect() if r.doc_id is not None)
    assert got == [(False, -3, -3), (False, 7, 7), (False, 9, 7)]
    assert {r.component_id for r in ngram_join.jaccard_classes(df, 3, 96, 100).where("doc_id is null").collect()} == {None}


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(200)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {(r.node, r.component) for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {(x, root(x)) for e in edges if e[0] != e[1] for x in e}


def test_quality(spark, sf1, docs):
    d, labels = spark.read.parquet(f"{sf1}/documents.parquet"), spark.read.parquet(f"{sf1}/labels.parquet")
    got = {r.doc_id: r for r in quality.scored(d, labels).collect()}
    assert len(got) == d.count() and all(r.held_out == held_out_py(i) and r.predicted == int(r.score >= 0.7) for i, r in got.items())
    test = [(got[r.doc_id].score, r.quality) for r in labels.collect() if held_out_py(r.doc_id)]
    good, bad = [s for s, q in test if q == 1], [s for s, q in test if q == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.85
    odd = {r.doc_id: r.score for r in quality.scored(docs, labels).collect()}
    assert all(0 <= s <= 1 for s in odd.values()) and odd[10_000] == odd[10_001]
    none = quality.scored(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.scored(empty(spark), labels).count() == 0


def test_quality_trees_and_walk():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    t = quality.grow(x, y, trees=30)
    for i in range(50):  # the walk, a node at a time
        raw = t.base
        for f, lim, v in zip(t.feature, t.limit, t.value):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(x[i, f[node]] > lim[node])
            raw += v[node - len(f)]
        assert math.isclose(t.scores(x[i : i + 1])[0], 1 / (1 + math.exp(-raw)))
    assert ((t.scores(x) > 0.5) == y).mean() > 0.95


def naive_statistics(t):
    """The statistics of one text, counted one at a time."""
    kinds = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:?'\"-()", b"!", b"|", b"#$%&*@+=~^_/\\<>[]{}`")
    size = len(t)
    share = lambda chars: sum(b in chars for b in t) / max(size, 1)
    shares = [share(k) for k in kinds]
    shares = [1 - sum(shares) if size else 0.0, *shares]
    words = t.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    pairs, lines = list(zip(words, words[1:])), [x for x in re.split(b"(?<=\n)", t) if x]
    most = lambda v: max(Counter(v).values(), default=0)
    some, n = max(len(words), 1), len(lines)
    odd = sum(a in kinds[6] + kinds[7] + kinds[8] and b in b" \n" for a, b in zip(t, t[1:]))
    return [
        math.log1p(size), math.log1p(len(words)), *shares, shares[2] / max(shares[1] + shares[2], 1e-9), (size - shares[4] * size) / some, len(set(words)) / some, most(words) / some,
        len(set(pairs)) / some, most(pairs) / some, math.log1p(n), len(set(lines)) / max(n, 1), most(lines) / max(n, 1), len(words) / max(n, 1), odd / some, sum(b & 0xC0 == 0x80 for b in t) / max(size, 1),
    ]


def test_statistics_against_plain_counts(rows):
    texts = [(t or "").encode() for _, t in rows if len(t or "") < 50_000]
    texts += [b"wow!", b" yes | no\n", b"a # b\na # b\nA # B", b"\n\n", b"x!\n", b"\t! \x0b|", "é é É".encode(), b"w" * 70 + b" " + b"W" * 70]
    off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    whole = quality.statistics(np.frombuffer(b"".join(texts), np.uint8), off)
    for t, got in zip(texts, whole):
        assert np.allclose(got, naive_statistics(t)), t[:60]


def test_growing_against_a_plain_tree():
    """The first split of the first tree is the one of largest gain among all features and cuts."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, (600, 4)).astype(float)
    y = (x[:, 2] + rng.integers(0, 3, 600) > 5).astype(float)
    tree = quality.grow(x, y, trees=1, depth=1)
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))

    def gain(f, cut):
        low = x[:, f] <= cut
        if min(h[low].sum(), h[~low].sum()) < quality.LEAST / 4:
            return -1.0
        return sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (low, ~low))

    best = max((gain(f, c), -f, -c) for f in range(4) for c in np.unique(x[:, f]))
    assert (tree.feature[0, 0], tree.limit[0, 0]) == (-best[1], -best[2])
    for side in (0, 1):
        m = (x[:, tree.feature[0, 0]] > tree.limit[0, 0]) == bool(side)
        assert math.isclose(tree.value[0, side], -quality.RATE * g[m].sum() / (h[m].sum() + 1))


def test_statistics_do_not_depend_on_neighbours(rows):
    texts = [(t or "").encode() for _, t in rows]
    off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    whole = quality.statistics(np.frombuffer(b"".join(texts), np.uint8), off)
    for k, t in enumerate(texts):
        assert np.allclose(whole[k], quality.statistics(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0])


def brute_topk(rows, k=10):
    """From (vec_id, embedding) rows: repeated rows are candidates each, equal queries are one."""
    data = [(i, np.floor(1024 * np.array(x, np.float64)).astype(np.int64)) for i, x in rows if i is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    want, pooled = Counter(), defaultdict(list)
    for q, x in {(i, tuple(v.tolist())) for i, v in data if i % 100 == 0}:
        pooled[q] += [(-int(np.dot(x, v)), i) for i, v in data if i != q and len(v) == len(x)]
    for q, s in pooled.items():
        want.update((q, n + 1, i, -v) for n, (v, i) in enumerate(sorted(s)[:k]))
    return want


def test_topk(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    odd = [(9000, None, 1), (9001, [float("nan")] * 64, 1), (9002, [1.0, None] * 32, 1), (9100, [0.5] * 64, 1), (9100, [0.5] * 64, 1), (9101, [0.5] * 64, 1), (9101, [0.5] * 64, 1), (9101, [0.5] * 64, 1), (None, [0.5] * 64, 1), (9200, [1.0, 2.0], 1), (9201, [3.0, -2.0], 1), (9300, [], 1), (9400, [0.25] * 64, 1), (9400, [-0.25] * 64, 1)]
    v = v.unionByName(spark.createDataFrame(odd, "vec_id long, embedding array<float>, label int")).withColumns({c: F.lit(1) for c in ("rng", "qry", "kth", "dim", "score", "query_id", "weights")})
    want = brute_topk([(r.vec_id, r.embedding) for r in v.collect()])
    got = Counter(map(tuple, topk_search.search(v, v.where("vec_id % 100 = 0")).collect()))
    assert got == want
    assert topk_search.search(v.limit(0), v.limit(0)).count() == 0


def test_topk_prunes_clustered_vectors(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((30, 64))
    x = centres[rng.integers(0, 30, 6000)] + 0.03 * rng.standard_normal((6000, 64))
    rows = [(i, [float(a) for a in r]) for i, r in enumerate(x)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter(map(tuple, topk_search.search(v, v.where("vec_id % 100 = 0")).collect()))
    assert got == brute_topk(rows)
    told = topk_search.search(v, v.where("vec_id % 100 = 0"), report=True).first()
    assert told.blocks >= 60 * 6000 // topk_search.BLOCK and told.opened < told.blocks / 3


def test_topk_blocks_and_ties():
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (1000, 4)).astype(np.float64)
    ids = rng.permutation(1000)
    for start in (-np.inf, 9.0):
        got, opened = topk_search.best_of(x[:40], ids[:40], np.full(40, start), x, ids, 7)
        assert opened < 40 * -(-1000 // topk_search.BLOCK)  # many ties, and yet some blocks stay shut
        by = defaultdict(list)
        for n, i, s in got:
            by[n].append((-s, i))
        for n in range(40):
            want = sorted((-int(x[n] @ x[j]), int(ids[j])) for j in range(1000) if j != n)
            assert sorted(by[n]) == [w for w in want if -w[0] >= start][:7]


def test_sharding(spark, docs, rows):
    out = sharding.shard_documents(docs).collect()
    assert len(out) == len(rows)
    text = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == text
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
        draws = []
        for k in range(17):
            u = (int(hashlib.md5(f"{chr(0) + 'null' if r.doc_id is None else r.doc_id}:{k}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            draws.append(-1 / math.log(u))
        assert r.shard == int(np.argmax(draws[:16])) and r.grown_shard == int(np.argmax(draws))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_documents(empty(spark)).count() == 0
    ids = spark.range(20_000).select(sharding.shard_of(F.col("id"), [3.0, 1.0]).alias("s"))
    assert abs(ids.where("s = 0").count() / 20_000 - 0.75) < 0.02


def test_langid(spark, sf1, docs):
    d = spark.read.parquet(f"{sf1}/documents.parquet")
    out = langid.told(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    test = [r for r in out if r.held_out]
    assert len(out) == d.count() and np.mean([r.lang == r.lang_pred for r in test]) > 0.95
    odd = {r.doc_id: r for r in langid.told(docs).collect()}
    assert all(odd[10_000 + k].lang_pred == "und" and odd[10_000 + k].score == 0 for k in (0, 1, 2, 11))
    assert all(0 <= r.score <= 1 for r in odd.values())
    assert {r.lang_pred for r in langid.told(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.told(empty(spark)).count() == 0


def test_langid_with_few_languages_or_letters(spark):
    """No letters to learn from, one language, and languages of one family."""
    make = lambda rows: spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("x", "draw", "nth", "score")})
    none = make([(t, "en") for t in (None, "", "123", " \n", "!!")] * 4)
    assert {(r.lang_pred, r.score) for r in langid.told(none).collect()} == {("und", 0.0)}
    assert langid.kept(none, langid.train(none), 0.5).count() == 0
    one = make([("some words here", "en"), (None, "en"), ("more of them", "en"), ("x", "en")] * 5)
    assert {(r.lang_pred, r.score) for r in langid.told(one).collect()} == {("en", 1.0), ("und", 0.0)}
    many = make([(f"the house and the dog {k}", "en") for k in range(20)] + [(f"das Haus und der Hund {k}", "de") for k in range(20)])
    assert {(r.lang_pred) for r in langid.told(many).where("doc_id < 20").collect()} == {"en"}
    assert {(r.lang_pred) for r in langid.told(many).where("doc_id >= 20").collect()} == {"de"}
    kept = langid.kept(many, langid.train(many), 0.5)
    assert kept.columns == many.columns and kept.count() == 40


def brute_margin(model, text):
    """Margins of a text from its n-grams, one at a time."""
    data = text.encode()
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in data)
    x = np.zeros(1 << langid.BITS)
    for n in langid.GRAMS:
        for k in range(len(low) - n + 1):
            code = int.from_bytes(low[k : k + n], "big")
            x[((code + (n << 40)) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - langid.BITS)] += langid.SCALE / (len(low) - n + 1)
    return model.weights @ x + model.bias


def test_langid_margins_against_brute_force(spark, sf1):
    model = langid.train(spark.read.parquet(f"{sf1}/documents.parquet"))
    texts = ["Le chat est ici.", "The cat sat", "a", "", "Ünïcode 日本", "x" * 300]
    raw = [t.encode() for t in texts]
    got = model.margins(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
    assert np.allclose(got, [brute_margin(model, t) for t in texts])


def test_langid_scores_a_family_by_its_lead(monkeypatch):
    model = langid.Model([])
    model.langs, model.families, model.pairs = ["en", "fi", "fr"], ["germanic", "romance", "uralic"], []
    monkeypatch.setattr(model, "margins", lambda data, off: np.array([[-0.2, -1.5, -1.4], [-0.5, -0.5, -2.0]]))
    lang, score = model.predict(np.zeros(0, np.uint8), np.array([0, 0, 0]))
    assert lang[0] == "en" and score[0] > 0.9 and score[1] == 0.5
    # with two families the lead is twice the margin, so the score is the margin's
    model.langs, model.families = ["en", "fr"], ["germanic", "romance"]
    monkeypatch.setattr(model, "margins", lambda data, off: np.array([[0.3, -0.3], [-0.1, 0.1]]))
    lang, score = model.predict(np.zeros(0, np.uint8), np.array([0, 0, 0]))
    assert list(lang) == ["en", "fr"] and np.allclose(score, 1 / (1 + np.exp(-langid.SHARP * np.array([0.3, 0.1]))))


def test_near_vectors(spark, sf1, monkeypatch):
    v = spark.read.parquet(f"{sf1}/embeddings.parquet")
    real = v.collect()
    rng = np.random.default_rng(0)
    extra, base = [], rng.standard_normal(64)
    for k in range(300):
        extra.append((20_000 + k, [float(x) for x in np.float32(base + 0.1 * rng.standard_normal(64))], 1))
    extra += [(21_000 + k, extra[0][1], 1) for k in range(40)] + [(22_000, None, 1), (22_001, [0.0] * 64, 1), (22_002, extra[0][1], None), (22_003, [float("inf")] * 64, 1), (22_004, [2 * x for x in extra[0][1]], 1), (22_005, [1.0, 0.0], 1), (22_006, [2.0, 0.0], 1), (22_007, extra[0][1], 2)]
    v = v.unionByName(spark.createDataFrame(extra, "vec_id long, embedding array<float>, label int")).withColumn("rep", F.lit(0))
    data = [(r[0], np.array(r[1], np.float64), r[2]) for r in [*map(tuple, real), *extra] if r[1] is not None and r[2] is not None]
    data = [(i, x / np.linalg.norm(x), lab) for i, x, lab in data if np.isfinite(x).all() and np.abs(x).sum() > 0]
    links, up = Counter(), {i: i for i, _, _ in data}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, x, lab) in enumerate(data):
        for j, y, other in data[:k]:
            if lab == other and len(x) == len(y) and x @ y >= 0.98:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    monkeypatch.setattr(near_vectors, "BLOCK", 100)
    got = {r.vec_id: r for r in near_vectors.near_duplicates(v).collect()}
    assert set(got) == {r[0] for r in real} | {e[0] for e in extra}
    assert all(r.n_links <= links[i] for i, r in got.items())  # none below the threshold
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(links.values())
    assert np.mean([r.component_id == (root(i) if i in up else i) for i, r in got.items()]) > 0.99
    assert all(r.kept == (r.component_id == i) for i, r in got.items())
    # longer signatures, as for labels of a quarter of a million and of sixty million vectors
    tables_for = near_vectors.tables_for
    for largest, bits in ((1 << 18, 20), (1 << 26, 28)):
        monkeypatch.setattr(near_vectors, "tables_for", lambda t, n, r, largest=largest: tables_for(t, largest, r))
        assert tables_for(0.98, largest)[0] == bits
        more = near_vectors.near_duplicates(v).collect()
        assert sum(r.n_links for r in more) >= 0.99 * sum(links.values()) and all(r.n_links <= links[r.vec_id] for r in more)
    assert near_vectors.near_duplicates(v.limit(0)).count() == 0


def canonical(role, text):
    return f"<|{role}|>\n{text}\n"


def test_chat(spark, sf1):
    conv = spark.read.parquet(f"{sf1}/conversations.parquet").withColumns({c: F.lit(1) for c in ("raw", "at", "tie", "block", "share", "nth", "blocks", "best")})
    out = chat.parse(conv).collect()
    assert sum(r.right for r in out) / sum(r.n_lines for r in out) > 0.97
    want = defaultdict(list)
    for r in conv.select("conv_id", "turn", "role", "text").distinct().collect():
        role = r.role if r.role in chat.ROLES else "user"
        want[r.conv_id].append((r.turn, canonical(role, r.text or "")))
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: r.turn_no):
        got[r.conv_id].append(r.rendered)
    assert set(got) == set(want)
    # whole conversations, turn by turn and character by character
    same = [got[c] == [t for _, t in sorted(want[c])] for c in want if len({t for t, _ in want[c]}) == len(want[c])]
    assert np.mean(same) > 0.9


def test_chat_of_odd_rows(spark):
    odd = [(1, None, None, None), (1, 0, "user", "Hi?\nmore"), (1, 1, "bot", ""), (None, 0, "assistant", "x" * 100_000), (1, 0, "user", "Hi?\nmore"), (1, 0, "system", "a tie")]
    got = chat.parse(spark.createDataFrame(odd, "conv_id long, turn long, role string, text string")).collect()
    assert {r.conv_id for r in got} == {1, None}
    assert sum(r.n_lines for r in got if r.conv_id == 1) >= 5
    assert next(r.rendered.count("x") for r in got if r.conv_id is None) == 100_000
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.parse(none).count() == 0


def test_raw_transcripts(spark, sf1):
    """Roles come back from lines alone, and every character of a turn stays."""
    hmm = chat.train(spark.read.parquet(f"{sf1}/conversations.parquet"))
    turns = {
        "a": [("user", "Hello there, how are you?"), ("assistant", "  Well, thanks.\n    indented code\nmore\n"), ("user", "Good."), ("assistant", "User: is a word here")],
        "b": [("system", "Be brief."), ("user", "What is 2 + 2?\n"), ("assistant", "4  ")],
    }
    styles = {"a": 0, "b": 3}
    text = {k: "\n".join(chat.MARKERS[r][styles[k]] + t for r, t in v) for k, v in turns.items()}
    rows = [("a", text["a"], 1), ("a", text["a"], 1), ("a", "[user] another of this id\n[assistant] yes", 2), ("b", text["b"], 3), ("c", None, 4), (None, "BOT> x\n\nand some more", 5), ("long", "\n".join(f"[{('user', 'assistant')[k % 2]}] line {k}\nmore of it\n" for k in range(4000)), 6)]
    out = chat.parse_transcripts(spark.createDataFrame(rows, "conv_id string, text string, turn_no int"), hmm).collect()
    by = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.conv, r.turn_no)):
        by[r.conv_id, r.conv].append(r.rendered)
    found = {tuple(v) for (i, _), v in by.items() if i == "a"}
    assert found == {tuple(canonical(*t) for t in turns["a"]), (canonical("user", "another of this id"), canonical("assistant", "yes"))}
    assert [v for (i, _), v in by.items() if i == "b"] == [[canonical(*t) for t in turns["b"]]]
    assert len([v for (i, _), v in by.items() if i == "c"][0]) == 1
    (none,) = [v for (i, _), v in by.items() if i is None]
    assert "".join(none).startswith("<|assistant|>\nx\n") and "and some more" in "".join(none)
    (long,) = [v for (i, _), v in by.items() if i == "long"]
    assert long == [canonical(("user", "assistant")[k % 2], f"line {k}\nmore of it\n" if k < 3999 else f"line {k}\nmore of it\n") for k in range(4000)]
    assert chat.parse_transcripts(spark.createDataFrame([], "conv_id string, text string"), hmm).count() == 0


def test_chat_blocks_give_the_best_path():
    rng = np.random.default_rng(6)
    for _ in range(30):
        seen = rng.integers(0, 30, (chat.STATES, chat.SYMBOLS)).astype(float)
        hmm = chat.Hmm(rng.integers(0, 9, chat.STATES).astype(float), rng.integers(0, 9, (chat.STATES, chat.STATES)).astype(float), seen)
        obs = rng.integers(0, chat.SYMBOLS, 60)

        def value(path, hmm=hmm, obs=obs):
            return hmm.start[path[0]] + sum(hmm.move[a, b] for a, b in zip(path, path[1:])) + sum(hmm.emit[s, o] for s, o in zip(path, obs))

        # Viterbi by plain dictionaries of whole paths
        best = {s: (hmm.start[s] + hmm.emit[s, obs[0]], [s]) for s in range(chat.STATES)}
        for o in obs[1:]:
            best = {s: max(((v + hmm.move[p, s] + hmm.emit[s, o], [*path, s]) for p, (v, path) in best.items()), key=lambda x: x[0]) for s in best}
        top = max(v for v, _ in best.values())
        assert math.isclose(value(hmm.trace(obs, None, None)), top)
        blocks = [hmm.first_block(obs[:17]), hmm.block(obs[17:40]), hmm.block(obs[40:])]
        score = np.zeros(chat.STATES)
        for b in blocks:
            score = (score[:, None] + b).max(0)
        assert math.isclose(score.max(), top)


def test_long_conversation_in_blocks(spark):
    rng, rows = random.Random(9), []
    for t in range(3000):
        rows.append((7, t, ("user", "assistant")[t % 2], "\n".join("word " * rng.randrange(1, 30) for _ in range(rng.randrange(1, 4)))))
    rows += [(k, *r[1:]) for k in range(8, 12) for r in rows[:40]]  # 7 is held out
    out = chat.parse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("conv_id = 7").orderBy("turn_no").collect()
    assert sum(r.right for r in out) / sum(r.n_lines for r in out) > 0.95
    assert [r.turn_no for r in out] == list(range(1, len(out) + 1))
    # every line of every turn is in the turns, in order
    lines = [x for r in out for x in r.rendered.split("\n")[1:-1] if x.strip()]
    assert lines == [x for r in rows[:3000] for x in r[3].split("\n")]


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = p.quality_stage(spark, docs, sf)
    scores = {r.doc_id: r.score for r in quality.with_scores(docs, quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {i for i, s in scores.items() if s >= p.QUALITY}
    told = {r.doc_id: r for r in langid.identified(good, langid.train(good)).collect()}
    lang = p.language_stage(spark, good, sf)
    assert {r.doc_id for r in lang.collect()} == {i for i, r in told.items() if r.lang_pred != "und" and r.score >= p.LANGUAGE}
    near = p.near_duplicate_stage(spark, lang, sf)
    rows = [(r.doc_id, r.text) for r in lang.collect()]
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i, _, c in brute_classes(rows, 5, 80, 100) if i == c)
    out = p.run(spark, sf).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in near.collect()}


def test_pipeline_stages_on_odd_rows(spark, sf, docs):
    """Null, empty, long and repeated texts, repeated and null ids, clashing columns, and an empty table, in every stage."""
    import corpus_pipeline as p

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    trees = quality.train(docs, labels)
    rows = docs.collect()
    texts = [(r.text or "").encode() for r in rows]
    off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    scores = trees.scores(quality.statistics(np.frombuffer(b"".join(texts), np.uint8), off))
    good = p.quality_stage(spark, docs, sf)
    same = lambda df: Counter(map(tuple, df.collect()))
    assert good.columns == docs.columns and same(good) == Counter(tuple(r) for r, s in zip(rows, scores) if s >= p.QUALITY)
    model = langid.train(docs)
    lang, sure = model.predict(np.frombuffer(b"".join(texts), np.uint8), off)
    told = p.language_stage(spark, docs, sf)
    want = Counter(tuple(r) for r, v, s in zip(rows, lang, sure) if s >= p.LANGUAGE and any(map(str.isalpha, r.text or "")))
    assert told.columns == docs.columns and same(told) == want
    near = p.near_duplicate_stage(spark, docs, sf)
    assert near.columns == docs.columns
    wordless = Counter((r.doc_id, r.text) for r in rows if not (r.text or "").split())
    kept = Counter((r.doc_id, r.text) for r in near.collect())
    assert all(kept[k] == n for k, n in wordless.items()) and all(n == 1 for k, n in kept.items() if k not in wordless)
    packed = p.packing_stage(spark, docs, sf)
    assert Counter(r.doc_id for r in packed.where("start = 0").collect()) == Counter(r.doc_id for r in rows)
    for stage in (p.quality_stage, p.language_stage, p.near_duplicate_stage, p.packing_stage):
        assert stage(spark, docs.limit(0), sf).count() == 0
    nothing = docs.withColumn("text", F.lit(None).cast("string"))
    assert p.language_stage(spark, nothing, sf).count() == 0 and p.near_duplicate_stage(spark, nothing, sf).count() == len(rows)
    assert p.quality_stage(spark, nothing, sf).count() in (0, len(rows))


def test_texts_of_four_megabytes(spark, tk):
    """One very long text among short ones, in the operators that read texts."""
    rng = random.Random(1)
    words = [f"{rng.choice('abcdefgh')}{k % 9973}" for k in range(700_000)]
    long = " ".join(words)
    rows = [(1, "a short text", "en"), (2, long, "en"), (3, long + " end", "de"), (4, "das ist kurz", "de"), (5, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    got = {r.doc_id: r for r in bpe.digests(df).collect()}
    ids = ids_of(tk, long)
    assert got[2].n_tokens == len(ids) and got[2].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and got[2].decoded_sha256 == hashlib.sha256(long.encode()).hexdigest()
    pieces = packing.pack(df).where("doc_id = 2").orderBy("start").collect()
    assert pieces[-1].start + pieces[-1].length == len(ids) + 1 == pieces[0].doc_tokens
    assert {r.doc_id: r.component_id for r in ngram_join.jaccard_classes(df).collect()} == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5}
    edits = edit_counts.apply_edits(edit_counts.standing_edits(df)).where("doc_id = 2").first()
    assert edits.tokens_before == len(ids) and edits.chars_encoded < 1000
    scores = {r.doc_id: r.score for r in quality.with_scores(df, quality.grow(np.zeros((0, 1)), np.zeros(0))).collect()}
    assert set(scores.values()) == {0.5} and len(scores) == 5
    assert {r.doc_id for r in langid.told(df).where("lang_pred <> 'und'").collect()} == {1, 2, 3, 4}


def test_held_out(spark):
    got = spark.range(500).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == held_out_py(r.id) for r in got)
