"""N-gram Jaccard join by a token-group matrix.

Documents are sets of word shingles. Two documents link when
``den * |A & B| >= num * |A | B|``. Exact links, in five steps:

1. A fixed-size count sketch of all shingles gives every shingle a rarity
   level; (level, hash) is the global order of tokens. Any order is right, a
   rare-first one keeps hot passages out of the prefixes.
2. Equal sets form a class with its smallest document as representative.
   Linked sets share a token in their prefixes of that order, at positions that
   leave room for the overlap needed. Prefixes are longer by one token in
   ``SPARE``, so that linked sets share as many tokens more: long texts that have
   one rare passage in common by chance are told apart by that.
3. Similar representatives are partitioned into groups: all that share their
   most popular prefix token, cut at a bounded number of tokens. Those without a
   token of more than ``POPULAR`` documents are groups of one. Where a token's
   documents had to be cut into many groups, links within them are found first,
   and one document of each local component is compared with those of the
   token's other groups, level by level; groups that so turn out to lie in one
   component form a team, and no member of that component asks it.
4. Rows of the matrix: a group's (or team's) prefix tokens and, for every token
   bin, the largest count among its members. A query goes to a group only if
   enough shared prefix tokens leave room and the sum of bin minima reaches the overlap
   needed; to a team's groups only if the team let it through. Of two groups of one
   whose documents have equally many tokens one asks the other.
5. Inside the group's task the union of all its tokens bounds the overlap
   again; only if the bound holds is the group opened and the query counted
   against every member. A spanning forest of the links found is returned, never
   all pairs of a group. Components are then found over the forests.

Defined results: null and wordless texts are empty sets that link with nothing;
a text of fewer words than a shingle is one shingle; repeated rows are one class;
rows without doc_id take part under no id: they link others, and get a null
component. Several rows of one doc_id with different texts are sets of their own;
each gets the smallest id that it reaches, its own included. Other columns are
ignored. Set elements are 64-bit hashes of words' hashes, classes 128-bit ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.common import Forest, connected_components, mix64, released, rest, shingle_sets, shuffles_dropped, text_steps, written
from strandlake.session import ship

SKETCH_BITS = 20
SLICES = 64
BINS = 64
#: Tokens of a group's members, and of the queries that one task counts against them.
GROUP_TOKENS = 100_000
#: Groups of one token beyond which their links are contracted before any asks; up to here asks are few.
MANY_GROUPS = 4
#: Documents that may share a prefix token before they are grouped by it.
POPULAR = 32
#: Tokens of a document for each of which its prefix has one more than one shared token needs.
SPARE = 50

SETS = "doc_id long, dig long, n_shingles int, class_id binary, tokens array<long>, roomy int, bins binary"


def needed_with(n, m, num: int, den: int):
    """Least overlap of sets of n and m tokens that link."""
    return -(-num * (n + m) // (num + den))


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for _, data, off in text_steps(batch):
                h = np.concatenate(shingle_sets(data, off, width))
                counts += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
        parts = counts.reshape(SLICES, -1)
        at = [k for k in range(SLICES) if parts[k].any()]
        yield pa.RecordBatch.from_pydict({"slice": pa.array(at, pa.int32()), "counts": pa.array([parts[k].astype(np.int64).tobytes() for k in at], pa.binary())})

    return run


def _levels(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    for pdf in frames:
        for k, raw in zip(pdf["slice"].tolist(), pdf["counts"]):
            c = np.frombuffer(raw, np.int64)
            total[k] = total[k] + c if k in total else c
    yield pd.DataFrame({"slice": list(total), "levels": [np.floor(2 * np.log2(np.maximum(c, 1))).astype(np.uint8).tobytes() for c in total.values()]})


def token_levels(docs: DataFrame, width: int) -> np.ndarray:
    """Rarity level of each of 2^SKETCH_BITS token bins over all documents: a fixed 1 MB, whatever the corpus."""
    rows = docs.select("text").mapInArrow(_sketch(width), "slice int, counts binary").repartition(SLICES, "slice").mapInPandas(_levels, "slice int, levels binary")
    with shuffles_dropped(docs.sparkSession):
        rows = rows.collect()
    out = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.uint8)
    for r in rows:
        out[r["slice"]] = np.frombuffer(r["levels"], np.uint8)
    return out.ravel()


def _class_id(s: np.ndarray) -> bytes:
    """128-bit fingerprint of a token set."""
    a, b = mix64(s ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64), mix64(s + np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64)
    return np.array([a, b], np.uint64).tobytes()


def _prefixes(width: int, num: int, den: int, levels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(levels.value, np.uint8).astype(np.uint64)
        for batch in batches:
            for part, data, off in text_steps(batch):
                rows: dict[str, list] = {"n_shingles": [], "class_id": [], "tokens": [], "roomy": [], "bins": []}
                for s in shingle_sets(data, off, width):
                    n = len(s)
                    ranked = np.sort(level[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] << np.uint64(56) | (mix64(s) >> np.uint64(8)))
                    take = n - -(-num * n // den) + 1 + n // SPARE if n else 0
                    rows["n_shingles"].append(n)
                    rows["class_id"].append(_class_id(s))
                    rows["tokens"].append(ranked[:take].view(np.int64))
                    # positions at which a set of at least this size may share its first tokens with this one
                    rows["roomy"].append(n - needed_with(n, n, num, den) + 1 + n // SPARE if n else 0)
                    bins = np.minimum(np.bincount((s & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS), 65535)
                    rows["bins"].append(bins.astype(np.uint16).tobytes())
                kinds = (pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(pa.array(v, k) for v, k in zip(rows.values(), kinds))],
                    names=["doc_id", "dig", *rows],
                )

    return run


def _near(num: int, den: int):
    """Whether the sum of bin minima reaches the overlap that a query and a member of at least least_n tokens need."""

    @F.pandas_udf(T.BooleanType())
    def near(query: pd.Series, group: pd.Series, n: pd.Series, least_n: pd.Series) -> pd.Series:
        if not len(query):
            return pd.Series([], dtype=bool)
        q, g = (np.frombuffer(b"".join(x), np.uint16).reshape(-1, BINS) for x in (query, group))
        most = np.minimum(q, g).sum(1, dtype=np.int64)
        n = n.to_numpy(np.int64)
        least = np.maximum(least_n.to_numpy(np.int64), -(-num * n // den))
        # counts of 65535 are capped, so they prune nothing
        return pd.Series((most >= needed_with(n, least, num, den)) | (q == 65535).any(1))

    return near


@F.pandas_udf(T.BinaryType())
def _most_bins(bins: pd.Series) -> bytes:
    out = np.zeros(BINS, np.uint16)
    for raw in bins:
        np.maximum(out, np.frombuffer(raw, np.uint16), out=out)
    return out.tobytes()


def _bits_of(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each key in a bitmap of so many bits, a power of two."""
    a = mix64(keys)
    return (a & np.uint64(size - 1)).astype(np.int64), (mix64(a + np.uint64(1)) & np.uint64(size - 1)).astype(np.int64)


def _bitmap(keys: DataFrame, n: int) -> bytes:
    """Bloom filter of the column ``key`` (long) or ``class_id``; 16 bits a key, and 16 MB at most whatever the corpus."""
    size = 1 << min(27, max(16, (16 * max(n, 1) - 1).bit_length()))
    by_class = "class_id" in keys.columns

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = [np.zeros(0, np.int64)]
        for pdf in frames:
            key = np.frombuffer(b"".join(pdf["class_id"]), np.uint64)[::2] if by_class else pdf["key"].to_numpy(np.int64).view(np.uint64)
            at.append(np.unique(np.concatenate(_bits_of(key, size))))
        at = np.unique(np.concatenate(at))
        part = at // (1 << 16)
        for k in np.unique(part).tolist():
            bits = np.zeros(1 << 16, bool)
            bits[at[part == k] % (1 << 16)] = True
            yield pd.DataFrame({"part": [k], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in frames:
            for k, raw in zip(pdf["part"].tolist(), pdf["bits"]):
                bits = np.frombuffer(raw, np.uint8)
                total[k] = total[k] | bits if k in total else bits
        yield pd.DataFrame({"part": list(total), "bits": [b.tobytes() for b in total.values()]})

    marked = keys.mapInPandas(mark, "part int, bits binary")
    out = np.zeros((size >> 16, 1 << 13), np.uint8)
    merged = marked.repartition(max(1, min(64, size >> 16)), "part").mapInPandas(merge, "part int, bits binary")
    with shuffles_dropped(keys.sparkSession):
        rows = merged.collect()
    for r in rows:
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def _held(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    a, b = _bits_of(keys, 8 * len(bits))
    return (bits[a >> 3] >> (a & 7).astype(np.uint8) & bits[b >> 3] >> (b & 7).astype(np.uint8) & 1).astype(bool)


def _entries(seen):
    """Prefix tokens, with their positions, that another document may have too."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.frombuffer(seen.value, np.uint8)
        for pdf in frames:
            sizes = pdf["tokens"].map(len).to_numpy(np.int64)
            if not len(sizes):
                continue
            token = np.concatenate(pdf["tokens"].tolist()).astype(np.int64)
            row = np.repeat(np.arange(len(pdf)), sizes)
            pos = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = _held(bits, token.view(np.uint64))
            row, pos, token = row[keep], pos[keep], token[keep]
            yield pd.DataFrame({"rep": pdf["rep"].to_numpy()[row], "n": pdf["n"].to_numpy()[row], "roomy": pdf["roomy"].to_numpy()[row], "pos": pos.astype(np.int32), "token": token})

    return run


def _chosen(width: int, bloom):
    """(class_id, tokens) of the documents that some group needs, by a Bloom filter; its false hits go in the join that follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = np.frombuffer(bloom.value, np.uint8), set()
        for batch in batches:
            for _, data, off in text_steps(batch):
                ids, sets = [], []
                all_sets = [s for s in shingle_sets(data, off, width) if len(s)]
                keys = [_class_id(s) for s in all_sets]
                hits = _held(bits, np.frombuffer(b"".join(keys), np.uint64)[::2]) if keys else ()
                for s, key, hit in zip(all_sets, keys, hits):
                    if hit and key not in seen:
                        ids.append(key)
                        sets.append(s.tobytes())
                        if len(seen) < 100_000:  # repeats within a partition are the same set
                            seen.add(key)
                if ids:
                    yield pa.RecordBatch.from_pydict({"class_id": pa.array(ids, pa.binary()), "set": pa.array(sets, pa.binary())})

    return run


def _opened(num: int, den: int):
    """Links of one group: members against each other, and queries whose bound opens it against its members; a forest of them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rest()
        pdf = pdf.sort_values(["query", "rep"], ignore_index=True)
        sets = [np.frombuffer(x, np.uint64) for x in pdf["set"]]
        m = int((~pdf["query"]).sum())
        sizes = np.array([len(s) for s in sets])
        if not m:
            return pd.DataFrame({"src": [], "dst": []}, dtype="int64")
        union, at = np.unique(np.concatenate(sets[:m]), return_inverse=True)
        order = np.argsort(at, kind="stable")
        owner = np.repeat(np.arange(m), sizes[:m])[order]
        start = np.searchsorted(at[order], np.arange(len(union) + 1))
        forest, reps, src, dst = Forest(len(sets)), pdf["rep"].tolist(), [], []
        for i, s in enumerate(sets):
            k = np.searchsorted(union, s)
            k[k == len(union)] = 0
            k = k[union[k] == s]
            if len(k) < -(-num * sizes[i] // den):
                continue  # even all of the group's tokens are too few
            lens = start[k + 1] - start[k]
            pick = np.repeat(start[k] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(lens.sum())
            both = np.bincount(owner[pick], minlength=m)
            linked = np.flatnonzero((den * both >= num * (sizes[i] + sizes[:m] - both)) & (both > 0))
            for j in linked.tolist():
                if j < i and forest.join(i, j):
                    src.append(reps[i])
                    dst.append(reps[j])
        return pd.DataFrame({"src": np.array(src, np.int64), "dst": np.array(dst, np.int64)})

    return run


def _stars(num: int, den: int):
    """For each member of a group: the first member of its local component (``dst``), or, for that one, its set."""
    opened = _opened(num, den)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", ignore_index=True)
        found = opened(pdf.assign(query=False))
        reps = pdf["rep"].tolist()
        at, forest = {r: k for k, r in enumerate(reps)}, Forest(len(reps))
        for a, b in zip(found["src"].tolist(), found["dst"].tolist()):
            forest.join(at[a], at[b])
        root = np.array([forest.root(k) for k in range(len(reps))], np.int64)
        first = root == np.arange(len(reps))
        dst = pd.Series(pdf["rep"].to_numpy()[root]).where(~first).astype("Int64")
        return pd.DataFrame({"rep": pdf["rep"], "dst": dst, "home": pdf["home"], "n": pdf["n"], "set": pdf["set"].where(first, None)})

    return run


def _group(w: Column, level: int) -> Column:
    return F.concat_ws("-", F.lit("" if not level else f"{level}"), "home", F.pmod(F.xxhash64("rep", F.lit(level)), F.ceil(w / GROUP_TOKENS)))


def _needed_sets(docs: DataFrame, wanted: DataFrame, width: int) -> tuple[DataFrame, Broadcast]:
    """(class_id, set) of the classes of ``wanted`` (and by chance some more), and the broadcast that it needs."""
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted.select("class_id"), wanted.count()))
    chosen = docs.select("text").mapInArrow(_chosen(width, bits), "class_id binary, set binary")
    return chosen.groupBy("class_id").agg(F.first("set").alias("set")), bits


def _contracted(docs: DataFrame, cut: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Links among the members (rep, class_id, home, n, grp) of tokens with several groups, and (rep, component) from them.

    Each level compares within groups, keeps one member of each local component,
    and deals those of a token out anew; a token stays while that halves them.
    """
    sets, bits = _needed_sets(docs, cut, width)
    level, edges, k = cut.join(sets, "class_id").select("rep", "home", "n", "grp", "set"), [], 0
    sizes = cut.groupBy("home").agg(F.count("*").alias("before"), F.countDistinct("grp").alias("groups"))
    while True:
        stars = level.groupBy("grp").applyInPandas(_stars(num, den), "rep long, dst long, home long, n int, set binary")
        stars = written(stars, "join-stars")
        if not k:
            bits.destroy()
        edges.append(stars)
        rest = stars.where("dst is null")
        left = rest.groupBy("home").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
        more = left.join(sizes, "home").where("groups > 1 and c > 1 and c <= before / 2")
        more = written(more.select("home", "w", F.col("c").alias("before"), F.ceil(F.col("w") / GROUP_TOKENS).alias("groups")), "join-more")
        if more.isEmpty():
            break
        k += 1
        sizes = more
        level = rest.join(more.select("home", "w"), "home").select("rep", "home", "n", _group(F.col("w"), k).alias("grp"), "set")
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    out = written(out.where("dst is not null").select(F.col("rep").alias("src"), "dst"), "join-near")
    released(*edges)
    return out, written(connected_components(out).withColumnRenamed("node", "rep"), "join-near-components")


def _classified(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(doc_id, dig, n_shingles, component, kept, class_rows) of every row: ``dig`` is a hash of its text, ``kept`` tells the first row of its component."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("dig"), "text")
    levels = spark.sparkContext.broadcast(token_levels(docs, width).tobytes())
    sets = written(docs.mapInArrow(_prefixes(width, num, den, levels), SETS), "join-sets")
    levels.destroy()
    some = sets.where("n_shingles > 0")
    # a class that only rows without doc_id hold is represented by a negative number made from its fingerprint
    made = F.expr("xxhash64(class_id) | shiftleft(-1L, 63)")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "dig")  # rows without id come last
    classes = some.groupBy("class_id").agg(F.min("doc_id").alias("least"), F.min(row).alias("first"), F.count("*").alias("class_rows"))
    classes = written(classes.select("class_id", F.coalesce("least", made).alias("rep"), "least", "first", "class_rows"), "join-classes")
    first = some.select("class_id", F.coalesce("doc_id", made).alias("rep"), "n_shingles", "tokens", "roomy", "bins")
    # an id's rows of one set count once
    reps = first.join(classes.select("class_id", "rep"), ["class_id", "rep"]).groupBy("class_id", "rep").agg(*[F.first(c).alias(c) for c in ("n_shingles", "tokens", "roomy", "bins")])
    # an id whose rows are different sets is told apart by numbers made from their fingerprints
    reps = written(reps, "join-reps")
    shared_ids = written(reps.groupBy("rep").agg(F.count("*").alias("c")).where("c > 1").select("rep"), "join-shared-ids")
    if not shared_ids.isEmpty():
        named = F.when(F.col("c").isNotNull(), made).otherwise(F.col("rep")).alias("rep")
        several = shared_ids.withColumn("c", F.lit(1))
        renamed = [df.join(several, "rep", "left").select(named, *[c for c in df.columns if c != "rep"]) for df in (classes, reps)]
        classes, reps = written(renamed[0], "join-classes"), written(renamed[1], "join-reps")

    counts = written(reps.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "join-df")
    seen = spark.sparkContext.broadcast(_bitmap(counts.select(F.col("token").alias("key")), counts.count()))
    entries = reps.select("rep", F.col("n_shingles").alias("n"), "roomy", "tokens").mapInPandas(_entries(seen), "rep long, n int, roomy int, pos int, token long")
    shared = written(entries.join(counts, "token"), "join-shared")
    seen.destroy()
    released(counts)
    # the partition: a representative with popular prefix tokens joins the others of the most popular; any other is a group of its own
    home = shared.groupBy("rep").agg(F.max(F.when(F.col("df") > POPULAR, F.struct("df", "token"))).alias("top"), F.first("n").alias("n"))
    home = home.select("rep", "n", F.col("top.token").alias("home"))
    weight = written(home.where("home is not null").groupBy("home").agg(F.sum("n").alias("w")), "join-weight")
    grp = F.when(F.col("w").isNull(), F.concat(F.lit("="), F.col("rep").cast("string"))).otherwise(_group(F.col("w"), 0))
    home = written(home.join(weight, "home", "left").select("rep", "n", "home", grp.alias("grp"), F.coalesce(F.col("w") > MANY_GROUPS * GROUP_TOKENS, F.lit(False)).alias("cut")), "join-groups")
    near, teams = None, home.select("rep", "n", "grp", "cut", F.col("grp").alias("team"), F.lit(None).cast("string").alias("own"))
    if not weight.where(F.col("w") > MANY_GROUPS * GROUP_TOKENS).isEmpty():
        cut = written(home.where("cut").join(reps.select("rep", "class_id"), "rep"), "join-cut")
        near, parent = _contracted(docs, cut, width, num, den)
        own = home.where("cut").join(parent, "rep", "left").withColumn("own", F.concat(F.lit("c"), F.coalesce("component", "rep").cast("string")))
        team = own.groupBy("grp").agg(F.min("own").alias("a"), F.max("own").alias("b")).select("grp", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("grp")).alias("team"))
        own = own.join(team, "grp").select("rep", "n", "grp", "cut", "team", "own")
        teams = written(own.unionByName(teams.where("not cut")), "join-teams")
    # rows of the matrix, and the queries that they let through
    tagged = written(shared.join(teams.select("rep", "team", "own"), "rep"), "join-tagged")
    released(shared)
    matrix = tagged.where("pos < roomy").groupBy("token", "team").agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"))
    least = f"cast(ceil(n * {num} / {den}) as int)"
    # a linked set of m tokens, {least} <= m <= n, shares its first tokens with the query: one, and one for each SPARE of the {least}
    spare = f"{least} div {SPARE}"
    room = f"n - pos + {spare} >= ceil({num} * (n + greatest(least_n, {least})) / {num + den}) and n >= least_n and most_n * {den} >= n * {num}"
    once = "(n > least_n or team < from or from not like '=%' or team not like '=%')"
    asks = (
        tagged.select("token", "rep", "n", "pos", F.col("team").alias("from"), "own").join(matrix, "token").where(f"team <> from and (own is null or team <> own) and {room} and {once}")
        .groupBy("rep", "team").agg(F.max("n").alias("n"), F.min("least_n").alias("least_n"), F.count("*").alias("hits")).where(f"hits > {spare}").drop("hits")
    )
    lean = reps.select("rep", "bins")
    bins = written(teams.join(lean, "rep").groupBy("grp", "team").agg(_most_bins("bins").alias("most")), "join-bins")
    near_to = _near(num, den)
    if near is None:
        asks = asks.join(lean, "rep").join(bins, "team").where(near_to("bins", "most", "n", "least_n")).select("rep", "grp")
    else:
        of_team = bins.groupBy("team").agg(_most_bins("most").alias("most"))
        asks = written(asks.join(lean, "rep").join(of_team, "team").where(near_to("bins", "most", "n", "least_n")).select("rep", "team", "n", "least_n", "bins"), "join-asks")
        asks = asks.join(bins, "team").where(near_to("bins", "most", "n", "least_n")).select("rep", "grp")
    asks = written(asks, "join-open")
    released(tagged)

    asked = asks.groupBy("grp").agg(F.count("*").alias("asked"))
    members = teams.groupBy("grp").agg(F.count("*").alias("members"), F.first("cut").alias("cut"))
    busy = members.join(asked, "grp", "left").where("members > 1 and not cut or asked > 0")
    busy = written(busy.select("grp", F.greatest(F.lit(1), F.ceil(F.coalesce("asked", F.lit(0)) / 512)).cast("int").alias("turns")), "join-busy")
    roles = teams.join(busy, "grp").select("rep", "grp", F.lit(False).alias("query"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"))
    roles = roles.unionByName(
        asks.join(busy, "grp").select("rep", "grp", F.lit(True).alias("query"), F.pmod(F.xxhash64("rep"), "turns").cast("int").alias("turn"))
    )
    roles = written(roles.join(reps.select("rep", "class_id"), "rep"), "join-roles")
    released(reps, bins, busy)
    chosen, bits = _needed_sets(docs, roles, width)
    edges = (
        roles.join(chosen, "class_id").select("grp", "turn", "query", "rep", "set")
        .groupBy("grp", "turn").applyInPandas(_opened(num, den), "src long, dst long")
    )
    edges = written(edges if near is None else edges.unionByName(near), "join-edges")
    bits.destroy()
    released(roles)
    # made numbers link, but the smallest id is one of those given
    parent = connected_components(edges).withColumnRenamed("node", "rep").join(classes.select("rep", "least", "first"), "rep")
    parent = written(parent.select("rep", "component", "least", "first"), "join-parent")
    whole = written(parent.groupBy("component").agg(F.min("least").alias("named"), F.min("first").alias("kept")), "join-whole")
    parent = parent.join(whole, "component").select("rep", "named", "kept", F.lit(True).alias("linked"))
    alone = F.col("linked").isNull()
    classes = classes.join(parent, "rep", "left").select(
        "class_id", "class_rows", F.when(alone, F.col("least")).otherwise(F.col("named")).alias("component"), F.when(alone, F.col("first")).otherwise(F.col("kept")).alias("kept")
    )
    classes = written(classes, "join-components")
    return sets.select("doc_id", "dig", "n_shingles", "class_id").join(classes, "class_id", "left").select(
        "doc_id", "dig", F.col("n_shingles").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        (F.col("kept").isNull() | (row == F.col("kept")) | ((F.col("dig") == F.col("kept.dig")) & F.col("doc_id").isNull() & F.col("kept.none"))).alias("kept"), F.coalesce("class_rows", F.lit(1)).alias("class_rows"),
    )


def jaccard_classes(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text)."""
    return _classified(docs, width, num, den).select("doc_id", "n_shingles", "component_id")


def keep_one_of_each_group(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each group of linked texts.

    That is the row of smallest doc_id (rows without one come last); of several
    rows of that id in the group the one whose text has the smallest hash, and of
    equal texts the row whose columns have. Rows without words, and rows of one id
    that are in different groups, all stay.
    """
    rows = _classified(docs, width, num, den).where("not kept or class_rows > 1").select("doc_id", "dig", "kept")
    rows = written(rows, "join-drop")
    dropped = rows.where("not kept").select("doc_id", "dig").distinct()
    again = written(rows.where("kept").groupBy("doc_id", "dig").count().where("count > 1").select("doc_id", "dig"), "join-again")
    keys = written(dropped.unionByName(again).select(F.xxhash64("doc_id", "dig").alias("key")), "join-keys")
    own = docs.withColumns({"_own_id": F.col("doc_id").cast("long"), "_own_dig": F.xxhash64(F.coalesce("text", F.lit("")))})
    # rows that a Bloom filter of the keys lets through are settled by joins; all others stay where they are
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(keys, keys.count()))

    @F.pandas_udf(T.BooleanType())
    def touched(key: pd.Series) -> pd.Series:
        return pd.Series(_held(np.frombuffer(bits.value, np.uint8), key.to_numpy(np.int64).view(np.uint64)))

    own = own.withColumn("_touched", touched(F.xxhash64("_own_id", "_own_dig")))

    def joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        right = right.select(F.col("doc_id").alias("_id"), F.col("dig").alias("_dig"))
        return left.join(right, left["_own_id"].eqNullSafe(right["_id"]) & (left["_own_dig"] == right["_dig"]), how)

    kept = joined(own.where("_touched"), dropped, "left_anti")
    if not again.isEmpty():
        nth = F.row_number().over(Window.partitionBy("_own_id", "_own_dig").orderBy(F.xxhash64(*docs.columns)))
        one = joined(kept, again, "left_semi").withColumn("_nth", nth).where("_nth = 1").drop("_nth")
        kept = joined(kept, again, "left_anti").unionByName(one)
    return own.where("not _touched").unionByName(kept).drop("_own_id", "_own_dig", "_touched")
