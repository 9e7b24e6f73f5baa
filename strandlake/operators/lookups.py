"""Lookups between tables, sets of ids, mapping of places, and assignment of hits; all are joins, groupings or windows over compressed rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.intervals import coverage, islands, overlap_join
from strandlake.session import dealt


def with_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key is among the ids."""
    return df.join(ids.select(key), key, "left_semi")


def without_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key is not among the ids; rows without key stay."""
    return df.join(ids.select(key), key, "left_anti")


def updated(df: DataFrame, test: Column, values: dict[str, Column]) -> DataFrame:
    """Rows with new values where the test holds; a test that is null holds not."""
    return df.withColumns({c: F.when(F.coalesce(test, F.lit(False)), v).otherwise(F.col(c)) for c, v in values.items()})


def fetched(rows: DataFrame, row_id: str, table: DataFrame, key: str, column: str, offset: Column, length: Column, out: str) -> DataFrame:
    """A part of another table's cell by row id; null where there is no such row."""
    cells = table.select(F.col(key).alias("_key"), F.col(column).alias("_cell"))
    return rows.join(cells, F.col(row_id) == F.col("_key"), "left").withColumn(out, F.substr("_cell", offset + 1, length)).drop("_key", "_cell")


def versioned(c: Column) -> tuple[Column, Column]:
    """Accession and version (null where there is none) of ``ACC.7``."""
    has = c.rlike(r"\.[0-9]+$")
    return F.when(has, F.regexp_extract(c, r"^(.*)\.[0-9]+$", 1)).otherwise(c), F.when(has, F.regexp_extract(c, r"\.([0-9]+)$", 1).cast("int"))


def matching_ids(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(asked, known) ids (column ``id``) of one accession; an id without version matches all of them, and is matched by all."""

    def parts(df: DataFrame, name: str) -> DataFrame:
        accession, version = versioned(F.col("id"))
        return df.select(F.col("id").alias(name), accession.alias("accession"), version.alias(f"{name}_v")).distinct()

    both = parts(asked, "asked").join(parts(known, "known"), "accession")
    return both.where("asked_v is null or known_v is null or asked_v = known_v").select("asked", "known")


def mapped(features: DataFrame, segments: DataFrame, key: str, width: int) -> DataFrame:
    """Features (key, f, lo, hi, strand) on the coordinates that segments (key, src_lo, src_hi, dst, dst_lo, forward) lead to.

    (f, dst, dst_lo, dst_hi, strand, partial): one row for each segment that a feature meets; ``partial`` where it goes on beyond.
    """
    both = overlap_join(features, segments, key, width, "lo", "hi", "src_lo", "src_hi")
    a, b = F.greatest("lo", "src_lo"), F.least("hi", "src_hi")
    lo = F.when(F.col("forward"), F.col("dst_lo") + a - F.col("src_lo")).otherwise(F.col("dst_lo") + F.col("src_hi") - b)
    strand = F.when(F.col("forward"), F.col("strand")).otherwise(F.translate("strand", "+-", "-+"))
    return both.select("f", "dst", lo.alias("dst_lo"), (lo + b - a).alias("dst_hi"), strand.alias("strand"), ((F.col("lo") < F.col("src_lo")) | (F.col("hi") > F.col("src_hi"))).alias("partial"))


def range_sets(hits: DataFrame, key: str, gap: int, expand: int = 0, width: int | None = None) -> DataFrame:
    """Ranges of each subject that hits (key, lo, hi) cover, stretched by ``expand`` to either side; those at most ``gap`` apart are one. (key, lo, hi, n)"""
    wide = hits.select(key, F.greatest(F.col("lo") - expand, F.lit(0)).alias("lo"), (F.col("hi") + expand).alias("hi"))
    return islands(wide, key, gap=gap, width=width)


def queries_of_ranges(ranges: DataFrame, hits: DataFrame, key: str, query: str, width: int) -> DataFrame:
    """(key, r_lo, query): which queries have hits in each range."""
    r = ranges.select(key, F.col("lo").alias("r_lo"), F.col("hi").alias("r_hi"))
    return overlap_join(r, hits.select(key, query, "lo", "hi"), key, width, "r_lo", "r_hi", "lo", "hi").select(key, "r_lo", query).distinct()


def shared_out(hits: DataFrame, models: DataFrame, key: str, hit: str, model: str, width: int) -> DataFrame:
    """(hit, model, overlap): each hit (lo, hi) goes to the model (m_lo, m_hi) that it shares most places with, ties to the smaller model."""
    met = overlap_join(hits.select(key, hit, "lo", "hi"), models.select(key, model, "m_lo", "m_hi"), key, width, "lo", "hi", "m_lo", "m_hi")
    most = F.max(F.struct((F.least("hi", "m_hi") - F.greatest("lo", "m_lo") + 1).alias("overlap"), (-F.col(model)).alias("m")))
    return met.groupBy(hit).agg(most.alias("x")).select(hit, (-F.col("x.m")).alias(model), F.col("x.overlap").alias("overlap"))


def representatives(items: DataFrame, pairs: DataFrame, item: str, score: str) -> DataFrame:
    """Items that no similar item of better score (or equal score and smaller id) stands for; pairs are (a, b), each once."""
    both = pairs.select(F.col("a").alias(item), F.col("b").alias("_other")).unionByName(pairs.select(F.col("b").alias(item), F.col("a").alias("_other")))
    own, other = items.select(item, F.col(score).alias("_s")), items.select(F.col(item).alias("_other"), F.col(score).alias("_t"))
    beaten = both.join(own, item).join(other, "_other").where((F.col("_t") > F.col("_s")) | ((F.col("_t") == F.col("_s")) & (F.col("_other") < F.col(item))))
    return items.join(beaten.select(item), item, "left_anti")


def shared_blocks(blocks: DataFrame, key: str, row: str, width: int = 1 << 20) -> DataFrame:
    """Stretches (key, lo, hi) that the blocks of all of a key's rows cover; a row's own blocks may overlap. Places meet within ranges of ``width`` first."""
    own = islands(blocks.withColumn("_row", F.struct(key, row)), "_row", width=width).select(F.col(f"_row.{key}").alias(key), "lo", "hi")
    rows = blocks.groupBy(key).agg(F.countDistinct(row).alias("_rows"))
    return coverage(own, key, width=width).join(rows, key).where("depth = _rows").select(key, "lo", "hi")


def merged_on_diagonals(alignments: DataFrame, keys: Sequence[str], gap: int = 0, width: int = 1 << 20) -> DataFrame:
    """Ungapped alignments (keys, q_lo, q_hi, s_lo) of one diagonal that meet, as one: (keys, q_lo, q_hi, s_lo, n). Places meet within ranges of ``width`` first."""
    own = alignments.select(F.struct(*keys, (F.col("s_lo") - F.col("q_lo")).alias("_d")).alias("_k"), F.col("q_lo").alias("lo"), F.col("q_hi").alias("hi"))
    # starts are few of one place, so rows are dealt before they are grouped: a task holds a bounded table, whatever a split of the input has
    found = islands(dealt(own, "_k", "lo", rows=1 << 19), "_k", gap=gap, width=width)
    return found.select(*[F.col(f"_k.{k}").alias(k) for k in keys], F.col("lo").alias("q_lo"), F.col("hi").alias("q_hi"), (F.col("lo") + F.col("_k._d")).alias("s_lo"), "n")


def switch_points(segments: DataFrame, key: str) -> DataFrame:
    """Where one of a key's segments (lo, hi, name) ends and the next begins: (key, before, after, from_place, to_place, gap).

    A switch may lie anywhere between the places; they are apart by ``gap``, which is negative where the segments overlap.
    """
    w = Window.partitionBy(key).orderBy("lo", "hi", "name")
    rows = segments.select(key, F.lag("name").over(w).alias("before"), F.col("name").alias("after"), F.lag("hi").over(w).alias("_hi"), F.col("lo").alias("_lo"))
    gap = F.col("_lo") - F.col("_hi") - 1
    return rows.where("before is not null").select(key, "before", "after", F.least("_hi", "_lo").alias("from_place"), F.greatest("_hi", "_lo").alias("to_place"), gap.alias("gap"))


def neighbours(ids: DataFrame, key: str, width: int = 1 << 20) -> DataFrame:
    """(key, before, after, gap) of distinct ids: the ids next to it, and the first id after it that isn't there.

    Ids meet within ranges of ``width``; only the ranges' first and last ids, a row for each, go through one window.
    """
    rows = ids.select(F.col(key)).where(F.col(key).isNotNull()).distinct().withColumn("_b", F.floor(F.col(key) / width))
    inside = Window.partitionBy("_b").orderBy(key)
    rows = rows.withColumns({"_p": F.lag(key).over(inside), "_n": F.lead(key).over(inside), "_run": F.col(key) - F.row_number().over(inside)})
    runs = rows.groupBy("_b", "_run").agg(F.max(key).alias("_hi"))
    ends = rows.groupBy("_b").agg(F.min(key).alias("_first"), F.max(key).alias("_last"), F.min("_run").alias("_run")).join(runs, ["_b", "_run"])
    whole, start, stop = Window.orderBy("_b"), F.col("_b") * width, (F.col("_b") + 1) * width
    ends = ends.withColumns({"_before": F.lag("_last").over(whole), "_after": F.lead("_first").over(whole), "_next": F.coalesce(F.lead("_b").over(whole) == F.col("_b") + 1, F.lit(False))})
    # the first free place at or after the start of a range; a range that is full hands on to the next
    full = (F.col("_first") == start) & (F.col("_hi") == stop - 1)
    free = F.when(full & F.col("_next"), None).when(full, stop).when(F.col("_first") == start, F.col("_hi") + 1).otherwise(start)
    ends = ends.withColumn("_free", free)
    beyond = F.when(F.col("_next"), F.min("_free").over(whole.rowsBetween(1, Window.unboundedFollowing))).otherwise(stop)
    ends = ends.select("_b", "_before", "_after", beyond.alias("_beyond"))
    rows = rows.join(runs, ["_b", "_run"]).join(ends, "_b")
    gap = F.when(F.col("_hi") == (F.col("_b") + 1) * width - 1, F.col("_beyond")).otherwise(F.col("_hi") + 1)
    return rows.select(key, F.coalesce("_p", "_before").alias("before"), F.coalesce("_n", "_after").alias("after"), gap.alias("gap"))


def bitsets(ids: DataFrame, key: str) -> DataFrame:
    """(bucket, bits): ids of 0 or more as bitmaps, one for each 32768 ids."""
    return ids.groupBy(F.bitmap_bucket_number(key).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("bits"))


def merged_bitsets(*sets: DataFrame) -> DataFrame:
    """Union of the bitmaps of several sets, without unfolding them."""
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def ids_of_bitsets(sets: DataFrame, key: str) -> DataFrame:
    """The ids that bitmaps hold; a byte that is empty makes no rows."""
    size = F.octet_length("bits")
    byte = lambda i: F.conv(F.hex(F.substr("bits", i + 1, F.lit(1))), 16, 10).cast("int")
    held = F.filter(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(i.alias("i"), byte(i).alias("b"))), lambda x: x["b"] != 0)
    rows = sets.select("bucket", F.explode(held).alias("x")).select("bucket", F.col("x.i").alias("i"), F.col("x.b").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    rows = rows.where("(shiftright(b, k) & 1) = 1")
    # bucket n > 0 holds the ids from 32768 (n - 1) + 1 on, bucket 0 id 0
    place = F.col("i") * 8 + F.col("k")
    return rows.select(F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * 32768 + place + 1).otherwise(F.col("bucket") * 32768 - place).cast("long").alias(key))


def count_runs(counts: DataFrame, key: str, n: str, width: int = 1 << 20) -> DataFrame:
    """(first, last, n): stretches of successive ids of one count, merged within ranges of ``width`` ids first, so that a count that most ids share is many tasks."""
    rows = counts.groupBy(key).agg(F.sum(n).alias("_c")).select("_c", F.col(key).alias("lo"), F.col(key).alias("hi"))
    return islands(rows, "_c", gap=1, width=width).select(F.col("lo").alias("first"), F.col("hi").alias("last"), F.col("_c").alias("n"))


def next_jobs(jobs: DataFrame, n: int, preferred: Sequence[str] = (), only_preferred: bool = False) -> DataFrame:
    """The ``n`` pending jobs to give out: those of a preferred affinity first, then by priority and id."""
    first = F.col("affinity").isin(*preferred) if preferred else F.lit(False)
    rows = jobs.where((F.col("state") == "Pending") & (first if only_preferred else F.lit(True)))
    return rows.withColumn("_own", F.coalesce(first, F.lit(False))).orderBy(F.desc("_own"), F.desc("priority"), "job").limit(n).drop("_own")


def count_matrix(hits: DataFrame, query: str, subject: str, subjects: Sequence[str]) -> DataFrame:
    """(query, a column of each subject in lower case, other): hits by query and subject; other subjects, and null, count together."""
    each = [F.count_if(F.col(subject) == s).alias(s.lower()) for s in subjects]
    return hits.groupBy(query).agg(*each, F.count_if(~F.coalesce(F.col(subject).isin(*subjects), F.lit(False))).alias("other"))


def schema_table(df: DataFrame) -> DataFrame:
    """(place, name, type, nullable) of a frame's columns."""
    return df.sparkSession.createDataFrame([(k, f.name, f.dataType.simpleString(), f.nullable) for k, f in enumerate(df.schema.fields)], "place int, name string, type string, nullable boolean")


def key_values(df: DataFrame, modules: dict[str, dict[str, Column]]) -> DataFrame:
    """(module, key, value) of a report whose modules are named aggregates, all of one pass."""
    flat = [(m, k, c) for m, own in modules.items() for k, c in own.items()]
    row = df.agg(*[c.cast("string").alias(f"v{i}") for i, (_, _, c) in enumerate(flat)])
    entries = F.array(*[F.struct(F.lit(m).alias("module"), F.lit(k).alias("key"), F.col(f"v{i}").alias("value")) for i, (m, k, _) in enumerate(flat)])
    return row.select(F.explode(entries).alias("x")).select("x.*")


def id_mapped(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """``df`` with the ids of a column by a mapping (id, to); those without one stay."""
    return df.join(mapping.select(F.col("id").alias(column), F.col("to").alias("_to")), column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def merged_volumes(volumes: Sequence[DataFrame], key: str, merge: dict[str, Column]) -> DataFrame:
    """One row for each key of several volumes, its columns merged by aggregates; volumes are neither sorted nor read in order."""
    out = volumes[0]
    for v in volumes[1:]:
        out = out.unionByName(v)
    return out.groupBy(key).agg(*[c.alias(n) for n, c in merge.items()])


def with_near_words(words: DataFrame, letters: str = "ACGT") -> DataFrame:
    """(word, near): every word of the column ``word`` with itself and the words that differ from it in one letter."""
    w = F.col("word")
    near = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.transform(F.array(*map(F.lit, letters)), lambda x: F.concat(F.substr(w, F.lit(1), i - 1), x, F.substr(w, i + 1))))
    return words.select("word", F.explode(F.array_distinct(F.flatten(near))).alias("near"))


def tagged_reads(kmers: DataFrame, words: DataFrame, read: str, least: int) -> DataFrame:
    """(read, hits): reads of whose words (read, kmer) at least so many are among ``words`` (column near), each place counted."""
    return kmers.join(words.select(F.col("near").alias("kmer")).distinct(), "kmer", "left_semi").groupBy(read).agg(F.count("*").alias("hits")).where(F.col("hits") >= least)
