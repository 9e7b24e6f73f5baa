"""Reads held as differences from a reference in rows, re-sorted tables with dense ids, and what refers to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import differences as D
from strandlake.functions.seq import reference_span
from strandlake.operators.alignments import chunked_reference
from strandlake.session import settled, ship


def with_window(alignments: DataFrame, refs: DataFrame, span: Column, width: int = 5000) -> DataFrame:
    """``alignments`` (ref, pos from 1, ..) with ``window``: the ``span`` bases of the reference from pos on.

    Up to ``width`` bases are taken from one row of twice as many of the reference, in which the alignment begins. Each longer
    window that alignments share is made once, from rows of ``width`` bases; what is beyond the reference's end isn't in it.
    Alignments of no known reference, or with a null place or one before its start, have a null window.
    """
    a = alignments.withColumns({"_span": span.cast("int"), "pos": F.col("pos").cast("long")})
    short = a.where(F.coalesce("_span", F.lit(0)) <= width).withColumn("_chunk", F.floor((F.col("pos") - 1) / width))
    rows = chunked_reference(refs, width, 2 * width).select("ref", F.col("chunk").cast("long").alias("_chunk"), "bases")
    window = F.substring("bases", (F.col("pos") - F.col("_chunk") * width).cast("int"), F.col("_span")).alias("window")
    short = short.join(rows, ["ref", "_chunk"], "left").select(*alignments.columns, window)
    return short.unionByName(_long_windows(a.where(F.col("_span") > width), refs, width).select(*alignments.columns, "window"))


def _long_windows(a: DataFrame, refs: DataFrame, width: int) -> DataFrame:
    """The step of ``with_window`` for windows of more than ``width`` bases."""
    own = ["ref", "pos", "_span"]
    at, last = F.floor((F.col("pos") - 1) / width), F.floor((F.col("pos") - 2 + F.greatest(F.col("_span"), F.lit(1))) / width)
    places = a.select(*own).where("pos > 0").dropna().distinct().select(*own, F.explode(F.sequence(at, last)).alias("chunk"))
    met = places.join(chunked_reference(refs, width).withColumn("chunk", F.col("chunk").cast("long")), ["ref", "chunk"])
    bases = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "bases"))), lambda x: x["bases"]), "")
    made = met.groupBy(*own).agg(F.min("chunk").alias("_first"), bases.alias("_bases"))
    start = (F.col("pos") - F.col("_first") * width).cast("int")
    made = made.select(*own, F.substring("_bases", start, F.col("_span")).alias("window"))
    return a.join(made, own, "left").drop("_span")


def held_reads(alignments: DataFrame, refs: DataFrame, key: str, width: int = 5000) -> DataFrame:
    """(key, ref, pos, ref_len, held) from alignments (key, ref, pos, cigar, seq); those whose reference isn't known, or with a null, are left out.

    ``ref_len`` is the one of ``held`` by built-ins, so that rows are told by it before differences are. Repeated keys are alignments each. A read of which the reference lacks everything has an empty window.
    """
    ship(alignments.sparkSession)
    a = alignments.select(key, "ref", "pos", "cigar", "seq").dropna()
    w = with_window(a, refs, reference_span(F.col("cigar")), width).where("window is not null")
    return w.select(key, "ref", "pos", reference_span(F.col("cigar")).alias("ref_len"), D.held(F.col("seq"), F.col("cigar"), F.col("window")).alias("held"))


def restored_reads(held: DataFrame, refs: DataFrame, key: str, width: int = 5000) -> DataFrame:
    """(key, ref, pos, seq, cigar, exact_cigar, clipped_cigar, left_clip, right_clip, edit_distance, mismatch_read) from held reads and the reference."""
    ship(held.sparkSession)
    w = with_window(held, refs, F.col("ref_len" if "ref_len" in held.columns else "held.ref_len"), width)
    told = w.select(key, "ref", "pos", D.restored(F.col("held"), F.col("window")).alias("d"))
    return told.select(key, "ref", "pos", "d.*")


def dense_ids(rows: DataFrame, order: Sequence, out: str, start: int = 1) -> DataFrame:
    """``rows`` with ids ``start``, ``start`` + 1, .. in ``order``, which must tell all rows apart.

    Rows are sorted by ranges, and kept so, as ranges may be drawn otherwise by another run. A row's id is its place within
    its partition, plus the rows of all partitions before; only the partitions' counts, one row each, meet in a window.
    Null keys come where ``order`` puts them.
    """
    ordered = settled(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    ordered = ordered.withColumns({"_part": F.shiftright("_id", 33), "_in": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return ordered.join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + F.col("_in") + start).drop("_id", "_part", "_in", "_before")


def resorted(rows: DataFrame, key: str, order: Sequence, keep: Sequence[str] = (), new: str = "new_id") -> tuple[DataFrame, DataFrame]:
    """(the table in its new order with dense ids in place of ``key``, the map (key, new)).

    The map is narrow: the sort carries the key and the columns of ``order`` only, and the table follows by a join.
    """
    names = [c for c in keep if c != key]
    narrow = rows.select(key, *names)
    mapping = dense_ids(narrow, [*order, key], new).select(key, new)
    return rows.join(mapping, key).drop(key).withColumnRenamed(new, key), mapping


def referred(rows: DataFrame, column: str, mapping: DataFrame, key: str, new: str = "new_id") -> DataFrame:
    """``rows`` whose ``column`` names rows of a re-sorted table, by their new ids; ids that the map lacks are null."""
    m = mapping.select(F.col(key).alias(column), F.col(new).alias("_new"))
    return rows.join(m, column, "left").withColumn(column, F.col("_new")).drop("_new")
