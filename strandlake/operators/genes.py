"""Genes and transcripts: predictions on both strands, spliced alignments, collapsed alignments and chains of compatible ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import genes as G
from strandlake.functions import splicing as P
from strandlake.functions.seq import cigar_ops, reference_span
from strandlake.operators.search import chains_of
from strandlake.session import ship

_OTHER = str.maketrans("ACGTacgt", "TGCAtgca")


def codon_counts(df: DataFrame, coding: str) -> dict[str, int]:
    """How often each codon stands in the coding sequences of a column, from their starts on; 64 rows reach the driver."""
    c = F.upper(F.col(coding))
    whole = F.transform(F.sequence(F.lit(0), F.floor(F.length(c) / 3).cast("int") - 1), lambda k: F.substring(c, k * 3 + 1, F.lit(3)))
    codons = df.where(F.length(coding) >= 3).select(F.explode(whole).alias("codon")).groupBy("codon").count()
    return {r["codon"]: r["count"] for r in codons.where(F.col("codon").isin(*G.CODONS)).collect()}


def base_shares(df: DataFrame, seq: str) -> dict[str, float]:
    """Shares of T, C, A and G among all bases of a column, each counted once more than seen."""
    n = df.agg(*[F.coalesce(F.sum(F.length(seq) - F.length(F.replace(F.upper(F.col(seq)), F.lit(b)))), F.lit(0)).alias(b) for b in "TCAG"]).first()
    total = sum(n[b] + 1 for b in "TCAG")
    return {b: (n[b] + 1) / total for b in "TCAG"}


def predicted_genes(df: DataFrame, key: str, seq: str, model: G.Model) -> DataFrame:
    """(key, strand, gene, score, exons) of the best parse of each strand; exons (lo, hi) are places from 0 on the given strand, in order.

    Strands are parsed apart, so genes of different strands may overlap. One sequence is one row of one task, in memory
    linear in its length. Null and short sequences have none.
    """
    ship(df.sparkSession)

    def parsed(x: str | None) -> list[dict]:
        out = []
        for strand in "+-" if x else "":
            s = x if strand == "+" else x[::-1].translate(_OTHER)
            for k, (score, exons) in enumerate(G.predicted(s, model)):
                places = exons if strand == "+" else [(len(x) - 1 - b, len(x) - 1 - a) for a, b in reversed(exons)]
                out.append({"strand": strand, "gene": k, "score": score, "exons": [{"lo": a, "hi": b} for a, b in places]})
        return out

    udf = F.pandas_udf(lambda s: s.map(parsed), "array<struct<strand:string,gene:int,score:double,exons:array<struct<lo:int,hi:int>>>>")
    return df.select(key, F.explode(udf(F.col(seq))).alias("g")).select(key, "g.*")


def spliced(query: Column, genome: Column, scheme: P.Scheme = P.Scheme()) -> Column:
    """Struct (score, cigar, exons) of the best spliced alignment of a transcript to a genomic sequence; empty with a null or empty one."""

    def run(q: pd.Series, g: pd.Series) -> pd.DataFrame:
        rows = [P.exons(a or "", b or "", scheme) for a, b in zip(q, g)]
        names = ("q_lo", "q_hi", "g_lo", "g_hi", "same", "sites")
        return pd.DataFrame({"score": [r[0] for r in rows], "cigar": [r[1] for r in rows], "exons": [[dict(zip(names, e)) for e in r[2]] for r in rows]})

    return F.pandas_udf(run, "struct<score:long,cigar:string,exons:array<struct<q_lo:int,q_hi:int,g_lo:int,g_hi:int,same:int,sites:string>>>")(query, genome)


def introns(pos: Column, cigar: Column) -> Column:
    """Array of (lo, hi) of the gaps N of an alignment that begins at ``pos``."""
    zero = F.struct(pos.cast("long").alias("at"), F.array().cast("array<struct<lo:bigint,hi:bigint>>").alias("out"))

    def step(acc: Column, o: Column) -> Column:
        end = acc["at"] + F.when(o["op"].isin("M", "D", "N", "=", "X"), o["n"]).otherwise(0).cast("long")
        gap = F.array(F.struct(acc["at"].alias("lo"), (end - 1).alias("hi")))
        return F.struct(end.alias("at"), F.when(o["op"] == "N", F.concat(acc["out"], gap)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(cigar_ops(cigar), zero, step, lambda acc: acc["out"])


def collapsed(alignments: DataFrame) -> DataFrame:
    """(ref, strand, introns, lo, hi, n): alignments (ref, strand, pos, cigar) of the same introns as one, from the first start to the last end; those without introns are left out.

    Alignments are counted in each task before any shuffle, so that an intron chain that very many share is a few rows.
    """
    a = alignments.select("ref", "strand", introns(F.col("pos"), F.col("cigar")).alias("introns"), F.col("pos").cast("long").alias("lo"), (F.col("pos") + reference_span(F.col("cigar")) - 1).cast("long").alias("hi"))
    return a.where(F.size("introns") > 0).groupBy("ref", "strand", "introns").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n"))


def _agree(a: tuple, b: tuple) -> bool:
    """Whether b goes on from a: it begins no earlier, ends later, meets it, and both have the same introns where they meet."""
    if not (a[0] <= b[0] <= a[1] < b[1]):
        return False
    lo, hi = b[0], a[1]
    there = lambda x: [i for i in x[2] if i[1] >= lo and i[0] <= hi]
    return there(a) == there(b)


def chained_models(models: DataFrame) -> DataFrame:
    """(ref, strand, chain, lo, hi, introns, members, n): chains of ``collapsed`` models each of which goes on from the one before, the best first.

    A chain is worth the alignments of its members. Models meet within loci, stretches that no model leaves, which windows
    tell; a locus is compared whole in one task, in order of place, each model with those before it that reach it.
    """
    ship(models.sparkSession)
    w = Window.partitionBy("ref", "strand").orderBy("lo", "hi")
    ahead = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    loci = models.withColumn("_opens", F.coalesce((F.col("lo") > ahead).cast("int"), F.lit(0)))
    loci = loci.withColumn("locus", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")
    schema = "ref long, strand string, locus long, chain int, lo long, hi long, introns array<struct<lo:bigint,hi:bigint>>, members int, n long".replace("ref long", f"ref {models.schema['ref'].dataType.simpleString()}")

    def done(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["lo", "hi", "n"], kind="stable", ignore_index=True)
        rows = [(r.lo, r.hi, [(i["lo"], i["hi"]) for i in r.introns]) for r in own.itertuples()]
        best, before = own["n"].to_numpy(np.float64).copy(), np.full(len(rows), -1)
        open_: list[int] = []
        for k, r in enumerate(rows):
            open_ = [j for j in open_ if rows[j][1] >= r[0]]
            for j in open_:
                if best[j] + own["n"].iloc[k] > best[k] and _agree(rows[j], r):
                    best[k], before[k] = best[j] + own["n"].iloc[k], j
            open_.append(k)
        chain = chains_of(best, before)
        out = []
        for c in range(chain.max() + 1):
            mine = np.flatnonzero(chain == c)
            every = sorted({i for k in mine for i in rows[k][2]})
            out.append((own["ref"].iloc[0], own["strand"].iloc[0], own["locus"].iloc[0], c, min(rows[k][0] for k in mine), max(rows[k][1] for k in mine), [{"lo": a, "hi": b} for a, b in every], len(mine), int(own["n"].iloc[mine].sum())))
        return pd.DataFrame(out, columns=["ref", "strand", "locus", "chain", "lo", "hi", "introns", "members", "n"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in frames:
            pdf = pdf if rest is None else pd.concat((rest, pdf), ignore_index=True)
            key = pdf[["ref", "strand", "locus"]]
            new = np.flatnonzero(np.concatenate(([True], (key.iloc[1:].to_numpy() != key.iloc[:-1].to_numpy()).any(1))))
            for a, b in zip(new, new[1:]):
                yield done(pdf.iloc[a:b])
            rest = pdf.iloc[new[-1] :].reset_index(drop=True)
        if rest is not None and len(rest):
            yield done(rest)

    ordered = loci.select("ref", "strand", "locus", "lo", "hi", "introns", "n").repartition("ref", "strand", "locus").sortWithinPartitions("ref", "strand", "locus", "lo", "hi")
    return ordered.mapInPandas(run, schema)
