"""Words that are alike: pairs within two edits, by equi-joins on what such words share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.rows import top_k
from strandlake.session import kept

#: Words of up to so many letters meet by their deletions, longer ones by their pieces.
SHORT_WORD = 24


def _keys(w: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(w, key) of the rests after up to two deletions, of the pieces at all places that edits may move them to, and of the pieces in place."""
    w = w.select("w").where("w <> ''").distinct().withColumn("m", F.length("w"))
    short = w.where(F.col("m") <= SHORT_WORD + 2)
    rests = short.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("m")))).withColumn("j", F.explode(F.sequence("i", "m")))
    rests = rests.selectExpr("w", "xxhash64('rest', substr(w, 1, i - 1) || substr(w, i + 1, j - i - 1) || substr(w, j + 1)) AS key").unionByName(short.selectExpr("w", "xxhash64('rest', w) AS key"))
    ways = [(i, less, s) for i in range(3) for less in range(3) for s in range(-1, 3) if abs(s) + abs(less - s) <= 2]
    at = w.where(F.col("m") > SHORT_WORD).withColumn("x", F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("i", "less", "s"), way)]) for way in ways])))
    at = at.selectExpr("w", "m", "x.i", "x.less", "x.s", "m - x.less AS n").where(F.col("n") > SHORT_WORD).selectExpr("*", "i * n DIV 3 + s AS lo", "(i + 1) * n DIV 3 - i * n DIV 3 AS len")
    at = at.where("lo >= 0 AND lo + len <= m").selectExpr("w", "less", "s", "xxhash64('piece', n, i, substr(w, CAST(lo AS INT) + 1, CAST(len AS INT))) AS key")
    return rests.distinct(), at.select("w", "key").distinct(), at.where("less = 0 AND s = 0").select("w", "key").distinct()


def near_words(w: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """(w, alternate, dist): each word of ``w`` and the different words of ``others`` (of ``w`` itself without it) within two edits.

    Both words of such a pair leave the same rest after up to two deletions each; or
    else one of three pieces of the shorter stands whole in the longer, moved by no
    more than the edits before it. Keys are hashes, and the distance decides. Rests are many
    times the words, so the pairs are kept as a table, and the rests' shuffle goes. Null
    and empty words have none. Any two words of one or two letters are within two edits.
    """
    rests, moved, placed = _keys(w)

    def met(a: DataFrame, b: DataFrame, which: str) -> DataFrame:
        """Words that share a key, as often as they do; the distance is told where they meet, as most such pairs are not near. Sides that are the same table are dealt once."""
        pairs = a.alias("a").join(b.alias("b"), F.col("a.key") == F.col("b.key")).select(F.col("a.w").alias("w"), F.col("b.w").alias("alternate"))
        return pairs.where(which).withColumn("dist", F.levenshtein("w", "alternate", 2).cast("long")).where("dist >= 0")

    if others is None:
        # each pair once, the longer or greater word first, then in both orders
        once = "length(w) > length(alternate) AND length(w) <= length(alternate) + 2 OR length(w) = length(alternate) AND w > alternate"
        near = met(rests, rests, once).unionByName(met(moved, placed, once)).distinct()
        near = kept(near, "near-words")
        orders = F.explode(F.array(F.struct("w", "alternate"), F.struct(F.col("alternate").alias("w"), F.col("w").alias("alternate"))))
        return near.select(orders.alias("x"), "dist").select("x.w", "x.alternate", "dist")
    rests2, moved2, placed2 = _keys(others)
    near_by = "abs(length(w) - length(alternate)) <= 2 AND w <> alternate"
    near = met(rests, rests2, near_by).unionByName(met(moved, placed2, f"{near_by} AND length(w) >= length(alternate)")).unionByName(met(placed, moved2, f"{near_by} AND length(w) < length(alternate)"))
    return kept(near.distinct(), "near-words")


def suggestions(words: DataFrame, known: DataFrame, score, k: int = 3) -> DataFrame:
    """(w, suggestion, score, rank): for each of ``words`` the ``k`` of ``known`` within two edits of best ``score(w, suggestion)``, ties in order of words."""
    scored = near_words(words, known).select("w", F.col("alternate").alias("suggestion"), score(F.col("w"), F.col("alternate")).alias("score"))
    return top_k(scored, ["w"], [F.desc("score"), "suggestion"], k).select("w", "suggestion", "score", "rank")


def checked(words: DataFrame, known: DataFrame) -> DataFrame:
    """(w, there): whether each distinct word is among ``known``; null words are left out."""
    own = words.select("w").where("w is not null").distinct()
    return own.join(known.select("w", F.lit(True).alias("_there")).distinct(), "w", "left").select("w", F.coalesce("_there", F.lit(False)).alias("there"))


def lone_words(own: DataFrame, doc: str) -> DataFrame:
    """(doc, unknown): of how many words each document is the only one; ``own`` has a row (doc, w) for each document and word.

    Rows without a document count the words that at most one has. A word is one row by its least and greatest document, so no set of them is kept.
    """
    known = F.col("_a").isNotNull()
    words = own.groupBy("w").agg(F.min(doc).alias("_a"), F.max(doc).alias("_b"), F.max(F.col(doc).isNull()).alias("_bare")).where("_a = _b or _a is null")
    none = F.lit(None).cast(own.schema[doc].dataType)
    of = F.explode(F.array_compact(F.array(F.when(known, F.struct(F.col("_a").alias("d"))), F.when(F.col("_bare"), F.struct(none.alias("d"))))))
    return words.select(of.alias("_x")).groupBy(F.col("_x.d").alias(doc)).agg(F.count("*").alias("unknown"))
