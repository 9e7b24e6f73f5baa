"""Corpus pipeline: quality, language, near duplicates, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import langid, ngram_join, packing, quality
from strandlake.llm.common import table, written

#: Least quality score, and least score of the language told, of documents that stay.
QUALITY, LANGUAGE = 0.5, 0.51


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least QUALITY; trees from the labelled documents among them.

    Null and empty texts are scored by their statistics, all zero. Repeated rows are judged each; a score of just QUALITY
    stays. Columns of any name pass through; without labels all scores are 0.5, and all rows stay.
    """
    return quality.kept(docs, quality.train(docs, table(spark, sf_dir, "labels")), QUALITY)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a score of at least LANGUAGE.

    Null texts, and those without a letter, have no language and go; so does a tie between two families or languages, whose
    score is 0.5. Repeated rows are judged each; columns of any name pass through. With no language to learn from all rows go.
    """
    return langid.kept(docs, langid.train(docs), LANGUAGE)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that 5-word shingles with a Jaccard similarity of 0.8 link, the one of smallest id.

    Texts of fewer words are one shingle; null texts and those without words link with nothing and stay. Rows without
    id come after all others; of one id's different texts the one of smallest hash stays, of equal rows one. Columns of any name pass through.
    """
    return ngram_join.keep_one_of_each_group(docs, width=5, num=80, den=100)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, packed along the Hilbert curve.

    Null texts are empty: the end token alone. Repeated rows, and rows of one key of the curve, are pieces each, in order of
    their ids. Only what the pieces need is read, so columns of any name do no harm; of an empty table there are no pieces.
    """
    return packing.pack(docs, length=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: No stage can be said in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
