"""A store of what files hold, brought up to date from the files that have changed.

Three kinds of tables in one folder: ``rows/batch=t``, what the files read by one update held, with each row's file;
``files/batch=t``, the files that are live after it, their size and time, and the batch that read each; and
``done/version=n``, one row that names the update's batch, written last. An update lists the files, reads only new and
changed ones, adds its tables under a name of its own, and rewrites nothing: rows of files that have changed or vanished are left
out because no live file names their batch. Readers take the newest version that is done, so they see an update all at
once or not at all; what one that failed has left is never named. Of two updates at a time the later ends with an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.session import settled

FILES = "path string, size long, modified timestamp, batch string"


def listed(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, size, modified) of the files of a folder, of all depths; their contents aren't read. Files of no byte aren't listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


@dataclass(frozen=True)
class Update:
    """What an update did: its version, and how many files were new, changed, withdrawn and left alone."""

    version: int
    new: int
    changed: int
    withdrawn: int
    same: int


class Store:
    """The store in a folder; ``read`` makes rows of files: (spark, paths) -> DataFrame with a column ``path``."""

    def __init__(self, spark: SparkSession, root: str, read: Callable[[SparkSession, Sequence[str]], DataFrame]):
        self.spark, self.root, self.read = spark, root.rstrip("/"), read

    def _table(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def _done(self, version: int | None) -> tuple[int, str | None]:
        done = self._table("done")
        if done is None:
            return 0, None
        r = (done if version is None else done.where(F.col("version") == version)).orderBy(F.desc("version")).first()
        return (r["version"], r["batch"]) if r else (0, None)

    def version(self) -> int:
        """The newest version that is done; 0 where there is none."""
        return self._done(None)[0]

    def files(self, version: int | None = None) -> DataFrame:
        """The live files of a version, the newest unless told; (path, size, modified, batch)."""
        _, batch = self._done(version)
        if batch is None:
            return self.spark.createDataFrame([], FILES)
        return self.spark.read.schema(FILES).parquet(f"{self.root}/files/of={batch}")

    def rows(self, version: int | None = None) -> DataFrame:
        """What the live files of a version hold; an error where the store has never had a row."""
        live = self.files(version).select("path", "batch")
        return self._table("rows").withColumn("batch", F.col("batch").cast("string")).join(live, ["path", "batch"], "left_semi").drop("batch")

    def update(self, folder: str, pattern: str = "*", most: int = 100_000) -> Update:
        """Bring the store up to date with a folder. A file whose size or time differs has changed; ``most`` new or changed files are read in one update, the earliest first, the others by the next ones."""
        version = self.version()
        old = self.files(version)
        now = listed(self.spark, folder, pattern)
        both = now.join(old.select("path", F.col("size").alias("_size"), F.col("modified").alias("_modified"), "batch"), "path", "full_outer")
        kind = (
            F.when(F.col("size").isNull(), "withdrawn").when(F.col("batch").isNull(), "new")
            .when((F.col("size") == F.col("_size")) & (F.col("modified") == F.col("_modified")), "same").otherwise("changed")
        )
        told = settled(both.select("path", "size", "modified", "batch", kind.alias("kind")))  # the folder may change meanwhile
        read = [r for r in told.where("kind in ('new', 'changed')").orderBy("modified", "path").limit(most).collect()]
        counts = {r["kind"]: r["count"] for r in told.groupBy("kind").count().collect()}
        batch, paths = f"b{uuid.uuid4().hex}", [r["path"] for r in read]
        if paths:
            self.read(self.spark, paths).write.parquet(f"{self.root}/rows/batch={batch}")
        fresh = self.spark.createDataFrame([(r["path"], r["size"], r["modified"], batch) for r in read], FILES)
        # files that wait for a later update stay as they were read last, and new ones out
        live = old.join(told.where("kind <> 'withdrawn'").select("path"), "path", "left_semi").join(fresh.select("path"), "path", "left_anti").unionByName(fresh)
        live.write.parquet(f"{self.root}/files/of={batch}")
        self.spark.range(1).select(F.lit(batch).alias("batch"), F.current_timestamp().alias("at")).write.mode("error").parquet(f"{self.root}/done/version={version + 1}")
        return Update(version + 1, *(counts.get(k, 0) for k in ("new", "changed", "withdrawn", "same")))


def lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, line) of text files, for a store of lines."""
    return spark.read.text(list(paths)).select(file_of_row().alias("path"), F.col("value").alias("line"))


def file_of_row():
    """The file that a row was read from, as ``listed`` names it."""
    whole = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(whole, "^([a-z]+):///", "$1:/")
