"""Session helpers: a local session for tests, and the package on the executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_folders: list[tempfile.TemporaryDirectory] = []


def ship(spark: SparkSession) -> None:
    """Give the executors this package's Python files, once per application.

    They need it wherever a Python function runs and the package is not
    installed on their machines.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    top = Path(__file__).resolve().parent
    _folders.append(tempfile.TemporaryDirectory(prefix="strandlake-py-"))  # goes when the driver ends
    path = os.path.join(_folders[-1].name, f"{top.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as run at once, where its files are cut in fewer; large inputs stay as they are read."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def dealt(df: DataFrame, *keys: str, rows: int = 1 << 16) -> DataFrame:
    """``df`` by key over tasks of about ``rows`` rows, for steps that make many rows of one: a small file is few tasks, whatever comes of it."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), *keys)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; one of its own only where none is named and driver and executors are one process."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="strandlake-", dir="/tmp")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` as one run gives it, kept in the shared folder: all that is drawn from it later agrees, whatever executors are lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Spark's own setting by which a query's shuffle files go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries run within leave no shuffle files; else these stay on disk until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def kept(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder; the shuffles that it took are gone then."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_session(cpus: int = 8, memory: str = "8g") -> SparkSession:
    """A ``local[cpus]`` session as the tests and the benchmark use it."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("strandlake")
        .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )
