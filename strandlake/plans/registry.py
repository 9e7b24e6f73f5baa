"""Versioned transforms, functions run on write, and edits that are committed or rolled back."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

Transform = Callable[..., Column]


class Registry:
    """Transforms by name and version. A request ``name #major.minor`` gets the newest of that major version, not older than the minor asked for."""

    def __init__(self):
        self._known: dict[str, dict[tuple[int, int], Transform]] = {}

    @staticmethod
    def _parts(spec: str) -> tuple[str, tuple[int, int] | None]:
        m = re.fullmatch(r"\s*([A-Za-z_][\w:]*)\s*(?:#\s*(\d+)(?:\.(\d+))?\s*)?", spec)
        if m is None:
            raise ValueError(f"bad transform name: {spec!r}")
        return m[1], None if m[2] is None else (int(m[2]), int(m[3] or 0))

    def add(self, spec: str, f: Transform) -> None:
        name, version = self._parts(spec)
        versions = self._known.setdefault(name, {})
        if (version or (1, 0)) in versions:
            raise ValueError(f"{spec!r} is registered already")
        versions[version or (1, 0)] = f

    def get(self, spec: str) -> Transform:
        """The transform of a request; without a version the newest of all."""
        name, version = self._parts(spec)
        fit = [v for v in self._known.get(name, {}) if version is None or v[0] == version[0] and v >= version]
        if not fit:
            raise ValueError(f"no transform {spec!r}")
        return self._known[name][max(fit)]

    def names(self) -> list[str]:
        return sorted(f"{name} #{a}.{b}" for name, versions in self._known.items() for a, b in versions)


def write_with_triggers(df: DataFrame, path: str, triggers: dict[str, Column], mode: str = "errorifexists") -> dict:
    """Write Parquet, and give the values of aggregates over the rows written, taken in the same pass."""
    seen = Observation()
    df.observe(seen, *[c.alias(name) for name, c in triggers.items()]).write.mode(mode).parquet(path)
    return seen.get


def quality_counts(qual: Column, levels: int = 64) -> dict[str, Column]:
    """Triggers that count each level of cells of numbers."""
    equal = lambda k: lambda x: x == k
    return {f"q{k}": F.sum(F.size(F.filter(qual, equal(k)))) for k in range(levels)}


def apply_edits(rows: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """``rows`` after the committed edits, the last of each key by ``seq``: ``upsert`` sets its columns, ``delete`` drops the row.

    ``edits``: key, seq, op, committed, and columns of ``rows``; what isn't committed is rolled back. Edits are
    reduced to one a key, by a partial aggregate, before the one join.
    """
    values = [c for c in rows.columns if c != key]
    last = edits.where("committed").groupBy(key).agg(F.max_by(F.struct("op", *[c for c in values if c in edits.columns]), "seq").alias("e"))
    joined = rows.withColumn("_there", F.lit(True)).join(last, key, "full_outer").where(F.coalesce(F.col("e.op") != "delete", F.lit(True)))
    upsert = F.coalesce(F.col("e.op") == "upsert", F.lit(False))
    joined = joined.where(F.col("_there") | upsert)
    return joined.select(key, *[F.when(upsert, F.col(f"e.{c}")).otherwise(F.col(c)).alias(c) if c in edits.columns else F.col(c) for c in values])
