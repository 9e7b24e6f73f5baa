"""Row-addressed tables: row ranges, dumps, redaction, copies, text indexes, metadata nodes, cache tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.session import dealt


def row_ranges(text: str) -> list[tuple[int, int]]:
    """Sorted, disjoint, inclusive ranges of an expression such as ``1-100,205,90-120``."""
    out: list[tuple[int, int]] = []
    spans = []
    for part in text.split(","):
        m = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", part)
        if m is None:
            raise ValueError(f"bad row range: {part!r}")
        a, b = int(m[1]), int(m[2] or m[1])
        spans.append((min(a, b), max(a, b)))
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def in_rows(row_id: Column, text: str) -> Column:
    """Whether a row id is within a range expression; comparisons that reach the scan as pushed filters."""
    test = F.lit(False)
    for a, b in row_ranges(text):
        test = test | row_id.between(a, b)
    return test


def id_range(df: DataFrame, row_id: str, column: str) -> DataFrame:
    """(first, last) row id that has a value in the column."""
    return df.where(F.col(column).isNotNull()).agg(F.min(row_id).alias("first"), F.max(row_id).alias("last"))


def row_length(c: Column, kind: T.DataType) -> Column:
    """Number of elements of a cell: of an array, characters of a string, else 1; 0 of null."""
    n = F.size(c) if isinstance(kind, (T.ArrayType, T.MapType)) else F.length(c) if isinstance(kind, (T.StringType, T.BinaryType)) else F.lit(1)
    return F.when(c.isNull(), 0).otherwise(n)


def column_report(df: DataFrame) -> DataFrame:
    """(name, type, filled, least, most, fixed) of every column, by one scan: row lengths, and whether all are one."""
    parts = []
    for f in df.schema.fields:
        n = row_length(F.col(f"`{f.name}`"), f.dataType)
        parts.append(F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"), F.count(F.col(f"`{f.name}`")).alias("filled"), F.min(n).alias("least"), F.max(n).alias("most")))
    one = df.agg(F.array(*parts).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    return one.withColumn("fixed", F.coalesce(F.col("least") == F.col("most"), F.lit(True)))


def chosen(df: DataFrame, keep: list[str] | None = None, without: list[str] = ()) -> DataFrame:
    """Only these columns, or all but some."""
    return df.select(*[c for c in (keep or df.columns) if c not in set(without)])


def dump(df: DataFrame, form: str = "default") -> DataFrame:
    """One line a row: default (name: value, one line a column), csv, tab, piped, json or xml."""
    text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    quoted = [F.when(t.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t) for t in text]
    safe = lambda t: F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    forms = {
        "default": lambda: F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), t) for c, t in zip(df.columns, text)]),
        "csv": lambda: F.concat_ws(",", *quoted), "tab": lambda: F.concat_ws("\t", *[F.regexp_replace(t, "[\t\n\r]", " ") for t in text]), "piped": lambda: F.concat_ws("|", *text),
        "json": lambda: F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])),
        "xml": lambda: F.concat(F.lit("<row>"), *[F.concat(F.lit(f"<{c}>"), safe(t), F.lit(f"</{c}>")) for c, t in zip(df.columns, text)], F.lit("</row>")),
    }
    if form not in forms:
        raise ValueError(f"unknown form {form!r}; there are {', '.join(forms)}")
    return df.select(forms[form]().alias("value"))


def redact(df: DataFrame, hide: Column, columns: list[str]) -> DataFrame:
    """Cells of these columns in hidden rows are overwritten by their type: N for each character, 0 for numbers, else null."""
    out = {}
    for c in columns:
        kind = df.schema[c].dataType
        blank = F.repeat(F.lit("N"), F.length(c)) if isinstance(kind, T.StringType) else F.lit(0).cast(kind) if isinstance(kind, T.NumericType) else F.lit(None).cast(kind)
        out[c] = F.when(hide & F.col(c).isNotNull(), blank).otherwise(F.col(c))
    return df.withColumns(out)


def copy_matching(df: DataFrame, target: T.StructType) -> DataFrame:
    """The target's columns from those of one name whose values its type can hold; others are null. A cell that can't be cast is null."""
    have = {f.name.lower(): f.name for f in df.schema.fields}
    return df.select(*[(F.col(f"`{have[f.name.lower()]}`").try_cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in target.fields])


def text_index(df: DataFrame, row_id: str, key: str, width: int = 1 << 18) -> DataFrame:
    """(key, first, n) of runs of rows, consecutive by id, with one key.

    Rows are numbered within ranges of ``width`` ids; only the ranges' counts, a row for each, go through a window of the key, which may hold most rows.
    """
    by_key = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(row_id).alias("id")).withColumn("_range", F.coalesce(F.floor(F.col("id") / width), F.lit(-(1 << 62))))
    by_key = dealt(by_key, "key", "_range", rows=1 << 19)
    counts = by_key.groupBy("key", "_range").agg(F.count("*").alias("_n"))
    counts = counts.select("key", "_range", (F.sum("_n").over(Window.partitionBy("key").orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("key", "_range").orderBy("id"))
    runs = by_key.withColumn("_in", inside).join(counts, ["key", "_range"]).withColumn("_run", F.col("id") - F.col("_before") - F.col("_in"))
    return runs.groupBy("key", "_run").agg(F.min("id").alias("first"), F.count("*").alias("n")).drop("_run")


def index_lookup(index: DataFrame, key: str) -> DataFrame:
    """(first, last) of a key's rows; none of a missing key."""
    return index.where(F.col("key") == key).select("first", (F.col("first") + F.col("n") - 1).alias("last"))


def index_project(index: DataFrame, row_id: int, default: str | None = None) -> str | None:
    """Key of a row, or the default where no run holds it."""
    found = index.where((F.col("first") <= row_id) & (F.col("first") + F.col("n") > row_id)).select("key").head()
    return default if found is None else found["key"]


def write_node(meta: DataFrame, path: str, value: str, append: bool = False) -> DataFrame:
    """Metadata nodes (path, value) with one of them set, or lengthened."""
    spark = meta.sparkSession
    old = meta.where(F.col("path") == path)
    new = spark.createDataFrame([(path, value)], "path string, value string")
    if append:
        new = new.withColumnRenamed("value", "more").join(old, "path", "left").select("path", F.concat(F.coalesce("value", F.lit("")), "more").alias("value"))
    return meta.where(F.col("path") != path).unionByName(new)


def read_node(meta: DataFrame, path: str, kind: str = "string"):
    """Value of a node as a type; None where there is none."""
    got = meta.where(F.col("path") == path).select(F.col("value").try_cast(kind).alias("v")).head()
    return None if got is None else got["v"]


def cache_get(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """Newest version of each (cache_key, subkey) that is asked for, by one partial aggregate before the join."""
    rest = [c for c in entries.columns if c not in ("cache_key", "subkey", "version")]
    newest = entries.groupBy("cache_key", "subkey").agg(F.max_by(F.struct("version", *rest), "version").alias("e")).select("cache_key", "subkey", "e.*")
    return keys.join(newest, [c for c in ("cache_key", "subkey") if c in keys.columns])


def cache_expire(entries: DataFrame, now_us: int, lifetime_us: int) -> DataFrame:
    """Entries touched within the lifetime."""
    return entries.where(F.col("touched_us") >= now_us - lifetime_us)


def id_checksums(df: DataFrame, key: str, order: str, c: str) -> DataFrame:
    """(key, total, crc32, md5) of a key's cells joined in order; for keys whose joined text fits a row."""
    s = df.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, c))), lambda x: x[c]), "").alias("s"))
    return s.select(key, F.length("s").cast("long").alias("total"), F.crc32(F.col("s").cast("binary")).alias("crc32"), F.md5(F.col("s").cast("binary")).alias("md5"))
