"""Raw flow CSV files: one profiling scan, then a typed scan per text encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.operators.columns import COPY_MARK, ID_COLUMNS, strip_names
from flowloom.operators.labels import day_of_file

TARGET = "Label"


def _cp1252() -> tuple[str, str, str]:
    """Characters that differ between latin-1 and windows-1252, their meaning, and the undefined ones."""
    source, meaning, undefined = "", "", ""
    for b in range(0x80, 0xA0):
        try:
            meaning += bytes([b]).decode("cp1252")
            source += chr(b)
        except UnicodeDecodeError:
            undefined += chr(b)
    return source, meaning, undefined


_LATIN, _WINDOWS, _UNDEFINED = _cp1252()


def profile_files(spark: SparkSession, path: str) -> DataFrame:
    """Per file: size, data rows, header line, encoding and a digest of its lines, in one text scan.

    Lines of a large file are profiled by many tasks. The digest is equal for equal content and
    ignores line order.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("filename"),
        F.col("_metadata.file_size").alias("size_bytes"),
        F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at"),
        "value",
    )
    latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    digest = F.xxhash64("value")
    per = raw.groupBy("path", "filename", "size_bytes").agg(
        (F.count(F.lit(1)) - 1).alias("row_count"),
        F.min_by("value", "at").alias("header"),
        F.bool_and(F.is_valid_utf8("value")).alias("_utf8"),
        F.bool_or(latin.rlike(f"[{_UNDEFINED}]")).alias("_undefined"),
        F.bit_xor(digest).alias("_x"),
        F.sum(F.pmod(F.xxhash64("value", F.lit(1)), F.lit(2**31 - 1))).alias("_s"),
    )
    encoding = F.when(F.col("_utf8"), "utf-8").when(F.col("_undefined"), "latin-1").otherwise("cp1252")
    return per.select(
        "path", "filename", "size_bytes", F.round(F.col("size_bytes") / F.lit(1024.0 * 1024.0), 2).alias("size_mb"),
        F.sha2(F.concat_ws(":", "row_count", "_x", "_s"), 256).alias("hash"), "row_count",
        F.rtrim(F.col("header"), F.lit("\r")).alias("header"), encoding.alias("encoding"), day_of_file(F.col("filename")).alias("day"))


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of whole files, for files small enough to be read in one piece."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("hash"))


def header_names(header: str) -> list[str]:
    """Column names of a header line; a repeated name gets the copy mark."""
    seen: dict[str, int] = {}
    names = []
    for raw in header.lstrip("﻿").split(","):
        name = raw.strip().strip('"').strip()
        n = seen.get(name, 0)
        seen[name] = n + 1
        names.append(f"{name}.{n}" if n else name)
    return names


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """File profile with column list and whether the columns differ from those of the first file."""
    files = profile_files(spark, path)
    cols = F.transform(F.split("header", ","), lambda c: F.trim(c))
    named = files.withColumn("columns", cols)
    first = F.first("columns").over(_by_name())
    differs = (F.size(F.array_except("columns", first)) > 0) | (F.size(F.array_except(first, F.col("columns"))) > 0)
    return named.withColumn("column_mismatch", differs).drop("header").orderBy("filename")


def _by_name():
    # One row per file, so a single partition is as small as the directory listing.
    return Window.partitionBy(F.lit(0)).orderBy("filename").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def manifest_totals(files: DataFrame) -> DataFrame:
    """Totals over the manifest rows."""
    return files.agg(
        F.count(F.lit(1)).alias("total_files"), F.sum("row_count").alias("total_rows"), F.sum("size_bytes").alias("total_bytes"),
        F.count_if("column_mismatch").alias("mismatched_files"))


def flow_schema(names: Sequence[str], text: Sequence[str] = (*ID_COLUMNS, TARGET)) -> T.StructType:
    """Text for identifiers and label, double for everything else."""
    return T.StructType([T.StructField(n, T.StringType() if n in text else T.DoubleType()) for n in names])


def _windows_text(df: DataFrame) -> DataFrame:
    """Turn latin-1 text into windows-1252 text."""
    def fix(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        return F.translate(c, _LATIN, _WINDOWS).alias(f.name) if isinstance(f.dataType, T.StringType) else c

    return df.select(*[fix(f) for f in df.schema.fields])


def read_flow_csv(spark: SparkSession, path: str, text: Sequence[str] = (*ID_COLUMNS, TARGET)) -> DataFrame:
    """All CSV files of a folder as one table with ``_source_file`` and ``_day``.

    Files are grouped by encoding and header; each group is one scan with an explicit schema,
    and groups are united by column name.
    """
    pattern = path if path.endswith(".csv") else f"{path.rstrip('/')}/*.csv"
    try:
        groups = (
            profile_files(spark, pattern)
            .groupBy("encoding", "header")
            .agg(F.array_sort(F.collect_list("path")).alias("paths"))
            .orderBy(F.col("paths")[0])
            .collect()
        )
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"no CSV files found in {path}") from e
        raise
    if not groups:
        raise FileNotFoundError(f"no CSV files found in {path}")
    out: DataFrame | None = None
    for g in groups:
        charset = "UTF-8" if g["encoding"] == "utf-8" else "ISO-8859-1"
        scan = spark.read.schema(flow_schema(header_names(g["header"]), text)).csv(
            list(g["paths"]), header=True, encoding=charset, enforceSchema=True, mode="PERMISSIVE",
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        names = scan.columns
        part = scan.select(*[F.col(f"`{c}`") for c in names], F.col("_metadata.file_name").alias("_source_file"))
        if g["encoding"] == "cp1252":
            part = _windows_text(part)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.withColumn("_day", day_of_file(F.col("_source_file")))


def load_submitted(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """A submitted CSV or Parquet table with stripped names, optionally only its first rows."""
    if path.lower().endswith(".csv"):
        df = spark.read.csv(path, header=True, inferSchema=True)
    else:
        df = spark.read.parquet(path)
    df = strip_names(df)
    return df.limit(max_rows) if max_rows else df


def without_copies(df: DataFrame) -> DataFrame:
    """Drop columns that repeat a header name."""
    return df.drop(*[c for c in df.columns if COPY_MARK in c])
