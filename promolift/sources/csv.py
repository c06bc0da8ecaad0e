"""Delimited-file sources: scan, header grouping, required-column gate, lineage.

Every column is read as text (no inference pass), headers are trimmed, and
the missing-value tokens become NULL. Files with different headers are read
one group per distinct header and unioned by name, so a file with its
columns in another order, or with extra columns, lines up correctly.
"""

from __future__ import annotations

import csv as _csv
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promolift import schema as S
from promolift.functions.clean import NA_TOKENS, null_if_na


def _jvm_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def list_files(spark: SparkSession, paths: list[str] | str, suffix: str = ".csv") -> list[str]:
    """Expand directories and globs to data files (names only; no data read)."""
    out: list[str] = []
    for path in [paths] if isinstance(paths, str) else paths:
        jvm, p, fs = _jvm_fs(spark, path)
        statuses = fs.globStatus(p) or []
        for st in statuses:
            if st.isDirectory():
                it = fs.listFiles(st.getPath(), True)
                while it.hasNext():
                    f = it.next().getPath()
                    name = f.getName()
                    if name.endswith(suffix) and not name.startswith(("_", ".")):
                        out.append(f.toString())
            else:
                out.append(st.getPath().toString())
    return sorted(out)


# Files whose first lines are asked for at once.
HEADER_READERS = 16


def _first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of a file, through the file system that Spark reads it by: one buffer is read, however large the file."""
    jvm, p, fs = _jvm_fs(spark, path)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark.sparkContext._jsc.hadoopConfiguration()).getCodec(p)
    data = fs.open(p)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(data) if codec else data, "UTF-8"))
    try:
        return reader.readLine()
    finally:
        reader.close()


def header_table(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, columns as split, untrimmed) of every file with a line, saved.

    Like the listing of the files this is metadata, read by the driver, several files at a time: a
    buffer a file. A scan would read the whole input, for it has no limit that holds for each file.
    """
    from promolift.session import work_dir
    with ThreadPoolExecutor(HEADER_READERS) as pool:
        lines = list(pool.map(lambda f: _first_line(spark, f), files))
    found = [(f, next(_csv.reader([line.lstrip("\ufeff")]), [])) for f, line in zip(files, lines, strict=True) if line is not None]
    path = f"{work_dir(spark)}/headers-{uuid.uuid4().hex}"
    spark.createDataFrame(found, "file string, columns array<string>").write.parquet(path)
    return spark.read.parquet(path)


def header_groups(spark: SparkSession, files: list[str], headers: DataFrame | None = None) -> dict[tuple[str, ...], list[str]]:
    """Files by header (as split, untrimmed): one row per distinct header with its file names reaches the driver."""
    if not files:
        return {}
    headers = header_table(spark, files) if headers is None else headers
    found = headers.groupBy("columns").agg(F.collect_list("file").alias("files")).collect()
    groups = {tuple(row["columns"]): list(row["files"]) for row in found}
    if bare := set(files).difference(*groups.values()):  # files without a line
        groups.setdefault((), []).extend(bare)
    return {h: sorted(m) for h, m in sorted(groups.items())}


def rejected_files(spark: SparkSession, headers: DataFrame, groups: dict[tuple[str, ...], list[str]],
                   missing: dict[tuple[str, ...], list[str]]) -> DataFrame:
    """(file, missing) of the files whose header misses required columns: the saved headers joined with the few different ones."""
    bad = [(list(h), ", ".join(m)) for h, m in missing.items() if m]
    rows = headers.join(F.broadcast(spark.createDataFrame(bad, "columns array<string>, missing string")), "columns").select("file", "missing")
    if missing.get(()):  # empty files have no row there
        rows = rows.unionByName(spark.createDataFrame([(f, ", ".join(missing[()])) for f in groups[()]], "file string, missing string"))
    return rows.distinct()


def scan_csv(spark: SparkSession, paths: list[str] | str, na_tokens: list[str] | None = None,
             multiline: bool = False) -> DataFrame:
    """Read delimited files with a header row; all columns text, headers trimmed.

    ``multiline`` allows newlines inside quoted fields but makes files
    unsplittable (one task per file); keep it off for large files.
    """
    reader = (spark.read.option("header", True).option("escape", '"')
              .option("multiLine", multiline).option("mode", "PERMISSIVE"))
    df = reader.csv(paths)
    df = df.toDF(*[c.strip() for c in df.columns])
    toks = NA_TOKENS if na_tokens is None else na_tokens
    return df.select(*[null_if_na(F.col(f"`{c}`"), toks).alias(c) for c in df.columns])


def with_lineage(df: DataFrame) -> DataFrame:
    """``source_file``: name of the file a row came from (file metadata column)."""
    return df.withColumn(S.SOURCE_FILE, F.col("_metadata.file_name"))


def with_load_order(df: DataFrame) -> DataFrame:
    """``row_order``: (file path, split start, position) - the order rows were loaded in.

    Used for "first" (first forecast, first sub category). For a DataFrame
    that was not read from files, the position alone.
    """
    position = F.monotonically_increasing_id()
    try:
        df.select("_metadata.file_path")
    except AnalysisException:  # not a file scan
        return df.withColumn(S.ROW_ORDER, position)
    return df.withColumn(S.ROW_ORDER, F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), position.alias("pos")))


@dataclass
class Loaded:
    data: DataFrame          # accepted rows, union by name, with source_file
    rejected: DataFrame      # file, missing (comma-separated)
    accepted_files: list[str]


def load_many(spark: SparkSession, paths: list[str] | str, required: list[str] | None = None,
              na_tokens: list[str] | None = None) -> Loaded:
    """Load files of possibly different headers; skip (and report) files missing a required column.

    One ``read.csv`` per distinct header (found by a distributed job),
    ``unionByName(allowMissingColumns=True)`` across groups.
    """
    req = S.REQUIRED_SALES if required is None else required
    files = list_files(spark, paths)
    if not files:
        return Loaded(_no_rows(spark, req), spark.createDataFrame([], "file string, missing string"), [])
    headers = header_table(spark, files)
    groups = header_groups(spark, files, headers)
    missing = {h: [c for c in req if c not in {x.strip() for x in h}] for h in groups}
    by_names: dict[tuple[str, ...], list[str]] = {}
    for header, members in groups.items():
        if not missing[header]:
            by_names.setdefault(tuple(h.strip() for h in header), []).extend(members)
    accepted = [m for members in by_names.values() for m in members]
    parts = [with_lineage(scan_csv(spark, members, na_tokens)) for members in by_names.values()]
    data = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else _no_rows(spark, req)
    return Loaded(data, rejected_files(spark, headers, groups, missing), accepted)


def _no_rows(spark: SparkSession, columns: list[str]) -> DataFrame:
    return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in [*columns, S.SOURCE_FILE]]))
