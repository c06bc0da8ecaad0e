"""Tables written by this library: the saved sales table, materialised results, CSV exports.

Everything is written under the shared folder named by ``spark.checkpoint.dir``
(see ``session.work_dir``), never a machine-local folder on a cluster, and never
over a path that is being read: appends go to a new path.
"""

from __future__ import annotations

import hashlib
import re
import threading
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promolift import schema as S
from promolift.session import work_dir

_LOCK = threading.RLock()


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def files_version(spark: SparkSession, folder: str) -> str:
    """Digest of the names, sizes and modification times of the tables in a folder.

    A table that is one file counts by itself, one that is a folder by its
    files, so changed input never finds tables saved from the old one. The files are listed
    level by level, one call each, whatever their number.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found, pattern = [], folder.rstrip("/")
    while True:
        pattern += "/*"
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        level = path.getFileSystem(conf).globStatus(path)
        if not level:
            break
        level = jvm.org.apache.commons.lang3.ArrayUtils.toString(level)  # of all files in one call
        found.append(re.sub(r"access_time=\d+", "", level))
    return hashlib.sha1("\n".join(found).encode()).hexdigest()[:12]


def table_path(spark: SparkSession, name: str, key: str) -> str:
    digest = hashlib.sha1(key.encode()).hexdigest()[:12]
    return f"{work_dir(spark)}/tables/{name}-{digest}"


def write_sales_table(df: DataFrame, path: str, partitions: int | None = None, mode: str = "errorifexists") -> None:
    """Write a sales table as Parquet, partitioned by Year, sorted by Article inside files.

    ``repartitionByRange(Year, Article, Sales Date, row_order)`` gives balanced
    write tasks (sampled ranges; the trailing keys split a hot article) and
    tight Article min/max statistics per row group, so a one-article lookup
    skips most of the file. ``partitionBy(Year)`` lets year filters prune folders.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if S.YEAR in df.columns and S.ARTICLE in df.columns:
        # Trailing keys (date, unique load order) let the sampled ranges cut
        # through one hot article, so its rows spread over many write tasks.
        keys = [S.YEAR, S.ARTICLE] + [c for c in (S.SALES_DATE, S.ROW_ORDER) if c in df.columns]
        out = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
        out.write.mode(mode).partitionBy(S.YEAR).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


# Rows a task sorts when a table is written: some 250 MB in memory.
TASK_ROWS = 1_000_000


def tasks_for(df: DataFrame) -> int:
    """Tasks of a write of about as many rows as the saved table ``df`` (counted from its footers) has."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // TASK_ROWS))


def materialized(spark: SparkSession, name: str, key: str, build: Callable[[], DataFrame],
                 writer: Callable[[DataFrame, str], None] | None = None) -> DataFrame:
    """Read table ``name`` for ``key`` from the work folder, writing it first if absent.

    A written table cuts the lineage: later jobs start from Parquet, and a
    lost executor costs a re-read, not a recomputation of the whole plan.
    """
    path = table_path(spark, name, key)
    with _LOCK:
        if not path_exists(spark, f"{path}/_SUCCESS"):
            # No _SUCCESS: absent, or left unfinished by a failed run of ours.
            if writer is None:
                write_sales_table(build(), path, mode="overwrite")
            else:
                writer(build(), path)
    return spark.read.parquet(path)


def materialized_files(spark: SparkSession, path: str, build: Callable[[], DataFrame], fmt: str = "parquet") -> str:
    """Write ``build()`` to ``path`` once (parquet, or csv with a header); return the path."""
    with _LOCK:
        if not path_exists(spark, f"{path}/_SUCCESS"):
            df = build()
            if fmt == "csv":
                write_csv(df, path, mode="overwrite")
            else:
                df.write.mode("overwrite").parquet(path)
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def saved_rows(df: DataFrame, name: str) -> DataFrame:
    """A table written to a path of its own in the work folder and read back."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    write_parquet(df, path)
    return spark.read.schema(df.schema).parquet(path)


# A saved table up to this size, measured, may be broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024


def saved_measured(df: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """A table written to the work folder and read back, and whether it is measured to be small enough to broadcast.

    Its size in memory is taken from its rows: texts by their bytes, eight bytes for any other value, a fixed share a row.
    """
    table = saved_rows(df, name)
    texts = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)).cast("long") for f in df.schema.fields
             if f.dataType.typeName() == "string"]
    row = F.lit(48 + 8 * len(df.columns)).cast("long")
    size = table.agg(F.coalesce(F.sum(reduce(lambda a, b: a + b, texts, row)), F.lit(0)).alias("bytes")).first()["bytes"]
    return table, size <= BROADCAST_BYTES


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV export with a header; quotes doubled as spreadsheet tools expect."""
    (df.write.mode(mode).option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def align(df: DataFrame, schema: dict) -> DataFrame:
    """``df`` with exactly the columns of ``schema`` (name -> type), missing ones NULL."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in schema.items()])


def new_rows_only(new: DataFrame, existing: DataFrame, columns: list[str] | None = None,
                  prune_on: str | None = None) -> DataFrame:
    """Distinct rows of ``new`` that ``existing`` does not already hold.

    Both sides are aligned to the union of their columns first (a column one
    side lacks is NULL there), so rows that differ in a new column are new.
    Null-safe equality on every column (a NULL Bonus Buy equals a NULL one);
    Spark plans it as an equi-join, so the stored side is shuffled or
    broadcast by its measured size. ``prune_on`` names a partition column with
    few values: the stored side is filtered to those present in the new rows,
    which prunes its folders; the new rows are then evaluated twice, so pass
    a saved or persisted table.
    """
    schema = {f.name: f.dataType for f in [*existing.schema.fields, *new.schema.fields]}
    names = columns or list(schema)
    fresh, stored = align(new, schema).dropDuplicates(names), align(existing, schema)
    if prune_on:
        # Distinct values of a partition column: as many as folders are touched.
        values = [r[0] for r in fresh.select(prune_on).distinct().collect()]
        keep = F.col(prune_on).isin([v for v in values if v is not None])
        if None in values:
            keep = keep | F.col(prune_on).isNull()
        stored = stored.where(keep)
    cond = reduce(lambda a, b: a & b, [fresh[f"`{c}`"].eqNullSafe(stored[f"`{c}`"]) for c in names])
    return fresh.join(stored, cond, "left_anti")


def append_dedup(existing: DataFrame, new: DataFrame, existing_is_distinct: bool = True) -> DataFrame:
    """Existing rows plus new rows (union by name), duplicates over all columns removed.

    A stored table is kept distinct, so only the new rows are deduplicated
    and anti-joined against it; the stored rows are not re-aggregated on every
    append. Pass ``existing_is_distinct=False`` to deduplicate everything; both
    ways give the same rows. The result is lazy; write it to a *new* path, then
    switch readers over.
    """
    if not existing_is_distinct:
        return existing.unionByName(new, allowMissingColumns=True).dropDuplicates()
    return existing.unionByName(new_rows_only(new, existing), allowMissingColumns=True)


# ---------------------------------------------------------------- appends with an index of digests


_DIGEST, _MONTH, _BATCH = "_digest", "_month", "_batch"


def row_digest(columns: list[str]):
    """Digest of a row: the same whatever the order of the columns, and with further columns that are NULL."""
    each = [F.when(F.col(f"`{c}`").isNotNull(), F.xxhash64(F.lit(c), F.col(f"`{c}`").cast("string"))).otherwise(F.lit(0).cast("long"))
            for c in columns]
    return reduce(lambda a, b: a.bitwiseXOR(b), each)


def read_indexed(spark: SparkSession, base: str) -> DataFrame:
    """The rows of an indexed table."""
    return spark.read.option("mergeSchema", True).parquet(base).drop(_DIGEST, _MONTH, _BATCH)


def _months(spark: SparkSession, base: str, months: list[int]) -> list[str]:
    return [p for m in months if path_exists(spark, p := f"{base}/{_MONTH}={m}")]


def append_indexed(new: DataFrame, base: str, batch: str, date_col: str = S.SALES_DATE) -> None:
    """Append the rows of ``new`` that the indexed table ``base`` does not hold, duplicates removed.

    The table lies in one folder a month of ``date_col`` (equal rows have equal dates), each row with the digest of all
    its columns. Of the months that the new rows touch, and no others, the
    digests alone are read, and meet the new ones in a join on one long; only for digests that are there already are
    whole rows compared, null-safe on every column. So a batch costs its own rows and the digests of its months,
    however large the table is. The same batch again replaces itself.
    """
    spark = new.sparkSession
    names = new.columns
    month = F.coalesce(F.year(date_col) * 100 + F.month(date_col), F.lit(0)).cast("int")
    fresh = new.dropDuplicates().withColumns({_DIGEST: row_digest(names), _MONTH: month})
    fresh = saved_rows(fresh, "append")
    months = [r[_MONTH] for r in fresh.select(_MONTH).distinct().collect()]  # as many as months
    if not months:
        return
    if touched := _months(spark, base, months):
        stored = spark.read.option("mergeSchema", True).option("basePath", base).parquet(*touched).where(F.col(_BATCH) != batch)
        same, small = saved_measured(stored.select(_DIGEST).join(fresh.select(_DIGEST).distinct(), _DIGEST, "left_semi").distinct(), "append_same")
        if not same.isEmpty():
            alike = stored.join(F.broadcast(same) if small else same, _DIGEST, "left_semi").drop(_MONTH, _BATCH)
            fresh = _not_alike(fresh, alike, names)
    (fresh.withColumn(_BATCH, F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(_MONTH, _BATCH).parquet(base))


def _not_alike(fresh: DataFrame, alike: DataFrame, names: list[str]) -> DataFrame:
    """Rows of ``fresh`` that equal no row of ``alike``, null-safe on the columns of both.

    The digest alone is the key that rows are shuffled and sorted by: the equal columns are counted, since
    a plain comparison of each would become part of the key.
    """
    own = alike.drop(_DIGEST)
    schema = {f.name: f.dataType for f in [*own.schema.fields, *fresh.select(*[f"`{c}`" for c in names]).schema.fields]}
    stored = align(alike, {_DIGEST: "long"} | schema).toDF("_stored", *[f"_stored{i}" for i in range(len(schema))])
    of_fresh = [F.col(f"`{c}`") if c in names else F.lit(None).cast(t) for c, t in schema.items()]
    equal = reduce(lambda a, b: a + b, [x.eqNullSafe(F.col(f"_stored{i}")).cast("int") for i, x in enumerate(of_fresh)])
    return fresh.join(stored, (F.col(_DIGEST) == F.col("_stored")) & (equal == len(schema)), "left_anti")


# ---------------------------------------------------------------- saved promotions


def materialize_promotions(spark: SparkSession, facts: DataFrame, key: str) -> DataFrame:
    """Un-thresholded promotion facts, written once per filter set without ``min_days``.

    ``min_days`` (and the other validity thresholds) are then cheap filters on
    the stored facts, so changing them does not recompute baselines.
    """
    return materialized(spark, "promo_facts", key, lambda: facts,
                        writer=lambda df, p: df.write.mode("overwrite").parquet(p))


def min_days_view(facts: DataFrame, min_days: int) -> DataFrame:
    """Valid promotions from stored facts for one ``min_days``."""
    from promolift.operators import promo as P
    keys = S.promo_keys(facts.columns)
    return P.label_promotions(P.valid_filter(facts, min_days), keys, S.FORECAST_QTY in facts.columns)

