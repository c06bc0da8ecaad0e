"""Incremental sales ingest with Structured Streaming.

A file-source stream notices new sales files in a folder (its checkpoint
remembers which were taken); the files of a micro-batch are then loaded *by
header*, as ``sources.csv.load_many`` does: columns in any order, extra
columns kept, files that miss a required column reported and left out. Rows
are cleaned (missing-value tokens, status, dates, numbers, bad dates dropped,
lineage) and appended to the saved table without duplicates:

* duplicates inside the micro-batch are dropped, then the batch is anti-joined,
  null-safe on every column, with the stored rows of the *same files*: the
  file name is one of the compared columns, so no other rows can be equal. Beside the
  table every file name has a folder with a mark for each batch that holds rows of it;
  only those batches are opened (none, for a file that is new), so a batch costs
  its own files, however many batches there were;
* each batch is written to its own folder ``batch_id=<n>``, overwritten on a
  replay, so a batch that is retried after a failure is written once. Its
  rejected files are listed in a table beside it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from promolift import schema as S
from promolift.operators import ingest as I
from promolift.sources import csv as CSV
from promolift.sources.store import new_rows_only

def new_files(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of the paths of CSV files arriving in ``source_dir`` (contents are not read)."""
    reader = (spark.readStream.format("binaryFile").option("pathGlobFilter", "*.csv")
              .schema("path string, modificationTime timestamp, length long, content binary"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(source_dir).select("path")


def cleaned(loaded: DataFrame) -> DataFrame:
    """Typed rows with a valid date, their Year and file name, duplicates dropped."""
    typed = I.typed_sales(I.drop_empty_rows(loaded))
    return typed.where(F.col(S.SALES_DATE).isNotNull()).withColumn(S.YEAR, F.year(S.SALES_DATE)).dropDuplicates()


def _marks(table_dir: str, file: str) -> str:
    """Folder of the marks of a file name."""
    return f"{table_dir}_files/{hashlib.md5(file.rsplit('/', 1)[-1].encode()).hexdigest()}"


def batches_with(spark: SparkSession, table_dir: str, files: list[str]) -> list[int]:
    """Batches that hold rows of files of these names: one listing a file."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found: set[int] = set()
    for file in files:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{_marks(table_dir, file)}/*")
        found.update(int(st.getPath().getName()) for st in path.getFileSystem(conf).globStatus(path) or [])
    return sorted(found)


def mark(spark: SparkSession, table_dir: str, files: list[str], batch_id: int) -> None:
    """Note that the batch holds rows of these files; the same again changes nothing."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for file in files:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{_marks(table_dir, file)}/{batch_id}")
        path.getFileSystem(conf).create(path, True).close()


def append_batch(table_dir: str):
    """``foreachBatch`` function: load the batch's files, drop rows already stored, write the batch folder."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        files = [r["path"] for r in batch.collect()]  # names of the files of one trigger
        if not files:
            return
        loaded = CSV.load_many(spark, files)
        loaded.rejected.write.mode("overwrite").parquet(f"{table_dir}_rejected/batch_id={batch_id}")
        if not loaded.accepted_files:
            return
        new = cleaned(loaded.data)
        before = [b for b in batches_with(spark, table_dir, loaded.accepted_files) if b != batch_id]
        if before:
            names = [f.rsplit("/", 1)[-1] for f in loaded.accepted_files]
            stored = read_batches(spark, table_dir, before).where(F.col(S.SOURCE_FILE).isin(names))
            new = new_rows_only(new, stored.drop("batch_id"))
        new.write.mode("overwrite").partitionBy(S.YEAR).parquet(f"{table_dir}/batch_id={batch_id}")
        mark(spark, table_dir, loaded.accepted_files, batch_id)
    return run


def read_batches(spark: SparkSession, table_dir: str, batches: list[int]) -> DataFrame:
    """The rows of some batches; no other batch's files are opened."""
    paths = [f"{table_dir}/batch_id={b}" for b in batches]
    return spark.read.option("mergeSchema", True).option("basePath", table_dir).parquet(*paths)


def start_sales_ingest(spark: SparkSession, source_dir: str, table_dir: str, checkpoint_dir: str,
                       available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the ingest stream; ``available_now`` processes what is there and stops."""
    writer = (new_files(spark, source_dir, max_files_per_trigger).writeStream
              .foreachBatch(append_batch(table_dir))
              .option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def read_ingested(spark: SparkSession, table_dir: str) -> DataFrame:
    """The ingested table (all batches; a column that a batch lacks is NULL there)."""
    return spark.read.option("mergeSchema", True).parquet(table_dir)


def read_rejected(spark: SparkSession, table_dir: str) -> DataFrame:
    """Files left out so far, with the columns they miss."""
    return spark.read.parquet(f"{table_dir}_rejected")
