"""Helpers shared by the operators of this package: tables, the shared folder, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promolift.session import work_dir

#: White space as the result contracts define it (space, tab, LF, VT, FF, CR).
SPACE = r"[\x20\x09-\x0D]+"


#: Rows of an Arrow batch: texts are long, so fewer than Spark's default of 10,000.
BATCH_ROWS = 1000
#: Bytes of an Arrow batch, so that rows of any size make batches of a bounded one.
BATCH_BYTES = 16 << 20

_ready: set[str] = set()


def ready(spark: SparkSession) -> None:
    """Prepare an application, once: executors get this library, Arrow batches a size that suits texts.

    Functions that run in Python workers import the library; a cluster job
    started with ``--py-files`` has it already, and then shipping changes
    nothing. A batch size that was set on purpose stays.
    """
    context = spark.sparkContext
    if context.applicationId in _ready:
        return
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(size) in ("67108864b", "-1"):  # Spark's defaults
        spark.conf.set(size, str(BATCH_BYTES))
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix=f"{root.name}-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))  # the driver serves it to every executor
    _ready.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text as a string, a missing one as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder (``spark.checkpoint.dir``), never reused."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage is cut there: what follows restarts from the files, so a lost
    executor costs a re-read and never a second, different, run of the plan.
    """
    ready(df.sparkSession)
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
