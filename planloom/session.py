"""What a Spark session needs before it runs this library's Python functions."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Rows that Spark hands to a Python function at once: whole documents, so fewer than Spark's own 10,000.
ROWS_A_BATCH = 1000


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once a session, through Spark's own file server: they need not have it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    if "spark.sql.execution.arrow.maxRecordsPerBatch" not in spark.conf.getAll:  # what the caller set stays
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_A_BATCH))
    package = Path(__file__).parent
    at = Path(tempfile.mkdtemp(prefix="planloom-")) / "planloom.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(at))
    _shipped.add(app)


@cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="planloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return "file://" + folder


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, in the cluster's spark.checkpoint.dir.

    Where that is unset, a session whose executors are threads of this process has a temporary folder; any other fails,
    as its machines would not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        folder = _own_folder()
    return f"{folder.rstrip('/')}/planloom-{spark.sparkContext.applicationId}"


def forget(spark: SparkSession) -> None:
    """Deletes this application's intermediate tables. Results that still rest on them can't be read any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to as many tasks as the cluster runs at once, where its input has fewer parts (a small file is one).

    Larger inputs have more parts than that, and stay as they are: nothing large is shuffled.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


#: For Parquet rows of some MB each: the writer looks at its size after every row, not every hundred, and begins a new row
#: group after few of them, so that neither it nor a reader, which takes up a row group's rows at once, holds many.
LARGE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size": str(4 << 20)}


def settled(df: DataFrame, name: str, large_rows: bool = False) -> DataFrame:
    """df written to the folder that all executors share and read back: computed once, its plan and lineage cut."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(LARGE_ROWS if large_rows else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
