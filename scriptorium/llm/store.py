"""Tables that cut lineage, in the folder which the cluster shares (``spark.checkpoint.dir``).

A written table survives the loss of an executor, is compressed and is read by column.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local session may go without and then gets a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="scriptorium-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_dir(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder; removed when the process ends."""
    if not _written:
        atexit.register(release)
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def keyed(docs: DataFrame) -> tuple[DataFrame, Column, Column]:
    """(``docs``, two columns that name each of its rows, the same in every reading). Rows of a table in files are
    named by file and place; anything else is written first."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = written(docs, "rows")
    place = docs.metadataColumn("_metadata")
    return docs, F.xxhash64(place["file_path"]), place["row_index"]


def lean(spark: SparkSession) -> None:
    """Arrow batches of 8 MB at most, unless the session has a limit of its own: a batch is held several times over
    by Spark and by Python."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "64MB", "64m"):  # Spark's own value
        spark.conf.set(name, "8m")


def written(df: DataFrame, what: str) -> DataFrame:
    """The same rows, read from a Parquet table written now."""
    spark = df.sparkSession
    lean(spark)
    path = new_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete what this process has written."""
    while _written:
        spark, path = _written.pop()
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session has ended; the folder's owner cleans it
            return
