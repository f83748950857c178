"""Tables written once and read several times, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, a local session gets a temporary one of its own and
    a cluster an error, as its executors would each write to their own disks."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="storyloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_written: list = []


def written(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared folder: its lineage ends here and survives lost executors.

    The table is deleted by ``clear``, or else when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(at)
    _written.append((files, at))
    return spark.read.parquet(path)


def clear() -> int:
    """Deletes the tables written so far, when the frames made from them are no longer used; their number is returned."""
    n = len(_written)
    while _written:
        files, at = _written.pop()
        files.delete(at, True)
        files.cancelDeleteOnExit(at)
    return n
