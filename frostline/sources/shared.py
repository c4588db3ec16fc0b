"""Tables written between two steps of a job."""

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A new path in `folder`, or else in the folder that spark.checkpoint.dir names.

    All executors have to reach it, so without either only a local session gets a
    temporary folder; any other raises ValueError.
    """
    folder = folder or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("name a shared folder, or set spark.checkpoint.dir")
        folder = tempfile.mkdtemp()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that no later step reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
