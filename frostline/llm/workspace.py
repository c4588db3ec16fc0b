"""Tables between two steps of an operator, and Arrow helpers for its tasks."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a session without one, as in tests, gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="frostline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back, which cuts its lineage."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes a saved table that no later step reads."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path
    folder = at(shared_folder(spark)).toUri().getPath()
    for file in df.inputFiles()[:1]:
        path = at(file.rsplit("/", 1)[0])
        if path.toUri().getPath().startswith(f"{folder}/"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Frees the disk that shuffles of finished steps take: Spark deletes their files once the driver
    has collected what refers to them, which may be long after the step. Events of the step that are
    still on their way refer to them as well, hence the second time."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(1)


#: Rows and bytes of the batches that go to Python, unless the session has its own limits.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m"),
}


def bounded_batches(df: DataFrame) -> DataFrame:
    """Makes the session send small batches, so that long texts and the lists made of them
    fit beside the executor's heap. Limits that were set are left alone."""
    conf = df.sparkSession.conf
    for name, (default, ours) in BATCH.items():
        if conf.get(name) == default:
            conf.set(name, ours)
    return df


def map_rows(
    df: DataFrame, batch: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """Maps Arrow batches one by one."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            out = batch(b)
            if out is not None and out.num_rows:
                yield out

    return bounded_batches(df).mapInArrow(run, schema)


def map_partitions(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str
) -> DataFrame:
    """As map_rows, with a function made anew for each task."""

    def run(batches: Batches) -> Batches:
        batch = make()
        for b in batches:
            out = batch(b)
            if out is not None and out.num_rows:
                yield out

    return bounded_batches(df).mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def text_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the columns an operator reads, so that others may have any name."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])
