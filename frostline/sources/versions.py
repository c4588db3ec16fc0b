"""Tables that are replaced as a whole: readers see the old rows or the new ones.

A table's folder holds its versions below `_table` and, for each that was written to its end,
an empty file of the same name below `_current`. Creating that file is the one step that
switches readers over, so a job that is lost while it writes leaves the old table as it was.
"""

import uuid

from pyspark.sql import SparkSession

from frostline.sources.shared import remove

#: Versions that stay: the current one, and the one before it for jobs that still read it.
KEPT = 2


def _system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names of what a folder holds, sorted; none if it does not exist."""
    system, folder = _system(spark, path)
    if not system.exists(folder):
        return []
    return sorted(f.getPath().getName() for f in system.listStatus(folder))


def _number(version: str) -> int:
    return int(version.split("-")[0])


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder of the rows to read, or None for a table without versions."""
    done = names_in(spark, f"{path.rstrip('/')}/_current")
    return f"{path.rstrip('/')}/_table/{done[-1]}" if done else None


def new_version(spark: SparkSession, path: str) -> str:
    """A folder to write the next version to."""
    done = names_in(spark, f"{path.rstrip('/')}/_current")
    number = _number(done[-1]) + 1 if done else 0
    return f"{path.rstrip('/')}/_table/{number:010d}-{uuid.uuid4().hex}"


def publish(spark: SparkSession, path: str, version: str) -> None:
    """Make a version that was written the current one, then delete what is older than KEPT
    versions, rows that lie in the folder without a version, and leftovers of lost jobs."""
    path = path.rstrip("/")
    name = version.rsplit("/", 1)[1]
    system, marker = _system(spark, f"{path}/_current/{name}")
    system.create(marker, False).close()
    done = names_in(spark, f"{path}/_current")
    for old in done[:-KEPT]:
        remove(spark, f"{path}/_current/{old}")
    kept = set(done[-KEPT:])
    for other in names_in(spark, f"{path}/_table"):
        # a version with a later number may be one that another job is writing
        if other not in kept and _number(other) <= _number(name):
            remove(spark, f"{path}/_table/{other}")
    for other in names_in(spark, path):
        if other not in ("_table", "_current"):
            remove(spark, f"{path}/{other}")
