"""Tidy CSV and Parquet files of observations."""

from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from frostline.schema import OBSERVATION
from frostline.sources.shared import remove
from frostline.sources.versions import current_version, names_in, new_version, publish

# Quotes inside a field are doubled, and spaces belong to the field.
_CSV = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def _hidden_files(spark: SparkSession, path: str) -> list[str]:
    """CSV files whose names begin with a dot or an underscore, which Spark passes over."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    names = [f.getPath().getName() for f in system.listStatus(folder) if f.isFile()]
    return [n for n in names if n.startswith((".", "_")) and n.endswith(".csv")]


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame | None:
    """All CSV files of a folder as one table, or None when there are none.

    The header must name the columns of the schema, and a value that is not a
    number stops the read instead of turning into a null. `multi_line` accepts line
    breaks within quotes; a file is then read by one task. A file that Spark would pass
    over for its name raises ValueError.
    """
    if hidden := _hidden_files(spark, path):
        raise ValueError(f"rename these files, Spark does not read them: {sorted(hidden)}")
    try:
        return (
            spark.read.schema(OBSERVATION)
            .options(**_CSV, enforceSchema=False, mode="FAILFAST", multiLine=multi_line)
            .csv(f"{path.rstrip('/')}/*.csv")
        )
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_csv(observations: DataFrame, path: str, multi_line: bool = False) -> bool:
    """Write CSV files with a header; without rows nothing stays written.

    A text with a line break stops the job unless `multi_line` says that the readers of
    the files accept it.
    """
    rows = observations.select(*OBSERVATION.fieldNames())
    if not multi_line:
        broken = F.raise_error(F.lit("a text has a line break: write it with multi_line"))
        texts = [f.name for f in OBSERVATION if f.dataType.simpleString() == "string"]
        rows = rows.select(
            *[
                F.when(F.col(c).rlike("[\\r\\n]"), broken).otherwise(F.col(c)).alias(c)
                if c in texts
                else c
                for c in rows.columns
            ]
        )
    written = Observation()
    rows = rows.observe(written, F.count(F.lit(1)).alias("rows"))
    rows.write.mode("overwrite").options(**_CSV).csv(path)
    if written.get["rows"]:
        return True
    remove(rows.sparkSession, path)
    return False


def _rows_of(spark: SparkSession, path: str) -> str:
    version = current_version(spark, path)
    return f"{version}/rows" if version else path


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """The combined Parquet table, with or without datatype folders, with or without versions."""
    return spark.read.schema(OBSERVATION).parquet(_rows_of(spark, path))


def replace_observations(observations: DataFrame, path: str) -> int:
    """As write_observations, but as the next version of the table: the old rows can be read
    until all new ones are written, and stay if the job is lost.

    Beside the rows stands the list of stations, taken from the rows as written."""
    spark = observations.sparkSession
    version = new_version(spark, path)
    rows = write_observations(observations, f"{version}/rows")
    written = spark.read.schema(OBSERVATION).parquet(f"{version}/rows")
    written.select("station").where("station IS NOT NULL").distinct().write.parquet(f"{version}/stations")
    publish(spark, path, version)
    return rows


def stations_listed(spark: SparkSession, path: str) -> DataFrame:
    """The different stations of a table, from the list written with its rows if it has one."""
    version = current_version(spark, path)
    if version is None:
        return read_observations(spark, path).select("station").where("station IS NOT NULL").distinct()
    return spark.read.schema("station string").parquet(f"{version}/stations")


def datatypes_listed(spark: SparkSession, path: str) -> DataFrame:
    """The different datatypes of a table, from the names of its folders, so that no file is
    opened; a table without such folders is read."""
    folders = [n for n in names_in(spark, _rows_of(spark, path)) if n.startswith("datatype=")]
    if not folders:
        return read_observations(spark, path).select("datatype").where("datatype IS NOT NULL").distinct()
    named = [unquote(n.removeprefix("datatype=")) for n in folders if n != "datatype=__HIVE_DEFAULT_PARTITION__"]
    return spark.createDataFrame([(n,) for n in named], "datatype string")


def write_trend(trend: DataFrame, path: str) -> int:
    """Replace the table of a climate trend, dealt by ranges of (station_id, date), and give the
    number of rows written."""
    spark = trend.sparkSession
    version, written = new_version(spark, path), Observation()
    (
        trend.repartitionByRange("station_id", "date")
        .observe(written, F.count(F.lit(1)).alias("rows"))
        .sortWithinPartitions("station_id", "date")
        .write.parquet(f"{version}/rows")
    )
    publish(spark, path, version)
    return written.get["rows"]


def read_trend(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{current_version(spark, path)}/rows")


def write_observations(observations: DataFrame, path: str) -> int:
    """Replace the combined Parquet table, one folder per datatype.

    Every query but the two listings reads one or two datatypes, and finds them in their
    folders. Rows are dealt by ranges of (datatype, station, date): a file holds few
    stations, so a filter on the station skips the others, and a large datatype or station
    is spread over tasks. An empty datatype, which no folder can be named for, stops the job.

    Gives the number of rows, counted while they are written. They are counted
    behind the shuffle, because adaptive execution drops what comes before an
    empty one.
    """
    nameless = F.raise_error(F.lit("an observation has an empty datatype"))
    named = F.when(F.col("datatype") == "", nameless).otherwise(F.col("datatype"))
    written = Observation()
    (
        observations.select(*OBSERVATION.fieldNames())
        .withColumn("datatype", named)
        .repartitionByRange("datatype", "station", "date")
        .observe(written, F.count(F.lit(1)).alias("rows"))
        .sortWithinPartitions("datatype", "station", "date")
        .write.mode("overwrite")
        .partitionBy("datatype")
        .parquet(path)
    )
    return written.get["rows"]


def from_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A small table of (date, datatype, station, value) rows held in memory."""
    return spark.createDataFrame(rows, OBSERVATION)
