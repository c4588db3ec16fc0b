"""Observation tables derived from `lineitem`, for Spark and DuckDB alike."""

from pyspark.sql import DataFrame, SparkSession

OBSERVATIONS_SQL = """
SELECT station, date, datatype, CAST(max(v) AS DOUBLE) AS value FROM (
 SELECT CASE CAST(floor(l_suppkey / 10) AS INT)
          WHEN 0 THEN 'GHCND:USC00351862'
          WHEN 1 THEN 'GHCND:USW00024221'
          WHEN 2 THEN 'GHCND:USW00024232'
          ELSE concat('GHCND:XTEST',
                 lpad(CAST(CAST(floor(l_suppkey / 10) AS INT) AS VARCHAR(6)), 6, '0')) END AS station,
  CAST(CAST(l_shipdate - INTERVAL '18' YEAR AS DATE) AS VARCHAR(10)) AS date,
  CASE l_linenumber % 3 WHEN 0 THEN 'TMAX' WHEN 1 THEN 'TMIN' ELSE 'PRCP' END AS datatype,
  CASE l_linenumber % 3
   WHEN 0 THEN 46 + 6 * (6 - abs(month(l_shipdate) - 7)) + (CAST(l_quantity AS INT) % 21) - 10
   WHEN 1 THEN 30 + 4 * (6 - abs(month(l_shipdate) - 7)) + (CAST(l_quantity AS INT) % 21) - 10
   ELSE CAST(l_quantity AS INT) % 7 END AS v
 FROM {lineitem}) q
GROUP BY station, date, datatype
"""

# Every reading, not folded: days repeat readings, some are null. Stations that end in W
# have no frost; those that end in K have hot days and frost in two years only.
READINGS_SQL = """
SELECT concat(station, kind) AS station, date, datatype,
 CAST(CASE WHEN l_orderkey % 97 = 0 THEN NULL
   WHEN kind = 'W' THEN v + 60
   WHEN kind = 'K' AND NOT substring(date, 1, 4) IN ('1980', '1981')
     THEN CASE datatype WHEN 'TMIN' THEN v + 60 ELSE v - 100 END
   ELSE v END AS DOUBLE) AS value FROM (
 SELECT l_orderkey,
  CASE CAST(floor(l_suppkey / 10) AS INT) WHEN 0 THEN 'GHCND:USC00351862'
    WHEN 1 THEN 'GHCND:USW00024221' WHEN 2 THEN 'GHCND:USW00024232'
    ELSE concat('GHCND:XTEST',
      lpad(CAST(CAST(floor(l_suppkey / 10) AS INT) AS VARCHAR(6)), 6, '0')) END AS station,
  CASE l_suppkey % 10 WHEN 9 THEN 'W' WHEN 8 THEN 'K' ELSE '' END AS kind,
  CAST(CAST(l_shipdate - INTERVAL '18' YEAR AS DATE) AS VARCHAR(10)) AS date,
  CASE l_linenumber % 3 WHEN 0 THEN 'TMAX' WHEN 1 THEN 'TMIN' ELSE 'PRCP' END AS datatype,
  CASE l_linenumber % 3
   WHEN 0 THEN 46 + 6 * (6 - abs(month(l_shipdate) - 7)) + (CAST(l_quantity AS INT) % 21) - 10
   WHEN 1 THEN 30 + 4 * (6 - abs(month(l_shipdate) - 7)) + (CAST(l_quantity AS INT) % 21) - 10
   ELSE CAST(l_quantity AS INT) % 7 END AS v
 FROM {lineitem}) q
"""


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return spark.sql(READINGS_SQL, lineitem=lineitem)


def with_readings(body: str) -> str:
    """A DuckDB query over `readings`."""
    view = READINGS_SQL.format(lineitem="lineitem")
    return f"WITH RECURSIVE readings AS MATERIALIZED ({view})\n{body}"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return spark.sql(OBSERVATIONS_SQL, lineitem=lineitem)


def with_observations(body: str) -> str:
    """A DuckDB query over `observations`."""
    view = OBSERVATIONS_SQL.format(lineitem="lineitem")
    return f"WITH RECURSIVE observations AS MATERIALIZED ({view})\n{body}"
