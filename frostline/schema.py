"""Table schemas and the fixed values every result depends on."""

from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)

# One row per reading. `date` stays text (YYYY-MM-DD) and `value` is always a
# double, so neither CSV nor Parquet reads ever infer a type.
OBSERVATION = StructType(
    [
        StructField("date", StringType()),
        StructField("datatype", StringType()),
        StructField("station", StringType()),
        StructField("value", DoubleType()),
    ]
)

# One landed API response: the request it answers and the records it carries.
PAGE = StructType(
    [
        StructField("station", StringType()),
        StructField("year", IntegerType()),
        StructField("offset", IntegerType()),
        StructField("results", ArrayType(OBSERVATION)),
    ]
)

# Friendly names of the known stations.
STATION_NAMES = {
    "GHCND:USC00351862": "Corvallis",
    "GHCND:USW00024221": "Eugene",
    "GHCND:USW00024232": "Salem",
}

# Thresholds and windows of the reports.
FREEZING = 32.0
SPRING_MONTHS = (3, 6)
FALL_MONTHS = (7, 11)
FIRST_FIT_YEAR = 1980.0
FULL_PAGE = 1000
TREND_WINDOW = 3652
TREND_MIN_ROWS = 1826
