"""Spark results against DuckDB, as sets of rows with exact values."""

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'"
        )
    return connection


def differences(result, connection, sql: str) -> list[str]:
    """What differs in columns, types or rows; empty when all is equal."""
    expected = connection.sql(sql)
    columns = sorted(result.columns)
    found = []
    if columns != sorted(expected.columns):
        return [f"columns {columns} != {sorted(expected.columns)}"]
    types = {c: str(t) for c, t in zip(expected.columns, expected.types)}
    spark_types = {f.name: f.dataType.simpleString() for f in result.schema}
    same = {
        "string": "VARCHAR",
        "double": "DOUBLE",
        "int": "INTEGER",
        "bigint": "BIGINT",
        "boolean": "BOOLEAN",
    }
    for c in columns:
        if same.get(spark_types[c]) != types[c]:
            found.append(f"type of {c}: {spark_types[c]} != {types[c]}")
    order = ", ".join(f'"{c}"' for c in columns)
    want = sorted(map(repr, expected.select(order).fetchall()))
    have = sorted(repr(tuple(r)) for r in result.select(*columns).collect())
    # -0.0 equals 0.0
    want = [w.replace("-0.0,", "0.0,").replace("-0.0)", "0.0)") for w in want]
    have = [h.replace("-0.0,", "0.0,").replace("-0.0)", "0.0)") for h in have]
    if len(want) != len(have):
        found.append(f"{len(have)} rows, expected {len(want)}")
    wrong = [(h, w) for h, w in zip(have, want) if h != w]
    if wrong:
        found.append(f"{len(wrong)} rows differ, first {wrong[0]}")
    return found
