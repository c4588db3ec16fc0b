"""Series of any length, without a task that holds a whole one.

A window partitioned by station sorts the whole station in one task. `number_rows` gives
every reading its place in its series; `into_blocks` then cuts the series into overlapping
blocks of consecutive rows, so that a window partitioned by (station, block) sees every row
it needs and no task sees more than a block. All series take this way.
"""

from pyspark.sql import DataFrame

from frostline.operators.rolling import window_reach

# Consecutive rows of a series that form one block.
BLOCK_ROWS = 250_000


def number_rows(
    rows: DataFrame, by: str, date: str, value: str, extra: tuple[str, ...] = ()
) -> DataFrame:
    """Number the rows of each series by (date, value) without sorting it whole.

    Copies of a row are folded first. Counts are then accumulated over two nested levels,
    the dates of the series and the distinct readings of one date, so no window spans
    more: a series has one row per date, as many as the calendar has, and a date of a
    station as many rows as it has different readings. Neither `by` nor `date` may be null, and `value` has to be read
    rather than computed: were a sum to come out differently in a second try of a
    lost task, its unit might change, and the job would stop instead of losing rows.

    One row per distinct reading comes back, with
      _n        its number of copies,
      _pos      the position of the first copy in the series,
      _index    the same, counting only rows whose value is not null,
      _length   the number of rows of the series whose value is not null,
      _rows     the number of all its rows,
      _special  the sum of the values that are NaN or infinite, else null.
    """
    reading = ", ".join([by, date, value, *extra])
    order = ", ".join([value, *extra])
    counts = "sum(_n) AS _n, sum(_m) AS _m, sum(_special) AS _special"
    # Every row finds its match; the left join infers no extra filters, so both uses of
    # `readings` stay alike and share one shuffle.
    return rows.sparkSession.sql(
        f"""
        WITH readings AS (
          SELECT {reading}, count(*) AS _n,
            CASE WHEN {value} IS NULL THEN 0 ELSE count(*) END AS _m,
            CASE WHEN isnan({value}) OR abs({value}) = double('Infinity')
              THEN {value} END AS _special
          FROM {{rows}} GROUP BY {reading}),
        days AS (SELECT {by}, {date}, {counts} FROM readings GROUP BY {by}, {date}),
        starts AS (
          SELECT {by}, {date},
            coalesce(sum(_n) OVER earlier, 0) AS _n_day,
            coalesce(sum(_m) OVER earlier, 0) AS _m_day,
            sum(_m) OVER series AS _length, sum(_n) OVER series AS _rows,
            sum(_special) OVER series AS _all
          FROM days
          WINDOW series AS (PARTITION BY {by}),
            earlier AS (PARTITION BY {by} ORDER BY {date}
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT {reading}, _n,
          coalesce(_n_day, raise_error('a reading changed while it was numbered'))
            + coalesce(sum(_n) OVER earlier, 0) AS _pos,
          _m_day + coalesce(sum(_m) OVER earlier, 0) AS _index,
          _length, _rows, _all AS _special
        FROM readings r LEFT JOIN starts s USING ({by}, {date})
        WINDOW earlier AS (PARTITION BY {by}, {date} ORDER BY {order}
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        """,
        rows=rows,
    )


def into_blocks(
    readings: DataFrame,
    by: str,
    value: str,
    start: str = "_pos",
    before: int = 0,
    after: int = 0,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Unfold numbered readings into rows, shuffled by (series, block).

    Rows are cut into blocks by the numbering `start`, `_pos` or `_index`. Block b
    also gets the rows from `before` rows ahead of it to `after` rows behind it,
    so its windows are complete; `_home` is true for the one copy of a row that
    carries its result. The size of a block grows with these margins, so a row is
    repeated twice at most. A reading with many copies is first cut at the borders
    of blocks and unfolded after the shuffle. What is shuffled may be far smaller than the
    blocks, so the number of partitions is given: Spark would merge them by their bytes.
    """
    size = max(block_rows, before, after)
    numbers = ("_n", "_pos", "_index")
    kept = [c for c in readings.columns if c not in numbers]
    partitions = int(readings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first_block = f"floor(greatest({start} - {after}, 0) / {size})"
    last_block = f"floor(({start} + _n - 1 + {before}) / {size})"
    first_copy = f"greatest(0, _block * {size} - {before} - {start})"
    last_copy = f"least(_n, (_block + 1) * {size} + {after} - {start}) - 1"
    return (
        readings.selectExpr(
            "*", f"explode(sequence({first_block}, {last_block})) AS _block"
        )
        .repartition(partitions, by, "_block")
        .selectExpr("*", f"explode(sequence({first_copy}, {last_copy})) AS _copy")
        .selectExpr(
            *kept,
            "1L AS _n",
            "_pos + _copy AS _pos",
            f"_index + if({value} IS NULL, 0, _copy) AS _index",
            "_block",
            f"_block = floor(({start} + _copy) / {size}) AS _home",
        )
    )


def blocks_for(
    readings: DataFrame, by: str, value: str, window: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Blocks by position, with the margins of a centred window that is not wider than a block.
    Wider windows are put together from blocks without margins."""
    before, after = window_reach(window) if window <= block_rows else (0, 0)
    return into_blocks(readings, by, value, "_pos", before, after, block_rows)


def home_rows(rows: DataFrame) -> DataFrame:
    """Drop the margins again."""
    return rows.where("_home").drop("_home")
