"""Least-squares polynomials per series, from sums that are combined before their shuffle."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.functions.values import polynomial

# Fixed value: a smaller pivot means that the points do not determine the polynomial.
SINGULAR = 1e-12
# Length of the stretches of x whose powers are summed about their middle.
STRETCH = 64.0


def polynomial_coefficients(
    points: DataFrame, by: str, x: str, y: str, degree: int
) -> DataFrame:
    """One row per series: center, c0 ... c<degree> of y over t = x - center.

    The coefficients are null where the series has no more than `degree` points
    or where its points are degenerate.
    """
    rows = _solve(_sums(points, by, x, y, degree), degree)
    return rows.selectExpr(by, "center", *[f"_c{k} AS c{k}" for k in range(degree + 1)])


def with_polynomial_fit(
    points: DataFrame, by: str, x: str, y: str, degree: int, out: str
) -> DataFrame:
    """Add the fitted value at `x`; null where x is null or there is no fit.

    Only points whose x is not null take part. Each series has one row of coefficients,
    which is joined to its points.
    """
    fits = polynomial_coefficients(points, by, x, y, degree).withColumnRenamed(by, "_by")
    coefficients = [F.col(f"c{k}") for k in range(degree + 1)]
    return points.join(fits, F.col(by).eqNullSafe(F.col("_by")), "left").select(
        *points.columns, polynomial(coefficients, F.col(x) - F.col("center")).alias(out)
    )


def with_period_fit(
    points: DataFrame, by: str, x: str, y: str, degree: int, out: str
) -> DataFrame:
    """As with_polynomial_fit, for points grouped by (series, year): the calendar bounds such a
    series, so windows gather its sums and the points are neither read again nor joined."""
    whole = f"OVER (PARTITION BY {by})"
    sums = [f"{text} {whole} AS {name}" for name, text in _moments(y, degree).items()]
    rows = points.selectExpr("*", f"avg({x}) {whole} AS center").selectExpr("*", f"{x} - center AS _t")
    rows = _solve(rows.selectExpr("*", *sums), degree)
    coefficients = [F.col(f"_c{k}") for k in range(degree + 1)]
    return rows.select(*points.columns, polynomial(coefficients, F.col("_t")).alias(out))


def _sums(points: DataFrame, by: str, x: str, y: str, degree: int) -> DataFrame:
    """Moments about the mean of x: years near 2000 have huge powers, their distances from
    the mean do not. One pass over the points sums powers about the middle of a stretch of x
    near each; the stretches of a series, a few rows, are then moved to its mean by the
    binomial rule."""
    sums = [f"{text} AS {name}" for name, text in _moments(y, degree).items()]
    stretches = (
        points.selectExpr(by, y, x, f"{STRETCH!r}D * rint({x} / {STRETCH!r}D) AS _middle")
        .selectExpr(by, y, "_middle", f"{x} - _middle AS _t")
        .groupBy(by, "_middle")
        .agg(*map(F.expr, sums))
    )
    whole = f"OVER (PARTITION BY {by})"
    moved = stretches.selectExpr(
        "*", f"sum(_middle * _t0 + _t1) {whole} / sum(_t0) {whole} AS center"
    ).selectExpr("*", "_middle - center AS _d")
    about_center = {}
    for name, highest in (("_t", 2 * degree), ("_y", degree)):
        for k in range(highest + 1):
            terms = [
                " * ".join([f"{math.comb(k, j)}D", *["_d"] * (k - j), f"{name}{j}"]) for j in range(k + 1)
            ]
            about_center[f"{name}{k}"] = " + ".join(terms)
    totals = [F.expr(f"sum({text}) AS {name}") for name, text in about_center.items()]
    return moved.groupBy(by).agg(F.max("center").alias("center"), *totals)


def _moments(y: str, degree: int) -> dict[str, str]:
    """Sums of t^k for k up to 2*degree and of y t^k for k up to degree."""
    powers = ["CASE WHEN _t IS NOT NULL THEN 1D END"]
    powers += [" * ".join(["_t"] * k) for k in range(1, max(2 * degree, 1) + 1)]
    sums = {f"_t{k}": f"sum({power})" for k, power in enumerate(powers)}
    sums |= {f"_y{k}": f"sum({y} * {powers[k]})" for k in range(degree + 1)}
    return sums


def _solve(rows: DataFrame, degree: int) -> DataFrame:
    """Solve the normal equations of each row by L D L^T elimination.

    Sums of powers of distinct points form a positive definite matrix, so no
    rows need to be exchanged. Each step adds columns that the next one reads.
    """
    size = degree + 1
    matrix = {(i, j): f"_t{i + j}" for i in range(size) for j in range(i + 1)}
    right = [f"_y{i}" for i in range(size)]
    usable = f"_t0 >= {size}"
    for k in range(size):
        pivot = matrix[k, k]
        rows = rows.selectExpr(
            "*",
            f"CASE WHEN {usable} AND NOT abs({pivot}) < {SINGULAR!r}D THEN {pivot} END "
            f"AS _pivot{k}",
        )
        usable = f"_pivot{k} IS NOT NULL"
        below = range(k + 1, size)
        rows = rows.selectExpr(
            "*",
            f"{right[k]} / _pivot{k} AS _d{k}",
            *[f"{matrix[i, k]} / _pivot{k} AS _l{i}{k}" for i in below],
        )
        reduced = []
        for i in below:
            for j in range(k + 1, i + 1):
                reduced.append(
                    f"{matrix[i, j]} - _l{i}{k} * {matrix[j, k]} AS _m{i}{j}_{k}"
                )
                matrix[i, j] = f"_m{i}{j}_{k}"
            reduced.append(f"{right[i]} - _l{i}{k} * {right[k]} AS _r{i}_{k}")
            right[i] = f"_r{i}_{k}"
        if reduced:
            rows = rows.selectExpr("*", *reduced)
    for k in reversed(range(size)):
        known = [f"_l{i}{k} * _c{i}" for i in range(k + 1, size)]
        rows = rows.selectExpr("*", f"{' - '.join([f'_d{k}', *known])} AS _c{k}")
    return rows
