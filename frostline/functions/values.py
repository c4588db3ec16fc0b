"""Column functions over readings."""

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def mean_of_extremes(high: Column, low: Column) -> Column:
    return (high + low) / 2.0


def polynomial(coefficients: list[Column], t: Column) -> Column:
    """c0 + c1 t + c2 t^2 + ... by Horner's rule."""
    return reduce(lambda acc, c: acc * t + c, reversed(coefficients))


def ema_weight(span: int) -> float:
    """The weight a new sample gets in an exponential mean of this span."""
    return 2.0 / (span + 1.0)


def ema_rows(span: int, decay: float) -> int:
    """Rows after which the weight of a sample has fallen to e^-decay."""
    return max(1, math.ceil(decay / -math.log1p(-ema_weight(span))))
