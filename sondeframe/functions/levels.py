"""Numerics along a profile as window expressions over one ordering.

``w`` is a window of one profile ordered by height.  All of these share its
sort, so that any number of them costs one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def gradient(y: str, z: str, w: WindowSpec) -> Column:
    """Second-order differences on uneven heights, one-sided at the ends; null beside a null."""
    y0, y1, y2 = F.lag(y).over(w), F.col(y), F.lead(y).over(w)
    z0, z1, z2 = F.lag(z).over(w), F.col(z), F.lead(z).over(w)
    down, up = z1 - z0, z2 - z1
    inner = F.try_divide(down * down * y2 + (up * up - down * down) * y1 - up * up * y0, down * up * (down + up))
    row, n = F.row_number().over(w), F.count(F.lit(1)).over(_whole(w))
    return (
        F.when(n < 2, F.lit(None)).when(row == 1, F.try_divide(y2 - y1, up)).when(row == n, F.try_divide(y1 - y0, down)).otherwise(inner)
    )


def gradient_ratio(y: str, z: str, w: WindowSpec) -> Column:
    """Central difference of y over that of z; one-sided at the ends."""
    row, n = F.row_number().over(w), F.count(F.lit(1)).over(_whole(w))
    y0, z0 = F.when(row == 1, F.col(y)).otherwise(F.lag(y).over(w)), F.when(row == 1, F.col(z)).otherwise(F.lag(z).over(w))
    y2, z2 = F.when(row == n, F.col(y)).otherwise(F.lead(y).over(w)), F.when(row == n, F.col(z)).otherwise(F.lead(z).over(w))
    return F.try_divide(y2 - y0, z2 - z0)


def smooth5(y: str, w: WindowSpec) -> Column:
    """Mean of five with zeros beyond the ends; null if any of the rows there is null."""
    near = w.rowsBetween(-2, 2)
    return F.when(F.count(F.lit(1)).over(near) == F.count(y).over(near), F.sum(y).over(near) / 5)


def smooth3(y: str, w: WindowSpec) -> Column:
    """Mean of three, the end value repeated beyond the ends."""
    return (F.coalesce(F.lag(y).over(w), F.col(y)) + F.col(y) + F.coalesce(F.lead(y).over(w), F.col(y))) / 3


def local_maximum(y: str, w: WindowSpec) -> Column:
    """Strictly above two neighbours each way, as far as there are; ends never are."""
    x, a1, a2, b1, b2 = F.col(y), F.lag(y).over(w), F.lag(y, 2).over(w), F.lead(y).over(w), F.lead(y, 2).over(w)
    return F.coalesce((x > a1) & (x > F.coalesce(a2, a1)) & (x > b1) & (x > F.coalesce(b2, b1)), F.lit(False))


def trapezoid_term(y: str, x: str, w: WindowSpec) -> Column:
    """What a row adds to the integral of y over x; the sum over the rows is the integral."""
    return (F.col(y) + F.lead(y).over(w)) / 2 * (F.lead(x).over(w) - F.col(x))


def slope(y: Column, x: Column, least: int = 3) -> Column:
    """Regression slope as an aggregate; null with fewer than ``least`` pairs."""
    both = y.isNotNull() & x.isNotNull()
    return F.when(F.count(F.when(both, 1)) >= least, F.regr_slope(F.when(both, y), F.when(both, x)))


def first_argmax(value: Column, place: Column) -> Column:
    """The place of the largest value, of several the lowest; as an aggregate."""
    return F.min_by(F.when(value.isNotNull(), place), F.when(value.isNotNull(), F.struct((-value).alias("v"), place.alias("z"))))


def interpolated(y: str, z: str, target: float) -> Column:
    """Linear value at a height as an aggregate; null outside, and with fewer than two points."""
    ok = F.col(y).isNotNull() & F.col(z).isNotNull()
    low, high = ok & (F.col(z) <= target), ok & (F.col(z) >= target)
    z0, y0 = F.max(F.when(low, F.col(z))), F.max_by(F.when(low, F.col(y)), F.when(low, F.col(z)))
    z1, y1 = F.min(F.when(high, F.col(z))), F.min_by(F.when(high, F.col(y)), F.when(high, F.col(z)))
    inside = F.when(z0 == z1, y0).otherwise(y0 + F.try_divide((y1 - y0) * (F.lit(target) - z0), z1 - z0))
    return F.when(F.count(F.when(ok, 1)) >= 2, inside)


def _whole(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def islands(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Runs of consecutive integers in ``value``: first, last and length, by key."""
    w = Window.partitionBy(*keys).orderBy(order) if keys else Window.partitionBy(F.lit(0)).orderBy(order)
    numbered = df.withColumn("_run", F.col(value) - F.row_number().over(w))
    return (
        numbered.groupBy(*keys, "_run").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("length")).drop("_run")
    )
