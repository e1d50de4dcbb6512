"""As-of joins: for each row the nearest one in time of another table, before, after or either way.

Time is cut into buckets, so that the history of one station is many groups.  A
bucket gets, besides its own rows, one look-back row (the last before it) and one
look-ahead row (the first after it), found among a row a bucket.  Inside a
bucket both tables' rows lie in one order, and a running window carries the
last row of the right table to the left one's: no pair of rows is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, direction: str = "before", tolerance: float | None = None,
              ties: list[str] | None = None, bucket: float = 86_400.0) -> DataFrame:
    """All rows of ``left`` with the columns of ``right`` (but ``by``) of the nearest row, or nulls, and ``distance`` in seconds.

    ``direction`` is before (at the same time or earlier), after (at the same time or later) or
    nearest (of equally near ones the earlier).  A row farther than ``tolerance``
    seconds is none.  Of rows at one time the first by ``ties`` is taken.  Null
    keys and times meet nothing.  ``bucket`` is the length of a group in seconds.
    """
    if direction not in ("before", "after", "nearest"):
        raise ValueError(f"unknown direction: {direction}")
    others = [c for c in right.columns if c not in by]
    clash = sorted(set(others) & set(left.columns))
    if clash or "distance" in left.columns + others:
        raise ValueError(f"columns of both tables: {clash or ['distance']}")
    width = int(bucket * 1_000_000)
    place = F.floor(F.col("_t") / width)
    keys = [F.col(k).isNotNull() for k in by]
    known = F.lit(True)
    for k in keys:
        known = known & k
    order = F.struct(*[F.col(c) for c in ties or []]) if ties else F.lit(0)
    own = left.select(*by, _micros(left_time).alias("_t"), F.struct(*left.columns).alias("_l")).withColumn("_b", place)
    rows = right.filter(known & F.col(right_time).isNotNull()).select(*by, _micros(right_time).alias("_t"), order.alias("_tie"), F.struct(*others).alias("_r")).withColumn("_b", place)
    entry = F.struct("_t", "_tie", "_r")
    ends = rows.groupBy(*by, "_b").agg(F.min_by(entry, F.struct((-F.col("_t")).alias("a"), F.col("_tie").alias("b"))).alias("_last"), F.min_by(entry, F.struct("_t", "_tie")).alias("_first"))
    # carried rows, for buckets that have rows of the left table
    marks = own.filter(known & F.col("_b").isNotNull()).select(*by, "_b").distinct().select(*by, "_b", F.lit(True).alias("_asked")).unionByName(ends, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_b")
    back = F.last("_last", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, -1))
    ahead = F.first("_first", ignorenulls=True).over(w.rangeBetween(1, Window.unboundedFollowing))
    carried = marks.select(*by, "_b", "_asked", F.array(back, ahead).alias("_c")).filter("_asked").select(*by, "_b", F.explode("_c").alias("_c")).filter("_c is not null").select(*by, "_b", "_c.*")
    both = rows.unionByName(carried).withColumn("_side", F.lit(0)).unionByName(own.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    seen = F.when(F.col("_side") == 0, F.struct("_t", "_r"))
    group = Window.partitionBy(*by, "_b")
    worst_tie_first = [F.col("_tie").desc()]
    before = F.last(seen, ignorenulls=True).over(group.orderBy("_t", "_side", *worst_tie_first))
    after = F.last(seen, ignorenulls=True).over(group.orderBy(F.col("_t").desc(), "_side", *worst_tie_first))
    found = both
    if direction != "after":
        found = found.withColumn("_before", before)
    if direction != "before":
        found = found.withColumn("_after", after)
    found = found.filter("_side = 1")
    if direction == "nearest":
        near = F.when(F.col("_before").isNull() | (F.col("_after")["_t"] - F.col("_t") < F.col("_t") - F.col("_before")["_t"]), F.col("_after")).otherwise(F.col("_before"))
    else:
        near = F.col(f"_{direction}")
    valid = known & F.col("_t").isNotNull()
    found = found.withColumn("_near", F.when(valid, near))
    gap = F.abs(F.col("_t") - F.col("_near")["_t"]) / 1_000_000
    if tolerance is not None:
        found = found.withColumn("_near", F.when(gap <= tolerance, F.col("_near")))
    return found.select("_l.*", *[F.col("_near")["_r"][c].alias(c) for c in others], gap.alias("distance"))
