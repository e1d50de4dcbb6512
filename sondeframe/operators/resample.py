"""Resampling of profiles on a common height grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sondeframe.functions.levels import interpolated
from sondeframe.functions.physics import components, direction, speed

LEAST_POINTS = 4


def height_grid(spark: SparkSession, low: float = 0.0, high: float = 14_900.0, step: float = 100.0) -> DataFrame:
    """(g_idx, z), both ends included."""
    n = int(round((high - low) / step)) + 1
    return spark.range(n).select(F.col("id").cast("int").alias("g_idx"), (F.lit(low) + F.col("id") * step).alias("z"))


def interpolate(levels: DataFrame, grid: DataFrame, variables: list[str]) -> DataFrame:
    """(profile_id, g_idx, altitude, variables): linear in height, null outside the valid points.

    A variable with fewer than LEAST_POINTS valid points in the profile is null.
    Grid points and levels are sorted together once; the nearest valid level on
    either side is a running last and first.
    """
    marks = levels.filter("altitude is not null").select("profile_id", F.col("altitude").cast("double").alias("z"), F.lit(None).cast("int").alias("g_idx"), *variables)
    points = (
        levels.select("profile_id").distinct().crossJoin(F.broadcast(grid))  # the grid is bounded by its step
        .select("profile_id", F.col("z").cast("double").alias("z"), "g_idx", *[F.lit(None).cast("double").alias(v) for v in variables])
    )
    w = Window.partitionBy("profile_id").orderBy("z", F.col("g_idx").asc_nulls_first())
    below, above = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    everywhere = Window.partitionBy("profile_id")
    rows = marks.unionByName(points)
    columns = {}
    for v in variables:
        pair = F.when(F.col(v).isNotNull(), F.struct(F.col("z").alias("z"), F.col(v).alias("y")))
        lo, hi = F.last(pair, ignorenulls=True).over(below), F.first(pair, ignorenulls=True).over(above)
        columns[f"_lo_{v}"], columns[f"_hi_{v}"] = lo, hi
        columns[f"_n_{v}"] = F.count(v).over(everywhere)
    rows = rows.withColumns(columns).filter("g_idx is not null")
    values = []
    for v in variables:
        lo, hi = F.col(f"_lo_{v}"), F.col(f"_hi_{v}")
        line = F.when(lo["z"] == F.col("z"), lo["y"]).otherwise(lo["y"] + F.try_divide(hi["y"] - lo["y"], hi["z"] - lo["z"]) * (F.col("z") - lo["z"]))
        values.append(F.when(F.col(f"_n_{v}") >= LEAST_POINTS, line).alias(v))
    return rows.select("profile_id", "g_idx", F.col("z").alias("altitude"), *values)


def resample(levels: DataFrame, grid: DataFrame) -> DataFrame:
    """t, td, p_niv and the wind on the grid; the wind goes through its components."""
    u, v = components("ff", "dd")
    out = interpolate(levels.withColumn("u", u).withColumn("v", v), grid, ["t", "td", "p_niv", "u", "v"])
    return out.withColumn("ff", speed("u", "v")).withColumn("dd", direction("u", "v"))


def at_heights(levels: DataFrame, variables: list[str], heights: list[float], z: str = "altitude") -> DataFrame:
    """A column v_z for each variable and height: bracketing aggregates, no sort."""
    return levels.groupBy("profile_id").agg(*[interpolated(v, z, h).alias(f"{v}_{h:g}") for v in variables for h in heights])


def pressure_warning(resampled: DataFrame) -> DataFrame:
    """(profile_id, rising): whether pressure rises anywhere on the grid."""
    w = Window.partitionBy("profile_id").orderBy("g_idx")
    return resampled.filter("p_niv is not null").withColumn("_d", F.col("p_niv") - F.lag("p_niv").over(w)).groupBy("profile_id").agg(
        F.coalesce(F.bool_or(F.col("_d") > 0), F.lit(False)).alias("rising")
    )
