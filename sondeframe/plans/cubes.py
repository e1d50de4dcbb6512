"""Profiles by station, month and cluster: landed sketches that any coarser table is rolled up from.

A cell keeps counts and sums beside a sketch of the distinct values that it has seen.
Sketches merge without the levels, so that a new month adds its cells and the
cube of all dimensions reads cells alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of a sketch's buckets: a relative standard error of about 1.04 / 2**(LG_K / 2).
LG_K = 12
DIMENSIONS = ("station", "month", "cluster")


def relative_error(lg_k: int = LG_K) -> float:
    """The standard error of an estimate, as a share of it."""
    return 1.04 / 2 ** (lg_k / 2)


def cells(rows: DataFrame, value: str, distinct: str, dimensions: tuple[str, ...] = DIMENSIONS, lg_k: int = LG_K) -> DataFrame:
    """(dimensions..., n, n_values, total, least, largest, seen): a row a cell; seen is the sketch of ``distinct``."""
    return rows.groupBy(*dimensions).agg(
        F.count("*").alias("n"), F.count(value).alias("n_values"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("largest"),
        F.hll_sketch_agg(F.col(distinct), F.lit(lg_k)).alias("seen"),
    )


def land_cells(table: DataFrame, path: str, by: str = "month") -> None:
    """Write cells in a folder a month; the months of ``table`` replace those that are there."""
    spark = table.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        table.repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def roll_up(table: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """(dimensions..., level, n, n_values, mean, least, largest, n_distinct) over all subsets of the dimensions.

    A dimension that is summed over is null; ``level`` has a bit for each of
    these, the first dimension's the highest.  n_distinct is an estimate.
    """
    cube = table.cube(*dimensions).agg(
        F.grouping_id().cast("int").alias("level"), F.sum("n").alias("n"), F.sum("n_values").alias("n_values"), F.sum("total").alias("_total"), F.min("least").alias("least"),
        F.max("largest").alias("largest"), F.hll_union_agg("seen").alias("_seen"),
    )
    return cube.select(*dimensions, "level", "n", "n_values", F.try_divide("_total", "n_values").alias("mean"), "least", "largest", F.hll_sketch_estimate("_seen").alias("n_distinct"))
