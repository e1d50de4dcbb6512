"""Canonical tables; every number is a nullable double and NaN is never stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VARIABLES = ("altitude", "p_niv", "t", "td", "dd", "ff")

PROFILES = T.StructType([
    T.StructField("profile_id", T.StringType()),
    T.StructField("profile_seq", T.LongType()),
    T.StructField("file", T.StringType()),
    T.StructField("station", T.StringType()),
    T.StructField("date", T.TimestampType()),
    T.StructField("nb_niv", T.IntegerType()),
    T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
])

LEVELS = T.StructType(
    [T.StructField("profile_id", T.StringType()), T.StructField("level_idx", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in (*VARIABLES, "dep_lat", "dep_lon")]
)

CIS_LEVELS = T.StructType([
    T.StructField("profile_id", T.StringType()),
    T.StructField("row_idx", T.LongType()),
    T.StructField("values", T.MapType(T.StringType(), T.DoubleType())),
])


def number(column: Column | str) -> Column:
    """A double; what is no number, and NaN, becomes null."""
    value = F.col(column) if isinstance(column, str) else column
    return F.nanvl(value.try_cast("double"), F.lit(None).cast("double"))


def without_nan(df: DataFrame) -> DataFrame:
    """df with NaN replaced by null in every float column."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in df.columns if kinds[c] in ("double", "float")})


def height_alias(df: DataFrame) -> DataFrame:
    """One ``altitude`` column from its aliases; of several the later wins: ``0``, geop, altitude."""
    names = [c for c in ("0", "geop", "altitude") if c in df.columns]
    if not names:
        raise ValueError("no height column: altitude, geop or 0")
    return df.withColumn("altitude", F.coalesce(*[F.col(f"`{c}`") for c in names])).drop(*[c for c in names if c != "altitude"])
