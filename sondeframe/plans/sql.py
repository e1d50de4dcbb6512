"""Profiles in SQL: views of the tables, and table functions over them.

``pressure_check(TABLE(levels))`` and ``parcel_temperature(TABLE(levels))`` say
themselves that they need a profile's rows together and in which order, so that a
query needs no PARTITION BY; they keep a profile's running state alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from sondeframe.functions import physics as P
from sondeframe.functions.parcel import Parcel
from sondeframe.operators.qc import DENSE


def _needs(table: AnalyzeArgument, *columns: str) -> StructType:
    if not table.isTable:
        raise ValueError("the first argument is TABLE(levels)")
    missing = set(columns) - set(table.dataType.names)
    if missing:
        raise ValueError(f"the table has no {sorted(missing)}")
    return table.dataType


@udtf
class PressureCheck:
    """A row a profile: levels by height whose pressure is above any before them."""

    @staticmethod
    def analyze(levels: AnalyzeArgument) -> AnalyzeResult:
        kind = _needs(levels, "profile_id", "altitude", "level_idx", "p_niv")["profile_id"].dataType
        schema = (
            StructType().add("profile_id", kind).add("total_points", LongType()).add("violations", LongType()).add("violation_ratio", DoubleType())
            .add("violation_type", StringType()).add("violation_idx", ArrayType(LongType()))
        )
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("profile_id")], orderBy=[OrderingColumn("altitude", overrideNullsFirst=False), OrderingColumn("level_idx")])

    def __init__(self) -> None:
        self.profile, self.n, self.least, self.bad = None, 0, None, []

    def eval(self, levels):
        p = levels["p_niv"]
        self.profile = levels["profile_id"]
        if p is not None:
            if self.least is not None and p > self.least:
                self.bad.append(self.n)
            self.least = p if self.least is None else min(self.least, p)
        self.n += 1

    def terminate(self):
        ratio = len(self.bad) / self.n if self.n else 0.0
        yield self.profile, self.n, len(self.bad), ratio, "none" if not self.bad else "sparse" if ratio < DENSE else "dense", self.bad


@udtf
class ParcelTemperature:
    """The parcel of a profile's lowest level at each level that has pressure and temperature."""

    @staticmethod
    def analyze(levels: AnalyzeArgument) -> AnalyzeResult:
        kind = _needs(levels, "profile_id", "level_idx", "p_niv", "t", "td")["profile_id"].dataType
        schema = StructType().add("profile_id", kind).add("level_idx", LongType()).add("parcel_t", DoubleType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("profile_id")], orderBy=[OrderingColumn("p_niv", ascending=False, overrideNullsFirst=False), OrderingColumn("level_idx")])

    def __init__(self) -> None:
        self.began, self.parcel = False, None

    def eval(self, levels):
        p, t, td = levels["p_niv"], levels["t"], levels["td"]
        if p is None or t is None:
            return
        if not self.began:
            self.began = True
            self.parcel = None if td is None else Parcel(t, td, p, P.KAPPA)
        yield levels["profile_id"], levels["level_idx"], None if self.parcel is None else self.parcel.at(p)


def register(spark: SparkSession, **tables: DataFrame) -> None:
    """The table functions, and a temporary view for each table by its name."""
    spark.udtf.register("pressure_check", PressureCheck)
    spark.udtf.register("parcel_temperature", ParcelTemperature)
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
