"""The feature matrix in long form (profile_id, var, g_idx, val): imputation and scaling.

Long form keeps column statistics native aggregates at any width; ``vectors``
packs it for Spark ML.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondeframe.functions import physics as P
from sondeframe.operators.quantiles import quantiles

COLUMN = ("var", "g_idx")
LEAST_RANGE = 1e-6
LEAST_SCALE = 1e-8
#: Features that are 0 where they don't exist; fixed values.
ZERO_FEATURES = ("inversion_strength", "inversion_height", "jet_nose_speed", "jet_nose_height", "max_grad_0_500")


def build_matrix(resampled: DataFrame, variables: list[str] | None = None, anomaly: bool = False) -> DataFrame:
    """Long matrix of grid variables; u, v are meteorological, t-td the depression.

    With ``anomaly`` t and td are taken from the dry adiabat of the lowest
    level.  A variable that isn't there gives nulls.
    """
    variables = variables or ["t", "td", "t-td", "u", "v"]
    u, v = P.components("ff", "dd", -1)
    rows = resampled.withColumn("level_idx", F.col("g_idx").cast("long"))
    base = P.dry_adiabat() if anomaly else F.lit(0.0)
    known = {"t": F.col("t") - base, "td": F.col("td") - base, "t-td": F.col("t") - F.col("td"), "u": u, "v": v}
    pairs = F.array(*[
        F.struct(F.lit(name).alias("var"), (known[name] if name in known else F.col(name) if name in resampled.columns else F.lit(None)).cast("double").alias("val"))
        for name in variables
    ])
    return rows.withColumn("_pairs", pairs).select("profile_id", "g_idx", F.explode("_pairs").alias("x")).select("profile_id", "x.var", "g_idx", "x.val")


def feature_matrix(features: DataFrame, id_col: str = "profile_id") -> DataFrame:
    """A wide feature table in long form; g_idx is the column's number."""
    names = [c for c in features.columns if c != id_col]
    pairs = F.array(*[F.struct(F.lit(n).alias("var"), F.lit(k).alias("g_idx"), F.col(n).cast("double").alias("val")) for k, n in enumerate(names)])
    return features.select(F.col(id_col).alias("profile_id"), F.explode(pairs).alias("x")).select("profile_id", "x.var", "x.g_idx", "x.val")


def column_names(matrix: DataFrame, grid: DataFrame) -> DataFrame:
    """(var, g_idx, name): names like t_z500."""
    return matrix.select(*COLUMN).distinct().join(F.broadcast(grid), "g_idx").select("var", "g_idx", F.format_string("%s_z%s", "var", F.col("z").cast("long")).alias("name"))


def _fills(matrix: DataFrame, strategy: str) -> DataFrame:
    """(var, g_idx, fill) of the columns that have a value."""
    if strategy == "mean":
        return matrix.groupBy(*COLUMN).agg(F.avg("val").alias("fill"))
    if strategy == "median":
        return quantiles(matrix, list(COLUMN), "val", [0.5]).select(*COLUMN, F.col("q")[0].alias("fill"))
    if strategy == "most_frequent":
        return _most_frequent(matrix)
    raise ValueError(f"unknown strategy: {strategy}")


def _most_frequent(matrix: DataFrame) -> DataFrame:
    counts = matrix.filter("val is not null").groupBy(*COLUMN, "val").agg(F.count("*").alias("n"))
    return counts.groupBy(*COLUMN).agg(F.min_by("val", F.struct((-F.col("n")).alias("n"), "val")).alias("fill"))


def impute(matrix: DataFrame, strategy: str) -> DataFrame:
    """Nulls filled by their column's mean, median or most_frequent; ``drop`` drops the profile.

    A column without any value is left out.  The statistics join back by
    column, which is a small table beside the matrix.
    """
    if strategy == "drop":
        whole = matrix.groupBy("profile_id").agg(F.bool_and(F.col("val").isNotNull()).alias("ok")).filter("ok").select("profile_id")
        return matrix.join(whole, "profile_id", "left_semi")
    filled = matrix.join(_fills(matrix, strategy).filter("fill is not null"), list(COLUMN))
    return filled.select("profile_id", *COLUMN, F.coalesce("val", "fill").alias("val"))


def impute_features(matrix: DataFrame, zero: tuple[str, ...] = ZERO_FEATURES) -> DataFrame:
    """0 for the features of a list, the exact median for the others."""
    zeroed = matrix.withColumn("val", F.when(F.col("var").isin(*zero), F.coalesce("val", F.lit(0.0))).otherwise(F.col("val")))
    return impute(zeroed, "median")


def standardise(matrix: DataFrame) -> DataFrame:
    """Column z-scores with the population deviation; a constant column becomes 0."""
    facts = matrix.groupBy(*COLUMN).agg(F.avg("val").alias("_m"), F.stddev_pop("val").alias("_s"))
    scale = F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))
    return matrix.join(facts, list(COLUMN)).select("profile_id", *COLUMN, ((F.col("val") - F.col("_m")) / scale).alias("val"))


def scale_shape(matrix: DataFrame, variables: list[str] | None = None, everywhere: bool = False) -> DataFrame:
    """Min-max by profile and variable, or by variable over all profiles; a flat range gives 0.5.

    Variables not named stay as they are.
    """
    keys = ["var"] if everywhere else ["profile_id", "var"]
    if everywhere:
        low = matrix.groupBy("var").agg(F.min("val").alias("_lo"), F.max("val").alias("_hi"))
        rows = matrix.join(F.broadcast(low), "var")  # a row a variable
    else:
        w = Window.partitionBy(*keys)
        rows = matrix.withColumn("_lo", F.min("val").over(w)).withColumn("_hi", F.max("val").over(w))
    width = F.col("_hi") - F.col("_lo")
    scaled = F.when(F.col("val").isNull(), F.lit(None)).when(width <= LEAST_RANGE, 0.5).otherwise((F.col("val") - F.col("_lo")) / width)
    named = F.lit(True) if variables is None else F.col("var").isin(*variables)
    return rows.select("profile_id", *COLUMN, F.when(named, scaled).otherwise(F.col("val")).alias("val"))


def scale_block(matrix: DataFrame, variables: list[str] | None = None, method: str = "std") -> DataFrame:
    """Every variable's block by one scale.

    ``std``: the root of the mean of its levels' population variances; ``z``:
    the same after the block's mean; ``max``: its largest magnitude.  A scale of
    LEAST_SCALE or less leaves the block unscaled.
    """
    if method not in ("std", "z", "max"):
        raise ValueError(f"unknown method: {method}")
    if variables is not None:
        missing = set(variables) - {r["var"] for r in matrix.select("var").distinct().collect()}
        if missing:
            raise ValueError(f"unknown variables: {sorted(missing)}")
    levels = matrix.groupBy(*COLUMN).agg(F.var_pop("val").alias("v"), F.sum("val").alias("s"), F.count("val").alias("n"), F.max(F.abs("val")).alias("m"))
    blocks = levels.groupBy("var").agg(F.sqrt(F.avg("v")).alias("_std"), (F.sum("s") / F.sum("n")).alias("_mean"), F.max("m").alias("_max"))
    scale = F.col("_max") if method == "max" else F.col("_std")
    centre = F.col("_mean") if method == "z" else F.lit(0.0)
    divided = F.when(scale > LEAST_SCALE, (F.col("val") - centre) / scale).otherwise(F.col("val") - centre)
    named = F.lit(True) if variables is None else F.col("var").isin(*variables)
    return matrix.join(F.broadcast(blocks), "var").select("profile_id", *COLUMN, F.when(named, divided).otherwise(F.col("val")).alias("val"))


def vectors(matrix: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(profile_id, features): a row's values by variable, in the order given, and level."""
    place = F.array_position(F.array(*[F.lit(v) for v in order]), F.col("var")) if order else F.col("var")
    packed = matrix.groupBy("profile_id").agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), "g_idx", "val"))).alias("x"))
    return packed.select("profile_id", array_to_vector(F.transform("x", lambda r: r["val"])).alias("features"))


def blocks(matrix: DataFrame, variables: list[str]) -> DataFrame:
    """The rows of some variables."""
    return matrix.filter(F.col("var").isin(*variables))
