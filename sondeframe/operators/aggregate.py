"""Statistics across profiles: per level, per cluster and per table."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondeframe.functions import physics as P
from sondeframe.functions.levels import first_argmax, gradient
from sondeframe.operators.quantiles import with_quantiles

LEAST_INVERSION = 2.0


def _by_height():
    return Window.partitionBy("profile_id").orderBy(F.col("altitude").asc_nulls_last(), "level_idx")


def check_same_grid(resampled: DataFrame) -> None:
    """An error unless every profile has the same number of levels, and there is one."""
    row = resampled.groupBy("profile_id").count().agg(F.min("count").alias("a"), F.max("count").alias("b")).first()
    if row["a"] is None:
        raise ValueError("no profiles")
    if row["a"] != row["b"]:
        raise ValueError("profiles differ in size")


def mean_profile(resampled: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means of t, td and p_niv by level, and the vector mean of the wind."""
    u, v = P.components("ff", "dd", -1)
    means = resampled.groupBy(*(by or []), "g_idx").agg(
        F.first("altitude").alias("altitude"), *[F.avg(c).alias(c) for c in ("t", "td", "p_niv")], F.avg(u).alias("_u"), F.avg(v).alias("_v"), F.count("*").alias("n_profiles")
    )
    return means.withColumn("ff", P.speed("_u", "_v")).withColumn("dd", P.direction("_u", "_v", -1)).drop("_u", "_v")


def inversions(levels: DataFrame, strict_nan: bool = False) -> DataFrame:
    """(profile_id, strength, inverted): the largest rise of t between neighbouring levels.

    A profile is inverted if t rises with height anywhere and the largest rise
    is LEAST_INVERSION or more.  With ``strict_nan`` a missing rise anywhere
    makes a profile not inverted.
    """
    w = _by_height()
    steps = levels.withColumn("_n", F.row_number().over(w)).withColumn("_dt", F.col("t") - F.lag("t").over(w)).withColumn("_dz", F.col("altitude") - F.lag("altitude").over(w))
    facts = steps.groupBy("profile_id").agg(
        F.max("_dt").alias("strength"), F.coalesce(F.bool_or(F.try_divide("_dt", "_dz") > 0), F.lit(False)).alias("_rises"), F.bool_or((F.col("_n") > 1) & F.col("_dt").isNull()).alias("_gap")
    )
    inverted = F.col("_rises") & F.coalesce(F.col("strength") >= LEAST_INVERSION, F.lit(False))
    return facts.select("profile_id", "strength", (inverted & ~F.col("_gap") if strict_nan else inverted).alias("inverted"))


def inversion_statistics(levels: DataFrame, strict_nan: bool = False) -> DataFrame:
    """(profiles, inversion_frequency, mean_inversion_strength)."""
    return inversions(levels, strict_nan).agg(
        F.count("*").alias("profiles"), F.avg(F.col("inverted").cast("double")).alias("inversion_frequency"), F.avg(F.when(F.col("inverted"), F.col("strength"))).alias("mean_inversion_strength")
    )


def boundary_layer_height(levels: DataFrame, strict_nan: bool = False) -> DataFrame:
    """(profile_id, height): where t rises fastest; with ``strict_nan`` the first missing gradient wins."""
    rows = levels.withColumn("_g", gradient("t", "altitude", _by_height()))
    best = first_argmax(F.col("_g"), F.col("altitude"))
    gap = F.min(F.when(F.col("_g").isNull(), F.col("altitude")))
    return rows.groupBy("profile_id").agg((F.coalesce(gap, best) if strict_nan else best).alias("height"))


def level_coverage(resampled: DataFrame, variable: str = "t") -> DataFrame:
    """(g_idx, coverage): the share of profiles with a value."""
    return resampled.groupBy("g_idx").agg(F.avg(F.col(variable).isNotNull().cast("double")).alias("coverage"))


def level_moments(resampled: DataFrame, variable: str = "ff") -> DataFrame:
    """(g_idx, mean, std) with the population deviation."""
    return resampled.groupBy("g_idx").agg(F.avg(variable).alias("mean"), F.stddev_pop(variable).alias("std"))


def with_derived(resampled: DataFrame) -> DataFrame:
    """With u, v (meteorological), rh and rhi."""
    u, v = P.components("ff", "dd", -1)
    return resampled.withColumns({"u": u, "v": v, "rh": P.relative_humidity_plain("t", "td"), "rhi": P.relative_humidity_ice("t", "td")})


def level_quantiles(resampled: DataFrame, variables: list[str], quantiles: tuple[float, ...] = (0.1, 0.9), by: list[str] | None = None) -> DataFrame:
    """Mean and exact quantiles (linear between ranks) of variables by level."""
    keys = [*(by or []), "g_idx"]
    facts = resampled.groupBy(*keys).agg(*[F.avg(v).alias(f"{v}_mean") for v in variables])
    return with_quantiles(facts, resampled, keys, {v: {f"{v}_q{round(q * 100):02d}": q for q in quantiles} for v in variables})


def circular_mean(direction: Column) -> Column:
    """Mean direction as an aggregate, in [0, 360)."""
    d = F.radians(direction)
    return P.wrap_360(F.degrees(F.atan2(F.avg(F.sin(d)), F.avg(F.cos(d)))))


def circular_profile(resampled: DataFrame, by: list[str] | None = None) -> DataFrame:
    return resampled.groupBy(*(by or []), "g_idx").agg(circular_mean(F.col("dd")).alias("dd"))


def profile_statistics(resampled: DataFrame) -> DataFrame:
    """By level: mean, 5 and 95 % quantiles and deviation of t; mean speed, speed and direction of the mean wind."""
    u, v = P.components("ff", "dd", -1)
    facts = resampled.groupBy("g_idx").agg(
        F.avg("t").alias("t_mean"), F.stddev_pop("t").alias("t_std"),
        F.avg("ff").alias("speed_mean"), F.avg(u).alias("_u"), F.avg(v).alias("_v"),
    )
    facts = with_quantiles(facts, resampled, ["g_idx"], {"t": {"t_q05": 0.05, "t_q95": 0.95}})
    return facts.withColumn("vector_speed", P.speed("_u", "_v")).withColumn("vector_direction", P.direction("_u", "_v", -1)).drop("_u", "_v")


def gated_statistics(resampled: DataFrame, variables: list[str], quantiles: tuple[float, float] = (0.1, 0.9), min_share: float = 0.5) -> DataFrame:
    """Mean and quantiles by level where enough profiles have a value; else null.

    Enough is the integer part of the share of all profiles.
    """
    total = resampled.select("profile_id").distinct().agg(F.count("*").alias("_all"))
    columns = []
    for v in variables:
        columns += [F.count(v).alias(f"_n_{v}"), F.avg(v).alias(f"{v}_mean")]
    facts = resampled.groupBy("g_idx").agg(*columns).crossJoin(F.broadcast(total))  # one row
    facts = with_quantiles(facts, resampled, ["g_idx"], {v: {f"{v}_low": quantiles[0], f"{v}_high": quantiles[1]} for v in variables})
    least = F.floor(F.col("_all") * min_share)
    return facts.select("g_idx", *[F.when(F.col(f"_n_{v}") >= least, F.col(f"{v}_{s}")).alias(f"{v}_{s}") for v in variables for s in ("mean", "low", "high")])


def cluster_summary(features: DataFrame, assignments: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and sample deviation of features by cluster; a null cluster has those of all."""
    rows = features.join(assignments.select("profile_id", "cluster"), "profile_id")
    facts = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return rows.groupingSets([["cluster"], []], "cluster").agg(F.count("*").alias("n"), *facts)


def cluster_means(features: DataFrame, assignments: DataFrame, columns: list[str]) -> DataFrame:
    return features.join(assignments, "profile_id").groupBy("cluster").agg(*[F.avg(c).alias(c) for c in columns])


def diagnose_clusters(resampled: DataFrame, assignments: DataFrame) -> DataFrame:
    """Per cluster, of its mean profile: surface t in degrees C, mean t - td, variance of t, mean lapse, largest speed and shear."""
    u, v = P.components("ff", "dd", -1)
    joined = resampled.withColumn("u", u).withColumn("v", v).join(assignments.select("profile_id", "cluster"), "profile_id")
    means = joined.groupBy("cluster", "g_idx").agg(F.first("altitude").alias("altitude"), *[F.avg(c).alias(c) for c in ("t", "td", "u", "v")])
    w = Window.partitionBy("cluster").orderBy("altitude")
    rows = means.withColumns({f"_g{c}": gradient(c, "altitude", w) for c in ("t", "u", "v")})
    return rows.groupBy("cluster").agg(
        (F.min_by("t", "altitude") - P.ZERO_C).alias("surface_t"), F.avg(F.col("t") - F.col("td")).alias("depression"), F.var_pop("t").alias("t_variance"),
        F.avg("_gt").alias("lapse"), F.max(P.speed("u", "v")).alias("max_speed"), F.max(P.speed("_gu", "_gv")).alias("max_shear"),
    )


def cluster_wind(levels: DataFrame, assignments: DataFrame, z_max: float = 1000.0, least: int = 3) -> DataFrame:
    """(cluster, u, v, speed) pooled below a height, of profiles with enough levels there; null where there are none."""
    u, v = P.components("ff", "dd", -1)
    low = levels.filter(F.col("altitude") <= z_max)
    enough = F.count(F.lit(1)).over(Window.partitionBy("profile_id"))
    low = low.withColumn("_n", enough).filter(F.col("_n") >= least)
    own = assignments.select("profile_id", "cluster")
    facts = low.join(own, "profile_id").groupBy("cluster").agg(F.avg(u).alias("u"), F.avg(v).alias("v"), F.avg(P.speed(u, v)).alias("speed"))
    return own.select("cluster").distinct().join(facts, "cluster", "left")


def hour_counts(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy(F.hour("date").alias("hour")).agg(F.count("*").alias("n"))


def describe(df: DataFrame, column: str) -> DataFrame:
    """n, mean, sample deviation, least, exact quartiles and largest value of a column, as one row."""
    facts = df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("least"), F.max(column).alias("largest"))
    return with_quantiles(facts, df, [], {column: {"q25": 0.25, "median": 0.5, "q75": 0.75}}).select("n", "mean", "std", "least", "q25", "median", "q75", "largest")


def histogram(df: DataFrame, column: str, bins: int, low: float, high: float) -> DataFrame:
    """(bin, n) over equal bins of a range; its upper end is in the last bin, values outside are not counted."""
    at = F.least(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.filter(F.col(column).between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def every_nth(levels: DataFrame, n: int = 50) -> DataFrame:
    """Every n-th level of a profile by height, from the first: what wind barbs are drawn for."""
    return levels.withColumn("_n", F.row_number().over(_by_height()) - 1).filter(F.col("_n") % n == 0).drop("_n")


def ellipse(points: DataFrame, x: str, y: str, by: list[str], sigmas: float = 2.0) -> DataFrame:
    """Confidence ellipse of two columns by group: centre, both axes' lengths and the angle in degrees.

    The eigenvalues of the 2 x 2 sample covariance have a closed form.
    """
    facts = points.groupBy(*by).agg(
        F.avg(x).alias("x"), F.avg(y).alias("y"), F.var_samp(x).alias("_a"), F.var_samp(y).alias("_c"), F.covar_samp(x, y).alias("_b")
    )
    half, root = (F.col("_a") + F.col("_c")) / 2, F.sqrt(((F.col("_a") - F.col("_c")) / 2) * ((F.col("_a") - F.col("_c")) / 2) + F.col("_b") * F.col("_b"))
    return facts.select(
        *by, "x", "y", (2 * sigmas * F.sqrt(half + root)).alias("width"), (2 * sigmas * F.sqrt(F.greatest(half - root, F.lit(0.0)))).alias("height"),
        F.degrees(0.5 * F.atan2(2 * F.col("_b"), F.col("_a") - F.col("_c"))).alias("angle"),
    )


def density(points: DataFrame, x: str, y: str, factor: float = 0.3, cells: int = 100) -> DataFrame:
    """(gx, gy, density): Gaussian kernels with the points' covariance times factor squared, on a square mesh.

    The mesh covers the points' range.  Of a kernel's exponent only one term joins
    both axes of the mesh, and that one knows no point; so a task adds up products of
    a row for either axis, and equal points once, with their number.
    """
    x0, x1, y0, y1, a, c, b, n = points.agg(
        F.min(x), F.max(x), F.min(y), F.max(y), F.var_samp(x), F.var_samp(y), F.covar_samp(x, y), F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1))
    ).first()
    precision = np.linalg.inv(np.array([[a, b], [b, c]]) * factor**2)
    gx, gy = np.linspace(x0, x1, cells), np.linspace(y0, y1, cells)
    scale = math.sqrt(np.linalg.det(precision)) / (2 * math.pi * n)
    # exponents that grow beyond a double's, where points lie on a line nearly, are taken point by point
    apart = abs(precision[0, 1]) * (x1 - x0) * (y1 - y0) < 300

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (p, q), (_, r) = precision
        total = np.zeros((cells, cells))
        u, v = gx - (x0 + x1) / 2, gy - (y0 + y1) / 2
        for batch in batches:
            px, py, number = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            px, py = px - (x0 + x1) / 2, py - (y0 + y1) / 2
            if apart:
                rows = np.exp(-0.5 * p * (u - px[:, None]) ** 2 + q * u * py[:, None] - q * (px * py)[:, None])
                columns = np.exp(-0.5 * r * (v - py[:, None]) ** 2 + q * px[:, None] * v)
                total += (rows * number[:, None]).T @ columns
            else:
                for k in range(len(px)):
                    dx, dy = (u - px[k])[:, None], (v - py[k])[None]
                    total += number[k] * np.exp(-0.5 * (p * dx * dx + 2 * q * dx * dy + r * dy * dy))
        if apart:
            total *= np.exp(-q * np.outer(u, v))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(gx, cells)), pa.array(np.tile(gy, cells)), pa.array(total.ravel())], names=["gx", "gy", "part"])

    held = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop().groupBy("x", "y").agg(F.count("*").cast("double").alias("n"))
    return held.mapInArrow(add, "gx double, gy double, part double").groupBy("gx", "gy").agg((F.sum("part") * scale).alias("density"))
