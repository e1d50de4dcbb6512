"""The three analyses: profile shapes, profile features, and seasons compared.

Each is one lazy plan from levels to its result; only fits and their bounded
tables run eagerly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeframe.operators import aggregate, calendar, cluster, features, matrix, qc
from sondeframe.operators.resample import height_grid, resample
from sondeframe.operators.stitch import stitch


@dataclass(frozen=True)
class Prepared:
    """Profiles after quality control, with their levels, on the grid, and the statistics of all."""

    profiles: DataFrame
    levels: DataFrame
    resampled: DataFrame
    statistics: DataFrame
    merges: DataFrame
    grid: DataFrame


def prepare(profiles: DataFrame, levels: DataFrame, low: float = 0.0, high: float = 14_900.0, step: float = 100.0, max_start: float = 500.0,
            min_coverage: float = 0.8, min_levels: int = 20, tolerance: float = 500.0, path: str | None = None) -> Prepared:
    """Stitch fragments, clean, keep covered profiles and resample them.

    With ``path`` the tables are written there once and read back, so that the
    fits that follow, which pass over them many times, don't prepare them anew.
    """
    heads, whole, merges = stitch(profiles, levels, tolerance)
    kept, statistics = qc.clean(whole, min_levels=min_levels)
    good, _ = qc.filter_by_coverage(kept, low, high, max_start, min_coverage)
    grid = height_grid(levels.sparkSession, low, high, step)
    own = heads.join(good.select("profile_id").distinct(), "profile_id", "left_semi")
    ready = Prepared(own, good, resample(good, grid), statistics, merges, grid)
    if path is None:
        return ready
    levels_ = _written(good, f"{path}/levels")
    return Prepared(
        _written(heads.join(levels_.select("profile_id").distinct(), "profile_id", "left_semi"), f"{path}/profiles"), levels_,
        _written(resample(levels_, grid), f"{path}/resampled"), _written(statistics, f"{path}/statistics"), _written(merges, f"{path}/merges"), grid,
    )


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def profile_shapes(prepared: Prepared, k: int, variables: list[str] | None = None, components: int = 5, strategy: str = "mean", seed: int = 0, n_init: int = 20) -> cluster.Fit:
    """Clusters of whole profiles: matrix, imputation, block scaling, components, k-means."""
    filled = matrix.impute(matrix.build_matrix(prepared.resampled, variables), strategy)
    scaled = matrix.scale_block(filled, None, "z")
    return cluster.k_means(cluster.reduce(matrix.vectors(scaled, variables), components).scores, k, seed, n_init)


def profile_features(levels: DataFrame, k: int, components: int = 5, seed: int = 0, n_init: int = 20) -> cluster.Fit:
    """Clusters of feature tables: usable profiles, features, imputation, z-scores, components, k-means."""
    good = qc.usable(levels).filter("usable").select("profile_id")
    table = features.full_features(levels.join(good, "profile_id", "left_semi"))
    scaled = matrix.standardise(matrix.impute_features(matrix.feature_matrix(table)))
    return cluster.k_means(cluster.reduce(matrix.vectors(scaled), components).scores, k, seed, n_init)


def explain(prepared: Prepared, assignments: DataFrame) -> DataFrame:
    """Means and deviations of the diagnostics by cluster and of all."""
    table = features.diagnostics(prepared.levels)
    return aggregate.cluster_summary(table, assignments, [c for c in table.columns if c != "profile_id"])


SEASONS = {"winter": (6, 7, 8), "summer": (12, 1, 2), "rest": (3, 4, 5, 9, 10, 11)}


def compare_seasons(prepared: Prepared, seasons: dict[str, tuple[int, ...]] = SEASONS) -> DataFrame:
    """(season, profiles, inversion_frequency, mean_inversion_strength, boundary_layer): in one pass."""
    name = F.lit(None).cast("string")
    for season, months in seasons.items():
        name = F.when(F.month("date").isin(list(months)), season).otherwise(name)
    dated = prepared.profiles.select("profile_id", name.alias("season"))
    rows = prepared.resampled.withColumn("level_idx", F.col("g_idx").cast("long"))
    facts = aggregate.inversions(rows).join(aggregate.boundary_layer_height(rows), "profile_id").join(dated, "profile_id")
    return facts.groupBy("season").agg(
        F.count("*").alias("profiles"), F.avg(F.col("inverted").cast("double")).alias("inversion_frequency"),
        F.avg(F.when(F.col("inverted"), F.col("strength"))).alias("mean_inversion_strength"), F.avg("height").alias("boundary_layer"),
    )


def yearly_consistency(profiles: DataFrame, assignments: DataFrame, months: list[int], window: int = 7, min_profiles: int = 3) -> tuple[DataFrame, DataFrame]:
    """(entropy by bin, agreement by pair of years) of the clusters that dominate."""
    frame = calendar.calendar(profiles, assignments)
    n = frame.agg(F.count_distinct("cluster")).first()[0]
    top = calendar.dominant(calendar.season_bins(frame, months, window), min_profiles)
    return calendar.bin_entropy(top, n), calendar.year_agreement(top)
