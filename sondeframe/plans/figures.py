"""The tables that figures are drawn from; drawing them is left to the reader's tool."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondeframe.operators import aggregate, qc

#: Heat maps show gradients of these layers in K per 100 m.
LAPSE_COLUMNS = tuple(f"lapse_z{k}_{k + 200}" for k in range(0, 2000, 200))


def cluster_mean_profiles(resampled: DataFrame, assignments: DataFrame) -> DataFrame:
    """(cluster, g_idx, altitude, means, n_profiles): t, td, p_niv and the vector mean of the wind."""
    return aggregate.mean_profile(resampled.join(assignments.select("profile_id", "cluster"), "profile_id"), ["cluster"])


def cluster_pages(resampled: DataFrame, assignments: DataFrame, quantiles: tuple[float, float] = (0.1, 0.9), top: float | None = None) -> DataFrame:
    """(cluster, g_idx, mean and quantiles of each variable, mean direction) up to a height."""
    rows = aggregate.with_derived(qc.crop(resampled, high=top)).join(assignments.select("profile_id", "cluster"), "profile_id")
    spread = aggregate.level_quantiles(rows, ["t", "td", "u", "v", "ff", "rh", "rhi"], quantiles, ["cluster"])
    return spread.join(aggregate.circular_profile(rows, ["cluster"]), ["cluster", "g_idx"])


def first_profiles(levels: DataFrame, profiles: DataFrame, m: int) -> DataFrame:
    """The levels of the first m profiles of each cluster, with cluster and rank.

    ``profiles`` is (profile_id, cluster, date).  The order is by date, those
    without one last, then by id.
    """
    w = Window.partitionBy("cluster").orderBy(F.col("date").asc_nulls_last(), "profile_id")
    chosen = profiles.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= m).select("profile_id", "cluster", "rank")
    return levels.join(F.broadcast(chosen), "profile_id")  # m profiles a cluster


def scatter(scores: DataFrame, assignments: DataFrame, first: int = 1, second: int = 2) -> DataFrame:
    """(profile_id, x, y, cluster): two components and the cluster."""
    at = vector_to_array("features")
    return scores.select("profile_id", at[first - 1].alias("x"), at[second - 1].alias("y")).join(assignments.select("profile_id", "cluster"), "profile_id")


def lapse_map(diagnostics: DataFrame, assignments: DataFrame) -> DataFrame:
    """(cluster, layer, gradient): mean gradients of the 200 m layers in K per 100 m."""
    means = aggregate.cluster_means(diagnostics, assignments, list(LAPSE_COLUMNS))
    return means.unpivot(["cluster"], list(LAPSE_COLUMNS), "layer", "gradient").withColumn("gradient", F.col("gradient") * 100)


def with_digits(summary: DataFrame) -> DataFrame:
    """Numbers as text: five decimals for lapses and stability, two for others."""
    kinds = dict(summary.dtypes)
    return summary.select(*[
        F.format_string("%.5f" if "lapse" in c or "N2" in c else "%.2f", F.col(c)).alias(c) if kinds[c] == "double" else F.col(c) for c in summary.columns
    ])
