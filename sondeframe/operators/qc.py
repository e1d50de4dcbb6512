"""Quality control of profiles: one exchange by profile, no row loop.

Rows are flagged, not dropped, until the end, so that the levels kept and one
statistics row per input profile come from the same plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Valid ranges, both ends included; fixed values.
LIMITS = {
    "t": (150.0, 350.0),
    "td": (150.0, 350.0),
    "p_niv": (500.0, 110_000.0),
    "altitude": (-300.0, 40_000.0),
    "dd": (0.0, 360.0),
    "ff": (0.0, 200.0),
}
LARGEST_GAP = 5
DENSE = 0.2
SPIKE_DEPTH = 50.0
LOWEST_LAPSE, HIGHEST_LAPSE = -0.0294, 0.1
HIGHEST_SHEAR = 0.15


def _in_file(*more: str):
    return Window.partitionBy("profile_id", *more).orderBy("level_idx")


def _by_height(*more: str):
    return Window.partitionBy("profile_id", *more).orderBy(F.col("altitude").asc_nulls_last(), "level_idx")


def beyond(column: str, limits: tuple[float, float]) -> Column:
    """Whether a value is outside its range; a null is not."""
    return F.coalesce((F.col(column) < limits[0]) | (F.col(column) > limits[1]), F.lit(False))


def apply_limits(levels: DataFrame, limits: dict[str, tuple[float, float]] = LIMITS) -> DataFrame:
    """Values out of range become null; ``n_threshold`` counts them in the row."""
    own = {c: x for c, x in limits.items() if c in levels.columns}
    counted = levels.withColumn("n_threshold", sum((beyond(c, x).cast("int") for c, x in own.items()), F.lit(0)))
    return counted.withColumns({c: F.when(~beyond(c, x), F.col(c)) for c, x in own.items()})


def limit_dew_point(levels: DataFrame) -> DataFrame:
    """td above t becomes null; ``n_dewpoint`` is 1 there."""
    above = F.coalesce(F.col("td") > F.col("t"), F.lit(False))
    return levels.withColumn("n_dewpoint", above.cast("int")).withColumn("td", F.when(~above, F.col("td")))


def first_at_height(levels: DataFrame) -> DataFrame:
    """Of levels at one altitude the first in the file; null altitudes count as one."""
    return levels.withColumn("_n", F.row_number().over(_in_file("altitude"))).filter("_n = 1").drop("_n")


def longest_null_run(levels: DataFrame, column: str = "p_niv") -> DataFrame:
    """(profile_id, longest): the longest run of nulls in file order."""
    flagged = levels.withColumn("_null", F.col(column).isNull()).withColumn("_row", F.row_number().over(_in_file()))
    runs = flagged.withColumn("_run", F.col("_row") - F.row_number().over(_in_file("_null")))
    return (
        runs.groupBy("profile_id", "_null", "_run").agg(F.count("*").alias("n"))
        .groupBy("profile_id").agg(F.coalesce(F.max(F.when(F.col("_null"), F.col("n"))), F.lit(0)).alias("longest"))
    )


def keep_descending(levels: DataFrame, column: str = "p_niv") -> DataFrame:
    """Levels whose pressure is not above any before them, by height.

    A greedy filter that compares with the last level kept keeps these rows: the
    last one kept is the least so far.
    """
    return levels.withColumn("_least", F.min(column).over(_by_height().rowsBetween(Window.unboundedPreceding, -1))).filter(
        F.col("_least").isNull() | (F.col(column) <= F.col("_least"))
    ).drop("_least")


def monotonicity(levels: DataFrame, column: str = "p_niv", dense: float = DENSE) -> DataFrame:
    """Per profile: total_points, violations, violation_ratio, violation_type, violation_idx."""
    w = _by_height()
    least = F.min(column).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = levels.select("profile_id", (F.row_number().over(w) - 1).alias("at"), F.coalesce(F.col(column) > least, F.lit(False)).alias("bad"))
    out = flagged.groupBy("profile_id").agg(
        F.count("*").alias("total_points"), F.count_if("bad").alias("violations"), F.array_sort(F.collect_list(F.when(F.col("bad"), F.col("at")))).alias("violation_idx")
    )
    return _with_ratio(out, dense)


def _with_ratio(out: DataFrame, dense: float) -> DataFrame:
    ratio = F.col("violations") / F.col("total_points")
    return out.withColumn("violation_ratio", F.coalesce(ratio, F.lit(0.0))).withColumn(
        "violation_type", F.when(F.col("violations") == 0, "none").when(ratio < dense, "sparse").otherwise("dense")
    )


def strictly_descending(levels: DataFrame, column: str = "p_niv") -> DataFrame:
    """(profile_id, descending): every level's pressure is below the one before."""
    step = levels.withColumn("_d", F.col(column) - F.lag(column).over(_by_height()))
    first = F.row_number().over(_by_height()) == 1
    return step.withColumn("_ok", first | F.coalesce(F.col("_d") < 0, F.lit(False))).groupBy("profile_id").agg(F.bool_and("_ok").alias("descending"))




def flag_spikes(levels: DataFrame, alive: str | None = None) -> DataFrame:
    """Temperature spikes null the upper t, wind spikes the upper ff; n_temp_spike and n_wind_spike count them.

    Rates are between consecutive levels that have the value and a height, as
    they were before any is nulled.
    """
    part = [alive] if alive else []
    out = levels
    flags = {}
    for column, name in (("t", "n_temp_spike"), ("ff", "n_wind_spike")):
        valid = f"_valid_{column}"
        out = out.withColumn(valid, F.col(column).isNotNull() & F.col("altitude").isNotNull())
        w = _by_height(*part, valid)
        dz, dy = F.col("altitude") - F.lag("altitude").over(w), F.col(column) - F.lag(column).over(w)
        rate = F.try_divide(dy, dz)
        bad = (rate < LOWEST_LAPSE) | (rate > HIGHEST_LAPSE) if column == "t" else F.abs(rate) > HIGHEST_SHEAR
        flags[name] = (column, valid)
        out = out.withColumn(name, F.coalesce(F.col(valid) & (dz > SPIKE_DEPTH) & bad, F.lit(False)))
    if alive:
        out = out.withColumns({n: F.col(n) & F.col(alive) for n in flags})
    for name, (column, valid) in flags.items():
        out = out.withColumn(column, F.when(~F.col(name), F.col(column))).drop(valid)
    return out.withColumns({n: F.col(n).cast("int") for n in flags})


def flag(levels: DataFrame, limits: dict = LIMITS, min_levels: int = 20, largest_gap: int = LARGEST_GAP) -> DataFrame:
    """All levels with the flags of every rule; ``keep`` marks those that pass."""
    rows = limit_dew_point(apply_limits(levels.repartition("profile_id"), limits))
    rows = rows.withColumn("_first", F.row_number().over(_in_file("altitude")) == 1)
    rows = rows.withColumn("_null_p", F.col("p_niv").isNull()).withColumn("_row", F.row_number().over(_in_file("_first")))
    rows = rows.withColumn("_run", F.col("_row") - F.row_number().over(_in_file("_first", "_null_p")))
    in_run = F.count(F.lit(1)).over(Window.partitionBy("profile_id", "_first", "_null_p", "_run"))
    rows = rows.withColumn("_gap", F.when(F.col("_first") & F.col("_null_p"), in_run).otherwise(0))
    everywhere = Window.partitionBy("profile_id")
    rows = rows.withColumn("largest_gap", F.max("_gap").over(everywhere)).withColumn("_p", F.col("_first") & ~F.col("_null_p"))
    w = _by_height("_p")
    rows = rows.withColumn("_at", F.row_number().over(w) - 1).withColumn("_least", F.min("p_niv").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_above", F.col("_p") & F.coalesce(F.col("p_niv") > F.col("_least"), F.lit(False)))
    rows = rows.withColumn("_alive", F.col("_p") & ~F.col("_above"))
    rows = flag_spikes(rows, "_alive")
    left = F.count_if(F.col("_alive")).over(everywhere)
    return rows.withColumn("len_after", left).withColumn(
        "status", F.when(F.col("largest_gap") > largest_gap, "pressure_gap").when(F.col("len_after") < min_levels, "short").otherwise("kept")
    ).withColumn("keep", F.col("_alive") & (F.col("status") == "kept"))


def clean(levels: DataFrame, limits: dict = LIMITS, min_levels: int = 20) -> tuple[DataFrame, DataFrame]:
    """(levels kept, statistics): range and dew-point limits, duplicate heights, pressure gaps,
    falling pressure, spikes, and the least number of levels.

    Statistics have one row per input profile and a status.
    """
    flagged = flag(levels, limits, min_levels)
    kept = flagged.filter("keep").select(*levels.columns)
    stats = flagged.groupBy("profile_id").agg(
        F.sum("n_threshold").alias("threshold"), F.sum("n_dewpoint").alias("dewpoint"),
        F.sum("n_temp_spike").alias("temp_spikes"), F.sum("n_wind_spike").alias("wind_spikes"),
        F.count_if(F.col("_first") & F.col("_null_p")).alias("pressure_nan"), F.max("largest_gap").alias("largest_gap_pressure_removed"),
        F.count_if("_above").alias("non_monotonic_pressure"),
        (F.max("status") == "pressure_gap").cast("long").alias("discarded_b_of_pressure"), (F.max("status") == "short").cast("long").alias("discarded_b_of_len"),
        F.count("*").alias("len_before"), F.max("len_after").alias("len_after"),
        F.count_if("_p").alias("total_points"), F.count_if("_above").alias("violations"),
        F.array_sort(F.collect_list(F.when(F.col("_above"), F.col("_at")))).alias("violation_idx"), F.max("status").alias("status"),
    )
    mono = F.struct("total_points", "violations", "violation_ratio", "violation_type", "violation_idx")
    return kept, _with_ratio(stats.withColumn("total_points", F.col("total_points")), DENSE).withColumn("mono", mono).drop(
        "total_points", "violations", "violation_ratio", "violation_type", "violation_idx"
    )


def coverage(levels: DataFrame, z_low: float, z_high: float, max_start: float = 500.0, min_coverage: float = 0.8) -> DataFrame:
    """(profile_id, z_min, z_max, covered): starts low enough and reaches the share of the grid."""
    reach = z_low + min_coverage * (z_high - z_low)
    spans = levels.groupBy("profile_id").agg(F.min("altitude").alias("z_min"), F.max("altitude").alias("z_max"))
    return spans.withColumn("covered", F.coalesce((F.col("z_min") <= max_start) & (F.col("z_max") >= reach), F.lit(False)))


def filter_by_coverage(levels: DataFrame, z_low: float, z_high: float, max_start: float = 500.0, min_coverage: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(levels of covered profiles, levels of the others)."""
    good = coverage(levels, z_low, z_high, max_start, min_coverage).filter("covered").select("profile_id")
    return levels.join(good, "profile_id", "left_semi"), levels.join(good, "profile_id", "left_anti")


def usable(levels: DataFrame, max_start: float = 500.0, z_required: float = 3000.0, min_levels: int = 30, max_null_ratio: float = 0.3) -> DataFrame:
    """(profile_id, usable) for feature clustering: levels, start, reach, rising heights, nulls of t."""
    stepped = levels.withColumn("_dz", F.col("altitude") - F.lag("altitude").over(_in_file()))
    stepped = stepped.withColumn("_first", F.row_number().over(_in_file()) == 1)
    facts = stepped.groupBy("profile_id").agg(
        F.count("*").alias("n"), F.min("altitude").alias("low"), F.max("altitude").alias("high"),
        F.bool_and(F.col("_first") | F.coalesce(F.col("_dz") > 0, F.lit(False))).alias("rising"), F.avg(F.col("t").isNull().cast("double")).alias("nulls"),
    )
    ok = (F.col("n") >= min_levels) & (F.col("low") <= max_start) & (F.col("high") >= z_required) & F.col("rising") & (F.col("nulls") <= max_null_ratio)
    return facts.select("profile_id", F.coalesce(ok, F.lit(False)).alias("usable"))


def crop(levels: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Levels between two heights, ends included."""
    out = levels if low is None else levels.filter(F.col("altitude") >= low)
    return out if high is None else out.filter(F.col("altitude") <= high)


def exclude(df: DataFrame, ids: DataFrame, key: str = "profile_id") -> DataFrame:
    """Without the profiles of a list."""
    return df.join(ids.select(key), key, "left_anti")


def drop_incomplete(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without a null in the columns."""
    return df.na.drop("any", subset=columns)


def roll_up(stats: DataFrame) -> DataFrame:
    """Over all profiles: how many had any hit of each rule, and the share of levels removed."""
    rules = ("threshold", "dewpoint", "temp_spikes", "wind_spikes", "pressure_nan", "non_monotonic_pressure", "discarded_b_of_pressure", "discarded_b_of_len")
    removed = 1 - F.try_divide(F.sum(F.when(F.col("status") == "kept", F.col("len_after")).otherwise(0)), F.sum("len_before"))
    return stats.agg(F.count("*").alias("profiles"), *[F.count_if(F.col(r) != 0).alias(r) for r in rules], removed.alias("removed_share"))
