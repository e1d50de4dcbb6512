"""Clusters over the calendar: counts, shares, dominance, entropy and agreement of years."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondeframe.operators.evaluate import adjusted_rand
from sondeframe.operators.quantiles import with_quantiles


def calendar(profiles: DataFrame, assignments: DataFrame) -> DataFrame:
    """(profile_id, date, cluster, month, year, doy, hour); the tables must have the same profiles."""
    joined = profiles.select("profile_id", "date").join(assignments.select("profile_id", "cluster"), "profile_id")
    return with_parts(joined)


def check_aligned(profiles: DataFrame, assignments: DataFrame) -> None:
    """An error unless every assigned profile is there and the other way round."""
    a, b = profiles.select("profile_id"), assignments.select("profile_id")
    if a.exceptAll(b).limit(1).count() or b.exceptAll(a).limit(1).count():
        raise ValueError("profiles and assignments differ")


def with_parts(df: DataFrame) -> DataFrame:
    return df.withColumns({"month": F.month("date"), "year": F.year("date"), "doy": F.dayofyear("date"), "hour": F.hour("date")})


def season_offsets(months: list[int]) -> dict[int, int]:
    """Days of the season before each of its months, with the lengths of a leap year."""
    out, total = {}, 0
    for m in months:
        out[m] = total
        total += (datetime.date(2000 + m // 12, m % 12 + 1, 1) - datetime.date(2000, m, 1)).days
    return out


def season_days(months: list[int]) -> int:
    last = months[-1]
    return season_offsets(months)[last] + season_offsets([last, 1 if last != 1 else 2])[1 if last != 1 else 2]


def day_of_season(date: Column, months: list[int], fractional: bool = False) -> Column:
    """Days since the season's first day; null outside it."""
    offset = F.lit(None).cast("int")
    for m, days in season_offsets(months).items():
        offset = F.when(F.month(date) == m, days).otherwise(offset)
    day = offset + F.dayofmonth(date) - 1
    return day + F.hour(date) / 24 if fractional else day


def season_year(date: Column, months: list[int]) -> Column:
    """The year a season begins in, for seasons that cross New Year."""
    first = months[0]
    crosses = any(b < a for a, b in zip(months, months[1:], strict=False))
    return F.year(date) - F.when(F.lit(crosses) & (F.month(date) < first), 1).otherwise(0)


def in_season(frame: DataFrame, months: list[int] | None = None, years: list[int] | None = None) -> DataFrame:
    out = frame.filter(F.col("month").isin(months)) if months else frame
    return out.filter(F.col("year").isin(years)) if years else out


def complete(frame: DataFrame, months: list[int] | None = None) -> DataFrame:
    """All pairs of a cluster and a month: both lists are short."""
    own = frame.select("month").distinct() if months is None else frame.sparkSession.createDataFrame([(m,) for m in months], "month int")
    return frame.select("cluster").distinct().crossJoin(own)


def month_counts(frame: DataFrame, months: list[int] | None = None) -> DataFrame:
    """(cluster, month, n), 0 where there is none."""
    counts = frame.groupBy("cluster", "month").agg(F.count("*").alias("n"))
    return complete(frame, months).join(counts, ["cluster", "month"], "left").select("cluster", "month", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def month_table(frame: DataFrame, clusters: list[int]) -> DataFrame:
    """Months by clusters, as columns."""
    return frame.groupBy("month").pivot("cluster", clusters).agg(F.count(F.lit(1))).na.fill(0)


def month_shares(frame: DataFrame, months: list[int] | None = None) -> DataFrame:
    """(cluster, month, n, share): percent of the month; 0 in an empty month."""
    total = F.sum("n").over(Window.partitionBy("month"))
    return month_counts(frame, months).withColumn("share", F.coalesce(F.try_divide(100.0 * F.col("n"), total), F.lit(0.0)))


def feature_seasonal(frame: DataFrame, feature: str, stat: str = "median", months: list[int] | None = None) -> DataFrame:
    """(cluster, month, centre, low, high): median and quartiles, or mean and one sample deviation about it."""
    if stat == "median":
        cells = with_quantiles(frame.select("cluster", "month").distinct(), frame, ["cluster", "month"], {feature: {"centre": 0.5, "low": 0.25, "high": 0.75}})
    elif stat == "mean":
        m, s = F.avg(feature), F.stddev_samp(feature)
        cells = frame.groupBy("cluster", "month").agg(m.alias("centre"), (m - s).alias("low"), (m + s).alias("high"))
    else:
        raise ValueError(f"unknown stat: {stat}")
    return complete(frame, months).join(cells, ["cluster", "month"], "left")


def carpet(frame: DataFrame, months: list[int], years: list[int] | None = None) -> DataFrame:
    """(profile_id, cluster, year, day): where each profile stands in its season."""
    return in_season(frame, months, years).select("profile_id", "cluster", "year", day_of_season(F.col("date"), months, True).alias("day"))


def season_bins(frame: DataFrame, months: list[int], window: int = 7) -> DataFrame:
    """With ``bin``: the season in windows of days; a short last window counts with its number."""
    n = -(-season_days(months) // window)
    return in_season(frame, months).withColumn("bin", F.least(F.floor(day_of_season(F.col("date"), months) / window), F.lit(n - 1)).cast("int"))


def dominant(binned: DataFrame, min_profiles: int = 3) -> DataFrame:
    """(year, bin, cluster): the commonest cluster, of ties the smallest, in bins with enough profiles."""
    counts = binned.groupBy("year", "bin", "cluster").agg(F.count("*").alias("n"))
    return (
        counts.groupBy("year", "bin").agg(F.min_by("cluster", F.struct((-F.col("n")).alias("n"), "cluster")).alias("cluster"), F.sum("n").alias("total"))
        .filter(F.col("total") >= min_profiles).drop("total")
    )


def bin_entropy(dominants: DataFrame, clusters: int) -> DataFrame:
    """(bin, years, entropy) over the years' dominant clusters, as a share of the largest possible; two years at least."""
    counts = dominants.groupBy("bin", "cluster").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("bin"))
    scale = F.lit(float(clusters))
    h = counts.withColumn("_p", share).groupBy("bin").agg(F.sum("n").alias("years"), (-F.sum(F.col("_p") * F.log("_p"))).alias("h"))
    value = F.col("h") / F.log(scale) if clusters > 1 else F.lit(0.0)
    return h.filter("years >= 2").select("bin", "years", value.alias("entropy"))


def year_agreement(dominants: DataFrame) -> DataFrame:
    """(year_a, year_b, ari, n) over the bins that two years share, two at least."""
    a = dominants.select(F.col("year").alias("year_a"), "bin", F.col("cluster").alias("a"))
    b = dominants.select(F.col("year").alias("year_b"), "bin", F.col("cluster").alias("b"))
    return adjusted_rand(a.join(b, "bin").filter("year_a < year_b"), "a", "b", ["year_a", "year_b"]).filter("n >= 2")
