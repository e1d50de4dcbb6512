"""Stitching of fragments: neighbours in a list that continue one ascent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondeframe.operators.qc import first_at_height

LOWEST_RESTART = 50.0


def chains(records: DataFrame, tolerance: float = 500.0, group: str = "station", order: str = "profile_seq") -> DataFrame:
    """(group, order, profile_id, chain): chain is the order of its first record.

    ``records`` has one row a fragment: bottom, top and date.  A record joins
    the chain before it if its bottom is within the tolerance of the chain's top
    (the largest so far), above LOWEST_RESTART, and both begin in the same hour
    or one of the dates is missing; the chain's date is its first record's.  A
    missing bottom or top ends the chain.  The fold runs over a group's records
    in order, cut before every record that can't continue a chain: one whose
    bottom is missing or not above LOWEST_RESTART, or, in a group without missing
    dates, of another hour.  So a run is about an ascent, and not a history.
    """
    w = Window.partitionBy(group).orderBy(order)
    hour = F.date_trunc("hour", F.col("date"))
    dated = records.withColumn("_hour", hour).withColumn("_undated", F.max(F.col("date").isNull()).over(Window.partitionBy(group)))
    grounded = ~F.coalesce(F.col("bottom") > LOWEST_RESTART, F.lit(False))
    breaks = (grounded | F.coalesce(~F.col("_undated") & (F.col("_hour") != F.lag("_hour").over(w)), F.lit(False))).cast("int")
    runs = dated.withColumn("_break", breaks).withColumn("_run", F.sum("_break").over(w))
    entry = F.struct(
        F.col(order).cast("long").alias("seq"), F.col("profile_id").alias("id"), F.col("bottom").cast("double").alias("bottom"),
        F.col("top").cast("double").alias("top"), F.col("_hour").alias("hour"),
    )
    start = F.struct(
        F.lit(None).cast("long").alias("chain"), F.lit(None).cast("double").alias("top"), F.lit(None).cast("timestamp").alias("hour"),
        F.array().cast("array<struct<seq: bigint, id: string, chain: bigint>>").alias("out"),
    )

    def step(acc: Column, x: Column) -> Column:
        same = acc["hour"].isNull() | x["hour"].isNull() | (acc["hour"] == x["hour"])
        near = F.abs(x["bottom"] - acc["top"]) <= tolerance
        on = F.coalesce(acc["chain"].isNotNull() & same & near & (x["bottom"] > LOWEST_RESTART), F.lit(False))
        chain = F.when(on, acc["chain"]).otherwise(x["seq"])
        top = F.when(x["bottom"].isNull() | x["top"].isNull(), F.lit(None)).otherwise(F.when(on, F.greatest(acc["top"], x["top"])).otherwise(x["top"]))
        item = F.struct(x["seq"].alias("seq"), x["id"].cast("string").alias("id"), chain.alias("chain"))
        return F.struct(
            chain.alias("chain"), top.cast("double").alias("top"), F.when(on, acc["hour"]).otherwise(x["hour"]).cast("timestamp").alias("hour"),
            F.concat(acc["out"], F.array(item)).alias("out"),
        )

    folded = runs.groupBy(group, "_run").agg(F.array_sort(F.collect_list(entry)).alias("r")).select(group, F.aggregate("r", start, step)["out"].alias("out"))
    return folded.select(group, F.explode("out").alias("x")).select(group, F.col("x.seq").alias(order), F.col("x.id").alias("profile_id"), F.col("x.chain").alias("chain"))


def stitch(profiles: DataFrame, levels: DataFrame, tolerance: float = 500.0, group: str = "station") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profiles, levels, merges): each chain becomes its first record's profile.

    The first record's header stays.  Levels follow in list order, and of those
    at one altitude the first stays.  merges has each profile's number of
    fragments joined to it.
    """
    ends = levels.groupBy("profile_id").agg(F.min("altitude").alias("bottom"), F.max("altitude").alias("top"))
    placed = chains(profiles.join(ends, "profile_id", "left"), tolerance, group)
    heads = placed.filter(F.col("profile_seq") == F.col("chain")).select(group, "chain", F.col("profile_id").alias("head"))
    moved = placed.join(heads, [group, "chain"]).select("profile_id", "profile_seq", "head")
    kept = profiles.join(heads.select(F.col("head").alias("profile_id")), "profile_id", "left_semi")
    w = Window.partitionBy("head").orderBy("profile_seq", "level_idx")
    joined = levels.join(moved, "profile_id").withColumn("level_idx", (F.row_number().over(w) - 1).cast("long"))
    merged = first_at_height(joined.withColumn("profile_id", F.col("head")).select(*levels.columns))
    merges = moved.groupBy(F.col("head").alias("profile_id")).agg((F.count("*") - 1).alias("merges"))
    return kept, merged, merges
