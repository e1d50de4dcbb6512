"""Exact quantiles in bounded memory: radix selection over all groups at once.

A double has a 64-bit image that keeps its order.  Rounds of counts over the
next bits of the images, for the values that may still be a wanted rank, narrow
all groups and quantiles together; no buffer holds the values of a group, and a
group of any size is counted by all tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from sondeframe.sources.storage import checkpointed

#: Bits of the image that a round decides.
ROUND_BITS = 12
#: Rows of the table of wanted ranks up to which it is broadcast.
BROADCAST_ROWS = 200_000


@F.pandas_udf(LongType())
def _image(values: pd.Series) -> pd.Series:
    """A long for each double, in the same order; null and NaN have none."""
    x = values.to_numpy(dtype=np.float64, na_value=np.nan) + 0.0  # -0 is 0
    bits = x.view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)).astype("Int64").mask(np.isnan(x))


@F.pandas_udf(DoubleType())
def _value(images: pd.Series) -> pd.Series:
    bits = images.to_numpy(dtype=np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits).view(np.float64))


def _same(left: DataFrame, right: DataFrame, keys: list[str], more: Column | None = None) -> Column:
    """Keys are equal, null to null."""
    test = F.lit(True) if more is None else more
    for k in keys:
        test = test & left[k].eqNullSafe(right[k])
    return test


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """(by..., n, q): for each group with a value the number of its values and an array of its exact quantiles.

    Quantiles are linear between ranks.  Null and NaN are no values; a null key
    is a group.  A task holds counts by group, wanted rank and 2**ROUND_BITS
    buckets at most, and these spill.
    """
    for s in shares:
        if not 0 <= s <= 1:
            raise ValueError(f"no share: {s}")
    names = [f"k{i}" for i in range(len(by))]
    keyed = checkpointed(rows.select(*[F.col(k).alias(n) for k, n in zip(by, names, strict=True)], _image(F.col(value).cast("double")).alias("x")).filter("x is not null"))
    sizes = keyed.groupBy(*names).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    places = F.array(*[F.lit(float(s)) * (F.col("n") - 1) for s in shares])
    ranks = F.array_sort(F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(F.floor(p), F.ceil(p))))))
    state = checkpointed(
        sizes.select(*names, "n", F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("below"), "low", "high")
    )
    shift = 64
    while True:
        wanted = state.filter("low < high")
        n_open = wanted.select(*names, "part").distinct().count()
        if not n_open:
            break
        last, shift = shift, max(0, shift - ROUND_BITS)
        part = F.lit(0).cast("long") if last == 64 else F.shiftright("x", last)
        open_parts = wanted.select(*[F.col(n).alias(f"_{n}") for n in names], F.col("part").alias("_part")).distinct()
        if n_open <= BROADCAST_ROWS:
            open_parts = F.broadcast(open_parts)
        test = part == open_parts["_part"]
        for n in names:
            test = test & keyed[n].eqNullSafe(open_parts[f"_{n}"])
        inside = keyed.join(open_parts, test, "left_semi")
        counts = (
            inside.groupBy(*names, part.alias("part"), F.shiftright("x", shift).alias("bucket")).agg(F.count("*").alias("m"), F.min("x").alias("least"), F.max("x").alias("most"))
            .withColumn("before", F.coalesce(F.sum("m").over(Window.partitionBy(*names, "part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        )
        place = (wanted["part"] == counts["part"]) & (wanted["rank"] - wanted["below"] >= counts["before"]) & (wanted["rank"] - wanted["below"] < counts["before"] + counts["m"])
        narrowed = wanted.join(counts, _same(wanted, counts, names, place)).select(
            *[wanted[n] for n in names], "n", "rank", F.col("bucket").alias("part"), (F.col("below") + F.col("before")).alias("below"), F.col("least").alias("low"), F.col("most").alias("high")
        )
        state = checkpointed(state.filter("low = high").unionByName(narrowed))
    found = state.groupBy(*names, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", _value("low").alias("v")))).alias("at"))

    def between(p: Column) -> Column:
        low, high = F.element_at("at", F.floor(p)), F.element_at("at", F.ceil(p))
        return F.when(F.floor(p) == F.ceil(p), low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    return found.select(*[F.col(n).alias(k) for k, n in zip(by, names, strict=True)], "n", F.transform(places, between).alias("q"))


def with_quantiles(facts: DataFrame, rows: DataFrame, by: list[str], wanted: dict[str, dict[str, float]]) -> DataFrame:
    """``facts`` (a row a group) with quantile columns; ``wanted`` says, by column of ``rows``, the names and shares.

    A group without a value gets nulls.  All columns are selected together.
    """
    columns = list(wanted)
    pairs = F.array(*[F.struct(F.lit(k).alias("v"), F.col(c).cast("double").alias("x")) for k, c in enumerate(columns)])
    long = rows.select(*[F.col(k).alias(f"b{i}") for i, k in enumerate(by)], F.explode(pairs).alias("p")).select(*[f"b{i}" for i in range(len(by))], "p.v", "p.x")
    keys = [f"b{i}" for i in range(len(by))]
    shares = sorted({s for own in wanted.values() for s in own.values()})
    found = quantiles(long, [*keys, "v"], "x", shares)
    picked = found.groupBy(*keys).agg(*[
        F.max(F.when(F.col("v") == k, F.col("q")[shares.index(s)])).alias(name) for k, c in enumerate(columns) for name, s in wanted[c].items()
    ])
    if not by:
        return facts.crossJoin(F.broadcast(picked))  # a row
    test = F.lit(True)
    for i, k in enumerate(by):
        test = test & facts[k].eqNullSafe(picked[f"b{i}"])
    return facts.join(picked, test, "left").drop(*keys)
