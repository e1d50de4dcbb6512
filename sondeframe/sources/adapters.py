"""Plain tables as profiles: users' events, orders over the calendar, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def event_levels(events: DataFrame) -> DataFrame:
    """A user's events as a profile: altitude is a tenth of an hour since the first, p_niv falls with it."""
    user = Window.partitionBy("user_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("double")
    rows = events.select(
        F.col("user_id").cast("string").alias("profile_id"),
        (F.row_number().over(user.orderBy("ts", "event_id")) - 1).cast("long").alias("level_idx"),
        ((micros - F.min(micros).over(user)) / F.lit(3.6e8)).alias("altitude"),
        (F.lit(200.0) + F.col("value") * F.lit(0.5)).alias("t"),
        k.alias("_k"),
        (F.col("value") / F.lit(10.0)).alias("ff"),
        F.pmod(F.col("event_id") * 37, F.lit(360)).cast("double").alias("dd"),
    )
    return rows.select(
        "profile_id", "level_idx", "altitude",
        F.when(F.col("_k") % 7 != 3, F.lit(100_000.0) - F.col("altitude") * F.lit(10.0) + F.col("_k") * F.lit(20.0)).alias("p_niv"),
        "t", (F.col("t") - F.col("_k") * F.lit(0.2) + F.lit(2.0)).alias("td"), "dd", "ff",
    )


def event_profiles(events: DataFrame) -> DataFrame:
    """(profile_id, date): a user's first event."""
    return events.groupBy("user_id").agg(F.min("ts").alias("date")).select(F.col("user_id").cast("string").alias("profile_id"), F.col("date").cast("timestamp").alias("date"))


def order_calendar(orders: DataFrame) -> DataFrame:
    """(profile_id, date, cluster, value) of orders; the cluster is the digit of the priority."""
    return orders.select(
        F.col("o_orderkey").cast("string").alias("profile_id"), F.col("o_orderdate").cast("timestamp").alias("date"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("cluster"), F.col("o_totalprice").alias("value"),
    )


def order_fragments(orders: DataFrame) -> DataFrame:
    """A customer's orders as fragments of ascents, every fifth without date."""
    bottom = F.pmod(F.col("o_orderkey") * 37, F.lit(1500)).cast("double")
    return orders.select(
        F.col("o_custkey").alias("station"), F.col("o_orderkey").alias("profile_seq"), F.col("o_orderkey").cast("string").alias("profile_id"),
        bottom.alias("bottom"), (bottom + F.pmod(F.col("o_orderkey") * 101, F.lit(900)).cast("double")).alias("top"),
        F.when(F.col("o_orderkey") % 5 != 0, F.date_trunc("year", F.col("o_orderdate").cast("timestamp"))).alias("date"),
    )


def supplier_levels(lineitem: DataFrame) -> DataFrame:
    """A supplier's items as a profile by ship date; values are those of the day."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("double")
    return lineitem.groupBy(F.col("l_suppkey").cast("string").alias("profile_id"), day.alias("altitude")).agg(
        F.min("l_quantity").alias("t"), F.max("l_extendedprice").alias("p_niv")
    ).withColumn("level_idx", F.col("altitude").cast("long"))


def vector_matrix(embeddings: DataFrame) -> DataFrame:
    """The vectors as a long matrix (profile_id, var, g_idx, val)."""
    return embeddings.select(F.col("vec_id").cast("string").alias("profile_id"), F.posexplode("embedding").alias("g_idx", "x")).select(
        "profile_id", F.format_string("e%02d", F.col("g_idx")).alias("var"), "g_idx", F.col("x").cast("double").alias("val")
    )


def vector_labels(embeddings: DataFrame) -> DataFrame:
    """(profile_id, cluster)."""
    return embeddings.select(F.col("vec_id").cast("string").alias("profile_id"), F.col("label").alias("cluster"))


def turn_records(conversations: DataFrame) -> DataFrame:
    """Turns of conversations cut into records, each opened by a user's turn."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    opened = F.sum((F.col("role") == "user").cast("int")).over(w)
    return conversations.select("conv_id", "turn", "role", opened.cast("long").alias("record")).filter("record > 0")
