"""As-of joins and cubes over events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondeframe.operators import features, qc
from sondeframe.operators.asof import asof_join
from sondeframe.plans import cubes, sql
from sondeframe.queries import levels
from sondeframe.queries.common import events, r, rounded, table


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events with an even value of k, and the others, by user."""
    rows = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    left = rows.filter("k % 2 = 0").select("event_id", "user_id", "ts")
    right = rows.filter("k % 2 = 1").select("user_id", F.col("ts").alias("near_ts"), F.col("event_id").alias("near_id"), F.col("value").alias("near_value"))
    return left, right


def _asof(spark: SparkSession, d: str, direction: str, tolerance: float | None) -> DataFrame:
    left, right = _sides(spark, d)
    found = asof_join(left, right, ["user_id"], "ts", "near_ts", direction, tolerance, ["near_id"])
    return rounded(found.select("event_id", "near_id", "near_value", "distance"), 3)


def asof_before(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d, "before", None)


def asof_after(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d, "after", 6 * 3600.0)


def asof_nearest(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d, "nearest", 12 * 3600.0)


def order_cube(spark: SparkSession, d: str) -> DataFrame:
    """Exact figures of the cube, and whether the estimate of distinct customers lies within four standard errors of their number."""
    rows = table(spark, d, "orders").select(
        F.col("o_orderstatus").alias("station"), F.month("o_orderdate").alias("month"), F.substring("o_orderpriority", 1, 1).cast("int").alias("cluster"), "o_totalprice", "o_custkey")
    cube = cubes.roll_up(cubes.cells(rows, "o_totalprice", "o_custkey"))
    exact = rows.cube(*cubes.DIMENSIONS).agg(F.grouping_id().cast("int").alias("level"), F.count_distinct("o_custkey").alias("exact"))
    a, b = cube.alias("a"), exact.alias("b")
    same = F.col("a.level") == F.col("b.level")
    for c in cubes.DIMENSIONS:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    near = F.abs(F.col("n_distinct") - F.col("exact")) <= 1 + 4 * cubes.relative_error() * F.col("exact")
    total = F.col("mean") * F.col("n_values")  # cents, which round alike in any order of adding up
    return rounded(a.join(b, same).select("a.*", "exact", near.alias("near"), total.alias("total")).drop("n_distinct", "mean"), 2)


def sql_pressure_check(spark: SparkSession, d: str) -> DataFrame:
    """What ``monotone_stats`` finds, by a table function in SQL text."""
    sql.register(spark, levels=events(spark, d).filter("p_niv is not null"))
    found = spark.sql("""SELECT profile_id, total_points, violations, concat_ws(',', transform(violation_idx, x -> string(x))) AS violation_idx, violation_ratio, violation_type
                         FROM pressure_check(TABLE(levels))""")
    return rounded(found)


def sql_parcel(spark: SparkSession, d: str) -> DataFrame:
    """What ``parcel`` finds, with the parcel's rise as a table function in SQL text."""
    rows = qc.limit_dew_point(qc.apply_limits(events(spark, d)))
    sql.register(spark, levels=rows)
    return rounded(features.parcel_energy(rows, spark.sql("SELECT * FROM parcel_temperature(TABLE(levels))")), 4)


QUERIES = {f.__name__: f for f in (asof_before, asof_after, asof_nearest, order_cube, sql_pressure_check, sql_parcel)}

_SIDES = """e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
    l AS (SELECT event_id, user_id, ts FROM e WHERE k % 2 = 0), x AS (SELECT user_id, ts AS near_ts, event_id AS near_id, value AS near_value FROM e WHERE k % 2 = 1),
    b AS (SELECT l.*, near_id, near_value, epoch_us(l.ts) - epoch_us(near_ts) AS gap FROM l ASOF LEFT JOIN x ON l.user_id = x.user_id AND l.ts >= x.near_ts),
    a AS (SELECT l.*, near_id, near_value, epoch_us(near_ts) - epoch_us(l.ts) AS gap FROM l ASOF LEFT JOIN x ON l.user_id = x.user_id AND l.ts <= x.near_ts)"""


def _within(rows: str, seconds: int) -> str:
    near = f"gap <= CAST({seconds} AS BIGINT) * 1000000"
    return f"SELECT event_id, CASE WHEN {near} THEN near_id END AS near_id, {r(f'CASE WHEN {near} THEN near_value END', 'near_value', 3)}, {r(f'CASE WHEN {near} THEN gap / 1000000e0 END', 'distance', 3)} FROM {rows}"


SQL = {
    "asof_before": f"WITH {_SIDES} {_within('b', 10**10)}",
    "asof_after": f"WITH {_SIDES} {_within('a', 6 * 3600)}",
    "asof_nearest": f"""WITH {_SIDES}, n AS (SELECT b.event_id, CASE WHEN b.gap IS NULL OR a.gap < b.gap THEN a.near_id ELSE b.near_id END AS near_id,
        CASE WHEN b.gap IS NULL OR a.gap < b.gap THEN a.near_value ELSE b.near_value END AS near_value, CASE WHEN b.gap IS NULL OR a.gap < b.gap THEN a.gap ELSE b.gap END AS gap FROM b JOIN a USING (event_id))
        {_within('n', 12 * 3600)}""",
    "sql_pressure_check": levels.SQL["monotone_stats"],
    "sql_parcel": levels.SQL["parcel"],
    "order_cube": f"""WITH o AS (SELECT o_orderstatus AS station, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS cluster, o_totalprice, o_custkey FROM orders)
        SELECT station, month, cluster, CAST(grouping(station, month, cluster) AS INTEGER) AS level, count(*) AS n, count(o_totalprice) AS n_values, {r('sum(o_totalprice)', 'total', 2)}, {r('min(o_totalprice)', 'least', 2)},
               {r('max(o_totalprice)', 'largest', 2)}, count(DISTINCT o_custkey) AS exact, true AS near FROM o GROUP BY CUBE (station, month, cluster)""",
}
