"""What queries share: tables, rounding, and the event profiles in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondeframe.operators.resample import height_grid, resample
from sondeframe.sources.adapters import event_levels


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_levels(table(spark, sf_dir, "events"))


def on_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event profiles on a grid of 500 m up to 7 km."""
    return resample(events(spark, sf_dir), height_grid(spark, 0.0, 7000.0, 500.0))


def round_to(x: Column, digits: int) -> Column:
    """x scaled, rounded to a whole number and scaled back in doubles, as DuckDB rounds: ``F.round`` goes by the decimal text and parts from it near a half."""
    return F.round(x * 10.0**digits, 0) / 10.0**digits


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded: sums come in another order in another engine."""
    kinds = dict(df.dtypes)
    return df.select(*[round_to(F.col(c), digits).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns])


def r(expression: str, name: str, digits: int = 6) -> str:
    """The same in SQL; adding 0 makes a negative zero positive."""
    return f"round({expression}, {digits}) + 0e0 AS {name}"


#: Event profiles as the table e.
E = """e AS (
    SELECT profile_id, level_idx, altitude, CASE WHEN k % 7 <> 3 THEN 1e5 - altitude * 10e0 + k * 20e0 END AS p_niv,
           t, t - k * 0.2e0 + 2e0 AS td, dd, ff
    FROM (SELECT CAST(user_id AS VARCHAR) AS profile_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS level_idx,
                 (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 3.6e8 AS altitude, 200e0 + value * 0.5e0 AS t,
                 CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, value / 10e0 AS ff, CAST((event_id * 37) % 360 AS DOUBLE) AS dd
          FROM events))"""

_GRID_VARIABLES = ("t", "td", "p_niv", "u", "v")


def _grid_sql() -> str:
    lo = [f"last_value(CASE WHEN {v} IS NOT NULL THEN z END IGNORE NULLS) OVER b AS lz_{v}, last_value({v} IGNORE NULLS) OVER b AS ly_{v}" for v in _GRID_VARIABLES]
    hi = [f"first_value(CASE WHEN {v} IS NOT NULL THEN z END IGNORE NULLS) OVER a AS hz_{v}, first_value({v} IGNORE NULLS) OVER a AS hy_{v}" for v in _GRID_VARIABLES]
    n = [f"count({v}) OVER (PARTITION BY profile_id) AS n_{v}" for v in _GRID_VARIABLES]
    out = [
        f"CASE WHEN n_{v} < 4 OR hz_{v} IS NULL THEN NULL WHEN lz_{v} = z THEN ly_{v} "
        f"ELSE ly_{v} + (hy_{v} - ly_{v}) / nullif(hz_{v} - lz_{v}, 0e0) * (z - lz_{v}) END AS {v}" for v in _GRID_VARIABLES
    ]
    return f"""grid AS (SELECT CAST(i AS INTEGER) AS g_idx, i * 500e0 AS z FROM range(15) t(i)),
    marks AS (
        SELECT profile_id, altitude AS z, CAST(NULL AS INTEGER) AS g_idx, t, td, p_niv, ff * sin(radians(dd)) AS u, ff * cos(radians(dd)) AS v FROM e WHERE altitude IS NOT NULL
        UNION ALL
        SELECT profile_id, z, g_idx, NULL, NULL, NULL, NULL, NULL FROM (SELECT DISTINCT profile_id FROM e), grid),
    near AS (
        SELECT profile_id, z, g_idx, {', '.join(lo + hi + n)} FROM marks
        WINDOW b AS (PARTITION BY profile_id ORDER BY z, g_idx NULLS FIRST ROWS UNBOUNDED PRECEDING),
               a AS (PARTITION BY profile_id ORDER BY z, g_idx NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    comp AS (SELECT profile_id, g_idx, z AS altitude, {', '.join(out)} FROM near WHERE g_idx IS NOT NULL),
    g AS (SELECT *, sqrt(u * u + v * v) AS ff, degrees(atan2(u, v)) - 360 * floor(degrees(atan2(u, v)) / 360) AS dd FROM comp)"""


#: The same on the grid, as the table g (after E).
G = _grid_sql()
