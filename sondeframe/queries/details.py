"""Small operators over the plain tables: labels, marks, crops, paths, first profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondeframe.functions import physics as P
from sondeframe.operators import matrix, qc, resample
from sondeframe.operators.resample import height_grid
from sondeframe.plans import figures
from sondeframe.queries.common import E, G, events, on_grid, r, rounded, table
from sondeframe.sources import soundings


def ice_humidity(spark: SparkSession, d: str) -> DataFrame:
    """Humidity over ice, wind in knots, pressure in hPa and a lapse in K per 100 m."""
    rows = events(spark, d)
    return rounded(rows.select(
        "profile_id", "level_idx", P.relative_humidity_ice("t", "td").alias("rhi"), P.knots("ff").alias("knots"), P.hectopascal("p_niv").alias("hpa"),
        P.per_100_m(F.try_divide(F.col("t") - F.col("td"), F.col("altitude"))).alias("lapse"),
    ), 4)


def launch_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumns({"dep_lat": F.col("ff") / 100, "dep_lon": -F.col("dd") / 1000})
    return rounded(soundings.trajectory(rows, -66.66, 140.0))


def grid_names(spark: SparkSession, d: str) -> DataFrame:
    return matrix.column_names(matrix.build_matrix(on_grid(spark, d)), height_grid(spark, 0.0, 7000.0, 500.0))


def significance_marks(spark: SparkSession, d: str) -> DataFrame:
    p = F.pmod(F.col("l_orderkey") * 7 + F.col("l_linenumber"), F.lit(1000)) / 10_000
    return table(spark, d, "lineitem").select(P.stars(p).alias("mark")).groupBy("mark").agg(F.count("*").alias("n"))


def rising_pressure(spark: SparkSession, d: str) -> DataFrame:
    return resample.pressure_warning(on_grid(spark, d))


def cropped_levels(spark: SparkSession, d: str) -> DataFrame:
    return qc.crop(events(spark, d), 500.0, 3000.0).groupBy("profile_id").agg(F.count("*").alias("n"), F.min("level_idx").alias("first"), F.max("level_idx").alias("last"))


def without_outliers(spark: SparkSession, d: str) -> DataFrame:
    """All profiles but those of a list by hand: here the users of a numbered few."""
    rows = events(spark, d)
    listed = rows.select("profile_id").distinct().filter(F.col("profile_id").cast("long") % 7 == 3)
    return qc.exclude(rows, listed).groupBy("profile_id").agg(F.count("*").alias("n"))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d)
    strong = F.col("ff") > 40
    return rows.groupBy("profile_id").agg(
        F.max(F.when(strong, F.col("ff"))).alias("jet_nose_speed"), F.min(F.when(strong, F.col("altitude"))).alias("jet_nose_height"),
        F.avg(F.when(F.col("dd") < 180, F.col("t"))).alias("warmth"), F.max(F.when(F.col("level_idx") >= 66, F.col("td"))).alias("late"),
    )


def features_long(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matrix.feature_matrix(_facts(spark, d)))


def features_imputed(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matrix.impute_features(matrix.feature_matrix(_facts(spark, d))))


def first_of_cluster(spark: SparkSession, d: str) -> DataFrame:
    """The first five profiles of each cluster by date, with their levels' number and reach."""
    rows = events(spark, d)
    dates = rows.groupBy("profile_id").agg(F.min("p_niv").alias("date"))
    found = figures.first_profiles(rows, dates.withColumn("cluster", (F.col("profile_id").cast("long") % 4).cast("int")), 5)
    return rounded(found.groupBy("cluster", "rank", "profile_id").agg(F.count("*").alias("n"), F.max("altitude").alias("top")))


def row_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Numbers in the order of a name, without all rows in one task."""
    return soundings.numbered(table(spark, d, "part").select("p_name").distinct(), "p_name", "place")


QUERIES = {f.__name__: f for f in (
    ice_humidity, launch_paths, grid_names, significance_marks, rising_pressure, cropped_levels, without_outliers, features_long, features_imputed, first_of_cluster, row_offsets,
)}

_F = f"""{E}, f AS (SELECT profile_id, max(CASE WHEN ff > 40 THEN ff END) AS jet_nose_speed, min(CASE WHEN ff > 40 THEN altitude END) AS jet_nose_height,
    avg(CASE WHEN dd < 180 THEN t END) AS warmth, max(CASE WHEN level_idx >= 66 THEN td END) AS late FROM e GROUP BY 1),
    m AS ({' UNION ALL '.join(f"SELECT profile_id, '{n}' AS var, CAST({k} AS INTEGER) AS g_idx, CAST({n} AS DOUBLE) AS val FROM f" for k, n in enumerate(("jet_nose_speed", "jet_nose_height", "warmth", "late")))})"""

SQL = {
    "ice_humidity": f"""WITH {E} SELECT profile_id, level_idx,
        {r('100 * exp(17.67e0 * (td - 273.15e0) / (td - 273.15e0 + 243.5e0)) / exp(22.46e0 * (t - 273.15e0) / (t - 273.15e0 + 272.62e0))', 'rhi', 4)},
        {r(f'ff * {P.KNOTS!r}', 'knots', 4)}, {r('p_niv / 100e0', 'hpa', 4)}, {r('(t - td) / nullif(altitude, 0e0) * 100', 'lapse', 4)} FROM e""",
    "launch_paths": f"WITH {E} SELECT profile_id, level_idx, {r('-66.66e0 + ff / 100e0', 'lat')}, {r('140e0 - dd / 1000e0', 'lon')} FROM e",
    "grid_names": "SELECT v AS var, CAST(i AS INTEGER) AS g_idx, v || '_z' || CAST(i * 500 AS VARCHAR) AS name FROM range(15) g(i), (VALUES ('t'), ('td'), ('t-td'), ('u'), ('v')) x(v)",
    "significance_marks": """SELECT CASE WHEN p < 0.001e0 THEN '***' WHEN p < 0.01e0 THEN '**' WHEN p < 0.05e0 THEN '*' ELSE '' END AS mark, count(*) AS n
        FROM (SELECT ((l_orderkey * 7 + l_linenumber) % 1000) / 10000e0 AS p FROM lineitem) GROUP BY 1""",
    "rising_pressure": f"""WITH {E}, {G}, w AS (SELECT profile_id, p_niv - lag(p_niv) OVER (PARTITION BY profile_id ORDER BY g_idx) AS step FROM g WHERE p_niv IS NOT NULL)
        SELECT profile_id, coalesce(bool_or(step > 0), false) AS rising FROM w GROUP BY 1""",
    "cropped_levels": f"WITH {E} SELECT profile_id, count(*) AS n, min(level_idx) AS first, max(level_idx) AS last FROM e WHERE altitude BETWEEN 500 AND 3000 GROUP BY 1",
    "without_outliers": f"WITH {E} SELECT profile_id, count(*) AS n FROM e WHERE CAST(profile_id AS BIGINT) % 7 <> 3 GROUP BY 1",
    "features_long": f"WITH {_F} SELECT profile_id, var, g_idx, {r('val', 'val')} FROM m",
    "features_imputed": f"""WITH {_F}, z AS (SELECT profile_id, var, g_idx, CASE WHEN var LIKE 'jet%' THEN coalesce(val, 0e0) ELSE val END AS val FROM m),
        c AS (SELECT var, g_idx, median(val) AS fill FROM z GROUP BY 1, 2) SELECT profile_id, var, g_idx, {r('coalesce(val, fill)', 'val')} FROM z JOIN c USING (var, g_idx) WHERE fill IS NOT NULL""",
    "first_of_cluster": f"""WITH {E}, p AS (SELECT profile_id, CAST(CAST(profile_id AS BIGINT) % 4 AS INTEGER) AS cluster, min(p_niv) AS date, count(*) AS n, max(altitude) AS top FROM e GROUP BY 1),
        k AS (SELECT *, CAST(row_number() OVER (PARTITION BY cluster ORDER BY date NULLS LAST, profile_id) AS INTEGER) AS rank FROM p)
        SELECT cluster, rank, profile_id, n, {r('top', 'top')} FROM k WHERE rank <= 5""",
    "row_offsets": "SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS place FROM (SELECT DISTINCT p_name FROM part)",
}
