"""Statistics across profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondeframe.operators import aggregate as A
from sondeframe.operators import qc
from sondeframe.queries.common import E, G, events, on_grid, r, rounded, table
from sondeframe.sources import adapters


def _even(spark: SparkSession, d: str) -> DataFrame:
    """Assignments of event profiles: the user's number modulo 4."""
    return adapters.event_profiles(table(spark, d, "events")).select("profile_id", (F.col("profile_id").cast("long") % 4).cast("int").alias("cluster"))


def mean_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.mean_profile(on_grid(spark, d)), 4)


def level_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.level_coverage(on_grid(spark, d)))


def level_moments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.level_moments(on_grid(spark, d)))


def level_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.level_quantiles(on_grid(spark, d), ["t", "ff"]), 5)


def cluster_level_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.level_quantiles(A.with_derived(on_grid(spark, d)).join(_even(spark, d), "profile_id"), ["t", "rh"], (0.25, 0.75), ["cluster"]), 4)


def circular_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.circular_profile(on_grid(spark, d)), 4)


def profile_statistics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.profile_statistics(on_grid(spark, d)), 4)


def gated_statistics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.gated_statistics(on_grid(spark, d), ["t", "td"], (0.1, 0.9), 0.97), 4)


def inversion_statistics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.inversion_statistics(events(spark, d)))


def boundary_layer(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.boundary_layer_height(events(spark, d)))


def cluster_wind(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.cluster_wind(events(spark, d), _even(spark, d)))


def diagnose_clusters(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.diagnose_clusters(on_grid(spark, d), _even(spark, d)), 4)


def hour_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.hour_counts(table(spark, d, "events").select(F.col("ts").alias("date")))


def describe_values(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.describe(table(spark, d, "lineitem"), "l_extendedprice"), 4)


def value_histogram(spark: SparkSession, d: str) -> DataFrame:
    return A.histogram(table(spark, d, "lineitem"), "l_quantity", 10, 1.0, 51.0)


def value_ellipse(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.ellipse(table(spark, d, "lineitem"), "l_quantity", "l_discount", ["l_returnflag"]), 5)


def value_density(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.density(table(spark, d, "part"), "p_size", "p_retailprice"), 9)


def supplier_extremes(spark: SparkSession, d: str) -> DataFrame:
    """Of suppliers' items by ship date: the days kept by the falling-value rule."""
    rows = adapters.supplier_levels(table(spark, d, "lineitem"))
    return qc.keep_descending(rows).groupBy("profile_id").agg(F.count("*").alias("n"), F.min("p_niv").alias("least"))


QUERIES = {f.__name__: f for f in (
    mean_profile, level_coverage, level_moments, level_quantiles, cluster_level_quantiles, circular_profile, profile_statistics, gated_statistics, inversion_statistics,
    boundary_layer, cluster_wind, diagnose_clusters, hour_counts, describe_values, value_histogram, value_ellipse, value_density, supplier_extremes,
)}

_EG = f"WITH {E}, {G}"
_M = "(-1 * ff * sin(radians(dd)))", "(-1 * ff * cos(radians(dd)))"
_DIR = "degrees(atan2(-1 * u, -1 * v)) - 360 * floor(degrees(atan2(-1 * u, -1 * v)) / 360)"
_ORDER = "PARTITION BY profile_id ORDER BY altitude NULLS LAST, level_idx"
_EVEN = "a AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS profile_id, CAST(user_id % 4 AS INTEGER) AS cluster FROM events)"


def _q(v: str, q: float, name: str, digits: int = 6) -> str:
    return r(f"quantile_cont({v}, CAST({q} AS DOUBLE))", name, digits)


def _gradient(y: str, window: str) -> str:
    """The uneven gradient in SQL; rn, n, and the window's altitude are there."""
    y0, y2, z0, z2 = f"lag({y}) OVER {window}", f"lead({y}) OVER {window}", f"(altitude - lag(altitude) OVER {window})", f"(lead(altitude) OVER {window} - altitude)"
    return f"""CASE WHEN rn = 1 THEN ({y2} - {y}) / nullif({z2}, 0e0) WHEN rn = n THEN ({y} - {y0}) / nullif({z0}, 0e0)
        ELSE ({z0} * {z0} * {y2} + ({z2} * {z2} - {z0} * {z0}) * {y} - {z2} * {z2} * {y0}) / nullif({z0} * {z2} * ({z0} + {z2}), 0e0) END"""


SQL = {
    "value_density": f"""WITH s AS (SELECT CAST(min(p_size) AS DOUBLE) AS x0, CAST(max(p_size) AS DOUBLE) AS x1, min(p_retailprice) AS y0, max(p_retailprice) AS y1,
            var_samp(p_size) * 0.09e0 AS a, var_samp(p_retailprice) * 0.09e0 AS c, covar_samp(p_size, p_retailprice) * 0.09e0 AS b, count(*) AS n FROM part),
        k AS (SELECT *, a * c - b * b AS det FROM s),
        mesh AS (SELECT x0 + (x1 - x0) / 99e0 * i AS gx, y0 + (y1 - y0) / 99e0 * j AS gy FROM k, range(100) p(i), range(100) q(j))
        SELECT {r('gx', 'gx', 9)}, {r('gy', 'gy', 9)}, {r("sum(exp(-0.5e0 * (c * (gx - p_size) * (gx - p_size) - 2 * b * (gx - p_size) * (gy - p_retailprice) + a * (gy - p_retailprice) * (gy - p_retailprice)) / det)) / (2 * pi() * any_value(n) * sqrt(any_value(det)))", 'density', 9)}
        FROM mesh, part, k GROUP BY mesh.gx, mesh.gy""",
    "mean_profile": f"""{_EG}, m AS (SELECT g_idx, any_value(altitude) AS altitude, avg(t) AS t, avg(td) AS td, avg(p_niv) AS p_niv, avg({_M[0]}) AS u, avg({_M[1]}) AS v, count(*) AS n_profiles FROM g GROUP BY 1)
        SELECT g_idx, altitude, {r('t', 't', 4)}, {r('td', 'td', 4)}, {r('p_niv', 'p_niv', 4)}, n_profiles, {r('sqrt(u * u + v * v)', 'ff', 4)}, {r(_DIR, 'dd', 4)} FROM m""",
    "level_coverage": f"{_EG} SELECT g_idx, {r('avg(CAST(t IS NOT NULL AS INT))', 'coverage')} FROM g GROUP BY 1",
    "level_moments": f"{_EG} SELECT g_idx, {r('avg(ff)', 'mean')}, {r('stddev_pop(ff)', 'std')} FROM g GROUP BY 1",
    "level_quantiles": f"{_EG} SELECT g_idx, {', '.join(x for v in ('t', 'ff') for x in (r(f'avg({v})', f'{v}_mean', 5), _q(v, 0.1, f'{v}_q10', 5), _q(v, 0.9, f'{v}_q90', 5)))} FROM g GROUP BY 1",
    "cluster_level_quantiles": f"""{_EG}, {_EVEN}, h AS (SELECT *, 100 * exp(17.625e0 * (td - 273.15e0) / (243.04e0 + (td - 273.15e0))) / exp(17.625e0 * (t - 273.15e0) / (243.04e0 + (t - 273.15e0))) AS rh FROM g JOIN a USING (profile_id))
        SELECT cluster, g_idx, {', '.join(x for v in ('t', 'rh') for x in (r(f'avg({v})', f'{v}_mean', 4), _q(v, 0.25, f'{v}_q25', 4), _q(v, 0.75, f'{v}_q75', 4)))} FROM h GROUP BY 1, 2""",
    "circular_profile": f"{_EG}, m AS (SELECT g_idx, degrees(atan2(avg(sin(radians(dd))), avg(cos(radians(dd))))) AS x FROM g GROUP BY 1) SELECT g_idx, {r('x - 360 * floor(x / 360)', 'dd', 4)} FROM m",
    "profile_statistics": f"""{_EG}, m AS (SELECT g_idx, avg(t) AS a, quantile_cont(t, CAST(0.05 AS DOUBLE)) AS b, quantile_cont(t, CAST(0.95 AS DOUBLE)) AS c, stddev_pop(t) AS s, avg(ff) AS f, avg({_M[0]}) AS u, avg({_M[1]}) AS v FROM g GROUP BY 1)
        SELECT g_idx, {r('a', 't_mean', 4)}, {r('b', 't_q05', 4)}, {r('c', 't_q95', 4)}, {r('s', 't_std', 4)}, {r('f', 'speed_mean', 4)}, {r('sqrt(u * u + v * v)', 'vector_speed', 4)}, {r(_DIR, 'vector_direction', 4)} FROM m""",
    "gated_statistics": f"""{_EG}, n AS (SELECT floor(count(DISTINCT profile_id) * 0.97e0) AS least FROM g)
        SELECT g_idx, {', '.join(r(f'CASE WHEN count({v}) >= any_value(least) THEN {x} END', f'{v}_{s}', 4) for v in ('t', 'td') for s, x in (('mean', f'avg({v})'), ('low', f'quantile_cont({v}, CAST(0.1 AS DOUBLE))'), ('high', f'quantile_cont({v}, CAST(0.9 AS DOUBLE))')))} FROM g, n GROUP BY 1""",
    "inversion_statistics": f"""WITH {E}, s AS (SELECT profile_id, t - lag(t) OVER w AS dt, altitude - lag(altitude) OVER w AS dz FROM e WINDOW w AS ({_ORDER})),
        p AS (SELECT profile_id, max(dt) AS strength, coalesce(bool_or(dt / nullif(dz, 0e0) > 0), false) AND coalesce(max(dt) >= 2, false) AS inverted FROM s GROUP BY 1)
        SELECT count(*) AS profiles, {r('avg(CAST(inverted AS INT))', 'inversion_frequency')}, {r('avg(strength) FILTER (inverted)', 'mean_inversion_strength')} FROM p""",
    "boundary_layer": f"""WITH {E}, n AS (SELECT *, row_number() OVER ({_ORDER}) AS rn, count(*) OVER (PARTITION BY profile_id) AS n FROM e), x AS (SELECT *, {_gradient('t', 'w')} AS g FROM n WINDOW w AS ({_ORDER}))
        SELECT profile_id, {r('altitude', 'height')} FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY g DESC NULLS LAST, altitude) AS k FROM x) WHERE k = 1""",
    "cluster_wind": f"""WITH {E}, {_EVEN}, l AS (SELECT *, count(*) OVER (PARTITION BY profile_id) AS n FROM e WHERE altitude <= 1000)
        SELECT cluster, {r(f'avg({_M[0]})', 'u')}, {r(f'avg({_M[1]})', 'v')}, {r(f'avg(sqrt({_M[0]} * {_M[0]} + {_M[1]} * {_M[1]}))', 'speed')} FROM a LEFT JOIN (SELECT * FROM l WHERE n >= 3) USING (profile_id) GROUP BY 1""",
    "diagnose_clusters": f"""{_EG}, {_EVEN}, j AS (SELECT cluster, g_idx, any_value(altitude) AS altitude, avg(t) AS t, avg(td) AS td, avg({_M[0]}) AS u, avg({_M[1]}) AS v FROM g JOIN a USING (profile_id) GROUP BY 1, 2),
        n AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY altitude) AS rn, count(*) OVER (PARTITION BY cluster) AS n FROM j),
        x AS (SELECT *, {_gradient('t', 'w')} AS gt, {_gradient('u', 'w')} AS gu, {_gradient('v', 'w')} AS gv FROM n WINDOW w AS (PARTITION BY cluster ORDER BY altitude))
        SELECT cluster, {r('arg_min(t, altitude) - 273.15e0', 'surface_t', 4)}, {r('avg(t - td)', 'depression', 4)}, {r('var_pop(t)', 't_variance', 4)}, {r('avg(gt)', 'lapse', 4)}, {r('max(sqrt(u * u + v * v))', 'max_speed', 4)}, {r('max(sqrt(gu * gu + gv * gv))', 'max_shear', 4)} FROM x GROUP BY 1""",
    "hour_counts": "SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM events GROUP BY 1",
    "describe_values": f"""SELECT count(l_extendedprice) AS n, {r('avg(l_extendedprice)', 'mean', 4)}, {r('stddev_samp(l_extendedprice)', 'std', 4)}, {r('min(l_extendedprice)', 'least', 4)}, {_q('l_extendedprice', 0.25, 'q25', 4)}, {_q('l_extendedprice', 0.5, 'median', 4)}, {_q('l_extendedprice', 0.75, 'q75', 4)}, {r('max(l_extendedprice)', 'largest', 4)} FROM lineitem""",
    "value_histogram": "SELECT CAST(least(floor((l_quantity - 1e0) / 5e0), 9) AS INTEGER) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 1 AND 51 GROUP BY 1",
    "value_ellipse": f"""WITH c AS (SELECT l_returnflag, avg(l_quantity) AS x, avg(l_discount) AS y, var_samp(l_quantity) AS a, var_samp(l_discount) AS c, covar_samp(l_quantity, l_discount) AS b FROM lineitem GROUP BY 1),
        d AS (SELECT *, (a + c) / 2 AS h, sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) AS s FROM c)
        SELECT l_returnflag, {r('x', 'x', 5)}, {r('y', 'y', 5)}, {r('4 * sqrt(h + s)', 'width', 5)}, {r('4 * sqrt(greatest(h - s, 0e0))', 'height', 5)}, {r('degrees(0.5e0 * atan2(2 * b, a - c))', 'angle', 5)} FROM d""",
    "supplier_extremes": """WITH p AS (SELECT CAST(l_suppkey AS VARCHAR) AS profile_id, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS z, max(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2),
        m AS (SELECT *, min(p) OVER (PARTITION BY profile_id ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM p)
        SELECT profile_id, count(*) AS n, min(p) AS least FROM m WHERE least IS NULL OR p <= least GROUP BY 1""",
}
