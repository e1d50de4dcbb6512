"""Clusters over the calendar, from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondeframe.operators import calendar as C
from sondeframe.queries.common import r, rounded, table
from sondeframe.sources import adapters

SEASON = [12, 1, 2]


def frame(spark: SparkSession, d: str) -> DataFrame:
    return C.with_parts(adapters.order_calendar(table(spark, d, "orders")))


def calendar_frame(spark: SparkSession, d: str) -> DataFrame:
    rows = adapters.order_calendar(table(spark, d, "orders"))
    return C.calendar(rows, rows).drop("date")


def month_counts(spark: SparkSession, d: str) -> DataFrame:
    return C.month_counts(frame(spark, d))


def month_shares(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.month_shares(frame(spark, d), SEASON))


def month_table(spark: SparkSession, d: str) -> DataFrame:
    out = C.month_table(frame(spark, d), [1, 2, 3, 4, 5])
    return out.select("month", *[F.col(str(k)).alias(f"c{k}") for k in range(1, 6)])


def feature_season_median(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.feature_seasonal(frame(spark, d), "value"), 4)


def feature_season_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.feature_seasonal(frame(spark, d), "value", "mean"))


def carpet_positions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.carpet(frame(spark, d), SEASON))


def season_years(spark: SparkSession, d: str) -> DataFrame:
    rows = C.in_season(frame(spark, d), SEASON)
    return rows.groupBy(C.season_year(F.col("date"), SEASON).alias("season_year")).agg(F.count("*").alias("n"))


def dominant_bins(spark: SparkSession, d: str) -> DataFrame:
    return C.dominant(C.season_bins(frame(spark, d), SEASON))


def bin_entropy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.bin_entropy(dominant_bins(spark, d), 5))


def year_agreement(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.year_agreement(dominant_bins(spark, d)))


QUERIES = {f.__name__: f for f in (
    calendar_frame, month_counts, month_shares, month_table, feature_season_median, feature_season_mean, carpet_positions, season_years, dominant_bins, bin_entropy, year_agreement,
)}

_O = "o AS (SELECT CAST(o_orderkey AS VARCHAR) AS profile_id, o_orderdate AS date, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS cluster, o_totalprice AS value, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders)"
_ALL = "f AS (SELECT * FROM (SELECT DISTINCT cluster FROM o), (SELECT DISTINCT month FROM o))"
_SEASON = "s AS (SELECT * FROM (VALUES (12, 0), (1, 31), (2, 62)) t(month, off))"
_DOS = "off + day(date) - 1"
_DOMINANT = f"""{_O}, {_SEASON}, b AS (SELECT cluster, year, CAST(least(floor(({_DOS}) / 7), 12) AS INTEGER) AS bin FROM o JOIN s USING (month)),
    c AS (SELECT year, bin, cluster, count(*) AS n FROM b GROUP BY 1, 2, 3),
    k AS (SELECT *, row_number() OVER (PARTITION BY year, bin ORDER BY n DESC, cluster) AS rn, sum(n) OVER (PARTITION BY year, bin) AS total FROM c),
    dom AS (SELECT year, bin, cluster FROM k WHERE rn = 1 AND total >= 3)"""

SQL = {
    "calendar_frame": f"WITH {_O} SELECT profile_id, cluster, month, year, CAST(dayofyear(date) AS INTEGER) AS doy, CAST(hour(date) AS INTEGER) AS hour FROM o",
    "month_counts": f"WITH {_O}, {_ALL} SELECT cluster, month, count(profile_id) AS n FROM f LEFT JOIN o USING (cluster, month) GROUP BY 1, 2",
    "month_shares": f"""WITH {_O}, f AS (SELECT * FROM (SELECT DISTINCT cluster FROM o), (VALUES (12), (1), (2)) t(month)), c AS (SELECT cluster, month, count(profile_id) AS n FROM f LEFT JOIN o USING (cluster, month) GROUP BY 1, 2)
        SELECT cluster, month, n, {r('coalesce(100e0 * n / nullif(sum(n) OVER (PARTITION BY month), 0), 0e0)', 'share')} FROM c""",
    "month_table": f"WITH {_O} SELECT month, {', '.join(f'count(*) FILTER (cluster = {k}) AS c{k}' for k in range(1, 6))} FROM o GROUP BY 1",
    "feature_season_median": f"WITH {_O}, {_ALL} SELECT cluster, month, {r('median(value)', 'centre', 4)}, {r('quantile_cont(value, CAST(0.25 AS DOUBLE))', 'low', 4)}, {r('quantile_cont(value, CAST(0.75 AS DOUBLE))', 'high', 4)} FROM f LEFT JOIN o USING (cluster, month) GROUP BY 1, 2",
    "feature_season_mean": f"WITH {_O}, {_ALL} SELECT cluster, month, {r('avg(value)', 'centre')}, {r('avg(value) - stddev_samp(value)', 'low')}, {r('avg(value) + stddev_samp(value)', 'high')} FROM f LEFT JOIN o USING (cluster, month) GROUP BY 1, 2",
    "carpet_positions": f"WITH {_O}, {_SEASON} SELECT profile_id, cluster, year, {r(f'{_DOS} + hour(date) / 24e0', 'day')} FROM o JOIN s USING (month)",
    "season_years": f"WITH {_O} SELECT CAST(year - CASE WHEN month < 12 THEN 1 ELSE 0 END AS INTEGER) AS season_year, count(*) AS n FROM o WHERE month IN (12, 1, 2) GROUP BY 1",
    "dominant_bins": f"WITH {_DOMINANT} SELECT year, bin, cluster FROM dom",
    "bin_entropy": f"""WITH {_DOMINANT}, n AS (SELECT bin, cluster, count(*) AS n FROM dom GROUP BY 1, 2), p AS (SELECT bin, n, n / sum(n) OVER (PARTITION BY bin) AS p FROM n)
        SELECT bin, CAST(sum(n) AS BIGINT) AS years, {r('-sum(p * ln(p)) / ln(5e0)', 'entropy')} FROM p GROUP BY 1 HAVING sum(n) >= 2""",
    "year_agreement": f"""WITH {_DOMINANT}, j AS (SELECT x.year AS year_a, y.year AS year_b, x.cluster AS a, y.cluster AS b FROM dom x JOIN dom y ON x.bin = y.bin AND x.year < y.year),
        cells AS (SELECT year_a, year_b, a, b, CAST(count(*) AS DOUBLE) AS n FROM j GROUP BY 1, 2, 3, 4),
        sm AS (SELECT year_a, year_b, sum(n * (n - 1) / 2) AS s, sum(n) AS n FROM cells GROUP BY 1, 2),
        ra AS (SELECT year_a, year_b, sum(n * (n - 1) / 2) AS a FROM (SELECT year_a, year_b, a, sum(n) AS n FROM cells GROUP BY 1, 2, 3) GROUP BY 1, 2),
        rb AS (SELECT year_a, year_b, sum(n * (n - 1) / 2) AS b FROM (SELECT year_a, year_b, b, sum(n) AS n FROM cells GROUP BY 1, 2, 3) GROUP BY 1, 2),
        x AS (SELECT *, a * b / nullif(n * (n - 1) / 2, 0e0) AS ex FROM sm JOIN ra USING (year_a, year_b) JOIN rb USING (year_a, year_b))
        SELECT year_a, year_b, {r('coalesce((s - ex) / nullif((a + b) / 2 - ex, 0e0), 1e0)', 'ari')}, CAST(n AS BIGINT) AS n FROM x WHERE n >= 2""",
}
