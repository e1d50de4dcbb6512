"""Quality control, resampling and numerics along profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sondeframe.functions import levels as L
from sondeframe.functions import physics as P
from sondeframe.operators import aggregate, features, qc, resample, stitch
from sondeframe.queries import feature_sql
from sondeframe.queries.common import E, G, events, on_grid, r, round_to, rounded, table
from sondeframe.sources import adapters, soundings


def _w() -> object:
    return Window.partitionBy("profile_id").orderBy(F.col("altitude").asc_nulls_last(), "level_idx")


def qc_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Values out of range and dew points above temperature, by profile."""
    rows = qc.limit_dew_point(qc.apply_limits(events(spark, d)))
    return rows.groupBy("profile_id").agg(F.sum("n_threshold").alias("threshold"), F.sum("n_dewpoint").alias("dewpoint"), F.count("t").alias("n_t"), F.count("td").alias("n_td"))


def _floored(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).withColumn("altitude", F.floor(F.col("altitude") / 250) * F.lit(250.0))


def dedup_first_level(spark: SparkSession, d: str) -> DataFrame:
    return qc.first_at_height(_floored(spark, d)).select("profile_id", "level_idx", "altitude")


def null_run_longest(spark: SparkSession, d: str) -> DataFrame:
    return qc.longest_null_run(events(spark, d))


def monotone_levels(spark: SparkSession, d: str) -> DataFrame:
    return qc.keep_descending(events(spark, d).filter("p_niv is not null")).select("profile_id", "level_idx")


def monotone_stats(spark: SparkSession, d: str) -> DataFrame:
    found = qc.monotonicity(events(spark, d).filter("p_niv is not null"))
    return rounded(found.withColumn("violation_idx", F.concat_ws(",", F.transform("violation_idx", lambda x: x.cast("string")))))


def violation_islands(spark: SparkSession, d: str) -> DataFrame:
    found = qc.monotonicity(events(spark, d).filter("p_niv is not null")).select("profile_id", F.explode("violation_idx").alias("at"))
    runs = L.islands(found, ["profile_id"], "at", "at")
    return runs.select("profile_id", *[F.col(c).cast("long").alias(c) for c in ("first", "last", "length")])


def strictly_descending(spark: SparkSession, d: str) -> DataFrame:
    return qc.strictly_descending(events(spark, d).filter("p_niv is not null"))


def spike_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = qc.flag_spikes(events(spark, d))
    return rows.groupBy("profile_id").agg(F.sum("n_temp_spike").alias("temp_spikes"), F.sum("n_wind_spike").alias("wind_spikes"), F.count("t").alias("n_t"), F.count("ff").alias("n_ff"), F.count("dd").alias("n_dd"))


def qc_clean(spark: SparkSession, d: str) -> DataFrame:
    """The whole of quality control: one row of statistics a profile."""
    _, stats = qc.clean(_floored(spark, d))
    return stats.select(*[c for c in stats.columns if c != "mono"], F.col("mono.violation_type").alias("violation_type"))


def coverage_filter(spark: SparkSession, d: str) -> DataFrame:
    return qc.coverage(events(spark, d), 0.0, 7100.0, 50.0, 0.98)


def usable_profiles(spark: SparkSession, d: str) -> DataFrame:
    return qc.usable(qc.apply_limits(events(spark, d)), min_levels=60, max_null_ratio=0.1)


def qc_roll_up(spark: SparkSession, d: str) -> DataFrame:
    return rounded(qc.roll_up(qc.clean(_floored(spark, d))[1]))


def resample_linear(spark: SparkSession, d: str) -> DataFrame:
    return rounded(on_grid(spark, d).drop("altitude"), 5)


def point_interpolation(spark: SparkSession, d: str) -> DataFrame:
    found = resample.at_heights(events(spark, d), ["t", "p_niv"], [500.0, 3000.0])
    return rounded(found, 5)


def gradients(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumn("g", L.gradient("t", "altitude", _w())).withColumn("ratio", L.gradient_ratio("t", "altitude", _w()))
    rows = rows.withColumn("smooth", L.smooth5("t", _w())).withColumn("s3", L.smooth3("t", _w()))
    return rounded(rows.withColumn("peak", L.local_maximum("s3", _w())).select("profile_id", "level_idx", "g", "ratio", "smooth", "s3", "peak"))


def lapse_layers(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumn("layer", F.floor(F.col("altitude") / 1000).cast("long"))
    return rounded(rows.groupBy("profile_id", "layer").agg(L.slope(F.col("t"), F.col("altitude")).alias("slope")))


def column_integral(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("profile_id").orderBy("altitude", "level_idx")
    rows = events(spark, d).filter("p_niv is not null").withColumn("a", L.trapezoid_term("t", "p_niv", w))
    return rounded(rows.groupBy("profile_id").agg(F.abs(F.sum("a")).alias("integral")), 3)


def highest_value(spark: SparkSession, d: str) -> DataFrame:
    return rounded(events(spark, d).groupBy("profile_id").agg(F.max("ff").alias("jet"), L.first_argmax(F.col("ff"), F.col("altitude")).alias("height")))


def wind_components(spark: SparkSession, d: str) -> DataFrame:
    u, v = P.components("ff", "dd", -1)
    rows = events(spark, d).withColumn("u", u).withColumn("v", v)
    return rounded(rows.select("profile_id", "level_idx", "u", "v", P.speed("u", "v").alias("speed")))


def thermodynamics(spark: SparkSession, d: str) -> DataFrame:
    rows = qc.limit_dew_point(qc.apply_limits(events(spark, d)))
    return rounded(rows.select(
        "profile_id", "level_idx", P.saturation_pressure("t").alias("es"), P.relative_humidity("t", "td").alias("rh"), P.relative_humidity_plain("t", "td").alias("rh_plain"),
        P.specific_humidity("td", "p_niv").alias("q"), P.potential_temperature("t", "p_niv").alias("theta"), P.hectopascal("p_niv").alias("p_hpa"), P.knots("ff").alias("ff_kt"),
        P.recentred("dd", 90.0).alias("dd_axis"),
    ), 4)


def dry_adiabat(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumn("zr", P.above_surface()).withColumn("_a", P.dry_adiabat())
    return rounded(rows.select("profile_id", "level_idx", "zr", (F.col("t") - F.col("_a")).alias("t_anomaly"), (F.col("td") - F.col("_a")).alias("td_anomaly")), 4)


def layer_features(spark: SparkSession, d: str) -> DataFrame:
    table = features.layer_features(events(spark, d))  # means of few decimals: more digits, past their ties
    return table.select(*[round_to(F.col(c), 9 if c.startswith("T_mean") else 6).alias(c) if c != "profile_id" else F.col(c) for c in table.columns])


def basic_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.basic_features(events(spark, d)), 4)


def wind_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.wind_features(events(spark, d)), 10)


def full_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.full_features(qc.apply_limits(events(spark, d))))


def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.diagnostics(qc.apply_limits(events(spark, d))))


def parcel(spark: SparkSession, d: str) -> DataFrame:
    rows = qc.limit_dew_point(qc.apply_limits(events(spark, d)))
    return rounded(features.parcel_energy(rows, features.parcel_profile(rows)), 4)


def stitch_chains(spark: SparkSession, d: str) -> DataFrame:
    return stitch.chains(adapters.order_fragments(table(spark, d, "orders"))).select("station", "profile_seq", "chain")


def record_segments(spark: SparkSession, d: str) -> DataFrame:
    return adapters.turn_records(table(spark, d, "conversations"))


def text_records(spark: SparkSession, d: str) -> DataFrame:
    """Event profiles written as text records and parsed again."""
    rows = events(spark, d)
    names = ["p_niv", "altitude", "t", "td", "dd", "ff"]
    cell = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names])
    data = rows.select(F.col("profile_id").alias("file"), (F.col("level_idx") + 3).alias("line_no"), cell.alias("line"))
    heads = rows.select(F.col("profile_id").alias("file")).distinct().select(
        "file", F.posexplode(F.array(F.lit("numer_sta,date,nb_niv"), F.concat(F.lit("89642,20240101000000,"), F.col("file")), F.lit(",".join(names)))).alias("line_no", "line")
    )
    lines = heads.select("file", F.col("line_no").cast("long").alias("line_no"), "line").unionByName(data)
    return soundings.read_profiles(lines)[1].select(F.substring_index("profile_id", "#", 1).alias("profile_id"), "level_idx", *names)


def every_nth_level(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.every_nth(events(spark, d), 10).select("profile_id", "level_idx")


QUERIES = {f.__name__: f for f in (
    qc_thresholds, dedup_first_level, null_run_longest, monotone_levels, monotone_stats, violation_islands, strictly_descending, spike_flags, qc_clean, coverage_filter,
    usable_profiles, qc_roll_up, resample_linear, point_interpolation, gradients, lapse_layers, column_integral, highest_value, wind_components, thermodynamics, dry_adiabat,
    layer_features, basic_features, wind_features, full_features, diagnostics, parcel, stitch_chains, record_segments, text_records, every_nth_level,
)}

_LIMITED = """lim AS (
    SELECT profile_id, level_idx, CASE WHEN altitude BETWEEN -300 AND 40000 THEN altitude END AS altitude, CASE WHEN p_niv BETWEEN 500 AND 110000 THEN p_niv END AS p_niv,
           CASE WHEN t BETWEEN 150 AND 350 THEN t END AS t, CASE WHEN td BETWEEN 150 AND 350 THEN td END AS td, CASE WHEN dd BETWEEN 0 AND 360 THEN dd END AS dd, CASE WHEN ff BETWEEN 0 AND 200 THEN ff END AS ff,
           CAST(coalesce(altitude NOT BETWEEN -300 AND 40000, false) AS INT) + CAST(coalesce(p_niv NOT BETWEEN 500 AND 110000, false) AS INT) + CAST(coalesce(t NOT BETWEEN 150 AND 350, false) AS INT)
           + CAST(coalesce(td NOT BETWEEN 150 AND 350, false) AS INT) + CAST(coalesce(dd NOT BETWEEN 0 AND 360, false) AS INT) + CAST(coalesce(ff NOT BETWEEN 0 AND 200, false) AS INT) AS n_threshold
    FROM e),
    dew AS (SELECT * REPLACE (CASE WHEN coalesce(td > t, false) THEN NULL ELSE td END AS td), CAST(coalesce(td > t, false) AS INT) AS n_dewpoint FROM lim)"""
_ORDER = "PARTITION BY profile_id ORDER BY altitude NULLS LAST, level_idx"
_FLOORED = E.replace("e AS (", "e0 AS (", 1) + ", e AS (SELECT * REPLACE (floor(altitude / 250) * 250e0 AS altitude) FROM e0)"


def _spikes(source: str, prefix: str = "") -> str:
    """Common tables with spike flags of ``source``, which has a boolean column alive."""
    return f"""{prefix}vt AS (SELECT profile_id, level_idx, altitude - lag(altitude) OVER ({_ORDER}) AS dz, t - lag(t) OVER ({_ORDER}) AS dy FROM {source} WHERE alive AND t IS NOT NULL AND altitude IS NOT NULL),
    {prefix}vf AS (SELECT profile_id, level_idx, altitude - lag(altitude) OVER ({_ORDER}) AS dz, ff - lag(ff) OVER ({_ORDER}) AS dy FROM {source} WHERE alive AND ff IS NOT NULL AND altitude IS NOT NULL),
    {prefix}bt AS (SELECT profile_id, count(*) AS n FROM {prefix}vt WHERE dz > 50 AND (dy / dz < -0.0294e0 OR dy / dz > 0.1e0) GROUP BY 1),
    {prefix}bf AS (SELECT profile_id, count(*) AS n FROM {prefix}vf WHERE dz > 50 AND abs(dy / dz) > 0.15e0 GROUP BY 1)"""


_CLEAN = f"""{_FLOORED}, {_LIMITED},
    d1 AS (SELECT *, row_number() OVER (PARTITION BY profile_id, altitude ORDER BY level_idx) AS rn FROM dew),
    d2 AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY level_idx) - row_number() OVER (PARTITION BY profile_id, p_niv IS NULL ORDER BY level_idx) AS run FROM d1 WHERE rn = 1),
    gaps AS (SELECT profile_id, max(CASE WHEN missing THEN n ELSE 0 END) AS largest FROM (SELECT profile_id, p_niv IS NULL AS missing, run, count(*) AS n FROM d2 GROUP BY 1, 2, 3) GROUP BY 1),
    p1 AS (SELECT *, min(p_niv) OVER ({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM d2 WHERE p_niv IS NOT NULL),
    p2 AS (SELECT *, NOT coalesce(p_niv > least, false) AS alive FROM p1), {_spikes('p2')},
    pp AS (SELECT profile_id, count(*) AS total, count(*) FILTER (NOT alive) AS bad, count(*) FILTER (alive) AS left_ FROM p2 GROUP BY 1),
    facts AS (
        SELECT f.profile_id, CAST(sum(n_threshold) AS BIGINT) AS threshold, CAST(sum(n_dewpoint) AS BIGINT) AS dewpoint, count(*) AS len_before FROM dew f GROUP BY 1),
    nulls AS (SELECT profile_id, count(*) FILTER (p_niv IS NULL) AS pressure_nan FROM d2 GROUP BY 1),
    stats AS (
        SELECT f.profile_id, threshold, dewpoint, coalesce(bt.n, 0) AS temp_spikes, coalesce(bf.n, 0) AS wind_spikes, pressure_nan, largest AS largest_gap_pressure_removed,
               coalesce(bad, 0) AS non_monotonic_pressure, len_before, coalesce(left_, 0) AS len_after,
               CASE WHEN largest > 5 THEN 'pressure_gap' WHEN coalesce(left_, 0) < 20 THEN 'short' ELSE 'kept' END AS status,
               CASE WHEN coalesce(bad, 0) = 0 THEN 'none' WHEN bad / total < 0.2e0 THEN 'sparse' ELSE 'dense' END AS violation_type
        FROM facts f JOIN nulls USING (profile_id) JOIN gaps USING (profile_id) LEFT JOIN pp USING (profile_id) LEFT JOIN bt USING (profile_id) LEFT JOIN bf USING (profile_id))"""

_VIOLATIONS = f"""v0 AS (SELECT profile_id, row_number() OVER ({_ORDER}) - 1 AS pos, p_niv, min(p_niv) OVER ({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM e WHERE p_niv IS NOT NULL),
    v AS (SELECT *, coalesce(p_niv > least, false) AS bad FROM v0)"""

_GRAD = f"""n0 AS (SELECT *, lag(t) OVER w AS y0, lead(t) OVER w AS y2, lag(altitude) OVER w AS z0, lead(altitude) OVER w AS z2, row_number() OVER w AS rn, count(*) OVER (PARTITION BY profile_id) AS n,
        lag(t, 2) OVER w AS ya, lead(t, 2) OVER w AS yb, lag(t, 3) OVER w AS yaa, lead(t, 3) OVER w AS ybb FROM e WINDOW w AS ({_ORDER}))"""


def _moist_rate(t: str, p: str) -> str:
    """Kelvin a pascal along the moist adiabat."""
    r_ = f"(0.622e0 * 611.2e0 * exp(17.67e0 * (({t}) - 273.15e0) / (({t}) - 29.65e0)) / (({p}) - 611.2e0 * exp(17.67e0 * (({t}) - 273.15e0) / (({t}) - 29.65e0))))"
    return f"((287.05e0 * ({t}) + 2.501e6 * {r_}) / (1004e0 + 2.501e6 * 2.501e6 * {r_} * 0.622e0 / (287.05e0 * ({t}) * ({t}))) / ({p}))"


#: Midpoint steps of 500 Pa at most, all profiles at once.
_PARCEL = f"""RECURSIVE {E}, {_LIMITED},
    own AS (SELECT profile_id, p_niv AS p, t, row_number() OVER w AS k, first_value(p_niv) OVER w AS p0, first_value(t) OVER w AS t0, first_value(td) OVER w AS td0
            FROM dew WHERE p_niv IS NOT NULL AND t IS NOT NULL WINDOW w AS (PARTITION BY profile_id ORDER BY p_niv DESC, level_idx)),
    lcl AS (SELECT *, p0 * pow(lcl_t / t0, 1 / 0.286e0) AS lcl_p FROM (SELECT *, CASE WHEN td0 < t0 THEN 1 / (1 / (td0 - 56) + ln(t0 / td0) / 800) + 56 WHEN td0 IS NOT NULL THEN t0 END AS lcl_t FROM own)),
    moist AS (SELECT profile_id, k, lcl_t, pa, greatest(1, CAST(ceil((pa - p) / 500e0) AS BIGINT)) AS steps, p - pa AS dp
              FROM (SELECT *, coalesce(lag(p) OVER (PARTITION BY profile_id ORDER BY k), lcl_p) AS pa FROM lcl WHERE p < lcl_p)),
    steps AS (SELECT profile_id, k, pa + i * dp / steps AS pa, dp / steps AS dp, i = steps - 1 AS ends, row_number() OVER (PARTITION BY profile_id ORDER BY k, i) AS n
              FROM (SELECT *, unnest(range(steps)) AS i FROM moist)),
    lifted AS (SELECT DISTINCT profile_id, CAST(0 AS BIGINT) AS n, lcl_t AS t FROM moist
               UNION ALL
               SELECT profile_id, n, t + {_moist_rate("half", "pa + dp / 2")} * dp
               FROM (SELECT s.profile_id, s.n, l.t, s.pa, s.dp, l.t + {_moist_rate("l.t", "s.pa")} * s.dp / 2 AS half FROM lifted l JOIN steps s ON s.profile_id = l.profile_id AND s.n = l.n + 1)),
    parcel AS (SELECT o.profile_id, o.k, o.p, CASE WHEN o.p < o.lcl_p THEN l.t WHEN o.lcl_p IS NOT NULL THEN o.t0 * pow(o.p / o.p0, 0.286e0) END - o.t AS d
               FROM lcl o LEFT JOIN steps s ON s.profile_id = o.profile_id AND s.k = o.k AND s.ends LEFT JOIN lifted l ON l.profile_id = s.profile_id AND l.n = s.n),
    excess AS (SELECT profile_id, 287.05e0 * (d + lead(d) OVER w) / 2 * (ln(p) - ln(lead(p) OVER w)) AS e FROM parcel WINDOW w AS (PARTITION BY profile_id ORDER BY k))"""


SQL = {
    "parcel": f"WITH {_PARCEL} SELECT profile_id, {r('sum(CASE WHEN e > 0 THEN e ELSE 0e0 END)', 'cape', 4)}, {r('sum(CASE WHEN e < 0 THEN e ELSE 0e0 END)', 'cin', 4)} FROM excess GROUP BY 1",
    "layer_features": feature_sql.LAYERS,
    "full_features": feature_sql.FULL,
    "diagnostics": feature_sql.DIAGNOSTICS,
    "qc_thresholds": f"WITH {E}, {_LIMITED} SELECT profile_id, CAST(sum(n_threshold) AS BIGINT) AS threshold, CAST(sum(n_dewpoint) AS BIGINT) AS dewpoint, count(t) AS n_t, count(td) AS n_td FROM dew GROUP BY 1",
    "dedup_first_level": f"WITH {_FLOORED} SELECT profile_id, level_idx, altitude FROM (SELECT *, row_number() OVER (PARTITION BY profile_id, altitude ORDER BY level_idx) AS rn FROM e) WHERE rn = 1",
    "null_run_longest": f"""WITH {E}, f AS (SELECT profile_id, p_niv IS NULL AS gap, row_number() OVER (PARTITION BY profile_id ORDER BY level_idx) - row_number() OVER (PARTITION BY profile_id, p_niv IS NULL ORDER BY level_idx) AS run FROM e)
        SELECT profile_id, coalesce(max(n) FILTER (gap), 0) AS longest FROM (SELECT profile_id, gap, run, count(*) AS n FROM f GROUP BY 1, 2, 3) GROUP BY 1""",
    "monotone_levels": f"""WITH {E}, m AS (SELECT profile_id, level_idx, p_niv, min(p_niv) OVER ({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM e WHERE p_niv IS NOT NULL)
        SELECT profile_id, level_idx FROM m WHERE least IS NULL OR p_niv <= least""",
    "monotone_stats": f"""WITH {E}, {_VIOLATIONS}
        SELECT profile_id, count(*) AS total_points, count(*) FILTER (bad) AS violations, coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (bad), '') AS violation_idx,
               {r("count(*) FILTER (bad) / count(*)", "violation_ratio")}, CASE WHEN count(*) FILTER (bad) = 0 THEN 'none' WHEN count(*) FILTER (bad) / count(*) < 0.2e0 THEN 'sparse' ELSE 'dense' END AS violation_type
        FROM v GROUP BY 1""",
    "violation_islands": f"""WITH {E}, {_VIOLATIONS}, q AS (SELECT profile_id, pos, pos - row_number() OVER (PARTITION BY profile_id ORDER BY pos) AS run FROM v WHERE bad)
        SELECT profile_id, min(pos) AS first, max(pos) AS last, count(*) AS length FROM q GROUP BY profile_id, run""",
    "strictly_descending": f"""WITH {E}, s AS (SELECT profile_id, p_niv - lag(p_niv) OVER ({_ORDER}) AS d, row_number() OVER ({_ORDER}) AS n FROM e WHERE p_niv IS NOT NULL)
        SELECT profile_id, bool_and(n = 1 OR coalesce(d < 0, false)) AS descending FROM s GROUP BY 1""",
    "spike_flags": f"""WITH {E}, a AS (SELECT *, true AS alive FROM e), {_spikes("a")}
        SELECT e.profile_id, coalesce(any_value(bt.n), 0) AS temp_spikes, coalesce(any_value(bf.n), 0) AS wind_spikes, count(t) - coalesce(any_value(bt.n), 0) AS n_t, count(ff) - coalesce(any_value(bf.n), 0) AS n_ff, count(dd) AS n_dd
        FROM e LEFT JOIN bt USING (profile_id) LEFT JOIN bf USING (profile_id) GROUP BY 1""",
    "qc_clean": f"WITH {_CLEAN} SELECT *, CAST(status = 'pressure_gap' AS BIGINT) AS discarded_b_of_pressure, CAST(status = 'short' AS BIGINT) AS discarded_b_of_len FROM stats",
    "qc_roll_up": f"""WITH {_CLEAN} SELECT count(*) AS profiles, {', '.join(f'count(*) FILTER ({c} <> 0) AS {c}' for c in ('threshold', 'dewpoint', 'temp_spikes', 'wind_spikes', 'pressure_nan', 'non_monotonic_pressure'))},
        count(*) FILTER (status = 'pressure_gap') AS discarded_b_of_pressure, count(*) FILTER (status = 'short') AS discarded_b_of_len,
        {r("1 - sum(CASE WHEN status = 'kept' THEN len_after ELSE 0 END) / sum(len_before)", "removed_share")} FROM stats""",
    "coverage_filter": f"WITH {E} SELECT profile_id, min(altitude) AS z_min, max(altitude) AS z_max, min(altitude) <= 50 AND max(altitude) >= 0.98e0 * 7100e0 AS covered FROM e GROUP BY 1",
    "usable_profiles": f"""WITH {E}, {_LIMITED}, s AS (SELECT *, altitude - lag(altitude) OVER (PARTITION BY profile_id ORDER BY level_idx) AS dz, row_number() OVER (PARTITION BY profile_id ORDER BY level_idx) AS n FROM lim)
        SELECT profile_id, count(*) >= 60 AND min(altitude) <= 500 AND max(altitude) >= 3000 AND bool_and(n = 1 OR coalesce(dz > 0, false)) AND avg(CAST(t IS NULL AS INT)) <= 0.1e0 AS usable FROM s GROUP BY 1""",
    "resample_linear": f"WITH {E}, {G} SELECT profile_id, g_idx, {', '.join(r(c, c, 5) for c in ('t', 'td', 'p_niv', 'u', 'v', 'ff', 'dd'))} FROM g",
    "point_interpolation": f"""WITH {E}, h(z) AS (VALUES (500e0), (3000e0)), x AS (
            SELECT profile_id, z, {', '.join(f"max(altitude) FILTER ({v} IS NOT NULL AND altitude <= z) AS a_{v}, arg_max({v}, altitude) FILTER ({v} IS NOT NULL AND altitude <= z) AS ya_{v}, min(altitude) FILTER ({v} IS NOT NULL AND altitude >= z) AS b_{v}, arg_min({v}, altitude) FILTER ({v} IS NOT NULL AND altitude >= z) AS yb_{v}" for v in ('t', 'p_niv'))}
            FROM e, h GROUP BY 1, 2),
        y AS (SELECT profile_id, z, {', '.join(f"CASE WHEN a_{v} = b_{v} THEN ya_{v} ELSE ya_{v} + (yb_{v} - ya_{v}) * (z - a_{v}) / nullif(b_{v} - a_{v}, 0e0) END AS {v}" for v in ('t', 'p_niv'))} FROM x)
        SELECT profile_id, {', '.join(r(f"max({v}) FILTER (z = {z})", f"{v}_{z}", 5) for v in ('t', 'p_niv') for z in (500, 3000))} FROM y GROUP BY 1""",
    "gradients": f"""WITH {E}, {_GRAD}, m AS (
            SELECT *, (coalesce(y0, t) + t + coalesce(y2, t)) / 3 AS s3,
                   CASE WHEN rn = 1 THEN (y2 - t) / nullif(z2 - altitude, 0e0) WHEN rn = n THEN (t - y0) / nullif(altitude - z0, 0e0)
                        ELSE ((altitude - z0) * (altitude - z0) * y2 + ((z2 - altitude) * (z2 - altitude) - (altitude - z0) * (altitude - z0)) * t - (z2 - altitude) * (z2 - altitude) * y0)
                             / nullif((altitude - z0) * (z2 - altitude) * ((altitude - z0) + (z2 - altitude)), 0e0) END AS g,
                   (CASE WHEN rn = n THEN t ELSE y2 END - CASE WHEN rn = 1 THEN t ELSE y0 END) / nullif(CASE WHEN rn = n THEN altitude ELSE z2 END - CASE WHEN rn = 1 THEN altitude ELSE z0 END, 0e0) AS ratio,
                   sum(t) OVER ({_ORDER} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS smooth FROM n0),
        k AS (SELECT *, lag(s3) OVER w AS a1, lag(s3, 2) OVER w AS a2, lead(s3) OVER w AS b1, lead(s3, 2) OVER w AS b2 FROM m WINDOW w AS ({_ORDER}))
        SELECT profile_id, level_idx, {r('g', 'g')}, {r('ratio', 'ratio')}, {r('smooth', 'smooth')}, {r('s3', 's3')},
               coalesce(s3 > a1 AND s3 > coalesce(a2, a1) AND s3 > b1 AND s3 > coalesce(b2, b1), false) AS peak FROM k""",
    "lapse_layers": f"WITH {E} SELECT profile_id, CAST(floor(altitude / 1000) AS BIGINT) AS layer, {r('CASE WHEN count(*) >= 3 THEN regr_slope(t, altitude) END', 'slope')} FROM e GROUP BY 1, 2",
    "column_integral": f"""WITH {E}, a AS (SELECT profile_id, (t + lead(t) OVER w) / 2 * (lead(p_niv) OVER w - p_niv) AS a FROM e WHERE p_niv IS NOT NULL WINDOW w AS ({_ORDER}))
        SELECT profile_id, {r('abs(sum(a))', 'integral', 3)} FROM a GROUP BY 1""",
    "highest_value": f"""WITH {E} SELECT profile_id, {r('ff', 'jet')}, {r('altitude', 'height')} FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY ff DESC, altitude) AS n FROM e) WHERE n = 1""",
    "wind_components": f"WITH {E}, c AS (SELECT profile_id, level_idx, -1 * ff * sin(radians(dd)) AS u, -1 * ff * cos(radians(dd)) AS v FROM e) SELECT profile_id, level_idx, {r('u', 'u')}, {r('v', 'v')}, {r('sqrt(u * u + v * v)', 'speed')} FROM c",
    "thermodynamics": f"""WITH {E}, {_LIMITED}, c AS (SELECT *, t - 273.15e0 AS tc, td - 273.15e0 AS tdc, CASE WHEN td >= 213.15e0 THEN td - 273.15e0 END AS tdv FROM dew),
        x AS (SELECT *, 6.112e0 * exp(17.67e0 * tc / (tc + 243.5e0)) AS es, 6.112e0 * exp(17.67e0 * tdc / (tdc + 243.5e0)) AS ed, 6.112e0 * exp(17.67e0 * tdv / (tdv + 243.5e0)) AS edv FROM c)
        SELECT profile_id, level_idx, {r('es', 'es', 4)}, {r('CASE WHEN edv / es IS NOT NULL THEN least(greatest(100 * edv / es, 0e0), 105e0) END', 'rh', 4)},
               {r('100 * exp(17.625e0 * tdc / (243.04e0 + tdc)) / exp(17.625e0 * tc / (243.04e0 + tc))', 'rh_plain', 4)}, {r('0.622e0 * ed / nullif(p_niv / 100 - 0.378e0 * ed, 0e0)', 'q', 4)},
               {r('t * pow(100000e0 / nullif(p_niv, 0e0), 0.286e0)', 'theta', 4)}, {r('p_niv / 100', 'p_hpa', 4)}, {r('ff * 1.943844e0', 'ff_kt', 4)}, {r('dd - 90e0 - 360 * floor((dd - 90e0) / 360) + 90e0', 'dd_axis', 4)} FROM x""",
    "dry_adiabat": f"""WITH {E}, a AS (SELECT *, first_value(t) OVER ({_ORDER}) AS t0, first_value(altitude) OVER ({_ORDER}) AS z0 FROM e)
        SELECT profile_id, level_idx, {r('altitude - z0', 'zr', 4)}, {r('t - (t0 - 0.0098e0 * (altitude - z0))', 't_anomaly', 4)}, {r('td - (t0 - 0.0098e0 * (altitude - z0))', 'td_anomaly', 4)} FROM a""",
    "basic_features": f"""WITH {E}, x AS (SELECT *, 100 * exp(17.625e0 * (td - 273.15e0) / (243.04e0 + (td - 273.15e0))) / exp(17.625e0 * (t - 273.15e0) / (243.04e0 + (t - 273.15e0))) AS rh, row_number() OVER ({_ORDER}) AS rn, count(*) OVER (PARTITION BY profile_id) AS n FROM e),
        y AS (SELECT *, (CASE WHEN rn = n THEN t ELSE lead(t) OVER w END - CASE WHEN rn = 1 THEN t ELSE lag(t) OVER w END) / nullif(CASE WHEN rn = n THEN altitude ELSE lead(altitude) OVER w END - CASE WHEN rn = 1 THEN altitude ELSE lag(altitude) OVER w END, 0e0) AS g,
                     (CASE WHEN rn = n THEN rh ELSE lead(rh) OVER w END - CASE WHEN rn = 1 THEN rh ELSE lag(rh) OVER w END) / nullif(CASE WHEN rn = n THEN altitude ELSE lead(altitude) OVER w END - CASE WHEN rn = 1 THEN altitude ELSE lag(altitude) OVER w END, 0e0) AS gr FROM x WINDOW w AS ({_ORDER}))
        SELECT profile_id, {r('avg(g) FILTER (altitude <= 3000)', 'lapse_rate_0_3km', 4)}, {r('max(g)', 'inversion_strength', 4)}, {r('arg_min(altitude, {v: -g, z: altitude}) FILTER (g IS NOT NULL)', 'inversion_height', 4)},
               {r('avg(t - 273.15e0) FILTER (altitude <= 1000)', 'T_mean_0_1km', 4)}, {r('avg(rh)', 'RH_mean', 4)}, {r('avg(gr)', 'RH_gradient', 4)}, {r('avg(CAST(coalesce(rh > 90, false) AS INT))', 'saturation_fraction', 4)},
               {r('var_pop(t)', 'T_variance', 4)}, {r('max(abs(g))', 'max_gradient', 4)} FROM y GROUP BY 1""",
    "wind_features": f"""WITH {E} SELECT profile_id, {r('avg(ff)', 'ws_mean', 10)}, {', '.join(r(f"CASE WHEN count(*) FILTER (altitude <= {z}) > 2 THEN arg_max(ff, altitude) FILTER (altitude <= {z}) - arg_min(ff, altitude) FILTER (altitude <= {z}) END", f"shear_0_{z // 1000}km", 10) for z in (1000, 3000))} FROM e GROUP BY 1""",
    "stitch_chains": """WITH RECURSIVE f AS (
            SELECT o_custkey AS station, o_orderkey AS seq, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, CAST((o_orderkey * 37) % 1500 AS DOUBLE) AS bottom,
                   CAST((o_orderkey * 37) % 1500 AS DOUBLE) + CAST((o_orderkey * 101) % 900 AS DOUBLE) AS top, CASE WHEN o_orderkey % 5 <> 0 THEN date_trunc('year', o_orderdate) END AS h FROM orders),
        walk AS (
            SELECT station, seq, n, seq AS chain, top, h FROM f WHERE n = 1
            UNION ALL
            SELECT f.station, f.seq, f.n, CASE WHEN j THEN w.chain ELSE f.seq END, CASE WHEN j THEN greatest(w.top, f.top) ELSE f.top END, CASE WHEN j THEN w.h ELSE f.h END
            FROM (SELECT w.*, w.station AS s2, w.n + 1 AS next FROM walk w) w JOIN f ON f.station = w.s2 AND f.n = w.next,
                 LATERAL (SELECT abs(f.bottom - w.top) <= 500 AND f.bottom > 50 AND (w.h IS NULL OR f.h IS NULL OR w.h = f.h) AS j) x)
        SELECT station, seq AS profile_seq, chain FROM walk""",
    "record_segments": """SELECT * FROM (SELECT conv_id, turn, role, CAST(sum(CAST(role = 'user' AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS record FROM conversations) WHERE record > 0""",
    "text_records": f"WITH {E} SELECT profile_id, level_idx, p_niv, altitude, t, td, dd, ff FROM e",
    "every_nth_level": f"WITH {E} SELECT profile_id, level_idx FROM (SELECT *, row_number() OVER ({_ORDER}) - 1 AS n FROM e) WHERE n % 10 = 0",
}
