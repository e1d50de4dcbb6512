"""Feature tables: one row a profile, by window stages and one conditional aggregate.

All stages partition by the profile, so that a table costs one exchange.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondeframe.functions import physics as P
from sondeframe.functions.parcel import Parcel
from sondeframe.functions.levels import first_argmax, gradient, gradient_ratio, interpolated, local_maximum, slope, smooth3, smooth5, trapezoid_term

UNITS = {"T": "K", "lapse": "K/m", "ws": "m/s", "RH": "%", "IWV": "kg/m2", "z": "m"}


def _w(*more: str):
    return Window.partitionBy("profile_id", *more).orderBy(F.col("altitude").asc_nulls_last(), "level_idx")


def _ordered(levels: DataFrame) -> DataFrame:
    """With level_idx, from the grid's index where levels are on a grid."""
    if "level_idx" in levels.columns:
        return levels
    return levels.withColumn("level_idx", F.col("g_idx").cast("long"))


def temperature_features(levels: DataFrame) -> DataFrame:
    """Mean lapse to 3 km, largest gradient and its height, mean temperature to 1 km in degrees C."""
    rows = _ordered(levels).withColumn("_g", gradient_ratio("t", "altitude", _w()))
    return rows.groupBy("profile_id").agg(*_temperature())


def _temperature() -> list[Column]:
    z, g = F.col("altitude"), F.col("_g")
    return [
        F.avg(F.when(z <= 3000, g)).alias("lapse_rate_0_3km"), F.max(g).alias("inversion_strength"), first_argmax(g, z).alias("inversion_height"),
        F.avg(F.when(z <= 1000, P.celsius("t"))).alias("T_mean_0_1km"),
    ]


def humidity_features(levels: DataFrame) -> DataFrame:
    """Mean relative humidity, its mean gradient, the share of levels above 90 %."""
    return _with_rh(levels).groupBy("profile_id").agg(*_humidity())


def _with_rh(levels: DataFrame) -> DataFrame:
    return _ordered(levels).withColumn("_rh", P.relative_humidity_plain("t", "td")).withColumn("_rh_g", gradient_ratio("_rh", "altitude", _w()))


def _humidity() -> list[Column]:
    return [
        F.avg("_rh").alias("RH_mean"), F.avg("_rh_g").alias("RH_gradient"),
        F.avg(F.coalesce((F.col("_rh") > 90).cast("double"), F.lit(0.0))).alias("saturation_fraction"),
    ]


def wind_features(levels: DataFrame) -> DataFrame:
    """Mean speed, and speed at the top less that at the bottom of the lowest 1 and 3 km (more than 2 levels)."""
    ws, z = F.col("ff"), F.col("altitude")

    def shear(top: float) -> Column:
        own, at = F.when(z <= top, ws), F.when(z <= top, z)
        return F.when(F.count(at) > 2, F.max_by(own, at) - F.min_by(own, at))

    return levels.groupBy("profile_id").agg(F.avg(ws).alias("ws_mean"), shear(1000).alias("shear_0_1km"), shear(3000).alias("shear_0_3km"))


def structure_features(levels: DataFrame) -> DataFrame:
    """Population variance of t, and the largest gradient of either sign."""
    return _ordered(levels).withColumn("_g", gradient_ratio("t", "altitude", _w())).groupBy("profile_id").agg(*_structure())


def _structure() -> list[Column]:
    return [F.var_pop("t").alias("T_variance"), F.max(F.abs("_g")).alias("max_gradient")]


def basic_features(levels: DataFrame) -> DataFrame:
    """Temperature, humidity and structure features in one aggregate: 9 columns."""
    rows = _with_rh(levels).withColumn("_g", gradient_ratio("t", "altitude", _w()))
    return rows.groupBy("profile_id").agg(*_temperature(), *_humidity(), *_structure())


def layer_features(levels: DataFrame) -> DataFrame:
    """13 columns: lapse, mean and variance of t, of all levels and of three layers, and mean t - td.

    A layer's lapse is the mean of gradients taken inside it, with 5 levels at least.
    """
    z = F.col("altitude")
    layers = {"0_1km": (z >= 0) & (z <= 1000), "1_3km": (z > 1000) & (z <= 3000), "3_6km": (z > 3000) & (z <= 6000)}
    which = F.lit(None)
    for name, inside in layers.items():
        which = F.when(inside, name).otherwise(which)
    rows = _ordered(levels).withColumn("_layer", which)
    rows = rows.withColumn("_g", gradient("t", "altitude", _w())).withColumn("_lg", gradient("t", "altitude", _w("_layer")))
    columns = [F.avg("_g").alias("lapse_mean"), F.avg("t").alias("T_mean"), F.var_pop("t").alias("T_var"), F.avg(F.col("t") - F.col("td")).alias("dd_mean")]
    for name in layers:
        own = F.col("_layer") == name
        gate = F.count_if(own) >= 5
        columns += [
            F.when(gate, F.avg(F.when(own, F.col("_lg")))).alias(f"lapse_{name}"), F.when(gate, F.avg(F.when(own, F.col("t")))).alias(f"T_mean_{name}"),
            F.when(gate, F.var_pop(F.when(own, F.col("t")))).alias(f"T_var_{name}"),
        ]
    return rows.groupBy("profile_id").agg(*columns)


def _stage(levels: DataFrame) -> DataFrame:
    """Window columns that both large tables need."""
    u, v = P.components("ff", "dd", -1)
    rows = _ordered(levels).repartition("profile_id").withColumn("zr", F.col("altitude") - F.first("altitude").over(_w()))
    rows = rows.withColumns({
        "_u": u, "_v": v, "ws0": F.first("ff").over(_w()), "p0": F.coalesce(F.first("p_niv").over(_w()), F.lit(P.REFERENCE_PRESSURE)),
        "_g": gradient("t", "altitude", _w()), "_tdv": P.usable_dew_point("td"), "_rh": P.relative_humidity("t", "td"),
    })
    rows = rows.withColumn("_gs", smooth5("_g", _w()))
    rows = rows.withColumn("_low", F.coalesce(F.col("zr") <= 500, F.lit(False))).withColumn(
        "_theta", F.col("t") * F.pow(P.REFERENCE_PRESSURE / F.coalesce("p_niv", F.col("p0")), F.lit(P.KAPPA))
    )
    rows = rows.withColumn("_theta_g", gradient("_theta", "altitude", _w("_low")))
    rows = rows.withColumn("_lg", gradient("t", "altitude", _w("_low")))
    rows = rows.withColumn("_q", P.specific_humidity("_tdv", "p_niv")).withColumn("_mass", -F.col("p_niv") / P.GRAVITY)
    rows = rows.withColumn("_has_q", F.col("_q").isNotNull() & F.col("_mass").isNotNull())
    return rows.withColumn("_iwv", F.when(F.col("_has_q"), trapezoid_term("_q", "_mass", _w("_has_q"))))


def _mean(x: Column, inside: Column, least: int = 3) -> Column:
    return F.when(F.count(F.when(inside, x)) >= least, F.avg(F.when(inside, x)))


def _std(x: Column, inside: Column, least: int = 3) -> Column:
    return F.when(F.count(F.when(inside, x)) >= least, F.stddev_pop(F.when(inside, x)))


def _shared() -> dict[str, Column]:
    """Aggregates that both large tables have with one definition."""
    zr, ws = F.col("zr"), F.col("ff")
    near, km1 = zr <= 200, zr <= 1000
    jet_ok = F.count(F.when(km1, ws)) >= 3
    jet, jet_z = F.max(F.when(km1, ws)), first_argmax(F.when(km1, ws), zr)
    ws0 = F.first("ws0")
    u3, v3 = interpolated("_u", "zr", 3000), interpolated("_v", "zr", 3000)
    us, vs = _mean(F.col("_u"), near), _mean(F.col("_v"), near)
    n2 = P.GRAVITY / F.avg(F.when(zr <= 500, F.col("_theta"))) * F.avg(F.when(zr <= 500, F.col("_theta_g")))
    return {
        "T_std_0_1km": _std(F.col("t"), km1), "N2_surface": F.when(F.count_if(zr <= 500) >= 5, n2), "max_grad_0_500": F.max(F.when(zr <= 500, F.col("_gs"))),
        "jet_nose_speed": F.when(jet_ok, jet), "jet_nose_height": F.when(jet_ok, jet_z), "jet_shear_below": F.when(jet_ok, jet - ws0),
        "jet_shear_above": F.when(jet_ok, interpolated("ff", "zr", 1000) - jet), "shear_0_500": interpolated("ff", "zr", 500) - ws0,
        "u_sfc": us, "v_sfc": vs, "u_1km": interpolated("_u", "zr", 1000), "v_1km": interpolated("_v", "zr", 1000), "u_3km": u3, "v_3km": v3,
        "wind_turning_0_3km": P.turning(P.direction(us, vs, -1), P.direction(u3, v3, -1)),
        "dd_0_500": _mean(F.col("t") - F.col("_tdv"), zr <= 500), "dd_1_3km": _mean(F.col("t") - F.col("_tdv"), (zr > 1000) & (zr <= 3000)),
        "IWV": F.when(F.count_if("_has_q") >= 5, F.abs(F.sum("_iwv"))),
    }


def full_features(levels: DataFrame, min_levels: int = 10) -> DataFrame:
    """25 columns.  Profiles without t or altitude, or with fewer levels, get no row.

    Surface t is the median of the lowest 200 m (200 not included); lapses are
    means of gradients inside the layer; inversion strength is the largest
    excess over surface t anywhere, its height that above sea level.
    """
    zr, t = F.col("zr"), F.col("t")
    two = F.coalesce(zr <= 2000, F.lit(False))
    rows = _stage(levels).withColumn("_two", two).withColumn("_lg2", gradient("t", "altitude", _w("_two")))
    sfc = F.percentile(F.when(zr < 200, t), F.lit(0.5))
    joint = F.count(F.when(F.col("_tdv").isNotNull(), t))
    gate = (joint >= 5) & (F.count("_rh") >= 3)
    both = _shared()
    columns = {
        "lapse_0_500": F.when(F.count_if(zr <= 500) >= 5, F.avg(F.when(zr <= 500, F.col("_lg")))),
        "lapse_0_2km": F.when(F.count_if("_two") >= 5, F.avg(F.when(F.col("_two"), F.col("_lg2")))),
        "inversion_strength": F.max("t") - sfc, "inversion_height": first_argmax(t, F.col("altitude")),
        "theta_sfc": sfc * F.pow(P.REFERENCE_PRESSURE / F.first("p0"), F.lit(P.KAPPA)),
        **both, "RH_max": F.when(gate, F.max("_rh")), "z_RH_max": F.when(gate, first_argmax(F.col("_rh"), zr)),
    }
    facts = rows.groupBy("profile_id").agg(*[c.alias(n) for n, c in columns.items()], F.count("*").alias("_n"), F.count("t").alias("_t"), F.count("altitude").alias("_z"))
    return facts.filter((F.col("_n") >= min_levels) & (F.col("_t") > 0) & (F.col("_z") > 0)).drop("_n", "_t", "_z")


def diagnostics(levels: DataFrame, min_levels: int = 5) -> DataFrame:
    """50 columns; a row of nulls for a profile of fewer levels.

    Surface t is the median of the lowest 200 m (200 included); lapses are
    regression slopes; the inversion is the first smoothed maximum of t in the
    lowest km, 0 and no height where it is not above surface t.
    """
    zr, t, ws = F.col("zr"), F.col("t"), F.col("ff")
    rows = _stage(levels)
    rows = rows.withColumn("_in", F.coalesce((zr <= 1000) & t.isNotNull(), F.lit(False))).withColumn("_out", ~F.col("_in"))
    # the rows inside come first, as in the SQL: means on a half of the last digit go by the order of their sums
    rows = rows.withColumn("_ts", smooth3("t", _w("_out"))).withColumn("_peak", F.col("_in") & local_maximum("_ts", _w("_out")))
    layers = {"0_500": zr <= 500, "0_1km": zr <= 1000, "0_2km": zr <= 2000, "1_3km": (zr > 1000) & (zr <= 3000), "3_6km": (zr > 3000) & (zr <= 6000)}
    sfc = F.percentile(F.when(zr <= 200, t), F.lit(0.5))
    peak = F.min_by(F.when(F.col("_peak"), F.col("_ts")), F.when(F.col("_peak"), zr))
    peak_z = F.min(F.when(F.col("_peak"), zr))
    n1 = F.count_if(layers["0_1km"]) >= 3
    both = _shared()
    rh_ok = F.count("_rh") >= 3
    columns = {
        "T_sfc_C": sfc - P.ZERO_C, **{f"T_mean_{k}_C": _mean(t, layers[k]) - P.ZERO_C for k in ("0_500", "0_1km", "1_3km")},
        "T_std_0_1km": both.pop("T_std_0_1km"), "T_range_0_1km": F.when(n1, F.max(F.when(layers["0_1km"], t)) - F.min(F.when(layers["0_1km"], t))),
        "theta_sfc": sfc * F.pow(P.REFERENCE_PRESSURE / F.first("p0"), F.lit(P.KAPPA)), "N2_surface": both.pop("N2_surface"),
        "inversion_strength": F.coalesce(F.when(peak - sfc > 0, peak - sfc), F.lit(0.0)), "inversion_height": F.when(peak - sfc > 0, peak_z),
        "max_grad_0_500": both.pop("max_grad_0_500"),
        **{f"lapse_{k}": slope(F.when(layers[k], t), F.when(layers[k], zr)) for k in ("0_500", "0_2km", "1_3km", "3_6km")},
        **{f"lapse_z{k}_{k + 200}": slope(F.when((zr >= k) & (zr < k + 200), t), F.when((zr >= k) & (zr < k + 200), zr)) for k in range(0, 2000, 200)},
        "ws_sfc": F.first("ws0"), "ws_500": interpolated("ff", "zr", 500), "ws_1km": interpolated("ff", "zr", 1000), "ws_3km": interpolated("ff", "zr", 3000),
        "ws_mean_0_1km": _mean(ws, layers["0_1km"]), "ws_mean_1_3km": _mean(ws, layers["1_3km"]),
        **both,
        "RH_mean_0_1km": _mean(F.col("_rh"), layers["0_1km"]), "RH_mean_1_3km": _mean(F.col("_rh"), layers["1_3km"]),
        "RH_max": F.when(rh_ok, F.max("_rh")), "z_RH_max": F.when(rh_ok, first_argmax(F.col("_rh"), zr)),
    }
    facts = rows.groupBy("profile_id").agg(*[c.alias(n) for n, c in columns.items()], F.count("*").alias("_n"))
    return facts.select("profile_id", *[F.when(F.col("_n") >= min_levels, F.col(c)).alias(c) for c in columns])


def parcel_profile(levels: DataFrame) -> DataFrame:
    """(profile_id, level_idx, parcel_t), and CAPE and CIN in ``parcel_energy``.

    The parcel of the lowest level rises dry to its condensation level, then by
    the moist adiabat, which has no closed form: a group function integrates it
    over the profile's levels (one profile at a time, bounded by its levels).
    """
    schema = "profile_id string, level_idx long, parcel_t double"

    def lift(own):
        own = own.dropna(subset=["p_niv", "t"]).sort_values(["p_niv", "level_idx"], ascending=[False, True])
        if own.empty or math.isnan(own["td"].iloc[0]):
            return own.assign(parcel_t=math.nan)[["profile_id", "level_idx", "parcel_t"]]
        parcel = Parcel(own["t"].iloc[0], own["td"].iloc[0], own["p_niv"].iloc[0], P.KAPPA)
        return own.assign(parcel_t=[parcel.at(p) for p in own["p_niv"]])[["profile_id", "level_idx", "parcel_t"]]

    return levels.select(F.col("profile_id").cast("string").alias("profile_id"), F.col("level_idx").cast("long").alias("level_idx"), "p_niv", "t", "td").groupBy("profile_id").applyInPandas(lift, schema)


def parcel_energy(levels: DataFrame, parcel: DataFrame) -> DataFrame:
    """(profile_id, cape, cin) in J/kg: the parcel's excess integrated over log pressure."""
    w = Window.partitionBy("profile_id").orderBy(F.col("p_niv").desc_nulls_last(), "level_idx")
    own = levels.withColumn("profile_id", F.col("profile_id").cast("string")).join(parcel, ["profile_id", "level_idx"]).filter("p_niv is not null and t is not null")
    own = own.withColumn("_d", F.nanvl(F.col("parcel_t") - F.col("t"), F.lit(None))).withColumn("_x", -F.log("p_niv"))
    own = own.withColumn("_e", 287.05 * trapezoid_term("_d", "_x", w))
    return own.groupBy("profile_id").agg(F.sum(F.when(F.col("_e") > 0, F.col("_e")).otherwise(0.0)).alias("cape"), F.sum(F.when(F.col("_e") < 0, F.col("_e")).otherwise(0.0)).alias("cin"))
