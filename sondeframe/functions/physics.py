"""Thermodynamics and wind as native column expressions.

Units: K, Pa, m, m/s, degrees.  Null in, null out.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

ZERO_C = 273.15
GRAVITY = 9.81
DRY_LAPSE = 0.0098
REFERENCE_PRESSURE = 100_000.0
KAPPA = 0.286
LEAST_DEW_POINT = 213.15
KNOTS = 1.943844


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def components(ff: Column | str, dd: Column | str, sign: int = 1) -> tuple[Column, Column]:
    """(u, v) of speed and direction; sign -1: where the wind blows to, as meteorology has it."""
    angle = F.radians(_c(dd))
    return sign * _c(ff) * F.sin(angle), sign * _c(ff) * F.cos(angle)


def speed(u: Column | str, v: Column | str) -> Column:
    return F.sqrt(_c(u) * _c(u) + _c(v) * _c(v))


def wrap_360(degrees: Column) -> Column:
    return degrees - 360 * F.floor(degrees / 360)


def direction(u: Column | str, v: Column | str, sign: int = 1) -> Column:
    """The angle whose ``components`` with this sign are (u, v), in [0, 360).

    Of a calm wind the zeros' signs tell, as in C: 180 where v is a negative zero, else 0.  Spark's atan2 drops those signs.
    """
    x, y = sign * _c(u), sign * _c(v)
    behind = (x == 0) & (y == 0) & y.cast("string").startswith("-")
    return F.when(behind, 180.0).otherwise(wrap_360(F.degrees(F.atan2(x, y))))


def turning(first: Column, last: Column) -> Column:
    """From one direction to another, in degrees, the short way round."""
    d = F.radians(last - first)
    return F.degrees(F.atan2(F.sin(d), F.cos(d)))


def recentred(dd: Column | str, low: Column | float) -> Column:
    """A direction on an axis that begins at ``low``."""
    low = F.lit(low) if not isinstance(low, Column) else low
    return wrap_360(_c(dd) - low) + low


def celsius(t: Column | str) -> Column:
    return _c(t) - ZERO_C


LARGEST_EXP = 709.78


@F.pandas_udf(DoubleType())
def c_exp(x: pd.Series) -> pd.Series:
    """exp by the C library, as DuckDB has it: in Spark's own the last bit differs for some arguments."""
    return pd.Series([math.inf if v > LARGEST_EXP else math.exp(v) for v in x], dtype=float)


def saturation_pressure(t: Column | str, exp: Callable[[Column], Column] = F.exp) -> Column:
    """Over water, in hPa (Magnus form 17.67, 243.5)."""
    c = celsius(t)
    return 6.112 * exp(17.67 * c / (c + 243.5))


def ice_saturation_pressure(t: Column | str) -> Column:
    """Over ice, in hPa (Magnus form 22.46, 272.62)."""
    c = celsius(t)
    return 6.112 * F.exp(22.46 * c / (c + 272.62))


def usable_dew_point(td: Column | str) -> Column:
    """Null below the dew point that sensors resolve."""
    return F.when(_c(td) >= LEAST_DEW_POINT, _c(td))


def relative_humidity(t: Column | str, td: Column | str) -> Column:
    """In percent, cut to 0 and 105.

    Saturated levels are equal but for the last bit, which tells where the humidity is largest.
    """
    rh = 100 * saturation_pressure(usable_dew_point(td), c_exp) / saturation_pressure(t, c_exp)
    return F.when(rh.isNotNull(), F.least(F.greatest(rh, F.lit(0.0)), F.lit(105.0)))


def relative_humidity_plain(t: Column | str, td: Column | str) -> Column:
    """In percent, uncut (Magnus form 17.625, 243.04)."""
    a, b = celsius(td), celsius(t)
    return 100 * F.exp(17.625 * a / (243.04 + a)) / F.exp(17.625 * b / (243.04 + b))


def relative_humidity_ice(t: Column | str, td: Column | str) -> Column:
    return 100 * saturation_pressure(td) / ice_saturation_pressure(t)


def specific_humidity(td: Column | str, p: Column | str) -> Column:
    e = saturation_pressure(td)
    return F.try_divide(0.622 * e, _c(p) / 100 - 0.378 * e)


def potential_temperature(t: Column | str, p: Column | str) -> Column:
    return _c(t) * F.pow(F.try_divide(F.lit(REFERENCE_PRESSURE), _c(p)), F.lit(KAPPA))


def condensation_temperature(t: Column | str, td: Column | str) -> Column:
    """Of the lifted parcel (Bolton's closed form)."""
    a, b = _c(t), _c(td)
    return 1 / (1 / (b - 56) + F.log(a / b) / 800) + 56


def condensation_pressure(t: Column | str, td: Column | str, p: Column | str) -> Column:
    return _c(p) * F.pow(condensation_temperature(t, td) / _c(t), F.lit(1 / KAPPA))


def by_height(profile: str = "profile_id"):
    return Window.partitionBy(profile).orderBy(F.col("altitude").asc_nulls_last(), "level_idx")


def above_surface(z: str = "altitude", profile: str = "profile_id") -> Column:
    """Height over the profile's lowest level."""
    return F.col(z) - F.first(z).over(by_height(profile))


def dry_adiabat(profile: str = "profile_id") -> Column:
    """Temperature of a dry parcel lifted from the lowest level."""
    w = by_height(profile)
    return F.first("t").over(w) - DRY_LAPSE * (F.col("altitude") - F.first("altitude").over(w))


def knots(x: Column | str) -> Column:
    return _c(x) * KNOTS


def hectopascal(p: Column | str) -> Column:
    return _c(p) / 100


def per_100_m(gradient: Column | str) -> Column:
    return _c(gradient) * 100


def stars(p: Column | str) -> Column:
    """Marks of significance."""
    return F.when(_c(p) < 0.001, "***").when(_c(p) < 0.01, "**").when(_c(p) < 0.05, "*").otherwise("")
