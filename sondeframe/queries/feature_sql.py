"""DuckDB SQL of the feature tables, put together from their parts."""

from __future__ import annotations

from sondeframe.queries.common import E, r

_ORDER = "ORDER BY altitude NULLS LAST, level_idx"


def _part(*more: str) -> str:
    return f"(PARTITION BY {', '.join(('profile_id', *more))} {_ORDER})"


def _gradient(y: str, window: str) -> str:
    """The uneven gradient; one-sided at the ends of its window."""
    rn, n = f"row_number() OVER {window}", f"count(*) OVER {window.replace(_ORDER, '')}"
    y0, y2 = f"lag({y}) OVER {window}", f"lead({y}) OVER {window}"
    down, up = f"(altitude - lag(altitude) OVER {window})", f"(lead(altitude) OVER {window} - altitude)"
    return f"""CASE WHEN {n} < 2 THEN NULL WHEN {rn} = 1 THEN ({y2} - {y}) / nullif({up}, 0e0) WHEN {rn} = {n} THEN ({y} - {y0}) / nullif({down}, 0e0)
        ELSE ({down} * {down} * {y2} + ({up} * {up} - {down} * {down}) * {y} - {up} * {up} * {y0}) / nullif({down} * {up} * ({down} + {up}), 0e0) END"""


def _pressure(t: str) -> str:
    return f"(6.112e0 * exp(17.67e0 * ({t} - 273.15e0) / (({t} - 273.15e0) + 243.5e0)))"


#: The limits of quality control that bite on the event profiles.
_STAGE = f"""{E}, lim AS (
        SELECT profile_id, level_idx, altitude, CASE WHEN p_niv BETWEEN 500 AND 110000 THEN p_niv END AS p_niv, CASE WHEN t BETWEEN 150 AND 350 THEN t END AS t,
               CASE WHEN td BETWEEN 150 AND 350 THEN td END AS td, dd, CASE WHEN ff BETWEEN 0 AND 200 THEN ff END AS ff FROM e),
    s1 AS (
        SELECT *, altitude - first_value(altitude) OVER w AS zr, first_value(ff) OVER w AS ws0, coalesce(first_value(p_niv) OVER w, 100000e0) AS p0,
               -1 * ff * sin(radians(dd)) AS u, -1 * ff * cos(radians(dd)) AS v, CASE WHEN td >= 213.15e0 THEN td END AS tdv, {_gradient('t', _part())} AS g
        FROM lim WINDOW w AS {_part()}),
    s2 AS (
        SELECT *, zr <= 500 AS low, zr <= 2000 AS two, zr <= 1000 AND t IS NOT NULL AS inn, t * pow(100000e0 / coalesce(p_niv, p0), 0.286e0) AS theta,
               CASE WHEN 100 * {_pressure('tdv')} / {_pressure('t')} IS NOT NULL THEN least(greatest(100 * {_pressure('tdv')} / {_pressure('t')}, 0e0), 105e0) END AS rh,
               0.622e0 * {_pressure('tdv')} / nullif(p_niv / 100 - 0.378e0 * {_pressure('tdv')}, 0e0) AS q, -1 * p_niv / 9.81e0 AS mass,
               CASE WHEN count(*) OVER k = count(g) OVER k THEN sum(g) OVER k / 5 END AS gs
        FROM s1 WINDOW k AS (PARTITION BY profile_id {_ORDER} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
    s3 AS (
        SELECT *, {_gradient('theta', _part('low'))} AS theta_g, {_gradient('t', _part('low'))} AS lg, {_gradient('t', _part('two'))} AS lg2, q IS NOT NULL AND mass IS NOT NULL AS has_q,
               (coalesce(lag(t) OVER i, t) + t + coalesce(lead(t) OVER i, t)) / 3 AS ts
        FROM s2 WINDOW i AS {_part('inn')}),
    s AS (
        SELECT *, CASE WHEN has_q THEN (q + lead(q) OVER h) / 2 * (lead(mass) OVER h - mass) END AS iwv,
               inn AND coalesce(ts > lag(ts) OVER i AND ts > coalesce(lag(ts, 2) OVER i, lag(ts) OVER i) AND ts > lead(ts) OVER i AND ts > coalesce(lead(ts, 2) OVER i, lead(ts) OVER i), false) AS peak
        FROM s3 WINDOW h AS {_part('has_q')}, i AS {_part('inn')})"""


def _mean(x: str, inside: str) -> str:
    return f"CASE WHEN count({x}) FILTER ({inside}) >= 3 THEN avg({x}) FILTER ({inside}) END"


def _slope(inside: str) -> str:
    return f"CASE WHEN count(t) FILTER ({inside}) >= 3 THEN regr_slope(t, zr) FILTER ({inside}) END"


def _at(y: str, z: int) -> str:
    low, high = f"FILTER ({y} IS NOT NULL AND zr <= {z})", f"FILTER ({y} IS NOT NULL AND zr >= {z})"
    z0, y0, z1, y1 = f"max(zr) {low}", f"arg_max({y}, zr) {low}", f"min(zr) {high}", f"arg_min({y}, zr) {high}"
    return f"(CASE WHEN count({y}) < 2 THEN NULL WHEN {z0} = {z1} THEN {y0} ELSE {y0} + ({y1} - {y0}) * ({z} - {z0}) / nullif({z1} - {z0}, 0e0) END)"


def _first_argmax(value: str, place: str, inside: str = "true") -> str:
    return f"arg_min({place}, {{v: -1 * {value}, z: {place}}}) FILTER ({value} IS NOT NULL AND {inside})"


_JET = "count(ff) FILTER (zr <= 1000) >= 3"
_MIDDLE = "zr > 1000 AND zr <= 3000"
_SHARED = {
    "T_std_0_1km": "CASE WHEN count(t) FILTER (zr <= 1000) >= 3 THEN stddev_pop(t) FILTER (zr <= 1000) END",
    "N2_surface": "CASE WHEN count(*) FILTER (zr <= 500) >= 5 THEN 9.81e0 / avg(theta) FILTER (zr <= 500) * avg(theta_g) FILTER (zr <= 500) END",
    "max_grad_0_500": "max(gs) FILTER (zr <= 500)",
    "jet_nose_speed": f"CASE WHEN {_JET} THEN max(ff) FILTER (zr <= 1000) END", "jet_nose_height": f"CASE WHEN {_JET} THEN {_first_argmax('ff', 'zr', 'zr <= 1000')} END",
    "jet_shear_below": f"CASE WHEN {_JET} THEN max(ff) FILTER (zr <= 1000) - any_value(ws0) END", "jet_shear_above": f"CASE WHEN {_JET} THEN {_at('ff', 1000)} - max(ff) FILTER (zr <= 1000) END",
    "shear_0_500": f"{_at('ff', 500)} - any_value(ws0)", "u_sfc": _mean("u", "zr <= 200"), "v_sfc": _mean("v", "zr <= 200"),
    **{f"{c}_{k}km": _at(c, 1000 * k) for k in (1, 3) for c in ("u", "v")},
    "dd_0_500": _mean("(t - tdv)", "zr <= 500"), "dd_1_3km": _mean("(t - tdv)", _MIDDLE), "IWV": "CASE WHEN count(*) FILTER (has_q) >= 5 THEN abs(sum(iwv)) END",
}


def _turning() -> str:
    direction = lambda u, v: f"(degrees(atan2(-1 * {u}, -1 * {v})) - 360 * floor(degrees(atan2(-1 * {u}, -1 * {v})) / 360))"
    turn = f"radians({direction('u_3km', 'v_3km')} - {direction('u_sfc', 'v_sfc')})"
    return r(f"degrees(atan2(sin({turn}), cos({turn})))", "wind_turning_0_3km")


def _select(columns: dict[str, str], gate: str, keep_short: bool) -> str:
    inner = ", ".join(f"{x} AS {n}" for n, x in columns.items())
    names = [r(n, n) for n in columns] + [_turning()]
    if keep_short:
        names = [f"CASE WHEN {gate} THEN {x.rpartition(' AS ')[0]} END AS {x.rpartition(' AS ')[2]}" for x in names]
    return f"""WITH {_STAGE}, a AS (SELECT profile_id, count(*) AS n_levels, count(t) AS n_t, {inner} FROM s GROUP BY 1)
        SELECT profile_id, {', '.join(names)} FROM a {'' if keep_short else f'WHERE {gate}'}"""


_SFC = "(median(t) FILTER (zr <= 200))"
_PEAK = "(arg_min(ts, zr) FILTER (peak))"
_RH = "count(rh) >= 3"
DIAGNOSTICS = _select({
    "T_sfc_C": f"{_SFC} - 273.15e0", **{f"T_mean_{k}_C": f"({_mean('t', c)}) - 273.15e0" for k, c in (("0_500", "zr <= 500"), ("0_1km", "zr <= 1000"), ("1_3km", _MIDDLE))},
    "T_range_0_1km": "CASE WHEN count(*) FILTER (zr <= 1000) >= 3 THEN max(t) FILTER (zr <= 1000) - min(t) FILTER (zr <= 1000) END",
    "theta_sfc": f"{_SFC} * pow(100000e0 / any_value(p0), 0.286e0)",
    "inversion_strength": f"coalesce(CASE WHEN {_PEAK} - {_SFC} > 0 THEN {_PEAK} - {_SFC} END, 0e0)", "inversion_height": f"CASE WHEN {_PEAK} - {_SFC} > 0 THEN min(zr) FILTER (peak) END",
    **{f"lapse_{k}": _slope(c) for k, c in (("0_500", "zr <= 500"), ("0_2km", "zr <= 2000"), ("1_3km", _MIDDLE), ("3_6km", "zr > 3000 AND zr <= 6000"))},
    **{f"lapse_z{k}_{k + 200}": _slope(f"zr >= {k} AND zr < {k + 200}") for k in range(0, 2000, 200)},
    "ws_sfc": "any_value(ws0)", "ws_500": _at("ff", 500), "ws_1km": _at("ff", 1000), "ws_3km": _at("ff", 3000), "ws_mean_0_1km": _mean("ff", "zr <= 1000"), "ws_mean_1_3km": _mean("ff", _MIDDLE),
    **_SHARED, "RH_mean_0_1km": _mean("rh", "zr <= 1000"), "RH_mean_1_3km": _mean("rh", _MIDDLE),
    "RH_max": f"CASE WHEN {_RH} THEN max(rh) END", "z_RH_max": f"CASE WHEN {_RH} THEN {_first_argmax('rh', 'zr')} END",
}, "n_levels >= 5", True)

_SFC_X = "(median(t) FILTER (zr < 200))"
_JOINT = "count(t) FILTER (tdv IS NOT NULL) >= 5 AND count(rh) >= 3"
FULL = _select({
    "lapse_0_500": "CASE WHEN count(*) FILTER (zr <= 500) >= 5 THEN avg(lg) FILTER (zr <= 500) END", "lapse_0_2km": "CASE WHEN count(*) FILTER (two) >= 5 THEN avg(lg2) FILTER (two) END",
    "inversion_strength": f"max(t) - {_SFC_X}", "inversion_height": _first_argmax("t", "altitude"), "theta_sfc": f"{_SFC_X} * pow(100000e0 / any_value(p0), 0.286e0)", **_SHARED,
    "RH_max": f"CASE WHEN {_JOINT} THEN max(rh) END", "z_RH_max": f"CASE WHEN {_JOINT} THEN {_first_argmax('rh', 'zr')} END",
}, "n_levels >= 10 AND n_t > 0", False)


def _layers() -> str:
    layers = {"0_1km": "altitude >= 0 AND altitude <= 1000", "1_3km": "altitude > 1000 AND altitude <= 3000", "3_6km": "altitude > 3000 AND altitude <= 6000"}
    which = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in layers.items()) + " END"
    columns = [r("avg(g)", "lapse_mean"), r("avg(t)", "T_mean", 9), r("var_pop(t)", "T_var"), r("avg(t - td)", "dd_mean")]
    for n in layers:
        own = f"FILTER (layer = '{n}')"
        columns += [r(f"CASE WHEN count(*) {own} >= 5 THEN {x} {own} END", f"{p}_{n}", 9 if p == "T_mean" else 6) for p, x in (("lapse", "avg(lg)"), ("T_mean", "avg(t)"), ("T_var", "var_pop(t)"))]
    return f"""WITH {E}, l AS (SELECT *, {which} AS layer FROM e), m AS (SELECT *, {_gradient('t', _part())} AS g, {_gradient('t', _part('layer'))} AS lg FROM l)
        SELECT profile_id, {', '.join(columns)} FROM m GROUP BY 1"""


LAYERS = _layers()
