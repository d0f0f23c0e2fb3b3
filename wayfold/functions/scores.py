"""Scores, costs and lookups as SQL expressions. Two generations share names with different definitions: ``seg_`` is the
road segment planner, ``cell_`` the grid cell planner, ``road_`` the cell planner drawn on roads."""

from __future__ import annotations

from .geo import clamp, haversine, pmod

# Classes of roads.
SEG_SPEED = {"motorway": 120.0, "motorway_link": 80.0, "trunk": 95.0, "trunk_link": 70.0, "primary": 80.0, "primary_link": 60.0, "secondary": 70.0, "secondary_link": 55.0, "tertiary": 60.0, "tertiary_link": 50.0, "unclassified": 50.0}
ROAD_SPEED = {"motorway": 120.0, "motorway_link": 70.0, "trunk": 100.0, "trunk_link": 60.0, "primary": 80.0, "primary_link": 50.0, "secondary": 70.0, "secondary_link": 45.0, "tertiary": 60.0, "tertiary_link": 40.0, "unclassified": 45.0}
CLASS_SCENIC = {"motorway": 0.02, "motorway_link": 0.05, "trunk": 0.25, "trunk_link": 0.25, "primary": 0.50, "primary_link": 0.45, "secondary": 0.75, "secondary_link": 0.65, "tertiary": 0.90, "tertiary_link": 0.80, "unclassified": 0.85}
HIGHWAY_AVOIDANCE = {"motorway": 5.0, "motorway_link": 4.0, "trunk": 3.0, "trunk_link": 2.5, "primary": 1.0, "primary_link": 0.8}
OUTER_HIGHWAY = {"motorway": 6.0, "motorway_link": 5.0, "trunk": 4.0, "trunk_link": 3.0, "primary": 1.45, "primary_link": 1.25}
TRAFFIC_PRIOR = {"motorway": 0.55, "motorway_link": 0.45, "trunk": 0.45, "trunk_link": 0.35, "primary": 0.32, "primary_link": 0.25, "secondary": 0.18, "secondary_link": 0.14, "tertiary": 0.10, "tertiary_link": 0.08, "unclassified": 0.05}
HIGHWAYS = "('motorway', 'motorway_link', 'trunk', 'trunk_link')"
# The city's centre, and rings and runs around it in km.
CITY = (48.137154, 11.576124)
RING_FROM, RING_TO = 20.0, 25.0
RUN_FROM, RUN_TO = 0.7, 3.0
CONFIDENCE_SEG, CONFIDENCE_CELL = 5.0, 3.0
LEAN_MARGIN = 8.0
BIKE_MARGIN = {"sport": 1.25, "roadster": 1.15, "tourer / adventure": 1.05}


def lookup(column: str, table: dict, default: float) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {default} END"


def nz(x: str) -> str:
    """Null is zero."""
    return f"coalesce({x}, 0.0)"


def confidence(n: str, k: float) -> str:
    return f"({nz(n)} / ({nz(n)} + {k}))"


def squash(z: str) -> str:
    return f"(1.0 / (1.0 + exp(-({z}))))"


def city_km(lat: str, lon: str) -> str:
    return f"({haversine(str(CITY[0]), str(CITY[1]), lat, lon)} / 1000.0)"


def ramp(x: str, lo: float, hi: float) -> str:
    return clamp(f"({x} - {lo}) / ({hi} - {lo})")


# --- segments ---------------------------------------------------------------------------------------------------------
def rpm_sweet_spot(rpm: str) -> str:
    return f"CASE WHEN {nz(rpm)} = 0 THEN 0.0 ELSE greatest(0.0, 1.0 - abs({rpm} - 4500.0) / 4500.0) END"


def seg_blend(n: str, curviness_p: str, geo_p: str) -> str:
    c = confidence(n, CONFIDENCE_SEG)
    return f"({c} * {curviness_p} + (1.0 - {c}) * {geo_p})"


def seg_scenic(light: str = "1.0", bonus: str = "0.0") -> str:
    """Over percentiles elev_p, relief_p, forest_p, water_p and the columns class_scenic, blend, viewpoint, tunnel."""
    mix = "0.22 * coalesce(class_scenic, 0.5) + 0.15 * elev_p + 0.15 * relief_p + 0.10 * forest_p + 0.10 * least(1.0, 0.7 * water_p + 0.3 * coalesce(viewpoint, 0.0)) + 0.28 * blend"
    return clamp(f"({mix}) * CASE WHEN tunnel THEN 0.65 ELSE 1.0 END * {light} + {bonus}")


def seg_fun() -> str:
    return clamp(f"0.40 * blend + 0.20 * leaned_p + 0.15 * band_p + 0.10 * (1.0 - {nz('crawl_share')}) + 0.10 * gradient_p + 0.05 * {rpm_sweet_spot('rpm_mean')}")


def seg_twist() -> str:
    return clamp("0.65 * blend + 0.35 * geo_p")


def seg_traffic() -> str:
    c = confidence("n_trips", CONFIDENCE_SEG)
    return clamp(f"{c} * (0.7 * {nz('crawl_share')} + 0.3 * (1.0 - {nz('band_share')})) + (1.0 - {c}) * {lookup('highway', TRAFFIC_PRIOR, 0.12)}")


def seg_risk(weather: str = "0.0") -> str:
    return f"least(1.0, 0.45 * abs_p + 0.25 * least(1.0, {nz('hard_decel_rate')} / 5.0) + 0.30 * {nz('crawl_share')} + {weather})"


def seg_seconds() -> str:
    return f"(length_m / 1000.0 / greatest(CASE WHEN {nz('speed_mean')} < 5.0 THEN coalesce(nullif(speed_assumed, 0.0), 50.0) ELSE speed_mean END, 5.0) * 3600.0)"


def seg_straight() -> str:
    return f"({clamp('(road_run_km - 0.6) / 2.4')} * (1.0 - twist))"


def seg_cost(alpha: float, highway: float = 0.0, twist: float = 0.0, traffic: float = 0.0, beta: float = 1.0) -> str:
    """Over scenic, risk, twist, traffic, seconds, road_run_km and highway, without the junction's delay."""
    return f"(seconds * (1.0 + {alpha} * (1.0 - scenic) + {beta} * risk + {highway} * {lookup('highway', HIGHWAY_AVOIDANCE, 0.0)} + {twist} * ((1.0 - twist) + {seg_straight()}) + {traffic} * traffic))"


def seg_excluded(lean_p95: float, style: float, margin: float, weather: float = 1.0) -> str:
    return f"({nz('lean_p95')} > 0 AND {nz('lean_p95')} > {lean_p95} * {margin} / greatest({style}, 0.3) * {weather})"


def junction_seconds(degree: str) -> str:
    return f"(5.0 + 3.0 * greatest(0, {degree} - 2))"


# --- cells ------------------------------------------------------------------------------------------------------------
def z(value: str, mean: str, sd: str) -> str:
    """Null is the average."""
    return f"coalesce(({value} - {mean}) / coalesce(nullif({sd}, 0.0), 1.0), 0.0)"


def cell_value(w: tuple[float, float, float], lean: float) -> str:
    """Over fun, scenic, fresh (0 or 1), lean_p50 and n_trips."""
    growth = f"(0.5 * CASE WHEN {nz('lean_p50')} BETWEEN {lean} * 0.85 AND {lean} THEN 1.0 ELSE 0.0 END + 0.5 * fresh)"
    c = confidence("n_trips", CONFIDENCE_CELL)
    return clamp(f"{c} * ({w[0]} * fun + {w[1]} * scenic + {w[2]} * {growth}) + (1.0 - {c}) * 0.5")


def cell_risk(weather: str = "0.0") -> str:
    jam = f"greatest(0.0, 1.0 - {nz('speed_med')} / greatest({nz('speed_p85')}, 0.000001))"
    return clamp(f"0.4 * least(1.0, {nz('abs_rate')} / p95_brake) + 0.3 * least(1.0, {nz('decel_rate')} / p95_decel) + 0.2 * {weather} + 0.1 * {jam}")


def cell_seconds(length: str, v: str, region: str) -> str:
    return f"({length} / 1000.0 / greatest(coalesce(nullif({v}, 0.0), {region}), 3.0) * 3600.0)"


# --- roads ------------------------------------------------------------------------------------------------------------
def road_style_factor(style: str) -> str:
    curve, speed = ramp(f"greatest(0.0, {nz('curvature_geo')})", 90.0, 370.0), ramp(lookup("highway", ROAD_SPEED, 45.0), 55.0, 100.0)
    return f"CASE WHEN {style} = 'A' THEN 1.0 + 3.0 * {curve} + 0.8 * {speed} ELSE 1.0 END"


def road_highway_factor(avoid: float = 1.0) -> str:
    return f"(1.0 + {ramp(city_km('mid_lat', 'mid_lon'), RING_FROM, RING_TO)} * {avoid} * ({lookup('highway', OUTER_HIGHWAY, 1.0)} - 1.0))"


def road_straight_factor(avoid: float = 1.0) -> str:
    city = ramp(city_km("mid_lat", "mid_lon"), RING_FROM, RING_TO)
    return f"(1.0 + {city} * {ramp(nz('road_run_km'), RUN_FROM, RUN_TO)} * (1.0 - least(1.0, greatest(0.0, {nz('curvature_geo')}) / 70.0)) * {avoid} * 3.0)"


# --- light, weather, forecast -----------------------------------------------------------------------------------------
def sun_terms(n: str, lat: str, lon: str) -> tuple[str, str]:
    """Elevation and azimuth in degrees, n days after the epoch of 2000."""
    g = f"radians({pmod(f'357.528 + 0.9856003 * {n}', 360.0)})"
    lam = f"radians({pmod(f'280.460 + 0.9856474 * {n}', 360.0)} + 1.915 * sin({g}) + 0.020 * sin(2.0 * {g}))"
    eps = f"radians(23.439 - 0.0000004 * {n})"
    ra = f"atan2(cos({eps}) * sin({lam}), cos({lam}))"
    dec = f"asin(sin({eps}) * sin({lam}))"
    lst = f"radians({pmod(f'({pmod(f'18.697374558 + 24.06570982441908 * {n}', 24.0)}) * 15.0 + {lon}', 360.0)})"
    ha = f"({lst} - {ra})"
    elev = f"degrees(asin(sin(radians({lat})) * sin({dec}) + cos(radians({lat})) * cos({dec}) * cos({ha})))"
    az = f"({pmod(f'degrees(atan2(-sin({ha}), tan({dec}) * cos(radians({lat})) - sin(radians({lat})) * cos({ha})))', 360.0)})"
    return elev, az


def daylight(e: str) -> str:
    return f"CASE WHEN {e} >= 5 THEN 1.0 WHEN {e} >= 0 THEN 0.95 WHEN {e} >= -6 THEN 0.55 WHEN {e} >= -12 THEN 0.25 ELSE 0.12 END"


def golden(e: str) -> str:
    return f"CASE WHEN {e} <= -4 OR {e} >= 12 THEN 0.0 WHEN {e} < 0 THEN greatest(0.0, ({e} + 4.0) / 4.0) * 0.6 ELSE greatest(0.0, 1.0 - {e} / 12.0) END"


def facing(bearing: str, azimuth: str) -> str:
    d = f"abs({pmod(f'{bearing} - {azimuth} + 180.0', 360.0)} - 180.0)"
    return f"CASE WHEN {bearing} IS NULL OR {d} >= 90 THEN 0.0 ELSE cos(radians({d})) END"


def phase(e: str) -> str:
    return f"CASE WHEN {e} >= 5 THEN 'day' WHEN {e} >= -4 THEN 'golden hour' WHEN {e} >= -12 THEN 'twilight' ELSE 'night' END"


def weather_risk(precip: str, temp: str, gust: str) -> str:
    return f"least(1.0, CASE WHEN {precip} > 0 THEN least(0.5, 0.15 + {precip} * 0.1) ELSE 0.0 END + CASE WHEN {temp} < 8 THEN 0.2 ELSE 0.0 END + CASE WHEN {gust} > 45 THEN 0.15 ELSE 0.0 END)"


def weather_factor(precip: str, temp: str, code: str) -> str:
    return f"CASE WHEN {code} IN (71, 73, 75, 77, 85, 86) THEN 0.0 WHEN {precip} > 0 AND {temp} < 8 THEN 0.5 WHEN {precip} > 0 THEN 0.7 ELSE 1.0 END"


def temp_score(t: str) -> str:
    return f"CASE WHEN {t} IS NULL THEN 0.5 WHEN {t} BETWEEN 14.0 AND 27.0 THEN 1.0 WHEN {t} < 14.0 THEN greatest(0.0, ({t} - 4.0) / 10.0) ELSE greatest(0.0, (35.0 - {t}) / 8.0) END"


def gust_score(g: str) -> str:
    return f"CASE WHEN {g} IS NULL THEN 0.7 WHEN {g} <= 25.0 THEN 1.0 ELSE greatest(0.0, (55.0 - {g}) / 30.0) END"


def rain_score(pop: str, precip: str) -> str:
    r = f"(1.0 - least(1.0, {nz(pop)} / 100.0))"
    return f"CASE WHEN {nz(precip)} > 0.2 THEN least({r}, 0.15) ELSE {r} END"


# --- riders -----------------------------------------------------------------------------------------------------------
def experience_gate(s: str) -> str:
    return f"CASE WHEN {s} < 0.4 THEN 'novice' WHEN {s} < 0.65 THEN 'intermediate' WHEN {s} < 0.85 THEN 'advanced' ELSE 'expert' END"


def alpha_max(s: str) -> str:
    return f"CASE WHEN {s} < 0.4 THEN 3.0 WHEN {s} < 0.65 THEN 5.0 WHEN {s} < 0.85 THEN 8.0 ELSE 10.0 END"


def bike_class(rpm: str, speed: str) -> str:
    r = f"(CASE WHEN {nz(speed)} = 0 THEN 0.0 ELSE {rpm} / {speed} END)"
    return f"CASE WHEN {r} > 60 THEN 'sport' WHEN {r} > 42 THEN 'roadster' ELSE 'tourer / adventure' END"
