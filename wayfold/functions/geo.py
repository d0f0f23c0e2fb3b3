"""Geometry and grid as SQL expressions over column names; ``functions.column`` turns them into Columns."""

from __future__ import annotations

EARTH_M = 6371000.0
DEG_M = 111320.0
LEVEL = 18
COARSE = 14


def pmod(a: str, b: float) -> str:
    return f"((({a}) % {b}) + {b}) % {b}"


def clamp(x: str, lo: str = "0.0", hi: str = "1.0") -> str:
    return f"greatest({lo}, least({hi}, {x}))"


def trunc(x: str) -> str:
    """Towards zero, as an integer."""
    return f"CAST(CASE WHEN {x} < 0 THEN ceil({x}) ELSE floor({x}) END AS BIGINT)"


def half_even(x: str) -> str:
    """To the nearest integer, halves to the even one."""
    return f"CAST(CASE WHEN ({x}) - floor({x}) = 0.5 THEN 2 * round(floor(({x}) + 0.5) / 2.0 - 0.25) ELSE floor(({x}) + 0.5) END AS BIGINT)"


def tile_x(lon: str, level: int = LEVEL) -> str:
    n = 1 << level
    return f"CAST(least({n - 1}, greatest(0, floor(({lon} + 180.0) / 360.0 * {n}))) AS BIGINT)"


def tile_y(lat: str, level: int = LEVEL) -> str:
    """Both axes are divided by 360 degrees, so tiles are square in degrees."""
    n = 1 << level
    return f"CAST(least({n - 1}, greatest(0, floor(({lat} + 90.0) / 360.0 * {n}))) AS BIGINT)"


def quadkey(x: str, y: str, level: int = LEVEL) -> str:
    """Base-4 digits, most significant first: twice the latitude's bit and the longitude's."""
    bit = lambda v, k: f"(CAST(floor({v} / {1 << k}.0) AS BIGINT) % 2)"
    return " || ".join(f"CAST(2 * {bit(y, k)} + {bit(x, k)} AS STR)" for k in reversed(range(level)))


def unquadkey(code: str, level: int = LEVEL) -> tuple[str, str]:
    """Tile x and y of a code."""
    digit = lambda k: f"CAST(substr({code}, {k + 1}, 1) AS BIGINT)"
    x = " + ".join(f"({digit(k)} % 2) * {1 << (level - 1 - k)}" for k in range(level))
    y = " + ".join(f"CAST(floor({digit(k)} / 2.0) AS BIGINT) * {1 << (level - 1 - k)}" for k in range(level))
    return f"({x})", f"({y})"


def tile_centre(x: str, y: str, level: int = LEVEL) -> tuple[str, str]:
    """Latitude and longitude of a tile's middle."""
    n = float(1 << level)
    return f"(({y} + 0.5) / {n} * 360.0 - 90.0)", f"(({x} + 0.5) / {n} * 360.0 - 180.0)"


def packed(lat: str, lon: str, level: int = LEVEL) -> str:
    n = 1 << level
    return f"(CAST(floor(({lat} + 90.0) / 360.0 * {n}) AS BIGINT) * {n} + CAST(floor(({lon} + 180.0) / 360.0 * {n}) AS BIGINT))"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = f"power(sin(radians({lat2} - {lat1}) / 2.0), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2.0), 2)"
    return f"(2.0 * {EARTH_M} * asin(sqrt(least(1.0, {h}))))"


def flat_step(lat: str, lon: str, p_lat: str, p_lon: str) -> str:
    """Equirectangular distance; the scale is that of the current latitude."""
    return f"sqrt(power(({lat} - {p_lat}) * {DEG_M}, 2) + power(({lon} - {p_lon}) * {DEG_M} * cos(radians({lat})), 2))"


def bearing(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    y = f"sin(radians({lon2} - {lon1})) * cos(radians({lat2}))"
    x = f"cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos(radians({lon2} - {lon1}))"
    return f"({pmod(f'degrees(atan2({y}, {x}))', 360.0)})"


def turn(a: str, b: str) -> str:
    """The smallest angle between two headings."""
    return f"abs({pmod(f'{b} - {a} + 180.0', 360.0)} - 180.0)"


def undirected(a: str, b: str) -> str:
    return f"least({turn(a, b)}, 180.0 - {turn(a, b)})"


def piece_distance(plat: str, plon: str, alat: str, alon: str, blat: str, blon: str) -> str:
    """Metres from a point to a piece of line, on a plane at the point."""
    k = f"({DEG_M} * cos(radians({plat})))"
    dx, dy = f"(({blon} - {alon}) * {k})", f"(({blat} - {alat}) * {DEG_M})"
    ex, ey = f"(({plon} - {alon}) * {k})", f"(({plat} - {alat}) * {DEG_M})"
    l2 = f"({dx} * {dx} + {dy} * {dy})"
    t = f"CASE WHEN {l2} <= 0.000000001 THEN 0.0 ELSE greatest(0.0, least(1.0, ({ex} * {dx} + {ey} * {dy}) / {l2})) END"
    return f"sqrt(power({ex} - ({t}) * {dx}, 2) + power({ey} - ({t}) * {dy}, 2))"


def in_sector(b: str, lo: float, hi: float) -> str:
    return f"({b} BETWEEN {lo} AND {hi})" if lo <= hi else f"({b} >= {lo} OR {b} <= {hi})"


def urban_grid(lat: str, lon: str, step: float = 0.018) -> tuple[str, str]:
    return trunc(f"({lat} / {step})"), trunc(f"({lon} / {step * 1.5})")


def octant(b: str) -> str:
    return f"CAST(floor({b} / 45.0) AS BIGINT)"
