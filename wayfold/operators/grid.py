"""Geometry and grid operators over telemetry and roads."""

from __future__ import annotations

from wayfold.functions import geo
from wayfold.plans.relation import CATALOG

add = CATALOG.add
G = geo
N = 1 << 18
code = G.quadkey("x", "y")

add("coded", f"SELECT *, {code} AS code FROM (SELECT trip, event_id, rn, t_ms, lat, lon, {G.tile_x('lon')} AS x, {G.tile_y('lat')} AS y FROM {{tele}})", query=False)
add("g1_tile_xy", "SELECT event_id, x, y FROM {coded}")
add("g2_quadkey", "SELECT event_id, code FROM {coded}")
add("g3_tile_bounds", f"SELECT DISTINCT code, round(y / {N}.0 * 360.0 - 90.0, 9) AS south, round(x / {N}.0 * 360.0 - 180.0, 9) AS west, round((y + 1) / {N}.0 * 360.0 - 90.0, 9) AS north, round((x + 1) / {N}.0 * 360.0 - 180.0, 9) AS east FROM {{coded}}")
_x, _y = G.unquadkey("code")
_lat, _lon = G.tile_centre("cx", "cy")
add("g4_code_centre", f"SELECT code, round({_lat}, 9) AS lat, round({_lon}, 9) AS lon FROM (SELECT code, {_x} AS cx, {_y} AS cy FROM (SELECT DISTINCT code FROM {{coded}}))")
add("g5_cell_width", f"SELECT event_id, round(360.0 / {N}.0 * 111320.0 * cos(radians(lat)), 6) AS width_m FROM {{tele}}")
add("g6_encoder_gate", f"""SELECT CAST(count(*) AS BIGINT) AS checked, CAST(sum(CASE WHEN code = again THEN 0 ELSE 1 END) AS BIGINT) AS mismatches FROM
(SELECT code, {G.quadkey('tx', 'ty')} AS again FROM (SELECT code, {G.tile_x('lon')} AS tx, {G.tile_y('lat')} AS ty FROM
 (SELECT code, lat, lon FROM {{coded}} WHERE NOT (lat = 0 AND lon = 0) ORDER BY event_id LIMIT 1000)))""")
add("g7_packed_id", f"SELECT event_id, {G.packed('lat', 'lon')} AS cell FROM {{tele}}")
add("g8_packed_centre", f"SELECT cell, round({G.tile_centre(f'(cell % {N})', f'floor(cell / {N}.0)')[0]}, 9) AS lat, round({G.tile_centre(f'(cell % {N})', f'floor(cell / {N}.0)')[1]}, 9) AS lon FROM (SELECT DISTINCT {G.packed('lat', 'lon')} AS cell FROM {{tele}})")
add("g9_prefix_rollup", "SELECT substr(code, 1, 14) AS coarse, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT code) AS BIGINT) AS cells FROM {coded} GROUP BY substr(code, 1, 14)")
add("g10_haversine", f"SELECT seg_id, round({G.haversine('a_lat', 'a_lon', 'b_lat', 'b_lon')}, 6) AS m FROM {{seg}}")
add("g11_flat_step", "SELECT event_id, round(step_m, 6) AS step_m FROM {steps} WHERE p_lat IS NOT NULL")
add("g12_bearing", f"SELECT seg_id, round({G.bearing('a_lat', 'a_lon', 'b_lat', 'b_lon')}, 6) AS deg FROM {{seg}}")
add("g13_turn_angle", f"SELECT event_id, round({G.turn('hdg', 'p')}, 6) AS deg FROM (SELECT event_id, hdg, lag(hdg) OVER (PARTITION BY trip ORDER BY rn) AS p FROM {{tele}}) WHERE p IS NOT NULL")
add("g14_heading_mismatch", f"SELECT seg_id, round({G.undirected('bearing_mean', '90.0')}, 6) AS deg FROM {{seg}} WHERE bearing_mean IS NOT NULL")
add("g15_piece_distance", f"SELECT p.poi_id, s.seg_id, round({G.piece_distance('p.lat', 'p.lon', 's.a_lat', 's.a_lon', 's.b_lat', 's.b_lon')}, 4) AS m FROM {{poi}} p JOIN {{seg}} s ON s.node_a = (p.poi_id * 7) % 160")
add("g16_sector", f"SELECT seg_id, {G.in_sector('bearing_mean', 140.0, 235.0)} AS south, {G.in_sector('bearing_mean', 315.0, 45.0)} AS north FROM {{seg}} WHERE bearing_mean IS NOT NULL")
add("g17_bbox", "SELECT event_id, lat BETWEEN 47.60 AND 47.75 AND lon BETWEEN 11.15 AND 11.503 AS inside FROM {tele}")
# bounding boxes of waters; some have none
add("bounds", "SELECT poi_id, CASE WHEN poi_id % 6 > 0 THEN lat - weight * 0.002 END AS minlat, lat + s_nationkey * 0.0001 AS maxlat, lon - weight * 0.001 AS minlon, lon + s_nationkey * 0.0002 AS maxlon FROM {poi}", query=False)
add("g18_poi_area", "SELECT poi_id, round(coalesce(abs((maxlat - minlat) * 111320.0 * (maxlon - minlon) * 111320.0 * 0.67), 0.0), 4) AS area_m2 FROM {bounds}")
_gy, _gx = G.urban_grid("lat", "lon")
add("g19_urban_grid", f"SELECT node, {_gy} AS gy, {_gx} AS gx FROM {{node}}")
add("g20_octant", f"SELECT seg_id, {G.octant('bearing_mean')} AS octant FROM {{seg}} WHERE bearing_mean IS NOT NULL")
# a raster of terrain: rows from the north, one pixel each 0.01 degrees; some pixels are voids
add("raster", "SELECT r, c, CASE WHEN (r * 31 + c) % 23 = 0 THEN -32768.0 ELSE 400.0 + (r * 37 + c * 91) % 1900 END AS elev FROM (SELECT r, SERIES(0, 59) AS c FROM (SELECT SERIES(0, 99) AS r))", query=False)
_row, _col = G.half_even("(48.60 - lat) / 0.01"), G.half_even("(lon - 11.25) / 0.01")
add("g21_raster_sample", f"SELECT n.node, CASE WHEN t.elev < -1000 OR t.elev > 9000 THEN NULL ELSE t.elev END AS elev FROM (SELECT node, {_row} AS r, {_col} AS c FROM {{node}}) n LEFT JOIN {{raster}} t ON t.r = n.r AND t.c = n.c")
