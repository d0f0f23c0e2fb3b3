"""Snapping and spatial joins, points of interest, polylines and terrain."""

from __future__ import annotations

from wayfold.functions import geo
from wayfold.functions import scores as S
from wayfold.plans.ranks import ranked_rows
from wayfold.plans.relation import CATALOG

add = CATALOG.add
H = geo.haversine
GRID = 1 << 16

# --- snapping: cells meet the pieces of roads in the nine buckets around them -------------------------------------------------
_bx, _by = (lambda c: f"CAST(floor(({c} + 180.0) / 360.0 * {GRID}) AS BIGINT)"), (lambda c: f"CAST(floor(({c} + 90.0) / 360.0 * {GRID}) AS BIGINT)")
# a crowd cell stands beside every road, near its middle
add("snap_points", """SELECT seg_id AS cell, mid_lat + ((seg_id * 37) % 100 - 50) * 0.00001 AS lat, mid_lon + ((seg_id * 53) % 100 - 50) * 0.000012 AS lon, CASE WHEN seg_id % 11 = 0 THEN NULL ELSE CASE WHEN seg_id % 2 = 0 THEN 90.0 ELSE 0.0 END + (seg_id * 17) % 80 END AS hdg, (seg_id * 7) % 40 + 1 AS n_points, n_trips, lean_p95, speed_mean, abs_rate * 3.0 AS abs_events, length_m AS path_m, curviness AS lean_delta FROM {seg}""", query=False)
# a road is cut into pieces short against a bucket, each of which is listed where its ends lie
add("pieces", "SELECT seg_id, k, a_lat + (b_lat - a_lat) * k / 12.0 AS p_lat, a_lon + (b_lon - a_lon) * k / 12.0 AS p_lon, a_lat + (b_lat - a_lat) * (k + 1) / 12.0 AS q_lat, a_lon + (b_lon - a_lon) * (k + 1) / 12.0 AS q_lon FROM (SELECT seg_id, a_lat, a_lon, b_lat, b_lon, SERIES(0, 11) AS k FROM {seg})", query=False)
add("y9_piece_index", f"SELECT DISTINCT {_bx('lon')} AS bx, {_by('lat')} AS by_, seg_id, k FROM (SELECT seg_id, k, p_lat AS lat, p_lon AS lon FROM {{pieces}} UNION ALL SELECT seg_id, k, q_lat, q_lon FROM {{pieces}})")
add("nine", "SELECT dx, SERIES(-1, 1) AS dy FROM (SELECT SERIES(-1, 1) AS dx)", query=False)
add("snap_candidates", f"""SELECT cell, seg_id, k, min({geo.piece_distance('lat', 'lon', 'p_lat', 'p_lon', 'q_lat', 'q_lon')}) AS d FROM
(SELECT c.*, p.seg_id, p.k, p.p_lat, p.p_lon, p.q_lat, p.q_lon FROM (SELECT s.*, {_bx('lon')} + dx AS bx, {_by('lat')} + dy AS by_ FROM {{snap_points}} s CROSS JOIN {{nine}}) c
 JOIN {{y9_piece_index}} i ON i.bx = c.bx AND i.by_ = c.by_ JOIN {{pieces}} p ON p.seg_id = i.seg_id AND p.k = i.k)
WHERE hdg IS NULL OR {geo.undirected('hdg', geo.bearing('p_lat', 'p_lon', 'q_lat', 'q_lon'))} <= 55.0 GROUP BY cell, seg_id, k""", query=False)
# a road is listed, with its ends, in every bucket that its surroundings touch, so that each point meets one bucket
_M = 46.0
_wide = f"{_M} / ({geo.DEG_M} * greatest(0.01, cos(radians(greatest(abs(a_lat), abs(b_lat))))))"
add("road_boxes", f"SELECT seg_id, a_lat, a_lon, b_lat, b_lon, bx, SERIES(y0, y1) AS by_ FROM (SELECT seg_id, a_lat, a_lon, b_lat, b_lon, y0, y1, SERIES(x0, x1) AS bx FROM (SELECT seg_id, a_lat, a_lon, b_lat, b_lon, {_by(f'(least(a_lat, b_lat) - {_M / geo.DEG_M!r})')} AS y0, {_by(f'(greatest(a_lat, b_lat) + {_M / geo.DEG_M!r})')} AS y1, {_bx(f'(least(a_lon, b_lon) - {_wide})')} AS x0, {_bx(f'(greatest(a_lon, b_lon) + {_wide})')} AS x1 FROM {{seg}}))", query=False)
add("snapped", f"""SELECT cell, seg_id, d FROM (SELECT cell, seg_id, d, row_number() OVER (PARTITION BY cell ORDER BY round(d, 6), seg_id) AS r FROM (SELECT c.cell, r.seg_id, {geo.piece_distance('c.lat', 'c.lon', 'r.a_lat', 'r.a_lon', 'r.b_lat', 'r.b_lon')} AS d
FROM {{snap_points}} c JOIN {{road_boxes}} r ON r.bx = {_bx('c.lon')} AND r.by_ = {_by('c.lat')} WHERE c.hdg IS NULL OR {geo.undirected('c.hdg', geo.bearing('r.a_lat', 'r.a_lon', 'r.b_lat', 'r.b_lon'))} <= 55.0) WHERE d < 46.0) WHERE r = 1""", query=False,
    oracle="SELECT cell, seg_id, d FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY round(d, 6), seg_id, k) AS r FROM {snap_candidates} WHERE d < 46.0) WHERE r = 1")
add("j1_snap_cells", "SELECT cell, seg_id, round(d, 3) AS d FROM {snapped}")
# the cells of a rider's trips, by their number of trips, meet the roads alike
add("j2_snap_rider", "SELECT s.cell, s.seg_id, p.n_trips FROM {snapped} s JOIN {snap_points} p ON p.cell = s.cell WHERE p.n_trips > 0")
add("snap_pool", """SELECT s.seg_id, CAST(sum(p.n_points) AS BIGINT) AS n_points, max(p.n_trips) AS n_trips, sum(p.path_m) AS path_m, sum(p.lean_delta) AS lean_delta, sum(p.abs_events) AS abs_events, sum(p.lean_p95 * p.n_points) / sum(p.n_points) AS lean_p95, coalesce(sum(nullif(p.speed_mean, 0.0) * p.n_points) / sum(CASE WHEN p.speed_mean <> 0 THEN p.n_points END), 0.0) AS speed_mean
FROM {snapped} s JOIN {snap_points} p ON p.cell = s.cell GROUP BY s.seg_id""", query=False)
add("a11_snap_pooling", "SELECT seg_id, n_points, n_trips, round(path_m, 4) AS path_m, round(lean_delta, 4) AS lean_delta, round(lean_p95, 6) AS lean_p95, round(speed_mean, 6) AS speed_mean FROM {snap_pool}")
add("a12_rates", "SELECT seg_id, round(lean_delta / greatest(path_m / 1000.0, 0.000001), 6) AS curviness, round(abs_events / greatest(path_m / 1000.0, 0.000001), 6) AS abs_rate FROM {snap_pool}")

# --- nearest and range --------------------------------------------------------------------------------------------------------
# Points on the unit sphere lie in cubes, each of which holds up to 64 of the next level; a cube carries one of its points. A probe
# starts with all eight cubes of the first level and goes down: of a level's cubes it keeps those that can hold a nearer point
# than the nearest one carried. So a probe meets a few cubes of each level, however many points they hold and wherever they
# are: the poles and the date line are places like all others.
LEVELS = 8
_unit = lambda t: f"cos(radians({t}.lat)) * cos(radians({t}.lon)) AS x, cos(radians({t}.lat)) * sin(radians({t}.lon)) AS y, sin(radians({t}.lat)) AS z"
_cube = lambda v, k: f"CAST(floor(({v} + 1.0) * {4**k / 2}) AS BIGINT)"
#: Beyond what rounding moves a distance on the unit sphere.
SLACK = "0.000000000001"


def nearest(name: str, probes: str, points: str, key: str, where: str = "TRUE", shown: str = "round(d, 3) AS d", query: bool = True) -> None:
    """The nearest point of each probe, at any distance; ties go to the smaller key. Probes: poi_id, lat, lon."""
    d = H("p.lat", "p.lon", "n.lat", "n.lon")
    add(f"{name}_points", f"SELECT q.*, {', '.join(f'{_cube(v, LEVELS)} AS c{v}' for v in 'xyz')} FROM (SELECT n.{key} AS id, n.lat, n.lon, {_unit('n')} FROM {{{points}}} n WHERE {where}) q", query=False)
    finer = f"{name}_points"
    for k in range(LEVELS, -1, -1):
        up = [f"c{v} AS c{v}" if k == LEVELS else f"CAST(floor(c{v} / 4.0) AS BIGINT) AS c{v}" for v in "xyz"]
        add(f"{name}_cubes_{k}", f"SELECT cx, cy, cz, CAST(floor(cx / 4.0) AS BIGINT) AS ux, CAST(floor(cy / 4.0) AS BIGINT) AS uy, CAST(floor(cz / 4.0) AS BIGINT) AS uz, min(id) AS id, MINBY(x, id) AS x, MINBY(y, id) AS y, MINBY(z, id) AS z FROM (SELECT {', '.join(up)}, id, x, y, z FROM {{{finer}}}) GROUP BY cx, cy, cz", query=False)
        finer = f"{name}_cubes_{k}"
    add(f"{name}_probes", f"SELECT p.poi_id, p.lat, p.lon, {_unit('p')} FROM {{{probes}}} p", query=False)
    for k in range(LEVELS + 1):
        w = 2 / 4**k
        out = lambda v: f"greatest(0.0, greatest(c.c{v} * {w!r} - 1.0 - p.{v}, p.{v} - ((c.c{v} + 1) * {w!r} - 1.0)))"
        least = f"sqrt({' + '.join(f'power({out(v)}, 2)' for v in 'xyz')}) AS least"
        carried = f"sqrt({' + '.join(f'power(c.{v} - p.{v}, 2)' for v in 'xyz')}) AS carried"
        source = f"{{{name}_probes}} p CROSS JOIN {{{name}_cubes_0}} c" if k == 0 else f"{{{name}_kept_{k - 1}}} p JOIN {{{name}_cubes_{k}}} c ON c.ux = p.cx AND c.uy = p.cy AND c.uz = p.cz"
        add(f"{name}_kept_{k}", f"SELECT poi_id, lat, lon, x, y, z, cx, cy, cz FROM (SELECT *, min(carried) OVER (PARTITION BY poi_id) AS best FROM (SELECT p.poi_id, p.lat, p.lon, p.x, p.y, p.z, c.cx, c.cy, c.cz, {least}, {carried} FROM {source})) WHERE least <= best + {SLACK}", query=False)
    full = f"SELECT poi_id, id AS {key}, {shown} FROM (SELECT p.poi_id, n.{key} AS id, {d} AS d, row_number() OVER (PARTITION BY p.poi_id ORDER BY round({d}, 6), n.{key}) AS r FROM {{{probes}}} p CROSS JOIN {{{points}}} n WHERE {where}) WHERE r = 1"
    add(name, f"SELECT poi_id, id AS {key}, {shown} FROM (SELECT p.poi_id, n.id, {d} AS d, row_number() OVER (PARTITION BY p.poi_id ORDER BY round({d}, 6), n.id) AS r FROM {{{name}_kept_{LEVELS}}} p JOIN {{{name}_points}} n ON n.cx = p.cx AND n.cy = p.cy AND n.cz = p.cz) WHERE r = 1", query, oracle=full)


add("main_nodes", "SELECT n.node, n.lat, n.lon, d.degree FROM {node} n JOIN {degree} d ON d.node = n.node", query=False)
nearest("j9_nearest_node", "poi", "main_nodes", "node")
nearest("j7_nearest_junction", "poi", "main_nodes", "node", "n.degree >= 3")
nearest("j8_nearest_cell", "poi", "cells", "code")
add("box_counts", "SELECT p.poi_id, CAST(count(n.node) AS BIGINT) AS n FROM (SELECT *, CAST(floor(lat / 0.02) AS BIGINT) AS gy, CAST(floor(lon / 0.02) AS BIGINT) AS gx FROM {poi}) p CROSS JOIN {nine} k JOIN {node} n ON CAST(floor(n.lat / 0.02) AS BIGINT) = p.gy + k.dy AND CAST(floor(n.lon / 0.02) AS BIGINT) = p.gx + k.dx WHERE n.lat BETWEEN p.lat - 0.01 AND p.lat + 0.01 AND n.lon BETWEEN p.lon - 0.015 AND p.lon + 0.015 GROUP BY p.poi_id", query=False)
add("j10_box_range", "SELECT p.poi_id, coalesce(b.n, CAST(0 AS BIGINT)) AS n FROM {poi} p LEFT JOIN {box_counts} b ON b.poi_id = p.poi_id",
    oracle="SELECT p.poi_id, count(n.node) AS n FROM {poi} p LEFT JOIN {node} n ON n.lat BETWEEN p.lat - 0.01 AND p.lat + 0.01 AND n.lon BETWEEN p.lon - 0.015 AND p.lon + 0.015 GROUP BY p.poi_id")
add("viewpoint_ok", "SELECT p.poi_id, p.lat, p.lon, p.name, n.node, n.d FROM {poi} p JOIN {j9_nearest_node} n ON n.poi_id = p.poi_id WHERE p.kind = 'viewpoint' AND n.d <= 700.0", query=False)
_by8, _bx8 = "CAST(floor({0}.lat / 0.08) AS BIGINT)", "CAST(floor({0}.lon / 0.13) AS BIGINT)"
# equal places have equal distances, so of viewpoints at one place the first alone can be a target, and lakes at one place share theirs
add("viewpoint_places", "SELECT lat, lon, min(poi_id) AS target FROM {viewpoint_ok} GROUP BY lat, lon", query=False)
add("lake_places", "SELECT min(poi_id) AS poi_id, lat, lon FROM {poi} WHERE kind = 'lake' GROUP BY lat, lon", query=False)
nearest("nearest_viewpoint", "lake_places", "viewpoint_places", "target", shown="d", query=False)
add("lake_targets", "SELECT q.poi_id, v.target FROM {poi} q JOIN {lake_places} l ON l.lat = q.lat AND l.lon = q.lon JOIN {nearest_viewpoint} v ON v.poi_id = l.poi_id WHERE q.kind = 'lake' AND v.d <= 8000.0", query=False,
    oracle=f"SELECT poi_id, target FROM (SELECT l.poi_id, v.poi_id AS target, row_number() OVER (PARTITION BY l.poi_id ORDER BY round({H('l.lat', 'l.lon', 'v.lat', 'v.lon')}, 6), v.poi_id) AS r FROM {{poi}} l, {{viewpoint_ok}} v WHERE l.kind = 'lake' AND {H('l.lat', 'l.lon', 'v.lat', 'v.lon')} <= 8000) WHERE r = 1")
add("poi_roads", "SELECT p.poi_id, p.name, p.kind, p.weight, p.ele, coalesce(t.target, p.poi_id) AS target, n.node, n.d AS snap_m, m.lat, m.lon FROM {poi} p LEFT JOIN {lake_targets} t ON t.poi_id = p.poi_id JOIN {j9_nearest_node} n ON n.poi_id = coalesce(t.target, p.poi_id) JOIN {node} m ON m.node = n.node WHERE n.d <= 2500.0", query=False)
add("j11_poi_roads", "SELECT poi_id, target, node, snap_m FROM {poi_roads}")
# every third point of a route, which is the operator's own stride; the first is always one
add("route_points", "SELECT r.route, r.pos, s.mid_lat AS lat, s.mid_lon AS lon FROM {routes} r JOIN {seg} s ON s.seg_id = r.seg_id WHERE (r.pos - 1) % 3 = 0", query=False)
_by7, _bx7 = "CAST(floor({0}.lat / 0.0064) AS BIGINT)", "CAST(floor({0}.lon / 0.01) AS BIGINT)"
add("j12_route_visits", f"SELECT r.route, p.poi_id, round(min({H('p.lat', 'p.lon', 'r.lat', 'r.lon')}), 3) AS d FROM (SELECT p.*, {_by7.format('p')} + k.dy AS gy, {_bx7.format('p')} + k.dx AS gx FROM {{poi_roads}} p CROSS JOIN {{nine}} k) p JOIN {{route_points}} r ON {_by7.format('r')} = p.gy AND {_bx7.format('r')} = p.gx GROUP BY r.route, p.poi_id HAVING min({H('p.lat', 'p.lon', 'r.lat', 'r.lon')}) <= 700.0",
    oracle=f"SELECT r.route, p.poi_id, round(min({H('p.lat', 'p.lon', 'r.lat', 'r.lon')}), 3) AS d FROM {{poi_roads}} p, {{route_points}} r GROUP BY r.route, p.poi_id HAVING min({H('p.lat', 'p.lon', 'r.lat', 'r.lon')}) <= 700.0")

# --- points of interest -----------------------------------------------------------------------------------------------------
# tags of what a map holds; heights are texts, some with a unit, some none
add("tagged", """SELECT poi_id, CASE WHEN s_nationkey % 5 = 0 THEN 'viewpoint' END AS tourism, CASE WHEN s_nationkey % 5 = 1 THEN CASE WHEN poi_id % 3 = 0 THEN 'no' ELSE 'yes' END END AS mountain_pass,
 CASE WHEN s_nationkey % 5 = 2 THEN 'peak' WHEN s_nationkey % 5 = 3 THEN 'water' END AS nature, CASE poi_id % 4 WHEN 0 THEN CAST(ele AS STR) WHEN 1 THEN ' ' || CAST(ele AS STR) || ' m' WHEN 2 THEN 'about ' || CAST(ele AS STR) END AS ele FROM {poi}""", query=False)
add("f41_classify", """SELECT poi_id, kind, round(weight, 6) AS weight FROM
(SELECT poi_id, CASE WHEN tourism = 'viewpoint' THEN 'viewpoint' WHEN mountain_pass = 'yes' THEN 'pass' WHEN nature = 'peak' THEN CASE WHEN m >= 1000.0 AND NOT isnan(m) THEN 'peak' END WHEN nature = 'water' AND area_m2 >= 150000.0 THEN 'lake' END AS kind,
 CASE WHEN tourism = 'viewpoint' THEN 1.0 WHEN mountain_pass = 'yes' THEN 1.4 WHEN nature = 'peak' THEN 1.0 + least(m, 2500.0) / 2500.0 ELSE 1.0 + least(area_m2 / 5000000.0, 0.8) END AS weight
 FROM (SELECT t.*, try_cast(split_part(trim(t.ele), ' ', 1) AS DOUBLE) AS m, a.area_m2 FROM {tagged} t JOIN {g18_poi_area} a ON a.poi_id = t.poi_id)) WHERE kind IS NOT NULL""")
add("poi_segments", "SELECT p.poi_id, s.* FROM {poi_roads} p JOIN (SELECT node_a AS node, seg_id FROM {seg} UNION ALL SELECT node_b, seg_id FROM {seg}) e ON e.node = p.node JOIN {roads} s ON s.seg_id = e.seg_id", query=False)
add("poi_features", f"SELECT poi_id, avg(least(curvature_geo, 300.0)) AS curve300, avg(curvature_geo) AS curve, sum(length_m) / greatest(sum(seconds), 0.001) * 3.6 AS kmh, avg(CASE WHEN highway IN {S.HIGHWAYS} THEN 0.0 ELSE 1.0 END) AS non_highway, max(CASE WHEN highway IN ('secondary', 'tertiary') THEN 2 WHEN highway = 'primary' THEN 1 ELSE 0 END) AS road_kind, avg(urban) AS urban FROM {{poi_segments}} GROUP BY poi_id", query=False)
add("a29_poi_road_features", "SELECT poi_id, round(curve, 3) AS curvature, round(kmh, 3) AS kmh FROM {poi_features}")
_kind = lambda lake, view, pass_, peak, other: f"CASE kind WHEN 'lake' THEN {lake} WHEN 'viewpoint' THEN {view} WHEN 'pass' THEN {pass_} WHEN 'peak' THEN {peak} ELSE {other} END"
add("poi_terms", f"""SELECT p.*, f.curve, f.kmh, {S.clamp('f.curve300 / 180.0')} AS curvature, f.non_highway, 1.0 - f.urban AS rural, {S.clamp(S.city_km('p.lat', 'p.lon') + ' / 55.0')} AS distance, {S.clamp('p.ele / 1600.0')} AS elevation, {S.clamp('(p.weight - 1.0) / 0.8')} AS scenery, 1.0 - {S.clamp('p.snap_m / 2500.0')} AS access, CASE f.road_kind WHEN 2 THEN 1.0 WHEN 1 THEN 0.72 ELSE 0.62 END AS tourer
FROM {{poi_roads}} p JOIN {{poi_features}} f ON f.poi_id = p.poi_id""", query=False)
_a = f"0.28 * {_kind(1.0, .82, .62, .68, .6)} + 0.15 * scenery + 0.15 * rural + 0.16 * distance + 0.18 * tourer + 0.08 * access"
_b = f"0.20 * {_kind(.52, .78, 1.0, .86, .6)} + 0.32 * curvature + 0.15 * elevation + 0.12 * rural + 0.13 * non_highway + 0.08 * access"
_c = f"0.20 * {_kind(.75, .86, .96, .92, .7)} + 0.20 * curvature + 0.13 * elevation + 0.13 * scenery + 0.10 * distance + 0.08 * rural + 0.10 * non_highway + 0.06 * access"
_ten = lambda x: f"greatest(1.0, least(10.0, 1.0 + 9.0 * ({x})))"
add("poi_scores", f"SELECT *, {_ten(_a)} AS aff_a, {_ten(_b)} AS aff_b, {_ten(_c)} AS aff_c, {_ten(f'0.58 * {_kind(1.0, .84, .96, .90, .6)} + 0.27 * scenery + 0.15 * rural')} AS objective FROM {{poi_terms}}", query=False)
add("f42_affinity", "SELECT poi_id, round(aff_a, 5) AS a, round(aff_b, 5) AS b, round(aff_c, 5) AS c FROM {poi_scores}")
add("f43_objective", "SELECT poi_id, round(objective, 5) AS objective, round(0.65 * aff_a + 0.35 * objective, 5) AS cool_a, round(0.65 * aff_b + 0.35 * objective, 5) AS cool_b, round(0.65 * aff_c + 0.35 * objective, 5) AS cool_c FROM {poi_scores}")
for _r in "abc":
    ranked_rows(f"poi_ranks_{_r}", "poi_scores", f"round(0.65 * aff_{_r} + 0.35 * objective, 3)", "p.name, p.node, p.poi_id")
add("l7_poi_ranks", " UNION ALL ".join(f"SELECT poi_id, '{r.upper()}' AS rider, rk FROM {{poi_ranks_{r}}}" for r in "abc"),
    oracle=" UNION ALL ".join(f"SELECT poi_id, '{r.upper()}' AS rider, CAST(row_number() OVER (ORDER BY round(0.65 * aff_{r} + 0.35 * objective, 3) DESC, name, node, poi_id) AS BIGINT) AS rk FROM {{poi_scores}}" for r in "abc"))
ranked_rows("curve_ranks", "poi_scores", "round(curve, 3)", "p.name, p.node, p.poi_id")
ranked_rows("speed_ranks", "poi_scores", "round(kmh, 2)", "p.name, p.node, p.poi_id")
add("l8_style_owner", """SELECT poi_id, cr, sr, CASE WHEN cr <= top AND (sr > top OR cr + margin < sr) THEN 'B' WHEN sr <= top AND (cr > top OR sr + margin < cr) THEN 'C' ELSE 'A' END AS owner FROM
(SELECT c.poi_id, c.rk AS cr, s.rk AS sr, greatest(1, ceil(c.of * 0.30)) AS top, greatest(1, ceil(c.of * 0.05)) AS margin FROM {curve_ranks} c JOIN {speed_ranks} s ON s.poi_id = c.poi_id)""",
    oracle="""SELECT poi_id, cr, sr, CASE WHEN cr <= top AND (sr > top OR cr + margin < sr) THEN 'B' WHEN sr <= top AND (cr > top OR sr + margin < cr) THEN 'C' ELSE 'A' END AS owner FROM
(SELECT poi_id, CAST(row_number() OVER (ORDER BY round(curve, 3) DESC, name, node, poi_id) AS BIGINT) AS cr, CAST(row_number() OVER (ORDER BY round(kmh, 2) DESC, name, node, poi_id) AS BIGINT) AS sr, greatest(1, ceil(count(*) OVER () * 0.30)) AS top, greatest(1, ceil(count(*) OVER () * 0.05)) AS margin FROM {poi_scores})""")
# spots of one owner within 12 km of each other, targets in squares of that size
add("spots", "SELECT p.poi_id, p.aff_a, p.aff_b, p.aff_c, p.objective, p.node, p.weight, o.owner, t.lat, t.lon FROM {poi_scores} p JOIN {l8_style_owner} o ON o.poi_id = p.poi_id JOIN {poi} t ON t.poi_id = p.target", query=False)
_by12, _bx12 = "CAST(floor({0}.lat / 0.11) AS BIGINT)", "CAST(floor({0}.lon / 0.19) AS BIGINT)"
_d12 = H("a.lat", "a.lon", "b.lat", "b.lon")
add("j13_spot_density", f"SELECT a.poi_id, round(sum(0.25 + 0.75 * (1.0 - {_d12} / 12000.0)), 4) AS density, CAST(count(*) AS BIGINT) AS spots FROM (SELECT s.*, {_by12.format('s')} + k.dy AS gy, {_bx12.format('s')} + k.dx AS gx FROM {{spots}} s CROSS JOIN {{nine}} k) a JOIN {{spots}} b ON b.owner = a.owner AND {_by12.format('b')} = a.gy AND {_bx12.format('b')} = a.gx WHERE {_d12} <= 12000.0 GROUP BY a.poi_id",
    oracle=f"SELECT a.poi_id, round(sum(0.25 + 0.75 * (1.0 - {_d12} / 12000.0)), 4) AS density, CAST(count(*) AS BIGINT) AS spots FROM {{spots}} a, {{spots}} b WHERE b.owner = a.owner AND {_d12} <= 12000.0 GROUP BY a.poi_id")
# for rider A: visited spots of its own style, how well they suit it, and how much of a 150-minute budget the route uses
add("a33_spot_search_score", "SELECT route, round(10.0 * n + 2.0 * aff + objective + least(1.0, minutes / 150.0), 3) AS score FROM (SELECT v.route, count(*) AS n, sum(0.65 * p.aff_a + 0.35 * p.objective) AS aff, sum(p.objective) AS objective, max(k.minutes) AS minutes FROM {j12_route_visits} v JOIN {spots} p ON p.poi_id = v.poi_id AND p.owner = 'A' JOIN {a23_road_kpis} k ON k.route = v.route GROUP BY v.route)")

# --- terrain ---------------------------------------------------------------------------------------------------------------------
_rc = (geo.half_even("(48.60 - lat) / 0.01"), geo.half_even("(lon - 11.25) / 0.01"))
add("probe_points", "SELECT seg_id, 0 AS k, a_lat AS lat, a_lon AS lon FROM {seg} UNION ALL SELECT seg_id, 1, b_lat, b_lon FROM {seg} UNION ALL SELECT s.seg_id, o.k, s.mid_lat + o.dla, s.mid_lon + o.dlo FROM {seg} s CROSS JOIN (VALUES (2, 0.0, 0.0), (3, 0.018, 0.0), (4, -0.018, 0.0), (5, 0.0, 0.027), (6, 0.0, -0.027)) AS o(k, dla, dlo)", query=False)
add("j17_terrain", f"""SELECT seg_id, round(CASE WHEN e0 IS NOT NULL AND e1 IS NOT NULL THEN (e0 + e1) / 2.0 END, 4) AS elev, round(CASE WHEN e0 IS NOT NULL AND e1 IS NOT NULL THEN 100.0 * (e1 - e0) / greatest(length_m, 1.0) END, 4) AS gradient_pct, round(CASE WHEN n > 2 THEN hi - lo END, 4) AS relief FROM
(SELECT p.seg_id, max(s.length_m) AS length_m, max(CASE WHEN p.k = 0 THEN t.elev END) AS e0, max(CASE WHEN p.k = 1 THEN t.elev END) AS e1, count(CASE WHEN p.k >= 2 THEN t.elev END) AS n, max(CASE WHEN p.k >= 2 THEN t.elev END) AS hi, min(CASE WHEN p.k >= 2 THEN t.elev END) AS lo
 FROM (SELECT seg_id, k, {_rc[0]} AS r, {_rc[1]} AS c FROM {{probe_points}}) p JOIN {{seg}} s ON s.seg_id = p.seg_id LEFT JOIN (SELECT * FROM {{raster}} WHERE elev BETWEEN -1000 AND 9000) t ON t.r = p.r AND t.c = p.c GROUP BY p.seg_id)""")

# --- polylines in long form: one row for each vertex --------------------------------------------------------------------------------
add("vertices", "SELECT way_id, row_number() OVER (PARTITION BY way_id ORDER BY seg_id) AS i, node_a AS node, a_lat + ((seg_id * 13) % 7) * 0.0004 AS lat, a_lon AS lon FROM {seg}", query=False)
# streets along some rows and columns of the lattice, which cross at vertices
add("streets", """SELECT way_id, row_number() OVER (PARTITION BY way_id ORDER BY node) AS i, count(*) OVER (PARTITION BY way_id) AS n, node, lat, lon FROM
(SELECT 2 * CAST(floor(node / 40.0) AS BIGINT) AS way_id, node, lat, lon FROM {node} WHERE CAST(floor(node / 40.0) AS BIGINT) % 3 = 0 UNION ALL SELECT 2 * (node % 40) + 1, node, lat, lon FROM {node} WHERE node % 4 = 0)""", query=False)
add("crossings", "SELECT round(lat, 7) AS la, round(lon, 7) AS lo FROM {streets} GROUP BY round(lat, 7), round(lon, 7) HAVING count(DISTINCT way_id) > 1", query=False)
add("cut_marks", f"""SELECT way_id, i, node, cut, CAST(sum(cut) OVER w AS BIGINT) AS piece, {H('p_lat', 'p_lon', 'lat', 'lon')} AS m FROM
(SELECT v.*, CASE WHEN v.i > 1 AND v.i < v.n AND u.la IS NOT NULL THEN 1 ELSE 0 END AS cut, lag(v.lat) OVER o AS p_lat, lag(v.lon) OVER o AS p_lon FROM {{streets}} v LEFT JOIN {{crossings}} u ON u.la = round(v.lat, 7) AND u.lo = round(v.lon, 7) WHERE v.n > 1 WINDOW o AS (PARTITION BY v.way_id ORDER BY v.i))
WINDOW w AS (PARTITION BY way_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", query=False)
# a leg belongs to the piece that it ends in; pieces of less than five metres go
add("street_pieces", "SELECT way_id, piece, min(i) - 1 AS first_i, max(i) AS last_i, round(sum(m), 6) AS total FROM (SELECT way_id, i, piece - cut AS piece, m FROM {cut_marks} WHERE m IS NOT NULL) GROUP BY way_id, piece HAVING sum(m) >= 5.0", query=False)
add("y1_junction_split", "SELECT v.way_id, p.piece, CAST(v.i AS BIGINT) AS i, v.node FROM (SELECT way_id, i, node, piece FROM {cut_marks} UNION ALL SELECT way_id, i, node, piece - 1 FROM {cut_marks} WHERE cut = 1) v JOIN {street_pieces} p ON p.way_id = v.way_id AND p.piece = v.piece",
    oracle=f"""WITH used AS (SELECT node, count(DISTINCT way_id) AS ways FROM {{streets}} GROUP BY node),
cuts AS (SELECT way_id, i, lead(i) OVER (PARTITION BY way_id ORDER BY i) AS e, row_number() OVER (PARTITION BY way_id ORDER BY i) - 1 AS piece FROM {{streets}} JOIN used USING (node) WHERE i = 1 OR i = n OR ways > 1),
held AS (SELECT c.way_id, c.piece, v.i, v.node, v.lat, v.lon FROM cuts c JOIN {{streets}} v ON v.way_id = c.way_id AND v.i BETWEEN c.i AND c.e),
long_enough AS (SELECT way_id, piece FROM (SELECT *, {H('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS m FROM held WINDOW w AS (PARTITION BY way_id, piece ORDER BY i)) GROUP BY way_id, piece HAVING sum(m) >= 5)
SELECT way_id, piece, i, node FROM held JOIN long_enough USING (way_id, piece)""")
add("legs", f"SELECT way_id, i, lat, lon, p_lat, p_lon, {H('p_lat', 'p_lon', 'lat', 'lon')} AS m FROM (SELECT *, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon FROM {{vertices}} WINDOW w AS (PARTITION BY way_id ORDER BY i)) WHERE p_lat IS NOT NULL", query=False)
add("chainage", "SELECT *, sum(m) OVER (PARTITION BY way_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(m) OVER (PARTITION BY way_id) AS total FROM {legs}", query=False)


def resampled(name: str, spacing: float) -> None:
    """Points every ``spacing`` metres along a line, by interpolation. Each leg makes its own, so that nothing meets by a range and
    nothing made of a line is ever handed to all tasks."""
    at = ", ".join(f"p_{x} + ({x} - p_{x}) * (k * {spacing} - (upto - m)) / m AS {x}" for x in ("lat", "lon"))
    first, last = (f"CAST(floor({x} / {spacing}) AS BIGINT)" for x in ("(upto - m)", "least(upto, total)"))
    add(name, f"SELECT way_id, k, {at} FROM (SELECT way_id, lat, lon, p_lat, p_lon, m, upto, SERIES(least({first}, {last}), {last}) AS k FROM {{chainage}} WHERE m > 0) WHERE k * {spacing} >= upto - m AND k * {spacing} < upto", query=False,
        oracle=f"""SELECT c.way_id, s.k, c.p_lat + (c.lat - c.p_lat) * (s.k * {spacing} - (c.upto - c.m)) / c.m AS lat, c.p_lon + (c.lon - c.p_lon) * (s.k * {spacing} - (c.upto - c.m)) / c.m AS lon
FROM {{chainage}} c JOIN (SELECT way_id, SERIES(0, CAST(floor(total / {spacing}) AS BIGINT)) AS k FROM (SELECT DISTINCT way_id, total FROM {{chainage}})) s ON s.way_id = c.way_id AND s.k * {spacing} >= c.upto - c.m AND s.k * {spacing} < c.upto WHERE c.m > 0""")


resampled("points_100", 100.0)
resampled("points_45", 45.0)
resampled("points_15", 15.0)
# pieces of over 150 m in chunks of 100 m; ids of new nodes run on from piece to piece: sums within blocks of ways, and of blocks
add("piece_cuts", "SELECT p.way_id, CAST(floor(p.way_id / 1000.0) AS BIGINT) AS block, p.piece, p.total, a.node AS a, b.node AS b, CASE WHEN p.total > 150.0 THEN CAST(floor(p.total / 100.0) AS BIGINT) ELSE CAST(0 AS BIGINT) END AS cuts FROM {street_pieces} p JOIN {streets} a ON a.way_id = p.way_id AND a.i = p.first_i JOIN {streets} b ON b.way_id = p.way_id AND b.i = p.last_i", query=False)
add("cut_blocks", "SELECT block, sum(cuts) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - cuts AS before FROM (SELECT block, sum(cuts) AS cuts FROM {piece_cuts} GROUP BY block)", query=False)
add("y2_subdivide", """SELECT way_id, piece, CAST(k AS BIGINT) AS k, CAST(CASE WHEN k = 0 THEN a ELSE 10000000 + base + k - 1 END AS BIGINT) AS node_a, CAST(CASE WHEN k = cuts THEN b ELSE 10000000 + base + k END AS BIGINT) AS node_b, round(m, 3) AS length_m FROM
(SELECT *, CASE WHEN cuts = 0 THEN total WHEN k = cuts THEN total - 100.0 * k ELSE 100.0 END AS m FROM (SELECT *, SERIES(CAST(0 AS BIGINT), cuts) AS k FROM
 (SELECT p.*, w.before + sum(p.cuts) OVER (PARTITION BY p.block ORDER BY p.way_id, p.piece ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - p.cuts AS base FROM {piece_cuts} p JOIN {cut_blocks} w ON w.block = p.block))) WHERE m >= 1.0""",
    oracle="""WITH RECURSIVE numbered AS (SELECT *, 10000000 + coalesce(sum(cuts) OVER (ORDER BY way_id, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS fresh FROM {piece_cuts}),
walk AS (SELECT way_id, piece, b, fresh, 0::BIGINT AS k, a AS node_a, total AS ahead, total <= 150 AS whole FROM numbered
 UNION ALL SELECT way_id, piece, b, fresh + 1, k + 1, fresh, ahead - 100, whole FROM walk WHERE NOT whole AND ahead >= 100)
SELECT way_id, piece, k, node_a, CASE WHEN whole OR ahead < 100 THEN b ELSE fresh END AS node_b, round(CASE WHEN whole THEN ahead ELSE least(ahead, 100.0) END, 3) AS length_m FROM walk WHERE ahead >= 1""")
add("y4_interpolate", "SELECT way_id, k, round(lat, 7) AS lat, round(lon, 7) AS lon FROM {points_45}")
add("headings", f"SELECT way_id, k, {geo.bearing('p_lat', 'p_lon', 'lat', 'lon')} AS b, d FROM (SELECT *, {H('p_lat', 'p_lon', 'lat', 'lon')} AS d FROM (SELECT *, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon FROM {{points_15}} WINDOW w AS (PARTITION BY way_id ORDER BY k))) WHERE d > 0.5", query=False)
add("turns", f"SELECT way_id, k, {geo.turn('p', 'b')} AS t FROM (SELECT *, lag(b) OVER (PARTITION BY way_id ORDER BY k) AS p FROM {{headings}}) WHERE p IS NOT NULL", query=False)
add("y3_curviness", "SELECT t.way_id, round(sum(t.t) / greatest(max(c.total) / 1000.0, 0.000001), 3) AS deg_per_km FROM {turns} t JOIN (SELECT DISTINCT way_id, total FROM {chainage}) c ON c.way_id = t.way_id GROUP BY t.way_id")
add("look", f"SELECT way_id, k, {geo.turn('b1', 'b2')} AS t FROM (SELECT way_id, k, {geo.bearing('lat3', 'lon3', 'lat', 'lon')} AS b1, {geo.bearing('lat', 'lon', 'lat4', 'lon4')} AS b2 FROM (SELECT *, lag(lat, 3) OVER w AS lat3, lag(lon, 3) OVER w AS lon3, lead(lat, 3) OVER w AS lat4, lead(lon, 3) OVER w AS lon4 FROM {{points_45}} WINDOW w AS (PARTITION BY way_id ORDER BY k)) WHERE lat3 IS NOT NULL AND lat4 IS NOT NULL)", query=False)
add("y5_turn_candidates", "SELECT way_id, k, round(t, 3) AS turn FROM {look} WHERE t >= 50.0")
# at most 160 places along a route, one for each 500 m, with the height of the road there
add("spans", "SELECT r.route, r.pos, coalesce(s.dem_elev_m, s.elev_mean) AS e, s.length_m, sum(s.length_m) OVER (PARTITION BY r.route ORDER BY r.pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(s.length_m) OVER (PARTITION BY r.route) AS total FROM {routes} r JOIN {seg} s ON s.seg_id = r.seg_id", query=False)
add("heights", """SELECT p.route, p.j, p.n, s.e FROM (SELECT route, n, j, CASE WHEN j = n - 1 THEN total ELSE total * j / (n - 1) END AS at_m FROM (SELECT *, SERIES(CAST(0 AS BIGINT), n - 1) AS j FROM
(SELECT route, max(total) AS total, least(160, greatest(2, CAST(floor(max(total) / 500.0) AS BIGINT) + 1)) AS n FROM {spans} GROUP BY route))) p JOIN {spans} s ON s.route = p.route AND p.at_m >= s.upto - s.length_m AND (p.at_m < s.upto OR (p.j = p.n - 1 AND s.upto = s.total))""", query=False)
add("smooth_heights", "SELECT route, j, CASE WHEN a IS NULL THEN (e + c) / 2.0 WHEN c IS NULL THEN (e + a) / 2.0 ELSE greatest(least(a, e), least(greatest(a, e), c)) END AS med FROM (SELECT route, j, e, lag(e) OVER w AS a, lead(e) OVER w AS c FROM {heights} WINDOW w AS (PARTITION BY route ORDER BY j))", query=False)
add("y6_elevation_profile", f"SELECT route, {geo.half_even('sum(CASE WHEN d > 2.0 THEN d ELSE 0.0 END)')} AS gain, {geo.half_even('sum(CASE WHEN d < -2.0 THEN -d ELSE 0.0 END)')} AS loss, {geo.half_even('min(med)')} AS lo, {geo.half_even('max(med)')} AS hi, CAST(count(*) AS BIGINT) AS samples FROM (SELECT route, med, med - lag(med) OVER (PARTITION BY route ORDER BY j) AS d FROM {{smooth_heights}}) GROUP BY route",
    oracle="""WITH sizes AS (SELECT route, max(upto) AS total FROM {spans} GROUP BY route),
places AS (SELECT route, total, n, unnest(range(n)) AS j FROM (SELECT *, least(160, greatest(2, floor(total / 500)::BIGINT + 1)) AS n FROM sizes)),
met AS (SELECT p.route, p.j, s.e FROM places p ASOF JOIN (SELECT route, e, upto - length_m AS since FROM {spans}) s ON s.route = p.route AND s.since <= CASE WHEN p.j = p.n - 1 THEN p.total - 0.5 ELSE p.total * p.j / (p.n - 1) END),
mid AS (SELECT route, j, median(e) OVER (PARTITION BY route ORDER BY j ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM met),
d AS (SELECT *, m - lag(m) OVER (PARTITION BY route ORDER BY j) AS d FROM mid)
SELECT route, round_even(coalesce(sum(d) FILTER (d > 2), 0), 0)::BIGINT AS gain, round_even(coalesce(sum(-d) FILTER (d < -2), 0), 0)::BIGINT AS loss, round_even(min(m), 0)::BIGINT AS lo, round_even(max(m), 0)::BIGINT AS hi, count(*) AS samples FROM d GROUP BY route""")
add("y7_stitch", "SELECT route, CAST(row_number() OVER (PARTITION BY route ORDER BY pos, side) AS BIGINT) AS i, lat, lon FROM (SELECT *, lag(lat) OVER (PARTITION BY route ORDER BY pos, side) AS q_lat, lag(lon) OVER (PARTITION BY route ORDER BY pos, side) AS q_lon FROM (SELECT r.route, r.pos, 0 AS side, round(s.a_lat, 7) AS lat, round(s.a_lon, 7) AS lon FROM {routes} r JOIN {seg} s ON s.seg_id = r.seg_id UNION ALL SELECT r.route, r.pos, 1, round(s.b_lat, 7), round(s.b_lon, 7) FROM {routes} r JOIN {seg} s ON s.seg_id = r.seg_id)) WHERE q_lat IS NULL OR q_lat <> lat OR q_lon <> lon")
add("y8_middle_vertex", "SELECT v.way_id, v.node FROM {vertices} v JOIN (SELECT way_id, CAST(floor(count(*) / 2.0) AS BIGINT) + 1 AS mid FROM {vertices} GROUP BY way_id) m ON m.way_id = v.way_id AND m.mid = v.i")
