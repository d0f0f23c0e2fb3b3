"""The road build: ways of map tiles become scored road segments with what the crowd rode on them.

``osm_ways`` (way_id, geometry, name, highway, oneway, tunnel) and ``a2_cell_aggregate`` are its inputs; here both come
from the tables, and ``jobs.build_roads`` gives it those of tiles and telemetry files. Nodes are coordinates, rounded to seven
places; ways are cut where another way has a node, and what is longer than 150 m is cut again every 100 m. A segment keeps
its line as an array, so lengths, resampling and headings are expressions within a row; only node identity, the snap and the
pooling shuffle.
"""

from __future__ import annotations

import re

from wayfold.functions import geo
from wayfold.functions import scores as S
from wayfold.plans.relation import CATALOG

add = CATALOG.add
#: Ways are cut into chunks of so many metres from a length of half as much more on; headings are taken every so many.
CHUNK_M, STEP_M, SNAP_M = 100.0, 15.0, 46.0
#: Nodes and segments of a way are numbered behind its id.
PLACES = 1 << 20

# --- ways from the tables: five lanes that the trips ride along, in bands of 800 m, and streets across them -------------------------
_CLASSES = ["motorway", "secondary", "tertiary", "primary", "unclassified", "trunk", "tertiary", "secondary", "motorway_link", "primary_link", "unclassified"]
add("osm_points", f"""SELECT way_id, i, (476000000 + band * 72000 + i * 9000) / 10000000.0 AS lat, (115000000 + lane * 11000 + block * 200000 + CASE WHEN i = 0 OR i = 8 THEN 0 ELSE ((way_id * 7 + i * 13) % 9 - 4) * 600 END) / 10000000.0 AS lon,
 CASE way_id % 11 {' '.join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CLASSES))} END AS highway, CASE WHEN way_id % 3 = 0 THEN NULL ELSE 'Lane ' || CAST(lane AS STR) || ' of ' || CAST(block AS STR) END AS name, way_id % 13 = 0 AS oneway, way_id % 17 = 0 AS tunnel
FROM (SELECT way_id, way_id % 5 AS lane, CAST(floor(way_id / 5.0) AS BIGINT) % 64 AS band, CAST(floor(way_id / 320.0) AS BIGINT) AS block, SERIES(0, 8) AS i FROM (SELECT DISTINCT CAST(floor(p_partkey / 8.0) AS BIGINT) AS way_id FROM {{part}}))
UNION ALL
SELECT 1000000000 + band * 100000 + block, i, (476000000 + band * 72000) / 10000000.0, (115000000 + i * 11000 + block * 200000) / 10000000.0, 'tertiary', NULL, false, false
FROM (SELECT band, block, SERIES(0, 4) AS i FROM (SELECT DISTINCT CAST(floor(way_id / 5.0) AS BIGINT) % 64 AS band, CAST(floor(way_id / 320.0) AS BIGINT) AS block FROM (SELECT DISTINCT CAST(floor(p_partkey / 8.0) AS BIGINT) AS way_id FROM {{part}})))""", query=False)
add("osm_ways", "SELECT way_id, transform(sort_array(collect_list(named_struct('i', i, 'lat', lat, 'lon', lon))), x -> named_struct('lat', x.lat, 'lon', x.lon)) AS geometry, max(name) AS name, max(highway) AS highway, max(oneway) AS oneway, max(tunnel) AS tunnel FROM {osm_points} GROUP BY way_id", query=False,
    oracle="SELECT way_id, list(struct_pack(lat := lat, lon := lon) ORDER BY i) AS geometry, max(name) AS name, max(highway) AS highway, max(oneway) AS oneway, max(tunnel) AS tunnel FROM {osm_points} GROUP BY way_id")


def _hav(p: str, q: str) -> str:
    return geo.haversine(f"{p}.lat", f"{p}.lon", f"{q}.lat", f"{q}.lon")


def _since(lat: str, lon: str) -> str:
    """For DuckDB, whose least() passes over nulls: metres from the row before in window o."""
    return f"CASE WHEN lag({lat}) OVER o IS NOT NULL THEN {geo.haversine(f'lag({lat}) OVER o', f'lag({lon}) OVER o', lat, lon)} END"


def _along(line: str) -> str:
    """How far each vertex of a line is from its start."""
    return f"aggregate(sequence(1, size({line}) - 1), array(0.0), (acc, j) -> concat(acc, array(acc[size(acc) - 1] + {_hav(f'{line}[j - 1]', f'{line}[j]')})))"


def _at(line: str, cum: str, m: str) -> str:
    """The point of a line at a distance from its start."""
    mix = lambda k: f"{line}[j - 1].{k} + ({line}[j].{k} - {line}[j - 1].{k}) * coalesce(({m} - {cum}[j - 1]) / nullif({cum}[j] - {cum}[j - 1], 0.0), 0.0)"
    return f"transform(array(greatest(1, least(size({line}) - 1, size(filter({cum}, c -> c <= {m}))))), j -> named_struct('lat', {mix('lat')}, 'lon', {mix('lon')}))[0]"


# --- segments: nodes by coordinate, cuts at nodes of several ways, chunks --------------------------------------------------------
add("way_vertices", f"""SELECT way_id, name, highway, oneway, tunnel, n, i, p.lat AS lat, p.lon AS lon, min(way_id * {PLACES} + i) OVER w AS node, CASE WHEN i > 0 AND i < n - 1 AND min(way_id) OVER w <> max(way_id) OVER w THEN 1 ELSE 0 END AS cut
FROM (SELECT way_id, name, highway, oneway, tunnel, size(geometry) AS n, posexplode(geometry) AS (i, p) FROM {{osm_ways}} WHERE size(geometry) > 1) WINDOW w AS (PARTITION BY round(p.lat, 7), round(p.lon, 7))""", query=False)
add("way_pieces", """SELECT way_id, piece, max(name) AS name, max(highway) AS highway, max(oneway) AS oneway, max(tunnel) AS tunnel, min_by(node, i) AS node_a, max_by(node, i) AS node_b, transform(sort_array(collect_list(named_struct('i', i, 'lat', lat, 'lon', lon))), x -> named_struct('lat', x.lat, 'lon', x.lon)) AS line
FROM (SELECT *, explode(CASE WHEN cut = 1 THEN array(upto - 1, upto) ELSE array(upto) END) AS piece FROM (SELECT *, sum(cut) OVER (PARTITION BY way_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM {way_vertices})) GROUP BY way_id, piece HAVING count(*) > 1""", query=False)
add("road_chunks", f"""SELECT *, aggregate(sequence(1, size(line) - 1), 0.0, (acc, j) -> acc + {_hav('line[j - 1]', 'line[j]')}) AS length_m FROM
(SELECT way_id, piece, k, cuts, name, highway, oneway, tunnel, node_a, node_b, concat(array({_at('line', 'cum', 'from_m')}), transform(filter(sequence(0, size(line) - 1), j -> cum[j] > from_m AND cum[j] < to_m), j -> line[j]), array({_at('line', 'cum', 'to_m')})) AS line
 FROM (SELECT *, {CHUNK_M} * k AS from_m, CASE WHEN k = cuts THEN total ELSE {CHUNK_M} * (k + 1) END AS to_m FROM (SELECT *, explode(sequence(CAST(0 AS BIGINT), cuts)) AS k FROM
  (SELECT *, CASE WHEN total > {1.5 * CHUNK_M} THEN CAST(floor(total / {CHUNK_M}) AS BIGINT) ELSE CAST(0 AS BIGINT) END AS cuts FROM (SELECT *, cum[size(cum) - 1] AS total FROM (SELECT *, {_along('line')} AS cum FROM {{way_pieces}})) WHERE total >= 5.0))))""", query=False,
    oracle=f"""WITH v AS (SELECT p.*, max(i) OVER (PARTITION BY way_id) AS last_i, round(lat, 7) AS la, round(lon, 7) AS lo FROM {{osm_points}} p),
nodes AS (SELECT la, lo, min(way_id * {PLACES} + i) AS node, count(DISTINCT way_id) AS ways FROM v GROUP BY la, lo),
marked AS (SELECT v.*, node, (i = 0 OR i = last_i OR ways > 1) AS stop FROM v JOIN nodes USING (la, lo)),
stops AS (SELECT way_id, i AS a, lead(i) OVER (PARTITION BY way_id ORDER BY i) AS b, row_number() OVER (PARTITION BY way_id ORDER BY i) - 1 AS piece FROM marked WHERE stop),
walked AS (SELECT *, sum(coalesce(m, 0)) OVER (PARTITION BY way_id, piece ORDER BY i) AS upto FROM (SELECT s.way_id, s.piece, s.a, s.b, x.i, x.lat, x.lon, x.node, x.name, x.highway, x.oneway, x.tunnel, {_since('x.lat', 'x.lon')} AS m FROM stops s JOIN marked x ON x.way_id = s.way_id AND x.i BETWEEN s.a AND s.b WINDOW o AS (PARTITION BY s.way_id, s.piece ORDER BY x.i))),
sized AS (SELECT *, max(upto) OVER q AS total, CASE WHEN max(upto) OVER q > {1.5 * CHUNK_M} THEN floor(max(upto) OVER q / {CHUNK_M})::BIGINT ELSE 0 END AS cuts, first_value(node) OVER (q ORDER BY i) AS node_a, first_value(node) OVER (q ORDER BY i DESC) AS node_b FROM walked WINDOW q AS (PARTITION BY way_id, piece)),
legs AS (SELECT *, lag(upto) OVER o AS since, lag(lat) OVER o AS p_lat, lag(lon) OVER o AS p_lon FROM sized WHERE total >= 5 WINDOW o AS (PARTITION BY way_id, piece ORDER BY i)),
ends AS (SELECT *, unnest([0, 1]) AS side FROM (SELECT way_id, piece, cuts, total, node_a, node_b, unnest(generate_series(0, cuts)) AS k FROM sized WHERE i = a AND total >= 5)),
placed AS (SELECT e.*, CASE WHEN side = 0 THEN {CHUNK_M} * k WHEN k = cuts THEN total ELSE {CHUNK_M} * (k + 1) END AS pos FROM ends e),
cut_points AS (SELECT p.way_id, p.piece, p.k, p.pos, p.side, l.p_lat + (l.lat - l.p_lat) * (p.pos - l.since) / (l.upto - l.since) AS lat, l.p_lon + (l.lon - l.p_lon) * (p.pos - l.since) / (l.upto - l.since) AS lon FROM placed p ASOF JOIN (SELECT * FROM legs WHERE since IS NOT NULL AND upto > since) l ON l.way_id = p.way_id AND l.piece = p.piece AND l.since <= CASE WHEN p.side = 1 AND p.k = p.cuts THEN p.pos - 0.001 ELSE p.pos END),
points AS (SELECT way_id, piece, k, pos, side * 2 AS side, lat, lon FROM cut_points UNION ALL SELECT way_id, piece, least(floor(upto / {CHUNK_M})::BIGINT, cuts), upto, 1, lat, lon FROM legs WHERE since IS NOT NULL AND upto < total AND (cuts = 0 OR upto % {CHUNK_M} > 0)),
fixed AS (SELECT way_id, piece, CASE WHEN cuts = 0 THEN 0 ELSE k END AS k, pos, side, lat, lon FROM points JOIN (SELECT DISTINCT way_id, piece, cuts FROM sized) USING (way_id, piece)),
measured AS (SELECT *, {_since('lat', 'lon')} AS m FROM fixed WINDOW o AS (PARTITION BY way_id, piece, k ORDER BY pos, side))
SELECT way_id, piece, k, cuts, name, highway, oneway, tunnel, node_a, node_b, line, length_m FROM (SELECT way_id, piece, k, list(struct_pack(lat := lat, lon := lon) ORDER BY pos, side) AS line, sum(m) AS length_m FROM measured GROUP BY ALL) JOIN (SELECT way_id, piece, cuts, name, highway, oneway, tunnel, node_a, node_b FROM sized WHERE i = a) USING (way_id, piece)""")
_bearing = lambda p, q: geo.bearing(f"{p}.lat", f"{p}.lon", f"{q}.lat", f"{q}.lon")
# a chunk's end is a node of its own, numbered below nought; the last chunk of a piece reaches the piece's node
add("road_segments", f"""SELECT seg_id, way_id, name, highway, oneway, tunnel, node_a, CASE WHEN k = cuts THEN node_b ELSE -1 - seg_id END AS node_b, length_m, line, line[0].lat AS a_lat, line[0].lon AS a_lon, line[size(line) - 1].lat AS b_lat, line[size(line) - 1].lon AS b_lon,
 line[CAST(floor(size(line) / 2.0) AS INT)].lat AS mid_lat, line[CAST(floor(size(line) / 2.0) AS INT)].lon AS mid_lon, round({_bearing('line[0]', 'line[size(line) - 1]')}, 1) AS bearing_mean,
 round(CASE WHEN size(line) < 3 OR size(even) < 3 THEN 0.0 ELSE aggregate(sequence(1, size(even) - 2), 0.0, (acc, j) -> acc + {geo.turn(_bearing('even[j - 1]', 'even[j]'), _bearing('even[j]', 'even[j + 1]'))}) / ({STEP_M} * (size(even) - 1) / 1000.0) END, 1) AS curvature_geo
FROM (SELECT *, transform(sequence(0, CAST(floor(cum[size(cum) - 1] / {STEP_M}) AS INT)), s -> {_at('line', 'cum', f's * {STEP_M}')}) AS even FROM (SELECT *, way_id * {PLACES} + row_number() OVER (PARTITION BY way_id ORDER BY piece, k) - 1 AS seg_id,
 CASE WHEN k = 0 THEN node_a0 ELSE -1 - (way_id * {PLACES} + row_number() OVER (PARTITION BY way_id ORDER BY piece, k) - 2) END AS node_a, {_along('line')} AS cum FROM (SELECT c.* EXCEPT (node_a), c.node_a AS node_a0 FROM {{road_chunks}} c WHERE length_m >= 1.0)))""", query=False,
    oracle=f"""WITH kept AS (SELECT *, way_id * {PLACES} + row_number() OVER (PARTITION BY way_id ORDER BY piece, k) - 1 AS seg_id FROM {{road_chunks}} WHERE length_m >= 1),
p AS (SELECT seg_id, length_m, unnest(line) AS p, generate_subscripts(line, 1) AS j FROM kept),
l AS (SELECT seg_id, j, p.lat AS lat, p.lon AS lon, lag(p.lat) OVER o AS p_lat, lag(p.lon) OVER o AS p_lon, {_since('p.lat', 'p.lon')} AS m FROM p WINDOW o AS (PARTITION BY seg_id ORDER BY j)),
c AS (SELECT *, sum(m) OVER (PARTITION BY seg_id ORDER BY j) - m AS since FROM l WHERE m > 0),
marks AS (SELECT seg_id, unnest(generate_series(0, floor(total / {STEP_M})::BIGINT)) AS s FROM (SELECT seg_id, sum(m) AS total FROM c GROUP BY seg_id)),
even AS (SELECT m.seg_id, m.s, c.p_lat + (c.lat - c.p_lat) * (m.s * {STEP_M} - c.since) / c.m AS lat, c.p_lon + (c.lon - c.p_lon) * (m.s * {STEP_M} - c.since) / c.m AS lon FROM marks m ASOF JOIN c ON c.seg_id = m.seg_id AND c.since <= m.s * {STEP_M}),
heads AS (SELECT seg_id, s, {geo.bearing('lag(lat) OVER o', 'lag(lon) OVER o', 'lat', 'lon')} AS h FROM even WINDOW o AS (PARTITION BY seg_id ORDER BY s)),
turned AS (SELECT seg_id, sum(d) / ({STEP_M} * max(s) / 1000) AS curvature FROM (SELECT seg_id, s, least(abs(h - g) % 360, 360 - abs(h - g) % 360) AS d FROM (SELECT *, lag(h) OVER (PARTITION BY seg_id ORDER BY s) AS g FROM heads WHERE s > 0)) GROUP BY seg_id)
SELECT k.seg_id, k.way_id, k.name, k.highway, k.oneway, k.tunnel, CASE WHEN k.k = 0 THEN k.node_a ELSE -k.seg_id END AS node_a, CASE WHEN k.k = k.cuts THEN k.node_b ELSE -1 - k.seg_id END AS node_b, k.length_m, k.line, line[1].lat AS a_lat, line[1].lon AS a_lon, line[-1].lat AS b_lat, line[-1].lon AS b_lon,
 line[len(line) // 2 + 1].lat AS mid_lat, line[len(line) // 2 + 1].lon AS mid_lon, round({geo.bearing('line[1].lat', 'line[1].lon', 'line[-1].lat', 'line[-1].lon')}, 1) AS bearing_mean, round(CASE WHEN len(line) < 3 THEN 0 ELSE coalesce(curvature, 0) END, 1) AS curvature_geo FROM kept k LEFT JOIN turned USING (seg_id)""")
add("s12_road_segments", "SELECT seg_id, way_id, node_a, node_b, highway, name, round(length_m, 3) AS length_m, round(a_lat, 7) AS a_lat, round(b_lon, 7) AS b_lon, round(mid_lat, 7) AS mid_lat, bearing_mean, curvature_geo FROM {road_segments}")

# --- the crowd: cells meet the legs whose surroundings lie in their bucket; a leg is listed in one to four of them --------------------
_LEVEL = 1 << 16
_bx, _by = (lambda x: f"CAST(floor(({x} + 180.0) / 360.0 * {_LEVEL}) AS BIGINT)"), (lambda y: f"CAST(floor(({y} + 90.0) / 360.0 * {_LEVEL}) AS BIGINT)")
_reach = f"{SNAP_M} / ({geo.DEG_M} * greatest(0.01, cos(radians(p.lat))))"
add("road_legs", f"""SELECT seg_id, k, p, q, bx, explode(sequence(least({_by(f'p.lat - {SNAP_M} / {geo.DEG_M}')}, {_by(f'q.lat - {SNAP_M} / {geo.DEG_M}')}), greatest({_by(f'p.lat + {SNAP_M} / {geo.DEG_M}')}, {_by(f'q.lat + {SNAP_M} / {geo.DEG_M}')}))) AS by_ FROM
(SELECT *, explode(sequence(least({_bx(f'p.lon - {_reach}')}, {_bx(f'q.lon - {_reach}')}), greatest({_bx(f'p.lon + {_reach}')}, {_bx(f'q.lon + {_reach}')}))) AS bx FROM
 (SELECT seg_id, j AS k, line[j - 1] AS p, line[j] AS q FROM (SELECT seg_id, line, explode(sequence(1, size(line) - 1)) AS j FROM {{road_segments}})))""", query=False)
_fits = f"(c.hdg IS NULL OR {geo.undirected('c.hdg', geo.bearing('l.p.lat', 'l.p.lon', 'l.q.lat', 'l.q.lon'))} <= 55.0)"
_far = geo.piece_distance("c.lat", "c.lon", "l.p.lat", "l.p.lon", "l.q.lat", "l.q.lon")
add("road_snapped", f"""SELECT cell, best.seg_id AS seg_id, best.d AS d FROM (SELECT cell, min(named_struct('d', d, 'seg_id', seg_id, 'k', k)) AS best FROM
(SELECT c.cell, l.seg_id, l.k, round({_far}, 6) AS d FROM {{a2_cell_aggregate}} c JOIN {{road_legs}} l ON l.bx = {_bx('c.lon')} AND l.by_ = {_by('c.lat')} WHERE {_fits}) WHERE d < {SNAP_M} GROUP BY cell)""", query=False,
    oracle=f"""WITH l AS (SELECT seg_id, j AS k, line[j] AS p, line[j + 1] AS q FROM (SELECT seg_id, line, unnest(generate_series(1, len(line) - 1)) AS j FROM {{road_segments}})),
met AS (SELECT c.cell, l.seg_id, l.k, round({_far}, 6) AS d FROM {{a2_cell_aggregate}} c JOIN l ON abs(l.p.lat - c.lat) < 0.003 WHERE {_fits})
SELECT cell, seg_id, d FROM met WHERE d < {SNAP_M} QUALIFY row_number() OVER (PARTITION BY cell ORDER BY d, seg_id, k) = 1""")
SUMS, MEANS = ("path_m", "lean_delta", "leaned_m", "abs_events", "hard_decel", "n_points"), ("lean_p95", "speed_mean", "speed_p85", "band_share", "crawl_share", "rpm_mean", "elev_mean")
_mean = lambda x: f"coalesce(sum(c.{x} * c.n_points) / nullif(sum(CASE WHEN c.{x} IS NOT NULL THEN c.n_points END), 0), 0.0)"
add("road_pool", f"SELECT s.seg_id, {', '.join(f'sum(c.{x}) * 1.0 AS {x}' for x in SUMS)}, CAST(max(c.n_trips) AS BIGINT) AS n_trips, {', '.join(f'{_mean(x)} AS {x}' for x in MEANS)} FROM {{road_snapped}} s JOIN {{a2_cell_aggregate}} c ON c.cell = s.cell GROUP BY s.seg_id", query=False)
add("road_rates", f"""SELECT s.seg_id, {', '.join(f'coalesce(p.{x}, 0.0) AS {x}' for x in (*SUMS, *MEANS))}, coalesce(p.n_trips, 0) AS n_trips, CASE WHEN p.seg_id IS NULL THEN s.curvature_geo ELSE p.lean_delta / greatest(p.path_m / 1000.0, 0.000001) END AS curviness,
 coalesce(p.leaned_m / nullif(p.path_m, 0.0), 0.0) AS leaned_share, coalesce(p.abs_events / greatest(p.path_m / 1000.0, 0.000001), 0.0) AS abs_rate, coalesce(p.hard_decel / greatest(p.path_m / 1000.0, 0.000001), 0.0) AS hard_decel_rate
FROM {{road_segments}} s LEFT JOIN {{road_pool}} p ON p.seg_id = s.seg_id""", query=False,
    oracle=f"""WITH c AS (SELECT * FROM {{road_snapped}} JOIN {{a2_cell_aggregate}} USING (cell)),
w AS (SELECT seg_id, max(n_trips) AS n_trips, {', '.join(f'sum({x})::DOUBLE AS {x}' for x in SUMS)}, {', '.join(f'sum({x} * n_points) FILTER ({x} IS NOT NULL) / sum(n_points) FILTER ({x} IS NOT NULL) AS {x}' for x in MEANS)} FROM c GROUP BY seg_id)
SELECT s.seg_id, {', '.join(f'coalesce({x}, 0) AS {x}' for x in (*SUMS, *MEANS))}, coalesce(n_trips, 0) AS n_trips, CASE WHEN w.seg_id IS NULL THEN curvature_geo ELSE 1000 * lean_delta / greatest(path_m, 0.001) END AS curviness, CASE WHEN path_m > 0 THEN leaned_m / path_m ELSE 0 END AS leaned_share,
 coalesce(1000 * abs_events / greatest(path_m, 0.001), 0) AS abs_rate, coalesce(1000 * hard_decel / greatest(path_m, 0.001), 0) AS hard_decel_rate FROM {{road_segments}} s LEFT JOIN w USING (seg_id)""")
add("s12_road_crowd", "SELECT seg_id, CAST(n_points AS BIGINT) AS n_points, n_trips, round(path_m, 3) AS path_m, round(lean_delta, 3) AS lean_delta, round(curviness, 4) AS curviness, round(leaned_share, 5) AS leaned_share, round(abs_rate, 4) AS abs_rate, round(hard_decel_rate, 4) AS hard_decel_rate, round(lean_p95, 4) AS lean_p95, round(speed_mean, 4) AS speed_mean, round(elev_mean, 3) AS elev_mean FROM {road_rates}")

# --- terrain at both ends and around the middle vertex ------------------------------------------------------------------------------
_rc = (geo.half_even("(48.60 - lat) / 0.01"), geo.half_even("(lon - 11.25) / 0.01"))
_probes = "SELECT seg_id, 0 AS k, a_lat AS lat, a_lon AS lon FROM {road_segments} UNION ALL SELECT seg_id, 1, b_lat, b_lon FROM {road_segments} UNION ALL SELECT s.seg_id, o.k, s.mid_lat + o.dla, s.mid_lon + o.dlo FROM {road_segments} s CROSS JOIN (VALUES (2, 0.0, 0.0), (3, 0.018, 0.0), (4, -0.018, 0.0), (5, 0.0, 0.027), (6, 0.0, -0.027)) AS o(k, dla, dlo)"
add("road_terrain", f"""SELECT p.seg_id, max(CASE WHEN p.k = 0 THEN t.elev END) AS e0, max(CASE WHEN p.k = 1 THEN t.elev END) AS e1, CASE WHEN count(CASE WHEN p.k >= 2 THEN t.elev END) > 2 THEN max(CASE WHEN p.k >= 2 THEN t.elev END) - min(CASE WHEN p.k >= 2 THEN t.elev END) END AS relief
FROM (SELECT seg_id, k, {_rc[0]} AS r, {_rc[1]} AS c FROM ({_probes})) p JOIN (SELECT * FROM {{raster}} WHERE elev BETWEEN -1000 AND 9000) t ON t.r = p.r AND t.c = p.c GROUP BY p.seg_id""", query=False)
add("road_seg", f"""SELECT s.seg_id, s.way_id, s.node_a, s.node_b, s.name, s.highway, s.oneway, s.tunnel, s.length_m, s.a_lat, s.a_lon, s.b_lat, s.b_lon, s.mid_lat, s.mid_lon, s.bearing_mean, s.curvature_geo, {', '.join(f'r.{x}' for x in ('n_trips', 'curviness', 'leaned_share', 'band_share', 'crawl_share', 'abs_rate', 'hard_decel_rate', 'rpm_mean', 'speed_mean', 'lean_p95', 'elev_mean', 'n_points', 'path_m'))},
 round((t.e0 + t.e1) / 2.0, 1) AS dem_elev_m, round(100.0 * (t.e1 - t.e0) / greatest(s.length_m, 1.0), 2) AS dem_gradient_pct, round(t.relief, 1) AS dem_relief_m, CAST(NULL AS DOUBLE) AS forest_share, CAST(NULL AS DOUBLE) AS water_prox, CAST(NULL AS DOUBLE) AS viewpoint
FROM {{road_segments}} s JOIN {{road_rates}} r ON r.seg_id = s.seg_id LEFT JOIN {{road_terrain}} t ON t.seg_id = s.seg_id""", query=False)
CATALOG.share("road_seg")


def rebased(names: list[str], **other: str) -> None:
    """Relations again over other inputs, named ``road_...``."""
    own = {n: f"road_{n}" for n in names} | other
    for n in names:
        add(own[n], re.sub(r"\{(\w+)\}", lambda m: "{" + own.get(m[1], m[1]) + "}", CATALOG.relations[n].sql), query=False)


# --- scores and costs read the built segments; a segment's cell is that of its middle vertex ------------------------------------------
rebased(["feature_values", "feature_counts", "feature_bounds", "feature_ranges", "feature_since", "feature_ranks", "percentiles", "wide_percentiles", "road_lengths", "road_runs", "scored"], seg="road_seg")
add("s12_road_scores", "SELECT seg_id, round(scenic, 6) AS scenic, round(fun, 6) AS fun, round(twist, 6) AS twist, round(traffic, 6) AS traffic, round(risk, 6) AS risk, round(seconds, 4) AS seconds, round(cost_15, 4) AS cost_15 FROM {road_scored}")
add("road_seg_cells", f"SELECT s.seg_id, c.code, c.value, CASE WHEN c.code IS NULL THEN 0.1 ELSE {S.cell_risk()} END AS risk, coalesce(c.lean_p95 - 25.0 > {S.LEAN_MARGIN}, false) AS excluded, c.lean_p95 AS cell_lean, c.lean_p50, c.elev_m FROM (SELECT seg_id, {geo.packed('mid_lat', 'mid_lon')} AS cell FROM {{road_seg}}) s LEFT JOIN {{cell_scores}} c ON c.code = s.cell", query=False)
add("j3_segment_cells", "SELECT seg_id, code FROM {road_seg_cells}", oracle=f"SELECT s.seg_id, c.code FROM (SELECT seg_id, floor((mid_lat + 90) / 360 * 262144)::BIGINT AS y, floor((mid_lon + 180) / 360 * 262144)::BIGINT AS x FROM {{road_segments}}) s LEFT JOIN {{cells}} c ON c.code = s.y * 262144 + s.x")
add("a28_coverage", "SELECT round(avg(CASE WHEN code IS NULL THEN 0.0 ELSE 1.0 END), 6) AS covered, CAST(count(code) AS BIGINT) AS n FROM {road_seg_cells}")
add("road_node", "SELECT node, max(lat) AS lat, max(lon) AS lon FROM (SELECT node_a AS node, a_lat AS lat, a_lon AS lon FROM {road_seg} UNION ALL SELECT node_b, b_lat, b_lon FROM {road_seg}) GROUP BY node", query=False)
rebased(["degree"], seg="road_seg")
rebased(["junction_density", "urban_top_counts", "urban_top_range", "urban_top", "urban", "roads"], node="road_node", degree="road_degree", seg="road_seg", road_runs="road_road_runs", seg_cells="road_seg_cells")
add("s12_road_costs", "SELECT seg_id, code, round(value, 6) AS value, round(seconds, 4) AS seconds, round(cost, 4) AS cost, round(cost_fast, 4) AS cost_fast FROM {road_roads}")
