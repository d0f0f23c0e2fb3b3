"""Scores and costs of road segments (the segment planner's generation)."""

from __future__ import annotations

from wayfold.functions import scores as S
from wayfold.operators.crowd import global_pick, ranked
from wayfold.plans.ranks import RANGES, ranked_rows
from wayfold.plans.relation import CATALOG

add = CATALOG.add

# --- percentiles against the network, for all features at once: counts of distinct values, summed up by feature ----------
FEATURES = ["curviness", "curvature_geo", "elev_mean", "dem_elev_m", "dem_relief_m", "band_share", "leaned_share", "abs_rate", "rpm_mean", "speed_mean", "forest_share", "water_prox"]
_long = " UNION ALL ".join(f"SELECT seg_id, '{f}' AS feature, {f} AS v, 1 AS n FROM {{seg}} WHERE {f} IS NOT NULL" for f in FEATURES)
add("feature_values", f"{_long} UNION ALL SELECT seg_id, 'gradient' AS feature, dem_gradient_pct AS v, 1 AS n FROM {{seg}} WHERE dem_gradient_pct IS NOT NULL UNION ALL SELECT seg_id, 'gradient', abs(coalesce(dem_gradient_pct, 0.0)), 0 FROM {{seg}}", query=False)
# ranges of equal width, and running sums over the ranges and within each
add("feature_counts", "SELECT feature, v, CAST(sum(n) AS DOUBLE) AS n FROM {feature_values} GROUP BY feature, v", query=False)
add("feature_bounds", "SELECT feature, min(v) AS lo, max(v) AS hi FROM {feature_values} GROUP BY feature", query=False)
add("feature_ranges", f"SELECT c.feature, c.v, c.n, CAST(floor(coalesce((c.v - b.lo) / nullif(b.hi - b.lo, 0.0), 0.0) * {RANGES}.0) AS BIGINT) AS b FROM {{feature_counts}} c JOIN {{feature_bounds}} b ON b.feature = c.feature", query=False)
add("feature_since", "SELECT feature, b, sum(n) OVER (PARTITION BY feature ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS since, sum(n) OVER (PARTITION BY feature) AS total FROM (SELECT feature, b, sum(n) AS n FROM {feature_ranges} GROUP BY feature, b)", query=False)
add("feature_ranks", "SELECT r.feature, r.v, (w.since + sum(r.n) OVER (PARTITION BY r.feature, r.b ORDER BY r.v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - r.n) / nullif(w.total, 0.0) AS p FROM {feature_ranges} r JOIN {feature_since} w ON w.feature = r.feature AND w.b = r.b", query=False,
    oracle="""SELECT feature, v, (sum(n) OVER (PARTITION BY feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n) / nullif(sum(n) OVER (PARTITION BY feature), 0) AS p
FROM (SELECT feature, v, CAST(sum(n) AS DOUBLE) AS n FROM {feature_values} GROUP BY feature, v)""")
add("percentiles", "SELECT x.seg_id, x.feature, CASE WHEN x.v = 0 THEN 0.0 ELSE r.p END AS p FROM {feature_values} x JOIN {feature_ranks} r ON r.feature = x.feature AND r.v = x.v WHERE x.feature <> 'gradient' OR x.n = 0", query=False)
add("f3_percentile_scaler", "SELECT seg_id, feature, round(p, 9) AS p FROM {percentiles} WHERE feature <> 'gradient'")
add("f8_gradient_percentile", "SELECT seg_id, round(p, 9) AS p FROM {percentiles} WHERE feature = 'gradient'")
_names = {"curviness": "curv_p", "curvature_geo": "geo_p", "elev_mean": "gps_p", "dem_elev_m": "dem_p", "dem_relief_m": "relief_p", "band_share": "band_p", "leaned_share": "leaned_p", "abs_rate": "abs_p", "forest_share": "forest_p", "water_prox": "water_p", "gradient": "gradient_p"}
add("wide_percentiles", "SELECT seg_id, " + ", ".join(f"coalesce(max(CASE WHEN feature = '{f}' THEN p END), 0.0) AS {n}" for f, n in _names.items()) + " FROM {percentiles} GROUP BY seg_id", query=False)
_road = "CASE WHEN name IS NOT NULL THEN 'name ' || name || ' ' || highway ELSE 'way ' || CAST(way_id AS STR) END"
add("road_lengths", f"SELECT {_road} AS road, sum(length_m) / 1000.0 AS km FROM {{seg}} GROUP BY {_road}", query=False)
add("road_runs", f"SELECT s.seg_id, l.km AS road_run_km FROM (SELECT seg_id, {_road} AS road FROM {{seg}}) s JOIN {{road_lengths}} l ON l.road = s.road", query=False, oracle="SELECT seg_id, sum(length_m) OVER (PARTITION BY CASE WHEN name IS NOT NULL THEN 'name ' || name || ' ' || highway ELSE 'way ' || CAST(way_id AS STR) END) / 1000.0 AS road_run_km FROM {seg}")
add("a15_road_runs", "SELECT seg_id, round(road_run_km, 3) AS road_run_km FROM {road_runs}")
add("degree", "SELECT node, count(*) AS degree FROM (SELECT node_a AS node FROM {seg} UNION ALL SELECT node_b FROM {seg}) GROUP BY node", query=False)
add("scored", f"""SELECT *, {S.seg_cost(3.0, 1.0, 2.5, 2.0)} AS cost_avoid, {S.seg_cost(0.0)} AS cost_0, {S.seg_cost(1.5)} AS cost_15, {S.seg_cost(3.0)} AS cost_3 FROM
(SELECT *, {S.seg_scenic()} AS scenic, {S.seg_fun()} AS fun, {S.seg_twist()} AS twist, {S.seg_traffic()} AS traffic, {S.seg_risk()} AS risk, {S.seg_seconds()} AS seconds FROM
 (SELECT s.*, p.curv_p, p.geo_p, CASE WHEN s.dem_elev_m IS NOT NULL THEN p.dem_p ELSE p.gps_p END AS elev_p, p.relief_p, p.band_p, p.leaned_p, p.abs_p, p.forest_p, p.water_p, p.gradient_p,
         {S.seg_blend('s.n_trips', 'p.curv_p', 'p.geo_p')} AS blend, {S.lookup('s.highway', S.CLASS_SCENIC, 0.5)} AS class_scenic, {S.lookup('s.highway', S.SEG_SPEED, 50.0)} AS speed_assumed, r.road_run_km
  FROM {{seg}} s JOIN {{wide_percentiles}} p ON p.seg_id = s.seg_id JOIN {{road_runs}} r ON r.seg_id = s.seg_id))""", query=False)


def show(name: str, *columns: str) -> None:
    add(name, "SELECT seg_id, " + ", ".join(f"round({c.split(' AS ')[0]}, 6) AS {c.split(' AS ')[-1]}" for c in columns) + " FROM {scored}")


show("f1_segment_confidence", f"{S.confidence('n_trips', 5.0)} AS confidence")
show("f4_blended_curviness", "blend")
show("f5_scenic", "scenic")
show("f6_twist", "twist")
show("f7_traffic_pressure", "traffic")
show("f9_rpm_sweet_spot", f"{S.rpm_sweet_spot('rpm_mean')} AS sweet_spot")
show("f10_fun", "fun")
show("f11_personal", f"{S.clamp('0.6 * scenic + 0.4 * fun')} AS personal")
show("f12_risk", "risk", f"{S.seg_risk('0.2')} AS risk_wet")
show("f15_travel_seconds", "seconds")
show("f16_edge_cost", "cost_0", "cost_15", "cost_3", "cost_avoid")
show("f17_long_straight", f"{S.seg_straight()} AS long_straight")
show("f44_class_lookups", "class_scenic", "speed_assumed", f"{S.lookup('highway', S.ROAD_SPEED, 45.0)} AS road_speed", f"{S.lookup('highway', S.HIGHWAY_AVOIDANCE, 0.0)} AS avoidance", f"{S.lookup('highway', S.TRAFFIC_PRIOR, 0.12)} AS traffic_prior", f"{S.lookup('highway', S.OUTER_HIGHWAY, 1.0)} AS outer_cost")
global_pick("curviness_p70", "seg", "coalesce(curviness, 0.0)", "seg_id", ranked(0.70, "n", False), "p70")
add("f14_curviness_p70", "SELECT p70 FROM {curviness_p70}")
add("f13_capability_exclusion", f"SELECT seg_id, {S.seg_excluded(30.0, 0.9, 1.15)} AS excluded, {S.nz('curviness')} > p70 AS excluded_novice FROM {{seg}} CROSS JOIN {{curviness_p70}}")
add("a34_excluded_count", "SELECT CAST(sum(CASE WHEN excluded THEN 1 ELSE 0 END) AS BIGINT) AS excluded, CAST(sum(CASE WHEN excluded_novice THEN 1 ELSE 0 END) AS BIGINT) AS excluded_novice FROM {f13_capability_exclusion}")
# the first node is the origin of the request, where nothing turns
add("f33_junction_cost", f"SELECT node, CASE WHEN node = (SELECT min(node) FROM {{degree}}) THEN 0.0 ELSE {S.junction_seconds('degree')} END AS seconds FROM {{degree}}")
add("f2_cell_confidence", f"SELECT code, round({S.confidence('n_trips', 3.0)}, 6) AS confidence FROM {{cells}}")
add("l1_top_scenic", "SELECT seg_id, round(scenic, 6) AS scenic FROM {scored} ORDER BY round(scenic, 6) DESC, seg_id LIMIT 50")
add("l2_coverage_sample", "SELECT seg_id, n_trips FROM (SELECT seg_id, n_trips, row_number() OVER (ORDER BY n_trips DESC, seg_id) AS r FROM (SELECT seg_id, n_trips FROM {seg} WHERE n_trips > 0 ORDER BY n_trips DESC, seg_id LIMIT 700)) WHERE (r - 1) % 7 = 0",
    oracle="SELECT seg_id, n_trips FROM (SELECT seg_id, n_trips, row_number() OVER (ORDER BY n_trips DESC, seg_id) AS r FROM {seg} WHERE n_trips > 0) WHERE (r - 1) % 7 = 0 ORDER BY r LIMIT 100")
add("l10_first_by_key", "SELECT name, way_id, seg_id FROM (SELECT *, row_number() OVER (PARTITION BY name, way_id ORDER BY seg_id) AS r FROM {seg} WHERE name IS NOT NULL) WHERE r = 1")

# --- the cell planner ----------------------------------------------------------------------------------------------------
LEAN = 25.0
for _k, _n in (("abs_rate", "p95_brake"), ("decel_rate", "p95_decel")):
    global_pick(_n, "cells", _k, "code", ranked(0.95, "n", False), _n, 200.0)
_moments = ", ".join(f"avg({k}) AS {k}_mu, stddev_samp({k}) AS {k}_sd" for k in ("lean_p50", "speed_med", "elev_m", "throttle"))
add("cell_norms", f"SELECT m.*, greatest(b.p95_brake, 0.001) AS p95_brake, greatest(d.p95_decel, 0.001) AS p95_decel FROM (SELECT {_moments} FROM {{cells}}) m CROSS JOIN {{p95_brake}} b CROSS JOIN {{p95_decel}} d", query=False)
_z = lambda k: S.z(k, f"{k}_mu", f"{k}_sd")
add("ridden", f"SELECT DISTINCT code FROM {{cell_samples}} WHERE trip % 3 = 0", query=False)
add("cell_codes", "SELECT code, CAST(floor(floor(code / 262144.0) / 16.0) AS BIGINT) * 16384 + CAST(floor((code % 262144) / 16.0) AS BIGINT) AS coarse FROM {cells}", query=False)
add("visited_coarse", "SELECT DISTINCT coarse FROM {cell_codes} k JOIN {ridden} r ON r.code = k.code WHERE r.code % 2 = 0", query=False)
W = (0.4, 0.35, 0.25)
add("cell_scores", f"""SELECT *, {S.cell_value(W, LEAN)} AS value FROM
(SELECT c.*, m.p95_brake, m.p95_decel, CASE WHEN v.coarse IS NULL THEN 1.0 ELSE 0.0 END AS fresh, {S.squash(f"0.7 * {_z('lean_p50')} + 0.3 * {_z('throttle')}")} AS fun, {S.squash(f"0.6 * {_z('elev_m')} - 0.4 * {_z('speed_med')}")} AS scenic
 FROM {{cells}} c JOIN {{cell_codes}} k ON k.code = c.code LEFT JOIN {{visited_coarse}} v ON v.coarse = k.coarse CROSS JOIN {{cell_norms}} m)""", query=False)
add("f18_squash", f"SELECT code, round({S.squash('lean_p50 / 10.0 - 1.0')}, 6) AS squashed FROM {{cells}}")
add("f19_cell_z", "SELECT code, " + ", ".join(f"round({_z(k)}, 6) AS z_{k}" for k in ("lean_p50", "speed_med", "elev_m", "throttle")) + " FROM {cells} CROSS JOIN {cell_norms}")
add("f20_cell_fun_scenic", "SELECT code, round(fun, 6) AS fun, round(scenic, 6) AS scenic FROM {cell_scores}")
add("f21_cell_value", "SELECT code, round(value, 6) AS value FROM {cell_scores}")
add("f22_growth", f"SELECT code, 0.5 * CASE WHEN lean_p50 BETWEEN {LEAN * 0.85} AND {LEAN} THEN 1.0 ELSE 0.0 END + 0.5 * fresh AS growth FROM {{cell_scores}}")
add("f23_cell_risk", f"SELECT code, round({S.cell_risk()}, 6) AS risk, round({S.cell_risk('0.5')}, 6) AS risk_wet FROM {{cell_scores}}")
add("f24_cell_exclusion", f"SELECT code, lean_p95 - {LEAN} > {S.LEAN_MARGIN} AS excluded FROM {{cells}}")
# both ways over each edge, at the value of the cell that is entered
add("cell_arcs", f"SELECT e.a, e.b, e.len_m, {S.cell_seconds('e.len_m', 'e.v_kmh', 'r.region')} AS seconds, c.value, {S.cell_risk()} AS risk, c.lean_p95 AS cell_lean, x.lat AS lat_a, x.lon AS lon_a, c.lat AS lat_b, c.lon AS lon_b FROM (SELECT a, b, max(len_m) AS len_m, max(v_kmh) AS v_kmh FROM (SELECT a, b, len_m, v_kmh FROM {{edges}} UNION ALL SELECT b, a, len_m, v_kmh FROM {{edges}}) WHERE a <> b GROUP BY a, b) e JOIN {{cell_scores}} c ON c.code = e.b JOIN (SELECT code, lat, lon FROM {{cells}}) x ON x.code = e.a CROSS JOIN {{region_speed}} r", query=False)
add("cell_costs", f"SELECT e.a, e.b, e.len_m, {S.cell_seconds('e.len_m', 'e.v_kmh', 'r.region')} AS seconds, c.value, {S.cell_risk()} AS risk, c.lean_p95 - {LEAN} > {S.LEAN_MARGIN} AS excluded FROM {{edges}} e JOIN {{cell_scores}} c ON c.code = e.b CROSS JOIN {{region_speed}} r", query=False)
add("f25_cell_edge_cost", "SELECT a, b, round(seconds, 4) AS seconds, round(seconds * (1.0 + 1.5 * (1.0 - value) + risk), 4) AS cost FROM {cell_costs}")
add("f50_clip_weights", "SELECT feature, round(CASE WHEN sum(raw) OVER () = 0 THEN 1.0 / 3.0 ELSE raw / sum(raw) OVER () END, 6) AS w FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS feature, greatest(0.0, avg({_z(k)})) AS raw FROM {{cells}} c JOIN {{ridden}} r ON r.code = c.code CROSS JOIN {{cell_norms}}" for k in ("lean_p50", "elev_m", "throttle")) + ")")
add("q4_rider_weights", "SELECT feature, w FROM {f50_clip_weights}")

# --- the cell planner drawn on roads ---------------------------------------------------------------------------------------
_gy, _gx = "CAST(floor(lat / 0.018) AS BIGINT)", "CAST(floor(lon / 0.027) AS BIGINT)"
add("junction_density", f"SELECT {_gy} AS gy, {_gx} AS gx, count(*) AS n FROM {{node}} x JOIN {{degree}} d ON d.node = x.node WHERE degree >= 3 GROUP BY {_gy}, {_gx}", query=False)
global_pick("urban_top", "junction_density", "n", "gy * 100000 + gx", ranked(0.95, "n", False), "top")
add("urban", "SELECT gy, gx, least(1.0, n * 1.0 / greatest(top, 1)) AS urban FROM {junction_density} CROSS JOIN {urban_top}", query=False)
add("a17_urbanness", "SELECT gy, gx, round(urban, 6) AS urban FROM {urban}")
add("seg_cells", f"SELECT s.seg_id, c.code, c.value, CASE WHEN c.code IS NULL THEN 0.1 ELSE {S.cell_risk()} END AS risk, coalesce(c.lean_p95 - {LEAN} > {S.LEAN_MARGIN}, false) AS excluded, c.lean_p95 AS cell_lean, c.lean_p50, c.elev_m FROM (SELECT seg_id, CAST(floor((a_lat + 90.0) / 360.0 * 262144) AS BIGINT) * 262144 + CAST(floor((11.5 + (seg_id % 7) * 0.0006 + 180.0) / 360.0 * 262144) AS BIGINT) AS cell FROM {{seg}}) s LEFT JOIN {{cell_scores}} c ON c.code = s.cell", query=False)
# a rider keeps its own pace: base times over 66 km/h by its mean speed; without telemetry the base time holds
add("rider_pace", "SELECT CASE WHEN speed_mean > 0 THEN 66.0 / greatest(speed_mean, 1.0) ELSE 1.0 END AS pace FROM {a5_rider_quantiles}", query=False)
add("roads", f"""SELECT *, seconds * (1.0 + 3.0 * (1.0 - urban) * (1.0 - value) + risk) * highway_factor * straight_factor * style_factor AS cost, seconds * (1.0 + risk) * highway_factor * straight_factor * style_factor AS cost_fast FROM
(SELECT s.*, r.road_run_km, s.length_m / 1000.0 / greatest({S.lookup('s.highway', S.ROAD_SPEED, 45.0)}, 3.0) * 3600.0 * k.pace AS seconds, coalesce(c.value, 0.5) AS value, c.risk, c.excluded, c.cell_lean, c.code, c.lean_p50, c.elev_m, coalesce(u.urban, 0.0) AS urban,
        {S.road_highway_factor()} AS highway_factor, {S.road_straight_factor()} AS straight_factor, {S.road_style_factor("'A'")} AS style_factor
 FROM {{seg}} s JOIN {{road_runs}} r ON r.seg_id = s.seg_id JOIN {{seg_cells}} c ON c.seg_id = s.seg_id CROSS JOIN {{rider_pace}} k
 LEFT JOIN {{urban}} u ON u.gy = CAST(floor(s.mid_lat / 0.018) AS BIGINT) AND u.gx = CAST(floor(s.mid_lon / 0.027) AS BIGINT))""", query=False)


def road(name: str, *columns: str) -> None:
    add(name, "SELECT seg_id, " + ", ".join(f"round({c.split(' AS ')[0]}, 6) AS {c.split(' AS ')[-1]}" for c in columns) + " FROM {roads}")


road("f26_road_seconds", "seconds")
add("f26_rider_pace", "SELECT r.seg_id, round(r.seconds / k.pace, 6) AS base, round(r.seconds, 6) AS paced FROM {roads} r CROSS JOIN {rider_pace} k",
    oracle=f"WITH v AS (SELECT avg(nullif(speed, 0)) AS kmh FROM {{steps}} WHERE trip % 3 = 0) SELECT seg_id, round(b, 6) AS base, round(CASE WHEN kmh > 0 THEN b * 66 / greatest(round(kmh, 6), 1) ELSE b END, 6) AS paced FROM (SELECT seg_id, length_m / 1000 / greatest({S.lookup('highway', S.ROAD_SPEED, 45.0)}, 3) * 3600 AS b FROM {{seg}}), v")
road("f27_road_value_risk", "value", "risk")
road("f28_alpha_fade", "3.0 * (1.0 - urban) AS alpha")
road("f29_highway_factor", "highway_factor")
road("f30_straight_factor", "straight_factor")
road("f31_style_factor", "style_factor")
add("f32_road_edge_cost", "SELECT seg_id, round(cost, 4) AS cost, round(cost_fast, 4) AS cost_fast FROM {roads}")

# --- routes: the first roads of a way, in order ------------------------------------------------------------------------------
add("routes", "SELECT way_id AS route, row_number() OVER (PARTITION BY way_id ORDER BY seg_id) AS pos, seg_id FROM {seg}", query=False)
add("j15_route_segments", "SELECT r.route, r.pos - 1 AS pos, r.seg_id, round(s.length_m, 3) AS length_m, s.highway FROM {routes} r JOIN {seg} s ON s.seg_id = r.seg_id")
_elev = "CASE WHEN n >= 5 THEN avg(e) OVER (PARTITION BY route ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) ELSE e END"
add("climbs", f"SELECT route, sum(CASE WHEN d > 2.0 THEN d ELSE 0.0 END) AS gain FROM (SELECT route, sm - lag(sm) OVER (PARTITION BY route ORDER BY pos) AS d FROM (SELECT route, pos, {_elev} AS sm FROM (SELECT r.route, r.pos, s.dem_elev_m AS e, count(*) OVER (PARTITION BY r.route) AS n FROM {{routes}} r JOIN {{seg}} s ON s.seg_id = r.seg_id WHERE s.dem_elev_m IS NOT NULL))) GROUP BY route", query=False)
add("a21_route_kpis", """SELECT r.route, round(sum(s.length_m) / 1000.0, 3) AS km, round(sum(s.seconds) / 60.0, 3) AS minutes, CAST(count(*) AS BIGINT) AS segments, round(sum(s.scenic * s.length_m) / sum(s.length_m), 5) AS scenic, round(sum(s.fun * s.length_m) / sum(s.length_m), 5) AS fun,
 round(sum(s.risk * s.length_m) / sum(s.length_m), 5) AS risk, max(s.lean_p95) AS max_lean, round(sum(CASE WHEN s.highway IN ('motorway', 'trunk') THEN s.length_m ELSE 0.0 END), 3) AS highway_m, round(coalesce(max(c.gain), 0.0), 4) AS elev_gain_m
 FROM {routes} r JOIN {scored} s ON s.seg_id = r.seg_id LEFT JOIN {climbs} c ON c.route = r.route GROUP BY r.route""")
add("a23_road_kpis", f"""SELECT r.route, round(sum(s.length_m) / 1000.0, 3) AS km, round(sum(s.seconds) / 60.0, 3) AS minutes, round(sum(s.value * s.length_m) / sum(s.length_m), 5) AS value, round(sum(s.risk * s.length_m) / sum(s.length_m), 5) AS risk,
 round(sum(CASE WHEN s.code IS NOT NULL THEN s.lean_p50 * s.length_m ELSE 0.0 END) / greatest(sum(CASE WHEN s.code IS NOT NULL THEN s.length_m ELSE 0.0 END), 0.000001), 4) AS mean_lean, round(100.0 * sum(CASE WHEN s.code IS NOT NULL THEN s.length_m ELSE 0.0 END) / sum(s.length_m), 4) AS crowd_pct,
 round(sum(CASE WHEN s.highway IN {S.HIGHWAYS} THEN s.length_m ELSE 0.0 END) / 1000.0, 4) AS highway_km, round(sum(CASE WHEN s.road_run_km >= 0.7 AND s.curvature_geo < 25.0 AND s.highway_factor > 1.0 THEN s.length_m ELSE 0.0 END) / 1000.0, 4) AS long_straight_km, round(sum(s.length_m) / sum(s.seconds) * 3.6, 4) AS avg_kmh
 FROM {{routes}} r JOIN {{roads}} s ON s.seg_id = r.seg_id GROUP BY r.route""")
add("a22_cell_path_kpis", "SELECT a AS route, round(sum(len_m) / 1000.0, 4) AS km, round(sum(seconds) / 60.0, 4) AS minutes, CAST(count(*) AS BIGINT) AS squares, round(sum(value * len_m) / greatest(sum(len_m), 0.000001), 5) AS value, round(sum(risk * len_m) / greatest(sum(len_m), 0.000001), 5) AS risk FROM {cell_costs} GROUP BY a")
add("a24_route_thirds", "SELECT route, third, round(sum(value * length_m) / sum(length_m), 5) AS value FROM (SELECT r.route, s.value, s.length_m, least(2, CAST(floor(3.0 * (sum(s.length_m) OVER (PARTITION BY r.route ORDER BY r.pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.length_m / 2.0) / sum(s.length_m) OVER (PARTITION BY r.route)) AS BIGINT)) AS third FROM {routes} r JOIN {roads} s ON s.seg_id = r.seg_id) GROUP BY route, third")
add("a25_top_roads", "SELECT route, name, metres, rk FROM (SELECT *, CAST(row_number() OVER (PARTITION BY route ORDER BY metres DESC, name) AS BIGINT) AS rk FROM (SELECT r.route, s.name, round(sum(s.length_m), 3) AS metres FROM {routes} r JOIN {seg} s ON s.seg_id = r.seg_id WHERE s.name IS NOT NULL GROUP BY r.route, s.name)) WHERE rk <= 5")
add("a25_first_roads", "SELECT route, name, first_pos, rk FROM (SELECT *, CAST(row_number() OVER (PARTITION BY route ORDER BY first_pos) AS BIGINT) AS rk FROM (SELECT r.route, s.name, CAST(min(r.pos) AS BIGINT) AS first_pos FROM {routes} r JOIN {seg} s ON s.seg_id = r.seg_id WHERE s.name IS NOT NULL GROUP BY r.route, s.name)) WHERE rk <= 8")
add("heat", "SELECT r.seg_id, sum(s.scenic * s.length_m) AS w FROM {routes} r JOIN {scored} s ON s.seg_id = r.seg_id GROUP BY r.seg_id", query=False)
add("a26_heatmap_weight", "SELECT seg_id, round(w / most, 6) AS weight FROM {heat} CROSS JOIN (SELECT max(w) AS most FROM {heat})")
add("l4_top_per_octant", "SELECT seg_id, octant FROM (SELECT seg_id, CAST(floor(bearing_mean / 45.0) AS BIGINT) AS octant, row_number() OVER (PARTITION BY CAST(floor(bearing_mean / 45.0) AS BIGINT) ORDER BY length_m DESC, seg_id) AS r FROM {seg} WHERE bearing_mean IS NOT NULL) WHERE r <= 2")
add("l5_diversity_pick", "SELECT route, octant, score FROM (SELECT *, row_number() OVER (PARTITION BY octant ORDER BY score DESC, route) AS r FROM (SELECT k.route, k.scenic AS score, CAST(floor(coalesce(s.bearing_mean, 0.0) / 45.0) AS BIGINT) AS octant FROM {a21_route_kpis} k JOIN {routes} q ON q.route = k.route AND q.pos = 1 JOIN {seg} s ON s.seg_id = q.seg_id)) WHERE r = 1")
# rides: whole ways, the start of a way with the whole next one, and ways ridden again, some the other way round
add("rides", "SELECT 3 * route AS ride, pos, seg_id FROM {routes} UNION ALL SELECT 3 * route + 1, pos, seg_id FROM {routes} WHERE pos <= 5 UNION ALL SELECT 3 * route - 2, pos + 5, seg_id FROM {routes} WHERE route > 0 UNION ALL SELECT 3 * route + 2, CASE WHEN route % 3 = 0 THEN pos ELSE -pos END, seg_id FROM {routes} WHERE route % 3 < 2", query=False)
add("ride_sizes", "SELECT ride, CAST(count(*) AS BIGINT) AS n, sum(length_m) AS m FROM (SELECT DISTINCT ride, seg_id FROM {rides}) r JOIN (SELECT seg_id AS id, length_m FROM {seg}) s ON s.id = r.seg_id GROUP BY ride", query=False)
add("l9_overlap", """SELECT x.ride_a, x.ride_b, x.shared, a.n + b.n - x.shared AS united, round(x.shared_m, 3) AS shared_m, round(x.shared_m / least(a.m, b.m), 6) AS share FROM
(SELECT a.ride AS ride_a, b.ride AS ride_b, CAST(count(*) AS BIGINT) AS shared, sum(s.length_m) AS shared_m FROM (SELECT DISTINCT ride, seg_id FROM {rides}) a JOIN (SELECT DISTINCT ride, seg_id FROM {rides}) b ON b.seg_id = a.seg_id AND b.ride > a.ride JOIN {seg} s ON s.seg_id = a.seg_id GROUP BY a.ride, b.ride) x
JOIN {ride_sizes} a ON a.ride = x.ride_a JOIN {ride_sizes} b ON b.ride = x.ride_b""",
    oracle="""WITH p AS (SELECT r.ride, list(DISTINCT r.seg_id) AS path FROM {rides} r GROUP BY r.ride),
c AS (SELECT a.ride AS ride_a, b.ride AS ride_b, list_intersect(a.path, b.path) AS inner_set, list_distinct(list_concat(a.path, b.path)) AS outer_set FROM p a JOIN p b ON b.ride > a.ride AND b.ride - a.ride <= 6 AND list_has_any(a.path, b.path)),
metres AS (SELECT ride, sum(length_m) AS m FROM (SELECT ride, unnest(path) AS seg_id FROM p) JOIN {seg} USING (seg_id) GROUP BY ride)
SELECT ride_a, ride_b, len(inner_set)::BIGINT AS shared, len(outer_set)::BIGINT AS united, round(m, 3) AS shared_m, round(m / least(x.m_a, x.m_b), 6) AS share FROM
(SELECT c.*, (SELECT sum(length_m) FROM {seg} s WHERE list_contains(c.inner_set, s.seg_id)) AS m, a.m AS m_a, b.m AS m_b FROM c JOIN metres a ON a.ride = ride_a JOIN metres b ON b.ride = ride_b) x""")
add("l11_same_routes", "SELECT min(ride) AS ride, CAST(count(*) AS BIGINT) AS n FROM (SELECT ride, transform(sort_array(collect_list(named_struct('pos', pos, 'seg', seg_id))), x -> x.seg) AS path FROM {rides} GROUP BY ride) GROUP BY path",
    oracle="SELECT min(ride) AS ride, count(*) AS n FROM (SELECT ride, string_agg(seg_id::VARCHAR, ' ' ORDER BY pos) AS path FROM {rides} GROUP BY ride) GROUP BY path")
add("jittered", "SELECT seg_id, round(scenic, 4) + ((seg_id * 7919 + 42 * 104729) % 1801 - 900) / 10000.0 AS score FROM {scored}", query=False)
ranked_rows("jitter_ranks", "jittered", "score", "p.seg_id")
add("l12_seeded_jitter", "SELECT seg_id, rk AS place FROM {jitter_ranks}", oracle="SELECT seg_id, CAST(row_number() OVER (ORDER BY score DESC, seg_id) AS BIGINT) AS place FROM (SELECT seg_id, round(scenic, 4) + ((seg_id * 7919 + 42 * 104729) % 1801 - 900) / 10000.0 AS score FROM {scored})")
add("j14_membership", "SELECT s.seg_id, r.seg_id IS NOT NULL AS used FROM {seg} s LEFT JOIN (SELECT DISTINCT q.seg_id FROM {routes} q JOIN {j12_route_visits} v ON v.route = q.route) r ON r.seg_id = s.seg_id")
add("q8_alpha_inversion", "SELECT x.seg_id AS fast, y.seg_id AS fine, round((y.seconds * (1.0 + y.risk) - x.seconds * (1.0 + x.risk)) / nullif(x.seconds * (1.0 - x.scenic) - y.seconds * (1.0 - y.scenic), 0.0), 4) AS alpha FROM {scored} x JOIN {scored} y ON y.seg_id = x.seg_id + 1 WHERE x.highway = 'motorway'")
