"""Trip windows, validity filters and crowd aggregates."""

from __future__ import annotations

from wayfold.functions import geo
from wayfold.functions.scores import nz
from wayfold.plans.ranks import group_quantiles
from wayfold.plans.relation import CATALOG

add = CATALOG.add
N = 1 << 18
CLEAN = "p_lat IS NOT NULL AND step_m <= 150.0"
CELL = f"cy * {N} + cx"
PREV = f"p_cy * {N} + p_cx"
#: What an aggregate over samples gives; ABS engages at 2, hard deceleration lies below a threshold.
CORE = """CAST(count(DISTINCT trip) AS BIGINT) AS n_trips, CAST(count(*) AS BIGINT) AS n_points, round(sum(step_m), 4) AS path_m,
 round(sum(CASE WHEN d_lean >= 2.0 THEN d_lean ELSE 0.0 END), 4) AS lean_delta, round(sum(CASE WHEN abs(lean) > 5.0 THEN step_m ELSE 0.0 END), 4) AS leaned_m,
 round(PCTL(abs(lean), 0.95), 6) AS lean_p95, round(avg(nullif(speed, 0.0)), 6) AS speed_mean, round(PCTL(nullif(speed, 0.0), 0.85), 6) AS speed_p85,
 round(avg(CASE WHEN speed BETWEEN 50 AND 120 THEN 1.0 ELSE 0.0 END), 6) AS band_share, round(avg(CASE WHEN speed > 0 AND speed < 20 THEN 1.0 ELSE 0.0 END), 6) AS crawl_share,
 CAST(sum(CASE WHEN absb >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS abs_events, CAST(sum(CASE WHEN acc < -0.3 THEN 1 ELSE 0 END) AS BIGINT) AS hard_decel,
 round(avg(nullif(rpm, 0.0)), 6) AS rpm_mean, round(avg(nullif(elev, 0.0)), 6) AS elev_mean, round(avg(lat), 9) AS lat, round(avg(lon), 9) AS lon"""

#: The same without quantiles, which come from counts of values.
PLAIN = CORE.replace("round(PCTL(abs(lean), 0.95), 6) AS lean_p95, ", "").replace("round(PCTL(nullif(speed, 0.0), 0.85), 6) AS speed_p85,\n", "")
CORE_PICKS = {"lean_p95": ("lean", 0.95, "between"), "speed_p85": ("speed", 0.85, "between")}
CORE_VALUES = {"lean": "abs(lean)", "speed": "nullif(speed, 0.0)"}

add("w1_lag", "SELECT event_id, round(p_lat, 9) AS p_lat, round(p_lon, 9) AS p_lon, round(p_lean, 6) AS p_lean FROM {steps}")
add("w2_lag_cell", "SELECT event_id, p_cx, p_cy FROM {steps}")
add("w3_trip_start", "SELECT trip, event_id, round(lat, 9) AS lat, round(lon, 9) AS lon FROM (SELECT *, row_number() OVER (PARTITION BY trip ORDER BY ts, event_id) AS r FROM {tele}) WHERE r = 1")
add("valid", "SELECT *, lag(lat) OVER w AS v_lat, lag(lon) OVER w AS v_lon, lag(t_ms) OVER w AS v_ms FROM {tele} WHERE event_id % 97 <> 0 WINDOW w AS (PARTITION BY trip ORDER BY ts, event_id)", query=False)
add("w4_previous_valid", f"SELECT event_id, round({geo.haversine('v_lat', 'v_lon', 'lat', 'lon')}, 6) AS m, t_ms - v_ms AS dt_ms FROM {{valid}} WHERE v_lat IS NOT NULL")
add("w5_lean_steps", "SELECT trip, round(sum(CASE WHEN d_lean >= 2.0 THEN d_lean ELSE 0.0 END), 4) AS lean_delta FROM {steps} GROUP BY trip")
# movement by position: dt in (0, 10] s, and up to 220 km/h
_v = f"({geo.haversine('p_lat', 'p_lon', 'lat', 'lon')} / (dt / 1000.0) * 3.6)"
add("moved", f"SELECT *, CASE WHEN v <= 220.0 THEN v END AS v_ok, CASE WHEN v <= 220.0 THEN v / 3.6 * dt / 1000.0 END AS d_ok FROM (SELECT *, CASE WHEN dt > 0 AND dt <= 10000 THEN {_v} END AS v FROM (SELECT *, t_ms - lag(t_ms) OVER (PARTITION BY trip ORDER BY ts, event_id) AS dt FROM {{steps}}))", query=False)
add("w6_moving_lean", "SELECT trip, round(sum(abs(l - p)), 4) AS lean_delta FROM (SELECT trip, abs(lean) AS l, lag(abs(lean)) OVER (PARTITION BY trip ORDER BY rn) AS p FROM {moved} WHERE v_ok > 15) GROUP BY trip")
for n in (5, 9, 15):
    add(f"w7_moving_average_{n}", f"SELECT event_id, round(CASE WHEN n >= {n} THEN avg(elev) OVER (PARTITION BY trip ORDER BY rn ROWS BETWEEN {n // 2} PRECEDING AND {n // 2} FOLLOWING) ELSE elev END, 6) AS smooth FROM (SELECT *, count(*) OVER (PARTITION BY trip) AS n FROM {{tele}} WHERE elev > 0)")
_b, _c = "lag(elev) OVER w", "lead(elev) OVER w"
add("w8_median_3", f"SELECT event_id, round(CASE WHEN a IS NULL AND c IS NULL THEN elev WHEN a IS NULL THEN (elev + c) / 2.0 WHEN c IS NULL THEN (elev + a) / 2.0 ELSE greatest(least(a, elev), least(greatest(a, elev), c)) END, 6) AS median FROM (SELECT event_id, elev, {_b} AS a, {_c} AS c FROM {{tele}} WINDOW w AS (PARTITION BY trip ORDER BY rn))")
add("first32", f"SELECT * FROM (SELECT *, {geo.packed('lat', 'lon')} AS cell, row_number() OVER (PARTITION BY {geo.packed('lat', 'lon')} ORDER BY trip, ts, event_id) AS r FROM {{tele}}) WHERE r <= 32", query=False)
add("w9_first_32", "SELECT cell, CAST(count(*) AS BIGINT) AS n, round(sum(abs(lean)), 4) AS lean_sum, max(event_id) AS last_event FROM {first32} GROUP BY cell")
add("w10_climb", "SELECT trip, round(sum(CASE WHEN d > 2.0 THEN d ELSE 0.0 END), 4) AS gain_2, round(sum(CASE WHEN d > 1.0 THEN d ELSE 0.0 END), 4) AS gain_1, round(sum(CASE WHEN d < -2.0 THEN -d ELSE 0.0 END), 4) AS loss_2 FROM (SELECT trip, elev - lag(elev) OVER (PARTITION BY trip ORDER BY rn) AS d FROM {tele} WHERE elev > 0) GROUP BY trip")
add("w11_brake_events", "SELECT trip, CAST(sum(CASE WHEN p IS NULL OR (t_ms - p) / 1000.0 > 3.0 THEN 1 ELSE 0 END) AS BIGINT) AS hard_braking FROM (SELECT trip, t_ms, lag(t_ms) OVER (PARTITION BY trip ORDER BY rn) AS p FROM {tele} WHERE acc < -0.4) GROUP BY trip")
add("w13_cumulative", "SELECT event_id, round(sum(coalesce(step_m, 0.0)) OVER (PARTITION BY trip ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS metres FROM {steps}")
add("w14_thinning", "SELECT event_id FROM (SELECT event_id, rn, greatest(1, CAST(floor(count(*) OVER (PARTITION BY trip) / 20.0) AS BIGINT)) AS step FROM {tele}) WHERE (rn - 1) % step = 0")

add("p1_bbox_then_lag", "SELECT event_id, round(lag(lat) OVER (PARTITION BY trip ORDER BY ts, event_id), 9) AS p_lat FROM {tele} WHERE lat BETWEEN 47.62 AND 47.66")
add("p2_no_fix", "SELECT event_id FROM {tele} WHERE NOT (lat = 0 AND lon = 0) AND lat <> 0")
add("p3_first_dropped", "SELECT event_id FROM {steps} WHERE p_lat IS NOT NULL")
add("p4_dropout_guard", f"SELECT event_id FROM {{steps}} WHERE {CLEAN}")
_gap = geo.haversine("p_lat", "p_lon", "lat", "lon")
add("gaps", f"SELECT *, CASE WHEN gap > 150.0 THEN 'teleport' WHEN dt <= 0 OR dt > 60000 THEN 'time' ELSE 'kept' END AS fate FROM (SELECT *, {_gap} AS gap FROM {{moved}} WHERE p_lat IS NOT NULL AND (cx <> p_cx OR cy <> p_cy))", query=False)
add("p5_gap_categories", "SELECT fate, CAST(count(*) AS BIGINT) AS n FROM {gaps} GROUP BY fate")
add("p6_transitions", f"SELECT event_id, {PREV} AS cell_from, {CELL} AS cell_to FROM {{steps}} WHERE {CLEAN} AND (cx <> p_cx OR cy <> p_cy)")
add("p7_two_trips", f"SELECT {PREV} AS cell_from, {CELL} AS cell_to, CAST(count(DISTINCT trip) AS BIGINT) AS n_trips FROM {{steps}} WHERE {CLEAN} AND (cx <> p_cx OR cy <> p_cy) GROUP BY {PREV}, {CELL} HAVING count(DISTINCT trip) >= 2")
add("p8_long_trips", "SELECT trip, round(sum(CASE WHEN step_m <= 150 THEN step_m ELSE 0.0 END), 4) AS dist_m FROM {steps} GROUP BY trip HAVING sum(CASE WHEN step_m <= 150 THEN step_m ELSE 0.0 END) > 500")
add("p9_plausible_speed", "SELECT event_id, round(v_ok, 6) AS v_220, round(CASE WHEN v > 0 AND v < 200 THEN v END, 6) AS v_200 FROM {moved} WHERE dt IS NOT NULL")
add("p10_moving_only", "SELECT trip, CAST(sum(CASE WHEN v_ok > 20 THEN 1 ELSE 0 END) AS BIGINT) AS n_20, CAST(sum(CASE WHEN v_ok > 15 THEN 1 ELSE 0 END) AS BIGINT) AS n_15, round(avg(CASE WHEN v_ok > 20 THEN v_ok END), 6) AS v_mean FROM {moved} GROUP BY trip")
add("p11_length_floors", "SELECT seg_id, length_m >= 5.0 AS keep_5, length_m >= 20.0 AS keep_20, length_m >= 100.0 AS keep_100 FROM {seg}")
add("p12_zero_as_missing", "SELECT trip, round(avg(nullif(speed, 0.0)), 6) AS speed_mean, round(avg(speed), 6) AS with_zeros, CAST(count(nullif(elev, 0.0)) AS BIGINT) AS n_elev FROM {tele} GROUP BY trip")

MOVES = f"{CLEAN} AND (cx <> p_cx OR cy <> p_cy)"
group_quantiles("transition_quantiles", "steps", {"cell_from": PREV, "cell_to": CELL}, CORE_VALUES, CORE_PICKS, MOVES)
add("a1_transition_aggregate", f"SELECT m.*, round(q.lean_p95, 6) AS lean_p95, round(q.speed_p85, 6) AS speed_p85 FROM (SELECT {PREV} AS cell_from, {CELL} AS cell_to, {PLAIN}, round(avg(abs(lean)), 6) AS lean_mean FROM {{steps}} WHERE {MOVES} GROUP BY {PREV}, {CELL} HAVING count(DISTINCT trip) >= 2) m LEFT JOIN {{transition_quantiles}} q ON q.cell_from = m.cell_from AND q.cell_to = m.cell_to",
    oracle=f"SELECT {PREV} AS cell_from, {CELL} AS cell_to, {CORE}, round(avg(abs(lean)), 6) AS lean_mean FROM {{steps}} WHERE {CLEAN} AND (cx <> p_cx OR cy <> p_cy) GROUP BY {PREV}, {CELL} HAVING count(DISTINCT trip) >= 2")
group_quantiles("cell_quantiles", "steps", {"cell": CELL}, CORE_VALUES, CORE_PICKS, CLEAN)
add("a2_cell_aggregate", f"SELECT m.*, round(q.lean_p95, 6) AS lean_p95, round(q.speed_p85, 6) AS speed_p85 FROM (SELECT {CELL} AS cell, {PLAIN}, round(avg(hdg), 6) AS hdg FROM {{steps}} WHERE {CLEAN} GROUP BY {CELL}) m LEFT JOIN {{cell_quantiles}} q ON q.cell = m.cell",
    oracle=f"SELECT {CELL} AS cell, {CORE}, round(avg(hdg), 6) AS hdg FROM {{steps}} WHERE {CLEAN} GROUP BY {CELL}")
add("a3_trip_aggregate", """SELECT trip, min(t_ms) AS t0, max(t_ms) AS t1, round(sum(CASE WHEN step_m <= 150 THEN step_m ELSE 0.0 END), 4) AS dist_m, round(max(abs(lean)), 6) AS lean_max,
 round(PCTL(abs(lean), 0.9), 6) AS lean_p90, round(PCTL(abs(lean), 0.95), 6) AS lean_p95, round(sum(CASE WHEN d_lean >= 2.0 THEN d_lean ELSE 0.0 END), 4) AS lean_delta, round(avg(nullif(speed, 0.0)), 6) AS speed_mean,
 max(speed) AS speed_max, max(nullif(elev, 0.0)) AS elev_max, round(avg(nullif(temp, 0.0)), 6) AS temp_mean, CAST(sum(CASE WHEN absb >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS abs_events, CAST(count(*) AS BIGINT) AS n
 FROM {steps} GROUP BY trip HAVING sum(CASE WHEN step_m <= 150 THEN step_m ELSE 0.0 END) > 500""")
RIDER = "trip % 3 = 0"
group_quantiles("rider_cell_quantiles", "steps", {"cell": CELL}, {"lean": "abs(lean)"}, {"lean_p95": ("lean", 0.95, "between")}, RIDER)
add("a4_rider_cells", f"""SELECT m.*, round(q.lean_p95, 6) AS lean_p95 FROM (SELECT {CELL} AS cell, round(avg(lat), 9) AS lat, round(avg(lon), 9) AS lon, round(avg(hdg), 6) AS hdg, round(sum(CASE WHEN step_m <= 150 THEN step_m ELSE 0.0 END), 4) AS path_m,
 round(sum(CASE WHEN d_lean >= 2.0 THEN d_lean ELSE 0.0 END), 4) AS lean_delta, round(sum(CASE WHEN abs(lean) > 5.0 THEN step_m ELSE 0.0 END), 4) AS leaned_m,  round(avg(nullif(speed, 0.0)), 6) AS speed_mean, round(avg(CASE WHEN speed BETWEEN 50 AND 120 THEN 1.0 ELSE 0.0 END), 6) AS band_share, round(avg(nullif(elev, 0.0)), 6) AS elev_mean, CAST(count(*) AS BIGINT) AS n
 FROM {{steps}} WHERE {RIDER} GROUP BY {CELL}) m LEFT JOIN {{rider_cell_quantiles}} q ON q.cell = m.cell""",
    oracle=f"""SELECT {CELL} AS cell, round(avg(lat), 9) AS lat, round(avg(lon), 9) AS lon, round(avg(hdg), 6) AS hdg, round(sum(CASE WHEN step_m <= 150 THEN step_m ELSE 0.0 END), 4) AS path_m,
 round(sum(CASE WHEN d_lean >= 2.0 THEN d_lean ELSE 0.0 END), 4) AS lean_delta, round(sum(CASE WHEN abs(lean) > 5.0 THEN step_m ELSE 0.0 END), 4) AS leaned_m, round(PCTL(abs(lean), 0.95), 6) AS lean_p95,
 round(avg(nullif(speed, 0.0)), 6) AS speed_mean, round(avg(CASE WHEN speed BETWEEN 50 AND 120 THEN 1.0 ELSE 0.0 END), 6) AS band_share, round(avg(nullif(elev, 0.0)), 6) AS elev_mean, CAST(count(*) AS BIGINT) AS n
 FROM {{steps}} WHERE {RIDER} GROUP BY {CELL}""")
group_quantiles("rider_quantiles", "steps", {"whole": "0"}, {"lean": "abs(lean)"}, {f"lean_p{p}": ("lean", p / 100, "between") for p in (90, 95, 99)}, RIDER)
add("a5_rider_quantiles", f"SELECT round(q.lean_p90, 6) AS lean_p90, round(q.lean_p95, 6) AS lean_p95, round(q.lean_p99, 6) AS lean_p99, m.* FROM (SELECT round(avg(nullif(rpm, 0.0)), 6) AS rpm_mean, round(avg(nullif(speed, 0.0)), 6) AS speed_mean, max(nullif(gear, 0)) AS max_gear, CAST(count(*) AS BIGINT) AS n_points FROM {{steps}} WHERE {RIDER}) m LEFT JOIN {{rider_quantiles}} q ON TRUE",
    oracle=f"SELECT round(PCTL(abs(lean), 0.90), 6) AS lean_p90, round(PCTL(abs(lean), 0.95), 6) AS lean_p95, round(PCTL(abs(lean), 0.99), 6) AS lean_p99, round(avg(nullif(rpm, 0.0)), 6) AS rpm_mean, round(avg(nullif(speed, 0.0)), 6) AS speed_mean, max(nullif(gear, 0)) AS max_gear, CAST(count(*) AS BIGINT) AS n_points FROM {{steps}} WHERE {RIDER}")


def ranked(q: float, n: str = "n", even: bool = True) -> str:
    """Rank, from 1, of the nearest-rank percentile; with ``even`` False the index is cut off."""
    return f"({geo.half_even(f'{q} * ({n} - 1)')} + 1)" if even else f"(CAST(floor({q} * ({n} - 1)) AS BIGINT) + 1)"


def picked(value: str, q: float, even: bool = True) -> str:
    return f"max(CASE WHEN r = {ranked(q, 'n', even)} THEN {value} END)"


def global_pick(name: str, source: str, value: str, tie: str, rank: str, out: str, scale: float = 1.0, where: str = "TRUE", default: str = "NULL") -> None:
    """One row: the value at a rank (an expression over the count n) of a whole relation.

    Counts of value ranges find the range that holds the rank; only its rows are sorted."""
    bucket = f"CAST(floor(({value}) * {scale}) AS BIGINT)"
    add(f"{name}_counts", f"SELECT {bucket} AS b, count(*) AS c FROM {{{source}}} WHERE {where} GROUP BY {bucket}", query=False)
    add(f"{name}_range", f"SELECT b, {rank} - (upto - c) AS k FROM (SELECT b, c, sum(c) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(c) OVER () AS n FROM {{{name}_counts}}) WHERE upto - c < {rank} AND {rank} <= upto", query=False)
    add(name, f"SELECT coalesce(max(CASE WHEN r = k THEN v END), {default}) AS {out} FROM (SELECT x.v, g.k, row_number() OVER (ORDER BY x.v, x.tie) AS r FROM (SELECT {value} AS v, {tie} AS tie, {bucket} AS b FROM {{{source}}} WHERE {where}) x JOIN {{{name}_range}} g ON g.b = x.b)", query=False)


add("a6_bounded_samples", f"SELECT cell, round({picked('l', 0.5)}, 6) AS lean_p50, round({picked('l', 0.9)}, 6) AS lean_p90, round({picked('l', 0.95)}, 6) AS lean_p95 FROM (SELECT cell, abs(lean) AS l, row_number() OVER (PARTITION BY cell ORDER BY abs(lean), event_id) AS r, count(*) OVER (PARTITION BY cell) AS n FROM {{first32}}) GROUP BY cell")
add("lean_ranks", "SELECT trip, abs(lean) AS l, row_number() OVER (PARTITION BY trip ORDER BY abs(lean), event_id) AS r, count(*) OVER (PARTITION BY trip) AS n FROM {tele}", query=False)
add("a7_nearest_rank", f"SELECT trip, round({picked('l', 0.5)}, 6) AS p50, round({picked('l', 0.95)}, 6) AS p95 FROM {{lean_ranks}} GROUP BY trip")
add("a8_truncated_rank", f"SELECT trip, round({picked('l', 0.5, False)}, 6) AS p50, round({picked('l', 0.95, False)}, 6) AS p95 FROM {{lean_ranks}} GROUP BY trip")
add("a9_weighted_percentile", "SELECT way_id, min(curviness) AS p90 FROM (SELECT way_id, curviness, sum(length_m) OVER (PARTITION BY way_id ORDER BY curviness, seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS acc, sum(length_m) OVER (PARTITION BY way_id) AS total FROM {seg}) WHERE acc >= 0.9 * total GROUP BY way_id")
add("a10_upper_median", "SELECT trip, round(max(CASE WHEN r = CAST(floor(n / 2.0) AS BIGINT) + 1 THEN l END), 6) AS median FROM {lean_ranks} GROUP BY trip")
add("a13_direction_pooling", """SELECT least(cell_from, cell_to) AS cell_a, greatest(cell_from, cell_to) AS cell_b, CAST(sum(n_points) AS BIGINT) AS n_points, max(n_trips) AS n_trips, round(sum(path_m), 4) AS path_m,
 round(sum(coalesce(speed_mean, 0.0) * n_points) / nullif(sum(CASE WHEN speed_mean IS NOT NULL THEN n_points END), 0), 6) AS speed_mean, round(sum(lean_p95 * n_points) / sum(n_points), 6) AS lean_p95
 FROM {a1_transition_aggregate} GROUP BY least(cell_from, cell_to), greatest(cell_from, cell_to)""")
add("j5_both_directions", "SELECT cell_a, cell_b, n_points, n_trips FROM {a13_direction_pooling}")
_c = geo.tile_centre(f"(node % {N})", f"floor(node / {N}.0)")
add("a14_node_position", f"SELECT node, round(coalesce(sum(lat * n_points) / nullif(sum(n_points), 0), {_c[0]}), 8) AS lat, round(coalesce(sum(lon * n_points) / nullif(sum(n_points), 0), {_c[1]}), 8) AS lon FROM (SELECT cell_to AS node, lat, lon, n_points FROM {{a1_transition_aggregate}} UNION ALL SELECT cell_from, NULL, NULL, 0 FROM {{a1_transition_aggregate}}) GROUP BY node")
add("a27_counters", f"SELECT CAST(count(*) AS BIGINT) AS samples, CAST(sum(CASE WHEN lat BETWEEN 47.62 AND 47.7 THEN 0 ELSE 1 END) AS BIGINT) AS out_of_region, CAST(sum(CASE WHEN step_m > 150 THEN 1 ELSE 0 END) AS BIGINT) AS dropped_teleport, CAST(sum(CASE WHEN p_lat IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS trip_starts, CAST(sum(CASE WHEN {nz('speed')} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS no_speed FROM {{steps}}")
add("a30_sustained_speed", "SELECT trip, round(CASE WHEN max(n) < 5 THEN max(v) ELSE max(CASE WHEN c = 5 THEN m END) END, 6) AS top FROM (SELECT trip, v_ok AS v, avg(v_ok) OVER w AS m, count(*) OVER w AS c, count(*) OVER (PARTITION BY trip) AS n FROM {moved} WHERE v_ok > 15 WINDOW w AS (PARTITION BY trip ORDER BY rn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) GROUP BY trip")

# --- the cell graph -----------------------------------------------------------------------------------------------------
add("cell_samples", f"SELECT *, {geo.packed('lat', 'lon')} AS code, CASE WHEN speed > 0 THEN speed WHEN v > 0 AND v < 200 THEN v ELSE 0.0 END AS spd FROM {{moved}}", query=False)
global_pick("region_speed", "cell_samples", "spd", "event_id", ranked(0.5), "region", 4.0, "spd > 0", "40.0")
add("cell_edges", "SELECT code_a AS a, code_b AS b, CAST(count(DISTINCT trip) AS BIGINT) AS n_trips, avg(gap) AS gap_m, avg(dt / 1000.0) AS secs FROM (SELECT *, p_cy * 262144 + p_cx AS code_a, cy * 262144 + cx AS code_b FROM {gaps} WHERE fate = 'kept') GROUP BY code_a, code_b HAVING count(DISTINCT trip) >= 2", query=False)
add("live", "SELECT DISTINCT code FROM (SELECT a AS code FROM {cell_edges} UNION ALL SELECT b FROM {cell_edges})", query=False)
group_quantiles("cell_values", "cell_samples", {"code": "code"}, {"lean": "abs(lean)", "speed": "CASE WHEN spd > 0 THEN spd END"}, {"lean_p50": ("lean", 0.5, "even"), "lean_p90": ("lean", 0.9, "even"), "lean_p95": ("lean", 0.95, "even"), "speed_med": ("speed", 0.5, "even"), "speed_p85": ("speed", 0.85, "even")})
add("cell_lean", "SELECT code, lean_p50, lean_p90, lean_p95 FROM {cell_values}", query=False, oracle=f"SELECT code, {picked('l', 0.5)} AS lean_p50, {picked('l', 0.9)} AS lean_p90, {picked('l', 0.95)} AS lean_p95 FROM (SELECT code, abs(lean) AS l, row_number() OVER (PARTITION BY code ORDER BY abs(lean), event_id) AS r, count(*) OVER (PARTITION BY code) AS n FROM {{cell_samples}}) GROUP BY code")
add("cell_speed", "SELECT code, speed_med, speed_p85 FROM {cell_values} WHERE speed_med IS NOT NULL", query=False, oracle=f"SELECT code, {picked('spd', 0.5)} AS speed_med, {picked('spd', 0.85)} AS speed_p85 FROM (SELECT code, spd, row_number() OVER (PARTITION BY code ORDER BY spd, event_id) AS r, count(*) OVER (PARTITION BY code) AS n FROM {{cell_samples}} WHERE spd > 0) GROUP BY code")
_cc = geo.tile_centre(f"(c.code % {N})", f"floor(c.code / {N}.0)")
add("cells", f"""SELECT c.code, {_cc[0]} AS lat, {_cc[1]} AS lon, c.n, c.n_trips, l.lean_p50, l.lean_p90, l.lean_p95, coalesce(s.speed_med, r.region) AS speed_med, coalesce(s.speed_p85, r.region) AS speed_p85, c.elev_m, c.abs_rate, c.decel_rate, c.throttle
FROM (SELECT code, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT trip) AS BIGINT) AS n_trips, avg(nullif(elev, 0.0)) AS elev_m, avg(CASE WHEN absb >= 2 THEN 1.0 ELSE 0.0 END) AS abs_rate, avg(CASE WHEN acc < -0.25 THEN 1.0 ELSE 0.0 END) AS decel_rate, avg(throttle) AS throttle FROM {{cell_samples}} GROUP BY code) c
JOIN {{live}} v ON v.code = c.code JOIN {{cell_lean}} l ON l.code = c.code LEFT JOIN {{cell_speed}} s ON s.code = c.code CROSS JOIN {{region_speed}} r""", query=False)
add("cell_graph_cells", "SELECT code, round(lat, 6) AS lat, round(lon, 6) AS lon, n, n_trips, round(lean_p50, 2) AS lean_p50, round(lean_p90, 2) AS lean_p90, round(lean_p95, 2) AS lean_p95, round(speed_med, 2) AS speed_med, round(speed_p85, 2) AS speed_p85, round(elev_m, 1) AS elev_m, round(abs_rate, 4) AS abs_rate, round(decel_rate, 4) AS decel_rate, round(throttle, 2) AS throttle FROM {cells}")
add("edges", f"SELECT e.a, e.b, {geo.haversine('x.lat', 'x.lon', 'y.lat', 'y.lon')} AS len_m, e.gap_m, greatest(3.0, least(200.0, (x.speed_p85 + y.speed_p85) / 2.0)) AS v_kmh, e.n_trips FROM {{cell_edges}} e JOIN {{cells}} x ON x.code = e.a JOIN {{cells}} y ON y.code = e.b", query=False)
add("j16_edge_endpoints", "SELECT a, b, round(len_m, 1) AS len_m, round(gap_m, 1) AS gap_m, round(v_kmh, 1) AS v_kmh, n_trips FROM {edges}")
add("j6_undirected", "SELECT a, b, n_trips FROM (SELECT *, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY n_trips DESC, a) AS r FROM {edges}) WHERE r = 1")
add("p13_graph_gate", "SELECT CAST(count(*) AS BIGINT) AS edges, CAST(sum(CASE WHEN gap_m > 150.0 THEN 1 ELSE 0 END) AS BIGINT) AS too_long, CAST(sum(CASE WHEN n_trips < 2 THEN 1 ELSE 0 END) AS BIGINT) AS too_few FROM {edges}")
add("l3_longest_edges", "SELECT a, b, round(gap_m, 4) AS gap_m FROM {edges} ORDER BY gap_m DESC, a, b LIMIT 20")
add("a16_degree", "SELECT node, CAST(count(*) AS BIGINT) AS degree FROM (SELECT node_a AS node FROM {seg} UNION ALL SELECT node_b FROM {seg}) GROUP BY node")
add("a16_branching", "SELECT round(avg(CASE WHEN d >= 3 THEN 1.0 ELSE 0.0 END), 6) AS share FROM (SELECT node, count(*) AS d FROM (SELECT a AS node FROM {j6_undirected} UNION ALL SELECT b FROM {j6_undirected}) GROUP BY node)")
