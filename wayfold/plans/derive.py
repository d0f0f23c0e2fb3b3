"""Domain inputs derived from the generated tables by expressions that both engines evaluate alike.

``tele``: telemetry samples from events, a trip for each user, with GPS spikes, dead speed channels and missing values.
``seg``: a lattice of roads from part. ``poi``: points of interest from supplier. ``forecast``: hours from events.
"""

from __future__ import annotations

from wayfold.functions import geo
from wayfold.plans.relation import CATALOG

add = CATALOG.add

add("tele", """
SELECT user_id AS trip, event_id, ts, rn, rn * 3000 AS t_ms,
       47.60 + (user_id % 12) * 0.01 + rn * 0.0004 + CASE WHEN event_id % 97 = 0 THEN 0.01 ELSE 0.0 END AS lat,
       11.50 + (rn % 3) * 0.0001 + (user_id % 5) * 0.0011 AS lon,
       CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE -1.0 END * (value % 45.0) AS lean,
       CASE WHEN user_id % 4 = 0 THEN 0.0 ELSE (event_id * 31) % 140 * 1.0 END AS speed,
       event_id % 4 AS absb, (event_id % 100 - 50) / 100.0 AS acc,
       CASE WHEN event_id % 11 = 0 THEN 0.0 ELSE 500.0 + (event_id * 7) % 400 END AS elev,
       (event_id * 37) % 6000 * 1.0 AS rpm, event_id % 7 AS gear, (event_id % 35) * 1.0 AS temp,
       (event_id * 13) % 360 * 1.0 AS hdg, (event_id * 17) % 100 * 1.0 AS throttle
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS rn FROM {events})
""", query=False)  # fmt: skip

_CLASSES = ["motorway", "secondary", "tertiary", "primary", "unclassified", "trunk", "tertiary", "secondary", "motorway_link", "primary_link", "unclassified"]
add("lattice", f"""
SELECT seg_id, node_a, node_b, k, 47.60 + CAST(floor(node_a / 40.0) AS BIGINT) * 0.0021 AS a_lat, 11.30 + (node_a % 40) * 0.013 AS a_lon,
       47.60 + CAST(floor(node_b / 40.0) AS BIGINT) * 0.0021 AS b_lat, 11.30 + (node_b % 40) * 0.013 AS b_lon, p_size, p_brand, w
FROM (SELECT 2 * p_partkey AS seg_id, p_partkey AS node_a, p_partkey + 1 AS node_b, p_partkey AS k, p_size, p_brand, 60 + p_size * 4 AS w
      FROM {{part}} WHERE p_partkey % 40 < 39 AND p_partkey + 1 < (SELECT count(*) FROM {{part}})
      UNION ALL
      SELECT 2 * p_partkey + 1, p_partkey, p_partkey + 40, p_partkey, p_size, p_brand, 60 + ((p_size * 7) % 50) * 4
      FROM {{part}} WHERE p_partkey + 40 < (SELECT count(*) FROM {{part}}))
""", query=False)  # fmt: skip
add("seg", f"""
SELECT *, (a_lat + b_lat) / 2.0 AS mid_lat, (a_lon + b_lon) / 2.0 AS mid_lon,
       CASE (k * 7 + seg_id) % 11 {' '.join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CLASSES))} END AS highway,
       CASE WHEN k % 3 = 0 THEN NULL ELSE p_brand END AS name, CAST(floor(k / 8.0) AS BIGINT) AS way_id,
       k % 13 = 0 AS oneway, k % 17 = 0 AS tunnel, w * 1.0 AS length_m, (k * 53) % 400 * 1.0 AS curvature_geo,
       p_size % 12 AS n_trips, (k * 29) % 300 * 1.0 AS curviness, (k % 100) / 100.0 AS leaned_share, ((k * 3) % 100) / 100.0 AS band_share,
       ((k * 7) % 50) / 100.0 AS crawl_share, ((k * 11) % 40) / 10.0 AS abs_rate, ((k * 13) % 60) / 10.0 AS hard_decel_rate,
       (k * 37) % 6000 * 1.0 AS rpm_mean, (k * 19) % 110 * 1.0 AS speed_mean, (k * 23) % 45 * 1.0 AS lean_p95, (k * 31) % 900 * 1.0 AS elev_mean,
       CASE WHEN k % 5 = 0 THEN NULL ELSE 450.0 + (k * 41) % 1200 END AS dem_elev_m, ((k * 17) % 41 - 20) / 2.0 AS dem_gradient_pct,
       CASE WHEN k % 9 = 0 THEN NULL ELSE (k * 43) % 700 * 1.0 END AS dem_relief_m, CASE WHEN k % 19 = 0 THEN NULL ELSE (k * 59) % 360 * 1.0 END AS bearing_mean,
       CAST(NULL AS DOUBLE) AS forest_share, CAST(NULL AS DOUBLE) AS water_prox, CAST(NULL AS DOUBLE) AS viewpoint
FROM {{lattice}}
""", query=False)  # fmt: skip
add("node", """
SELECT DISTINCT node, lat, lon FROM (SELECT node_a AS node, a_lat AS lat, a_lon AS lon FROM {seg} UNION ALL SELECT node_b, b_lat, b_lon FROM {seg})
""", query=False)
add("poi", """
SELECT s_suppkey AS poi_id, s_name AS name, CASE s_nationkey % 4 WHEN 0 THEN 'lake' WHEN 1 THEN 'viewpoint' WHEN 2 THEN 'pass' ELSE 'peak' END AS kind,
       47.60 + (s_suppkey * 7 % 50) * 0.0021 + (s_suppkey % 9) * 0.0013 AS lat, 11.30 + (s_suppkey * 11 % 40) * 0.013 + (s_suppkey % 7) * 0.0017 AS lon,
       1.0 + least(0.8, abs(s_acctbal) / 10000.0) AS weight, (s_suppkey * 97) % 2600 * 1.0 AS ele, s_nationkey
FROM {supplier}
""", query=False)
add("forecast", """
SELECT h, round(8.0 + avg_v / 8.0, 3) AS temp, CASE WHEN n % 13 = 0 THEN NULL ELSE (n * 7) % 45 * 1.0 END AS pop, CASE WHEN n % 5 = 0 THEN (n % 7) / 5.0 ELSE 0.0 END AS precip,
       CASE WHEN n % 11 = 0 THEN NULL ELSE 10.0 + (n * 5) % 35 END AS gust, hour(h) BETWEEN 6 AND 20 AS is_day, CASE WHEN n % 29 = 0 THEN 71 ELSE 3 END AS weather_code
FROM (SELECT date_trunc('hour', ts) AS h, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS avg_v FROM {events} GROUP BY date_trunc('hour', ts))
""", query=False)
add("sunset", "SELECT d, d + INTERVAL 19 HOUR AS sunset FROM (SELECT DISTINCT date_trunc('day', h) AS d FROM {forecast})", query=False)

add("steps", f"""
SELECT *, {geo.flat_step('lat', 'lon', 'p_lat', 'p_lon')} AS step_m, abs(lean - p_lean) AS d_lean
FROM (SELECT *, {geo.tile_x('lon')} AS cx, {geo.tile_y('lat')} AS cy, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon, lag(lean) OVER w AS p_lean,
             lag({geo.tile_x('lon')}) OVER w AS p_cx, lag({geo.tile_y('lat')}) OVER w AS p_cy
      FROM {{tele}} WHERE lat BETWEEN 47.0 AND 49.4 AND lon BETWEEN 9.8 AND 13.4
      WINDOW w AS (PARTITION BY trip ORDER BY ts, event_id))
""", query=False)
