"""Light, weather and ride windows; rider profiles; trip replays."""

from __future__ import annotations

from wayfold.functions import geo
from wayfold.functions import scores as S
from wayfold.operators.crowd import global_pick, picked, ranked
from wayfold.plans.relation import CATALOG

add = CATALOG.add

# --- light ----------------------------------------------------------------------------------------------------------------
# the forecast's hours at the city, numbered from the first: days since the epoch of 2000
add("hours", "SELECT CAST(round((j.jd - m.jd) * 24.0) AS BIGINT) AS i, j.jd - 2451545.0 AS n, 48.137154 AS lat, 11.576124 AS lon FROM {julian} j CROSS JOIN (SELECT min(jd) AS jd FROM {julian}) m", query=False)
_e, _a = S.sun_terms("n", "lat", "lon")
add("sun", f"SELECT i, {_e} AS elev, {_a} AS az FROM {{hours}}", query=False)
# the hour that a request asks for: the first from the fifteenth on
add("asked_hour", "SELECT * FROM {sun} WHERE i = (SELECT min(i) FROM {sun} WHERE i >= 15)", query=False)
add("f34_sun_position", "SELECT i, round(elev, 6) AS elevation, round(az, 6) AS azimuth FROM {sun}")
# the civil calendar's terms; January and February count as months of the year before
add("julian", """SELECT h, floor(365.25 * (y + 4716)) + floor(30.6001 * (m + 1)) + day(h) + hour(h) / 24.0 + minute(h) / 1440.0 + second(h) / 86400.0 + (2 - floor(y / 100.0) + floor(floor(y / 100.0) / 4.0)) - 1524.5 AS jd
FROM (SELECT h, CASE WHEN month(h) <= 2 THEN year(h) - 1 ELSE year(h) END AS y, CASE WHEN month(h) <= 2 THEN month(h) + 12 ELSE month(h) END AS m FROM {forecast})""", query=False)
_je, _ja = S.sun_terms("(jd - 2451545.0)", "48.137154", "11.576124")
add("f34_julian_day", f"SELECT h, round(jd, 6) AS jd, round({_je}, 4) AS elevation, round({_ja}, 4) AS azimuth FROM {{julian}}",
    oracle=f"SELECT h, round(jd, 6) AS jd, round({_je}, 4) AS elevation, round({_ja}, 4) AS azimuth FROM (SELECT h, epoch(h) / 86400.0 + 2440587.5 AS jd FROM {{forecast}})")
add("f35_light", f"SELECT i, {S.daylight('elev')} AS daylight, round({S.golden('elev')}, 6) AS golden, round({S.facing('200.0', 'az')}, 6) AS facing, {S.phase('elev')} AS phase FROM {{sun}}")
# every segment at one hour, which is the request
add("f36_time_factor", f"SELECT s.seg_id, u.i, {S.daylight('u.elev')} AS light, round(0.30 * {S.golden('u.elev')} * {S.facing('s.bearing_mean', 'u.az')}, 6) AS bonus FROM {{seg}} s CROSS JOIN {{asked_hour}} u")
add("f5_scenic_at_dusk", f"SELECT s.seg_id, round({S.seg_scenic('l.light', '0.30 * l.gold * ' + S.facing('s.bearing_mean', 'l.az'))}, 6) AS scenic FROM {{scored}} s CROSS JOIN (SELECT {S.daylight('elev')} AS light, {S.golden('elev')} AS gold, az FROM {{asked_hour}}) l")

# --- weather and windows -----------------------------------------------------------------------------------------------------
add("f37_weather", f"SELECT h, round({S.weather_risk('precip', 'temp', 'gust')}, 6) AS risk, {S.weather_factor('precip', 'temp', 'weather_code')} AS factor FROM {{forecast}}".replace("+ CASE WHEN gust > 45", "+ CASE WHEN coalesce(gust, 0.0) > 45"))
add("f38_temp_gust", f"SELECT h, round({S.temp_score('temp')}, 6) AS temp_score, round({S.gust_score('gust')}, 6) AS gust_score FROM {{forecast}}")
add("hour_parts", f"SELECT *, {S.rain_score('pop', 'precip')} AS rain_s, {S.temp_score('temp')} AS temp_s, {S.gust_score('gust')} AS gust_s FROM {{forecast}}", query=False)
add("hour_scores", """SELECT *, CASE WHEN NOT is_day THEN 0.0 ELSE weather_s END AS score, CASE WHEN NOT is_day THEN 'dark' WHEN weather_s >= 0.75 THEN 'good' ELSE worst END AS reason FROM
(SELECT *, power(rain_s, 1.6) * temp_s * gust_s AS weather_s, CASE WHEN rain_s <= temp_s AND rain_s <= gust_s THEN 'rain' WHEN temp_s <= gust_s THEN CASE WHEN coalesce(temp, 99.0) < 14.0 THEN 'cold' ELSE 'heat' END ELSE 'wind' END AS worst FROM {hour_parts})""", query=False)
add("f39_hour_score", "SELECT h, round(score, 6) AS score, reason FROM {hour_scores}")
add("window_hours", "SELECT s.sunset, x.*, coalesce(temp <= 30.0, false) AND weather_s >= 0.55 AS passed FROM {sunset} s JOIN {hour_scores} x ON x.h >= s.sunset - INTERVAL 3 HOUR AND x.h < s.sunset + INTERVAL 1 HOUR", query=False)
add("good_runs", "SELECT sunset, grp, min(h) AS run_start, max(h) + INTERVAL 1 HOUR AS run_end, CAST(count(*) AS BIGINT) AS hours FROM (SELECT *, row_number() OVER (PARTITION BY sunset ORDER BY h) - row_number() OVER (PARTITION BY sunset, passed ORDER BY h) AS grp FROM {window_hours}) WHERE passed GROUP BY sunset, grp", query=False)
add("w12_good_runs", "SELECT sunset, run_start, run_end, hours FROM {good_runs}")
add("w12_best_run", "SELECT sunset, run_start, hours FROM (SELECT *, row_number() OVER (PARTITION BY sunset ORDER BY hours DESC, run_start) AS r FROM {good_runs}) WHERE r = 1")
add("windows", """SELECT sunset, round(avg(weather_s), 3) AS score, round(avg(temp), 1) AS temp_c, round(max(temp), 1) AS max_temp_c, round(coalesce(max(gust), 0.0), 0) AS gust_kmh, round(coalesce(max(pop), 0.0), 0) AS rain_pct,
 CAST(sum(CASE WHEN passed THEN 1 ELSE 0 END) AS BIGINT) AS good_hours, CAST(count(*) AS BIGINT) AS hours, max(temp) <= 30.0 AND min(weather_s) >= 0.55 AS confirmed,
 CASE WHEN max(temp) > 30.0 OR max(temp) IS NULL THEN 'too hot' WHEN min(weather_s) < 0.55 THEN MINBY(worst, round(weather_s, 4) * 1000000.0 + hour(h)) END AS rejection FROM {window_hours} GROUP BY sunset""", query=False)
add("q5_sunset_windows", "SELECT *, CASE WHEN good_hours = hours THEN 'full' WHEN good_hours > 0 THEN 'partial' ELSE 'none' END AS availability FROM {windows}")
add("q6_current_hour", "SELECT h, round(temp, 4) AS temp, round(score, 4) AS score, reason FROM {hour_scores} WHERE h = (SELECT max(h) FROM {forecast} WHERE h <= (SELECT min(h) + INTERVAL 100 HOUR FROM {forecast}))")
# today is the second day of the forecast
_whole = "CAST(CAST({} AS BIGINT) AS STR)"
_rest = f"|| ' · ' || {_whole.format(geo.half_even('temp_c'))} || '°C, ' || {_whole.format('rain_pct')} || '% rain, gusts ' || {_whole.format('gust_kmh')} || ' km/h' AS headline"
add("f40_headline", f"""SELECT sunset, CASE WHEN day0 = today THEN 'Today' WHEN day0 = today + INTERVAL 24 HOUR THEN 'Tomorrow' ELSE date_format(sunset - INTERVAL 3 HOUR, 'EEEE') END || ' ' || date_format(sunset - INTERVAL 3 HOUR, 'HH:mm') || '–' || date_format(sunset + INTERVAL 1 HOUR, 'HH:mm') {_rest}
FROM (SELECT *, date_trunc('day', sunset - INTERVAL 3 HOUR) AS day0 FROM {{windows}}) CROSS JOIN (SELECT min(d) + INTERVAL 24 HOUR AS today FROM {{sunset}})""",
    oracle=f"""SELECT sunset, coalesce({{{{0: 'Today', 1: 'Tomorrow'}}}}[date_diff('day', today, start_at::DATE)], dayname(start_at)) || strftime(start_at, ' %H:%M–') || strftime(end_at, '%H:%M') {_rest}
FROM (SELECT *, sunset - INTERVAL 3 HOUR AS start_at, sunset + INTERVAL 1 HOUR AS end_at FROM {{windows}}) CROSS JOIN (SELECT (min(d) + INTERVAL 1 DAY)::DATE AS today FROM {{sunset}})""".replace("{{0: 'Today', 1: 'Tomorrow'}}", "MAP {{0: 'Today', 1: 'Tomorrow'}}"))

# --- rider profile --------------------------------------------------------------------------------------------------------------
TASTE = ("curviness", "leaned_share", "speed_mean", "band_share", "elev_mean")
add("taste_values", " UNION ALL ".join(f"SELECT seg_id, '{f}' AS feature, nullif({f}, 0.0) AS v, length_m FROM {{seg}}" for f in TASTE), query=False)
add("baseline", "SELECT feature, sum(v * length_m) / sum(length_m) AS mu, sqrt(greatest(0.0, sum(v * v * length_m) / sum(length_m) - power(sum(v * length_m) / sum(length_m), 2))) AS sd FROM {taste_values} WHERE v IS NOT NULL GROUP BY feature", query=False)
add("a18_crowd_baseline", "SELECT feature, round(mu, 5) AS mu, round(CASE WHEN sd = 0 THEN 1.0 ELSE sd END, 5) AS sd FROM {baseline}")
add("rider_segments", "SELECT seg_id, ((seg_id * 31) % 97) * 10.0 AS metres FROM {seg} WHERE seg_id % 3 = 0", query=False)
add("rider_means", "SELECT t.feature, sum(coalesce(t.v, 0.0) * r.metres) / sum(r.metres) AS mean FROM {taste_values} t JOIN {rider_segments} r ON r.seg_id = t.seg_id GROUP BY t.feature", query=False)
add("a19_rider_mean", "SELECT feature, round(mean, 6) AS mean FROM {rider_means}")
add("f49_softmax_weights", "SELECT feature, round(z, 6) AS z, round(exp(greatest(-4.0, least(4.0, z)) / 0.6) / sum(exp(greatest(-4.0, least(4.0, z)) / 0.6)) OVER (), 6) AS w FROM (SELECT m.feature, (m.mean - b.mu) / coalesce(nullif(b.sd, 0.0), 1.0) AS z FROM {rider_means} m JOIN {baseline} b ON b.feature = m.feature)")
add("style_ratios", "SELECT r.cell, r.lean_p95 / c.lean_p95 AS ratio FROM {a4_rider_cells} r JOIN {a2_cell_aggregate} c ON c.cell = r.cell WHERE r.n >= 5 AND c.lean_p95 >= 5.0", query=False)
add("j4_rider_vs_crowd", "SELECT cell, round(ratio, 6) AS ratio FROM {style_ratios}")
global_pick("style_median", "style_ratios", "ratio", "cell", "(CAST(floor(n / 2.0) AS BIGINT) + 1)", "style_ratio", 50.0, "TRUE", "0.9")
add("style", "SELECT m.style_ratio, n.basis FROM {style_median} m CROSS JOIN (SELECT CAST(count(*) AS BIGINT) AS basis FROM {style_ratios}) n", query=False)
add("a10_style_ratio", "SELECT round(style_ratio, 6) AS style_ratio, basis FROM {style}")
# the first curviness up to which nine tenths of the rider's metres lie: ranges of one, then the values of a range
add("rider_curve_values", "SELECT s.curviness AS v, CAST(floor(s.curviness) AS BIGINT) AS b, sum(r.metres) AS m FROM {rider_segments} r JOIN {seg} s ON s.seg_id = r.seg_id WHERE r.metres > 0 GROUP BY s.curviness", query=False)
add("rider_curve_ranges", "SELECT b, upto - m AS since, total FROM (SELECT b, m, sum(m) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(m) OVER () AS total FROM (SELECT b, sum(m) AS m FROM {rider_curve_values} GROUP BY b)) WHERE upto >= 0.9 * total AND upto - m < 0.9 * total", query=False)
add("rider_curves", "SELECT min(CASE WHEN since + acc >= 0.9 * total THEN v END) AS rider_p90 FROM (SELECT x.v, g.since, g.total, sum(x.m) OVER (PARTITION BY x.b ORDER BY x.v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS acc FROM {rider_curve_values} x JOIN {rider_curve_ranges} g ON g.b = x.b)", query=False,
    oracle=f"SELECT min(CASE WHEN acc >= 0.9 * total THEN curviness END) AS rider_p90 FROM (SELECT s.curviness, sum(r.metres) OVER (ORDER BY s.curviness, s.seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS acc, sum(r.metres) OVER () AS total FROM {{rider_segments}} r JOIN {{seg}} s ON s.seg_id = r.seg_id WHERE r.metres > 0)")
global_pick("crowd_curves", "seg", "curviness", "seg_id", ranked(0.9), "crowd_p90")
add("rider_trips", "SELECT * FROM {a3_trip_aggregate} WHERE trip % 3 = 0", query=False)
add("experience", "SELECT 0.3 * ln(1.0 + t.km / 500.0) + 0.3 * ln(1.0 + t.n / 20.0) + 0.2 * (q.lean_p95 / 35.0) + 0.2 * (r.rider_p90 / greatest(c.crowd_p90, 0.000001)) AS s FROM (SELECT sum(dist_m) / 1000.0 AS km, count(*) AS n FROM {rider_trips}) t CROSS JOIN {a5_rider_quantiles} q CROSS JOIN {rider_curves} r CROSS JOIN {crowd_curves} c", query=False)
add("f45_experience", f"SELECT round(s, 3) AS score, {S.experience_gate('s')} AS level, {S.alpha_max('s')} AS alpha_max FROM {{experience}}")
add("f46_bike_class", f"SELECT trip, {S.bike_class('rpm', 'spd')} AS bike FROM (SELECT trip, avg(nullif(rpm, 0.0)) AS rpm, avg(nullif(speed, 0.0)) AS spd FROM {{tele}} GROUP BY trip)")
add("f47_lean_ceiling", f"SELECT round(q.lean_p95 * b.margin / greatest(s.style_ratio, 0.3), 4) AS ceiling, round(q.lean_p95 * b.margin / greatest(s.style_ratio, 0.3) * 0.7, 4) AS ceiling_wet, round(q.lean_p95 * 1.15, 4) AS ceiling_light FROM {{a5_rider_quantiles}} q CROSS JOIN {{style}} s CROSS JOIN (SELECT {S.lookup(S.bike_class('rpm_mean', 'speed_mean'), S.BIKE_MARGIN, 1.05)} AS margin FROM {{a5_rider_quantiles}}) b")
add("starts", "SELECT trip, round(lat, 2) AS glat, round(lon, 2) AS glon, lat, lon, hour(ts) AS h FROM (SELECT *, row_number() OVER (PARTITION BY trip ORDER BY ts, event_id) AS r FROM {tele}) WHERE r = 1 AND trip % 3 = 0", query=False)
add("a20_usual_hour", "SELECT h, n FROM (SELECT CAST(h AS BIGINT) AS h, CAST(count(*) AS BIGINT) AS n, row_number() OVER (ORDER BY count(*) DESC, h) AS r FROM {starts} GROUP BY h) WHERE r = 1")
add("home", "SELECT glat, glon, lat, lon, n FROM (SELECT glat, glon, round(avg(lat), 7) AS lat, round(avg(lon), 7) AS lon, CAST(count(*) AS BIGINT) AS n, row_number() OVER (ORDER BY count(*) DESC, glat, glon) AS r FROM {starts} GROUP BY glat, glon) WHERE r = 1", query=False)
add("a20_home", "SELECT round(glat, 2) AS glat, round(glon, 2) AS glon, lat, lon, n FROM {home}")
add("q1_trip_summary", "SELECT CAST(count(*) AS BIGINT) AS trips, round(sum(dist_m) / 1000.0, 4) AS km, round(max(dist_m) / 1000.0, 4) AS longest_km, round(max(lean_max), 4) AS max_lean, max(speed_max) AS max_speed, max(elev_max) AS max_altitude FROM {rider_trips}")
global_pick("middle_ride", "rider_trips", "(t1 - t0) / 60000.0", "trip", "(CAST(floor(n / 2.0) AS BIGINT) + 1)", "minutes")
add("median_ride", "SELECT least(300.0, greatest(30.0, minutes)) AS minutes FROM {middle_ride}", query=False, oracle="SELECT least(300.0, greatest(30.0, max(CASE WHEN r = CAST(floor(n / 2.0) AS BIGINT) + 1 THEN minutes END))) AS minutes FROM (SELECT (t1 - t0) / 60000.0 AS minutes, row_number() OVER (ORDER BY t1 - t0, trip) AS r, count(*) OVER () AS n FROM {rider_trips})")
add("q2_full_profile", """SELECT t.trips, t.km, t.longest_km, t.max_lean, e.score AS experience_score, e.level, e.alpha_max, f.ceiling AS lean_ceiling, round(s.style_ratio, 6) AS style_ratio, s.basis, m.minutes AS median_minutes, u.h AS usual_hour, h.lat AS home_lat, h.lon AS home_lon
FROM {q1_trip_summary} t CROSS JOIN {f45_experience} e CROSS JOIN {f47_lean_ceiling} f CROSS JOIN {style} s CROSS JOIN {median_ride} m CROSS JOIN {a20_usual_hour} u CROSS JOIN {a20_home} h""")
add("light_samples", "SELECT trip, abs(lean) AS l, v, rpm, gear, d_ok FROM {moved} WHERE v > 0 AND v < 200", query=False)
add("q3_light_profile", f"""SELECT x.trip, round(x.lean_p95, 1) AS lean_p95, round(y.km, 4) AS km, round(y.v_mean, 4) AS v_mean, round(y.rpm_mean, 4) AS rpm_mean, y.top_gear, {S.bike_class('y.rpm_mean', 'y.v_mean')} AS bike, round(least(1.0, x.lean_p95 / 42.0) * 0.6 + least(1.0, y.km * 1000.0 / 4000000.0) * 0.4, 4) AS score,
 CASE WHEN least(1.0, x.lean_p95 / 42.0) * 0.6 + least(1.0, y.km * 1000.0 / 4000000.0) * 0.4 >= 0.75 THEN 'advanced' WHEN least(1.0, x.lean_p95 / 42.0) * 0.6 + least(1.0, y.km * 1000.0 / 4000000.0) * 0.4 >= 0.45 THEN 'intermediate' ELSE 'novice' END AS level
FROM (SELECT trip, {picked('l', 0.95)} AS lean_p95 FROM (SELECT trip, l, row_number() OVER (PARTITION BY trip ORDER BY l) AS r, count(*) OVER (PARTITION BY trip) AS n FROM {{light_samples}} WHERE v > 20) GROUP BY trip) x
JOIN (SELECT trip, sum(v / 3.6 * 3.0) / 1000.0 AS km, avg(CASE WHEN v > 20 THEN v END) AS v_mean, avg(CASE WHEN v > 20 AND rpm > 500 THEN rpm END) AS rpm_mean, max(CASE WHEN v > 20 AND gear > 0 THEN gear END) AS top_gear FROM {{light_samples}} GROUP BY trip) y ON y.trip = x.trip""")

# --- replay -----------------------------------------------------------------------------------------------------------------------
add("replay_base", "SELECT trip, min(t_ms) AS t0, max(t_ms) AS t1, sum(d_ok) AS dist_m, sum(CASE WHEN v_ok > 5 THEN dt / 1000.0 ELSE 0.0 END) AS moving_s, max(CASE WHEN v_ok > 15 THEN abs(lean) END) AS max_lean, CAST(sum(CASE WHEN v_ok > 15 THEN 1 ELSE 0 END) AS BIGINT) AS n_moving, CAST(sum(CASE WHEN v_ok > 15 AND abs(lean) >= 15.0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaned FROM {moved} GROUP BY trip", query=False)
add("replay_climb", "SELECT trip, sum(CASE WHEN d > 1.0 THEN d ELSE 0.0 END) AS climb FROM (SELECT trip, smooth - lag(smooth) OVER (PARTITION BY trip ORDER BY rn) AS d FROM (SELECT trip, rn, CASE WHEN n >= 15 THEN avg(elev) OVER (PARTITION BY trip ORDER BY rn ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) ELSE elev END AS smooth FROM (SELECT *, count(*) OVER (PARTITION BY trip) AS n FROM {tele} WHERE elev > 0))) GROUP BY trip", query=False)
add("replays", """SELECT b.trip, round(b.dist_m / 1000.0, 4) AS km, round((b.t1 - b.t0) / 60000.0, 4) AS minutes, round(b.moving_s / 60.0, 4) AS moving_minutes, round(b.max_lean, 4) AS max_lean, round(100.0 * (b.n_leaned / greatest(b.n_moving / greatest(b.moving_s, 0.000001), 0.000001)) / greatest(b.moving_s, 0.000001), 4) AS leaned_pct,
 round(coalesce(l.lean_delta, 0.0) / greatest(b.dist_m / 1000.0, 0.000001), 4) AS curviness, round(coalesce(s.top, 0.0), 4) AS top_speed, coalesce(k.hard_braking, 0) AS hard_braking, round(coalesce(c.climb, 0.0), 4) AS climb_m
FROM {replay_base} b LEFT JOIN {w6_moving_lean} l ON l.trip = b.trip LEFT JOIN {a30_sustained_speed} s ON s.trip = b.trip LEFT JOIN {w11_brake_events} k ON k.trip = b.trip LEFT JOIN {replay_climb} c ON c.trip = b.trip WHERE b.dist_m >= 500""", query=False)
add("a31_trip_replay", "SELECT * FROM {replays}")
_show = "max_lean / 45.0 * 0.4 + least(climb_m, 1200.0) / 1200.0 * 0.3 + least(km, 150.0) / 150.0 * 0.2 + least(curviness, 400.0) / 400.0 * 0.1"
add("f48_showcase_score", f"SELECT trip, round({_show}, 6) AS score FROM {{replays}}")
add("q7_best_trip", "SELECT trip, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, trip) AS r FROM {f48_showcase_score}) WHERE r = 1")
