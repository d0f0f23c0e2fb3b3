import json

import pytest

from wayfold import sources, streaming


def test_telemetry(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "t1.csv").write_text("timestampinmillis,positionmapmatchedlatitude,positionmapmatchedlongitude,sensorsbankingangle,extra\n1000,47.7,11.5,12.0,x\n2000,0,0,1,x\nbad,47.7,11.5,1,x\n3000,47.7,11.6,oops,x\n")
    rows = sources.telemetry(spark, str(tmp_path)).orderBy("t_ms").collect()
    assert [(r.t_ms, r.lean) for r in rows] == [(1000, 12.0), (3000, None)]
    assert rows[0].trip.endswith("t1.csv") and rows[0].speed is None
    assert sources.telemetry(spark, str(tmp_path), bbox=(47, 11, 48, 11.55)).count() == 1


def test_telemetry_by_name(spark, tmp_path):
    """Files with other columns, in another order."""
    (tmp_path / "__MACOSX").mkdir()
    (tmp_path / "__MACOSX" / "x.csv").write_text("timestampinmillis,positionmapmatchedlatitude\n1,2\n")
    (tmp_path / "a.csv").write_text("timestampinmillis,positionmapmatchedlatitude,positionmapmatchedlongitude,sensorsbankingangle\n1000,47.7,11.5,12\n")
    (tmp_path / "b.csv").write_text("sensorsbankingangle,ridinggear,positionmapmatchedlongitude,timestampinmillis,positionmapmatchedlatitude\n-3,4,11.6,2000,47.8\n")
    rows = sources.telemetry(spark, str(tmp_path)).orderBy("t_ms").collect()
    assert [(r.t_ms, r.lat, r.lon, r.lean, r.gear) for r in rows] == [(1000, 47.7, 11.5, 12.0, None), (2000, 47.8, 11.6, -3.0, 4)]
    assert [f.rsplit("/", 1)[1] for f in sources.discover(spark, str(tmp_path), str(tmp_path))] == ["a.csv", "b.csv"] and len(sources.discover(spark, str(tmp_path), limit=1)) == 1
    (tmp_path / "none").mkdir()
    assert sources.telemetry(spark, str(tmp_path / "none")).count() == 0


def test_telemetry_of_archives(spark, tmp_path):
    """Members of archives beside files, each with its own header; broken rows, an empty file, a byte order mark."""
    import zipfile

    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in" / "up.zip", "w") as z:
        z.writestr("day/one.csv", "sensorsbankingangle,timestampinmillis,positionmapmatchedlatitude,positionmapmatchedlongitude\n5,1,47.1,11\n6,2,47.2,11,extra\n7,3,47.3,11\n")
        z.writestr("__MACOSX/day/one.csv", "timestampinmillis,positionmapmatchedlatitude,positionmapmatchedlongitude\n1,47,11\n")
        z.writestr("notes.txt", "timestampinmillis\n1\n")
    (tmp_path / "in" / "two.csv").write_text('\ufeff"timestampinmillis",positionmapmatchedlatitude,positionmapmatchedlongitude\r\n4,48.1,"11.5"\r\n', encoding="utf-8")
    (tmp_path / "in" / "none.csv").write_text("")
    (tmp_path / "in" / "head.csv").write_text("timestampinmillis,positionmapmatchedlatitude,positionmapmatchedlongitude\n")
    got = sources.telemetry(spark, str(tmp_path / "in"))
    rows = sorted((r.t_ms, r.lat, r.lon, r.lean, r.trip.rsplit("/", 1)[-1].split("!")[0]) for r in got.collect())
    assert rows == [(1, 47.1, 11.0, 5.0, "one.csv"), (3, 47.3, 11.0, 7.0, "one.csv"), (4, 48.1, 11.5, None, "two.csv")]
    assert sum("up.zip!day/one.csv" in r.trip for r in got.collect()) == 2
    assert sources.telemetry(spark, str(tmp_path / "in"), str(tmp_path / "in")).count() == 3
    assert "BinaryFile" in got._jdf.queryExecution().toString() or "binaryFile" in got._jdf.queryExecution().toString()


def test_turns_and_coordinates(spark):
    from wayfold.operators.terrain import check_coordinates, turns

    look = spark.createDataFrame([(1, k, t) for k, t in [(3, 60.0), (4, 150.0), (6, 149.0), (8, 140.0), (9, 70.0), (20, 55.0), (21, 20.0)]] + [(2, 5, 30.0)], "way_id long, k long, t double")
    lines = spark.createDataFrame([(1, 2000.0), (2, 900.0)], "way_id long, total double")
    got = {r.way_id: tuple(r)[1:] for r in turns(look, lines).collect()}
    assert got == {1: (3, 1, 15.0, 150.0), 2: (0, 0, 0.0, 0.0)}
    assert check_coordinates([[47, 11], (48.5, -11)]) == [(47.0, 11.0), (48.5, -11.0)]
    for bad in ([], [[1, 2]], [[1, 2], [float("nan"), 1]], [[1, 2], [91, 0]], [[1, 2], "x"], [[1, 2]] * 20_001, None):
        with pytest.raises(ValueError):
            check_coordinates(bad)


def test_cached_and_recovered(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(2)

    for _ in range(2):
        assert sources.cached(spark, "k", str(tmp_path), make).count() == 2
    assert len(made) == 1
    assert sources.cached(spark, "k", str(tmp_path), make, version=2).count() == 2 and len(made) == 2
    path = tmp_path / "out"
    sources.publish(spark.range(3), str(path))
    sources.publish(spark.range(4), str(path))
    path.rename(tmp_path / "out.old")  # as a crash between the two renames leaves it
    sources.recover(spark, str(path))
    assert spark.read.parquet(str(path)).count() == 4
    assert [sources.forecast_policy(100.0, f, e, 50.0, 60.0) for f, e in ((60.0, None), (10.0, None), (10.0, 90.0), (None, 90.0), (None, None), (10.0, 30.0))] == ["cache", "live", "stale", "none", "live", "live"]


def test_forecast_is_served(spark, tmp_path):
    calls = []

    def fetch(temp, fails=False):
        def run():
            calls.append(temp)
            if fails:
                raise OSError("no network")
            return json.dumps({"hourly": {"time": ["2024-05-01T10:00"], "temperature_2m": [temp], "precipitation_probability": [3], "precipitation": [0], "wind_gusts_10m": [12], "weather_code": [1], "is_day": [1]}})
        return run

    def served(now, temp, fails=False):
        frame, label = sources.served_forecast(spark, str(tmp_path / "f"), fetch(temp, fails), now, ttl=100.0, cooldown=60.0)
        return label, [r.temp for r in frame.collect()]

    assert served(0, 1.0, True) == ("none", []) and served(10, 1.0) == ("none", [])  # still cooling down
    assert served(70, 2.0) == ("live", [2.0]) and served(150, 3.0) == ("cache", [2.0])
    assert served(200, 4.0, True) == ("stale", [2.0]) and served(210, 4.0) == ("stale", [2.0])
    assert served(270, 5.0) == ("live", [5.0]) and calls == [1.0, 2.0, 4.0, 5.0]


def test_ways_and_forecast(spark, tmp_path):
    way = {"id": 1, "type": "way", "geometry": [{"lat": 1.0, "lon": 2.0}], "tags": {"highway": "primary"}}
    (tmp_path / "1.json").write_text(json.dumps({"elements": [way, {"id": 3, "type": "node"}]}))
    (tmp_path / "2.json").write_text(json.dumps([way | {"tags": {"highway": "trunk"}}]))
    rows = sources.ways(spark, str(tmp_path / "1.json"), str(tmp_path / "2.json")).collect()
    assert [(r.id, r.tags["highway"]) for r in rows] == [(1, "trunk")]
    (tmp_path / "f.json").write_text(json.dumps({"hourly": {"time": ["2024-05-01T10:00"], "temperature_2m": [20.5], "precipitation_probability": [3], "precipitation": [0], "wind_gusts_10m": [12], "weather_code": [1], "is_day": [1]}}))
    assert sources.forecast(spark, str(tmp_path / "f.json")).first().temp == 20.5


def test_publish_keeps_the_old_result(spark, tmp_path):
    path = str(tmp_path / "out")
    sources.publish(spark.range(3).toDF("id"), path)
    with pytest.raises(ValueError):
        sources.publish(spark.range(0).toDF("id"), path)
    assert spark.read.parquet(path).count() == 3
    assert sources.signature(path, spark) == sources.signature(path, spark)


def test_streams(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    samples = events.selectExpr("ts", "user_id AS trip", "47.6 + user_id % 3 * 0.1 AS lat", "11.5 AS lon", "value AS speed", "value AS lean")
    q = streaming.cell_traffic(samples, "1 day").writeStream.format("memory").queryName("traffic").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM traffic").first()[0] == spark.read.schema(schema).parquet(f"{sf}/events.parquet").count()
