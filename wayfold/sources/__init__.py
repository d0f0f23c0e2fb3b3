"""Sources and sinks: telemetry CSV lakes, road tiles, points of interest, forecasts, and Parquet artefacts."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a telemetry file that are read; files may have more, in any order.
TELEMETRY = {
    "timestampinmillis": "t_ms bigint", "positionmapmatchedlatitude": "lat double", "positionmapmatchedlongitude": "lon double", "positionmapmatchedheading": "hdg double",
    "positionrawelevation": "elev double", "ridingvehiclespeed": "speed double", "ridingabsbraking": "absb bigint", "ridingenginespeed": "rpm double", "ridinggear": "gear bigint",
    "ridingthrottlevalue": "throttle double", "sensorsbankingangle": "lean double", "sensorsaccelerationlongitudinal": "acc double", "sensorsoutsidetemperature": "temp double",
}


def discover(spark: SparkSession, *paths: str, pattern: str = "*.csv", limit: int | None = None) -> list[str]:
    """Files under folders, each once, in order; leftovers of archives are passed over. Reads names alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(list(paths))
    names = files.select("path").where(~F.col("path").contains("__MACOSX")).distinct().orderBy("path")
    return [r[0] for r in (names.limit(limit) if limit else names).collect()]


def _csv_columns(data: bytes, wanted: list[str]):
    """The wanted columns of a CSV file as texts, by the names in its first line; those it lacks are null. None without a header."""
    import pyarrow as pa
    from pyarrow import csv

    head, _, body = data.decode("utf-8-sig", "replace").partition("\n")
    names = [c.strip().strip('"').strip().lower() for c in head.strip().split(",")]
    if "timestampinmillis" not in names:
        return None
    if not body.strip():
        return pa.table({c: pa.array([], pa.string()) for c in wanted})
    options = csv.ConvertOptions(include_columns=wanted, include_missing_columns=True, column_types=dict.fromkeys([*wanted, *names], pa.string()), strings_can_be_null=False)
    return csv.read_csv(pa.BufferReader(body.encode()), csv.ReadOptions(column_names=names, use_threads=False), csv.ParseOptions(invalid_row_handler=lambda _: "skip"), options)


def telemetry(spark: SparkSession, *paths: str, bbox: tuple | None = None) -> DataFrame:
    """Samples of CSV files, and of those in zip archives, found recursively; bad numbers are null, a row without time or place
    is dropped, and the trip is the file, or the archive and its member. Columns are matched by name, file by file: each may
    lack columns, have others, and have them in any order; rows with too many or too few values are left out.

    One scan: files are rows to Spark, and a task reads each with its own header. A file is held whole, up to 2 GB."""
    import pyarrow as pa

    wanted = list(TELEMETRY)

    def members(path: str, content: bytes):
        if not path.lower().endswith(".zip"):
            yield path, content
            return
        import io
        import zipfile

        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for name in archive.namelist():
                if name.lower().endswith(".csv") and "__MACOSX" not in name:
                    yield f"{path}!{name}", archive.read(name)

    def read(batches):
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"]):
                for trip, data in members(path, content.as_py()):
                    table = _csv_columns(data, wanted)
                    if table is not None and len(table):
                        for part in table.to_batches(max_chunksize=50_000):
                            yield pa.RecordBatch.from_arrays([pa.array([trip] * len(part), pa.string()), *part.columns], names=["trip", *wanted])

    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.{csv,CSV,zip,ZIP}").load(list(paths))
    files = files.where(~F.col("path").contains("__MACOSX")).select("path", "content").dropDuplicates(["path"]) if len(paths) > 1 else files.where(~F.col("path").contains("__MACOSX")).select("path", "content")
    raw = files.mapInArrow(read, "trip string, " + ", ".join(f"{c} string" for c in wanted))
    columns = [F.expr(f"try_cast(try_cast({source} AS DOUBLE) AS {spec.split()[1]})").alias(spec.split()[0]) for source, spec in TELEMETRY.items()]
    out = raw.select("trip", *columns).where("t_ms IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat = 0 AND lon = 0)")
    if bbox:
        south, west, north, east = bbox
        out = out.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    return out


#: Folders of published segments are cells of this level: about 40 km wide.
COARSE = 10


def by_coarse_cell(segments: DataFrame) -> DataFrame:
    from wayfold.functions import column, geo

    return segments.withColumn("coarse", column(geo.packed("mid_lat", "mid_lon", COARSE)))


def roads(spark: SparkSession, path: str, bbox: tuple | None = None) -> DataFrame:
    """Published segments; with a box those whose middle lies in it, from the folders that it meets alone."""
    found = spark.read.parquet(path)
    if bbox:
        n, (south, west, north, east) = 1 << COARSE, bbox
        cell = lambda v, off: int((v + off) / 360 * n)
        cells = [y * n + x for y in range(cell(south, 90), cell(north, 90) + 1) for x in range(cell(west, 180), cell(east, 180) + 1)]
        found = found.where(F.col("coarse").isin(cells)).where(F.col("mid_lat").between(south, north) & F.col("mid_lon").between(west, east))
    return found


def ways(spark: SparkSession, *paths: str) -> DataFrame:
    """Road ways of JSON tiles, each a list or an object with ``elements``; of ways in several tiles the last file's stays."""
    element = "id bigint, type string, geometry array<struct<lat: double, lon: double>>, tags map<string, string>"
    schema = f"elements array<struct<{element.replace('id bigint', 'id: bigint').replace('type string', 'type: string').replace('geometry array', 'geometry: array').replace('tags map', 'tags: map')}>>, {element}"
    raw = spark.read.option("multiLine", True).schema(schema).json(list(paths)).withColumn("file", F.col("_metadata.file_path"))
    wrapped = raw.where("elements IS NOT NULL").select("file", F.inline("elements"))
    found = raw.where("elements IS NULL").select("file", "id", "type", "geometry", "tags").unionByName(wrapped).where("id IS NOT NULL AND geometry IS NOT NULL AND coalesce(type, 'way') = 'way'")
    return found.groupBy("id").agg(F.max_by(F.struct("type", "geometry", "tags"), "file").alias("w")).select("id", "w.geometry", "w.tags")


def points_of_interest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema("name string, kind string, lat double, lon double, weight double, ele string").json(path)


def forecast(spark: SparkSession, path: str) -> DataFrame:
    """Hours of a forecast whose hourly values are parallel arrays."""
    return _hours(spark.read.option("wholetext", True).text(path))


def _hours(texts: DataFrame) -> DataFrame:
    arrays = "time array<string>, temperature_2m array<double>, precipitation_probability array<double>, precipitation array<double>, wind_gusts_10m array<double>, weather_code array<bigint>, is_day array<bigint>"
    raw = texts.select(F.from_json("value", f"hourly struct<{arrays.replace(' array', ': array')}>").alias("j")).select("j.hourly")
    zipped = F.arrays_zip(*[F.col(f"hourly.{c.split()[0]}") for c in arrays.split(", ")])
    x = raw.select(F.explode(zipped).alias("x"))
    return x.select(F.col("x.time").cast("timestamp_ntz").alias("h"), F.col("x.temperature_2m").alias("temp"), F.col("x.precipitation_probability").alias("pop"), F.col("x.precipitation").alias("precip"), F.col("x.wind_gusts_10m").alias("gust"), F.col("x.weather_code").alias("weather_code"), (F.col("x.is_day") == 1).alias("is_day"))


def signature(df_path: str, spark: SparkSession) -> str:
    """A digest of the names, sizes and times of a folder's Parquet files: the key of what is derived from it."""
    files = spark.read.parquet(df_path).select(F.concat_ws("|", "_metadata.file_path", F.col("_metadata.file_size").cast("string"), F.col("_metadata.file_modification_time").cast("string")).alias("f")).distinct()
    return files.agg(F.sha2(F.array_join(F.sort_array(F.collect_set("f")), "\n"), 256)).first()[0]


def publish(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Writes Parquet beside the target and swaps it in; an empty result leaves the old one in place and fails.

    The old result is set aside before the new one takes its name, and goes last: a crash in between leaves both, and the
    next call, or ``recover``, puts it back."""
    spark = df.sparkSession
    path = path.rstrip("/")
    recover(spark, path)
    fresh = f"{path}.{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(fresh)
    fs, new, target, aside = _places(spark, fresh, path, f"{path}.old")
    if spark.read.parquet(fresh).isEmpty():
        fs.delete(new, True)
        raise ValueError("the result is empty; the old one stays")
    if fs.exists(target) and not fs.rename(target, aside):
        raise OSError(f"can't set {path} aside")
    if not fs.rename(new, target):
        fs.rename(aside, target)
        raise OSError(f"can't rename {fresh}")
    fs.delete(aside, True)


def recover(spark: SparkSession, path: str) -> None:
    """Puts back a result that was set aside when nothing has its name, and deletes it otherwise."""
    fs, target, aside = _places(spark, path.rstrip("/"), f"{path.rstrip('/')}.old")
    if fs.exists(aside):
        if fs.exists(target):
            fs.delete(aside, True)
        else:
            fs.rename(aside, target)


def _places(spark: SparkSession, *paths: str) -> tuple:
    own = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return own[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), *own


def cached(spark: SparkSession, key: str, folder: str, make, version: int = 1) -> DataFrame:
    """A derived table, made once for each key and version. One that isn't whole or can't be opened is made again; other
    errors, such as a lost connection, are raised."""
    path = f"{folder.rstrip('/')}/v{version}-{key}"
    fs, done = _places(spark, f"{path}/_SUCCESS")
    if fs.exists(done):
        try:
            return spark.read.parquet(path)
        except AnalysisException:  # no schema can be read: the files are broken
            pass
        except Py4JJavaError as e:
            if "is not a Parquet file" not in str(e) and "CANNOT_READ_FILE_FOOTER" not in str(e):
                raise
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def served_forecast(spark: SparkSession, folder: str, fetch, now: float | None = None, ttl: float = 1800.0, cooldown: float = 60.0) -> tuple[DataFrame, str]:
    """A forecast's hours and where they are from: ``cache`` while fresh, else ``live`` from ``fetch()``, which gives the forecast
    as JSON text; ``stale`` if that fails and there is an old one, and ``none``, without rows, if there isn't.

    The last answer and the times of the last success and failure lie in ``folder``, replaced as a whole."""
    import time

    now = float(time.time() if now is None else now)
    fs, place = _places(spark, f"{folder.rstrip('/')}/_SUCCESS")
    recover(spark, folder)
    fetched, failed, text = tuple(spark.read.parquet(folder).first()) if fs.exists(place) else (None, None, None)
    label = forecast_policy(now, fetched, failed, ttl, cooldown)
    if label == "live":
        try:
            text, fetched, failed = fetch(), now, None
        except Exception:  # whatever a live source fails with, an old answer is better than none
            failed, label = now, "none" if text is None else "stale"
        publish(spark.createDataFrame([(fetched, failed, text)], "fetched double, failed double, text string"), folder)
    return _hours(spark.createDataFrame([(text,)] if text and label != "none" else [], "value string")), label


def forecast_policy(now: float, fetched: float | None, failed: float | None, ttl: float = 1800.0, cooldown: float = 60.0) -> str:
    """What to do with a cached forecast, by seconds: ``cache`` while it is fresh, ``live`` otherwise; within the cooldown after
    a failure ``stale`` if there is any, and ``none`` if not."""
    if fetched is not None and now - fetched <= ttl:
        return "cache"
    if failed is not None and now - failed < cooldown:
        return "stale" if fetched is not None else "none"
    return "live"
