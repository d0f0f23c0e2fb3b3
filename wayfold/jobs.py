"""Batch jobs: what a user runs over its own files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold import sources
from wayfold.operators import load
from wayfold.plans.relation import CATALOG


def tile_ways(spark: SparkSession, *tiles: str) -> DataFrame:
    """Ways of road tiles as the road build reads them."""
    tag = lambda k: F.col("tags")[k]
    return sources.ways(spark, *tiles).select(F.col("id").alias("way_id"), "geometry", tag("name").alias("name"), F.coalesce(tag("highway"), F.lit("unclassified")).alias("highway"), F.coalesce(tag("oneway").isin("yes", "1", "true"), F.lit(False)).alias("oneway"), (F.coalesce(tag("tunnel"), F.lit("")) != "").alias("tunnel"))


def samples(spark: SparkSession, *lake: str, bbox: tuple | None = None) -> DataFrame:
    """Telemetry of files as relations read it: a trip is a file, its samples are in order of time."""
    found = sources.telemetry(spark, *lake, bbox=bbox)
    return found.select("trip", F.col("t_ms").alias("event_id"), F.col("t_ms").alias("ts"), "t_ms", F.col("t_ms").alias("rn"), *[c for c in found.columns if c not in ("trip", "t_ms")])


def road_segments(spark: SparkSession, ways: DataFrame, telemetry: DataFrame, raster: DataFrame | None = None) -> DataFrame:
    """Segments with geometry, what the crowd rode on them and terrain: ``road_seg`` with each segment's line.

    ``raster``: r, c, elev of terrain; without it there are no heights."""
    load()
    raster = raster if raster is not None else spark.createDataFrame([], "r long, c long, elev double")
    frames = {"osm_ways": ways, "tele": telemetry, "raster": raster}
    lines = CATALOG.build("road_segments", spark, "", dict(frames)).select("seg_id", "line")
    return CATALOG.build("road_seg", spark, "", dict(frames)).join(lines, "seg_id")


def build_roads(spark: SparkSession, tiles: list[str], lake: list[str], out: str, raster: DataFrame | None = None, bbox: tuple | None = None) -> dict:
    """Tiles and telemetry to two artefacts under ``out``: ``segments``, in folders by coarse cell, and ``adjacency``. Gives
    their sizes, as a report. The old artefacts stay if the result is empty."""
    out = out.rstrip("/")
    sources.publish(sources.by_coarse_cell(road_segments(spark, tile_ways(spark, *tiles), samples(spark, *lake, bbox=bbox), raster)), f"{out}/segments", "coarse")
    segments = sources.roads(spark, f"{out}/segments")
    ends = segments.select(F.col("node_a").alias("node"), "seg_id").unionByName(segments.where("node_b <> node_a").select(F.col("node_b").alias("node"), "seg_id"))
    sources.publish(ends, f"{out}/adjacency")
    row = segments.agg(F.count("*").alias("segments"), F.sum((F.col("n_trips") > 0).cast("long")).alias("ridden"), F.countDistinct("way_id").alias("ways")).first()
    nodes = spark.read.parquet(f"{out}/adjacency").select("node").distinct().count()
    return {"ways": row.ways, "segments": row.segments, "nodes": nodes, "ridden": row.ridden, "ridden_pct": round(100 * (row.ridden or 0) / max(row.segments, 1), 1)}


def scored_roads(spark: SparkSession, path: str) -> DataFrame:
    """Scores and costs of published segments."""
    load()
    return CATALOG.build("road_scored", spark, "", {"road_seg": sources.roads(spark, path)})
