"""The engine's entry points: one function for each thing a client asks for. ``sf_dir`` is a folder of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import load, planning, search
from wayfold.plans.relation import CATALOG

load()


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Any relation by name."""
    return CATALOG.build(name, spark, sf_dir)


def top_segments(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    return relation(spark, sf_dir, "scored").select("seg_id", "scenic", "fun", "risk").orderBy(F.desc("scenic"), "seg_id").limit(k)


def cell_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "p13_graph_gate")


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "l2_coverage_sample")


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "q2_full_profile")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "q5_sunset_windows")


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "replays")


def pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "poi_scores")


def terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "j17_terrain")


def plan(spark: SparkSession, sf_dir: str, mode: str, start: int, goal: int | None = None, minutes: float | None = None, network: str = "segments", **options) -> DataFrame:
    """Routes by one of the planners (destination, avoiding, budgeted, round_trip, alternatives, greedy, heatmap, scenic_loop) on
    segments, roads or cells."""
    if mode == "scenic_loop":
        rider = options.pop("rider", "A")
        return search.scenic_loops(planning._requests(spark, (start, None, minutes)), planning._roads(spark, sf_dir), planning._stops(spark, sf_dir, rider), **options)
    if mode not in search.PLANNERS:
        raise ValueError(f"no planner is named {mode}")
    net = {"segments": planning._net, "roads": planning._roads, "cells": planning._cells}[network](spark, sf_dir)
    return search.plan(planning._requests(spark, (start, goal, minutes)), net, mode, **options)


def cell_route(spark: SparkSession, sf_dir: str, start: int, goal: int, minutes: float | None = None) -> DataFrame:
    """A way between two cells, at fixed alphas or within a budget."""
    if minutes is None:
        return plan(spark, sf_dir, "destination", start, goal, network="cells")
    return plan(spark, sf_dir, "budgeted", start, goal, minutes, network="cells", most=8.0, tolerance=0.0, junctions=False)


def cell_joyride(spark: SparkSession, sf_dir: str, start: int, minutes: float) -> DataFrame:
    return plan(spark, sf_dir, "round_trip", start, minutes=minutes, network="cells", kind="cell")


def heatmap(spark: SparkSession, sf_dir: str, start: int, goal: int) -> tuple[DataFrame, DataFrame]:
    """Sampled routes, and how much of them each segment carries."""
    routes = plan(spark, sf_dir, "heatmap", start, goal)
    used = routes.join(relation(spark, sf_dir, "scored").select("seg_id", "scenic", "length_m"), "seg_id").groupBy("seg_id").agg(F.sum(F.col("scenic") * F.col("length_m")).alias("w"))
    return routes, used.crossJoin(F.broadcast(used.agg(F.max("w").alias("top")))).select("seg_id", F.round(F.col("w") / F.col("top"), 5).alias("weight"))


def sorted_routes(routes: DataFrame, by: str = "value") -> DataFrame:
    """One row for each route, best first by one of its figures."""
    return routes.groupBy("request", "label", "alpha").agg(*[F.first(c).alias(c) for c in ("km", "minutes", "value", "risk")]).orderBy(F.desc(by), "label")
