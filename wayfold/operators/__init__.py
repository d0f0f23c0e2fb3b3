"""Operators of the ride analytics engine: relations over telemetry, roads, cells, riders and forecasts."""


def load() -> None:
    """Registers all relations."""
    import importlib

    importlib.import_module("wayfold.plans.derive")
    for name in ("grid", "crowd", "scoring", "riders", "places", "roadbuild", "measures"):
        importlib.import_module(f"wayfold.operators.{name}")
    from wayfold.plans.relation import CATALOG

    CATALOG.share("tele", "moved", "cell_samples", "gaps", "cell_edges", "region_speed", "cells", "edges", "cell_norms", "cell_scores", "lattice", "seg", "node", "degree", "road_runs", "wide_percentiles", "scored", "urban", "roads", "snapped", "snap_points", "chainage", "j9_nearest_node", "poi_roads", "poi_scores", "j12_route_visits", "forecast", "steps", "a2_cell_aggregate", "road_segments", "road_snapped")
