"""Registered relations against DuckDB on the smallest tables: one for each kind of operator; the driver holds all."""

import os

import duckdb
import pytest

from wayfold import catalog

SAMPLE = ["g2_quadkey", "g12_bearing", "g15_piece_distance", "g21_raster_sample", "w1_lag", "w8_median_3", "w11_brake_events", "p5_gap_categories", "a1_transition_aggregate", "a2_cell_aggregate", "a3_trip_aggregate", "a7_nearest_rank", "a13_direction_pooling", "f3_percentile_scaler", "f16_edge_cost", "f49_softmax_weights", "f34_sun_position", "q5_sunset_windows", "j1_snap_cells", "j9_nearest_node", "l8_style_owner", "y4_interpolate", "a31_trip_replay", "y1_junction_split", "y2_subdivide", "y6_elevation_profile", "l9_overlap", "l11_same_routes", "f34_julian_day", "f40_headline", "f41_classify", "r1_components", "r3_shortest_costs", "r2_chains", "r2_chain_order", "r3_flood_costs", "s12_road_segments", "s12_road_crowd", "s12_road_scores", "s12_road_costs", "j3_segment_cells", "a4_rider_cells", "a5_rider_quantiles", "cell_graph_cells", "l2_coverage_sample", "l7_poi_ranks", "l12_seeded_jitter", "q2_full_profile", "j10_box_range", "j11_main_roads", "f26_rider_pace", "k1_kernel_attribution", "k1_kernel_totals", "k2_turn_arcs", "k2_turn_costs", "k3_junction_delay", "k4_congestion", "k5_corner_rhythm", "k6_exposed_risk"]


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_equals_sql(name, spark, sf, duck):
    a, b = catalog.QUERIES[name](spark, sf).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b)
    names = sorted(a.columns)
    a, b = (x[names].sort_values(names).reset_index(drop=True) for x in (a, b))
    for k in names:
        assert ((a[k] == b[k]) | (a[k].isna() & b[k].isna())).all(), k


def test_every_relation_has_sql():
    assert len(catalog.ORACLE_SQL) > 180
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
