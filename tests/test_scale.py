"""What keeps queries within memory and time on larger tables."""

import pytest

from wayfold import catalog


def joins(frame) -> int:
    """Joins in a frame's plan."""
    return frame._jdf.queryExecution().optimizedPlan().toString().count("Join ")


# of a line's points, nothing meets by a range: what is left are joins with one row for each line
@pytest.mark.parametrize("name, most", [("k5_corner_rhythm", 0), ("y4_interpolate", 0), ("y3_curviness", 1), ("y5_turn_candidates", 0), ("y5_turns", 1)])
def test_points_of_lines_need_no_join(name, most, spark, sf):
    assert joins(catalog.QUERIES[name](spark, sf)) <= most


def test_chains_leave_rings_early_and_broadcast_nothing(spark, monkeypatch):
    """A ring ends once its least segment is known all around, however many segments there are, and no join is by broadcast."""
    from wayfold.operators import graph

    cuts, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: cuts.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    loose = [(1000 + i, 10 * i + 100, 10 * i + 101) for i in range(500)]
    ring = [(7, 1, 2), (3, 2, 3), (9, 3, 1)]
    got = {r.seg_id: (r.chain, r.position, r.ring) for r in graph.ordered_chains(spark.createDataFrame(loose + ring, "seg_id long, node_a long, node_b long")).collect()}
    assert {s: got[s] for s, _, _ in ring} == {7: (3, 0, True), 3: (3, 1, True), 9: (3, 2, True)} and len(got) == 503
    assert len(cuts) <= 9  # with twelve rounds for a ring before
    assert not any("Broadcast" in plan for plan in cuts)


def test_pooled_chains_broadcast_nothing(spark, sf):
    plan = catalog.QUERIES["r2_chains"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == plan.count("rightHint=(strategy=merge)") > 0


# the network stays where it is: no query collects it
@pytest.mark.parametrize("name", ["r3_shortest_costs", "r6_paths", "r7_fixed_alphas", "r8_motorway_free", "r9_time_budget", "r13_alternatives", "r14_heatmap", "l6_distinct_routes"])
def test_the_driver_holds_no_network(name, spark, sf, monkeypatch):
    from wayfold.operators import search

    monkeypatch.setattr(search, "network", lambda *a: pytest.fail("the driver collects the network"))
    assert catalog.QUERIES[name](spark, sf).count()


def test_parts_of_a_network_give_the_routes_of_the_whole(spark, monkeypatch):
    """Searches that leave the first squares get more of them; settled regions are one heap over the whole, ties and seconds too."""
    import random

    from wayfold.operators import graph, search

    rng = random.Random(5)
    rows = []
    for k in range(400):  # a lattice of 20 by 20, a tenth of a degree apart
        for other in ([k + 1] if k % 20 < 19 else []) + ([k + 20] if k < 380 else []):
            rows.append((len(rows), k, other, 100.0, float(rng.randint(1, 6)), rng.random(), 0.1, rng.random() < 0.1, k // 20 * 0.1, k % 20 * 0.1, other // 20 * 0.1, other % 20 * 0.1))
    seg = spark.createDataFrame(rows, "seg_id long, node_a long, node_b long, length_m double, seconds double, value double, risk double, oneway boolean, lat_a double, lon_a double, lat_b double, lon_b double")
    whole = search.Network(seg.toPandas())
    asked = spark.createDataFrame([(0, 0, 399, None), (1, 210, 214, None), (2, 5, 77, None), (3, 5, 9999, None)], "request long, start long, goal long, minutes double")
    key = ["request", "label", "pos"]
    part = search.plan(asked, seg, "destination").toPandas().sort_values(key).reset_index(drop=True)
    assert part.equals(search.plan(asked, whole, "destination").toPandas().sort_values(key).reset_index(drop=True)) and set(part["request"]) == {0, 1, 2}
    monkeypatch.setattr(graph.settled, "__defaults__", (40, 1000))
    starts, key = asked.where("request < 2"), ["request", "node"]
    far = search.costs_from(starts, seg, junctions=True, alpha=2.0, used=frozenset(range(50)), reuse=4.0).toPandas().sort_values(key).reset_index(drop=True)
    assert far.equals(search.costs_from(starts, whole, junctions=True, alpha=2.0, used=frozenset(range(50)), reuse=4.0).toPandas().sort_values(key).reset_index(drop=True)) and len(far) == 800


# floods go from region to region, not from hop to hop by rounds of joins
@pytest.mark.parametrize("name", ["r3_flood_costs", "k2_turn_costs"])
def test_floods_take_no_round_for_each_hop(name, spark, sf, monkeypatch):
    from wayfold.operators import graph

    monkeypatch.setattr(graph, "floods", lambda *a: pytest.fail("a round of joins for each hop"))
    cuts, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: cuts.append(1) or cut(df))
    assert catalog.QUERIES[name](spark, sf).count() and len(cuts) <= 4


def test_lakes_meet_places_not_viewpoints(spark):
    """Lakes and viewpoints that share their places meet once for each place: the first viewpoint of the nearest place, within 8 km."""
    from wayfold.plans.relation import CATALOG

    poi = spark.createDataFrame([(i, "lake", 47.6 + i % 2 * 0.01, 11.3) for i in range(6)] + [(9, "lake", 50.0, 11.3)], "poi_id long, kind string, lat double, lon double")
    seen = spark.createDataFrame([(100 + i, 47.6 + i % 3 * 0.01, 11.31) for i in range(9)], "poi_id long, lat double, lon double")
    frames = {"poi": poi, "viewpoint_ok": seen}
    assert CATALOG.build("lake_places", spark, "", dict(frames)).count() == 3 and CATALOG.build("viewpoint_places", spark, "", dict(frames)).count() == 3
    assert {tuple(r) for r in CATALOG.build("lake_targets", spark, "", dict(frames)).select("poi_id", "target").collect()} == {(i, 100 + i % 2) for i in range(6)}
