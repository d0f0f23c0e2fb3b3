"""Planners on hand-built networks."""

import math
import random

import pandas as pd

from wayfold.functions import geo
from wayfold.operators import graph, search


def corridors() -> search.Network:
    """Four ways of 20 segments between nodes 0 and 1: motorway, winding, straight, jammed."""
    rows, node, sid = [], 2, 0
    for highway, seconds, value, risk in (("motorway", 4.0, 0.02, 0.0), ("secondary", 6.0, 0.9, 0.0), ("secondary", 6.0, 0.3, 0.0), ("secondary", 6.0, 0.3, 0.9)):
        at = 0
        for k in range(20):
            to = 1 if k == 19 else node
            rows.append((sid, at, to, 100.0, seconds, value, risk, False, highway))
            at, node, sid = to, node + (k < 19), sid + 1
    return search.Network(pd.DataFrame(rows, columns=["seg_id", "node_a", "node_b", "length_m", "seconds", "value", "risk", "oneway", "highway"]))


def test_corridors():
    net = corridors()
    (_, _, fast), _, (_, _, fine) = search.destination(net, 0, 1)
    assert net.seg.highway[fast[0]] == "motorway" and fine[0] == 20
    assert search.avoiding(net, 0, 1, 0.0)[0][2][0] == 20
    assert (net.costs(3.0) > 0).all() and net.costs(1.0)[60] > net.costs(1.0)[40]
    found = search.alternatives(net, 0, 1)
    assert len(found) == 3 and sorted((search.kpis(net, f[2])["value"] for f in found), reverse=True) == [search.kpis(net, f[2])["value"] for f in found]
    assert len(search.greedy(net, 0, 1)) == 2  # the motorway, then the winding way


def test_shortest_equals_relaxation():
    rng = random.Random(1)
    for _ in range(50):
        rows = [(i, rng.randrange(12), rng.randrange(12), 1.0, rng.randint(1, 9), 1.0, 0.0, rng.random() < 0.3) for i in range(30)]
        net = search.Network(pd.DataFrame(rows, columns=["seg_id", "node_a", "node_b", "length_m", "seconds", "value", "risk", "oneway"]))
        best = {0: 0.0}
        for _ in range(12):
            for _, a, b, _, w, _, _, one in rows:
                for u, v in ((a, b),) if one else ((a, b), (b, a)):
                    if u in best and best[u] + w < best.get(v, math.inf):
                        best[v] = best[u] + w
        found, _, before = search.shortest(net, 0, net.costs(0.0))
        assert found == best
        for node in best:
            rows_ = search.path(before, 0, node)
            assert sum(net.seconds[rows_]) == best[node]


def test_reuse_penalties_and_junctions_equal_relaxation():
    """Arcs relaxed over and over under the rules: used segments, added seconds, and delays at junctions but not at the start."""
    rng = random.Random(2)
    for trial in range(30):
        rows = [(i, rng.randrange(10), rng.randrange(10), 1.0, float(rng.randint(1, 9)), rng.random(), rng.random(), rng.random() < 0.3, rng.random(), 1 + rng.random(), rng.random()) for i in range(26)]
        net = search.Network(pd.DataFrame(rows, columns=["seg_id", "node_a", "node_b", "length_m", "seconds", "value", "risk", "oneway", "avoid", "factor", "fade"]))
        used, extra = frozenset(rng.sample(range(26), 6)), {i: rng.random() * 3 for i in rng.sample(range(26), 6)}
        reuse, again = (4.0, 0.0) if trial % 2 else (1.0, 4.0)
        degree = {n: sum((a == n) + (b == n) for _, a, b, *_ in rows) for n in range(10)}
        best = {0: 0.0}
        for _ in range(30):
            for i, a, b, _, sec, value, risk, one, avoid, factor, fade in rows:
                for u, v in ((a, b),) if one else ((a, b), (b, a)):
                    if u in best and u != v:
                        step = sec * (1 + 2.0 * fade * (1 - value) + risk + avoid) * factor
                        step = step * reuse + again * sec if i in used else step
                        step += sec * extra.get(i, 0.0) + (5.0 + 3.0 * max(0, degree[u] - 2) if u != 0 else 0.0)
                        if best[u] + step < best.get(v, math.inf) - 1e-12:
                            best[v] = best[u] + step
        found, _, _ = search.shortest(net, 0, net.costs(2.0), used=used, reuse=reuse, again=again, extra=extra, junctions=True)
        assert found.keys() == best.keys() and all(abs(found[n] - best[n]) < 1e-9 for n in best)


def lattice(n=14, gap=0.02):
    rows = []
    for y in range(n):
        for x in range(n):
            for dx, dy in ((1, 0), (0, 1)):
                if x + dx < n and y + dy < n:
                    a, b = y * n + x, (y + dy) * n + x + dx
                    rows.append((len(rows), a, b, 2000.0, 100.0, 0.5, 0.0, 47 + y * gap, 11 + x * gap, 47 + (y + dy) * gap, 11 + (x + dx) * gap))
    return search.Network(pd.DataFrame(rows, columns=["seg_id", "node_a", "node_b", "length_m", "seconds", "value", "risk", "lat_a", "lon_a", "lat_b", "lon_b"]))


def test_scenic_loop_keeps_its_limits():
    net = lattice()
    stops = pd.DataFrame([(i, f"P{i}", n, *net.place(n), 400.0, p, 1.5, d) for i, (n, p, d) in enumerate([(5, 0.9, 3.0), (33, 0.8, 2.0), (62, 0.7, 4.0), (90, 0.6, 1.0), (6, 0.95, 2.0)])], columns=["poi_id", "name", "node", "lat", "lon", "t", "preference", "weight", "density"])
    for minutes in (40.0, 70.0, 150.0):
        (label, _, rows), = search.scenic_loop(net, 0, minutes, stops)
        ends = net.seg.iloc[rows]
        assert not label.startswith("Fallback") and search.kpis(net, rows)["minutes"] <= 1.12 * minutes
        again = net.length[[r for r in set(rows) if rows.count(r) > 1]].sum()
        assert again <= 8000 and again <= 0.10 * net.length[rows].sum()
        touched = set(ends.node_a) | set(ends.node_b)
        assert all(int(stops.node[stops.name == name].iloc[0]) in touched for name in label.split(" - "))
        names = [stops[stops.name == n].iloc[0] for n in label.split(" - ")]
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                assert search.metres((a.lat, a.lon), (b.lat, b.lon)) >= 2500
    fallback = search.scenic_loop(net, 0, 90.0, stops.iloc[:0])
    assert fallback and all(label.startswith("Fallback") for label, _, _ in fallback)


def test_registered_planners_give_rows(spark, sf):
    from wayfold import catalog

    for size in ("sf0.001", "sf0.01"):
        for name in ("r11_cell_joyride", "r12_road_joyride", "r15_scenic_loop", "r18_fallback", "l6_distinct_routes"):
            assert catalog.QUERIES[name](spark, f"{sf}/../{size}").count() or size == "sf0.001" and name in ("r12_road_joyride", "r18_fallback", "r11_cell_joyride", "r15_scenic_loop"), (size, name)


def test_nearest_at_any_distance(spark, tmp_path):
    """Probes all over the globe, at the poles and the date line, and among many points in one place, against a full scan."""
    from wayfold.operators import load
    from wayfold.plans.relation import CATALOG

    load()
    rng = random.Random(4)
    points = [(n, 47 + rng.random() * 0.5, 11 + rng.random() * 0.7, 3) for n in range(60)] + [(100, -30.0, -170.0, 3), (101, 47.2, 11.2, 3), (102, 47.2, 11.2, 3)]
    points += [(200 + n, math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180), 3) for n in range(60)]
    points += [(300, 0.0, -179.9, 3), (301, 0.0, 175.0, 3), (302, 90.0, 0.0, 3), (303, -89.9, 170.0, 3)] + [(400 + n, 10 + n * 1e-6, 20.0, 3) for n in range(300)]
    probes = [(i, math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for i in range(120)] + [(200 + i, 47 + rng.random() * 0.5, 11 + rng.random() * 0.7) for i in range(40)]
    probes += [(300, 47.2, 11.2), (301, 0.0, 179.9), (302, 89.99, 120.0), (303, -90.0, 0.0), (304, 10.5, 20.0), (305, 10.0001, 20.0), (306, 0.0, 180.0), (307, 0.0, -180.0)]
    frames = {"poi": spark.createDataFrame(probes, "poi_id long, lat double, lon double"), "main_nodes": spark.createDataFrame(points, "node long, lat double, lon double, degree long")}
    got = {r.poi_id: r.node for r in CATALOG.build("j9_nearest_node", spark, str(tmp_path), frames).collect()}
    for i, lat, lon in probes:
        assert got[i] == min(points, key=lambda p: (round(search.metres((lat, lon), p[1:3]), 6), p[0]))[0], (i, lat, lon)
    assert len(got) == len(probes)


def test_nearest_in_the_main_component(spark):
    from wayfold.operators import planning

    nodes = spark.createDataFrame([(1, 48.0, 11.0), (2, 48.1, 11.0), (3, 48.2, 11.0), (8, 48.05, 11.0), (9, 48.06, 11.0)], "node long, lat double, lon double")
    edges = spark.createDataFrame([(1, 2), (2, 3), (8, 9)], "a long, b long")
    probes = spark.createDataFrame([(5, 48.051, 11.0)], "poi_id long, lat double, lon double")
    assert planning.nearest_in_main_component(spark, probes, nodes, edges).first().node == 2


def test_components_and_flood(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (9, 5)], "a long, b long")
    assert {r.node: r.component for r in graph.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 9: 5}
    assert graph.components(edges.where("a > 99")).count() == 0
    assert {r.node for r in graph.main_component(edges).collect()} == {1, 2, 3}
    arcs = spark.createDataFrame([(0, 1, 4.0), (0, 2, 1.0), (2, 1, 2.0), (1, 3, 5.0)], "u long, v long, w double")
    assert {r.node: r.cost for r in graph.flood(spark, arcs, 0).collect()} == {0: 0.0, 1: 3.0, 2: 1.0, 3: 8.0}


def test_half_even(spark):
    from wayfold.functions import column

    got = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,), (2.4,), (3.6,)], "x double").select(column(geo.half_even("x")).alias("y")).collect()
    assert [r.y for r in got] == [0, 2, 2, 0, 2, 4]
