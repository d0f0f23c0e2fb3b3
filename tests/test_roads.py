"""The road build over files, ordered chains, ranks and quantiles, and the measures on roads made by hand."""

import json
import random

import pytest

from wayfold import jobs, sources
from wayfold.operators import graph, load
from wayfold.plans import ranks
from wayfold.plans.relation import CATALOG, Catalog

load()


@pytest.fixture(scope="module")
def files(spark, sf, tmp_path_factory):
    """Tiles and a lake written from the tables, one road in two tiles, and trips with unlike headers."""
    folder = tmp_path_factory.mktemp("lake")
    ways = [r.asDict(recursive=True) for r in CATALOG.build("osm_ways", spark, sf).collect()]
    elements = [{"id": w["way_id"], "type": "way", "geometry": w["geometry"], "tags": {k: v for k, v in (("name", w["name"]), ("highway", w["highway"]), ("oneway", "yes" if w["oneway"] else None), ("tunnel", "yes" if w["tunnel"] else None)) if v}} for w in ways]
    (folder / "tiles").mkdir()
    (folder / "tiles" / "1.json").write_text(json.dumps({"elements": elements[:20]}))
    (folder / "tiles" / "2.json").write_text(json.dumps(elements[10:]))
    (folder / "trips").mkdir()
    names = {spec.split()[0]: source for source, spec in sources.TELEMETRY.items()}
    rows = CATALOG.build("tele", spark, sf).toPandas()
    for trip, own in rows.groupby("trip"):
        keys = ["lat", "lon", "lean", "speed", "absb", "acc", "elev", "rpm", "gear", "temp", "hdg", "throttle"]
        random.Random(int(trip)).shuffle(keys)
        out = own[["t_ms", *keys]].rename(columns=names)
        out.to_csv(folder / "trips" / f"{trip}.csv", index=False)
    return folder


def test_build_roads_equals_the_relations(spark, sf, files, tmp_path):
    raster = CATALOG.build("raster", spark, sf)
    report = jobs.build_roads(spark, [str(files / "tiles")], [str(files / "trips")], str(tmp_path / "out"), raster)
    want = {r.seg_id: r for r in CATALOG.build("road_seg", spark, sf).collect()}
    got = {r.seg_id: r for r in sources.roads(spark, str(tmp_path / "out" / "segments")).collect()}
    assert got.keys() == want.keys() and report["segments"] == len(want) and report["ridden"] == sum(r.n_trips > 0 for r in want.values()) > 10
    for k, r in want.items():
        for c in ("node_a", "node_b", "highway", "oneway", "n_trips", "curvature_geo", "dem_elev_m"):
            assert got[k][c] == r[c], c
        for c in ("length_m", "curviness", "abs_rate", "speed_mean", "lean_p95"):
            assert got[k][c] == pytest.approx(r[c], rel=1e-6, abs=1e-6), c
    lats = sorted(r.mid_lat for r in want.values())
    box = (lats[5], 11.0, lats[-5], 12.0)
    assert sources.roads(spark, str(tmp_path / "out" / "segments"), box).count() == sum(lats[5] <= x <= lats[-5] for x in lats)
    assert jobs.scored_roads(spark, str(tmp_path / "out" / "segments")).where("scenic BETWEEN 0 AND 1").count() == len(want)
    degree = spark.read.parquet(str(tmp_path / "out" / "adjacency")).groupBy("node").count()
    assert degree.agg({"count": "sum"}).first()[0] == sum(1 + (r.node_a != r.node_b) for r in want.values())


def test_roads_by_hand(spark):
    """Two ways that cross: cut at the crossing, and every 100 m."""
    line = lambda *p: [{"lat": float(a), "lon": float(b)} for a, b in p]
    step = 0.0009  # of latitude, 100.07 m
    ways = spark.createDataFrame([(1, line((48, 11), (48 + step, 11), (48 + 3 * step, 11)), "A", "primary", False, False), (2, line((48 + step, 10.999), (48 + step, 11), (48 + step, 11.001)), None, "tertiary", True, False), (3, line((50, 10), (50, 10.00001)), None, "track", False, False)], "way_id long, geometry array<struct<lat:double,lon:double>>, name string, highway string, oneway boolean, tunnel boolean")
    got = CATALOG.build("road_segments", spark, "", {"osm_ways": ways}).orderBy("seg_id").collect()
    assert [(r.way_id, round(r.length_m)) for r in got] == [(1, 100), (1, 100), (1, 100), (2, 74), (2, 74)]
    assert [r.node_a for r in got[:2]] == [1 << 20, (1 << 20) + 1] and got[1].node_b == got[2].node_a == -1 - got[1].seg_id
    assert got[3].node_b == got[4].node_a == got[1].node_a  # the crossing
    assert got[0].curvature_geo == 0.0 and got[0].bearing_mean == 0.0


def slow_chains(rows):
    """Chains walked from their ends, and rings from their smallest node."""
    ends = {}
    for s, a, b in rows:
        ends.setdefault(a, []).append(s)
        ends.setdefault(b, []).append(s)
    side = {s: (a, b) for s, a, b in rows}
    joint = {n for n, x in ends.items() if len(x) == 2 and x[0] != x[1]}

    def walk(node, s):
        out = []
        start = node
        while True:
            forward = side[s][0] == node if side[s][0] != side[s][1] else True
            out.append((s, forward))
            node = side[s][1] if forward else side[s][0]
            if node not in joint or node == start:
                return out
            s = next(x for x in ends[node] if x != s)

    done, out = set(), {}
    for ring in (False, True):
        for node in sorted(ends):
            for s in sorted(ends[node]):
                if s in done or (node in joint) != ring:
                    continue
                own = walk(node, s)
                done |= {x for x, _ in own}
                for k, (x, forward) in enumerate(own):
                    out[x] = (min(y for y, _ in own), k, forward, len(own), ring)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_ordered_chains(spark, seed):
    rng = random.Random(seed)
    n = [12, 30, 60][seed]
    rows = [(i, rng.randrange(n), rng.randrange(n)) for i in range(n)]
    base = 100
    for size in (2, 3, 5, 17):  # rings
        nodes = rng.sample(range(1000, 2000), size)
        rows += [(base + k, *rng.choice([(nodes[k], nodes[(k + 1) % size]), (nodes[(k + 1) % size], nodes[k])])) for k in range(size)]
        base += 100
    rows += [(600 + k, 5000 + (k * 7) % 50, 5000 + ((k + 1) * 7) % 50) for k in range(49)]  # a long chain
    got = {r.seg_id: (r.chain, r.position, r.forward, r.segments, r.ring) for r in graph.ordered_chains(spark.createDataFrame(rows, "seg_id long, node_a long, node_b long")).collect()}
    want = slow_chains(rows)
    assert {k: (v[0], v[3], v[4]) for k, v in got.items()} == {k: (v[0], v[3], v[4]) for k, v in want.items()}
    for k in got:  # a line whose ends are one node may start at either; so may a segment from a node to itself
        if got[k] != want[k]:
            own = [s for s in got if got[s][0] == got[k][0]]
            assert all(got[s][1] == got[s][3] - 1 - want[s][1] and got[s][2] != want[s][2] or got[s][3] == 1 for s in own)


def test_rings_alone(spark):
    cols = "seg_id long, node_a long, node_b long, length_m double, n_trips long, n_points long, path_m double, " + ", ".join(f"{c} double" for c in graph.CHAIN_MEANS)
    make = lambda rows: spark.createDataFrame([(*r, 50.0, 2, 4, 10.0, *[1.0] * len(graph.CHAIN_MEANS)) for r in rows], cols)
    two = make([(1, 5, 6), (2, 6, 7), (3, 7, 5), (4, 1, 2), (5, 2, 1)])
    assert [(r.chain, r.segments, r.length_m) for r in graph.chains(two).collect()] == [(4, 2, 100.0)]
    assert graph.chains(two, rings="all").count() == 2
    assert [r.chain for r in graph.chains(two.unionByName(make([(9, 20, 21)]))).collect()] == [9]


def test_flood_fails_at_its_limit(spark):
    arcs = spark.createDataFrame([(i, i + 1, 1.0) for i in range(9)], "u long, v long, w double")
    assert graph.flood(spark, arcs, 0).count() == 10
    with pytest.raises(RuntimeError):
        graph.flood(spark, arcs, 0, limit=3)


@pytest.mark.parametrize("doublings", [0, 2])
def test_cheapest_ways_of_many_requests(spark, doublings):
    """Two requests with weights of their own, in one flood: costs by relaxation, and arcs that are on some cheapest way."""
    import math

    rng = random.Random(3)
    ends = [(rng.randrange(9), rng.randrange(9)) for _ in range(26)]
    arcs = [(key, k, u, v, float(rng.randint(1, 6))) for key in ("a", "b") for k, (u, v) in enumerate(ends) if u != v]
    frame = spark.createDataFrame(arcs, "key string, arc long, u long, v long, w double")
    starts = spark.createDataFrame([("a", 0, 0.0), ("b", 3, 0.0)], "key string, node long, cost double")
    goals = spark.createDataFrame([("a", 5), ("b", 1)], "key string, node long")

    def costs(key, start, turned=False):
        best = {start: 0.0}
        for _ in range(9):
            for own, _, u, v, w in arcs:
                u, v = (v, u) if turned else (u, v)
                if own == key and u in best:
                    best[v] = min(best.get(v, math.inf), best[u] + w)
        return best

    got = {(r.key, r.node): r.cost for r in graph.floods(graph.widened(frame.drop("arc").groupBy("key", "u", "v").agg({"w": "min"}).withColumnRenamed("min(w)", "w"), doublings), starts).collect()}
    assert got == {(key, n): c for key, start in (("a", 0), ("b", 3)) for n, c in costs(key, start).items()}
    want = set()
    for key, start, goal in (("a", 0, 5), ("b", 3, 1)):
        forth, back = costs(key, start), costs(key, goal, True)
        want |= {(key, k, forth[u]) for own, k, u, v, w in arcs if own == key and u in forth and v in back and goal in forth and forth[u] + w + back[v] == forth[goal]}
    assert {(r.key, r.arc, r.since) for r in graph.on_cheapest_ways(frame, starts, goals, doublings).collect()} == want


def test_quantiles_and_ranks(spark):
    """A group with half of all rows, equal values, nulls, one row."""
    import numpy as np

    rng = random.Random(1)
    rows = [(0 if i % 2 else i % 7 + 1, i, rng.choice([None, 3.0, rng.uniform(-5, 90), rng.uniform(0, 2)])) for i in range(4000)] + [(99, 5000, 1.5)]
    frame = spark.createDataFrame(rows, "g long, i long, v double")
    own = Catalog()
    kept, ranks.CATALOG = ranks.CATALOG, own
    try:
        ranks.group_quantiles("q", "src", {"g": "g"}, {"v": "v"}, {"mid": ("v", 0.3, "between"), "near": ("v", 0.5, "even"), "low": ("v", 0.95, "cut")})
        ranks.ranked_rows("r", "src", "coalesce(v, 0.0)", "p.i")
    finally:
        ranks.CATALOG = kept
    got = {r.g: r for r in own.build("q", spark, "", {"src": frame}).collect()}
    for g in {r[0] for r in rows}:
        v = sorted(r[2] for r in rows if r[0] == g and r[2] is not None)
        assert got[g].mid == pytest.approx(np.quantile(v, 0.3), rel=1e-12, abs=1e-12)
        assert got[g].near == v[round(0.5 * (len(v) - 1))] and got[g].low == v[int(0.95 * (len(v) - 1))]
    order = [r.i for r in own.build("r", spark, "", {"src": frame}).orderBy("rk").collect()]
    assert order == [r[1] for r in sorted(rows, key=lambda r: (-(r[2] or 0.0), r[1]))]


def test_kernel_weights_by_hand(spark):
    """Half way between two roads that run alike: one half each; a road across it counts for nothing."""
    point = lambda a, b: {"lat": a, "lon": b}
    off = 20 / 111320.0
    legs = [(1, point(48 + off, 11.0), point(48 + off, 11.002)), (2, point(48 - off, 11.002), point(48 - off, 11.0)), (3, point(47.999, 11.001), point(48.001, 11.001))]
    line = spark.createDataFrame([(s, [p, q]) for s, p, q in legs], "seg_id long, line array<struct<lat:double,lon:double>>")
    tele = spark.createDataFrame([(7, 48.0, 11.001, 90.0, -30.0)], "event_id long, lat double, lon double, hdg double, lean double")
    got = {r.seg_id: r for r in CATALOG.build("kernel_weights", spark, "", {"road_segments": line, "tele": tele}).collect()}
    assert set(got) == {1, 2} and got[1].w == pytest.approx(0.5, abs=1e-4) and got[1].w + got[2].w == pytest.approx(1)
    assert got[1].raw == pytest.approx(2.718281828 ** -0.5, rel=1e-3) and got[1].lean == 30.0


def test_corner_rhythm_by_hand(spark):
    """Even corners are regular, uneven ones less so."""
    def road(way, gaps):
        out, b, k = [], 90.0, 0
        for n, gap in enumerate(gaps):
            for _ in range(gap):
                out.append((way, k, b % 360, 15.0))
                k += 1
            for _ in range(3):
                b += 10 * (-1) ** n
                out.append((way, k, b % 360, 15.0))
                k += 1
        return out

    frame = spark.createDataFrame(road(1, [10] * 6) + road(2, [3, 30, 4, 40, 5, 20]), "way_id long, k long, b double, d double")
    got = {r.way_id: r for r in CATALOG.build("k5_corner_rhythm", spark, "", {"headings": frame}).collect()}
    assert got[1].corners == got[2].corners == 6 and got[1].regularity == 1.0 and got[2].regularity < 0.5 and got[1].alternation == 1.0


def test_sparse_takes_the_prior(spark, sf):
    delay = CATALOG.build("k3_junction_delay", spark, sf).collect()
    assert all(r.delay_s == r.prior_s for r in delay if not r.passes) and any(r.passes for r in delay)
    risk = CATALOG.build("k6_exposed_risk", spark, sf).collect()
    assert all(abs(r.rate - r.road_rate) < 1e-4 for r in risk if r.km == 0) and len({r.rate for r in risk}) > 3
