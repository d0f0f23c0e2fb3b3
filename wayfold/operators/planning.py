"""Registered graph and routing queries. They iterate or search, so they are functions rather than relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import column, geo
from wayfold.functions import scores as S
from wayfold.operators import graph, search
from wayfold.plans.relation import CATALOG


def _seg(spark: SparkSession, sf_dir: str, name: str = "roads") -> DataFrame:
    return CATALOG.build(name, spark, sf_dir)


def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lattice with its integer weights as cost, ridden both ways."""
    return _seg(spark, sf_dir, "seg").select("seg_id", "node_a", "node_b", "length_m", F.col("length_m").alias("seconds"), F.lit(1.0).alias("value"), F.lit(0.0).alias("risk"), F.col("a_lat").alias("lat_a"), F.col("a_lon").alias("lon_a"), F.col("b_lat").alias("lat_b"), F.col("b_lon").alias("lon_b"))


def _net(spark: SparkSession, sf_dir: str, highway: float = 0.0, twist: float = 0.0, traffic: float = 0.0) -> DataFrame:
    """Segments with their scenic value, one-way roads, exclusions and a rider's aversions."""
    avoid = f"({S.seg_cost(0.0, highway, twist, traffic)} - {S.seg_cost(0.0)}) / greatest(seconds, 0.000001)"
    return _seg(spark, sf_dir, "scored").select("seg_id", "node_a", "node_b", "length_m", "seconds", F.col("scenic").alias("value"), "risk", "oneway", column(S.seg_excluded(30.0, 0.9, 1.15)).alias("excluded"), "highway", column(avoid).alias("avoid"), F.col("a_lat").alias("lat_a"), F.col("a_lon").alias("lon_a"), F.col("b_lat").alias("lat_b"), F.col("b_lon").alias("lon_b"))


#: The lean that the requests' rider rides, in degrees; cells beyond it by the margin are left out.
RIDER_LEAN = 45.0


def _beyond() -> Column:
    return F.coalesce(F.col("cell_lean") - RIDER_LEAN > S.LEAN_MARGIN, F.lit(False)).alias("excluded")


def _cells(spark: SparkSession, sf_dir: str) -> search.Network:
    """Cells and the edges between them, both ways; an arc is named by a hash of its ends."""
    arcs = _seg(spark, sf_dir, "cell_arcs").select(F.xxhash64("a", "b").alias("seg_id"), F.col("a").alias("node_a"), F.col("b").alias("node_b"), "len_m", "seconds", "value", "risk", _beyond(), "lat_a", "lon_a", "lat_b", "lon_b")
    return search.network(arcs.withColumnRenamed("len_m", "length_m").withColumn("oneway", F.lit(True)))


def _roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads with cell values, urban fade and the factors for highways, straights and style; one-way roads aren't heeded."""
    factor = F.col("highway_factor") * F.col("straight_factor") * F.col("style_factor")
    return _seg(spark, sf_dir).select("seg_id", "node_a", "node_b", "length_m", "seconds", "value", "risk", _beyond(), "highway", "urban", (1 - F.col("urban")).alias("fade"), factor.alias("factor"), F.col("a_lat").alias("lat_a"), F.col("a_lon").alias("lon_a"), F.col("b_lat").alias("lat_b"), F.col("b_lon").alias("lon_b"))


def _home_cell(net: search.Network) -> int:
    """The cell with most edges; of several, the first."""
    return int(net.names[net.degrees.argmax()])


def _requests(spark: SparkSession, *rows: tuple) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "request long, start long, goal long, minutes double").repartition(len(rows), "request")


def r1_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = _seg(spark, sf_dir, "seg").where("n_trips >= 6")
    return graph.components(seg.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))


def r1_main_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = _seg(spark, sf_dir, "seg").where("n_trips >= 6")
    return graph.main_component(seg.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))


def _chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridden segments, with a ring of four beside them for every fortieth node."""
    seg = _seg(spark, sf_dir, "seg").where("n_trips >= 6").select("seg_id", "node_a", "node_b", "length_m", "n_trips", (F.col("n_trips") * 3 + 1).alias("n_points"), (F.col("length_m") * F.col("n_trips")).alias("path_m"), *graph.CHAIN_MEANS)
    k, i = F.col("node"), F.col("i")
    ring = _seg(spark, sf_dir, "node").where("node % 40 = 7").select("node", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    at = lambda x: 10_000_000 + 4 * k + (x * 3 + k) % 4
    loop = ring.select((10_000_000 + 4 * k + (i * 7 + k) % 4).cast("long").alias("seg_id"), at(i).cast("long").alias("node_a"), at((i + 1) % 4).cast("long").alias("node_b"), F.lit(10.0).alias("length_m"), F.lit(1).cast(seg.schema["n_trips"].dataType).alias("n_trips"), F.lit(1).cast(seg.schema["n_points"].dataType).alias("n_points"), F.lit(5.0).alias("path_m"), *[F.lit(0.5).alias(c) for c in graph.CHAIN_MEANS])
    return seg.unionByName(loop)


def r2_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled chains; the rings beside are left out, as there are junctions."""
    return graph.chains(_chained(spark, sf_dir))


def r2_chain_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each segment's chain, place and direction."""
    return graph.ordered_chains(_chained(spark, sf_dir))


def nearest_in_main_component(spark: SparkSession, probes: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """poi_id, node, d: the nearest node of each probe that lies in the network's main component."""
    main = nodes.join(graph.main_component(edges), "node", "left_semi").withColumn("degree", F.lit(3))
    return CATALOG.build("j9_nearest_node", spark, "", {"poi": probes, "main_nodes": main})


def j11_main_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of interest and their roads where ridden roads alone are the network: in pieces, of which only the main one counts."""
    seg = _seg(spark, sf_dir, "seg").where("n_trips >= 6")
    edges = seg.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    return nearest_in_main_component(spark, _seg(spark, sf_dir, "poi"), _seg(spark, sf_dir, "node"), edges)


def k2_turn_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs from one directed road over the turn-expanded graph, from region to region: a turn's cost is its road's and its own."""
    arcs = _seg(spark, sf_dir, "turn_arcs").select(F.col("from_arc").alias("u"), F.col("to_arc").alias("v"), (F.col("seconds") + F.col("turn_s")).alias("w"))
    return graph.settled(arcs, spark.createDataFrame([(0, 2, 0.0)], "key long, node long, cost double")).select(F.col("node").alias("arc"), F.round("cost", 4).alias("cost"))


def k2_turn_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed roads that turns connect."""
    arcs = _seg(spark, sf_dir, "turn_arcs").select(F.col("from_arc").alias("a"), F.col("to_arc").alias("b"))
    return graph.components(arcs)


def r3_flood_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs from a node over the whole lattice, from region to region."""
    seg = _seg(spark, sf_dir, "seg")
    arcs = seg.select(F.col("node_a").alias("u"), F.col("node_b").alias("v"), F.col("length_m").alias("w"))
    both = arcs.unionByName(arcs.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    return graph.settled(both, spark.createDataFrame([(0, 0, 0.0)], "key long, node long, cost double")).select("node", "cost")


def r3_shortest_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.costs_from(_requests(spark, (0, None, None)), _plain(spark, sf_dir)).select("node", "cost")


def r3_junction_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.costs_from(_requests(spark, (0, None, None), (41, None, None)), _plain(spark, sf_dir), junctions=True)


def r4_budget_flood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On cells, edges used before at four times their cost: here those at the start."""
    net = _cells(spark, sf_dir)
    home = _home_cell(net)
    used = frozenset(net.seg.loc[(net.seg["node_a"] == home) | (net.seg["node_b"] == home), "seg_id"].tolist())
    return search.costs_from(_requests(spark, (home, None, None)), net, alpha=3.0, most_seconds=1500.0, used=used, reuse=4.0)


def r5_reuse_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On roads, with a route ridden before at twelve times its cost."""
    net = _roads(spark, sf_dir)
    before = search.plan(_requests(spark, (0, 125, None)), net, "destination", alphas=(3.0,)).select("seg_id").collect()
    return search.costs_from(_requests(spark, (125, None, None)), net, alpha=3.0, used=frozenset(r.seg_id for r in before), reuse=12.0)


def r6_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.plan(_requests(spark, (0, 170, None), (5, 60, None)), _plain(spark, sf_dir), "destination", alphas=(0.0,))


def r7_fixed_alphas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.plan(_requests(spark, (0, 170, None), (44, 130, None)), _net(spark, sf_dir), "destination")


def r8_motorway_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.plan(_requests(spark, (0, 170, None), (44, 130, None)), _net(spark, sf_dir), "avoiding")


def r9_time_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.plan(_requests(spark, (0, 170, 12.0)), _net(spark, sf_dir), "budgeted")


def r9_cell_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On cells: alphas up to 8, all seven steps; to the cell that is farthest from the one with most edges."""
    net = _cells(spark, sf_dir)
    home = _home_cell(net)
    reached = search.shortest(net, home, net.costs(0.0))[1]
    goal = max(reached, key=lambda n: (reached[n], -n))
    return search.plan(_requests(spark, (home, goal, 1.2 * reached[goal] / 60)), net, "budgeted", most=8.0, tolerance=0.0, junctions=False)


def r10_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.plan(_requests(spark, (66, None, 12.0)), _net(spark, sf_dir), "round_trip", kind="segment")


def r11_cell_joyride(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = _cells(spark, sf_dir)
    return search.plan(_requests(spark, *[(_home_cell(net), None, m) for m in (10.0, 20.0, 40.0)]), net, "round_trip", kind="cell")


def r12_road_joyride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.plan(_requests(spark, (66, None, 20.0)), _roads(spark, sf_dir), "round_trip", kind="road")


def r13_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.plan(_requests(spark, (0, 170, None)), _net(spark, sf_dir), "alternatives")


def r14_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight of each segment over all sampled routes."""
    routes = search.plan(_requests(spark, (0, 170, None)), _net(spark, sf_dir), "heatmap")
    weights = routes.join(_seg(spark, sf_dir, "scored").select("seg_id", "scenic", "length_m"), "seg_id").groupBy("seg_id").agg(F.sum(F.col("scenic") * F.col("length_m")).alias("w"))
    return weights.crossJoin(F.broadcast(weights.agg(F.max("w").alias("top")))).select("seg_id", F.round(F.col("w") / F.col("top"), 5).alias("weight"))


def _stops(spark: SparkSession, sf_dir: str, rider: str = "A") -> DataFrame:
    """The points of interest of a rider's style outside towns: poi_id, name, node, lat, lon, preference, weight, density."""
    scores = _seg(spark, sf_dir, "poi_scores").where(F.col("rural") >= 1 - search.RURAL)
    owners = _seg(spark, sf_dir, "l8_style_owner").where(F.col("owner") == rider).select("poi_id")
    density = _seg(spark, sf_dir, "j13_spot_density").select("poi_id", "density")
    cool = (0.65 * F.col(f"aff_{rider.lower()}") + 0.35 * F.col("objective")) / 10
    return scores.join(owners, "poi_id").join(density, "poi_id").select("poi_id", "name", "node", "lat", "lon", cool.alias("preference"), "weight", "density")


def r15_scenic_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.scenic_loops(_requests(spark, (64, None, 45.0), (20, None, 90.0)), _roads(spark, sf_dir), _stops(spark, sf_dir))


def r18_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without any point of interest: round trips that ride little of a road twice."""
    return search.scenic_loops(_requests(spark, (66, None, 20.0)), _roads(spark, sf_dir), _stops(spark, sf_dir).where("false"))


def l6_distinct_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = search.plan(_requests(spark, (44, 130, None)), _net(spark, sf_dir), "greedy")
    return routes.groupBy("request", "label").agg(F.count("*").alias("segments"), F.max("km").alias("km"), F.max("value").alias("value"))


QUERIES = {f.__name__: f for f in (r1_components, r1_main_component, r2_chains, r2_chain_order, j11_main_roads, k2_turn_costs, k2_turn_components, r3_flood_costs, r3_shortest_costs, r3_junction_costs, r4_budget_flood, r5_reuse_costs, r6_paths, r7_fixed_alphas, r8_motorway_free, r9_time_budget, r9_cell_budget, r10_round_trip, r11_cell_joyride, r12_road_joyride, r13_alternatives, r14_heatmap, r15_scenic_loop, r18_fallback, l6_distinct_routes)}


def oracles() -> dict[str, str]:
    seg = CATALOG.oracle("seg")
    closure = f"""WITH RECURSIVE s AS (SELECT * FROM ({seg}) WHERE n_trips >= 6),
e AS (SELECT node_a AS a, node_b AS b FROM s UNION ALL SELECT node_b, node_a FROM s),
c(node, component) USING KEY (node) AS (
  SELECT node, min(node) FROM (SELECT a AS node FROM e) GROUP BY node
  UNION SELECT e.b, min(c.component) FROM c JOIN e ON e.a = c.node JOIN recurring.c AS r ON r.node = e.b WHERE c.component < r.component GROUP BY e.b)
"""
    walk = f"""WITH RECURSIVE r AS (SELECT node, unnest([0, 1, 2, 3]) AS i FROM ({CATALOG.oracle("node")}) WHERE node % 40 = 7),
s AS (SELECT seg_id, node_a, node_b, length_m, n_trips, n_trips * 3 + 1 AS n_points, length_m * n_trips AS path_m, lean_p95, speed_mean, band_share, crawl_share, rpm_mean, elev_mean FROM ({seg}) WHERE n_trips >= 6
  UNION ALL SELECT 10000000 + 4 * node + (i * 7 + node) % 4, 10000000 + 4 * node + (i * 3 + node) % 4, 10000000 + 4 * node + ((i + 1) % 4 * 3 + node) % 4, 10, 1, 1, 5, .5, .5, .5, .5, .5, .5 FROM r),
x AS (SELECT seg_id, node_a AS node, node_b AS other, true AS ahead FROM s UNION ALL SELECT seg_id, node_b, node_a, false FROM s),
meet AS (SELECT node, count(*) = 2 AND min(seg_id) <> max(seg_id) AS joint FROM x GROUP BY node),
loose AS (SELECT x.* FROM x JOIN meet USING (node) WHERE NOT joint),
w AS (SELECT node AS from_node, seg_id AS from_seg, ahead AS from_ahead, seg_id, other AS tip, ahead, 0::BIGINT AS position FROM loose
  UNION ALL SELECT from_node, from_seg, from_ahead, x.seg_id, x.other, x.ahead, position + 1 FROM w JOIN meet m ON m.node = w.tip AND m.joint JOIN x ON x.node = w.tip AND x.seg_id <> w.seg_id),
whole AS (SELECT *, count(*) OVER q AS segments, min(seg_id) OVER q AS chain, last_value(tip) OVER (q ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS to_node, last_value(seg_id) OVER (q ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS to_seg, last_value(ahead) OVER (q ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS to_ahead FROM w WINDOW q AS (PARTITION BY from_node, from_seg, from_ahead)),
lines AS (SELECT seg_id, chain, position, ahead AS forward, segments, false AS ring FROM whole WHERE (from_node, from_seg, from_ahead::INT) <= (to_node, to_seg, (NOT to_ahead)::INT)),
circle AS (SELECT * FROM x WHERE seg_id NOT IN (SELECT seg_id FROM lines)),
around(start, first, seg_id, tip, ahead, position, low) AS (SELECT node, seg_id, seg_id, other, ahead, 0::BIGINT, node FROM circle
  UNION ALL SELECT start, first, c.seg_id, c.other, c.ahead, position + 1, least(low, c.node) FROM around a JOIN circle c ON c.node = a.tip AND c.seg_id <> a.seg_id WHERE a.tip <> a.start),
closed AS (SELECT start, first FROM around WHERE tip = start AND low = start QUALIFY first = min(first) OVER (PARTITION BY start)),
loops AS (SELECT seg_id, min(seg_id) OVER (PARTITION BY start) AS chain, position, ahead AS forward, count(*) OVER (PARTITION BY start) AS segments, true AS ring FROM around SEMI JOIN closed USING (start, first))
"""
    chains = walk + """SELECT chain, any_value(segments) AS segments, round(sum(length_m), 3) AS length_m, max(n_trips) AS n_trips, round(sum(n_points), 4) AS n_points, round(sum(path_m), 4) AS path_m,
 """ + ", ".join(f"round(coalesce(sum({c} * n_points) / sum(n_points) FILTER ({c} IS NOT NULL), 0), 6) AS {c}" for c in graph.CHAIN_MEANS) + " FROM lines JOIN s USING (seg_id) GROUP BY chain HAVING sum(length_m) >= 20"
    costs = f"""WITH RECURSIVE s AS ({seg}),
e AS (SELECT node_a AS a, node_b AS b, length_m AS w FROM s UNION ALL SELECT node_b, node_a, length_m FROM s),
d(node, cost) USING KEY (node) AS (
  SELECT 0::BIGINT, 0::DOUBLE
  UNION SELECT e.b, min(d.cost + e.w) FROM d JOIN e ON e.a = d.node LEFT JOIN recurring.d AS r ON r.node = e.b WHERE r.cost IS NULL OR d.cost + e.w < r.cost GROUP BY e.b)
SELECT node, cost FROM d
"""
    return {
        "r1_components": closure + "SELECT node, component FROM c",
        "r1_main_component": closure + "SELECT node FROM c WHERE component = (SELECT component FROM c GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)",
        "r2_chains": chains,
        "r2_chain_order": walk + "SELECT seg_id, chain, position, forward, segments, ring FROM lines UNION ALL SELECT seg_id, chain, position, forward, segments, ring FROM loops",
        "r3_flood_costs": costs,
        "j11_main_roads": closure.rstrip() + f""", m AS (SELECT node FROM c WHERE component = (SELECT component FROM c GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)),
d AS (SELECT p.poi_id, n.node, {geo.haversine("p.lat", "p.lon", "n.lat", "n.lon")} AS d FROM ({CATALOG.oracle("poi")}) p, ({CATALOG.oracle("node")}) n SEMI JOIN m ON m.node = n.node)
SELECT poi_id, node, round(d, 3) AS d FROM d QUALIFY row_number() OVER (PARTITION BY poi_id ORDER BY round(d, 6), node) = 1""",
        "k2_turn_costs": f"""WITH RECURSIVE t AS (SELECT from_arc AS a, to_arc AS b, seconds + turn_s AS w FROM ({CATALOG.oracle("turn_arcs")})),
d(node, cost) USING KEY (node) AS (
  SELECT 2::BIGINT, 0::DOUBLE
  UNION SELECT t.b, min(d.cost + t.w) FROM d JOIN t ON t.a = d.node LEFT JOIN recurring.d AS r ON r.node = t.b WHERE r.cost IS NULL OR d.cost + t.w < r.cost GROUP BY t.b)
SELECT node AS arc, round(cost, 4) AS cost FROM d""",
        "k2_turn_components": f"""WITH RECURSIVE t AS (SELECT from_arc AS a, to_arc AS b FROM ({CATALOG.oracle("turn_arcs")}) WHERE from_arc <> to_arc),
e AS (SELECT a, b FROM t UNION ALL SELECT b, a FROM t),
c(node, component) USING KEY (node) AS (
  SELECT a, min(a) FROM e GROUP BY a
  UNION SELECT e.b, min(c.component) FROM c JOIN e ON e.a = c.node JOIN recurring.c AS r ON r.node = e.b WHERE c.component < r.component GROUP BY e.b)
SELECT node, component FROM c""",
        "r3_shortest_costs": costs,
    }
