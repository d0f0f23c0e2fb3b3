"""Graph operators on DataFrames: components, chains and bulk floods, as loops of joins whose lineage is cut by reliable
checkpoints."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.plans import store


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that the session names."""
    store.shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that is connected) for undirected edges (a, b).

    Alternating stars: neighbours are hung under each node's smallest neighbour until all hang under their component's
    smallest node, in about as many rounds as the logarithm of the diameter."""
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("u", "v"), 32))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = cut(small.unionByName(root.select("u", F.col("m").alias("v"))).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def main_component(edges: DataFrame) -> DataFrame:
    """The nodes of the component with most nodes; of equal ones, that with the smallest node."""
    labels = components(edges)
    top = labels.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    return labels.join(F.broadcast(top.select("component")), "component", "left_semi").select("node")


def _met(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two sides that grow alike: always by sorting, as sizes guessed for checkpoints and filters are often far too small,
    and what is taken for small is collected by the driver."""
    return left.join(right.hint("merge"), on, how)


def _followed(arcs: DataFrame, rounds: int) -> DataFrame:
    """arc, low, last, hops, nxt for arcs (arc, seg_id, nxt): each list followed to its end by pointer doubling.

    A round replaces each pointer by its target's, so that lists of n arcs take about log2(n) rounds; arcs that reached their
    end rest. ``low`` is the smallest segment on the way. Of arcs that have an end, the nearest to it reaches it in the next round, so
    after a round in which none did, all that are left lie on rings: these go on among themselves, and keep a pointer."""
    state = cut(arcs.select("arc", F.col("seg_id").alias("low"), F.col("arc").alias("last"), F.when(F.col("nxt").isNull(), 0).otherwise(1).cast("long").alias("hops"), "nxt"))
    done, going = state.where("nxt IS NULL"), state.where("nxt IS NOT NULL")
    left, rings = going.count(), False
    for _ in range(rounds):
        if not left:
            break
        targets = going if rings else done.unionByName(going)
        ahead = targets.select(F.col("arc").alias("nxt"), F.col("low").alias("low_"), F.col("last").alias("last_"), F.col("hops").alias("hops_"), F.col("nxt").alias("nxt_"))
        moved = cut(_met(going, ahead, "nxt").select("arc", F.least("low", "low_").alias("low"), F.col("last_").alias("last"), (F.col("hops") + F.col("hops_")).alias("hops"), F.col("nxt_").alias("nxt"), (F.col("low_") < F.col("low")).alias("lower")))
        # what is low over two stretches that follow each other, all around, is low over the ring
        if rings and moved.where("lower").isEmpty():
            break
        moved, lower = moved.drop("lower"), left
        done, going = done.unionByName(moved.where("nxt IS NULL")), moved.where("nxt IS NOT NULL")
        left = going.count()
        rings = left == lower
    return done.unionByName(going)


def ordered_chains(seg: DataFrame) -> DataFrame:
    """seg_id, chain (its smallest segment), position (from 0), forward, segments, ring for segments (seg_id, node_a, node_b).

    A chain runs through nodes at which exactly two ends of different segments meet. It starts at its end with the smaller
    node, or the smaller segment if both ends are one node, and ``forward`` says whether a segment is passed from its
    node_a. Rings have no end: each is opened at its smallest node and goes on with the smaller of the two segments there.

    Both directions of a segment are arcs of opposite lists, ranked by pointer doubling; only segments that rounds haven't
    brought to an end, the rings, are ranked a second time."""
    ends = seg.select("seg_id", F.col("node_a").alias("node"), F.lit(0).alias("side")).unionByName(seg.select("seg_id", F.col("node_b").alias("node"), F.lit(1).alias("side")))
    end = F.struct("seg_id", "side")
    joints = ends.groupBy("node").agg(F.count("*").alias("n"), F.min(end).alias("x"), F.max(end).alias("y")).where("n = 2 AND x.seg_id <> y.seg_id")
    # an arc is twice its segment, and one more if it runs to node_a; at a joint it goes on with the other segment, away from there
    turn = lambda a, b: joints.select((2 * F.col(f"{a}.seg_id") + 1 - F.col(f"{a}.side")).alias("arc"), (2 * F.col(f"{b}.seg_id") + F.col(f"{b}.side")).alias("nxt"), "node")
    follows = cut(turn("x", "y").unionByName(turn("y", "x")))
    arcs = seg.select("seg_id", F.explode(F.array(2 * F.col("seg_id"), 2 * F.col("seg_id") + 1)).alias("arc"))
    rounds = max(1, int(seg.count() * 2).bit_length() + 1)
    ranked = _followed(_met(arcs, follows, "arc", "left"), rounds)
    rings = ranked.where("nxt IS NOT NULL").select("arc", "low")
    opened = seg.limit(0).select("seg_id", F.lit(0).cast("long").alias("arc"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("last"), F.lit(0).cast("long").alias("hops"), F.lit(0).cast("long").alias("nxt"))
    if not rings.isEmpty():
        own = _met(rings, follows, "arc")  # after so many rounds, low is the ring's smallest segment
        first = own.groupBy("low").agg(F.min("node").alias("node"))
        open_at = _met(first, joints, "node").select("low", "node", F.col("x.seg_id").alias("seg_id"), F.col("x.side").alias("side"))
        start = open_at.select((2 * F.col("seg_id") + F.col("side")).alias("start"), "low")
        marked = _met(own, first.withColumnRenamed("node", "open"), "low")
        lists = marked.select("arc", F.shiftright("arc", 1).alias("seg_id"), F.when(F.col("node") != F.col("open"), F.col("nxt")).alias("nxt"))
        again = _followed(lists, rounds)
        # of the two directions of a ring, that which leaves its node by the smaller segment
        size = _met(again, start, again.arc == F.col("start")).select(F.col("last").alias("last"))
        opened = _met(again, size, "last", "left_semi").select(F.shiftright("arc", 1).alias("seg_id"), "arc", "low", "last", "hops", "nxt")
    tail = ranked.where("nxt IS NULL").select(F.shiftright("arc", 1).alias("seg_id"), F.when(F.col("arc") % 2 == 0, "f").otherwise("b").alias("way"), F.struct("low", "last", "hops").alias("to"))
    both = tail.groupBy("seg_id").agg(F.max(F.when(F.col("way") == "f", F.col("to"))).alias("f"), F.max(F.when(F.col("way") == "b", F.col("to"))).alias("b")).where("f IS NOT NULL AND b IS NOT NULL")
    heads = ends.select((2 * F.col("seg_id") + 1 - F.col("side")).alias("last"), "node")
    both = _met(both, heads.withColumnsRenamed({"last": "f_last", "node": "f_node"}), F.col("f.last") == F.col("f_last"))
    both = _met(both, heads.withColumnsRenamed({"last": "b_last", "node": "b_node"}), F.col("b.last") == F.col("b_last"))
    ahead = F.struct("b_node", F.shiftright("b_last", 1), "b_last") <= F.struct("f_node", F.shiftright("f_last", 1), "f_last")
    lines = both.select("seg_id", F.least("f.low", "b.low").alias("chain"), F.when(ahead, F.col("b.hops")).otherwise(F.col("f.hops")).alias("position"), ahead.alias("forward"), (F.col("f.hops") + F.col("b.hops") + 1).alias("segments"), F.lit(False).alias("ring"))
    sizes = opened.groupBy("last").agg(F.min("low").alias("chain"), F.max("hops").alias("most"))
    loops = _met(opened, sizes, "last").select("seg_id", "chain", (F.col("most") - F.col("hops")).alias("position"), (F.col("arc") % 2 == 0).alias("forward"), (F.col("most") + 1).alias("segments"), F.lit(True).alias("ring"))
    return lines.unionByName(loops)


#: Figures of segments that add up along a chain, and those that are means over its points.
CHAIN_SUMS, CHAIN_MEANS = ("n_points", "path_m"), ("lean_p95", "speed_mean", "band_share", "crawl_share", "rpm_mean", "elev_mean")


def chains(seg: DataFrame, rings: str = "alone", least_m: float = 20.0) -> DataFrame:
    """Chains with pooled figures: chain, segments, length_m, n_trips (the most: trips don't add up along a road), sums, and
    means by points. Chains shorter than ``least_m`` are left out. ``rings``: ``alone`` keeps rings only in a network that has no end
    or junction at all, and then the one with the smallest node; ``all`` keeps every ring."""
    own = ordered_chains(seg)
    if rings == "alone":
        if own.where("NOT ring").isEmpty():
            nodes = _met(own, seg.select("seg_id", "node_a", "node_b"), "seg_id")
            first = nodes.groupBy("chain").agg(F.min(F.least("node_a", "node_b")).alias("node")).orderBy("node").limit(1)
            own = own.join(F.broadcast(first.select("chain")), "chain", "left_semi")
        else:
            own = own.where("NOT ring")
    held = _met(own, seg, "seg_id")
    sums = [F.round(F.sum(c), 4).alias(c) for c in CHAIN_SUMS]
    means = [F.round(F.coalesce(F.sum(F.col(c) * F.col("n_points")) / F.nullif(F.sum(F.when(F.col(c).isNotNull(), F.col("n_points"))), F.lit(0)), F.lit(0.0)), 6).alias(c) for c in CHAIN_MEANS]
    out = held.groupBy("chain").agg(F.max("segments").alias("segments"), F.sum("length_m").alias("m"), F.max("n_trips").alias("n_trips"), *sums, *means)
    return out.where(F.col("m") >= least_m).select("chain", "segments", F.round("m", 3).alias("length_m"), "n_trips", *CHAIN_SUMS, *CHAIN_MEANS)


def widened(arcs: DataFrame, doublings: int) -> DataFrame:
    """Arcs (u, v, w), or (key, u, v, w), and the cheapest ways over up to 2, 4, 8 and so on of them, as arcs. Costs stay what they
    are, and a flood takes as many times fewer rounds; nodes of many arcs have very many such ways, so this is for roads."""
    keys = ["key"] if "key" in arcs.columns else []
    for _ in range(doublings):
        ahead = arcs.select(*keys, F.col("u").alias("v"), F.col("v").alias("to"), F.col("w").alias("more"))
        far = arcs.join(ahead, [*keys, "v"]).where("u <> to").select(*keys, "u", F.col("to").alias("v"), (F.col("w") + F.col("more")).alias("w"))
        arcs = cut(arcs.unionByName(far).groupBy(*keys, "u", "v").agg(F.min("w").alias("w")))
    return arcs


def floods(arcs: DataFrame, starts: DataFrame, limit: int = 100_000) -> DataFrame:
    """key, node, cost of the cheapest way from each key's ``starts`` (key, node, cost) over its arcs (key, u, v, w) with positive
    weights, for all keys at once: relaxation in rounds, each from the nodes that got cheaper. It fails rather than return
    unsettled nodes after ``limit`` rounds."""
    best = front = cut(starts.select("key", "node", "cost"))
    for _ in range(limit):
        reached = front.withColumnRenamed("node", "u").join(arcs, ["key", "u"]).groupBy("key", "v").agg(F.min(F.col("cost") + F.col("w")).alias("new"))
        better = cut(reached.join(best.select("key", F.col("node").alias("v"), "cost"), ["key", "v"], "left").where("cost IS NULL OR new < cost").select("key", F.col("v").alias("node"), F.col("new").alias("cost")))
        if better.isEmpty():
            return best
        best = cut(best.join(better.select("key", "node"), ["key", "node"], "left_anti").unionByName(better))
        front = better
    raise RuntimeError(f"nodes are not settled after {limit} rounds")


def flood(spark: SparkSession, arcs: DataFrame, start: int, limit: int = 100_000) -> DataFrame:
    """node, cost of the cheapest way from one node over arcs (u, v, w)."""
    starts = spark.createDataFrame([(0, start, 0.0)], "key int, node long, cost double")
    return floods(arcs.select(F.lit(0).alias("key"), "u", "v", "w"), starts, limit).select("node", "cost")


def on_cheapest_ways(arcs: DataFrame, starts: DataFrame, goals: DataFrame, doublings: int = 0, slack: float = 1e-6) -> DataFrame:
    """key, arc, u, v, since of the arcs (key, arc, u, v, w) that lie on a cheapest way from each key's start to its goal (key, node):
    those whose costs from the start, their own, and on to the goal add up to the whole. ``since`` is the cost up to u, so ordering
    by it gives the way; no predecessor is followed, and of equally cheap ways all are given."""
    plain = arcs.groupBy("key", "u", "v").agg(F.min("w").alias("w"))
    forth = floods(widened(plain, doublings), starts)
    back = floods(widened(plain.select("key", F.col("u").alias("v"), F.col("v").alias("u"), "w"), doublings), goals.select("key", "node", F.lit(0.0).alias("cost")))
    whole = forth.join(goals.select("key", "node"), ["key", "node"]).select("key", F.col("cost").alias("whole"))
    met = arcs.join(forth.select("key", F.col("node").alias("u"), F.col("cost").alias("since")), ["key", "u"]).join(back.select("key", F.col("node").alias("v"), F.col("cost").alias("ahead")), ["key", "v"]).join(whole, "key")
    return met.where(F.abs(F.col("since") + F.col("w") + F.col("ahead") - F.col("whole")) <= slack).select("key", "arc", "u", "v", "since")


#: Nodes of a region, which a task settles at once; a node with four arcs takes about 600 bytes there.
REGION_NODES = 250_000


def _region(node: str, bounds: list[int], base: int = 0) -> Column:
    """How many of the sorted bounds are no larger than a node."""
    if not bounds:
        return F.lit(base)
    at = len(bounds) // 2
    return F.when(F.col(node) < bounds[at], _region(node, bounds[:at], base)).otherwise(_region(node, bounds[at + 1 :], base + at + 1))


def _settle(key: tuple, arcs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """Labels of a region's nodes from those of its starts and of the nodes outside that have arcs into it."""
    nodes, index = np.unique(np.concatenate([arcs["u"].to_numpy(np.int64), arcs["v"].to_numpy(np.int64), known["node"].to_numpy(np.int64)]), return_inverse=True)
    u, v, k = np.split(index, [len(arcs), 2 * len(arcs)])
    order = np.lexsort((arcs["turn"].to_numpy(), u))
    first = np.searchsorted(u[order], np.arange(len(nodes) + 1)).tolist()
    end = v[order].tolist()
    w, s, wait = (arcs[c].to_numpy(float)[order].tolist() for c in ("w", "s", "delay"))
    best, elapsed = [math.inf] * len(nodes), [0.0] * len(nodes)
    origins = set(k[known["origin"].to_numpy(bool)].tolist())
    heap = []
    for i, cost, since in zip(k.tolist(), known["cost"].tolist(), known["elapsed"].tolist()):
        if cost < best[i]:
            best[i], elapsed[i] = cost, since
            heap.append((cost, i))
    heapq.heapify(heap)
    while heap:
        d, i = heapq.heappop(heap)
        if d > best[i]:
            continue
        origin = i in origins
        for a in range(first[i], first[i + 1]):
            more = 0.0 if origin else wait[a]
            if (new := d + w[a] + more) < best[j := end[a]]:
                best[j], elapsed[j] = new, elapsed[i] + s[a] + more
                heapq.heappush(heap, (new, j))
    inside = np.zeros(len(nodes), bool)
    inside[v] = True
    inside[k[known["own"].to_numpy(bool)]] = True
    best = np.array(best)
    at = np.flatnonzero(inside & (best < math.inf))
    return pd.DataFrame({"key": key[0], "region": key[1], "node": nodes[at], "cost": best[at], "elapsed": np.array(elapsed)[at], "origin": np.isin(at, list(origins))})


def settled(arcs: DataFrame, starts: DataFrame, region_nodes: int = REGION_NODES, limit: int = 100_000) -> DataFrame:
    """key, node, cost, elapsed of the cheapest way from each key's ``starts`` (key, node, cost) over all arcs (u, v, w) with positive
    weights. Arcs may have s (seconds, which add up to ``elapsed``; w otherwise), delay (added to both unless u is a start) and turn (which
    of a node's arcs comes first; of equal costs, the one found first by a heap of (cost, node) stays).

    Nodes are cut into regions by ranges of their numbers. A round settles the regions into which labels came that differ from the last,
    each in a task from what its neighbours told; the labels at which nothing changes are those of one heap over the whole. So a
    flood takes about as many rounds as its cheapest ways cross borders; how regions are cut changes only that."""
    spark = arcs.sparkSession
    own = lambda c, other: F.col(c) if c in arcs.columns else other
    arcs = arcs.where("u <> v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col("w").cast("double").alias("w"), own("s", F.col("w")).cast("double").alias("s"), own("delay", F.lit(0.0)).cast("double").alias("delay"), own("turn", F.col("v")).cast("long").alias("turn"))
    parts = math.ceil(arcs.agg(F.approx_count_distinct("v")).first()[0] / region_nodes)
    bounds = sorted({int(b) for b in arcs.approxQuantile("v", [i / parts for i in range(1, parts)], 0.1 / parts)}) if parts > 1 else []
    path = store.scratch(spark, "regions")
    arcs.withColumn("source", _region("u", bounds)).withColumn("region", _region("v", bounds)).repartition("region").write.partitionBy("region").parquet(f"{path}/arcs")
    arcs = spark.read.schema("u long, v long, w double, s double, delay double, turn long, source int, region int").parquet(f"{path}/arcs")
    border = cut(arcs.where("source <> region").select(F.col("u").alias("node"), F.col("source").alias("region"), F.col("region").alias("target")).distinct())
    label = "key long, region int, node long, cost double, elapsed double, origin boolean"
    begin = cut(starts.select(F.col("key").cast("long").alias("key"), _region("node", bounds).alias("region"), F.col("node").cast("long").alias("node"), F.col("cost").cast("double").alias("cost"), F.lit(0.0).alias("elapsed"), F.lit(True).alias("origin"), F.lit(True).alias("own")))
    told = spark.createDataFrame([], f"{label}, target int")
    due = [tuple(r) for r in begin.select("key", "region").distinct().collect()]
    latest: dict[tuple, int] = {}
    for turn in range(limit):
        if not due:
            break
        latest |= dict.fromkeys(due, turn)
        pairs = F.broadcast(spark.createDataFrame(due, "key long, region int"))
        ways = arcs.where(F.col("region").isin(sorted({r for _, r in due}))).join(pairs, "region")
        known = begin.unionByName(told.select("key", F.col("target").alias("region"), "node", "cost", "elapsed", "origin", F.lit(False).alias("own"))).join(pairs, ["key", "region"], "left_semi")
        ways.groupBy("key", "region").cogroup(known.groupBy("key", "region")).applyInPandas(_settle, label).write.parquet(f"{path}/labels/turn={turn}")
        new = cut(_met(spark.read.schema(label).parquet(f"{path}/labels/turn={turn}"), border, ["node", "region"]).select("key", "region", "node", "cost", "elapsed", "origin", "target"))
        old = told.join(pairs, ["key", "region"], "left_semi")
        both = _met(new.withColumn("x", F.struct("cost", "elapsed")).select("key", "target", "node", "x"), old.withColumn("y", F.struct("cost", "elapsed")).select("key", "target", "node", "y"), ["key", "target", "node"], "full")
        due = [tuple(r) for r in both.where("NOT x <=> y").select("key", "target").distinct().collect()]
        told = cut(told.join(pairs, ["key", "region"], "left_anti").unionByName(new))
    else:
        raise RuntimeError(f"nodes are not settled after {limit} rounds")
    if not latest:
        return spark.createDataFrame([], "key long, node long, cost double, elapsed double")
    last = F.broadcast(spark.createDataFrame([(*k, t) for k, t in latest.items()], "key long, region int, turn int"))
    return spark.read.schema(f"{label}, turn int").parquet(f"{path}/labels").join(last, ["key", "region", "turn"], "left_semi").select("key", "node", "cost", "elapsed")
