"""Near-duplicate detection by ProbMinHash.

A text is the set of its five-word shingles. A shingle that occurs c times weighs 1.5 - 0.5 / c. Every shingle is a Poisson
process whose arrivals, at the shingle's weight as rate, hit random places of the sketch; a place keeps the shingle of
its first arrival, and a shingle is given up as soon as its next arrival comes too late for all places. The places of
two sketches agree with the probability Jaccard similarity of the weighted sets. 32 bands of five places find candidates,
and exact Jaccard similarity of the shingle sets, at 0.8 or more, verifies them. Classes are the connected components of
the verified pairs.

Both similarities are equal where shingles repeat alike, and a pair at 0.8 is then missed with a probability of 3e-6.
Weights lie between 1 and 1.5, so that at a Jaccard similarity of 0.8 the other one is at least 0.64 however shingles
repeat; even then banding finds 97 % of such pairs. Nothing but set sizes, which 0.8 bounds, goes before verification.

No bucket emits all its pairs. Equal texts, by a digest of 128 bits, are one node. In each bucket the members meet the
bucket's leader, the one that has most company in all its buckets, as an original has among its copies. Only buckets whose
members aren't in one component yet go on; they are settled exactly, by tasks that verify pairs of a block of bounded size
and return only the links that connect what wasn't connected yet. A bucket of more than a block is dealt out before by its
members' rarest shingles: two sets that are similar enough have one in common among the rarest fifth of either, so texts
that share a passage and nothing else don't meet again. Only members that share even that in great number and yet aren't
connected meet block by block. The largest component of a bucket never meets itself.

Defined results: null and empty texts are equal texts without words and form one class; texts of fewer than five words
have one shingle, all their words; texts of any length are read whole; equal texts, repeated rows included, are in one
class; a class is named by its smallest identifier and the row that has it stays, of several such rows one; a null
identifier is a document like others and stays only if its class has no other; no rows give no rows; other columns, of
whatever name, are neither read nor needed. Words are hashed to 64 bits, once for each distinct word; verification
compares 32 bits of each shingle's hash, which changes the similarity of texts of n shingles by about n / 2**32.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, texts, trim, tune, unused, written

WORDS = 5
SIMILARITY = 0.8
BANDS, BAND = 32, 5
PLACES = BANDS * BAND
ROUNDS = 1
#: Nodes of a bucket that meet in one place.
BLOCK = 512
#: Pairs that are sent to all executors rather than dealt out, at most.
FEW_PAIRS = 20_000
#: Bytes of text whose words are taken apart at once.
BLOCK_BYTES = 1 << 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a column of strings, and the row of each. Words are runs without ASCII white space."""
    lists = pc.ascii_split_whitespace(column)
    rows, words = pc.list_parent_indices(lists), pc.list_flatten(lists)
    solid = pc.not_equal(words, pa.scalar("", words.type))
    coded = words.filter(solid).dictionary_encode()
    kinds = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return kinds[coded.indices.to_numpy(zero_copy_only=False)], rows.filter(solid).to_numpy(zero_copy_only=False).astype(np.int64)


def _parts(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Stretches of a column of bounded size, each with the row where it begins. A long text comes in parts, cut at white space."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    i = 0
    while i < len(column):
        j, size = i + 1, int(sizes[i])
        while j < len(column) and size + sizes[j] <= BLOCK_BYTES:
            size, j = size + int(sizes[j]), j + 1
        if size <= BLOCK_BYTES:
            yield i, column.slice(i, j - i)
        else:
            text, at = column[i].as_py(), 0
            while at < len(text):
                end = min(at + BLOCK_BYTES, len(text))
                while end < len(text) and text[end] not in " \t\n\v\f\r":
                    end += 1
                yield i, pa.array([text[at:end]], pa.large_string())
                at = end
        i = j


def shingles(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of an Arrow string column, and the row of each; rows in order."""
    found = [(h, rows + i) for i, part in _parts(column.cast(pa.large_string())) for h, rows in [_word_hashes(part)]]
    word = np.concatenate([np.zeros(0, np.uint64), *[h for h, _ in found]])
    row = np.concatenate([np.zeros(0, np.int64), *[r for _, r in found]])
    count = np.bincount(row, minlength=len(column))
    out, rows = [], []
    with np.errstate(over="ignore"):
        for n in range(1, words + 1):  # whole shingles; shorter only where a text has no more words
            if len(word) < n:
                break
            good = row[: len(word) - n + 1] == row[n - 1 :]
            if n < words:
                good &= count[row[: len(good)]] == n
            at = np.flatnonzero(good)
            h = np.zeros(len(at), np.uint64)
            for k in range(n):
                h = _mix(h * _GOLD + word[at + k])
            out.append(h)
            rows.append(row[at])
    if not out:
        return word, row
    h, r = np.concatenate(out), np.concatenate(rows)
    order = np.argsort(r, kind="stable")
    return h[order], r[order]


def weighted(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row, with their weights."""
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])]) if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return h[at], rows[at], 1.5 - 0.5 / np.diff(np.append(at, len(h)))


def sketches(h: np.ndarray, rows: np.ndarray, weights: np.ndarray, n: int, places: int = PLACES) -> np.ndarray:
    """ProbMinHash sketches of n rows; zero where a row has no shingle."""
    first = np.full(n * places, np.inf)
    out = np.zeros(n * places, np.uint64)
    alone = np.bincount(rows, minlength=n)[rows] == 1
    out.reshape(n, places)[rows[alone]] = h[alone][:, None]  # all arrivals are its own
    h, rows, weights = h[~alone], rows[~alone], weights[~alone]
    arrival, state = np.zeros(len(h)), h.copy()
    while len(h):
        with np.errstate(over="ignore"):
            state = state + _GOLD
        u = _mix(state)
        arrival = arrival - np.log1p(-((u >> np.uint64(11)).astype(float) * 2.0**-53)) / weights
        place = rows * places + (_mix(u ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(places)).astype(np.int64)
        early = np.flatnonzero(arrival < first[place])
        early = early[np.argsort(-arrival[early], kind="stable")]
        first[place[early]], out[place[early]] = arrival[early], h[early]  # the last one, the earliest, stays
        late = first.reshape(n, places).max(axis=1)
        on = arrival < late[rows]
        h, rows, weights, arrival, state = h[on], rows[on], weights[on], arrival[on], state[on]
    return out.reshape(n, places)


def band_keys(sketch: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A signed 64-bit key of each band of each row."""
    n, places = sketch.shape
    parts = sketch.reshape(n, bands, places // bands)
    with np.errstate(over="ignore"):
        key = np.tile(np.arange(bands, dtype=np.uint64) * _GOLD, (n, 1))
        for k in range(parts.shape[2]):
            key = _mix(key * _GOLD + parts[:, :, k])
    return key.view(np.int64)


def _sketched(docs: DataFrame) -> DataFrame:
    """row, doc_id, digest of the whole text (hi, lo), bands (array of long) and shingle set of each row of ``docs`` (row,
    doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            digests = np.array([np.frombuffer(hashlib.blake2b(x.encode(), digest_size=16).digest(), "<i8") for x in batch.column(2).to_pylist()], np.int64).reshape(n, 2)
            h, rows, weights = weighted(*shingles(batch.column(2)))
            keys = band_keys(sketches(h, rows, weights, n))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            cuts = np.searchsorted(rows, np.arange(n + 1)).tolist()
            short = (h >> np.uint64(32)).astype("<u4")
            sets = pa.array([np.unique(short[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests[:, 0]), pa.array(digests[:, 1]), bands, sets], names=["row", "doc_id", "hi", "lo", "bands", "hashes"])
            trim()

    return docs.select("row", "doc_id", "text").mapInArrow(run, f"row long, doc_id {kind}, hi long, lo long, bands array<long>, hashes binary")


def _fits(a: int, b: int) -> bool:
    """Whether two sets of these sizes can be similar enough."""
    return min(a, b) >= SIMILARITY * max(a, b)


def _overlap(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sorted sets; 0 if their sizes alone rule it out."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    if not _fits(len(x), len(y)):
        return 0.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(len(x) + len(y) - both, 1)


@F.pandas_udf(T.DoubleType())
def _jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_overlap(x, y) for x, y in zip(a, b)], dtype=float)


@F.arrow_udf(T.ArrayType(T.LongType()))
def _members(column: pa.Array) -> pa.Array:
    """The hashes of sets, as numbers."""
    sets = [np.frombuffer(x, "<u4") for x in column.to_pylist()]
    offsets = np.concatenate([[0], np.cumsum(list(map(len, sets)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *sets]).astype(np.int64)))


def _order(node: Column, seed: int) -> Column:
    """One order of all nodes for each seed."""
    return F.xxhash64(node, F.lit(seed))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of the nodes of undirected edges (a, b), by alternating large and small stars."""
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    total = edges.agg(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count("*")).first()
    while total[1]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = checkpointed(small.unionByName(small_least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count("*")).first()
        if now == total:
            break
        total = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough."""
    pairs = checkpointed(pairs)
    if pairs.count() <= FEW_PAIRS:
        few = F.broadcast(pairs)
        half = sets.join(few, sets.node == few.a).select("a", "b", F.col("hashes").alias("x"))
        half = half.alias("h").join(sets.alias("s"), F.col("h.b") == F.col("s.node"))
    else:
        half = pairs.join(sets, pairs.a == sets.node).select("a", "b", F.col("hashes").alias("x")).alias("h").join(sets.alias("s"), F.col("h.b") == F.col("s.node"))
    return half.where(_jaccard(F.col("h.x"), F.col("s.hashes")) >= SIMILARITY).select("h.a", "h.b")


def _rare_keys(hot: DataFrame, sets: DataFrame) -> DataFrame:
    """The nodes of large buckets (node, key, component) under keys of the bucket and each of the node's rarest shingles.

    Of sets of n and m shingles that are similar enough, either's rarest n - ceil(0.8 n) + 1, by one order for the whole
    bucket, hold one of the other's."""
    spread = hot.join(sets, "node").select("key", "node", "component", F.explode(_members(F.col("hashes"))).alias("h"))
    often = spread.groupBy("key", "h").agg(F.count("*").alias("n"))
    ranked = spread.join(often, ["key", "h"]).groupBy("key", "node", "component").agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("own"))  # a group is one text's shingles
    size = F.size("own")
    prefix = F.slice("own", F.lit(1), (size - F.ceil(size * SIMILARITY - 1e-9) + 1).cast("int"))
    rare = ranked.select("key", "node", "component", F.explode(prefix).alias("o"))
    return rare.select("node", F.xxhash64("key", "o.h").alias("key"), "component")


def _sized(left: DataFrame) -> DataFrame:
    """Adds each bucket's size, its largest component and how many nodes others have; buckets of one component go."""
    parts = left.groupBy("key", "component").agg(F.count("*").alias("c"))
    sizes = parts.groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "component")).alias("most"))
    sizes = sizes.select("key", "n", F.col("most.component").alias("main"), (F.col("n") - F.col("most.c")).alias("others"))
    return left.join(sizes.where("others > 0"), "key")


def _placed(sized: DataFrame) -> DataFrame:
    """The nodes of buckets in the blocks where they meet: key, lo, hi, i, node, component.

    A bucket of up to ``BLOCK`` nodes is one block. In larger ones the nodes outside the largest component are cut into
    blocks and that component into others, and each two blocks meet once, except for two of the largest component."""
    small = F.col("n") <= BLOCK
    blocks = F.when(small, 1).otherwise(F.ceil(F.col("others") / BLOCK)).cast("int")
    mains = F.when(small, 0).otherwise(F.ceil((F.col("n") - F.col("others")) / BLOCK)).cast("int")
    sized = sized.withColumn("blocks", blocks).withColumn("mains", mains)
    spread = _order(F.col("node"), 7)
    other = small | (F.col("component") != F.col("main"))
    sized = sized.withColumn("i", F.when(other, F.pmod(spread, F.col("blocks"))).otherwise(F.col("blocks") + F.pmod(spread, F.greatest("mains", F.lit(1)))).cast("int"))
    meets = F.when(F.col("i") < F.col("blocks"), F.col("blocks") + F.col("mains")).otherwise(F.col("blocks"))
    placed = sized.withColumn("j", F.explode(F.sequence(F.lit(0), meets - 1)))
    return placed.select("key", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "node", "component")


def _settled(left: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components within the buckets of ``left`` (node, key, component).

    Buckets with more than a block of nodes outside their largest component are dealt out by rare shingles first. Pairs
    whose ends are connected are passed over, so that a task returns a forest and never all pairs."""
    sized = checkpointed(_sized(left))
    hot = (F.col("n") > BLOCK) & (F.col("others") > BLOCK)
    finer = checkpointed(_rare_keys(sized.where(hot).select("node", "key", "component"), sets))
    placed = _placed(sized.where(~hot)).unionByName(_placed(_sized(finer)))
    rows = placed.join(sets, "node").select("key", "lo", "hi", "i", "node", "component", "hashes")
    dealt = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := above.get(x, x)) != x:
                above[x] = x = above.get(y, y)
            return x

        def groups():
            held, name = [], None
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns))):
                    if row[:3] != name:
                        if len(held) > 1:
                            yield held
                        held, name = [], row[:3]
                    held.append(row[3:])
            if len(held) > 1:
                yield held

        a_out, b_out = [], []
        for group in groups():
            side, node, component, hashes = zip(*group)
            for k, m in _links(np.array(side), np.array(component), [np.frombuffer(x, "<u4") for x in hashes], top, above):
                a_out.append(node[k])
                b_out.append(node[m])
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _links(side: np.ndarray, component: np.ndarray, sets: list[np.ndarray], top, above: dict[int, int]) -> Iterator[tuple[int, int]]:
    """Pairs of similar sets that connect components, which ``top`` and ``above`` keep; of two blocks, only pairs across."""
    if len({top(c) for c in component.tolist()}) == 1:
        return
    sizes = np.array(list(map(len, sets)))
    order = np.argsort(sizes, kind="stable")
    kinds, codes = np.unique(np.concatenate([sets[i] for i in order.tolist()]), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(sizes[order])])
    has = np.zeros(len(kinds), bool)
    two = side.min() != side.max()
    for p, k in enumerate(order.tolist()):
        # only sets of like size, which stand after it, can be similar enough
        end = int(np.searchsorted(sizes[order], math.floor(sizes[k] / SIMILARITY + 1e-9), "right"))
        rest = order[p + 1 : end]
        keep = component[rest] != component[k]
        if two:
            keep &= side[rest] != side[k]
        if not keep.any() or not sizes[k]:
            continue
        own = codes[begin[p] : begin[p + 1]]
        has[own] = True
        both = np.add.reduceat(has[codes[begin[p + 1] : begin[end]]], begin[p + 1 : end] - begin[p + 1], dtype=np.int64)
        has[own] = False
        for m in np.flatnonzero(keep & (both >= SIMILARITY * (sizes[k] + sizes[rest] - both))).tolist():
            x, y = top(int(component[k])), top(int(component[rest[m]]))
            if x != y:
                above[x] = y
                yield k, int(rest[m])


def node_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, node) of each row, and (node, component) of the nodes that have near duplicates among other texts.

    ``docs``: row (unique), doc_id and text. A node is the smallest row of equal texts."""
    sketched = written(_sketched(docs), "sketches")
    firsts = sketched.groupBy("hi", "lo").agg(F.min("row").alias("node"))
    nodes = sketched.select("row", "doc_id", "hi", "lo").join(firsts, ["hi", "lo"]).select("row", "doc_id", "node")
    nodes = written(nodes, "nodes")
    own = nodes.where("row = node").select("node")
    bands = sketched.select(F.col("row").alias("node"), "bands").join(own, "node", "left_semi").select("node", F.explode("bands").alias("key"))
    sizes = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    shared = written(bands.join(sizes, "key"), "buckets")  # node, key of the buckets that hold several texts
    wanted = shared.select("node").distinct()
    sets = written(sketched.select(F.col("row").alias("node"), "hashes").join(wanted, "node", "left_semi"), "shingle-sets")

    links, labels, left = [], None, shared.withColumn("component", F.col("node"))
    for step in range(ROUNDS + 1):
        if step < ROUNDS:
            # the nodes with most company lead, which originals have among their copies; in further rounds, any
            busy = left.join(left.groupBy("key").agg(F.count("*").alias("n")), "key").groupBy("node").agg(F.sum("n").alias("busy"))
            ranked = left.join(busy, "node").withColumn("rank", F.struct("busy", _order(F.col("node"), step)) if step == 0 else _order(F.col("node"), step))
            leaders = ranked.groupBy("key").agg(F.max_by(F.struct("node", "component"), F.col("rank")).alias("leader"))
            pairs = left.join(leaders, "key").where("component <> leader.component").select(F.col("node").alias("a"), F.col("leader.node").alias("b"))
            links.append(checkpointed(_similar(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), sets)))
        else:
            links.append(checkpointed(_settled(left, sets)))
        labels = written(components(functools.reduce(DataFrame.unionByName, links)), "components")
        if step == ROUNDS:
            break
        placed = left.drop("component").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
        left = written(placed.join(mixed, "key").select("node", "key", "component"), "mixed-buckets")
    return nodes, labels


def _decided(rows: DataFrame) -> DataFrame:
    """row, doc_id, class_id, class_size, kept of each of ``rows`` (row, doc_id, text)."""
    nodes, labels = node_classes(rows)
    named = nodes.join(labels, "node", "left").select("row", "doc_id", F.coalesce("component", "node").alias("component"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    sizes = named.groupBy("component").agg(F.min(first).alias("first"), F.count("*").alias("class_size"))
    return named.join(sizes, "component").select("row", "doc_id", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("first.row")).alias("kept"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, class_id (the class's smallest doc_id), class_size, kept (one row of each class)."""
    tune(docs.sparkSession)
    return _decided(texts(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())).drop("row")


def near_deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of each class that ``near_classes`` keeps, with all its columns."""
    tune(docs.sparkSession)
    row = unused(docs, "row")
    held = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")  # numbers that stay the same
    rows = held.select(F.col(row).alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    gone = _decided(rows).where("NOT kept").select(F.col("row").alias(row))
    return held.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
