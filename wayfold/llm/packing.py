"""Best-fit packing by non-negative least squares.

Texts are tokenised and only those longer than a sequence are cut. The histogram of piece lengths, at most one number
for each length, goes to the driver. There all patterns of up to three lengths that fill a sequence exactly are
enumerated, their repeat counts are fitted to the histogram by non-negative least squares and rounded, and what they
leave is packed by best fit, decreasing, over the histogram. The plan has a few thousand rows whatever the input's
size. Each piece finds its place by its rank among the pieces of its length; ranks are counted in salted groups, so that a
length that half of all pieces have is spread as well.

Defined results: null and empty texts are the end token alone; texts of any length are cut into as many pieces as they need;
pieces of equal length take the places of that length in order of doc_id and piece; repeated rows are packed each for
itself; no rows give no rows; other columns, of whatever name, aren't read. Sequence numbers are unique and otherwise
without meaning.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, trim, tune, written

CAPACITY = 1024
END_ID = 2
#: What may be added to fitted counts before their fraction is cut off; the sum that leads to the fewest sequences is taken.
ROUND = (-1.0, -0.5, 0.0, 0.25, 0.5)
#: Pieces of one length that are ranked in one group, at least.
GROUP_ROWS = 4096
GROUPS = 500_000


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and with ``keep_ids`` the ids (array of int)."""
    tune(docs.sparkSession)
    rows = texts(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import id_table

        table = id_table(vocabulary)
        for batch in batches:
            owner, out, held = [], [], []
            for i, own in enumerate(table.texts(batch.column(1))):
                ids = own.tobytes() + end
                n = len(ids) // 4
                at, size = 0, (n - 1) % capacity + 1
                for piece in range(-(-n // capacity)):
                    cut = ids[4 * at : 4 * (at + size)]
                    owner.append(i)
                    out.append((piece, at, size, zlib.crc32(cut)))
                    if keep_ids:
                        held.append(np.frombuffer(cut, "<i4"))
                    at, size = at + size, capacity
            if owner:
                a, b, c, d = zip(*out)
                arrays = [batch.column(0).take(pa.array(owner)), pa.array(a, pa.int32()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    arrays.append(pa.array(held, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)
            trim()

    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def patterns(present: np.ndarray, capacity: int) -> np.ndarray:
    """All ways to fill a sequence exactly with two or three of the lengths that are present; 0 is no piece.

    Lengths under 3/16 of a sequence stay out: they fill the gaps in what the fit leaves over."""
    has = np.zeros(capacity + 1, bool)
    has[present] = True
    has[: 3 * capacity // 16] = False
    a, b = np.triu_indices(capacity // 2 + 1)
    c = capacity - a - b
    ok = (c >= b) & (has[a] | (a == 0)) & has[b] & has[c]
    return np.column_stack([a, b, c])[ok]


def fit_counts(hist: np.ndarray, pats: np.ndarray, block: int = 96, tolerance: float = 0.05) -> np.ndarray:
    """Non-negative repeat counts of patterns by an active-set method that takes in ``block`` patterns at a time, until no
    pattern's gradient exceeds the tolerance or the residual falls no more.

    A length's residual weighs as much as the length: short pieces that are left over fill gaps, long ones make them."""
    size = len(hist)
    weight = np.arange(size) / size
    x = np.zeros(len(pats))
    active: list[int] = []
    used = np.zeros(len(pats), bool)

    def matrix(cols: list[int]) -> np.ndarray:
        a = np.zeros((size, len(cols)))
        for k in range(3):
            np.add.at(a, (pats[cols, k], np.arange(len(cols))), 1.0)
        return a * weight[:, None]

    target = hist * weight
    residual = target.copy()
    while True:
        gradient = (residual * weight)[pats].sum(axis=1)
        gradient[used] = -np.inf
        taken, lengths = [], set()
        for j in np.argsort(-gradient)[: 40 * block]:
            if gradient[j] < tolerance or len(taken) == block:
                break
            own = set(pats[j].tolist()) - {0}
            if not own & lengths:
                taken.append(int(j))
                lengths |= own
        if not taken:
            break
        active += taken
        used[taken] = True
        while active:
            a = matrix(active)
            z = np.linalg.solve(a.T @ a + 1e-6 * np.eye(len(active)), a.T @ target)
            if z.min() > 0:
                x[:] = 0
                x[active] = z
                break
            old = x[active]
            falling = z <= 0
            step = min(1.0, float((old[falling] / np.maximum(old[falling] - z[falling], 1e-12)).min()))
            moved = old + step * (z - old)
            keep = (moved > 1e-9) & ~(falling & (old <= 1e-9))
            x[:] = 0
            active = [j for j, k in zip(active, keep) if k]
            x[active] = moved[keep]
        before, residual = residual, target - matrix(active) @ x[active] if active else target.copy()
        if len(active) >= size or residual @ residual >= (before @ before) * (1 - 1e-9):
            break
    return x


def plan(hist: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths in order, number of such sequences); every piece of the histogram has one place."""
    left = hist.astype(np.int64).copy()
    left[0] = 0
    full = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    pats = patterns(np.flatnonzero(left), capacity)
    x = fit_counts(left.astype(float), pats) if len(pats) else np.zeros(0)
    return full + min((_rounded(left, pats, x, r, capacity) for r in ROUND), key=lambda p: sum(n for _, n in p))


def _rounded(hist: np.ndarray, pats: np.ndarray, x: np.ndarray, round_by: float, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences of the patterns by their rounded counts, and of what they leave by best fit."""
    left, out = hist.copy(), []
    for j in np.argsort(-x, kind="stable"):
        n = int(np.floor(x[j] + round_by))
        if n < 1:
            break
        own = [int(v) for v in pats[j] if v]
        n = min(n, *(int(left[v]) // own.count(v) for v in own))
        if n:
            out.append((tuple(own[::-1]), n))
            for v in own:
                left[v] -= n
    return out + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, decreasing, over a histogram: pieces of one length go to equal sequences together."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by the room that is left
    for length in range(capacity, 0, -1):
        count = int(left[length])
        while count:
            room = next((r for r in range(length, capacity) if bins.get(r)), capacity)
            own, n = bins[room].pop() if room < capacity else ((), count)
            each = min(room // length, count)
            full = min(n, count // each)
            bins.setdefault(room - each * length, []).append((own + (length,) * each, full))
            count -= each * full
            if room < capacity and n > full:
                bins.setdefault(room, []).append((own, n - full))
    return [x for group in bins.values() for x in group]


def assign(rows: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, groups: int = GROUPS) -> DataFrame:
    """Adds sequence_id and offset to rows with ``length``; all other columns stay.

    ``rows`` is read several times, so it should be a written table with the columns doc_id and piece."""
    spark = rows.sparkSession
    hist = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("length").count().collect():
        hist[r["length"]] = r["count"]
    slots = []  # length, first rank, first sequence, offset
    nth, sequence = np.zeros(capacity + 1, np.int64), 0
    for lengths, n in plan(hist, capacity):
        offset = 0
        for v in lengths:
            slots.append((v, int(nth[v]), sequence, offset))
            nth[v] += n
            offset += v
        sequence += n
    slots.sort()
    table = np.array(slots, np.int64).reshape(-1, 4)
    keys = (table[:, 0] << 48) + table[:, 1]

    per_group = max(group_rows, int(hist.sum()) // groups)
    sizes = [(v, int(-(-n // per_group))) for v, n in enumerate(hist.tolist()) if n]
    salts = spark.createDataFrame(pd.DataFrame(sizes or [(0, 1)], columns=["length", "_salts"]))
    salted = rows.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("_salts"))).drop("_salts")
    counts = salted.groupBy("length", "_salt").count()  # at most groups and one more for each length
    from pyspark.sql import Window

    order = Window.partitionBy("length").orderBy("_salt")
    bases = counts.select("length", "_salt", (F.sum("count").over(order) - F.col("count")).alias("_base"))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(F.broadcast(bases), ["length", "_salt"])

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        v, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(keys, (v << 48) + r, side="right") - 1
        return pd.DataFrame({"sequence_id": table[at, 2] + r - table[at, 1], "offset": table[at, 3]})

    done = ranked.withColumn("_place", placed(F.col("length"), F.col("_base") + F.col("_rank")))
    return done.select(*rows.columns, "_place.sequence_id", "_place.offset")


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Every piece with its sequence and its place there. With ``keep_ids``, ``sequences`` builds the token arrays."""
    cut = written(pieces(docs, vocabulary, id_col, text_col, capacity, end_id, keep_ids), "pieces")
    return assign(cut, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (array of int) and doc_ids of each packed sequence; a group holds at most one sequence's tokens."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
