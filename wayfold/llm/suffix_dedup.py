"""Removal of repeated passages by suffix sorting in shards.

Every byte that is covered by a ``WINDOW``-byte string which also starts earlier goes; earlier is a smaller doc_id, or an
earlier start in the same document. Equal windows must meet, so windows are dealt out by content: the least hash of the
``GRAM``-byte strings in a window. Neighbouring windows with the least at the same place make a unit, about one for each 35
bytes.

1. Each batch of documents gives its units as (least hash, digest of the unit's bytes, document, start), packed for buckets
   of least hashes. Units of equal bytes are reduced to the earliest, in the batch and in the bucket: all windows of the
   others start earlier there. Units that alone have their least hash repeat nowhere.
2. What is left are units whose least hash has several contents. Their bytes are fetched and dealt out by least hash to shards.
   Each is trimmed to the bytes around its least gram that other units of its hash have there too, or left out if these
   hold no window. All suffixes of a shard are put in order by external induced sorting (``induced``) with common prefixes. A stretch of
   the order with common prefixes of ``WINDOW`` and more is one window's occurrences; all but the first are removed.
3. The removed stretches of a document meet its text.

A least hash that very many contents share would gather them in one bucket. A sample of the documents shows which these
may be; their units are dealt out window by window, by a 128-bit digest of the whole window, which is spread evenly. The
sample decides about the way alone, not about results: a hash that it misses stays in one bucket.

Digests of units are 64 bits beside the 64 bits of the least hash; those of single windows 128 bits.

Defined results: null texts are empty; texts are UTF-8 bytes, and a cut may fall inside a character; texts shorter than a
window lose nothing; rows of equal doc_id come in the order of their texts, and null ids after all others; repeated rows
are documents of their own, so that of equal ones the first stays; texts of any length are read whole; no rows give no
rows; other columns, of whatever name, aren't read.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, trim, tune, written
from .induced import Space, suffixes

WINDOW, GRAM = 100, 32
#: Windows that are hashed together, which 20 bits count, and units packed together.
BLOCK, PACKED = 1 << 19, 1 << 20
#: Part of the documents that shows which least hashes are hot: with at least so many contents, and one in so many units.
SAMPLE, HOT_CONTENTS, HOT_PART = 0.01, 50, 1000
#: Bytes of text in a bucket of units, and of units in a shard of suffixes.
BUCKET_BYTES, SHARD_BYTES = 32 << 20, 6 << 20
_B, _B_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    both = []
    for b in (_B, _B_INVERSE):
        steps = np.full(n, b, np.uint64)
        steps[0] = 1
        both.append(np.cumprod(steps))
    return both[0], both[1]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all grams; their places have no part in them."""
    n = len(data)
    power, inverse = _powers(BLOCK + WINDOW)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n])])
    h = (sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def least_grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams, and the place of the least one in each window, the last of equal ones.

    Hashes are compared by 44 bits, with the place behind them."""
    h = gram_hashes(data)
    low = np.uint64((1 << 20) - 1)
    least = h & ~low | low - np.arange(len(h), dtype=np.uint64)
    grams, reach = WINDOW - GRAM + 1, 1
    while 2 * reach <= grams:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if grams > reach:
        least = np.minimum(least[: len(least) - (grams - reach)], least[grams - reach :])
    return h, (low - (least & low)).astype(np.int64)


def _units(data: np.ndarray, offsets: np.ndarray, hot: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Units of texts that lie one after another, by blocks: least hash, digest, text, start in it, windows."""
    view = memoryview(data)
    ends = offsets[1:] - WINDOW + 1  # of the windows that start in a text
    whole = np.flatnonzero(ends > offsets[:-1])
    marks = np.concatenate([offsets[whole], ends[whole]])
    for low in range(0, max(len(data) - WINDOW + 1, 0), BLOCK):
        high = min(low + BLOCK, len(data) - WINDOW + 1)
        hashes, place = least_grams(data[low : high + WINDOW - 1])
        cuts = np.unique(np.concatenate([[low, high], np.flatnonzero(place[1:] != place[:-1]) + low + 1, marks[(marks > low) & (marks < high)]]))
        start, size = cuts[:-1], np.diff(cuts)
        text = np.searchsorted(offsets, start, "right") - 1
        own = start < ends[text]
        start, size, text = start[own], size[own], text[own]
        h = hashes[place[start - low]]
        single = np.isin(h, hot) if len(hot) else np.zeros(len(h), bool)
        if single.any():  # window by window
            parts = np.where(single, size, 1)
            k = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
            start, text, h, single = np.repeat(start, parts) + k, np.repeat(text, parts), np.repeat(h, parts), np.repeat(single, parts)
            size = np.where(single, 1, np.repeat(size, parts))
        begin, end = start.tolist(), (start + size + WINDOW - 1).tolist()
        digest = np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(begin, end)], np.uint64)
        if single.any():
            at = np.flatnonzero(single)
            long = [xxhash.xxh3_128_intdigest(view[begin[i] : end[i]]) for i in at.tolist()]
            h[at] = np.array([x >> 64 for x in long], np.uint64)
            digest[at] = np.array([x & (1 << 64) - 1 for x in long], np.uint64)
        yield h, digest, text, start - offsets[text], size


def _text_units(batch: pa.RecordBatch, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """Units of a batch of documents: least hash, digest, document, start, windows."""
    column = batch["text"].cast("large_string")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    got = [tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64)), *_units(data, offsets - offsets[0], hot)]
    h, digest, text, start, size = (np.concatenate(x) for x in zip(*got))
    return h, digest, batch["key"].to_numpy()[text], start, size


def _reduced(h: np.ndarray, digest: np.ndarray, key: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest unit of each content, in the order of least hashes, and all others."""
    order = np.lexsort((start, key, digest, h))
    first = np.append(True, (h[order][1:] != h[order][:-1]) | (digest[order][1:] != digest[order][:-1]))[: len(order)]
    return order[first], order[~first]


def _stretches(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of documents, joined where they meet."""
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], end[order]
    if not len(key):
        return key, start, end
    span = int(end.max()) + 2
    rank = np.cumsum(np.append(False, key[1:] != key[:-1])) * span
    reach = np.maximum.accumulate(end + rank)
    new = np.append(True, start[1:] + rank[1:] > reach[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(key)) - 1
    return key[at], start[at], reach[last] - rank[last]


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low bytes of numbers, each in a row of its own, as high ones compress best."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _numbers(data: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(data) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return wide.view("<u8").ravel()


_WIDTHS = (8, 8, 8, 4, 1)


def _pack(units: list[tuple[np.ndarray, ...]], buckets: int) -> Iterator[pa.RecordBatch]:
    h, digest, key, start, size = (np.concatenate(x) for x in zip(*units))
    bucket = (h >> np.uint64(20)) % np.uint64(buckets)
    order = np.lexsort((key, bucket))
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    parts = [x for x in np.split(order, cuts) if len(x)]
    blobs = [b"".join(_planes(v[x] if w > 1 else v[x], w) for v, w in zip((h, digest, key, start, size), _WIDTHS)) for x in parts]
    yield pa.RecordBatch.from_arrays([pa.array([int(bucket[x[0]]) for x in parts], pa.int64()), pa.array(blobs, pa.binary()), *[pa.nulls(len(parts), pa.int64())] * 3], names=["bucket", "units", "key", "start", "stop"])


def _unpack(blobs: list[bytes]) -> list[np.ndarray]:
    width, out = sum(_WIDTHS), [[] for _ in _WIDTHS]
    for blob in blobs:
        n, at = len(blob) // width, 0
        for own, w in zip(out, _WIDTHS):
            own.append(_numbers(blob[at : at + n * w], w))
            at += n * w
    return [np.concatenate(x) for x in out]


def _removed(key: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[pa.Array]:
    key, start, stop = _stretches(key.astype(np.int64), start.astype(np.int64), stop.astype(np.int64))
    return [pa.array(key), pa.array(start), pa.array(stop)]


def _hot(docs: DataFrame) -> np.ndarray:
    """Least hashes that many contents share, by a sample of the documents; at most ``HOT_PART`` of them."""
    none = np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, digest, *_ = _text_units(batch, none)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(digest.view(np.int64))], names=["h", "digest"])

    pairs = docs.sample(SAMPLE, 7).mapInArrow(run, "h long, digest long").groupBy("h", "digest").agg(F.count("*").alias("n"))
    sums = pairs.groupBy("h").agg(F.count("*").alias("contents"), F.sum("n").alias("n"))
    total = F.broadcast(sums.agg(F.sum("n").alias("all")))
    hot = sums.where(f"contents >= {HOT_CONTENTS}").join(total).where(F.col("n") * HOT_PART >= F.col("all")).select("h").collect()
    return np.sort(np.array([r.h for r in hot], np.int64).view(np.uint64))


def _unit_rows(docs: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """Packed units for buckets, and stretches that repeat within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            units = _text_units(batch, hot)
            if not len(units[0]):
                continue
            first, rest = _reduced(*units)
            held.append(tuple(v[first] for v in units))
            count += len(first)
            if len(rest):
                _, _, key, start, size = (v[rest] for v in units)
                gone = _removed(key, start, start + size + WINDOW - 1)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(gone[0]), pa.int64()), pa.nulls(len(gone[0]), pa.binary()), *gone], names=["bucket", "units", "key", "start", "stop"])
            if count >= PACKED:
                yield from _pack(held, buckets)
                held, count = [], 0
        if held:
            yield from _pack(held, buckets)
        trim()

    return docs.select("key", "text").mapInArrow(run, "bucket long, units binary, key long, start long, stop long")


def _settle(rows: DataFrame) -> DataFrame:
    """h, key, start, stop: with h a unit whose least hash has several contents, without a stretch to remove."""

    def run(table: pa.Table) -> pa.Table:
        h, digest, key, start, size = _unpack(table["units"].to_pylist())
        first, rest = _reduced(h, digest, key, start, size)
        own = h[first]
        several = np.append(False, own[1:] == own[:-1]) | np.append(own[1:] == own[:-1], False)
        ask = first[several]
        stop = start + size + np.uint64(WINDOW - 1)
        gone = _removed(key[rest], start[rest], stop[rest])
        return pa.table([pa.concat_arrays([pa.array(h[ask].view(np.int64)), pa.nulls(len(gone[0]), pa.int64())]), *(pa.concat_arrays([pa.array(v[ask].astype(np.int64)), g]) for v, g in zip((key, start, stop), gone))], names=["h", "key", "start", "stop"])

    return rows.where("bucket IS NOT NULL").select("bucket", "units").groupBy("bucket").applyInArrow(run, "h long, key long, start long, stop long")


def _shared(rows: np.ndarray, size: np.ndarray, h: np.ndarray) -> np.ndarray:
    """How many leading bytes each row has in common with any other of its hash; rows hold so many bytes of their own."""
    words = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    words[:, : rows.shape[1]] = rows
    order = np.lexsort((size, *words.view(">u8").T[::-1], h))
    rows, size, h = rows[order], size[order], h[order]
    same = np.cumprod(rows[1:] == rows[:-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    same = np.where(h[1:] == h[:-1], np.minimum(same, np.minimum(size[1:], size[:-1])), 0)
    out = np.zeros(len(rows), np.int64)
    out[order] = np.maximum(np.append(same, 0), np.append(0, same))
    return out


def trimmed(h: np.ndarray, contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Where each unit begins and ends to share windows with others of its least hash: around the least gram, as far as
    some other unit has the same bytes to the left, and some other to the right. Equal if there is no such window."""
    sizes = np.array(list(map(len, contents)), np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(contents) + bytes(GRAM), np.uint8)
    unit = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(unit)) - np.repeat(ends - sizes, sizes)
    step = BLOCK
    hashes = np.concatenate([gram_hashes(data[k : k + step + GRAM - 1]) for k in range(0, len(unit), step)])[: len(unit)]
    windows = sizes - WINDOW + 1
    hit = np.flatnonzero((hashes == h[unit]) & (place >= windows[unit] - 1) & (place <= WINDOW - GRAM))
    at = np.full(len(sizes), -1, np.int64)
    at[unit[hit]] = place[hit]  # of several the last
    begin, end = np.zeros(len(sizes), np.int64), sizes.copy()
    own = np.flatnonzero(at >= 0)  # single windows of hot hashes have none
    if len(own):
        reach = np.arange(WINDOW - GRAM)
        first = (ends - sizes)[own] + at[own]
        left, right = at[own], sizes[own] - at[own] - GRAM
        to_left = _shared(data[np.maximum(first[:, None] - 1 - reach, 0)], np.minimum(left, WINDOW - GRAM), h[own])
        to_right = _shared(data[np.minimum(first[:, None] + GRAM + reach, len(data) - 1)], np.minimum(right, WINDOW - GRAM), h[own])
        begin[own], end[own] = at[own] - to_left, at[own] + GRAM + to_right
    return begin, np.where(end - begin >= WINDOW, end, begin)


def shard_repeats(h: np.ndarray, key: np.ndarray, start: np.ndarray, contents: list[bytes], space: Space) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches of units that repeat a window of an earlier place, by the order of all their suffixes."""
    begin, end = trimmed(h, contents)
    some = np.flatnonzero(end > begin)
    if not len(some):
        return key[:0], start[:0], start[:0]
    contents = [contents[i][a:b] for i, a, b in zip(some.tolist(), begin[some].tolist(), end[some].tolist())]
    key, start = key[some], start[some] + begin[some]
    order = np.lexsort((start, key))
    key, start, contents = key[order], start[order], [contents[i] for i in order.tolist()]
    sizes = np.array(list(map(len, contents)), np.int64)
    n = int(sizes.sum()) + len(sizes)
    ends = np.cumsum(sizes + 1)
    text = space.array(n, np.int64)
    text[:] = len(sizes)
    text[ends - 1] = np.arange(len(sizes))[::-1]  # each unit ends with a symbol of its own, the last one with the smallest
    inner = np.ones(n, bool)
    inner[ends - 1] = False
    text[inner] += np.frombuffer(b"".join(contents), np.uint8)
    places, shared = suffixes(text, WINDOW, space)
    one = np.flatnonzero(shared >= WINDOW)
    if not len(one):
        return key[:0], start[:0], start[:0]
    # stretches of the order with the window in common; places are in the order of documents, so the least is the first
    member = np.zeros(n + 1, bool)
    member[one] = True
    heads = np.flatnonzero(member[1:] & ~member[:-1])
    in_class = member[:-1].copy()
    in_class[heads] = True
    rows = np.flatnonzero(in_class)
    own = places[rows]
    begin = np.searchsorted(rows, heads)
    least = np.minimum.reduceat(own, begin)
    repeat = own[own != np.repeat(least, np.diff(np.append(begin, len(own))))]
    unit = np.searchsorted(ends, repeat, "right")
    offset = repeat - (ends[unit] - sizes[unit] - 1) + start[unit]
    return _stretches(key[unit], offset, offset + WINDOW)


def _sorted_repeats(units: DataFrame) -> DataFrame:
    """key, start, stop: what suffix sorting removes of units (h, key, start, content). A partition is a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, key, start, contents = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for batch in batches:
            h.append(batch["h"].to_numpy())
            key.append(batch["key"].to_numpy())
            start.append(batch["start"].to_numpy())
            contents += batch["content"].to_pylist()
        if contents:
            space = Space()
            try:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, shard_repeats(np.concatenate(h).view(np.uint64), np.concatenate(key), np.concatenate(start), contents, space))), names=["key", "start", "stop"])
            finally:
                space.close()
        trim()

    return units.select("h", "key", "start", "content").mapInArrow(run, "key long, start long, stop long")


def _contents(keyed: DataFrame, asked: DataFrame) -> DataFrame:
    """h, key, start, content: the bytes of units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, own in zip(batch["key"].to_pylist(), batch["text"].to_pylist(), batch["asked"].to_pylist()):
                data = text.encode()
                yield pa.RecordBatch.from_arrays([pa.array([x["h"] for x in own], pa.int64()), pa.array([key] * len(own), pa.int64()), pa.array([x["start"] for x in own], pa.int64()), pa.array([data[x["start"] : x["stop"]] for x in own], pa.binary())], names=["h", "key", "start", "content"])

    lists = asked.groupBy("key").agg(F.collect_list(F.struct("h", "start", "stop")).alias("asked"))
    return keyed.join(lists, "key", "left").where("asked IS NOT NULL").select("key", "text", "asked").mapInArrow(run, "h long, key long, start long, content binary")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """Documents with a key in the order of ids: the id, or where ids are missing or repeat, a number made by sorting."""
    own = texts(docs, f"`{id_col}`", f"`{text_col}`").withColumn("doc_id", F.col("doc_id").cast("long"))
    twice = own.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL OR doc_id < 0")
    if twice.limit(1).count():
        own = written(own.orderBy(F.asc_nulls_last("doc_id"), "text").withColumn("key", F.monotonically_increasing_id()), "keyed")
        return own.select("key", "doc_id", "text"), False
    return own.select(F.col("doc_id").alias("key"), "text"), True


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, spans: of every document the maximal stretches of bytes that repeat earlier ones, in order."""
    spark = docs.sparkSession
    tune(spark)
    keyed, plain = _keyed(docs, id_col, text_col)
    body = keyed.select("key", "text")
    size = int(body.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BUCKET_BYTES))
    rows = written(_unit_rows(body, _hot(body), buckets), "units")
    settled = written(_settle(rows), "settled")
    asked = settled.where("h IS NOT NULL")
    shards = max(1, math.ceil((asked.agg(F.sum(F.col("stop") - F.col("start"))).first()[0] or 0) / SHARD_BYTES))
    more = _sorted_repeats(_contents(body, asked).repartition(shards, "h"))
    gone = rows.where("bucket IS NULL").select("key", "start", "stop").unionByName(settled.where("h IS NULL").select("key", "start", "stop")).unionByName(more)
    lists = gone.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    out = body.join(lists, "key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for own in batch["spans"].to_pylist():
                start, stop = (np.array([x[k] for x in own or ()], np.int64) for k in ("start", "stop"))
                _, start, stop = _stretches(np.zeros(len(start), np.int64), start, stop)
                spans.append([{"start": a, "stop": b} for a, b in zip(start.tolist(), stop.tolist())])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch["key"], batch["text"], pa.array(spans, kind)], names=["key", "text", "spans"])

    out = out.select("key", "text", "spans").mapInArrow(run, "key long, text string, spans array<struct<start:long,stop:long>>")
    if plain:
        return out.withColumnRenamed("key", "doc_id")
    return out.join(keyed.select("key", "doc_id"), "key").select("doc_id", "text", "spans")


def _kept(text: str, spans: list) -> bytes:
    data, at, out = text.encode(), 0, []
    for x in spans:
        out.append(data[at : x["start"]])
        at = x["stop"]
    return b"".join([*out, data[at:]])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kept: the bytes of every document without those that repeat earlier ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [_kept(t, s) for t, s in zip(batch["text"].to_pylist(), batch["spans"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(kept, pa.binary())], names=["doc_id", "kept"])

    return repeats(docs, id_col, text_col).mapInArrow(run, "doc_id long, kept binary")


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gone, spans, digest = [], [], [], []
            for text, own in zip(batch["text"].to_pylist(), batch["spans"].to_pylist()):
                kept = _kept(text, own)
                gone.append(sum(x["stop"] - x["start"] for x in own))
                size.append(len(kept) + gone[-1])
                spans.append(len(own))
                digest.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(v, pa.int64()) for v in (size, gone, spans)), pa.array(digest, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return repeats(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
