"""Exact deduplication by Grace hashing.

Records meet in a hash table with open addressing that compares complete contents. A table that has reached its memory
bound takes no new content: records it doesn't hold yet go to spill files by further bits of their hash, and each file
is then read with an empty table, recursively. Copies of held content never spill, so a group of any size costs one
entry.

The work is done twice. First each input partition is reduced to one record for each distinct text, with a count; then
these records are dealt out by hash and reduced again. A group that holds a third of all rows thus reaches the second
step as one record for each partition at most. The decisions go back to the rows by a join on the partition's group,
whose large partitions Spark can split.

Defined results: null text equals empty text; null identifiers are smaller than all others; of rows equal in text and
identifier exactly one is kept; texts of any length are compared whole, without normalisation, and one that exceeds a table
by itself is held alone; no rows give no rows; other columns, of whatever name and type, aren't read for the decision and
come back unchanged from ``exact_deduplicate``.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import texts, trim, tune, written

#: Bytes of distinct text in a table before it spills, and spill files at each level.
TABLE_BYTES = 96 << 20
FANOUT = 16
_ENTRY_BYTES = 300


class ContentTable:
    """Open addressing with linear probing over 64-bit hashes; equal hashes are settled by the complete content."""

    def __init__(self, limit: int) -> None:
        self.limit, self.held = limit, 0
        self.slots: list[int] = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []

    def find(self, h: int, content: bytes) -> int:
        """The entry of a content, or -1."""
        slots, mask = self.slots, len(self.slots) - 1
        at = h & mask
        while (entry := slots[at]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                return entry
            at = (at + 1) & mask
        return -1

    def full(self) -> bool:
        return self.held >= self.limit

    def add(self, h: int, content: bytes) -> int:
        if 3 * len(self.hashes) > 2 * len(self.slots):
            self._grow()
        entry = len(self.hashes)
        self._place(h, entry)
        self.hashes.append(h)
        self.contents.append(content)
        self.held += len(content) + _ENTRY_BYTES
        return entry

    def _place(self, h: int, entry: int) -> None:
        mask = len(self.slots) - 1
        at = h & mask
        while self.slots[at] >= 0:
            at = (at + 1) & mask
        self.slots[at] = entry

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        for entry, h in enumerate(self.hashes):
            self._place(h, entry)


def grace(records: Iterator[tuple[bytes, tuple]], merge: Callable, finish: Callable, limit: int = TABLE_BYTES, fanout: int = FANOUT, depth: int = 0) -> Iterator:
    """Groups records by content within bounded memory.

    ``merge(state, record)`` gives a group's new state, from None on, and rows to return at once;
    ``finish(content, state)`` gives the rows of a complete group. Spill files live in the task's own temporary folder
    and go with the task: a lost task starts again from its input.
    """
    import pickle

    contents, states, files = ContentTable(limit), [], [None] * fanout
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        for content, record in records:
            h = xxhash.xxh3_64_intdigest(content, seed=depth)
            entry = contents.find(h, content)
            if entry < 0:
                if contents.full():
                    part = (h >> 32) % fanout
                    if files[part] is None:
                        files[part] = open(os.path.join(folder, str(part)), "wb")
                    pickle.dump((content, record), files[part], protocol=5)
                    continue
                entry = contents.add(h, content)
                states.append(None)
            states[entry], now = merge(states[entry], record)
            yield from now
        for content, state in zip(contents.contents, states):
            yield from finish(content, state)
        del contents, states
        trim()
        for f in files:
            if f is not None:
                f.close()
        for part, f in enumerate(files):
            if f is not None:
                yield from grace(_unspilled(os.path.join(folder, str(part))), merge, finish, limit, fanout, depth + 1)
                os.remove(os.path.join(folder, str(part)))


def _unspilled(path: str) -> Iterator[tuple[bytes, tuple]]:
    import pickle

    with open(path, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of rows; the text, if any, is the last column."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[-1]) if isinstance(row[-1], str) else 0
        if len(held) >= size or n >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _key(doc_id) -> tuple:
    return (doc_id is not None, doc_id)


def _schema(docs: DataFrame, fields: str) -> T.StructType:
    """A schema in which ``{id}`` is the identifier's type and ``{payload}`` that of the other columns."""
    out = T.StructType()
    for field in fields.split(", "):
        name, kind = field.split(" ")
        out.add(name, docs.schema[{"{id}": "doc_id", "{payload}": "payload"}[kind]].dataType if kind[0] == "{" else kind)
    return out


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and a struct of all other columns, by place, as payload."""
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    payload = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]) if rest else F.lit(True)
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), payload.alias("payload"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def local_groups(docs: DataFrame, limit: int = TABLE_BYTES) -> DataFrame:
    """One row for each document: ``rid`` numbers the row, ``gid`` the group of equal texts within its partition.

    The group's row of the largest identifier also has the text, its hashes and the number of copies.
    ``docs``: doc_id, payload (what goes with the row that stays) and text.
    """
    fields = _schema(docs, "rid long, doc_id {id}, gid long, copies long, h long, text_sha256 string, payload {payload}, text string")
    schema = _arrow(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40

        def records():
            rid = base
            for batch in batches:
                for doc_id, payload, text in zip(*(c.to_pylist() for c in batch.columns)):
                    yield text.encode(), (rid, doc_id, payload)
                    rid += 1

        def merge(state, record):
            if state is None:
                return [record[0], 1, record], ()
            state[1] += 1
            lost = record
            if _key(record[1]) > _key(state[2][1]):
                lost, state[2] = state[2], record
            return state, ((lost[0], lost[1], state[0], None, None, None, None, None),)

        def finish(content, state):
            gid, copies, (rid, doc_id, payload) = state
            h = xxhash.xxh3_64_intdigest(content, seed=99) - (1 << 63)
            yield rid, doc_id, gid, copies, h, hashlib.sha256(content).hexdigest(), payload, content.decode()

        yield from _batches(grace(records(), merge, finish, limit), schema)

    return docs.select("doc_id", "payload", "text").mapInArrow(run, fields)


def merged_groups(local: DataFrame, limit: int = TABLE_BYTES) -> DataFrame:
    """Joins the partitions' groups of equal text: for each ``gid`` the row that stays, its payload and the group's size;
    ``text`` is there once for each whole group."""
    out = _schema(local, "gid long, keep_rid long, keep_id {id}, group_size long, text_sha256 string, payload {payload}, text string")
    schema = _arrow(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for batch in batches:
                b = batch.to_pydict()
                for row in zip(b["text"], b["gid"], b["copies"], b["rid"], b["doc_id"], b["text_sha256"], b["payload"]):
                    yield row[0].encode(), row[1:]

        def merge(state, r):
            gid, copies, rid, doc_id, sha, payload = r
            if state is None:
                return [[gid], copies, rid, doc_id, sha, payload], ()
            state[0].append(gid)
            state[1] += copies
            if (_key(doc_id), rid) > (_key(state[3]), state[2]):
                state[2], state[3], state[5] = rid, doc_id, payload
            return state, ()

        def finish(content, state):
            gids, size, rid, doc_id, sha, payload = state
            for n, gid in enumerate(gids):
                yield gid, rid, doc_id, size, sha, payload if n == 0 else None, content.decode() if n == 0 else None

        yield from _batches(grace(records(), merge, finish, limit), schema)

    reps = local.where("text IS NOT NULL").select("h", "gid", "copies", "rid", "doc_id", "text_sha256", "payload", "text")
    return reps.repartition("h").mapInArrow(run, out)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = TABLE_BYTES) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    tune(docs.sparkSession)
    local = written(local_groups(texts(docs, id_col, text_col).withColumn("payload", F.lit(True)), limit), "exact-groups")
    whole = merged_groups(local, limit).drop("text", "payload")
    rows = local.select("rid", "doc_id", "gid")
    return rows.join(whole, "gid").select("doc_id", "keep_id", F.col("group_size"), (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256")


def exact_deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = TABLE_BYTES) -> DataFrame:
    """The rows that stay, with all their columns; a null text comes back as empty."""
    tune(docs.sparkSession)
    kept = merged_groups(local_groups(_named(docs, id_col, text_col), limit), limit).where("text IS NOT NULL")
    rest = iter(range(len(docs.columns)))
    return kept.select(*[F.col("keep_id").alias(c) if c == id_col else F.col("text").alias(c) if c == text_col else F.col(f"payload.c{next(rest)}").alias(c) for c in docs.columns])
