"""Alignment of two tokenizers over the bytes of texts, by DuckDB queries in each Arrow partition.

A text with a space before it is tokenised by a byte-level BPE vocabulary (A) and by a sentencepiece model (B). Both are
intervals over the same bytes. Offsets at which tokens of both end cut the intervals into groups, and all tokens of A and B in a
group are linked. DuckDB holds the token intervals of a block in two tables: a window sum over the tokens of A that start
where one of B starts numbers the groups, an ASOF join gives each token of B the group of the token of A that covers its
start, and a join on the groups links all tokens that lie in one group's range. Documents are made of chunks that repeat, cut before spaces that follow
no white space, where neither tokenizer joins anything; each distinct chunk of a worker is aligned once.

How many documents hold a pair of ids linked is a figure of the whole corpus. Tasks write blocks of documents with their
distinct pairs; the blocks' partial counts meet in Spark, which sums them, finds each A id's highest and joins the counts
back to the blocks, whose documents take them from there. Nothing is broadcast, and a hot pair has a row for each block at most.

Defined results: null and empty texts have no tokens; nor have texts that the model doesn't give back byte for byte, such as
those with U+2581; strings of special tokens are plain text; texts and words of any length are read whole; each row is a
document, so repeated rows count each, and get the same figures; no rows give no rows; ids are passed through, null ones
too; other columns, of whatever name, aren't read.
"""

from __future__ import annotations

import functools
import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, trim, tune, written
from .tokens import ChunkTable, _chunk_starts, id_table, read_ranks

#: Bytes of text in a block of documents, whose pairs are counted together; links of a block.
BLOCK_BYTES, BLOCK_LINKS = 16 << 20, 8_000_000
#: A pair of ids is one number: the A id in front of so many bits of the B id.
BITS = 20
#: Numbers that stand before a chunk's pairs: tokens of A and B, groups, whether it is given back, the place of its text.
HEAD = 5

_GROUPS = """
CREATE OR REPLACE TEMP TABLE ga AS
    SELECT a.i, a.id, a.c, a.s, sum((b.s IS NOT NULL)::INT) OVER (ORDER BY a.i)::INT AS g FROM a_in a LEFT JOIN b_in b ON b.s = a.s;
CREATE OR REPLACE TEMP TABLE gb AS
    SELECT b.i, b.id, b.s, b.e, a.g FROM b_in b ASOF JOIN ga a ON b.s >= a.s;
"""
#: Ranges of groups don't overlap, so that a token lies in the range of a group if it starts there: an equality on its number.
_LINKS = "SELECT ga.c, ga.id::BIGINT << 20 | gb.id AS pair FROM ga JOIN gb ON gb.g = ga.g"


class Aligner:
    """Both tokenizers and one DuckDB connection, with one thread and bounded memory, of a worker."""

    def __init__(self, a_path: str, b_path: str, memory: str = "300MB") -> None:
        import duckdb
        import sentencepiece

        self.encode_a = id_table(a_path).make
        ranks = read_ranks(a_path)
        self.a_size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.a_size[list(ranks.values())] = list(map(len, ranks))
        self.model = sentencepiece.SentencePieceProcessor(model_file=b_path)
        names = [self.model.id_to_piece(i) for i in range(len(self.model))]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        if any(" " in p.lstrip(" ") for p in (x.replace("▁", " ") for x in names)):
            raise ValueError("pieces of the model reach over the start of a word: its texts can't be taken apart")
        if max(len(self.a_size), len(names)) > 1 << BITS:
            raise ValueError("the vocabularies are too large for a pair to be one number")
        self.b_size = np.array(list(map(len, self.b_bytes)), np.int64)
        self.space = [self.model.piece_to_id("▁")]
        self.folder = tempfile.TemporaryDirectory(prefix="align-")  # of this worker, empty unless a query spills
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": self.folder.name})
        self.digits = pa.array([str(i).encode() for i in range(max(len(self.a_size), len(names)))], pa.binary())

    def tokens(self, chunks: list[bytes], joined: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and B, how many each chunk has of them, and whether B gives the chunk back."""
        a, n_a = self.encode_a(chunks, joined)
        own = [self.space if c == b" " else x for c, x in zip(chunks, self.model.encode([c[1:].decode() for c in chunks], num_threads=1))]
        n_b = np.array(list(map(len, own)), np.int64)
        b = np.array([i for x in own for i in x], np.int64)
        good = np.ones(len(chunks), bool)
        again = list(map(self.b_bytes.__getitem__, b.tolist()))
        sizes = np.array(list(map(len, chunks)), np.int64)
        ends = np.concatenate([[0], np.cumsum(self.b_size[b])])[np.concatenate([[0], np.cumsum(n_b)])]
        if not (np.diff(ends) == sizes).all() or b"".join(again) != b"".join(chunks):
            at = np.concatenate([[0], np.cumsum(n_b)]).tolist()
            good = np.array([b"".join(again[at[i] : at[i + 1]]) == c for i, c in enumerate(chunks)])
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
        return a.astype(np.int64), n_a, b, n_b, good

    def groups(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The group of each token of A and of B, and the links: the chunk and the pair of ids of each."""
        if not len(a):
            none = np.zeros(0, np.int64)
            return none, none, none, none
        tables = {}
        for name, ids, n, size in (("a_in", a, n_a, self.a_size), ("b_in", b, n_b, self.b_size)):
            ends = np.cumsum(size[ids])
            tables[name] = pa.table({"i": np.arange(len(ids), dtype=np.int32), "id": ids.astype(np.int32), "c": np.repeat(np.arange(len(n), dtype=np.int32), n), "s": ends - size[ids], "e": ends})
            self.db.register(name, tables[name])
        self.db.execute(_GROUPS)
        g_a = self.db.execute("SELECT g FROM ga ORDER BY i").fetchnumpy()["g"]
        g_b = self.db.execute("SELECT g FROM gb ORDER BY i").fetchnumpy()["g"]
        links = self.db.execute(_LINKS).fetchnumpy()
        order = np.argsort(links["c"], kind="stable")
        return np.asarray(g_a, np.int64), np.asarray(g_b, np.int64), np.asarray(links["c"], np.int64)[order], np.asarray(links["pair"], np.int64)[order]

    def spelled(self, a: np.ndarray, c_a: np.ndarray, g_a: np.ndarray, b: np.ndarray, g_b: np.ndarray, chunks: int) -> list[bytes]:
        """The groups of each chunk: ``a1,a2|b1;a3|b2,b3``."""
        if not len(a):
            return [b""] * chunks
        order = np.argsort(np.concatenate([2 * g_a, 2 * g_b + 1]), kind="stable")
        ids, key = np.concatenate([a, b])[order], np.concatenate([2 * g_a, 2 * g_b + 1])[order]
        chunk_of = np.zeros(int(g_a[-1]) + 1, np.int64)
        chunk_of[g_a] = c_a
        c = chunk_of[key >> 1]
        same = key[1:] == key[:-1]
        mark = np.where(same, 0, np.where(key[1:] >> 1 == key[:-1] >> 1, 1, np.where(c[1:] == c[:-1], 2, 3)))
        marks = pa.array([b",", b"|", b";", b""], pa.binary()).take(pa.array(np.append(mark, 3)))
        parts = pc.binary_join_element_wise(self.digits.take(pa.array(ids)), marks, pa.scalar(b"", pa.binary()))
        offsets = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + len(parts) + 1]
        data = parts.buffers()[2].to_pybytes()
        cut = offsets[np.searchsorted(c, np.arange(chunks + 1))].tolist()
        return [data[x:y] for x, y in zip(cut, cut[1:])]


class PairTable(ChunkTable):
    """For each distinct chunk its figures, the pairs of its links, and its groups spelled out."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.aligner = Aligner(a_path, b_path)
        super().__init__(self.align, "<i8", 2 << 20)

    def clear(self) -> None:
        super().clear()
        self.strings: list[bytes] = []

    def align(self, chunks: list[bytes], joined: bool) -> tuple[np.ndarray, np.ndarray]:
        a, n_a, b, n_b, good = self.aligner.tokens(chunks, joined)
        g_a, g_b, c, pairs = self.aligner.groups(a, n_a, b, n_b)
        c_a = np.repeat(np.arange(len(chunks)), n_a)
        head = np.zeros((len(chunks), HEAD), np.int64)
        head[:, 0], head[:, 1], head[:, 3] = n_a, n_b, good
        new = np.flatnonzero(np.diff(g_a, prepend=-1)) if len(g_a) else g_a
        head[:, 2] = np.bincount(c_a[new], minlength=len(chunks))
        head[:, 4] = len(self.strings) + np.arange(len(chunks))
        self.strings += self.aligner.spelled(a, c_a, g_a, b, g_b, len(chunks))
        sizes = np.bincount(c, minlength=len(chunks)) + HEAD
        flat = np.zeros(int(sizes.sum()), np.int64)
        first = np.cumsum(sizes) - sizes
        is_head = np.zeros(len(flat), bool)
        is_head[(first[:, None] + np.arange(HEAD)).ravel()] = True
        flat[is_head], flat[~is_head] = head.ravel(), pairs
        return flat, sizes


@functools.cache
def pair_table(a_path: str, b_path: str) -> PairTable:
    return PairTable(a_path, b_path)


def _pack(values: np.ndarray) -> bytes:
    """Numbers below 2**32, byte by byte, as small ones compress best."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(np.frombuffer(data, np.uint8).reshape(4, -1).T.tobytes(), "<u4").astype(np.int64)


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values up to each end, from the end before."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], ends])])


def _digest(strings: list[bytes], places: list[int]) -> str:
    out = hashlib.sha256()
    for k in range(0, len(places), 4096):
        out.update((b";" if k else b"") + b";".join(map(strings.__getitem__, places[k : k + 4096])))
    return out.hexdigest()


def _spaced(column: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column.cast("large_string"), pa.scalar("", pa.large_string()))


class _Block:
    """Documents whose pairs are counted together."""

    def __init__(self) -> None:
        self.docs: list[tuple] = []
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.bytes = self.links = 0

    def add(self, table: PairTable, ids: list, empty: np.ndarray, rows: np.ndarray, last: np.ndarray, size: int) -> None:
        start = table.starts[rows]
        n_a, n_b, n_groups, good, place = (table.flat[start + k] for k in range(HEAD))
        ok = (_sums(1 - good, last) == 0) & ~empty
        n_links = table.sizes[rows] - HEAD
        figures = [np.where(ok, _sums(v, last), 0) for v in (n_a, n_b, n_groups, n_links)]
        doc = np.repeat(np.arange(len(last)), np.diff(last, prepend=0))
        links = np.where(ok[doc], n_links, 0)
        ends = np.cumsum(links)
        flat = table.flat[np.repeat(start + HEAD - ends + links, links) + np.arange(int(links.sum()))]
        keys, times = np.unique(np.repeat(doc, links) << 2 * BITS | flat, return_counts=True)
        self.pairs.append(keys & (1 << 2 * BITS) - 1)
        self.times.append(times)
        self.sizes.append(np.bincount(keys >> 2 * BITS, minlength=len(last)))
        begin = np.concatenate([[0], last]).tolist()
        place = place.tolist()
        digests = [_digest(table.strings, place[begin[i] : begin[i + 1]]) if ok[i] else "" for i in range(len(last))]
        self.docs += list(zip(ids, *(v.tolist() for v in figures), digests))
        self.bytes += size
        self.links += len(keys)

    def rows(self) -> pa.RecordBatch:
        """A row for each document, with places in the block's list of pairs, and one row for that list."""
        pairs, sizes = np.concatenate(self.pairs), np.concatenate(self.sizes)
        own = np.unique(pairs)
        place = np.searchsorted(own, pairs)
        held = np.bincount(place, minlength=len(own))
        cut = np.cumsum(sizes)[:-1]
        steps = [_pack(np.diff(x, prepend=0)) for x in np.split(place, cut)]
        times = [_pack(x) for x in np.split(np.concatenate(self.times), cut)]
        columns = [list(x) for x in zip(*self.docs)]
        number = int.from_bytes(os.urandom(8), "little") >> 1
        arrays = [pa.array([number] * (len(self.docs) + 1), pa.int64()), pa.array([False] * len(self.docs) + [True])]
        arrays += [pa.array([*c, None], pa.int64() if k < 5 else pa.string()) for k, c in enumerate(columns)]
        arrays += [pa.array(steps + [own.astype("<i8").tobytes()], pa.binary()), pa.array(times + [_pack(held)], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=_NAMES)


_NAMES = ["block", "is_list", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
_BLOCK_TYPE = "block long, is_list boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of aligned documents, written: a row for each document and one for each block's list of pairs."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, block = pair_table(a_path, b_path), _Block()
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            empty = np.asarray(pc.equal(pc.binary_length(batch["text"]), 0))
            for i, rows, last, data in table.blocks(_spaced(batch["text"])):
                block.add(table, ids[i : i + len(last)], empty[i : i + len(last)], rows, last, len(data))
                if block.bytes >= BLOCK_BYTES or block.links >= BLOCK_LINKS:
                    yield block.rows()
                    block = _Block()
        if block.docs:
            yield block.rows()
        trim()

    own = texts(docs, f"`{id_col}`", f"`{text_col}`").withColumn("doc_id", F.col("doc_id").cast("long"))
    return written(own.mapInArrow(run, _BLOCK_TYPE), "alignment")


def _listed(made: DataFrame) -> DataFrame:
    """block, place, pair, n: the distinct pairs of each block and the documents of the block that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pairs, held in zip(*(batch[c].to_pylist() for c in ("block", "pairs", "times"))):
                own = np.frombuffer(pairs, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block)), pa.array(np.arange(len(own), dtype=np.int32)), pa.array(own), pa.array(_unpack(held))], names=["block", "place", "pair", "n"])

    return made.where("is_list").select("block", "pairs", "times").mapInArrow(run, "block long, place int, pair long, n long")


def _totals(listed: DataFrame) -> DataFrame:
    """pair, count, top: how many documents hold each pair linked, and whether no pair of its A id is held by more."""
    counts = listed.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("a", F.shiftright("pair", BITS))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("top"))


def pair_counts(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a_id, b_id, documents: how many documents hold the pair of ids linked."""
    counts = _totals(_listed(blocks(docs, a_path, b_path, id_col, text_col)))
    return counts.select(F.shiftright("pair", BITS).cast("int").alias("a_id"), F.col("pair").bitwiseAND((1 << BITS) - 1).cast("int").alias("b_id"), F.col("count").alias("documents"))


def token_groups(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, group (from 0), start, end (bytes of the text with a space before it), a_ids, b_ids: the aligned groups."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = pair_table(a_path, b_path).aligner
        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                data = np.frombuffer(b" " + text.encode() if text else b"", np.uint8)
                chunks = [x.tobytes() for x in np.split(data, _chunk_starts(data, np.array([0, len(data)]))[1:])] if text else []
                parts = [aligner.tokens([c], False) for c in chunks]
                if not chunks or not all(p[4].all() for p in parts):
                    continue
                a, b = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts])
                g_a, g_b, _, _ = aligner.groups(a, np.array([len(a)]), b, np.array([len(b)]))
                n = int(g_a[-1])
                ends = np.cumsum(aligner.a_size[a])[np.searchsorted(g_a, np.arange(1, n + 1), "right") - 1]
                own_a, own_b = (np.split(x, np.searchsorted(g, np.arange(2, n + 1))) for x, g in ((a, g_a), (b, g_b)))
                yield pa.RecordBatch.from_arrays([pa.array([doc] * n, pa.int64()), pa.array(np.arange(n)), pa.array(np.concatenate([[0], ends[:-1]])), pa.array(ends), pa.array([x.tolist() for x in own_a], pa.list_(pa.int32())), pa.array([x.tolist() for x in own_b], pa.list_(pa.int32()))], names=["doc_id", "group", "start", "end", "a_ids", "b_ids"])

    own = texts(docs, f"`{id_col}`", f"`{text_col}`").withColumn("doc_id", F.col("doc_id").cast("long"))
    return own.mapInArrow(run, "doc_id long, group long, start long, end long, a_ids array<int>, b_ids array<int>")


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document: its tokens, groups and links,
    the links whose pair is the one that most documents hold for its A id, and the sum of all links' document counts."""
    made = blocks(docs, a_path, b_path, id_col, text_col)
    listed = _listed(made)
    counted = listed.select("block", "place", "pair").join(_totals(listed), "pair").select("block", "place", "count", "top")

    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        place = counts["place"].to_numpy()
        count, top = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], top[place] = counts["count"].to_numpy(), counts["top"].to_numpy().astype(np.int64)
        sums, best = [], []
        for steps, times in zip(docs["pairs"].to_pylist(), docs["times"].to_pylist()):
            own, n = np.cumsum(_unpack(steps)), _unpack(times)
            sums.append(int(count[own] @ n))
            best.append(int(top[own] @ n))
        return pa.table([*(docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), pa.array(best, pa.int64()), pa.array(sums, pa.int64()), docs["groups_sha256"]], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    own = made.where("NOT is_list").drop("is_list")
    return own.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
