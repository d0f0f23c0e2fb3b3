"""Byte-level BPE encoding and decoding by recursive DuckDB queries in each partition.

A text is cut by the vocabulary's pattern into words; a worker merges each distinct word once, as long as it remembers it. A
word is a run of token-position rows. Every step of the recursive query joins neighbouring rows with the merge table, contracts each
word's leftmost pair of least rank, and hands unfinished words on until no pair is left. Decoding joins ids with the
vocabulary and puts their bytes in order.

A word may be as long as a text. Words of more than ``LONG`` bytes are cut into overlapping windows, which are merged like
words and joined where two neighbours have the same token at the same place. That is exact: a sequence of tokens is what a
word merges to if, and only if, each two neighbours are what their own bytes merge to, and the joined sequence has only
pairs that stand side by side in some window. Neighbours without a common token are merged again as one window, so the
work grows with the length of a word and not with its square. In such wider windows a step contracts all places of the pair
that don't overlap: they would be the next steps. Both need that merges only lead to pairs of higher rank; a vocabulary is
checked for that when the first long word comes, and its long words are merged whole, pair by pair, if it fails.

Each worker has one DuckDB connection with one thread and bounded memory, which spills to the task's own temporary
folder. Nothing is shuffled and a lost task starts again from its input.

Defined results: null and empty texts have no ids and decode to nothing; texts and words of any length are read whole; of
equal ranks the leftmost pair goes first; strings of special tokens are plain text; an id that isn't in the vocabulary fails
the decoding; repeated rows give equal rows; no rows give no rows; other columns, of whatever name, aren't read.
"""

from __future__ import annotations

import functools
import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import texts, tune
from .tokens import ChunkTable, read_ranks

#: Words merged by one query.
WORDS = 60_000

#: Words, and bytes of words, that a worker remembers; then it starts anew.
WORDS_REMEMBERED, WORDS_REMEMBERED_BYTES = 1_000_000, 24 << 20

#: Words of more bytes are merged in windows of ``WINDOW`` bytes, each half over the next. Where windows don't fit together,
#: larger ones follow; half of each is a multiple of small numbers, as in a run of one symbol tokens stand at multiples of
#: their length.
LONG, WINDOW, WIDER = 96, 48, (3360, 40320)

_MERGE = """
WITH RECURSIVE t(k, id, live) AS (
    SELECT k, id, true FROM start_rows
  UNION ALL (
    WITH pairs AS (
        SELECT k, id, lead(k) OVER o AS gone, lead(id) OVER o AS next FROM t WHERE live WINDOW o AS (ORDER BY k)),
    best AS MATERIALIZED (
        SELECT p.k >> 32 AS word, min(m.rank::BIGINT << 32 | (p.k & 4294967295)) AS head,
               arg_min(p.gone, m.rank::BIGINT << 32 | (p.k & 4294967295)) AS gone
        FROM pairs p JOIN merges m ON m.pair = (p.id::BIGINT << 17) | p.next
        WHERE p.gone >> 32 = p.k >> 32 GROUP BY ALL)
    SELECT t.k, CASE WHEN t.k & 4294967295 = b.head & 4294967295 THEN b.head >> 32 ELSE t.id END::INTEGER, b.word IS NOT NULL
    FROM t LEFT JOIN best b ON b.word = t.k >> 32
    WHERE t.live AND t.k IS DISTINCT FROM b.gone
  )
)
SELECT k >> 32 AS word, id FROM t WHERE NOT live ORDER BY k
"""

_MERGE_LONG = """
WITH RECURSIVE t(k, id, nk, live) AS (
    SELECT k, id, nk, true FROM start_rows
  UNION ALL (
    WITH pairs AS MATERIALIZED (
        SELECT a.k, a.nk AS gone, b.nk AS after, m.rank, a.id AS l, b.id AS r
        FROM t a JOIN t b ON b.k = a.nk JOIN merges m ON m.pair = (a.id::BIGINT << 17) | b.id
        WHERE a.live),
    best AS (SELECT k >> 32 AS word, min(rank) AS rank FROM pairs GROUP BY ALL),
    hits AS MATERIALIZED (
        SELECT p.* FROM pairs p JOIN best b ON b.word = p.k >> 32 AND b.rank = p.rank),
    runs AS (
        SELECT h.*, p.k IS NOT NULL AS follows FROM hits h LEFT JOIN hits p ON p.gone = h.k),
    heads AS (
        SELECT *, sum(NOT follows::BOOL) OVER (ORDER BY k) AS run FROM runs WHERE l = r),
    chosen AS MATERIALIZED (
        SELECT k, gone, after, rank FROM hits WHERE l <> r
        UNION ALL
        SELECT k, gone, after, rank FROM heads QUALIFY row_number() OVER (PARTITION BY run ORDER BY k) % 2 = 1)
    SELECT t.k, coalesce(c.rank, t.id), CASE WHEN c.k IS NULL THEN t.nk ELSE c.after END, b.word IS NOT NULL
    FROM t LEFT JOIN chosen c ON c.k = t.k
           LEFT JOIN best b ON b.word = t.k >> 32
    WHERE t.live AND NOT EXISTS (SELECT 1 FROM chosen g WHERE g.gone = t.k)
  )
)
SELECT k >> 32 AS word, id FROM t WHERE NOT live ORDER BY k
"""

_DECODE = """
SELECT v.bytes FROM id_rows i JOIN vocabulary v ON v.id = i.id ORDER BY i.pos
"""


def _each(flat: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    return np.split(flat, np.cumsum(sizes)[:-1])


def _windows(start: int, end: int, size: int) -> list[tuple[int, int]]:
    """Windows of a size over a stretch, each half over the next."""
    return [(a, min(a + size, end)) for a in range(start, max(end - size // 2, start + 1), size // 2)]


def _common(ids: np.ndarray, begin: np.ndarray, other_ids: np.ndarray, other_begin: np.ndarray, end: int, start: int) -> np.ndarray:
    """Where two windows have the same token, between the start of the second and the end of the first."""
    low = np.searchsorted(begin, start)
    high = np.searchsorted(other_begin, end)
    places, left, right = np.intersect1d(begin[low:], other_begin[:high], assume_unique=True, return_indices=True)
    return places[ids[low:][left] == other_ids[:high][right]]


class Merger:
    """One DuckDB connection that holds a vocabulary and its merge table."""

    def __init__(self, vocabulary: str, memory: str = "400MB") -> None:
        import duckdb
        import public_tokenizers
        import regex

        ranks = read_ranks(vocabulary)
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.folder = tempfile.TemporaryDirectory(prefix="merge-")  # of this worker, empty unless a query spills
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": self.folder.name})
        pairs, merged = [], []
        for token, rank in ranks.items():  # every way to make a token of two
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append(left << 17 | right)
                    merged.append(rank)
        merges = pa.table({"pair": pa.array(pairs, pa.int64()), "rank": pa.array(merged, pa.int32())})  # noqa: F841
        names = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "bytes": pa.array(list(ranks), pa.binary())})  # noqa: F841
        self.db.register("merges_in", merges)
        self.db.register("names_in", names)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges_in; CREATE TABLE vocabulary AS SELECT * FROM names_in")
        self.whole, self._regular = ranks, None
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.lengths[list(ranks.values())] = list(map(len, ranks))
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}  # the row of each word
        self.held = 0
        self.flat = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, flat, and how many each has; long words by windows."""
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        if not long or not self.regular():
            return self.merge_whole(words)
        kinds = set(long)
        each = _each(*self.merge_whole([b"" if i in kinds else w for i, w in enumerate(words)]))
        for i in long:
            each[i] = self.merge_windows(words[i])
        return np.concatenate(each), np.array(list(map(len, each)), np.int64)

    def merge_whole(self, words: list[bytes], query: str = _MERGE) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, flat, and how many each has, by a recursive query."""
        flat, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        i = 0
        while i < len(words):
            own, size = [], 0
            while i < len(words) and len(own) < WORDS and (not own or size + len(words[i]) <= WORDS * 16):
                own.append(words[i])
                size += len(words[i])
                i += 1
            lengths = np.array(list(map(len, own)), np.int64)
            data = np.frombuffer(b"".join(own), np.uint8)
            word = np.repeat(np.arange(len(own)), lengths)
            pos = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            k = (word << 32) | pos
            rows = {"k": k, "id": self.byte_ids[data]}
            if query is not _MERGE:
                rows["nk"] = pa.array(k + 1, mask=pos == lengths[word] - 1)
            self.db.register("start_rows", pa.table(rows))
            got = self.db.execute(query).fetchnumpy()
            flat.append(np.asarray(got["id"], np.int32))
            sizes.append(np.bincount(np.asarray(got["word"], np.int64), minlength=len(own)))
        return np.concatenate(flat), np.concatenate(sizes)

    def merge_windows(self, word: bytes) -> np.ndarray:
        """The ids of a long word, by windows that are joined at common tokens."""
        spans = _windows(0, len(word), WINDOW)
        known: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}  # ids, and the places where they begin
        while True:
            fresh = [s for s in spans if s not in known]
            distinct = list(dict.fromkeys(word[a:b] for a, b in fresh))
            small = [w for w in distinct if len(w) <= WINDOW]
            ids = dict(zip(small, _each(*self.merge_whole(small))))
            wide = [w for w in distinct if len(w) > WINDOW]
            ids.update(zip(wide, _each(*self.merge_whole(wide, _MERGE_LONG))))
            for a, b in fresh:
                own = ids[word[a:b]]
                known[a, b] = own, a + np.cumsum(self.lengths[own]) - self.lengths[own]
            at, apart = [0], set()  # where each window's part begins, and windows that don't fit the next
            for i, (left, right) in enumerate(zip(spans, spans[1:])):
                both = _common(*known[left], *known[right], left[1], right[0])
                at.append(int(both[len(both) // 2]) if len(both) else -1)
                if not len(both):
                    apart.add(i)
            if not apart:
                break
            again, i = [], 0
            while i < len(spans):
                j = i
                while j in apart:
                    j += 1
                if i == j:
                    again.append(spans[i])
                else:  # a run of windows that don't fit is cut into larger ones
                    widest = max(b - a for a, b in spans[i : j + 1])
                    again += _windows(spans[i][0], spans[j][1], next((w for w in WIDER if w > widest), len(word)))
                i = j + 1
            spans = again
        parts = []
        for span, a, b in zip(spans, at, [*at[1:], len(word)]):
            own, begin = known[span]
            parts.append(own[np.searchsorted(begin, a) : np.searchsorted(begin, b)])
        return np.concatenate(parts)

    def regular(self) -> bool:
        """Whether every token with a pair of lower rank than one of its halves merges to itself without such pairs: then
        no text ever comes to them, and the ranks of a text's merges never fall."""
        if self._regular is None:
            odd = [t for t, rank in self.whole.items() for c in range(1, len(t)) if max(self.whole.get(t[:c], -1), self.whole.get(t[c:], -1)) >= rank and t[:c] in self.whole and t[c:] in self.whole]
            odd = list(dict.fromkeys(odd))
            self.db.execute("ALTER TABLE merges RENAME TO all_merges; CREATE TABLE merges AS SELECT * FROM all_merges WHERE rank > greatest(pair >> 17, pair & 131071)")
            own = _each(*self.merge_whole(odd))
            self._regular = all(len(x) == 1 and x[0] == self.whole[t] for t, x in zip(odd, own))
            self.db.execute("DROP TABLE merges; ALTER TABLE all_merges RENAME TO merges")
        return self._regular

    def words_of(self, chunks: list[bytes], joined: bool) -> tuple[list[str], np.ndarray]:
        """The words of chunks, and how many each has; a text of joined chunks has the same words."""
        if not joined:
            each = [self.find(c.decode()) for c in chunks]
            return [w for found in each for w in found], np.array(list(map(len, each)), np.int64)
        data = b"".join(chunks)
        found = self.find(data.decode())
        ends = np.cumsum(list(map(len, found)))
        begins = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80  # where characters begin
        chunk_ends = np.cumsum(begins)[np.cumsum(list(map(len, chunks))) - 1]
        at = np.searchsorted(ends, chunk_ends)
        assert (ends[at] == chunk_ends).all()
        return found, np.diff(at, prepend=-1)

    def encode_chunks(self, chunks: list[bytes], joined: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks of text, flat, and how many each has; only words that aren't remembered are merged."""
        if len(self.words) > WORDS_REMEMBERED or self.held > WORDS_REMEMBERED_BYTES:
            self.forget()
        found, counts = self.words_of(chunks, joined)
        fresh = [w for w in dict.fromkeys(found) if w not in self.words]
        if fresh:
            own = [w.encode() for w in fresh]
            flat, sizes = self.merge(own)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
            self.words.update(zip(fresh, range(len(self.words), len(self.sizes))))
            self.held += sum(map(len, own))
        rows = np.array(list(map(self.words.__getitem__, found)), np.int64)
        own_sizes = self.sizes[rows]
        ends = np.cumsum(own_sizes)
        ids = self.flat[np.repeat(self.starts[rows] - ends + own_sizes, own_sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        word_ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return ids.astype("<u4"), np.diff(word_ends)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of sequences of ids, which lie one after another, flat, and how many each sequence has."""
        if not len(ids):
            return np.zeros(0, np.uint8), np.zeros(len(sizes), np.int64)
        self.db.register("id_rows", pa.table({"pos": np.arange(len(ids)), "id": ids.astype(np.int64)}))
        got = self.db.sql(_DECODE).to_arrow_table()["bytes"].cast(pa.large_binary()).combine_chunks()
        if len(got) != len(ids):
            raise ValueError("an id isn't in the vocabulary")
        offsets = np.frombuffer(got.buffers()[1], np.int64)[got.offset : got.offset + len(got) + 1]
        flat = np.frombuffer(got.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        ends = offsets[np.concatenate([[0], np.cumsum(sizes)])]
        return flat, np.diff(ends)


@functools.cache
def _merger(vocabulary: str) -> Merger:
    return Merger(vocabulary)


@functools.cache
def _table(vocabulary: str) -> ChunkTable:
    return ChunkTable(_merger(vocabulary).encode_chunks, block_bytes=3 << 20)


def encode_column(text: Column, vocabulary: str) -> Column:
    """The ids of a text column, array of int; null gives none."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encoded(s: pa.Array) -> pa.Array:
        each = list(_table(vocabulary).texts(s.fill_null("")))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *each]).astype(np.int32)))

    return encoded(text)


def decode_column(ids: Column, vocabulary: str) -> Column:
    """The bytes that a column of id arrays stands for; null gives none."""

    @F.arrow_udf(T.BinaryType())
    def decoded(s: pa.Array) -> pa.Array:
        lists = s.to_pylist()
        sizes = np.array([len(x or ()) for x in lists], np.int64)
        flat, own = _merger(vocabulary).decode(np.array([i for x in lists for i in x or ()], np.int64), sizes)
        ends = np.cumsum(own)
        return pa.array([flat[a:b].tobytes() for a, b in zip(ends - own, ends)], pa.binary())

    return decoded(ids)


def encoded_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text.

    Ids are kept as rows of a chunk table; decoding goes from the ids of these rows."""
    tune(docs.sparkSession, 1024, 8 << 20)
    rows = texts(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, table = _merger(vocabulary), _table(vocabulary)
        names = list(map(str, range(1 << 17)))
        for batch in batches:
            n_tokens, ids_sha, decoded_sha = [], [], []
            for _, chunk_rows, last, _ in table.blocks(batch.column(1)):
                decoded = getattr(table, "side", None)
                if decoded is None or decoded[0] is not table.epoch:
                    decoded = table.side = [table.epoch, np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)]
                have = len(decoded[2])
                if have < len(table.starts):
                    fresh = np.arange(have, len(table.starts))
                    ids, ends = table.spread(fresh)
                    made, sizes = merger.decode(ids, table.sizes[fresh])
                    decoded[2] = np.concatenate([decoded[2], len(decoded[1]) + np.cumsum(sizes) - sizes])
                    decoded[3] = np.concatenate([decoded[3], sizes])
                    decoded[1] = np.concatenate([decoded[1], made])
                ids, ends = table.spread(chunk_rows)
                sizes = decoded[3][chunk_rows]
                byte_ends = np.cumsum(sizes)
                out = decoded[1][np.repeat(decoded[2][chunk_rows] - byte_ends + sizes, sizes) + np.arange(int(byte_ends[-1]) if len(byte_ends) else 0)]
                limits = np.concatenate([[0], last])
                cuts = np.concatenate([[0], ends])[limits].tolist()
                byte_cuts = np.concatenate([[0], byte_ends])[limits].tolist()
                for a, b, c, d in zip(cuts, cuts[1:], byte_cuts, byte_cuts[1:]):
                    n_tokens.append(b - a)
                    ids_sha.append(hashlib.sha256(" ".join(map(names.__getitem__, ids[a:b].tolist())).encode()).hexdigest())
                    decoded_sha.append(hashlib.sha256(out[c:d].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
