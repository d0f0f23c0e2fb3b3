"""Ranked lexical search by WAND over shards of documents.

The terms of a block of queries make a vocabulary of bounded size, which goes to every task. One pass over the texts
counts each document's terms and its occurrences of that vocabulary; only these counts are written, and all statistics
(documents, length, document frequencies) come from them, over all documents. A second pass cuts the counts into shards,
each an inverted index in memory with a largest impact for every term.

A shard answers a query in document order, a block of documents at a time, with a heap of the best so far. Terms whose
largest impacts add up to no more than the heap's threshold can't bring a document in by themselves, so their postings
aren't read to find candidates. The pivots of a block are the documents whose present terms' largest impacts, with all of
those set aside, exceed the threshold; all others are skipped, and only pivots are scored. The shards' heaps are merged
by Spark, whose window keeps the best of each task before it shuffles.

Queries come in blocks of about ``QUERY_BYTES`` of text, one after another, each against all documents: their terms are what
a task must hold. Nothing else is bounded.

Defined results: null texts have no terms, neither in documents nor in queries; a query without terms, or whose terms
no document holds, has no rows; a document is a row: repeated rows are ranked each, rows of equal score by ascending
doc_id, null ids last, and rows equal in both in any order; a query is a row too: repeated ones are answered each; texts
of any length are read whole; empty tables give no rows; other columns, of whatever name, aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import texts, trim, tune, written

#: Bytes of query text whose terms a task holds at once.
QUERY_BYTES = 4 << 20
#: Postings of a shard, and documents looked at together.
SHARD_POSTINGS, BLOCK = 4_000_000, 2048
#: Bytes of text that are taken apart at once.
CHUNK = 1 << 20

_IS_TERM = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def split_terms(data: np.ndarray, starts: np.ndarray, end: int) -> tuple[pa.Array, np.ndarray]:
    """The terms of texts that lie one after another, and the number of the text that each is in.

    Letters, digits and all bytes beyond ASCII are parts of terms; of letters only A to Z are lower-cased."""
    inside = _IS_TERM[data[: end]]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    cuts = np.unique(np.concatenate([edge, starts[starts < end]]))
    if not len(cuts) or cuts[0] != 0:
        cuts = np.concatenate([[0], cuts])
    begins = cuts[inside[cuts]] if end else cuts[:0]
    ends = np.append(cuts[1:], end)[inside[cuts]] if end else cuts[:0]
    offsets = np.concatenate([[0], np.cumsum(ends - begins)]).astype(np.int64)
    kept = np.ascontiguousarray(_LOWER[data[:end][inside]])
    terms = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    return terms, np.searchsorted(starts, begins, "right") - 1


def term_list(text: str | None) -> list[bytes]:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return split_terms(data, np.zeros(1, np.int64), len(data))[0].to_pylist()


def _count_terms(column: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Of each text: how many terms it has, and which of the vocabulary how often."""
    column = column.cast("large_string")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    everything = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    n, found = np.zeros(len(column), np.int64), [np.zeros(0, np.int64)]
    v = max(len(vocabulary), 1)
    i = 0
    while i < len(column):  # whole texts, about CHUNK bytes together
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        data, starts = everything[offsets[i] : offsets[j]], offsets[i:j] - offsets[i]
        terms, text = split_terms(data, starts, len(data))
        n[i:j] = np.bincount(text, minlength=j - i)
        at = pc.index_in(terms, vocabulary)
        hit = np.flatnonzero(np.asarray(at.is_valid()))
        found.append((text[hit] + i) * v + np.asarray(at.take(pa.array(hit))).astype(np.int64))
        i = j
    keys, tf = np.unique(np.concatenate(found), return_counts=True)
    cuts = np.searchsorted(keys, np.arange(1, len(column)) * v)
    return n, list(zip(np.split((keys % v).astype("<i4"), cuts), np.split(tf.astype("<i8"), cuts)))


class Shard:
    """An inverted index of some documents, in the order of their ids."""

    def __init__(self, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, count: int, length: int) -> None:
        order = np.lexsort((doc, term))
        doc, term, tf = doc[order], term[order], tf[order]
        if 75 * int(n.max(initial=0)) * count < 1 << 62:
            m = 25 + 75 * n * count // max(length, 1)
        else:
            m = np.array([25 + 75 * int(x) * count // length for x in n], np.int64)
        self.size, self.doc = len(n), doc
        self.impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        self.first = np.searchsorted(term, np.arange(len(weight) + 1))
        self.most = np.zeros(len(weight), np.int64)
        present = np.flatnonzero(np.diff(self.first))
        if len(present):
            self.most[present] = np.maximum.reduceat(self.impact, self.first[present])

    def best(self, terms: np.ndarray, repeats: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best documents, best first."""
        bound = self.most[terms] * repeats
        order = np.argsort(bound, kind="stable")
        order = order[bound[order] > 0]
        terms, repeats, bound = terms[order], repeats[order], bound[order]
        upto = np.cumsum(bound)
        spans = [(self.doc[a:b], self.impact[a:b]) for a, b in zip(self.first[terms], self.first[terms + 1])]
        docs, scores, threshold = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for low in range(0, self.size if len(terms) else 0, BLOCK):
            high = min(low + BLOCK, self.size)
            aside = int(np.searchsorted(upto, threshold, "right"))  # alone they can't pass the threshold
            if aside == len(terms):
                break
            most = np.zeros(high - low, np.int64)
            for (own, _), b in zip(spans[aside:], bound[aside:]):
                most[own[slice(*np.searchsorted(own, (low, high)))] - low] += b
            pivots = np.flatnonzero((most > 0) & (most + (upto[aside - 1] if aside else 0) > threshold)) + low
            if not len(pivots):
                continue
            score = np.zeros(len(pivots), np.int64)
            for (own, impact), r in zip(spans, repeats):
                at = np.searchsorted(own, pivots)
                at[at == len(own)] = 0
                score += np.where(own[at] == pivots, impact[at] * r, 0)
            ok = score > threshold
            docs, scores = np.concatenate([docs, pivots[ok]]), np.concatenate([scores, score[ok]])
            top = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[top], scores[top]
            if len(docs) == k:
                threshold = int(scores[-1])
        return docs, scores


def _index(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    words = pa.array(vocabulary, pa.large_binary())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found = _count_terms(batch["text"], words)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(some)), pa.array(n[some]), pa.array([found[i][0].tobytes() for i in some], pa.binary()), pa.array([found[i][1].tobytes() for i in some], pa.binary())], names=["doc_id", "n", "terms", "counts"])
        trim()

    return written(docs.mapInArrow(count, "doc_id long, n long, terms binary, counts binary"), "lexical")


def _frequencies(index: DataFrame, size: int) -> np.ndarray:
    """The documents that hold each term of the vocabulary: a partial sum of each task, summed by Spark."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch["terms"].to_pylist():
                total[np.frombuffer(x, "<i4")] += 1  # a document's terms are distinct
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    out = np.zeros(size, np.int64)
    for r in index.select("terms").mapInArrow(partial, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r.term] = r.df
    return out


def _answers(docs: DataFrame, queries: list, k: int) -> DataFrame:
    """Query number, item_id, doc_id and score of the best documents of each shard."""
    parsed = [term_list(text) for _, text in queries]
    vocabulary = sorted({t for own in parsed for t in own})
    place = {t: i for i, t in enumerate(vocabulary)}
    asked = [np.unique([place[t] for t in own], return_counts=True) if own else (np.zeros(0, np.int64), np.zeros(0, np.int64)) for own in parsed]
    names = [q[0] for q in queries]
    index = _index(docs, vocabulary)
    total = index.agg(F.count("*"), F.sum("n")).first()
    count, length = int(total[0]), int(total[1] or 0)
    df = _frequencies(index, len(vocabulary))
    weight = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * int(x) + 1))) for x in df], np.int64)

    def answer(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        order = pc.sort_indices(table["doc_id"], null_placement="at_end")
        table = table.take(order).combine_chunks()
        terms, counts = table["terms"].to_pylist(), table["counts"].to_pylist()
        sizes = np.array([len(x) // 4 for x in terms], np.int64)
        shard = Shard(table["n"].to_numpy(), np.repeat(np.arange(len(sizes)), sizes), np.frombuffer(b"".join(terms), "<i4").astype(np.int64), np.frombuffer(b"".join(counts), "<i8"), weight, count, length)
        number, docs, scores = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for q, (own, repeats) in enumerate(asked):
            d, s = shard.best(own, repeats, k)
            number += [q] * len(d)
            docs.append(d)
            scores.append(s)
        ids = table["doc_id"].combine_chunks().take(pa.array(np.concatenate(docs)))
        return pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array([names[q] for q in number], pa.int64()), ids, pa.array(np.concatenate(scores))], names=["q", "item_id", "doc_id", "score"])

    def wand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, postings = [], 0
        for batch in batches:
            held.append(batch)
            postings += batch["terms"].nbytes // 4
            if postings >= SHARD_POSTINGS:
                yield answer(held)
                held, postings = [], 0
        if held:
            yield answer(held)
        trim()

    return index.mapInArrow(wand, "q int, item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item whose score is above 0."""
    spark = docs.sparkSession
    tune(spark)
    docs = texts(docs, f"`{id_col}`", f"`{text_col}`").withColumn("doc_id", F.col("doc_id").cast("long"))
    items = texts(items, f"`{item_id_col}`", f"`{item_text_col}`").select(F.col("doc_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / query_bytes))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(blocks):
        own = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]
        if own:
            order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            best = _answers(docs, own, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            best = best.select("item_id", "rank", "doc_id", "score")
            out = best if b == 0 or blocks == 1 else out.unionByName(best)
    return out


def oracle_sql(k: int = 10) -> str:
    """The same ranking for DuckDB: every document is scored."""
    terms = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS ts FROM documents),
sizes AS (SELECT r, doc_id, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0),
totals AS (SELECT count(*)::BIGINT AS c, sum(n)::BIGINT AS l FROM sizes),
asked AS (SELECT i, item_id, t, count(*)::BIGINT AS reps FROM (SELECT row_number() OVER () AS i, item_id, unnest({terms}) AS t FROM benchmark) GROUP BY ALL),
tfs AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
weights AS (SELECT t, floor(1000 * ln((2 * c + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT t, count(*)::BIGINT AS df FROM tfs GROUP BY t), totals),
hits AS (SELECT tfs.r, tfs.t, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * c) // l))) AS impact FROM tfs JOIN sizes USING (r) JOIN weights USING (t), totals),
scored AS (SELECT i, item_id, r, sum(reps * impact)::BIGINT AS score FROM asked JOIN hits USING (t) GROUP BY ALL HAVING sum(reps * impact) > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM
(SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored JOIN sizes USING (r)) WHERE rank <= {k}
"""
