"""Token counts from an exact length histogram.

Documents are aggregated by their encoded length; suffix sums over the histogram then answer, for every context limit
that is a document's length, how many documents and tokens lie at or beyond it, the total of all lengths cut at the
limit, and the limit's quantile. Limits between two lengths follow from the next one above. The histogram has a row for
each distinct length. Its suffix sums are taken in two steps, within ranges of lengths and over the ranges, so that no
task holds all of it.

Defined results: null and empty texts have length 0; texts of any length are encoded whole; equal lengths share a row;
repeated rows count each; no rows give no rows; other columns, of whatever name, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import texts, trim, tune, written

#: Lengths of one range of the histogram.
RANGE = 4096


def lengths(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens of each whole text."""
    tune(docs.sparkSession)
    rows = texts(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import id_table

        table = id_table(vocabulary)
        for batch in batches:
            n = []
            for _, chunks, last, _ in table.blocks(batch.column(1)):
                ends = np.concatenate([[0], np.cumsum(table.sizes[chunks])])[np.concatenate([[0], last])]
                n.append(np.diff(ends))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0, np.int64), *n]))], names=["doc_id", "n_tokens"])
            trim()

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long")


def histogram(counted: DataFrame) -> DataFrame:
    """n_tokens, documents."""
    return counted.groupBy("n_tokens").agg(F.count("*").alias("documents"))


def limit_totals(hist: DataFrame, width: int = RANGE) -> DataFrame:
    """For each length: documents of it; documents and tokens of it or more; the quantile that it reaches; and as a context
    limit, the total of all lengths cut there and the tokens cut off."""
    own = hist.withColumn("_range", F.floor(F.col("n_tokens") / width)).withColumn("_tokens", F.col("documents") * F.col("n_tokens"))
    ranges = own.groupBy("_range").agg(F.sum("documents").alias("d"), F.sum("_tokens").alias("t"))
    over = Window.orderBy(F.desc("_range"))  # one row for every ``width`` lengths
    above = ranges.select("_range", (F.sum("d").over(over) - F.col("d")).alias("_d"), (F.sum("t").over(over) - F.col("t")).alias("_t"))
    total = ranges.agg(F.sum("d").alias("_all_d"), F.sum("t").alias("_all_t"))
    within = Window.partitionBy("_range").orderBy(F.desc("n_tokens"))
    sums = own.join(above, "_range").crossJoin(F.broadcast(total))  # one row
    sums = sums.select(
        "n_tokens", "documents", "_all_d", "_all_t",
        (F.sum("documents").over(within) + F.col("_d")).alias("documents_from"),
        (F.sum("_tokens").over(within) + F.col("_t")).alias("tokens_from"),
    )
    kept = F.col("_all_t") - F.col("tokens_from") + F.col("n_tokens") * F.col("documents_from")
    return sums.select(
        "n_tokens", "documents", "documents_from", "tokens_from",
        F.round((F.col("_all_d") - F.col("documents_from") + F.col("documents")) / F.col("_all_d"), 9).alias("quantile"),
        kept.alias("tokens_cut_at"), (F.col("_all_t") - kept).alias("tokens_lost_at"),
    )


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``limit_totals`` of all documents. The histogram, a row for each distinct length, is written, so that texts are encoded once."""
    return limit_totals(written(histogram(lengths(docs, vocabulary, id_col, text_col)), "length-histogram"))
