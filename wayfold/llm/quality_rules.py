"""Quality rules: gradient-boosted trees over document statistics.

``statistics`` measures whole texts; ``fit_trees`` boosts small histogram trees on labelled rows, with monotonic
constraints on the features of which more can only be worse; ``Forest`` holds all trees flattened into numpy arrays and
scores a batch of rows by stepping all of them through all trees at once. Two fixed base rules come before the trees.

Defined results: null and empty texts have no words and fail the base rules; texts of any length are measured whole; ties
and repeated rows are scored alike, row by row, and a score equal to the cut passes; with no labels, or labels of one kind,
there is nothing to fit and the base rules alone decide; labels too few for any split leave trees of one leaf, which pass all
rows; no rows give no rows; other columns of the input, of whatever name, don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import trim, tune, unused

#: At most about this many labelled rows are fitted, chosen by a hash of the identifier.
SAMPLE_ROWS = 20_000
#: The share of good labelled rows that the verdict's threshold must let pass.
KEEP_SHARE = 0.998

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_digits", "n_other_punct", "n_unique_words", "n_letters"]

#: Features of the trees, and the direction in which the score may move as they grow (0: either).
FEATURES = {
    "log_words": 0, "mean_word_chars": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_word_share": -1,
    "upper_share": -1, "digit_share": 0, "punct_per_word": 0, "unique_word_share": 0, "words_per_line": 0,
}
MONOTONE = list(FEATURES.values())

_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in SYMBOLS]] = 3
_CLASS[97:123] = 4
_CLASS[128:] = 5


def statistics(texts: list[str]) -> pd.DataFrame:
    """Counts for each text. Words are runs without ASCII white space; lines are split at newlines."""
    n = len(texts)
    out = {c: np.zeros(n, np.int64) for c in BASE + MORE}
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        out["word_chars"][i] = len(text) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
        out["n_symbols"][i] = sum(map(text.count, SYMBOLS))
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        out["n_lines"][i], out["n_dup_lines"][i] = len(lines), len(lines) - len(set(lines))
        kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=6)
        out["n_upper"][i], out["n_digits"][i], out["n_other_punct"][i] = kinds[1], kinds[2], kinds[3]
        out["n_letters"][i] = kinds[1] + kinds[4] + kinds[5]
    # words as codes, without an object for each
    lists = pc.ascii_split_whitespace(pa.array([t.encode("utf-8", "replace") for t in texts], pa.large_binary()).cast(pa.large_string()))
    words = pc.list_flatten(lists)
    solid = pc.not_equal(words, pa.scalar("", words.type))
    coded = words.filter(solid).dictionary_encode()
    codes, kinds = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
    doc = pc.list_parent_indices(lists).filter(solid).to_numpy(zero_copy_only=False).astype(np.int64)
    out["n_words"] = np.bincount(doc, minlength=n)
    if len(codes):
        out["n_unique_words"] = np.bincount(np.unique(doc * kinds + codes) // kinds, minlength=n)
        out["n_repeat_words"] = _repeated(codes, doc, n)
    return pd.DataFrame(out)


def _repeated(codes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """For each document, its words that lie in a three-word window found at least twice in it."""
    if len(codes) < 3:
        return np.zeros(n, np.int64)
    pair, _ = pd.factorize(codes[:-1] * (codes.max() + 1) + codes[1:])
    whole = doc[:-2] == doc[2:]
    triple, _ = pd.factorize(pair[:-1].astype(np.int64) * (codes.max() + 1) + codes[2:])
    window = np.where(whole, triple.astype(np.int64) * n + doc[:-2], -1)
    ids, _ = pd.factorize(window)
    often = (np.bincount(ids)[ids] >= 2) & whole
    covered = np.zeros(len(codes), bool)
    for k in range(3):
        covered[k : len(codes) - 2 + k] |= often
    return np.bincount(doc[covered], minlength=n)


def features(s: pd.DataFrame) -> np.ndarray:
    words, lines, letters = (np.maximum(s[c].to_numpy(float), 1) for c in ("n_words", "n_lines", "n_letters"))
    return np.column_stack([
        np.log1p(s.n_words), s.word_chars / words, s.n_symbols / words, s.n_dup_lines / lines, s.n_repeat_words / words,
        s.n_upper / letters, s.n_digits / np.maximum(s.word_chars, 1), s.n_other_punct / words, s.n_unique_words / words, s.n_words / lines,
    ])


@dataclass
class Forest:
    """All trees in flat arrays; a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float
    cut: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.bias + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: list[int], rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, smooth: float = 2.0, least: float = 2.0) -> Forest:
    """Second-order boosting of the logistic loss. A split on a constrained feature must order its children's values, and
    bounds their descendants by the middle of the two."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)])
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    margin = np.full(len(y), bias)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, lo: float, hi: float, level: int) -> int:
        me = len(nodes)
        gs, hs = g[rows].sum(), h[rows].sum()
        own = float(np.clip(-gs / (hs + smooth), lo, hi))
        nodes.append([0, np.inf, me, me, rate * own])
        best = (1e-6, None)
        for f in range(x.shape[1] if level < depth else 0):
            if not len(edges[f]):
                continue
            gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(edges[f]) + 1))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(edges[f]) + 1))[:-1]
            wl, wr = np.clip(-gl / (hl + smooth), lo, hi), np.clip(-(gs - gl) / (hs - hl + smooth), lo, hi)
            gain = -(gl * wl + 0.5 * (hl + smooth) * wl**2) - ((gs - gl) * wr + 0.5 * (hs - hl + smooth) * wr**2) + (gs * own + 0.5 * (hs + smooth) * own**2)
            gain[(hl < least) | (hs - hl < least) | (monotone[f] * (wr - wl) < 0)] = -np.inf
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (f, k, float(wl[k]), float(wr[k])))
        if best[1]:
            f, k, wl, wr = best[1]
            mid, c = (wl + wr) / 2, monotone[f]
            low = rows[binned[rows, f] <= k]
            high = rows[binned[rows, f] > k]
            a = grow(low, g, h, mid if c < 0 else lo, mid if c > 0 else hi, level + 1)
            b = grow(high, g, h, mid if c > 0 else lo, mid if c < 0 else hi, level + 1)
            nodes[me][:4] = [f, float(edges[f][k]), a, b]
        return me

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        first = len(nodes)
        roots.append(grow(np.arange(len(y)), p - y, np.maximum(p * (1 - p), 1e-6), -4.0, 4.0, 0))
        flat = _flat(nodes, [first], depth, 0.0)
        margin += flat.margin(x)
    return _flat(nodes, roots, depth, bias)


def _flat(nodes: list[list], roots: list[int], depth: int, bias: float) -> Forest:
    f, t, a, b, v = zip(*nodes)
    return Forest(np.array(f), np.array(t), np.array(a), np.array(b), np.array(v), np.array(roots), depth, bias)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, keep_share: float = KEEP_SHARE) -> Forest | None:
    """Trees from the labelled rows of ``docs``, of which a hash of the identifier takes about ``sample_rows``.

    The verdict's cut is set so that ``keep_share`` of the good rows pass."""
    tune(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").alias(id_col), F.col("quality").cast("double").alias("_quality"))
    share = min(1.0, sample_rows / max(known.count(), 1))
    drawn = known.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    rows = docs.select(id_col, text_col).join(F.broadcast(drawn), id_col)  # about sample_rows narrow rows
    got = rows.select("_quality", statistics_column(F.col(text_col)).alias("s")).select("_quality", "s.*").toPandas()
    y = (got["_quality"].to_numpy(float) > 0.5).astype(float)
    if not len(y) or y.min() == y.max():
        return None
    x = features(got)
    order = np.lexsort((*x.T, y))  # independent of the order in which rows arrive
    forest = fit_trees(x[order], y[order], MONOTONE)
    forest.cut = min(0.5, float(np.quantile(forest.score(x[y > 0]), 1 - keep_share)))
    return forest


_STATS = ", ".join(f"{c} long" for c in BASE + MORE)


def statistics_column(text: Column) -> Column:
    """A struct of ``statistics`` of a text column."""

    @F.pandas_udf(_STATS)
    def measured(s: pd.Series) -> pd.DataFrame:
        out = statistics(s.fillna("").tolist())
        trim()
        return out

    return measured(text)


def quality_column(text: Column, forest: Forest | None) -> Column:
    """A struct of the statistics, base_failed, score (0 to 1, null without trees) and kept."""

    @F.pandas_udf(_STATS + ", base_failed boolean, score double, kept boolean")
    def judged(s: pd.Series) -> pd.DataFrame:
        out = statistics(s.fillna("").tolist())
        out["base_failed"] = (out.n_words < MIN_WORDS) | (100 * out.n_repeat_words > MAX_REPEAT_PERCENT * out.n_words)
        out["score"] = forest.score(features(out)) if forest else None
        out["score"] = out["score"].astype(float)
        trim()
        out["kept"] = ~out.base_failed & ((out.score >= forest.cut) if forest else True)
        return out

    return judged(text)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, the counts, base_failed, score, kept."""
    forest = fit(docs, labels, id_col, text_col)
    tune(docs.sparkSession)
    got = docs.select(F.col(id_col).alias("doc_id"), quality_column(F.col(text_col), forest).alias("q"))
    return got.select("doc_id", *[f"q.{c}" for c in [*BASE, "base_failed", "kept", "score"]])


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged."""
    forest = fit(docs, labels, id_col, text_col)
    tune(docs.sparkSession)
    verdict = unused(docs, "verdict")
    judged = docs.withColumn(verdict, quality_column(F.col(text_col), forest))
    return judged.where(F.col(verdict).getField("kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
