"""Language identification by nearest centroid.

A text becomes a normalised TF-IDF vector of hashed character n-grams of its lower-case letters; words are bounded by
anything that isn't a letter. Each language has several centroids, found by spherical k-means, and a text takes the
language of the centroid of largest cosine. A text farther from its centroid than the language's learned limit for texts
of its length is rejected.

Fitting draws about ``SAMPLE_ROWS`` labelled rows of each language by a hash of the identifier; this is the only bounded
step. A third of them is kept apart from the centroids, and passages of several lengths from it set the limits: the
median cosine of the language at a length, times the share of the median that all but ``TAIL`` of the passages reach,
``STAYS`` at most. Prediction reads every whole text, long ones in blocks.

Defined results: null, empty and letterless texts are ``und`` with score 0 and rejected; so is everything if nothing is
labelled; a language of one labelled row has one centroid, one of more has at least two; equal cosines go to the language
first in order of name; texts of any length are read whole; repeated rows get equal results; no rows give no rows; other
columns, of whatever name, are neither read nor needed.
"""

from __future__ import annotations

import functools
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import trim, tune, unused

SAMPLE_ROWS = 600
CENTROIDS = 4
DIMENSIONS = 4096
BLOCK = 1 << 20
#: Limits are learned from passages of so many characters; all but ``TAIL`` of them stay, and a text of this part of the
#: median cosine always does: rows of odd content, such as one word over and over, may be missing in a small sample.
PASSAGES, TAIL, STAYS = [5 << i for i in range(8)], 0.02, 0.5
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def ngram_counts(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Counts of hashed 1- to 3-grams; grams don't cross words. All zero if there is no letter."""
    out = np.zeros(dimensions, np.int64)
    start = 0
    while start < len(text):
        end = min(start + BLOCK, len(text))
        while end < len(text) and text[end].isalpha():  # blocks end with words
            end += 1
        out += _block(np.frombuffer(text[start:end].lower().encode("utf-32-le", "surrogatepass"), np.uint32), dimensions)
        start = end
    return out


def _block(points: np.ndarray, dimensions: int) -> np.ndarray:
    p = np.where(_letters()[points], points, 0).astype(np.uint32)
    p = np.concatenate([[0], p, [0]]).astype(np.uint32)
    p = p[(p != 0) | np.concatenate([[True], p[:-1] != 0])]
    if len(p) < 3:
        return np.zeros(dimensions, np.int64)
    one = p * np.uint32(0x9E3779B1)
    a, b, c = one[:-2], one[1:-1], one[2:]
    inner = p[1:-1] != 0
    grams = [b[inner] ^ np.uint32(0x85EBCA6B), (a * np.uint32(31) + b)[inner], (b * np.uint32(31) + c)[inner & (p[2:] == 0)], ((a * np.uint32(31) + b) * np.uint32(31) + c)[inner] + np.uint32(0x27D4EB2F)]
    h = np.concatenate(grams)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return np.bincount(h % np.uint32(dimensions), minlength=dimensions)


@dataclass
class Centroids:
    idf: np.ndarray
    centres: np.ndarray
    languages: list[str]
    sizes: np.ndarray  # logarithms of the counts of grams that limits are learned for, rising
    limits: np.ndarray  # for each centroid and size

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row, and the cosine."""
        sims = vectors(counts, self.idf) @ self.centres.T
        best = sims.argmax(axis=1)
        return best, np.clip(sims[np.arange(len(best)), best], 0, 1)


    def limit(self, best: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The least cosine that each row needs to its nearest centroid."""
        size = np.log1p(counts.sum(axis=1))
        return np.array([np.interp(n, self.sizes, self.limits[b]) for n, b in zip(size, best)], float) if len(self.sizes) else np.zeros(len(best))


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(counts).astype(np.float32) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def spherical_kmeans(v: np.ndarray, k: int, rounds: int = 12, least: float = 0.1) -> np.ndarray:
    """Unit centroids, from seeded random rows. Clusters of less than the share ``least`` are given up: they are made of
    mixed or mislabelled rows. If a single one would be left, the rows are halved along their widest direction."""

    def unit(m: np.ndarray) -> np.ndarray:
        return m / max(np.linalg.norm(m), 1e-9)

    start = np.random.default_rng(0).choice(len(v), min(k, max(1, len(v) // 20)), replace=False)
    c = v[start]
    while True:
        for _ in range(rounds):
            near = (v @ c.T).argmax(axis=1)
            c = np.array([unit(v[near == j].mean(axis=0)) if (near == j).any() else c[j] for j in range(len(c))])
        share = np.bincount((v @ c.T).argmax(axis=1), minlength=len(c)) / len(v)
        if len(c) > 1 and share.min() >= least:
            return c
        if len(c) <= 2:
            break
        c = np.delete(c, share.argmin(), axis=0)
    if len(v) < 2:
        return v
    off = v - v.mean(axis=0)
    axis = off[np.linalg.norm(off, axis=1).argmax()]
    for _ in range(rounds):
        axis = unit(off.T @ (off @ axis))
    order = np.argsort(off @ axis, kind="stable")
    return np.array([unit(v[half].mean(axis=0)) for half in np.array_split(order, 2)])


def fit_counts(counts: np.ndarray, langs: list[str], centroids: int = CENTROIDS) -> Centroids | None:
    kept = counts.sum(axis=1) > 0
    counts, langs = counts[kept], [x for x, k in zip(langs, kept) if k]
    if not langs:
        return None
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    v = vectors(counts, idf)
    centres, names = [], []
    for lang in sorted(set(langs)):
        own = v[[x == lang for x in langs]]
        c = spherical_kmeans(own, centroids)
        centres.append(c)
        names += [lang] * len(c)
    return Centroids(idf, np.concatenate(centres).astype(np.float32), names, np.zeros(0), np.zeros((len(names), 0)))


def passages(text: str) -> list[tuple[int, str]]:
    """(index of its length, passage) from the middle of a text, of each length that the text has twice."""
    return [(i, text[(len(text) - n) // 2 :][:n]) for i, n in enumerate(PASSAGES) if len(text) >= 2 * n]


def set_limits(model: Centroids, seen: list[tuple[str, int, float, float]]) -> None:
    """Limits from (language, index of length, grams, cosine) of passages that the centroids weren't fitted on."""
    frame = pd.DataFrame(seen, columns=["lang", "i", "grams", "score"])
    frame = frame[frame.grams > 0]
    if frame.empty:
        return
    frame["middle"] = frame.groupby(["lang", "i"]).score.transform("median")
    part = (frame.score / frame.middle.clip(lower=1e-9)).groupby(frame.i).quantile(TAIL).clip(upper=STAYS)
    pooled, middles = frame.groupby("i").score.median(), frame.groupby(["lang", "i"]).score.median()
    model.sizes = np.maximum.accumulate(np.log1p(frame.groupby("i").grams.median().to_numpy()))
    rows = {x: np.maximum.accumulate([part[i] * middles.get((x, i), pooled[i]) for i in part.index]) for x in set(model.languages)}
    model.limits = np.array([rows[x] for x in model.languages])


@F.pandas_udf(T.BinaryType())
def _counts_column(s: pd.Series) -> pd.Series:
    return pd.Series([ngram_counts(t or "").astype(np.float32).tobytes() for t in s])


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def kept_apart(doc_id: Column) -> Column:
    """Drawn rows that limits, not centroids, are learned from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Centroids | None:
    """Centroids and limits from the labelled rows that aren't held out, about ``sample_rows`` of each language. A language
    that has too few rows for both has its centroids from all of them."""
    tune(docs.sparkSession)
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    if not sizes:
        return None
    bound = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, sample_rows / n) * (1 << 30)))])
    drawn = known.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) < bound[F.col(lang_col)])
    rows = drawn.select(F.col(id_col), F.col(lang_col).alias("_lang"), kept_apart(F.col(id_col)).alias("_apart"), _counts_column(F.col(text_col)).alias("_counts"))
    got = sorted(((r["_lang"], r[id_col], r["_apart"], bytes(r["_counts"])) for r in rows.collect()))
    lettered = {x for x, _, apart, c in got if not apart and any(c)}
    got = [(x, c) for x, _, apart, c in got if not apart or x not in lettered]
    if not got:
        return None
    model = fit_counts(np.array([np.frombuffer(c, np.float32) for _, c in got]), [x for x, _ in got])
    if model is not None:
        seen = drawn.where(kept_apart(F.col(id_col))).select(F.col(lang_col).alias("_lang"), F.explode(_passages_column(F.col(text_col), model)).alias("_p"))
        set_limits(model, sorted((r[0], int(r[1]), r[2], r[3]) for r in seen.select("_lang", "_p.i", "_p.grams", "_p.score").collect()))
    return model


def _passages_column(text: Column, model: Centroids) -> Column:
    @F.pandas_udf("array<struct<i: int, grams: double, score: double>>")
    def scored(s: pd.Series) -> pd.Series:
        out = []
        for t in s:
            own = passages(t or "")
            counts = np.array([ngram_counts(p) for _, p in own], np.float32).reshape(-1, DIMENSIONS)
            _, score = model.predict(counts)
            out.append([{"i": i, "grams": float(n), "score": float(x)} for (i, _), n, x in zip(own, counts.sum(axis=1), score)])
        return pd.Series(out)

    return scored(text)


def language_column(text: Column, model: Centroids | None) -> Column:
    """A struct of lang_pred, score and rejected."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predicted(s: pd.Series) -> pd.DataFrame:
        n = len(s)
        if model is None or not n:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * n, "score": np.zeros(n), "rejected": [True] * n})
        langs = np.array(model.languages, dtype=object)
        counts = np.array([ngram_counts(t or "") for t in s], np.float32)
        best, score = model.predict(counts)
        none = counts.sum(axis=1) == 0
        score[none] = 0
        trim()
        return pd.DataFrame({"lang_pred": np.where(none, UNKNOWN, langs[best]), "score": score.astype(float), "rejected": none | (score < model.limit(best, counts))})

    return predicted(text)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred, score, rejected."""
    model = fit(docs, id_col, text_col, lang_col)
    got = docs.select(F.col(id_col).alias("doc_id"), language_column(F.col(text_col), model).alias("p"))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "p.lang_pred", "p.score", "p.rejected")


def language_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows that aren't rejected; lang becomes the predicted language."""
    model = fit(docs, id_col, text_col, lang_col)
    verdict = unused(docs, "verdict")
    judged = docs.withColumn(verdict, language_column(F.col(text_col), model)).where(~F.col(verdict).getField("rejected"))
    return judged.select(*[F.col(verdict).getField("lang_pred").alias(c) if c == lang_col else F.col(f"`{c}`") for c in docs.columns])
