"""Quality classifier by hierarchical empirical Bayes.

A document's own evidence is a logistic model on the logarithms and shares of its statistics, fitted to labelled rows.
Sites and their sections add what the model says of their other documents: the section's mean, without the document's own
evidence, is shrunk towards its site's posterior mean, likewise without it, and that towards the global mean, each by a prior
strength estimated from the groups by the method of moments. A sparse site thus stays at the global prior, and a large one
speaks for itself. The posterior odds of a document are those of its own evidence times the section's posterior odds over
the global prior odds, the latter tempered so that no site alone condemns a document.

``address_levels`` gives host and first folder of an address as site and section; a table without addresses has its source,
and source and language.

Groups are summed before they are shuffled; a site with a third of all rows is one sum. Sections with more than a
thousandth of all rows, of which there are fewer than a thousand, are broadcast, so that their rows stay where they are;
the rest is joined by a shuffle. Evidence is summed in whole units of 2**-30, so sums don't depend on the order in which rows come.

Defined results: null and empty texts have no words and are judged as such; texts of any length are measured whole; a null
site or section is a group like others; a document alone in its section has its site's posterior, and one alone in its site
the global prior; with no labels, or labels of one kind, the evidence is neutral at 0.5 and all rows are kept; a score equal
to the cut is kept; repeated rows are judged alike and count each; no rows give no rows; other columns, of whatever name,
aren't read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tune, written
from .quality_rules import features, statistics, statistics_column

#: About this many labelled rows are fitted, chosen by a hash of the identifier.
SAMPLE_ROWS = 20_000
#: The part of a section's log odds that counts, and the score below which a document is dropped.
TEMPER = 0.25
CUT = 0.5


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton's method with a ridge: (mean, scale, coefficients with the intercept last)."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def evidence_features(s: pd.DataFrame) -> np.ndarray:
    """Shares in which junk differs, and their square roots: small shares matter."""
    f = features(s)
    shares = np.sqrt(np.maximum(f[:, 2:6], 0))
    return np.column_stack([f[:, [0, 1, 6, 7, 8]], np.minimum(shares, 2), np.log1p(np.maximum(f[:, 9], 0))])


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample_rows: int = SAMPLE_ROWS) -> tuple | None:
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").alias(id_col), F.col("quality").cast("double").alias("_quality"))
    share = min(1.0, sample_rows / max(known.count(), 1))
    drawn = known.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    rows = docs.select(id_col, text_col).join(F.broadcast(drawn), id_col)  # about sample_rows narrow rows
    got = rows.select("_quality", statistics_column(F.col(text_col)).alias("s")).select("_quality", "s.*").toPandas()
    y = (got["_quality"].to_numpy(float) > 0.5).astype(float)
    if not len(y) or y.min() == y.max():
        return None
    x = evidence_features(got)
    order = np.lexsort((*x.T, y))
    return fit_logistic(x[order], y[order])


def evidence_column(text: Column, model: tuple | None) -> Column:
    """The probability of good quality by the text alone."""

    @F.pandas_udf(T.DoubleType())
    def judged(s: pd.Series) -> pd.Series:
        if model is None or not len(s):
            return pd.Series(np.full(len(s), 0.5))
        mean, scale, w = model
        z = (evidence_features(statistics(s.fillna("").tolist())) - mean) / scale
        return pd.Series(1 / (1 + np.exp(-np.clip(z @ w[:-1] + w[-1], -30, 30))))

    return judged(text)


def prior_strength(n: Column, total: Column, squares: Column, mean: Column, spread: Column) -> Column:
    """Pseudo-count of a prior by the method of moments over groups.

    ``spread`` is the documents' variance within groups; what the groups' means vary beyond spread / n is the variance
    between them. The strength is the ratio of the two."""
    between = F.greatest((squares - total * mean * mean - spread * n) / F.greatest(total, F.lit(1.0)), F.lit(1e-6))
    return F.least(F.greatest(spread / between, F.lit(1.0)), F.lit(1e6))


def address_levels(url: Column) -> tuple[Column, Column]:
    """Host, and host and first folder, of an address."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    return host, F.concat_ws("/", host, F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^/?#]*)/", 1))


#: One unit of summed evidence.
UNIT = 1 << 30
#: Sections with more than one in this many rows are joined by a broadcast.
HOT = 1000


def posteriors(judged: DataFrame, cut: float = CUT, temper: float = TEMPER) -> DataFrame:
    """doc_id, evidence, site_posterior, section_posterior, score, kept of rows of doc_id, site, section and u (evidence in
    units)."""
    p = F.col("u") / UNIT
    sections = judged.groupBy("site", "section").agg(F.count("*").alias("n"), F.sum("u").alias("s"), F.sum((F.col("u") * F.col("u")).cast("decimal(38,0)")).alias("q"))
    sites = sections.groupBy("site").agg(F.sum("n").alias("site_n"), F.sum("s").alias("site_s"), F.sum("q").alias("site_q"))

    def squares(s: str, n: str) -> Column:  # of group means, in whole units, for sums without an order
        return F.sum(F.floor(F.col(s) / UNIT * F.col(s) / F.col(n)))

    world = sites.agg(F.sum("site_n").alias("wn"), F.sum("site_s").alias("ws"), F.sum("site_q").alias("wq"), squares("site_s", "site_n").alias("site_sq"), F.count("*").alias("groups"))
    world = world.crossJoin(sections.agg(squares("s", "n").alias("section_sq"), F.count("*").alias("section_groups")))  # one row
    total = F.greatest(F.col("wn"), F.lit(1))
    mean, all_sq = F.col("ws") / UNIT / total, F.col("wq").cast("double") / UNIT / UNIT

    def strength(groups: str, sq: str) -> Column:
        own = F.col(sq) / UNIT
        return prior_strength(F.col(groups), F.col("wn"), own, mean, F.greatest((all_sq - own) / total, F.lit(1e-4)))

    world = world.select(F.col("wn").alias("all_n"), mean.alias("prior"), strength("groups", "site_sq").alias("site_k"), strength("section_groups", "section_sq").alias("section_k"))
    groups = written(sections.join(sites, "site").crossJoin(F.broadcast(world)).drop("q", "site_q"), "section-sums")
    hot = F.col("n") * HOT > F.col("all_n")
    large = F.broadcast(groups.where(hot))  # fewer than HOT rows
    rest = judged.join(large.select("site", "section"), ["site", "section"], "left_anti")
    out = judged.join(large, ["site", "section"]).unionByName(rest.join(groups.where(~hot), ["site", "section"]))
    out = out.withColumn("site_posterior", ((F.col("site_s") - F.col("u")) / UNIT + F.col("site_k") * F.col("prior")) / (F.col("site_n") - 1 + F.col("site_k")))
    out = out.withColumn("section_posterior", ((F.col("s") - F.col("u")) / UNIT + F.col("section_k") * F.col("site_posterior")) / (F.col("n") - 1 + F.col("section_k")))

    def logit(p: Column) -> Column:
        q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
        return F.log(q / (1 - q))

    odds = logit(p) + temper * (logit(F.col("section_posterior")) - logit(F.col("prior")))
    out = out.withColumn("score", 1 / (1 + F.exp(-odds)))
    return out.select("doc_id", p.alias("evidence"), "site_posterior", "section_posterior", "score", (F.round("score", 9) >= cut).alias("kept"))


def site_quality(docs: DataFrame, labels: DataFrame, site: Column, section: Column, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT, temper: float = TEMPER) -> DataFrame:
    """One row for each document: doc_id, evidence, site_posterior, section_posterior, score, kept."""
    tune(docs.sparkSession)
    model = fit(docs, labels, id_col, text_col)
    units = F.round(evidence_column(F.col(text_col), model) * UNIT).cast("long")
    judged = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(site.cast("string"), F.lit("")).alias("site"), F.coalesce(section.cast("string"), F.lit("")).alias("section"), units.alias("u"))
    return posteriors(written(judged, "evidence"), cut, temper)
