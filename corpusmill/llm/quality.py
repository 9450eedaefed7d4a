"""Document quality by hierarchical empirical Bayes.

A logistic model, fitted on a bounded sample of labelled documents, gives each document a probability. Its evidence
are surface features and what the text is about: a ridge regression on hashed runs of one and two words, whose
value for a sampled document comes from the folds without it. Grouped sums of these give every host, and every path of a host, a posterior
mean: a prior centred on the global mean shrinks a host, one centred on the host's posterior shrinks a
path, so that sparse sites stay near what is above them. A prior's weight, in documents, is the spread
within sites over the spread between them, by moments of a nested analysis of variance. A document's own
evidence is left out of its site's sums, so that it counts once. Its log odds are then moved by how far
the posterior of its site lies from the global mean.

Edge cases: a null or empty text has the features of an empty one; a null host or path is a site of its
own; a site of one document has its host's posterior, a host of one document the global mean; labels that
are null are not learned from; with labels of one kind only, or none, every document has that share (or a
half) as its probability; repeated rows are scored one by one; an empty table gives no rows; other columns
pass through, whatever their names, but for those named like a result (_p, _site, _score, _keep), which
give way.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import array_udf, join_checked, own, packed, stored, unpacked
from corpusmill.llm.resampling import features as runs
from corpusmill.llm.words import blocks

#: Most labelled documents that the model is fitted on.
SAMPLE = 5000
RIDGE = 0.05
STEPS = 40
#: Share of a site's log-odds shift that reaches its documents where no labels tell, and the score from which a document stays.
SITE_WEIGHT = 0.5
KEEP = 0.5
#: Bounds of a prior's weight, in documents.
WEIGHTS = (2.0, 1000.0)
#: Surface features; words of the longest run, buckets of runs, ridge and folds of the regression on them.
SURFACE = 12
RUN, BUCKETS, GRAM_RIDGE, FOLDS = 2, 1024, 1e-5, 5
FEATURES = SURFACE + 1


def features(text: str | None) -> list[float]:
    """Surface features of a whole text, each about 0 to 1."""
    text = text or ""
    words = text.split()
    n, w = max(1, len(text)), max(1, len(words))
    distinct = len(set(words))
    upper = sum(map(str.isupper, words))
    odd = sum(1 for x in words if not x[0].isalnum() or (len(x) > 1 and not x[-1].isalnum() and not x[-2].isalnum()))
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    top = max(Counter(words).values(), default=0)
    lines = [x for x in text.split("\n") if x.strip()]
    marks = sum(text.count(c) for c in "|#$%&*!<>{}[]\\^~_=@")
    digits = sum(text.count(c) for c in "0123456789")
    stops = sum(text.count(c) for c in ".?")
    return [
        marks / n * 10,
        odd / w,
        upper / w,
        repeats / w,
        math.log(w) / math.log(distinct + 1.0) - 1 if distinct else 0.0,
        top / w,
        digits / n * 10,
        min(2.0, stops / w * 5),
        min(2.0, sum(map(len, words)) / w / 10),
        1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(w) / 10,
        min(1.0, text.count("|") / w),
    ]


@dataclass(frozen=True)
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    grams: np.ndarray

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """All features of each text: the surface ones, and the mean weight of its runs of words."""
        return np.c_[surface(texts), run_means(texts, self.grams)]

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.mean) / self.scale, -6, 6) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -12, 12)))


def surface(texts: pa.Array) -> np.ndarray:
    return np.array([features(t) for t in texts.to_pylist()]).reshape(-1, SURFACE)


def run_means(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """The mean weight of each text's runs of words; 0 without words."""
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for block in blocks(texts, RUN - 1):
        for bucket, first in runs(block, RUN, len(weights)):
            row = block.row[first]
            total += np.bincount(row, weights[bucket], len(texts))
            n += np.bincount(row, minlength=len(texts))
    return total / np.maximum(n, 1)


def run_shares(texts: pa.Array) -> np.ndarray:
    """Share of each bucket in each text's runs of words."""
    out = np.zeros((len(texts), BUCKETS))
    for block in blocks(texts, RUN - 1):
        for bucket, first in runs(block, RUN, BUCKETS):
            np.add.at(out, (block.row[first], bucket), 1)
    return out / np.maximum(out.sum(1, keepdims=True), 1)


def _ridge(shares: np.ndarray, labels: np.ndarray) -> np.ndarray:
    return np.linalg.solve(shares.T @ shares + GRAM_RIDGE * len(labels) * np.eye(BUCKETS), shares.T @ (labels - labels.mean()))


def solve(rows: np.ndarray, labels: np.ndarray, shares: np.ndarray | None = None) -> Classifier:
    """Ridge logistic regression by Newton steps, on surface features and on what a regression on `shares` tells."""
    none = np.zeros(BUCKETS)
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.5
        share = min(max(share, 0.01), 0.99)
        return Classifier(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), math.log(share / (1 - share)), none)
    told, grams = np.zeros(len(labels)), none
    if shares is not None:
        fold = np.arange(len(labels)) % FOLDS
        for k in range(FOLDS):
            if (fold != k).any() and (fold == k).any():
                told[fold == k] = shares[fold == k] @ _ridge(shares[fold != k], labels[fold != k])
        grams = _ridge(shares, labels)
    rows = np.c_[rows, told]
    mean, scale = rows.mean(0), rows.std(0) + 1e-6
    x = np.c_[np.clip((rows - mean) / scale, -6, 6), np.ones(len(rows))]
    ridge, b = RIDGE * np.eye(x.shape[1]) * len(rows) / 100, np.zeros(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge, x.T @ (labels - p) - ridge @ b)
        b += step
        if abs(step).max() < 1e-8:
            break
    return Classifier(mean, scale, b[:-1], float(b[-1]), grams)


def _features(texts: pa.Array) -> pa.Array:
    plain, shares = surface(texts), run_shares(texts).astype(np.float32)
    return pa.StructArray.from_arrays([pa.array(list(plain), pa.list_(pa.float64())), pa.array([x.tobytes() for x in shares], pa.binary())], names=["x", "shares"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Classifier:
    """A classifier from at most SAMPLE labelled documents, drawn by a hash of the id; only features reach the driver."""
    drawn = sampled(labels, id_col, label_col)
    rows = join_checked(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")), drawn, "_id", "inner", SAMPLE)
    found = rows.select("_label", array_udf(_features, "struct<x: array<double>, shares: binary>")("_text").alias("f")).select("_label", "f.*").collect()
    found = sorted((r["_label"], r["x"], bytes(r["shares"])) for r in found)  # one order whatever the partitions
    shares = np.array([np.frombuffer(x, np.float32) for _, _, x in found], np.float64).reshape(-1, BUCKETS)
    return solve(np.array([x for _, x, _ in found]).reshape(-1, SURFACE), np.array([y for y, _, _ in found]), shares)


def sampled(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """_id, _label of at most SAMPLE labels."""
    ids = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_label"))
    return stored(ids.orderBy(F.xxhash64("_id", F.lit("quality sample")), "_id").limit(SAMPLE), "quality-sample")


def site_weight(own: np.ndarray, shift: np.ndarray, labels: np.ndarray) -> float:
    """The share of a site's shift, from 0 to 1, under which labels are most likely, given log odds of their own."""
    if not len(labels) or labels.min() == labels.max() or not np.abs(shift).max() > 0:
        return SITE_WEIGHT
    shares = np.linspace(0, 1, 21)
    loss = [np.mean(np.logaddexp(0, np.where(labels > 0.5, -1, 1) * (own + c * shift))) for c in shares]
    return float(shares[int(np.argmin(loss))])


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def weight(within: float, between: float, degrees: float, spread: float) -> float:
    """A prior's weight in documents: variance within sites over the variance between them.

    between: weighted squares of site means around what is above them; degrees: its degrees of freedom;
    spread: the weight of the variance between sites in its expectation.
    """
    variance = (between - degrees * within) / spread if spread > 0 else 0.0
    found = within / variance if variance > 0 else WEIGHTS[1]
    return min(max(found, WEIGHTS[0]), WEIGHTS[1])


def score(docs: DataFrame, model: Classifier, host: Column, path: Column, text_col: str = "text", labels: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """docs without their text, with _p (document alone), _site (posterior of its path), _score (combined, 0 to 1) and _keep.

    labels: id_col and quality; at most SAMPLE of them set the sites' weight.
    """

    def run(texts: pa.Array) -> pa.Array:
        own("quality")
        return pa.array(model.probabilities(model.evidence(texts)), pa.float64())

    names = [c for c in docs.columns if c != text_col]
    named = lambda c: F.coalesce(c.cast("string"), F.lit("\0"))
    marked = docs.select(packed(docs, names).alias("row"), named(host).alias("host"), named(path).alias("path"), array_udf(run, "double")(F.col(f"`{text_col}`").cast("string")).alias("p"))
    marked = stored(marked, "scored")
    paths = stored(marked.groupBy("host", "path").agg(F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("squares"), F.count(F.lit(1)).cast("double").alias("n")), "paths")
    hosts = stored(paths.groupBy("host").agg(F.sum("s").alias("host_s"), F.sum("n").alias("host_n"), F.sum(F.col("n") * F.col("n")).alias("path_n2")), "hosts")
    sites = stored(paths.join(hosts, "host"), "sites")

    path_mean, host_mean = F.col("s") / F.col("n"), F.col("host_s") / F.col("host_n")
    total = hosts.agg(F.sum("host_s").alias("s"), F.sum("host_n").alias("n"), F.count(F.lit(1)).alias("hosts"), F.sum(F.col("host_n") * F.col("host_n")).alias("host_n2"), F.sum(F.col("path_n2") / F.col("host_n")).alias("path_share")).first()
    n = total["n"] or 0.0
    mean = min(max(total["s"] / n, 0.001), 0.999) if n else 0.5
    found = sites.agg(
        F.count(F.lit(1)).alias("paths"), F.sum(F.col("squares") - F.col("n") * path_mean * path_mean).alias("within"), F.sum(F.col("n") * F.pow(path_mean - host_mean, 2)).alias("between_paths"), F.sum(F.col("n") * F.pow(host_mean - F.lit(mean), 2)).alias("between_hosts")
    ).first()
    host_weight = path_weight = WEIGHTS[1]
    if n > found["paths"]:
        within = max(found["within"], 0.0) / (n - found["paths"])
        path_weight = weight(within, found["between_paths"], found["paths"] - total["hosts"], n - total["path_share"])
        host_weight = weight(within, found["between_hosts"], total["hosts"] - 1, n - total["host_n2"] / n)

    out = join_checked(marked, sites.select("host", "path", "s", "n", "host_s", "host_n"), ["host", "path"], "left")
    above = (F.col("host_s") - F.col("p") + F.lit(host_weight * mean)) / (F.col("host_n") - 1 + F.lit(host_weight))
    site = (F.col("s") - F.col("p") + F.lit(path_weight) * above) / (F.col("n") - 1 + F.lit(path_weight))
    out = out.select("row", "p", F.least(F.greatest(site, F.lit(1e-6)), F.lit(1 - 1e-6)).alias("site"))
    shift = _logit(F.col("site")) - F.lit(math.log(mean / (1 - mean)))
    share = SITE_WEIGHT
    if labels is not None:
        told = join_checked(out.select(F.col("row").getField(id_col).alias("_id"), _logit(F.col("p")).alias("own"), shift.alias("shift")), sampled(labels, id_col), "_id", "inner", SAMPLE)
        told = np.array(sorted((r["own"], r["shift"], r["_label"]) for r in told.select("own", "shift", "_label").collect())).reshape(-1, 3)  # a row a label
        share = site_weight(told[:, 0], told[:, 1], told[:, 2])
    shift = F.lit(share) * shift
    out = out.withColumn("score", 1 / (1 + F.exp(-(_logit(F.col("p")) + shift))))
    return unpacked(out, "row", names, _p=F.col("p"), _site=F.col("site"), _score=F.col("score"), _keep=F.col("score") >= KEEP)
