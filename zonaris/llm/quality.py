"""Quality scores: random Fourier features over document statistics, ridge by normal equations, isotonic calibration.

Each text becomes `STATS` (all of it, whatever its length). Standardised, they are mapped by
sqrt(2/D) * cos(W x + b) with normal W, which approximates a Gaussian kernel. Every partition of labelled rows adds its
products of features into the normal equations, Spark sums them entry by entry, and the driver solves one (D+1)-square
system. A fifth of the labelled rows, chosen by a hash, is held aside from that fit; their raw scores are counted in fixed bins, and
pooling adjacent violators over the bins gives a monotone map from raw score to the share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import lists, struct, text_function
from .scratch import materialize
from .textkit import words

STATS = ("log_bytes", "log_words", "word_bytes", "capitals", "digits", "symbols", "spaces", "lines", "stops", "bars", "marks", "non_ascii", "capital_words", "distinct_words", "top_word", "repeated_neighbours", "distinct_lines", "words_a_stop")
FEATURES, WIDTH, RIDGE, BINS, SEED = 192, 2.0, 1e-3, 400, 7
ASIDE = 5  # one in so many labelled rows serves for calibration only
_CLASSES = np.zeros((256, 8))
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*<>=+^~@_\\/{}[]", b" \t\r", b"\n", b".!?", b"|", b"!*#&%$")):
    _CLASSES[list(_chars), _k] = 1


def statistics(texts: list[str | None]) -> np.ndarray:
    """(texts, STATS); an empty or null text has zeros."""
    n = len(texts)
    w = words(texts)
    at = w.starts()
    count = np.diff(at).astype(float)
    out = np.zeros((n, len(STATS)))
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    size = np.array([len(r) for r in raws], float)
    histogram = np.array([np.bincount(np.frombuffer(r, np.uint8), minlength=256) for r in raws], float).reshape(n, 256)
    some, any_word = np.maximum(size, 1), np.maximum(count, 1)
    shares = histogram @ _CLASSES
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(count)
    word_bytes = size - shares[:, 3] - shares[:, 4]
    out[:, 2] = word_bytes / any_word
    out[:, 3:11] = shares / some[:, None]
    out[:, 11] = histogram[:, 128:].sum(1) / some
    out[:, 12] = np.bincount(w.text, w.capital, n) / any_word
    order = np.lexsort((w.hash, w.text))
    h, t = w.hash[order], w.text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(h)))
    top = np.zeros(n)
    np.maximum.at(top, t[first], runs)
    out[:, 13] = np.bincount(t[first], minlength=n) / any_word
    out[:, 14] = top / any_word
    same = (w.hash[1:] == w.hash[:-1]) & (w.text[1:] == w.text[:-1])
    out[:, 15] = np.bincount(w.text[1:], same, n) / any_word if len(w.hash) else 0
    lines = [r.split(b"\n") for r in raws]
    out[:, 16] = [len(set(x)) / len(x) for x in lines]
    out[:, 17] = np.log1p(count / (1 + shares[:, 5]))
    out[size == 0] = 0
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray
    edges: np.ndarray  # raw scores
    values: np.ndarray  # calibrated scores there
    features: int = FEATURES
    width: float = WIDTH
    seed: int = SEED

    def map(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        rng = np.random.default_rng(self.seed)
        w = rng.normal(0, 1 / (self.width * np.sqrt(x.shape[1])), (x.shape[1], self.features))
        b = rng.uniform(0, 2 * np.pi, self.features)
        return np.hstack([np.sqrt(2 / self.features) * np.cos(x @ w + b), np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.map(stats) @ self.beta

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.edges, self.values), 0, 1) if len(stats) else np.zeros(0)


def isotonic(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pooled adjacent violators: the non-decreasing fit to means `y` with weights."""
    value, mass, size = [], [], []
    for v, m in zip(y, weight, strict=True):
        value.append(v), mass.append(m), size.append(1)
        while len(value) > 1 and value[-2] >= value[-1]:
            total = mass[-2] + mass[-1]
            value[-2] = (value[-2] * mass[-2] + value[-1] * mass[-1]) / total
            mass[-2], size[-2] = total, size[-2] + size[-1]
            value.pop(), mass.pop(), size.pop()
    return np.repeat(value, size)


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) for each row of `docs` (doc_id, text; further columns are ignored); an empty or null text has zeros."""
    k = len(STATS)
    stats = text_function(lambda t: lists(np.arange(len(t) + 1) * k, statistics(t).ravel()), "array<double>")
    return docs.select("doc_id", stats("text").alias("stats"))


def _matrix(stats: pa.Array) -> np.ndarray:
    return stats.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATS))


def fit(stats: DataFrame, labels: DataFrame, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, bins: int = BINS, seed: int = SEED) -> Model:
    """A model from (doc_id, stats) and (doc_id, quality 0/1), over all labelled rows.

    A doc_id with several labels counts with their largest; null labels and null doc_ids do not count. Without a labelled row the
    model gives 0.5 to all, with labels of one kind that label; where the rows held aside, or those left, are none, all serve for both.
    The driver receives sums only, whose number depends on `features` and `bins`. Further columns, of any name, are ignored; empty tables count as
    being without a labelled row.
    """
    k = len(STATS)
    lab = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    rows = stats.join(lab, "doc_id").select("stats", "y", (F.pmod(F.xxhash64(F.lit("aside"), "doc_id"), F.lit(ASIDE)) == 0).alias("aside"))
    rows = materialize(rows, "labelled")
    moments = [f(F.col("stats")[i]).alias(f"{n}{i}") for i in range(k) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    sums = rows.agg(F.count("*").alias("n"), F.count_if("aside").alias("held"), *moments).first()
    if not sums["n"]:
        return Model(np.zeros(k), np.ones(k), np.zeros(features + 1), np.array([0.0, 1.0]), np.array([0.5, 0.5]), features, width, seed)
    split = 0 < sums["held"] < sums["n"]
    learned, aside = (rows.where("not aside"), rows.where("aside")) if split else (rows, rows)
    mean, scale = (np.array([sums[f"{c}{i}"] for i in range(k)]) for c in "ms")
    scale = np.where(scale > 1e-12, scale, 1.0)
    base = Model(mean, scale, np.zeros(features + 1), np.zeros(2), np.zeros(2), features, width, seed)
    d = features + 1

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.zeros((d, d + 1))
        for b in batches:
            z = base.map(_matrix(b.column("stats")))
            a += z.T @ np.column_stack([z, b.column("y").to_numpy()])
        i, j = np.repeat(np.arange(d, dtype=np.int32), d + 1), np.tile(np.arange(d + 1, dtype=np.int32), d)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(a.ravel())], names=["i", "j", "v"])

    total = learned.select("stats", "y").mapInArrow(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    a = np.zeros((d, d + 1))
    a[total["i"], total["j"]] = total["v"]
    n = sums["n"] - sums["held"] if split else sums["n"]
    beta = np.linalg.solve(a[:, :d] + ridge * n * np.eye(d) * (np.arange(d) < features)[:, None] + 1e-9 * np.eye(d), a[:, d])
    model = Model(mean, scale, beta, np.zeros(2), np.zeros(2), features, width, seed)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.clip(np.floor((model.raw(_matrix(b.column("stats"))) + 0.5) / 2 * bins), 0, bins - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column("y")], names=["bin", "y"])

    binned = aside.select("stats", "y").mapInArrow(scored, "bin int, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").toPandas()
    model.edges = (binned["bin"].to_numpy() + 0.5) / bins * 2 - 0.5
    model.values = isotonic(binned["y"].to_numpy(), binned["n"].to_numpy(float))
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) for each row of (doc_id, stats)."""

    @F.arrow_udf("double")
    def scored(s: pa.Array) -> pa.Array:
        return pa.array(model.score(_matrix(s)), pa.float64())

    return stats.select("doc_id", scored("stats").alias("score")).select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def score_documents(docs: DataFrame, labels: DataFrame, train: str | None = None) -> DataFrame:
    """(doc_id, score, predicted) for each row of `docs` (doc_id, text; further columns are ignored).

    `train` is a SQL condition on doc_id that labelled rows must meet to be learned from; scores depend on the text alone. Empty and
    null texts have a score too; very long texts are measured whole; repeated rows and null doc_ids are kept; an empty table gives no rows.
    """
    stats = materialize(document_statistics(docs), "statistics")
    chosen = labels if train is None else labels.where(train)
    return score(stats, fit(stats, chosen.select("doc_id", "quality")))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of `docs` whose score, by a model fitted on all labels, is at least `least`; columns as they are.

    Statistics are computed of the labelled documents to fit, then of each text to judge it. Null and empty texts are judged like
    any other; null doc_ids and repeated rows are judged by their text; columns may have any name and type; an empty table gives no rows.
    """
    labelled = docs.join(labels.where("quality is not null").select("doc_id").distinct(), "doc_id", "left_semi")
    model = fit(document_statistics(labelled), labels.select("doc_id", "quality"))
    good = text_function(lambda t: pa.array(model.score(statistics(t)), pa.float64()), "double")
    return docs.where(good("text") >= least)
