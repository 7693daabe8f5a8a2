"""Quality classifier: random Fourier features, ridge regression by summed normal equations, isotonic calibration.

Each text becomes a short row of statistics. cos(statistics @ W + b) approximates a Gaussian kernel; every partition of
the labelled rows adds up its Z'Z and Z'y, the driver adds the partitions and solves one small system. The ridge score
becomes a probability by isotonic regression on the labelled scores, counted in bins. No step holds labelled rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linesieve.llm.common import columns_like, materialise, own_name, remainder
from linesieve.llm.features import NAMES, statistics

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
FEATURES = 256
BINS = 2000


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    cuts: np.ndarray
    values: np.ndarray

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights + self.phase
        return np.hstack([np.cos(z) * np.sqrt(2 / len(self.phase)), np.ones((len(x), 1))])

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.beta if len(x) else np.zeros(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; linear between the centres of the calibrated bins."""
        return np.interp(self.ridge(x), self.cuts, self.values)


def pool(counts: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Isotonic means: adjacent violators are pooled."""
    blocks: list[list[float]] = []
    for n, k in zip(counts, ones, strict=True):
        blocks.append([float(n), float(k), 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n2, k2, m2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n2, blocks[-1][1] + k2, blocks[-1][2] + m2]
    return np.concatenate([np.full(int(m), k / n if n else 0.0) for n, k, m in blocks]) if blocks else np.zeros(0)


def _stat_udf():
    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    return stats


def with_statistics(docs: DataFrame, columns: list[str], text: str = "text", name: str = "stats") -> DataFrame:
    return docs.select(*[F.col(f"`{c}`") for c in columns], _stat_udf()(F.col(f"`{text}`").cast("string")).alias(name))


def labelled(rows: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(stats, y) of rows, for ids outside the held-out fold. An id with several labels counts by their mean, and not at a half;
    null ids and labels teach nothing."""
    y = columns_like(labels, {"doc_id": "long", label: "double"}).filter(f"doc_id IS NOT NULL AND {label} IS NOT NULL")
    y = y.filter(remainder(F.col("doc_id"), FOLDS) != HELD_OUT).groupBy("doc_id").agg(F.avg(label).alias("y")).filter("y != 0.5")
    return materialise(rows.join(y.withColumn("y", (F.col("y") > 0.5).cast("double")), "doc_id").select("stats", "y"), "quality-labelled")


def _sum_by_partition(rows: DataFrame, make, shape: tuple[int, ...]) -> np.ndarray:
    """Adds the arrays that make(x, y) gives for batches: one array per partition goes to the driver, over a tree of sums."""

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape)
        for f in frames:
            if len(f):
                total += make(np.stack(f["stats"].to_numpy()), f["y"].to_numpy())
        yield pd.DataFrame({"k": [0], "v": [total.tobytes()]})

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape)
        for f in frames:
            for v in f["v"]:
                total += np.frombuffer(v).reshape(shape)
        yield pd.DataFrame({"k": [0], "v": [total.tobytes()]})

    sums = rows.select("stats", "y").mapInPandas(part, "k int, v binary")
    # A square root of the partitions at a time, in tasks and then here.
    sums = sums.repartition(math.ceil(math.sqrt(max(1, rows.rdd.getNumPartitions())))).mapInPandas(add, "k int, v binary")
    total = np.zeros(shape)
    for r in sums.toLocalIterator():
        total += np.frombuffer(r["v"]).reshape(shape)
    return total


def fit(rows: DataFrame, features: int = FEATURES, gamma: float = 0.05, ridge: float = 1e-3, seed: int = 7) -> Model:
    """rows (stats, y) -> model. Without rows every score is 0.5."""
    d = len(NAMES)
    moments = _sum_by_partition(rows, lambda x, y: np.stack([np.append(x.sum(0), len(x)), np.append((x**2).sum(0), y.sum())]), (2, d + 1))
    n = moments[0, -1]
    mean = moments[0, :-1] / max(n, 1)
    scale = np.sqrt(np.maximum(moments[1, :-1] / max(n, 1) - mean**2, 0)) + 1e-3
    rng = np.random.default_rng(seed)
    model = Model(mean, scale, rng.normal(0, np.sqrt(2 * gamma), (d, features)), rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.array([0.0]), np.array([0.5]))
    if not n:
        return model

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.lift(x)
        return np.vstack([z.T @ z, z.T @ y])

    a = _sum_by_partition(rows, normal, (features + 2, features + 1))
    model.beta = np.linalg.solve(a[:-1] + ridge * n * np.eye(features + 1) / features, a[-1])

    def bins(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        s = model.ridge(x)
        at = np.clip(((s + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return np.stack([np.bincount(at, minlength=BINS), np.bincount(at, y, minlength=BINS), np.bincount(at, s, minlength=BINS)]).astype(float)

    count, ones, total = _sum_by_partition(rows, bins, (3, BINS))
    have = count > 0
    model.cuts, model.values = total[have] / count[have], pool(count[have], ones[have])
    return model


def _score_udf(model: Model):
    @F.pandas_udf("double")
    def score(stats: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(stats.to_numpy())) if len(stats) else np.zeros(0))

    return score


def text_score(model: Model) -> Column:
    """A function from a text column to its score."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t) for t in texts]).reshape(-1, len(NAMES))))

    return score


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """documents, labels -> (doc_id, held_out, score, predicted), one row per row of docs.

    Each text is read once; what is kept of it is its statistics. Null and empty texts have a score like any other; a null
    id is never held out and never learned from. Repeated rows get equal scores. Without labels all scores are 0.5; an
    empty table gives an empty result. Other columns are ignored.
    """
    rows = materialise(with_statistics(columns_like(docs, {"doc_id": "long", "text": "string"}), ["doc_id"]), "quality-stats")
    model = fit(labelled(rows, labels, label))
    held = remainder(F.col("doc_id"), FOLDS) == HELD_OUT
    return rows.select("doc_id", held.alias("held_out"), _score_udf(model)("stats").alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def filter_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs with a score of at least the threshold, with the columns of docs."""
    stats, score = own_name(docs, "ls_stats"), own_name(docs, "ls_score")
    base = columns_like(docs, {"doc_id": "long", "text": "string"})
    model = fit(labelled(materialise(with_statistics(base, ["doc_id"]), "quality-stats"), labels, label))
    scored = docs.withColumn(score, text_score(model)(F.col("text").cast("string")))
    return scored.filter(F.col(score) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
