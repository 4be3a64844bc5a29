"""Quality classifier: ridge regression on random Fourier features, then isotonic calibration.

The standardised statistics of a text go through random cosines whose inner products approximate a Gaussian
kernel. Every partition adds up its normal equations, one set per fold; the sets are added in a tree and only
the last few sums reach the driver, where each fold is solved without itself. The out-of-fold scores of all
training rows, counted in narrow bins, are calibrated by pooling neighbouring bins that are out of order.

Scale: texts are read once and become twelve numbers that are stored; training joins those numbers with the
labels. Sums have a fixed size (folds x features squared), whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secflow.llm.docstats import RATIOS, learnable, measure, with_stats
from secflow.settings import checkpointed

FEATURES, FOLDS, SEED, RIDGE = 192, 3, 11, 1e-3
#: Calibration bins over raw scores from -0.5 to 1.5.
BINS = 4096
#: Partial sums that are added in one task of the second level.
LANES = 8


@dataclass
class Fourier:
    """z(x) = (1, sqrt(2/D) cos(Wx + b)) over standardised x."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray

    @classmethod
    def draw(cls, mean: np.ndarray, scale: np.ndarray, width: float = 2.0) -> Fourier:
        rng = np.random.default_rng(SEED)
        return cls(mean, scale, rng.normal(size=(len(mean), FEATURES)) / width, rng.uniform(0, 2 * np.pi, FEATURES))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        standard = np.clip((x - self.mean) / self.scale, -6, 6)
        waves = np.sqrt(2 / FEATURES) * np.cos(standard @ self.weights + self.phase)
        return np.concatenate([np.ones((len(x), 1)), waves], 1)


@dataclass
class Model:
    fourier: Fourier
    beta: np.ndarray
    knots: np.ndarray  # raw scores, ascending
    levels: np.ndarray  # calibrated scores, not descending

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.fourier(x) @ self.beta, self.knots, self.levels)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float).reshape(-1, len(RATIOS))


def _partition_sums(fourier: Fourier):
    """(fold, lane, sums): Z'Z, Z'y of one partition, fold by fold."""
    size = FEATURES + 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        lane = 0
        for frame in frames:
            if not len(frame):
                continue
            z, y, fold = fourier(_matrix(frame["ratios"])), frame["y"].to_numpy(float), frame["fold"].to_numpy()
            lane = int(frame["lane"].iloc[0])
            for f in np.unique(fold):
                zf, yf = z[fold == f], y[fold == f]
                part = np.concatenate([zf.T @ zf, (zf.T @ yf)[:, None]], 1)
                sums[int(f)] = sums.get(int(f), np.zeros((size, size + 1))) + part
        if sums:
            yield pd.DataFrame({"fold": list(sums), "lane": lane, "sums": [s.tobytes() for s in sums.values()]})

    return run


def _add_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Add sums of equal fold as they come in; memory holds one sum per fold."""
    sums: dict[int, np.ndarray] = {}
    for frame in frames:
        for fold, raw in zip(frame["fold"], frame["sums"], strict=True):
            part = np.frombuffer(raw)
            sums[int(fold)] = sums[int(fold)] + part if int(fold) in sums else part
    if sums:
        yield pd.DataFrame({"fold": list(sums), "lane": 0, "sums": [s.tobytes() for s in sums.values()]})


def pooled(weight: np.ndarray, total: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit of total/weight over ascending ``at``: neighbours out of order are merged. (centres, levels)."""
    blocks: list[list[float]] = []  # weight, total, weight x place
    for w, t, a in zip(weight, total, at, strict=True):
        blocks.append([w, t, w * a])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    got = np.array(blocks)
    return got[:, 2] / got[:, 0], got[:, 1] / got[:, 0]


def fit(stats: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on every labelled row of ``stats`` (doc_id, ratios) that is not held out; None without two classes."""
    rows = checkpointed(stats.where("doc_id is not null").join(learnable(labels, "quality"), "doc_id").select(
        "ratios", "y", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"),
        F.pmod(F.spark_partition_id(), F.lit(LANES)).alias("lane")))
    moments = rows.agg(
        F.min("y"), F.max("y"), *[f(F.col("ratios")[k]) for k in range(len(RATIOS)) for f in (F.avg, F.stddev_pop)]
    ).first()
    if moments[0] is None or moments[0] == moments[1]:
        return None
    mean, scale = np.array(moments[2::2]), np.maximum(np.array(moments[3::2]), 1e-6)
    fourier = Fourier.draw(mean, scale)
    kind = "fold int, lane int, sums binary"
    sums = (rows.mapInPandas(_partition_sums(fourier), kind).repartition(LANES, "lane").mapInPandas(_add_up, kind))
    by_fold = {f: np.zeros((FEATURES + 1, FEATURES + 2)) for f in range(FOLDS)}
    for fold, _, raw in sums.collect():  # at most LANES x FOLDS rows of fixed size
        by_fold[fold] += np.frombuffer(raw).reshape(FEATURES + 1, FEATURES + 2)
    whole = sum(by_fold.values())

    def solve(s: np.ndarray) -> np.ndarray:
        n = max(s[0, 0], 1.0)
        penalty = RIDGE * n * np.eye(FEATURES + 1) / FEATURES
        penalty[0, 0] = 1e-9
        return np.linalg.solve(s[:, :-1] + penalty, s[:, -1])

    betas = np.stack([solve(whole - by_fold[f]) for f in range(FOLDS)])

    def out_of_fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                raw = (fourier(_matrix(frame["ratios"])) * betas[frame["fold"].to_numpy()]).sum(1)
                place = np.clip((raw + 0.5) * BINS / 2, 0, BINS - 1).astype(int)
                yield pd.DataFrame({"place": place, "y": frame["y"]})

    bins = (rows.mapInPandas(out_of_fold, "place int, y int").groupBy("place")
            .agg(F.count("*").alias("n"), F.sum("y").alias("ones")).orderBy("place").collect())
    knots, levels = pooled(*(np.array([r[k] for r in bins], float) for k in (1, 2)),
                           np.array([(r[0] + 0.5) * 2 / BINS - 0.5 for r in bins]))
    return Model(fourier, solve(whole), knots, levels)


def score(stats: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted for every row of ``stats``; without a model every score is 0.5."""

    @F.pandas_udf("double")
    def calibrated(ratios: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix(ratios)) if model else np.full(len(ratios), 0.5))

    return (stats.select("doc_id", calibrated("ratios").alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= threshold) per row of ``docs``.

    Learns from ``labels`` (doc_id, quality) except held-out ids; an id with several labels has the smallest,
    null labels and null ids are ignored. Null texts count as empty and are scored like any other. Null ids and
    repeated rows of ``docs`` stay. Without labels of both classes every score is 0.5, predicted 0. An empty
    table gives an empty result; other columns are not looked at.
    """
    stats = checkpointed(with_stats(docs, counts=False))
    return score(stats, fit(stats, labels), threshold)


def good_ones(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, that ``classify`` predicts as 1; all rows where there is no model."""
    model = fit(checkpointed(with_stats(docs, counts=False)), labels)
    if model is None:
        return docs

    @F.pandas_udf("boolean")
    def good(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(measure([t or "" for t in text])["ratios"]) >= threshold)

    return docs.where(good("text"))
