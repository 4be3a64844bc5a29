"""Toxicity by a classifier chain.

Categories are predicted one after the other by logistic models on the presence of words and word beginnings.
A later model also sees the probabilities of the earlier categories. While it is trained these are
out-of-fold predictions, so it learns from what it will meet; words are chosen per fold for the same reason.

``labels.toxic`` is the only label. The last category, ``toxic``, is that label. The earlier ones are its weak
sub-categories: labelled toxic and with one of a few fixed seed words. A category without examples is constant.

Scale: learning uses at most ``most_rows`` labelled documents, a documented bound. Their words are counted
inside each partition before they meet. Scoring reads every text once, without a shuffle; the model is a few
hundred weights.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secflow.llm.common import held_out, map_text
from secflow.llm.docstats import training_sample
from secflow.settings import checkpointed

# Seed words of the weak categories, in the order of the chain.
SEEDS = {"insult": {"idiot", "moron", "stupid", "clown", "loser"},
         "contempt": {"trash", "scum", "worthless", "pathetic", "disgusting"}}
CATEGORIES = [*SEEDS, "toxic"]
FOLDS, CHOSEN, LEAST = 3, 256, 2
#: A tenth of the labels are toxic, so a document may be called toxic somewhat below even odds.
THRESHOLD = 0.35
#: Lengths of word beginnings that are features beside the whole word.
BEGINNINGS = (3, 4, 5, 6)
LETTERS = re.compile(r"[^\W\d_]+")
#: Entries of a word cache before it is emptied, and of a task's counts before they are sent on.
MOST_HELD, MOST_COUNTED = 100_000, 40_000


def features(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:n] for n in BEGINNINGS if len(word) >= n)]


def words_of(text: str) -> set[str]:
    return set(LETTERS.findall(text.lower()))


class Known(dict):
    """word -> places of its chosen features, worked out when first seen."""

    def __init__(self, place: dict[str, int]) -> None:
        super().__init__()
        self.place = place

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > MOST_HELD:
            self.clear()
        got = tuple(self.place[f] for f in features(word) if f in self.place)
        self[word] = got
        return got

    def of(self, text: str) -> list[int]:
        return sorted({i for w in words_of(text) for i in self[w]})


@dataclass
class Chain:
    names: list[str]  # of the features
    weights: np.ndarray  # (categories, features + earlier categories)
    base: np.ndarray

    def predict(self, places: list[list[int]]) -> np.ndarray:
        """Probabilities (texts, categories)."""
        n, k = len(self.names), len(self.base)
        out = np.empty((len(places), k))
        for row, at in enumerate(places):
            plain = self.weights[:, at].sum(1) + self.base if at else self.base
            for c in range(k):
                margin = plain[c] + self.weights[c, n:n + c] @ out[row, :c]
                out[row, c] = 1 / (1 + np.exp(-margin))
        return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by accelerated gradient steps; a constant where only one class is seen."""
    share = (y.sum() + 0.5) / (len(y) + 1) if y.any() else 0.5 / (len(y) + 100)
    w, base = np.zeros(x.shape[1], np.float32), float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return w, base
    probe = np.ones(x.shape[1], np.float32)
    for _ in range(12):  # the largest curvature sets the step
        probe = x.T @ (x @ probe)
        size = float(np.linalg.norm(probe)) or 1.0
        probe /= size
    step = 1.0 / (0.25 * (size + len(y)) + ridge)
    ahead, ahead_base, w_old, base_old = w, base, w, base
    for t in range(rounds):
        p = 1 / (1 + np.exp(-(x @ ahead + ahead_base)))
        gap = (p - y).astype(np.float32)
        w = ahead - np.float32(step) * (x.T @ gap + np.float32(ridge) * ahead)
        base = ahead_base - step * float(gap.sum())
        pull = t / (t + 3)
        ahead, ahead_base = w + np.float32(pull) * (w - w_old), base + pull * (base - base_old)
        w_old, base_old = w, base
    return w, base


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(feature, fold, clean, toxic) counts of one partition, sent on when there are many."""
    held: dict[str, list[int]] = defaultdict(lambda: [0] * (2 * FOLDS))

    def emit() -> pd.DataFrame:
        frame = pd.DataFrame(np.array(list(held.values())).reshape(-1, 2 * FOLDS), columns=_COUNTS)
        frame.insert(0, "feature", list(held))
        held.clear()
        return frame

    for frame in frames:
        for text, y, fold in zip(frame["text"], frame["y"], frame["fold"], strict=True):
            for f in {f for w in words_of(text or "") for f in features(w)}:
                held[f][2 * fold + y] += 1
            if len(held) > MOST_COUNTED:
                yield emit()
    if held:
        yield emit()


_COUNTS = [f"{kind}{fold}" for fold in range(FOLDS) for kind in ("clean", "toxic")]


def _choose(rows: DataFrame) -> dict[str, list[bool]]:
    """feature -> which of the fits (without fold 0, 1, ..., on all) may use it: the best by chi-square in each.

    A longer beginning or a whole word is left out where its own beginning is at least as sure a sign, since
    that one covers more texts; so a few frequent words do not fill the list with their parts.
    """
    sizes = {(r["fold"], r["y"]): r["n"] for r in rows.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
    counts = checkpointed(rows.mapInPandas(_counted, "feature string, " + ", ".join(f"{c} long" for c in _COUNTS))
                          .groupBy("feature").agg(*[F.sum(c).alias(c) for c in _COUNTS])
                          .where(sum(F.col(f"toxic{f}") for f in range(FOLDS)) >= LEAST))
    word = F.col("feature").startswith("=")
    shorter = F.when(word, F.concat(F.lit("^"), F.substring("feature", 2, BEGINNINGS[-1]))).otherwise(
        F.substr("feature", F.lit(1), F.length("feature") - 1))
    parents = counts.select(F.col("feature").alias("shorter"), *[F.col(c).alias(f"{c}_of_shorter") for c in _COUNTS])
    pairs = checkpointed(counts.withColumn("shorter", shorter).join(parents, "shorter", "left"))
    best = []
    for left_out in range(FOLDS + 1):
        folds = [f for f in range(FOLDS) if f != left_out]
        toxic, clean = (float(sum(sizes.get((f, y), 0) for f in folds)) for y in (1, 0))

        def total(name: str, folds: list[int] = folds) -> Column:
            return sum((F.col(name.format(f)) for f in folds), F.lit(0)).cast("double")

        a, b = total("toxic{}"), total("clean{}")
        above_a, above_b = total("toxic{}_of_shorter"), total("clean{}_of_shorter")
        n = toxic + clean
        spread = (a + b) * (F.lit(n) - a - b)
        gain = F.when((spread > 0) & (a * clean > b * toxic), (a * clean - b * toxic) ** 2 * n / spread)
        surer = above_a.isNull() | (a * (above_a + above_b) > above_a * (a + b))
        best.append(pairs.where((a >= LEAST) & surer)
                    .select("feature", F.lit(left_out).alias("fit"), gain.alias("gain"))
                    .where("gain is not null").orderBy(F.desc("gain"), "feature").limit(CHOSEN)
                    .select("feature", "fit"))
    chosen: dict[str, list[bool]] = {}
    for feature, fit_ in reduce(DataFrame.union, best).collect():  # at most CHOSEN for each fit
        chosen.setdefault(feature, [False] * (FOLDS + 1))[fit_] = True
    return dict(sorted(chosen.items()))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 8000) -> Chain:
    """Train the chain on at most ``most_rows`` labelled documents, held-out ids excluded."""
    sample = training_sample(docs.select("doc_id", "text"), labels, "toxic", most_rows)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(FOLDS)).cast("int").alias("fold")
    rows = checkpointed(sample.select("doc_id", "text", (F.col("y") > 0).cast("int").alias("y"), fold))
    chosen = _choose(rows)
    names, may_use = list(chosen), np.array(list(chosen.values()), bool).reshape(-1, FOLDS + 1)

    def present(texts: list[str]) -> dict[str, list]:
        known = Known({f: i for i, f in enumerate(names)})
        return {"at": [known.of(t) for t in texts],
                "seeds": [[not s.isdisjoint(words_of(t)) for s in SEEDS.values()] for t in texts]}

    got = map_text(rows, "text", present, "at array<int>, seeds array<boolean>",
                   {"doc_id": "long", "y": "int", "fold": "int"}).orderBy("doc_id").collect()
    n, k = len(names), len(CATEGORIES)
    x = np.zeros((len(got), n + k), np.float32)
    y = np.zeros((len(got), k), np.float32)
    folds = np.array([r["fold"] for r in got], int)
    for i, r in enumerate(got):
        x[i, r["at"]] = 1
        y[i] = [r["y"] and s for s in [*r["seeds"], True]]
    weights, base = np.zeros((k, n + k), np.float64), np.zeros(k)
    for c in range(k):
        for f in range(FOLDS + 1):
            use = np.flatnonzero(np.r_[may_use[:, f] if n else np.zeros(0, bool), np.arange(k) < c])
            train = folds != f
            w, b = logistic(np.ascontiguousarray(x[np.ix_(train, use)]), y[train, c])
            if f < FOLDS:  # what later categories see of this one
                out = ~train
                x[out, n + c] = 1 / (1 + np.exp(-(x[np.ix_(out, use)] @ w + b)))
            else:
                weights[c, use], base[c] = w, b
    return Chain(names, weights, base)


def rate(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, p_<category> for each category but the last, toxic_score, toxic_predicted per row.

    toxic_predicted: toxic_score >= threshold. Null and empty texts are scored as texts without words. Without
    toxic labels every score is small and no document is toxic. Null ids (never held out)
    and repeated rows stay; an empty table gives an empty result; other columns are not looked at.
    """

    def run(texts: list[str]) -> dict[str, list]:
        known = _known(tuple(chain.names))
        p = chain.predict([known.of(t) for t in texts])
        return ({f"p_{name}": p[:, c] for c, name in enumerate(CATEGORIES[:-1])}
                | {"toxic_score": p[:, -1], "toxic_predicted": p[:, -1] >= threshold})

    schema = ", ".join([*(f"p_{n} double" for n in CATEGORIES[:-1]), "toxic_score double", "toxic_predicted boolean"])
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rated = map_text(kept, "text", run, schema, {"doc_id": "long"})
    return rated.select("doc_id", held_out().alias("held_out"), *rated.columns[1:])


def without_toxic(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose toxic_score is below ``threshold``."""

    @F.pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        known = _known(tuple(chain.names))
        return pd.Series(chain.predict([known.of(t or "") for t in text])[:, -1] < threshold)

    return docs.where(clean("text"))


_last: list = []


def _known(names: tuple[str, ...]) -> Known:
    """The word cache of this worker, kept while the model stays the same."""
    if not _last or _last[0] != names:
        _last[:] = [names, Known({f: i for i, f in enumerate(names)})]
    return _last[1]
