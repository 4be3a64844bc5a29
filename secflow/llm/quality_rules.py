"""Quality rules: fixed limits first, then gradient-boosted trees over statistics of the text.

The trees are grown on a bounded sample of labelled rows (``most_rows``) by histograms of binned statistics
with logistic loss. Chosen statistics carry a monotonic constraint: more symbols, repeated lines, repeated
words or capitals can never raise a score, more distinct words never lower it. All trees are complete binary
trees in three flat arrays, so a batch is scored by ``depth`` gathers over (rows x trees).

Scale: one pass over the texts without a shuffle; the model is a few kilobytes in the closure.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secflow.llm.common import map_text
from secflow.llm.docstats import COUNTS, RATIOS, measure, training_sample, with_stats

#: Direction that a statistic may move the score in.
MONOTONE = {"symbols": -1, "upper": -1, "dup_lines": -1, "repeats": -1, "distinct": 1}
MIN_WORDS, MOST_REPEATED = 50, 50


@dataclass
class Forest:
    """Complete trees: node i has the children 2i+1 (at or below the cut) and 2i+2."""

    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray
    value: np.ndarray  # (trees, leaves)
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        node = np.zeros((len(x), trees), np.int64)
        at, row = np.arange(trees), np.arange(len(x))[:, None]
        for _ in range((inner + 1).bit_length() - 1):
            node = 2 * node + 1 + (x[row, self.feature[at, node]] > self.cut[at, node])
        return self.base + self.value[at, node - inner].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def _split(g: np.ndarray, h: np.ndarray, signs: np.ndarray, low: float, high: float, l2: float, least: float):
    """Best (gain, feature, bin, left value, right value) of one node from its histograms (feature, bin)."""
    gl, hl = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
    gt, ht = g[0].sum(), h[0].sum()
    gr, hr = gt - gl, ht - hl
    left, right = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
    whole = np.clip(-gt / (ht + l2), low, high)

    def loss(gs, hs, v):
        return gs * v + 0.5 * (hs + l2) * v * v

    gain = loss(gt, ht, whole) - loss(gl, hl, left) - loss(gr, hr, right)
    allowed = (hl >= least) & (hr >= least) & (signs[:, None] * (right - left) >= 0)
    gain = np.where(allowed, gain, -np.inf)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return gain[f, b], f, b, left[f, b], right[f, b], whole


def grow(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 50, depth: int = 3, rate: float = 0.2,
         bins: int = 48, l2: float = 1.0, least: float = 1.0) -> Forest | None:
    """Boosted trees for the chance of ``y`` = 1; None if there are not two classes to tell apart."""
    if len(y) == 0 or y.min() == y.max():
        return None
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1)
    inner, n_features = (1 << depth) - 1, x.shape[1]
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), base)
    feature, cut = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    value = np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        bounds = {0: (-np.inf, np.inf)}
        for i in range(inner):
            low, high = bounds[i]
            at = node == i
            middle = (low, high)
            if at.any():
                flat = (binned[at] + np.arange(n_features) * bins).ravel()
                hist = [np.bincount(flat, np.repeat(w[at], n_features), n_features * bins).reshape(n_features, bins)
                        for w in (g, h)]
                gain, f, b, left, right, _ = _split(*hist, signs, low, high, l2, least)
                if gain > 1e-9 and b < len(edges[f]):
                    feature[t, i], cut[t, i] = f, edges[f][b]
                    mid = (left + right) / 2
                    middle = (mid, mid) if signs[f] else middle
                    node[at] = 2 * i + 1 + (binned[at, f] > b)
                    sign = signs[f]
                    bounds[2 * i + 1] = (low, middle[0]) if sign > 0 else (middle[0], high) if sign < 0 else (low, high)
                    bounds[2 * i + 2] = (middle[1], high) if sign > 0 else (low, middle[1]) if sign < 0 else (low, high)
                    continue
            node[at] = 2 * i + 1
            bounds[2 * i + 1] = bounds[2 * i + 2] = (low, high)
        for leaf in range(inner + 1):
            at = node == inner + leaf
            low, high = bounds[inner + leaf]
            if at.any():
                value[t, leaf] = rate * np.clip(-g[at].sum() / (h[at].sum() + l2), low, high)
            else:
                value[t, leaf] = rate * np.clip(0.0, low, high)
        margin += value[t, node - inner]
    return Forest(feature, cut, value, base)


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> Forest | None:
    """Grow the trees on ``labels.quality`` of at most ``most_rows`` labelled documents, held-out ids excluded."""
    few = training_sample(docs.select("doc_id", "text"), labels, "quality", most_rows)
    got = with_stats(few, extra={"y": "int"}, counts=False).orderBy("doc_id").collect()
    x = np.array([r["ratios"] for r in got]).reshape(-1, len(RATIOS))
    return grow(x, np.array([r["y"] for r in got], float), np.array([MONOTONE.get(n, 0) for n in RATIOS]))


def judge(docs: DataFrame, forest: Forest | None, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score per row.

    base_failed: fewer than 50 words, or more than half of the words in repeated 3-word windows. kept: not
    base_failed and a score of at least ``threshold``; without a model (no labels of both kinds) every
    document that passes the limits is kept and its score is null. Null texts count as empty: no words, base_failed.
    Null ids and repeated rows stay; an empty table gives an empty result; other columns are not looked at.
    """

    def run(texts: list[str]) -> dict[str, list]:
        got = measure(texts)
        failed = (got["n_words"] < MIN_WORDS) | (100 * got["n_repeat_words"] > MOST_REPEATED * got["n_words"])
        score = forest.probability(got["ratios"]) if forest else np.ones(len(texts))
        return {n: got[n] for n in COUNTS} | {
            "base_failed": failed, "kept": ~failed & (score >= threshold),
            "score": list(score) if forest else [None] * len(texts)}

    schema = ", ".join([*(f"{n} long" for n in COUNTS), "base_failed boolean", "kept boolean", "score double"])
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_text(kept, "text", run, schema, {"doc_id": "long"})
