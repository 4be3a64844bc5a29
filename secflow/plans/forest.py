"""Isolation forest (Liu, Ting and Zhou, 2008): trees grow in parallel, scoring is vectorised."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TREES = 200
SAMPLE = 256
MIN_ROWS = 5
#: Rows that walk through a tree together; their values and positions stay in a core's cache.
ROWS_AT_ONCE = 4096
NODE = "tree int, node int, feature int, cut double, low int, high int, depth double"


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + 0.5772156649) - 2.0 * (n - 1.0) / n


def tree_samples(train: DataFrame, n: int, key: str, trees: int, sample: int, seed: int) -> DataFrame:
    """Rows for each tree by a portable hash, about twice the sample size per tree.

    Only that many rows travel: a large table is thinned on the map side; in a small one a row may
    serve several trees.
    """
    wanted = trees * sample * 2
    copies = max(1, min(trees, -(-wanted // max(n, 1))))
    rate = min(1.0, wanted / max(n * copies, 1))
    rows = train.selectExpr("*", f"explode(sequence(1, {copies})) as _copy").withColumn(
        "_h", F.expr(f"md5(cast(concat('{seed}-', _copy, '-', {key}) as binary))"))
    kept = rows.where(f"cast(conv(substr(_h, 1, 7), 16, 10) as bigint) % 1000000 < {int(rate * 1_000_000)}")
    return kept.withColumn("tree", F.expr(f"cast(cast(conv(substr(_h, 8, 7), 16, 10) as bigint) % {trees} as int)"))


def fit(train: DataFrame, names: list[str], key: str = "event_id", trees: int = TREES, sample: int = SAMPLE,
        seed: int = 42) -> tuple[pd.DataFrame, float]:
    """Node table of the forest (at most trees * 2 * sample rows, whatever the data size)."""
    n = train.count()
    if n < MIN_ROWS:
        return pd.DataFrame(columns=["tree", "node", "feature", "cut", "low", "high", "depth"]), 0.0
    drawn = tree_samples(train, n, key, trees, sample, seed)
    size = min(sample, n)
    deepest = int(np.ceil(np.log2(max(size, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values("_h").drop_duplicates(key).head(sample)
        x = pdf[names].to_numpy(dtype=float)
        rng = np.random.default_rng(seed * 1000 + tree)
        nodes: list[list] = []
        todo = [(np.arange(len(x)), 0, None)]
        while todo:
            rows, depth, parent = todo.pop()
            me = len(nodes)
            if parent is not None:
                nodes[parent[0]][parent[1]] = me
            low, high = x[rows].min(axis=0), x[rows].max(axis=0)
            usable = np.flatnonzero(high > low)
            if depth >= deepest or len(rows) <= 1 or len(usable) == 0:
                nodes.append([tree, me, -1, 0.0, -1, -1, depth + average_path(len(rows))])
                continue
            f = int(rng.choice(usable))
            cut = float(rng.uniform(low[f], high[f]))
            nodes.append([tree, me, f, cut, -1, -1, float(depth)])
            left = x[rows, f] < cut
            if not left.any():  # the draw fell on the lower end
                cut = float(high[f])
                left = x[rows, f] < cut
            todo.append((rows[~left], depth + 1, (me, 5)))
            todo.append((rows[left], depth + 1, (me, 4)))
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "low", "high", "depth"])

    forest = drawn.select("tree", "_h", key, *names).groupBy("tree").applyInPandas(grow, NODE).toPandas()
    return forest.sort_values(["tree", "node"]).reset_index(drop=True), average_path(size)


def score(rows: DataFrame, model: tuple[pd.DataFrame, float], names: list[str]) -> DataFrame:
    """Add ``forest_score`` = 2^(-mean depth / expected depth), in 0..1; an unfitted forest gives 0."""
    forest, expected = model
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", forest_score double"
    if forest.empty or expected == 0:
        return rows.withColumn("forest_score", F.lit(0.0))
    packed = _packed(forest)
    shared = rows.sparkSession.sparkContext.broadcast(packed)

    def run(batches):
        m = shared.value
        for pdf in batches:
            x = pdf[names].to_numpy(dtype=float)
            total = np.concatenate([_depths(m, x[a:a + ROWS_AT_ONCE]) for a in range(0, max(len(x), 1), ROWS_AT_ONCE)])
            yield pdf.assign(forest_score=np.power(2.0, -total / len(m["roots"]) / expected))

    return rows.mapInPandas(run, ddl)


def _packed(forest: pd.DataFrame) -> dict:
    """All trees in one set of arrays; child numbers become positions, and a leaf is its own child on both sides."""
    base = forest.groupby("tree")["node"].transform("size").groupby(forest["tree"]).first().cumsum().shift(fill_value=0)
    offset = forest["tree"].map(base).to_numpy()
    leaf, here = forest["feature"].to_numpy() < 0, np.arange(len(forest))
    low, high = (np.where(leaf, here, forest[side].to_numpy() + offset) for side in ("low", "high"))
    roots = base.to_numpy().astype(np.intp)
    # Steps from the root to the deepest leaf of each tree.
    steps, at = np.zeros(len(roots), dtype=int), [(roots, np.arange(len(roots)))]
    while at:
        nodes, of = at.pop()
        inner = ~leaf[nodes]
        nodes, of = nodes[inner], of[inner]
        if len(nodes):
            steps[np.unique(of)] += 1
            at.append((np.concatenate([low[nodes], high[nodes]]), np.concatenate([of, of])))
    return {"roots": roots, "steps": steps, "feature": np.where(leaf, 0, forest["feature"].to_numpy()).astype(np.intp),
            "cut": forest["cut"].to_numpy(dtype=float), "child": np.stack([high, low], axis=1).ravel().astype(np.intp),
            "depth": forest["depth"].to_numpy(dtype=float)}


def _depths(m: dict, x: np.ndarray) -> np.ndarray:
    """Sum over the trees of the depths that the rows end at; a missing value goes to the high side."""
    n = len(x)
    columns, row = np.ascontiguousarray(x.T).ravel(), np.arange(n)
    total = np.zeros(n)
    for root, steps in zip(m["roots"], m["steps"], strict=True):
        at = np.full(n, root)
        for _ in range(steps):
            value = columns.take(m["feature"].take(at) * n + row)
            at = m["child"].take(2 * at + (value < m["cut"].take(at)))
        total += m["depth"].take(at)
    return total
