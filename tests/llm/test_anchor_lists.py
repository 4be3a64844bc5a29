from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from secflow.llm import anchor_lists
from secflow.llm.registry import section

SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(row: tuple) -> bool:
    _, vec, label = row
    return label is not None and vec is not None and all(x is not None and math.isfinite(x) for x in vec)


def brute(data: list[tuple], every: int, k: int = 5, low: int = 80, high: int = 100) -> list[tuple]:
    rows = [(i, v, [math.floor(256 * float(np.float32(x))) for x in vec], label)
            for i, (v, vec, label) in enumerate(data) if usable((v, vec, label))]
    out = []
    for i, vec_id, vec, label in rows:
        if vec_id is None or vec_id % every:
            continue
        scored = sorted((-sum(map(int.__mul__, vec, w)), u is None, u or 0, j, u, m) for j, u, w, m in rows
                        if j != i and len(w) == len(vec))
        for p in [s for s in scored if s[5] == label][:k]:
            hard = [s for s in scored if s[5] != label and low * -p[0] <= 100 * -s[0] <= high * -p[0]][:k]
            out += [(vec_id, p[4], at + 1, s[4], -p[0], -s[0]) for at, s in enumerate(hard)]
    return out


def as_key(row: tuple) -> tuple:
    return tuple((x is None, x or 0) for x in row)


def same(got, expected: list[tuple]) -> None:  # noqa: ANN001
    assert sorted((tuple(r) for r in got.collect()), key=as_key) == sorted(expected, key=as_key)


def vectors(seed: int, n: int, size: int = 6) -> list[tuple]:
    rng = random.Random(seed)
    ways = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(4)]
    out = []
    for i in range(n):
        way = rng.choice(ways)
        out.append((i, [x + rng.gauss(0, 0.3) for x in way], rng.randrange(4)))
    hot = out[10][1]  # a third of all rows is one vector
    out += [(n + i, hot, i % 3) for i in range(n // 2)]
    return out


ODD = [(5000, None, 1), (5010, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (5020, [math.nan] * 6, 1), (5030, [math.inf] * 6, 2),
       (5040, [0.5] * 6, None), (None, [0.5] * 6, 1), (None, [0.5] * 6, 2), (5050, [0.0] * 6, 1), (5060, [0.0] * 6, 2),
       (5070, [], 1), (5080, [], 2), (5090, [0.5, 0.25], 1), (5100, [0.5, 0.25], 2), (5110, [1.0] * 3000, 1),
       (5120, [1.0] * 3000, 2), (5130, [-0.5] * 6, 3), (5140, [30000.0] * 6, 1), (5150, [29000.0] * 6, 2)]


@pytest.mark.parametrize("values", [1 << 22, 3000])
def test_negatives_equal_brute_force_in_one_block_and_in_many(spark, values):
    data = vectors(1, 150) + ODD + [vectors(1, 150)[20]] * 2
    rows = spark.createDataFrame(data, SCHEMA).select("*", F.lit("x").alias("row"), F.lit(1).alias("vec"),
                                                      F.lit(2).alias("is_anchor"), F.lit(0).alias("rank"))
    same(anchor_lists.mine(rows, "vec_id % 10 = 0", values=values), brute(data, 10))


def test_few_rows_other_limits_and_empty_tables(spark):
    data = vectors(2, 60)
    rows = spark.createDataFrame(data, SCHEMA)
    same(anchor_lists.mine(rows, "vec_id % 20 = 0", positives=2, negatives=3, low=50, high=90),
         [r for r in brute_limited(data)])
    assert anchor_lists.mine(rows.limit(0), "vec_id % 10 = 0").count() == 0
    assert anchor_lists.mine(rows, "false").count() == 0
    assert anchor_lists.mine(rows.where("label = 1"), "true").count() == 0
    assert anchor_lists.mine(rows.limit(1), "true").count() == 0


def brute_limited(data: list[tuple]) -> list[tuple]:
    from itertools import groupby

    whole = brute_with(data, 20, 2, 3, 50, 90)
    assert all(len(list(g)) <= 3 for _, g in groupby(whole, key=lambda r: r[:2]))
    return whole


def brute_with(data: list[tuple], every: int, positives: int, negatives: int, low: int, high: int) -> list[tuple]:
    pairs = {}
    for row in brute(data, every, 10_000, low, high):
        pairs.setdefault(row[:2], []).append(row)
    rows = [(i, v, [math.floor(256 * float(np.float32(x))) for x in vec], label) for i, (v, vec, label) in enumerate(data)]
    out = []
    for i, vec_id, vec, label in rows:
        if vec_id % every:
            continue
        best = sorted((-sum(map(int.__mul__, vec, w)), u, j) for j, u, w, m in rows if j != i and m == label)
        for _, u, _ in best[:positives]:
            out += [r for r in pairs.get((vec_id, u), []) if r[2] <= negatives]
    return out


def test_the_bound_holds_and_lets_members_stop():
    rng = np.random.default_rng(5)
    ways = rng.normal(size=(8, 16)) * 300
    vec = np.floor(ways[rng.integers(0, 8, 4000)] + rng.normal(size=(4000, 16)) * 20).astype(np.int64)
    rows = anchor_lists.Rows(vec, np.zeros(4000, np.int64), np.arange(4000), np.arange(4000))
    anchors = anchor_lists.Rows(*(x[:64] for x in (rows.vectors, rows.labels, rows.ids, rows.rows)))
    groups = anchor_lists.clusters(anchors)
    assert sorted(np.concatenate([g.members for g in groups]).tolist()) == list(range(64))
    best = anchor_lists.Best(5, np.full(64, anchor_lists.NEVER + 1))
    looked = anchor_lists.walk(anchors, groups, rows, lambda active: best.least[active], lambda scores, active, step:
                               best.add(scores, active, rows.ids[step], rows.rows[step]))
    scores = anchors.vectors @ vec.T
    expected = np.sort(scores, 1)[:, ::-1][:, :5]
    assert (np.sort(best.held[1].reshape(64, 5), 1)[:, ::-1] == expected).all()
    assert looked < 64 * 4000 / 3
    for g in groups:
        turn = np.maximum(0, anchor_lists.angles(rows.units, g.centre) - g.spread)
        bound = rows.norms * (np.cos(turn) + anchor_lists.SLACK)
        assert (scores[g.members] <= anchors.norms[g.members][:, None] * bound + 0.5).all()


def test_large_components_are_exact(spark):
    rng = random.Random(3)
    data = [(i, [float(np.float32(rng.choice([-1, 1]) * rng.uniform(1e6, 2e6))) for _ in range(4)], i % 2)
            for i in range(60)]
    same(anchor_lists.mine(spark.createDataFrame(data, SCHEMA), "vec_id % 10 = 0"), brute(data, 10))


def test_query_equals_its_sql(spark, tmp_path):
    data = [r for r in vectors(7, 400) + ODD if r[0] is not None]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = section.queries["op11_hard_negatives"](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    expected = db.execute(section.checks["op11_hard_negatives"]).fetchall()
    assert expected and got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                                        "negative_score"]
    same(got, expected)
