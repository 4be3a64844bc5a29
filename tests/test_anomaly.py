"""The stored anomaly model: versions, scores against a plain walk through the trees, and its weight in the score."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from helpers import at

from secflow.plans import anomaly
from secflow.plans import features as ft
from secflow.plans import forest
from secflow.plans import scoring as sc


@pytest.fixture
def events(spark):
    rng = random.Random(4)
    rows = [(i, at(i * 7), f"h{rng.randrange(3)}", f"u{rng.randrange(4)}", f"10.0.0.{rng.randrange(9)}", "10.1.0.1",
             rng.choice([80, 443, 9999]), rng.randrange(9000), rng.randrange(900), rng.choice(["cmd a", "dir", None]),
             "p.exe", None, None, rng.choice(["process", "network"]), "act", 0) for i in range(120)]
    rows.append((500, at(10 ** 5), "odd", "odd", "9.9.9.9", "8.8.8.8", 31337, 10 ** 9, 5, "x" * 900 + "$%&/()", "q.exe", "y", "z",
                 "network", "act", 1))
    return spark.createDataFrame(rows, (
        "event_id bigint, ts timestamp, host string, user string, src_ip string, dst_ip string, dst_port int, bytes_out bigint, "
        "bytes_in bigint, command_line string, process_name string, md5 string, parent_process string, category string, "
        "action string, label int"))


def plain_scores(model: dict, rows: list[dict], names: list[str]) -> dict[int, float]:
    """Every event alone, tree by tree."""
    scale = {r.feature: (r.mean, r.scale) for r in model["scaler"].collect()}
    nodes = {(r.tree, r.node): r for r in model["nodes"].collect()}
    trees = sorted({t for t, _ in nodes})
    expected = model["about"].first()["expected"]
    out = {}
    for row in rows:
        x = [(row[n] - scale[n][0]) / scale[n][1] for n in names]
        total = 0.0
        for tree in trees:
            at_node = nodes[tree, 0]
            while at_node.feature >= 0:
                at_node = nodes[tree, at_node.low if x[at_node.feature] < at_node.cut else at_node.high]
            total += at_node.depth
        out[row["event_id"]] = 2.0 ** (-total / len(trees) / expected)
    return out


def test_scores_equal_a_plain_walk_and_versions_stay(spark, events, tmp_path):
    folder = str(tmp_path / "model")
    assert anomaly.versions(spark, folder) == []
    assert anomaly.fit(events, "label = 0", folder, trees=20) == 1
    model = anomaly.load(spark, folder)
    got = {r.event_id: r.anomaly_score for r in anomaly.scores(events, model).collect()}
    train = events.where("label = 0")
    rows = [r.asDict() for r in ft.features(events, train, anomaly.WINDOW).collect()]
    expected = plain_scores(model, rows, list(model["about"].first()["features"]))
    assert got.keys() == expected.keys() and np.allclose([got[i] for i in sorted(got)], [expected[i] for i in sorted(got)])
    assert got[500] > np.quantile(list(got.values()), 0.75)
    assert anomaly.fit(events, "label = 0", folder, trees=5, seed=7) == 2
    assert anomaly.versions(spark, folder) == [1, 2] and anomaly.load(spark, folder, 1)["nodes"].count() == model["nodes"].count()
    with pytest.raises(ValueError, match="no version"):
        anomaly.load(spark, folder, 9)


def test_the_combined_score_changes_with_the_forest(spark, events, tmp_path):
    none = spark.createDataFrame([], "event_id bigint")
    rules = none.selectExpr("event_id", "0L as n_rules", "'' as rules", "'' as techniques", "'' as tactics", "'' as rule_title")
    signals = (rules, none.selectExpr("event_id", "'' as sequences"), none.selectExpr("event_id", "0D as behaviour_score"),
               none.selectExpr("event_id", "0D as cti_points", "0L as n_cti", "false as cti_campaign"),
               none.selectExpr("event_id", "0D as reputation_points", "false as reputation_campaign"))
    found = []
    for seed in (1, 2):
        folder = str(tmp_path / f"m{seed}")
        anomaly.fit(events, "label = 0", folder, trees=10, seed=seed)
        scored = anomaly.with_scores(events.selectExpr("*", "'a' as attack_cat", "5D as anomaly_score"), anomaly.load(spark, folder))
        rows = sc.evidence(scored, *signals).where("event_id = 500").first()
        assert rows.hybrid_score == pytest.approx(max(0.0, (rows.anomaly_score - 0.602) * 40)) and rows.anomaly_score < 1
        found.append(rows.hybrid_score)
    assert found[0] != found[1]


def test_too_few_rows_score_nothing(spark, events, tmp_path):
    anomaly.fit(events.limit(3), "true", str(tmp_path / "few"))
    assert anomaly.scores(events, anomaly.load(spark, str(tmp_path / "few"))).agg({"anomaly_score": "max"}).first()[0] == 0


def test_all_rows_of_a_block_walk_the_trees_as_single_rows_do():
    rng = np.random.default_rng(6)
    nodes = pd.DataFrame([  # a deep tree, a tree that is one leaf, and one with two leaves
        (0, 0, 1, 0.5, 1, 4, 0.0), (0, 1, 0, -0.2, 2, 3, 1.0), (0, 2, -1, 0.0, -1, -1, 2.5), (0, 3, -1, 0.0, -1, -1, 2.0),
        (0, 4, -1, 0.0, -1, -1, 1.0), (1, 0, -1, 0.0, -1, -1, 3.0), (2, 0, 0, 0.1, 1, 2, 0.0), (2, 1, -1, 0.0, -1, -1, 1.25),
        (2, 2, -1, 0.0, -1, -1, 1.75)], columns=["tree", "node", "feature", "cut", "low", "high", "depth"])
    x = rng.normal(size=(50, 2))
    x[3, 0], x[4, 1] = np.nan, np.nan
    packed = forest._packed(nodes)
    assert packed["steps"].tolist() == [2, 0, 1]
    table = {(int(t), int(n)): r for t, n, *r in nodes.itertuples(index=False)}

    def walk(row, tree):  # noqa: ANN001, ANN202
        f, cut, low, high, depth = table[tree, 0]
        while f >= 0:
            f, cut, low, high, depth = table[tree, int(low if row[int(f)] < cut else high)]
        return depth

    assert forest._depths(packed, x).tolist() == [sum(walk(row, t) for t in range(3)) for row in x]


def test_ablation_scores_each_row_once_for_a_forest(spark):
    import __spark_entry__ as registry

    got = registry.queries()["ml_feature_ablation"](spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "parquet" not in plan
    assert sorted(r.features for r in got.collect()) == ["all", "without_time"]
