"""Models, curves and registered queries."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as registry
from secflow.plans import cti
from secflow.plans import evaluation as ev
from secflow.plans import forest
from secflow.plans import retrieval as rt
from secflow.plans import sequence as sq
from secflow.plans.response import plan, verdicts

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_forest_ranks_an_outlier_first(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))] + [(400, 9.0, -9.0)]
    df = spark.createDataFrame(rows, "event_id bigint, a double, b double")
    scored = forest.score(df, forest.fit(df, ["a", "b"], trees=50), ["a", "b"]).toPandas()
    assert scored.sort_values("forest_score").iloc[-1].event_id == 400
    assert scored.forest_score.between(0, 1).all()


def test_forest_needs_five_rows(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(4)], "event_id bigint, a double")
    assert forest.score(df, forest.fit(df, ["a"]), ["a"]).agg({"forest_score": "max"}).first()[0] == 0.0


def test_percentiles_match_numpy(spark):
    values = np.round(np.random.default_rng(2).random(501), 3)
    df = spark.createDataFrame([(float(v),) for v in values], "score double")
    got = {r.percent: r.threshold for r in ev.percentiles(df, [1.0, 50.0, 97.5, 99.0]).collect()}
    for percent, value in got.items():
        assert value == pytest.approx(np.percentile(values, percent))


def test_sweep_counts(spark):
    df = spark.createDataFrame([(0.1, 0), (0.5, 1), (0.5, 0), (0.9, 1)], "score double, label int")
    got = {r.threshold: (r.tp, r.fp, r.tn, r.fn) for r in ev.sweep(df, spark.createDataFrame([(0.5,), (0.95,)], "threshold double")).collect()}
    assert got == {0.5: (2, 1, 1, 0), 0.95: (0, 0, 2, 2)}


def test_markov_rows_sum_to_one_and_never_go_back(spark):
    lists = spark.createDataFrame([("a", ["execution", "impact"]), ("b", ["discovery", "execution"])], "seq_id string, tactics array<string>")
    probs = sq.transition_probabilities(sq.transition_counts(lists))
    assert all(abs(r.s - 1) < 1e-9 for r in probs.groupBy("origin").agg({"p": "sum"}).withColumnRenamed("sum(p)", "s").collect())
    for r in sq.with_deepest(sq.markov_predictions(lists, probs).drop("deepest")).collect():
        assert all(sq.TACTICS.index(x.tactic) > r.deepest for x in r.predicted)


def test_incidents_follow_the_transitions_and_fall_back_to_the_order(spark):
    from secflow.schema import TACTICS
    lists = spark.createDataFrame([(i, ["execution", "impact"]) for i in range(9)] + [(20, ["execution"]), (21, ["execution"])],
                                  "seq_id bigint, tactics array<string>")
    probabilities = sq.transition_probabilities(sq.transition_counts(lists))
    schema = "incident_id string, entity string, tactics array<string>, deepest bigint, risk bigint, velocity double"
    rows = spark.createDataFrame([("a", "x", ["execution"], 3, 10, 0.0), ("b", "x", ["discovery"], 9, 10, 0.0),
                                  ("c", "x", [TACTICS[-1]], 14, 10, 0.0), ("d", "x", [], -1, 0, 0.0)], schema)
    flagged = spark.createDataFrame([("x", False)], "entity string, cti_confirmed boolean")
    got = {r.incident_id: r for r in sq.incident_predictions(rows, flagged, probabilities).collect()}
    assert set(got) == {"a", "b", "c"}
    p = 9.5 / (11 + 0.5 * 16)
    assert got["a"].model == sq.MODEL and got["a"].predicted[0].tactic == "impact"
    assert got["a"].confidence == pytest.approx(p) and got["a"].p_end == pytest.approx(2.5 / 19)
    assert "stops here" not in got["a"].rationale
    assert got["b"].model == sq.ORDER and got["b"].predicted[0].tactic == "lateral-movement" and got["b"].p_end == 0
    assert got["b"].confidence == pytest.approx(0.75)
    assert got["c"].predicted == [] and "no later phase" in got["c"].rationale
    often = sq.transition_probabilities(sq.transition_counts(lists.where("seq_id >= 20")))
    assert "stops here with" in sq.incident_predictions(rows, flagged, often).where("incident_id = 'a'").first().rationale
    plain = {r.incident_id: r.model for r in sq.incident_predictions(rows, flagged).collect()}
    assert set(plain.values()) == {sq.ORDER}


def test_response_order(spark):
    df = spark.createDataFrame([("i", "h", ["credential-access", "exfiltration"], 80)], "incident_id string, entity string, tactics array<string>, risk int")
    rows = verdicts(plan(df)).orderBy("sort_key").collect()
    assert [r.action for r in rows] == ["enrich_context", "notify_analyst", "disable_account", "reset_password", "block_ip", "isolate_host", "snapshot_evidence"]
    assert [r.decision for r in rows].count("requires_approval") == 4


def test_every_check_belongs_to_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def _plain(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
@pytest.mark.parametrize("name", ["rule_match", "rule_volume", "win_sequence_match", "hybrid_score", "incident_predict", "win_risk_decay",
                                  "norm_dispatch", "ml_pick_youden", "rag_grounded", "stream_risk", "stream_volume_rule", "stream_baseline"])
def test_query_equals_its_check(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = registry.queries()[name](spark, SF)
    check = con.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(check.columns)
    got = sorted(repr([_plain(r[c]) for c in columns]) for r in df.collect())
    places = [check.columns.index(c) for c in columns]
    assert got == sorted(repr([_plain(r[i]) for i in places]) for r in check.fetchall())


def test_latent_vectors_equal_the_svd(spark):
    import numpy as np

    from secflow.plans import retrieval as rt

    rng = np.random.default_rng(4)
    topics = [["alpha", "beta", "gamma"], ["delta", "eps", "zeta"], ["eta", "theta", "iota"]]
    texts = [" ".join(rng.choice(topics[i % 3] + ["common"], 30)) for i in range(60)] + ["", "?"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: np.array(r.vector) for r in rt.latent_vectors(docs, 3, extra=4).collect()}
    weights = rt.tfidf(docs)[0].toPandas().pivot(index="doc_id", columns="term", values="w").fillna(0.0)
    u, s, _ = np.linalg.svd(weights.to_numpy(), full_matrices=False)
    want = u[:, :3] * s[:3]
    mine = np.stack([got[i] for i in weights.index])
    assert np.allclose(mine @ mine.T, want @ want.T, atol=1e-3) and not got[60].any() and not got[61].any()


@pytest.mark.parametrize(("count", "k"), [(3, 5), (120, 2), (0, 3)])
def test_nearest_vectors_equal_all_pairs(spark, count, k):
    rng = np.random.default_rng(5)
    ways = rng.normal(size=(6, 8))
    vec = np.concatenate([ways[rng.integers(0, 6, 300)] + 0.1 * rng.normal(size=(300, 8)), np.zeros((1, 8))]).astype(np.float32)
    vec[100:200] = vec[7]  # a third of all vectors is one
    asked = np.concatenate([vec[rng.integers(0, 300, count)], np.zeros((1, 8), np.float32)])
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vec)], "vec_id bigint, embedding array<float>")
    queries = spark.createDataFrame([(i, [float(x) for x in q]) for i, q in enumerate(asked)], "label int, query array<double>")
    got = {}
    for r in rt.nearest(vectors, queries, k, pivots=7, block=40, asked_at_once=50).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["vec_id"], r["score"]))
    unit = vec[:300].astype(float) / np.linalg.norm(vec[:300].astype(float), axis=1)[:, None]
    assert len(got) == count
    for i, q in enumerate(asked[:count].astype(float)):
        scores = np.round(unit @ (q / np.linalg.norm(q)), 6)
        want = sorted(range(300), key=lambda j: (-scores[j], j))[:k]
        assert [x[1] for x in sorted(got[i])] == want
    assert rt.nearest(vectors.limit(0), queries, k).count() == 0


def test_sums_in_lanes_add_up(spark):
    rows = [(i % 3, np.full(4, float(i)).tobytes()) for i in range(200)]
    df = spark.createDataFrame(rows, "block int, sums binary").repartition(40)
    got = {r["block"]: np.frombuffer(r["sums"])[0] for r in rt.summed(df, lanes=5).collect()}
    assert got == {b: float(sum(i for i in range(200) if i % 3 == b)) for b in range(3)}


def test_a_profile_lists_every_value(spark):
    from helpers import at

    from secflow.plans.behaviour import profiles
    rows = [(at(i // 2) if i else None, "u", "h", f"10.0.0.{i}", f"10.1.0.{i % 60}", f"p{i % 70}.exe") for i in range(120)]
    rows += [(at(500), "v", None, None, None, None), (at(501), None, "g", "10.0.0.1", "10.1.0.1", None)]
    events = spark.createDataFrame(rows, "ts timestamp, user string, host string, src_ip string, dst_ip string, process_name string")
    got = {(r.type, r.entity): r for r in profiles(events).collect()}
    assert len(got) == 4

    def listed(values):
        first = {}
        for ts, value in values:
            key = (ts is None, ts or at(0), value)
            first[value] = min(first.get(value, key), key)
        return sorted(first, key=first.get)

    mine = rows[:120]
    for kind, column in (("user", 3), ("host", 4)):
        r = got[kind, kind[0]]
        assert r.ips == listed((x[0], x[column]) for x in mine) and r.processes == listed((x[0], x[5]) for x in mine)
        assert (r.n_ips, r.n_processes, r.n_events) == (len(r.ips), 70, 120) and len(r.ips) == (120 if kind == "user" else 60)
    assert (got["user", "v"].n_ips, got["user", "v"].n_processes) == (0, 0)
    assert (got["host", "g"].n_ips, got["host", "g"].ips, got["host", "g"].n_processes) == (1, ["10.1.0.1"], 0)


def test_events_are_counted_per_value_before_they_meet_indicators(spark):
    events = spark.createDataFrame([(i, "1.1.1.1" if i % 2 else "2.2.2.2", "1.1.1.1", None) for i in range(40)],
                                   "event_id bigint, src_ip string, dst_ip string, md5 string")
    indicators = spark.createDataFrame([(f"i{j}", "[ipv4-addr:value = '1.1.1.1' OR ipv4-addr:value = '2.2.2.2']", ["c2"], False, None)
                                        for j in range(30)],
                                       "indicator_id string, pattern string, labels array<string>, revoked boolean, valid_until timestamp")
    pairs = cti.cti_hits(events, indicators, "2024-02-01").groupBy("indicator_id").count().collect()
    met = cti.cti_hits(events, indicators, "2024-02-01", counted=True)
    assert met.count() == 60
    got = {r.indicator_id: r.n for r in met.groupBy("indicator_id").agg({"n": "sum"}).toDF("indicator_id", "n").collect()}
    assert got == {r.indicator_id: r["count"] for r in pairs} == {f"i{j}": 60 for j in range(30)}


def test_documents_are_multiplied_in_blocks_of_bounded_size():
    import pyarrow as pa

    sizes = [3, rt.ENTRIES_AT_ONCE + 5, 1, *[rt.ENTRIES_AT_ONCE // 4] * 9, 2]
    at = [list(range(n)) for n in sizes]
    batch = pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int32())), pa.array(
        [[i / 7 for i in x] for x in at], pa.list_(pa.float64()))], ["i", "w"])
    for part, first in ((batch, 0), (batch.slice(2), 2)):
        blocks = list(rt._blocks(part))
        assert [b[0] for b in blocks[1:]] == [b[1] for b in blocks[:-1]] and blocks[-1][1] == len(sizes) - first
        assert all(len(i) <= rt.ENTRIES_AT_ONCE or b - a == 1 for a, b, _, i, _ in blocks)
        basis = np.arange(2.0 * max(sizes)).reshape(-1, 2)
        got = np.concatenate([rt._times(*b[2:], basis) for b in blocks])
        assert np.allclose(got, [(np.arange(n) / 7) @ basis[:n] for n in sizes[first:]])
