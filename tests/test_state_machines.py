"""Order-dependent rules against the loops they stand for, with tiny blocks."""

from __future__ import annotations

import random

import pytest
from helpers import at, by_key, random_rows
from pyspark.sql import functions as F

from secflow.operators import blocks
from secflow.plans import audit, operations, risk
from secflow.plans.detection import sequence_hits, volume_hits

BLOCKS = [3, 8, None]


@pytest.mark.parametrize("block", BLOCKS)
@pytest.mark.parametrize("count", [2, 3, 5])
def test_volume_rule(spark, block, count):
    rows = random_rows(count, 160)
    hits = {(r.event_id, tuple(r.related)) for r in volume_hits(
        spark.createDataFrame(rows, "event_id bigint, ts timestamp, key string"), ["key"], count, 240, block=block).collect()}
    want = set()
    for group in by_key(rows).values():
        window = []
        for row in group:
            window = [w for w in window if (row[1] - w[1]).total_seconds() <= 240] + [row]
            if len(window) >= count:
                want.add((row[0], tuple(w[0] for w in window[:-1])))
                window = []
    assert hits == want and want


@pytest.mark.parametrize("block", BLOCKS)
@pytest.mark.parametrize("chunk", ["600", "86400"])
def test_sequences(spark, block, chunk):
    spark.conf.set("secflow.chunk.seconds", chunk)
    rng = random.Random(9)
    rows = [(i, ts, key, rng.choice("AABCX"), f"r{i}", 0.5 + rng.random() / 4) for i, ts, key in random_rows(9, 250)]
    frame = spark.createDataFrame(rows, "event_id bigint, ts timestamp, host string, technique string, rule_id string, confidence double")
    patterns = {"abc": (("A", "B", "C"), 1800), "ab": (("A", "B"), 600)}
    got = {(r.sequence, tuple(r.members), round(r.confidence, 9)) for r in sequence_hits(frame, patterns, block=block).collect()}
    spark.conf.unset("secflow.chunk.seconds")
    want = set()
    for name, (pattern, seconds) in patterns.items():
        for group in by_key(rows).values():
            chain = []
            for row in group:
                if chain and (row[1] - chain[0][1]).total_seconds() > seconds:
                    chain = []
                if row[3] == pattern[len(chain)]:
                    chain.append(row)
                    if len(chain) == len(pattern):
                        sure = min(1.0, sum(c[5] for c in chain) / len(chain) + 0.2)
                        want.add((name, tuple(c[0] for c in chain), round(sure, 9)))
                        chain = []
    assert got == want and want


def test_sequence_starts_at_the_first_element_and_is_not_restarted(spark):
    rows = [(0, at(0), "h", "A"), (1, at(25), "h", "A"), (2, at(40), "h", "B")]
    frame = spark.createDataFrame(rows, "event_id bigint, ts timestamp, host string, technique string").withColumns(
        {"rule_id": F.lit("r"), "confidence": F.lit(0.6)})
    assert sequence_hits(frame, {"ab": (("A", "B"), 1800)}).count() == 0
    assert sequence_hits(frame, {"ab": (("A", "B"), 2400)}).count() == 1


@pytest.mark.parametrize("block", BLOCKS)
def test_risk(spark, block):
    rng = random.Random(4)
    rows = [(i, ts, key, float(rng.choice([0, 0, 40, 90, 100])), rng.random() < 0.05) for i, ts, key in random_rows(4, 150)]
    frame = spark.createDataFrame(rows, "event_id bigint, ts timestamp, entity string, hybrid_score double, cti_confirmed boolean")
    got = {r.event_id: (r.previous, r.score) for r in risk.risk_history(frame, block=block).collect()}
    for group in by_key(rows).values():
        score, last = 0.0, None
        for row in group:
            if row[3] == 0:  # no part of the history
                assert row[0] not in got
                continue
            before = score
            hours = 0 if last is None else (row[1] - last).total_seconds() / 3600
            score = min(100.0, max(0.0, score - 5 * hours) + max(row[3] / 3, 60.0 if row[4] else 0.0))
            last = row[1]
            assert got[row[0]] == pytest.approx((before, score))


@pytest.mark.parametrize("block", BLOCKS)
def test_lifecycle(spark, block):
    rng = random.Random(5)
    rows = [(inc, seq, rng.choice([*operations.STATES, None, "archived"]), rng.choice(["benign", "nonsense", None]),
             rng.choice([None, "ana"]), rng.choice([None, None, "high", "urgent"]))
            for inc in (1, 2) for seq in range(1, 60)]
    frame = spark.createDataFrame(rows, "incident_id bigint, seq int, state string, resolution string, owner string, severity string")
    got = {(r.incident_id, r.seq): (r.state_before, r.state_after, r.error == "") for r in operations.lifecycle(frame, block=block).collect()}
    for inc in (1, 2):
        state = "new"
        for _, seq, target, resolution, _, severity in sorted(r for r in rows if r[0] == inc):
            before, good = state, severity != "urgent" and target != "archived"
            if good and target is not None and target != state:
                good = target in operations.ALLOWED[state] and (target != "resolved" or resolution in operations.RESOLUTIONS)
            state = target if good and target is not None else state
            assert got[(inc, seq)] == (before, state, good)


def test_audit_chain_tampering(spark):
    rows = [(run, i, f"t{i}", "ana", "set", "x") for run in ("a", "b", "c", "d") for i in range(6)]
    frame = spark.createDataFrame(rows, "run string, idx bigint, at string, actor string, action string, detail string")
    chained = audit.build_chain(frame)
    anchor = audit.anchors(chained)
    bad = (chained.withColumn("detail", F.expr("if(run = 'b' and idx = 2, 'edited', detail)"))
           .where("not (run = 'c' and idx = 5)").where("not (run = 'd' and idx = 3)"))
    got = {r.run: (r.bad_index, r.reason) for r in audit.verify_chain(bad, anchor).collect()}
    assert got == {"a": (None, None), "b": (2, "changed entry"), "c": (None, "truncated"), "d": (4, "broken link")}


def test_a_tree_of_descriptions_gives_the_same(spark, monkeypatch):
    """Runs of two blocks are composed, and runs of those, so that keys have trees of several levels."""
    monkeypatch.setattr(blocks, "FAN", 2)
    test_volume_rule(spark, 3, 5)
    test_sequences(spark, 3, "600")
    test_risk(spark, 3)
    test_lifecycle(spark, 3)
