"""Events whose time cannot be read stay in every per-event plan, once each and with defaults."""

from __future__ import annotations

import json
import random

import pytest
from helpers import at

from secflow.operators import timeline as tl
from secflow.plans import behaviour as b
from secflow.plans import detection as det
from secflow.plans.features import FEATURES, features
from secflow.plans.incidents import clustered, findings
from secflow.plans.risk import risk_history
from secflow.sources import normalize, prepared

RAW = [{"source": "sysmon", "EventID": 1, "UtcTime": when, "Computer": "H", "User": "u", "Image": "C:\\Windows\\whoami.exe",
        "CommandLine": f"cmd /c whoami {i}"}
       for i, when in enumerate(["2024-03-01 10:00:00", "not a time", "2024-03-01 10:02:00", "", "2024-03-05 10:00:00"])]


@pytest.fixture
def raw_events(spark):
    lines = spark.createDataFrame([(json.dumps(r),) for r in RAW], "value string")
    return prepared.referenced(normalize.dispatch(lines))


@pytest.fixture
def chunked(spark):
    spark.conf.set("secflow.chunk.seconds", "600")
    yield spark
    spark.conf.unset("secflow.chunk.seconds")


def test_raw_records_without_a_time_come_out_once(raw_events, chunked):
    ids = sorted(r.event_id for r in raw_events.collect())
    assert len(ids) == 5 and raw_events.where("ts is null").count() == 2
    plans = {
        "burst": b.burst(raw_events, 300), "since": b.since_previous(raw_events, 300),
        "timeline": b.host_timeline(raw_events, 300), "users": b.user_history(raw_events),
        "hosts": b.host_history(raw_events), "features": features(raw_events, raw_events)}
    for name, plan in plans.items():
        assert sorted(r.event_id for r in plan.collect()) == ids, name
    gap = {r.command_line[-1]: (r.events_in_window, r.since_prev) for r in plans["timeline"].collect()}
    assert gap == {"0": (0, 300.0), "1": (0, 300.0), "2": (1, 120.0), "3": (0, 300.0), "4": (0, 345480.0)}
    assert all(getattr(r, f) is not None for r in plans["features"].collect() for f in FEATURES)
    assert sorted(r.n_prior for r in plans["hosts"].collect()) == [0, 1, 2, 3, 4]
    untimed = plans["users"].where("ts is null").collect()
    assert all(r.typical and r.hour == -1 and r.n_prior >= 3 for r in untimed)


def test_hits_and_risk_of_events_without_a_time(spark, raw_events, chunked):
    hits = det.rule_matches(raw_events)
    found = clustered(findings(hits, raw_events.selectExpr("*", "0D as anomaly_score")))
    assert found.count() == hits.count() > 0
    scored = raw_events.selectExpr("event_id", "ts", "host as entity", "30D as hybrid_score", "false as cti_confirmed")
    assert risk_history(scored).count() == 5


def test_positions_of_rows_without_a_time_follow_all_others(chunked):
    rng = random.Random(2)
    rows = [(i, at(rng.randrange(400)) if rng.random() < 0.6 else None, "hot") for i in range(300)]
    df = chunked.createDataFrame(rows, "event_id bigint, ts timestamp, host string")
    got = {r.event_id: r._idx for r in tl.timed_index(df, ["host"]).collect()}
    timed = sorted((r[1], r[0]) for r in rows if r[1])
    assert sorted(got.values()) == list(range(300))
    assert [got[i] for _, i in timed] == list(range(len(timed)))


def test_one_pass_over_the_hosts_equals_both_plans(chunked):
    rng = random.Random(6)
    rows = [(i, at(rng.choice([rng.randrange(4000), rng.randrange(100)])) if rng.random() < 0.9 else None,
             rng.choice(["hot", "hot", "b"]), None) for i in range(400)]
    df = chunked.createDataFrame(rows, "event_id bigint, ts timestamp, host string, src_ip string")
    both = {r.event_id: (r.events_in_window, r.since_prev) for r in b.host_timeline(df, 300).collect()}
    one = {r.event_id: r.events_in_window for r in b.burst(df, 300).collect()}
    two = {r.event_id: r.since_prev for r in b.since_previous(df, 300).collect()}
    assert both == {i: (one[i], two[i]) for i in one} and len(one) == 400
    firsts = min((r for r in rows if r[1] and r[2] == "b"), key=lambda r: (r[1], r[0]))
    assert two[firsts[0]] == 300.0
