"""Raw records through normalisers and detection; splits and lookups where one key holds all rows."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from secflow.operators import lookups, sampling
from secflow.plans import detection as det
from secflow.plans import scoring as sc
from secflow.plans.cti import observables
from secflow.plans.evaluation import stratified_split
from secflow.plans.features import features
from secflow.sources import flows, normalize, prepared
from secflow.streaming import jobs


def process(host, command, **more):
    return json.dumps({"source": "sysmon", "EventID": 1, "UtcTime": "2024-03-01 10:00:00", "Computer": host,
                       "Image": "C:\\x.exe", "CommandLine": command} | more)


def events_of(spark, *records):
    raw = spark.createDataFrame([(r,) for r in records], "value string")
    return prepared.referenced(normalize.dispatch(raw))


def test_equal_source_ids_do_not_mix_hosts(spark):
    events = events_of(spark, process("H", "cmd /c whoami.exe", Image="C:\\Windows\\whoami.exe"), process("H2", "notepad a.txt"))
    found = events.join(sc.rule_evidence(det.rule_matches(events)), "event_id", "left").collect()
    assert len({r.event_id for r in found}) == 2 and {r.source_event_id for r in found} == {"1"}
    rules = {r.host: r.rules for r in found}
    assert rules["H"] and rules["H2"] is None


def test_rules_find_fields_in_properties_and_raw(spark):
    query = json.dumps({"source": "sysmon", "EventID": 22, "UtcTime": "2024-03-01 10:00:00", "Computer": "H",
                        "QueryName": "a" * 50 + ".example.test"})
    hits = {r.rule_id for r in det.rule_matches(events_of(spark, query)).collect()}
    assert "dns-tunneling" in hits
    events = events_of(spark, process("H", "notepad")).withColumn("properties", F.lit(None).cast("map<string,string>"))
    raw_only = events.withColumns({"category": F.lit("dns"), "raw": F.lit(query.replace("QueryName", "query_name"))})
    assert "dns-tunneling" in {r.rule_id for r in det.rule_matches(raw_only).collect()}


def test_features_and_observables_on_normalised_events(spark):
    events = events_of(spark, process("H", "whoami", Hashes="MD5=AB,SHA256=CD", ParentCommandLine="cmd /c"),
                       process("H", "dir"))
    got = {r.cmd_len: r for r in features(events, events).collect()}
    assert (got[6].has_hash, got[6].has_parent_cmd, got[3].has_hash, got[3].has_parent_cmd) == (1, 1, 0, 0)
    assert {r.observable for r in observables(events).collect()} == {"ab", "cd"}


def test_flow_files_of_different_layouts_and_none(spark, tmp_path):
    (tmp_path / "a.csv").write_text("dur,proto,label,ltime\n1,tcp,1,1421927414\n")
    (tmp_path / "b.csv").write_text("proto,dur,attack_cat,label\nudp,2,Fuzzers,0\n")
    (tmp_path / "c.csv").write_text("10.0.0.1,5,10.0.0.2,80,icmp\n")
    (tmp_path / "empty.csv").write_text("")
    rows = flows.read_flow_csv(spark, [str(tmp_path / f"{n}.csv") for n in "abc"])
    assert {(r.proto, r.dur, r.label) for r in rows.collect()} == {("tcp", "1", "1"), ("udp", "2", "0"), ("icmp", None, None)}
    assert flows.read_flow_csv(spark, str(tmp_path / "empty.csv")).count() == 0
    one = flows.flow_events(flows.read_flow_csv(spark, str(tmp_path / "a.csv")), "'1'", "1").first()
    assert one.ts == datetime(2015, 1, 22, 11, 50, 14) and one.unavailable == ["ip_addresses"]


@pytest.mark.parametrize("failures", [1, 5])
def test_a_batch_is_tried_again_before_it_is_a_dead_letter(spark, tmp_path, failures):
    calls = []

    def handle(batch, number):
        calls.append(number)
        if len(calls) <= failures:
            raise ValueError("executor lost")
        jobs.written(batch, str(tmp_path / "good"), number)

    jobs.guarded(handle, str(tmp_path / "dead"), pause=0.01)(spark.range(3).toDF("event_id"), 7)
    assert len(calls) == min(failures + 1, 3)
    assert (tmp_path / "good").exists() == (failures == 1) and (tmp_path / "dead").exists() == (failures == 5)


def one_key(spark, n=400):
    start = datetime(2024, 3, 1)
    rows = [(i, start + timedelta(milliseconds=7 * i), "hot", "s", i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp, host string, source string, label int")


def test_splits_cut_one_key_that_holds_all_rows_in_one_day(spark):
    rows = one_key(spark)
    spark.conf.set("secflow.block.rows", "50")
    try:
        sizes = rows.groupBy(sampling.even_bucket(rows).alias("b")).count().collect()
        assert len(sizes) >= 6 and max(r["count"] for r in sizes) <= 100
        split = {r.event_id: r.split for r in sampling.time_split(rows).collect()}
        assert [split[i] for i in (0, 239, 240, 319, 320, 399)] == ["train"] * 2 + ["validation"] * 2 + ["test"] * 2
        assert sorted(r.event_id for r in sampling.systematic_sample(rows, "source", 100).collect()) == list(range(0, 400, 4))
        parts = stratified_split(rows).groupBy("label", "split").count().collect()
        assert {(r.label, r.split): r["count"] for r in parts} == {
            (c, s): n for c in (0, 1) for s, n in (("train", 100), ("validation", 50), ("test", 50))}
        assert sampling.time_split(rows.limit(0)).count() == 0
    finally:
        spark.conf.unset("secflow.block.rows")


def test_interval_lookup_equals_all_pairs_with_cut_lanes(spark):
    start = datetime(2024, 3, 1)
    events = [(i, start + timedelta(seconds=i % 97), [None, "a", "b", ""][i % 4]) for i in range(200)]
    marks = [(j, start + timedelta(seconds=9 * j), [None, "a", "c"][j % 3], f"T{j}") for j in range(12)]
    spark.conf.set("secflow.block.rows", "10")
    try:
        got = lookups.first_in_window(
            spark.createDataFrame(events, "event_id long, ts timestamp, host string"),
            spark.createDataFrame(marks, "exec_no long, ts timestamp, host string, technique string"), 20).collect()
    finally:
        spark.conf.unset("secflow.block.rows")
    assert len(got) == len(events)
    for event_id, technique in got:
        _, ts, host = events[event_id]
        fit = [m for m in marks if (not host or not m[2] or host == m[2]) and timedelta(0) <= ts - m[1] <= timedelta(seconds=20)]
        assert technique == (min(fit, key=lambda m: (m[1], m[0]))[3] if fit else None)


def test_interval_lookup_does_not_walk_a_window_of_marks_for_each_event(spark):
    start = datetime(2024, 3, 1)
    events = spark.createDataFrame([(i - 3, start + timedelta(seconds=i), "a") for i in range(6)],
                                   "event_id long, ts timestamp, host string")
    marks = spark.createDataFrame([(j, start + timedelta(seconds=j), "a", f"T{j}") for j in range(0, 6, 2)],
                                  "exec_no long, ts timestamp, host string, technique string")
    got = lookups.first_in_window(events, marks, 3)
    # A frame with two moving ends is computed anew for each row; one that only grows is carried on.
    assert "specifiedwindowframe(RangeFrame, -" not in got._jdf.queryExecution().toString()
    assert dict(map(tuple, got.collect())) == {-3: "T0", -2: "T0", -1: "T0", 0: "T0", 1: "T2", 2: "T2"}


def test_label_queries_carry_the_first_mark_on(spark):
    import __spark_entry__ as registry

    for name in ("label_interval_join", "range_label"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "specifiedwindowframe(RangeFrame, unboundedpreceding$(), currentrow$())" in plan
        assert "specifiedwindowframe(RangeFrame, -" not in plan
