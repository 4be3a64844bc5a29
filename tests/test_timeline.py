"""Chunked history against plain loops, with chunks and blocks far smaller than a key."""

from __future__ import annotations

import pytest
from helpers import by_key, random_rows
from pyspark.sql import functions as F

import __spark_entry__ as registry
from secflow.operators.lookups import as_of, first_in_window
from secflow.operators.timeline import over_rows, over_time, sessions, timed_index, timed_prefix
from secflow.plans import behaviour as b

DDL = "event_id bigint, ts timestamp, key string"


@pytest.fixture(params=[60, 900, 86400])
def chunked(spark, request):
    spark.conf.set("secflow.chunk.seconds", str(request.param))
    yield spark
    spark.conf.unset("secflow.chunk.seconds")


def frame(spark, rows, parts=5):
    return spark.createDataFrame(rows, DDL).repartition(parts)


def test_prefix_and_index(chunked):
    rows = random_rows(1, 120)
    got = {r.event_id: (r.n, r.low, r._idx) for r in timed_index(timed_prefix(
        frame(chunked, rows), ["key"], {"n": ("count", F.lit(1)), "low": ("min", F.col("event_id"))}), ["key"]).collect()}
    for group in by_key(rows).values():
        for i, row in enumerate(group):
            low = min((g[0] for g in group[:i]), default=None)
            assert got[row[0]] == (i, low, i)


def test_rows_frame(chunked):
    rows = random_rows(2, 150)
    indexed = timed_index(frame(chunked, rows), ["key"])
    got = {r.event_id: r.s for r in over_rows(indexed, ["key"], 4, {
        "s": lambda w: F.sum("event_id").over(w.rowsBetween(-4, -1))}, block=7).collect()}
    for group in by_key(rows).values():
        for i, row in enumerate(group):
            past = [g[0] for g in group[max(0, i - 4):i]]
            assert got[row[0]] == (sum(past) if past else None)


def test_range_frame_counts_ties_once(chunked):
    rows = random_rows(3, 150)
    span = 5 * 60 * 1_000_000 - 1
    got = {r.event_id: r.c for r in over_time(frame(chunked, rows), ["key"], 300, {
        "c": lambda o, r: F.col("_row") - F.min("_row").over(r.rangeBetween(-span, 0))}).collect()}
    for group in by_key(rows).values():
        for i, row in enumerate(group):
            assert got[row[0]] == sum((row[1] - g[1]).total_seconds() < 300 for g in group[:i])


def test_gap_of_exactly_the_limit_stays_together(chunked):
    rows = random_rows(4, 150)
    got = {r.event_id: r.session for r in sessions(frame(chunked, rows), ["key"], 180).collect()}
    for group in by_key(rows).values():
        number, last = 0, None
        for row in group:
            if last is None or (row[1] - last).total_seconds() > 180:
                number += 1
            last = row[1]
            assert got[row[0]] == number


def test_as_of_takes_the_newest_snapshot(chunked):
    rows, marks = random_rows(5, 80), random_rows(6, 40)
    side = chunked.createDataFrame([(r[2], r[1], "a" if r[0] % 2 else "b", r[0]) for r in marks],
                                   "key string, queried_at timestamp, kind string, no bigint")
    got = {r.event_id: (r.asof_a, r.asof_b) for r in as_of(
        frame(chunked, rows), side, "key", "queried_at", ["a", "b"], "kind", ["no"]).collect()}
    for row in rows:
        for place, odd in ((0, 1), (1, 0)):
            past = [(m[1], m[0]) for m in marks if m[2] == row[2] and m[0] % 2 == odd and m[1] <= row[1]]
            found = got[row[0]][place]
            assert (found.no if found else None) == (max(past)[1] if past else None)


def test_first_mark_in_window(chunked):
    events = [(i, ts, None if i % 7 == 0 else key) for i, ts, key in random_rows(7, 80)]
    marks = [(i, ts, "" if i % 5 == 0 else key, f"T{i}") for i, ts, key in random_rows(8, 40)]
    got = {r.event_id: r.technique for r in first_in_window(
        chunked.createDataFrame(events, "event_id bigint, ts timestamp, host string"),
        chunked.createDataFrame(marks, "exec_no bigint, ts timestamp, host string, technique string"), 600).collect()}
    for event in events:
        fit = [(m[1], m[0], m[3]) for m in marks if 0 <= (event[1] - m[1]).total_seconds() <= 600
               and (not event[2] or not m[2] or m[2] == event[2])]
        assert got.get(event[0]) == (min(fit)[2] if fit else None)


def plan_of(df) -> str:  # noqa: ANN001
    return df._jdf.queryExecution().toString()


def test_bursts_are_counted_by_a_frame_that_only_grows(chunked):
    rows = random_rows(12, 60)
    events = frame(chunked, rows).selectExpr("event_id", "ts", "key as host", "'1.2.3.4' as src_ip").unionByName(
        chunked.createDataFrame([(900, None, "hot", "1.2.3.4")], "event_id bigint, ts timestamp, host string, src_ip string"))
    got = b.host_timeline(events, 600)
    assert "specifiedwindowframe(RangeFrame, -" not in plan_of(got)
    counts = {r.event_id: r.events_in_window for r in got.collect()}
    assert counts.pop(900) == 0
    for mine in by_key(rows).values():
        for i, row in enumerate(mine):
            assert counts[row[0]] == sum((row[1] - r[1]).total_seconds() < 600 for r in mine[:i])


def test_feature_queries_have_no_frame_that_moves_at_both_ends(spark):
    for name in ("ml_standardize", "topk_features"):
        assert "specifiedwindowframe(RangeFrame, -" not in plan_of(registry.queries()[name](spark, "/root/testdata/sf0.001"))


def test_error_samples_make_the_features_once(spark):
    got = registry.queries()["ml_error_samples"](spark, "/root/testdata/sf0.001")
    assert "parquet" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.where("cell = 'TN'").count() == 10 and got.where("cell <> 'TN'").count() > 10


def test_top_features_of_a_busy_host(chunked):
    """The three largest deviations read the burst; its count equals a loop where one host has every event."""
    events = frame(chunked, random_rows(13, 50, keys=1)).selectExpr(
        "event_id - 40 as event_id", "ts", "'one' as host", "'1.2.3.4' as src_ip")
    got = {r.event_id: r.events_in_window for r in b.burst(events, 3600).collect()}
    rows = sorted(events.select("ts", "event_id").collect())
    for i, row in enumerate(rows):
        assert got[row.event_id] == sum((row.ts - r.ts).total_seconds() < 3600 for r in rows[:i])
    assert "specifiedwindowframe(RangeFrame, -" not in plan_of(b.burst(events, 3600))
