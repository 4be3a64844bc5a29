from __future__ import annotations

import random

import numpy as np
import pytest
from helpers import at
from pyspark.sql import functions as F

from secflow.plans import behaviour as b
from secflow.queries.streams import delivered
from secflow.streaming import jobs
from secflow.streaming.processors import clamped_scan


def events(n: int = 240) -> list[tuple]:
    """(event_id, ts, entity, value, volume, increment), most of them of one entity; some without a time."""
    rng = random.Random(3)
    out, minute = [], 0.0
    for i in range(n):
        minute += rng.choice([0, 1, 7, 90])
        out.append((i, at(minute), "hot" if rng.random() < 0.7 else f"e{rng.randrange(3)}", f"v{rng.randrange(12)}",
                    float(rng.choice([10, 11, 12, 9, 500])), float(rng.choice([0, 5, 20, 60]))))
    return out


SCHEMA = "event_id bigint, ts timestamp, entity string, value string, volume double, increment double"


def drained(spark, rows, job, folder, keep=None, cuts=None):  # noqa: ANN001, ANN201
    more = {} if keep is None else {"keep": keep}
    delivered(spark, rows, folder.name, lambda stream: jobs.run_to_table(
        job(stream, **more), str(folder / "out"), str(folder / "mark")), cuts)
    return spark.read.parquet(str(folder / "out"))


def plain_risk(rows: list[tuple]) -> dict[int, tuple[float, float]]:
    out, state = {}, {}
    for event, ts, entity, _, _, add in sorted(rows, key=lambda r: (r[1] is None, r[1] or at(0), r[0])):
        score, last = state.get(entity, (0.0, None))
        hours = 0.0 if last is None or ts is None else (ts - last).total_seconds() / 3600
        after = min(100.0, max(0.0, score - 5 * hours) + add)
        out[event] = (score, after)
        state[entity] = (after, ts or last)
    return out


def test_composed_clamps_equal_a_loop():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 64, 301):
        moves, low = rng.normal(0, 30, n), rng.uniform(0, 40, n)
        expected, s = [], 12.0
        for m, lo in zip(moves, low, strict=True):
            s = min(100.0, max(lo, s + m))
            expected.append(s)
        assert np.allclose(clamped_scan(12.0, moves, low, 100.0), expected)


def test_risk_goes_on_over_restarts_and_takes_rows_without_a_time(spark, tmp_path):
    rows = events() + [(900, None, "hot", "v1", 1.0, 7.0), (901, None, "new", "v1", 1.0, 7.0)]
    got = drained(spark, spark.createDataFrame(rows, SCHEMA).select("event_id", "ts", "entity", "increment"),
                  jobs.risk, tmp_path)
    expected = plain_risk(rows)
    assert {r["event_id"] for r in got.collect()} == set(expected)
    for r in got.collect():
        assert np.allclose((r["previous"], r["score"]), expected[r["event_id"]])


def test_keys_expire(spark, tmp_path):
    rows = spark.createDataFrame([(1, at(0), "a", "v", 1.0, 50.0), (2, at(1), "a", "v", 1.0, 5.0)], SCHEMA).select(
        "event_id", "ts", "entity", "increment")
    cut = ["timestamp'2024-03-01 00:00:30'"]
    kept = drained(spark, rows, jobs.risk, tmp_path / "kept", cuts=cut)
    gone = drained(spark, rows, jobs.risk, tmp_path / "gone", keep="1 ms", cuts=cut)
    assert kept.where("event_id = 2").first()["previous"] == 50.0
    assert gone.where("event_id = 2").first()["previous"] == 0.0


def test_volume_windows_equal_a_loop_and_odd_rows_come_out(spark, tmp_path):
    rows = spark.createDataFrame(events(), SCHEMA).selectExpr("event_id", "ts", "entity as group")
    late = spark.createDataFrame([(800, at(-5000), "hot"), (801, None, "hot"), (802, None, "only")],
                                 "event_id bigint, ts timestamp, group string")
    mark, out = str(tmp_path / "mark"), str(tmp_path / "out")

    def start(stream):  # noqa: ANN001, ANN202
        jobs.run_to_table(jobs.volume_rule(stream, 3, 3600), out, mark)

    source = str(tmp_path / "in")
    for number, part in enumerate((rows.where("event_id < 90"), rows.where("event_id >= 90"), late)):
        part.write.parquet(f"{source}/{number:03d}")
        start(jobs.read_events(spark, source, rows.schema))
    expected, state = {}, {}
    for event, ts, group, *_ in sorted(events(), key=lambda r: (r[1], r[0])):
        held = [(t, e) for t, e in state.get(group, []) if (ts - t).total_seconds() <= 3600] + [(ts, event)]
        if len(held) == 3:
            expected[event] = ",".join(str(e) for _, e in held[:-1])
            held = []
        state[group] = held
    got = spark.read.parquet(out).collect()
    assert {r["event_id"]: r["related"] for r in got if r["kind"] == "hit"} == expected and expected
    assert {(r["event_id"], r["kind"]) for r in got if r["kind"] != "hit"} == {
        (800, "late"), (801, "untimed"), (802, "untimed")}


def test_baselines_on_a_stream_equal_the_batch(spark, tmp_path):
    rows = spark.createDataFrame(events(400), SCHEMA).selectExpr(
        "event_id", "ts", "entity as host", "concat('u', entity) as user", "value as src_ip", "value as process_name",
        "cast(volume as bigint) as bytes_out")
    long = rows.selectExpr(
        "event_id", "ts", "cast(hour(ts) as int) as hour",
        "explode(array(named_struct('kind', 'user', 'entity', user, 'value', src_ip, 'volume', cast(null as double)), "
        "named_struct('kind', 'host', 'entity', host, 'value', process_name, 'volume', cast(bytes_out as double)))) as e",
    ).selectExpr("event_id", "ts", "hour", "e.*")
    got = drained(spark, long, jobs.baselines, tmp_path).select("event_id", "kind", "entity", F.round("score", 6), F.round(
        "confidence", 6)).collect()
    expected = b.deviations(rows).select("event_id", "kind", "entity", F.round("score", 6), F.round("confidence", 6)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, expected)) and len(expected) > 20


def test_values_that_are_not_used_are_forgotten(spark, tmp_path):
    long = spark.range(24).selectExpr(
        "id as event_id", "timestamp_seconds(1700000000 + id) as ts", "22 as hour", "'user' as kind", "'a' as entity",
        "if(id % 2 = 0, 'x', 'y') as value", "cast(null as double) as volume")
    cut = ["timestamp_seconds(1700000012)"]
    count = [drained(spark, long, jobs.baselines, tmp_path / f"k{i}", keep, cut).count() for i, keep in enumerate(
        ("30 days", "1 ms"))]
    assert count == [0, 0]
    state = spark.read.format("statestore").option("stateVarName", "known").load(str(tmp_path / "k0" / "mark"))
    assert state.count() == 2


@pytest.mark.parametrize("parts", [1, 4])
def test_deliveries_hold_every_row_once(spark, tmp_path, parts):
    rows = spark.createDataFrame([*events(50), (99, None, "a", "b", 1.0, 1.0)], SCHEMA).repartition(3)
    cuts = [f"timestamp'2024-03-01 0{h}:00:00'" for h in range(1, parts)]
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    delivered(spark, rows, "all", lambda stream: jobs.run_batches(
        stream, lambda batch, number: jobs.written(batch, out, number), mark), cuts)
    got = spark.read.parquet(out)
    assert sorted(r["event_id"] for r in got.collect()) == [*range(50), 99]
    assert got.select("batch").distinct().count() <= parts
    assert got.where("event_id = 99").first()["batch"] == got.agg(F.max("batch")).first()[0]


def test_matches_store_an_event_once_for_a_value_and_keep_the_table_it_met(spark, tmp_path):
    events = spark.createDataFrame([(i, "1.1.1.1" if i % 2 else "9.9.9.9", "2.2.2.2", None) for i in range(20)],
                                   "event_id bigint, src_ip string, dst_ip string, md5 string")
    tables = iter([[(f"a{j}", ["c2"], v) for j in range(30) for v in ("1.1.1.1", "2.2.2.2")], [("b", ["spam"], "2.2.2.2")]] * 2)
    handle = jobs.with_intel(lambda: spark.createDataFrame(
        next(tables), "indicator_id string, labels array<string>, observable string"), str(tmp_path))
    batches = [events.where(f"event_id div 5 = {i}") for i in range(4)]
    for number, batch in enumerate(batches):
        handle(batch, number)
    next_again = iter([[("b", ["spam"], "2.2.2.2")]])
    jobs.with_intel(lambda: spark.createDataFrame(  # delivered again: replaces its own rows only
        next(next_again), "indicator_id string, labels array<string>, observable string"), str(tmp_path))(batches[3], 3)
    assert spark.read.parquet(f"{tmp_path}/events").count() == 2 * 5 + 2 * (5 + 2)
    assert spark.read.parquet(f"{tmp_path}/indicators").count() == 61
    got = sorted(map(tuple, jobs.matches(spark, str(tmp_path)).select("event_id", "observable", "indicator_id").collect()))
    assert got == sorted([(i, v, f"a{j}") for i in range(20) if i // 5 % 2 == 0 for j in range(30)
                          for v in (["1.1.1.1", "2.2.2.2"] if i % 2 else ["2.2.2.2"])]
                         + [(i, "2.2.2.2", "b") for i in range(20) if i // 5 % 2 == 1])
