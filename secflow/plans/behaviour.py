"""Per-entity behaviour: what was usual before each event, and what deviates from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secflow.operators.timeline import (over_rows, over_time, row_index, time_bucket, timed_bucket, timed_index,
                                        timed_prefix)
from secflow.plans.detection import first_rows
from secflow.settings import MICROS, checkpointed, chunk_seconds, small_side

# Fixed values.
MIN_EVENTS = 10
FULL_CONFIDENCE = 50.0
VOLUME_HISTORY = 500
MIN_SAMPLES = 5
#: The chunk of samples of earlier deliveries, before all chunks of time.
BEFORE = -(1 << 60)


def _host(events: DataFrame) -> DataFrame:
    return events.withColumn("_h", F.expr("coalesce(host, src_ip, 'unknown')"))


def _in_window(seconds: int):  # noqa: ANN202
    """Rows before this one less those that the window has left behind: a count that only grows along the chunk."""
    def count(_, ranged):  # noqa: ANN001, ANN202
        gone = F.count(F.lit(1)).over(ranged.rangeBetween(Window.unboundedPreceding, -seconds * MICROS))
        return F.when(F.col("_micros").isNull(), 0).otherwise(F.col("_row") - 1 - gone).cast("bigint")

    return count


def burst(events: DataFrame, seconds: int) -> DataFrame:
    """Events of the same host in the open interval (ts - seconds, ts) that come before this one.

    An event without a time has none.
    """
    return over_time(_host(events), ["_h"], seconds, {"events_in_window": _in_window(seconds)}).drop("_h")


def _since(before: Column, default_seconds: int) -> Column:
    gap = (F.unix_micros("ts") - F.unix_micros(before)) / 1e6
    return F.when(gap.isNull(), F.lit(float(default_seconds))).otherwise(F.greatest(F.lit(0.0), gap))


def since_previous(events: DataFrame, default_seconds: int) -> DataFrame:
    """Seconds since the previous event of the host, at least 0; first events and those without a time get the default."""
    keyed = timed_index(_host(events), ["_h"])
    return over_rows(keyed, ["_h"], 1, {
        "since_prev": lambda w: _since(F.lag("ts").over(w), default_seconds)}).drop("_h", "_idx")


def host_timeline(events: DataFrame, seconds: int) -> DataFrame:
    """``burst`` and ``since_previous`` in one pass over the hosts' timelines.

    The event before stands in the same chunk or its halo. Where neither has one, it is the newest of the
    chunks before, which are one small row each.
    """
    keyed, width = _host(events), max(chunk_seconds(events.sparkSession), seconds)
    rows = over_time(keyed, ["_h"], seconds, {
        "events_in_window": _in_window(seconds), "_before": lambda rows, _: F.lag("ts").over(rows)})
    chunk = time_bucket("ts", width)
    ends = keyed.where("ts is not null").groupBy("_h", chunk.alias("_c")).agg(F.max("ts").alias("_end"))
    earlier = Window.partitionBy("_h").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("_h", "_c", F.max("_end").over(earlier).alias("_carry")).where("_carry is not null")
    joined = rows.withColumn("_c", chunk).join(small_side(carry), ["_h", "_c"], "left")
    return joined.withColumn("since_prev", _since(F.coalesce("_before", "_carry"), seconds)).drop(
        "_h", "_c", "_before", "_carry")


def confidence(n: str) -> str:
    return f"least({n} / {FULL_CONFIDENCE}D, 1D)"


@dataclass
class Known:
    """What earlier deliveries taught: counts (kind, entity, hour, n; hour -1 without a time), values (kind, entity,
    value) and samples (event_id, ts, host, bytes_out), the newest VOLUME_HISTORY of each host."""

    counts: DataFrame
    values: DataFrame
    samples: DataFrame

    def add_counts(self, rows: DataFrame, kind: str, by_hour: bool) -> DataFrame:
        mine = self.counts.where(F.col("kind") == kind)
        total = mine.groupBy(F.col("entity").alias(kind)).agg(F.sum("n").alias("_n"))
        out = rows.join(total, kind, "left").withColumn("n_prior", F.expr("n_prior + coalesce(_n, 0)")).drop("_n")
        if not by_hour:
            return out
        hours = mine.select(F.col("entity").alias(kind), F.col("hour"), F.col("n").alias("_n"))
        return out.join(hours, [kind, "hour"], "left").withColumn("n_hour", F.expr("n_hour + coalesce(_n, 0)")).drop("_n")


HOUR = "coalesce(cast(hour(ts) as bigint), -1L)"


def learnt(events: DataFrame, known: Known | None = None) -> Known:
    """What is known after ``events``: whole counts and samples, and only the values that are new."""
    both = events.selectExpr("event_id", f"{HOUR} as hour", (
        "explode(array(named_struct('kind', 'user', 'entity', user, 'value', src_ip), "
        "named_struct('kind', 'host', 'entity', host, 'value', process_name))) as e")).selectExpr(
        "hour", "e.*").where("entity is not null")
    counts = both.groupBy("kind", "entity", "hour").agg(F.count("*").alias("n"))
    values = both.where("value is not null").select("kind", "entity", "value").distinct()
    samples = events.where("bytes_out is not null and host is not null").select(
        "event_id", "ts", "host", F.col("bytes_out").cast("double").alias("bytes_out"))
    if known is not None:
        counts = counts.unionByName(known.counts).groupBy("kind", "entity", "hour").agg(F.sum("n").alias("n"))
        values = values.join(known.values, ["kind", "entity", "value"], "left_anti")
        samples = samples.unionByName(known.samples)
    newest = [F.desc_nulls_first("ts"), F.desc("event_id")]  # without a time: last in order
    return Known(counts, values, first_rows(samples, ["host"], newest, VOLUME_HISTORY).drop("rank"))


def user_history(events: DataFrame, known: Known | None = None) -> DataFrame:
    """Per event of a known user: events before it, and how many of those fell in the same hour.

    An event without a time comes last, has no hour (-1) and is never unusual for it.
    """
    rows = events.where("user is not null").select("event_id", "ts", "user", F.expr(f"{HOUR} as hour"))
    counted = timed_prefix(rows, ["user"], {"n_prior": ("count", F.lit(1))})
    hours = timed_prefix(counted, ["user", "hour"], {"n_hour": ("count", F.lit(1))})
    hours = hours if known is None else known.add_counts(hours, "user", by_hour=True)
    return hours.withColumn("typical", F.expr("hour < 0 or n_hour >= greatest(0.02D * n_prior, 1D)"))


def host_history(events: DataFrame, known: Known | None = None) -> DataFrame:
    rows = events.where("host is not null").select("event_id", "ts", "host")
    counted = timed_prefix(rows, ["host"], {"n_prior": ("count", F.lit(1))})
    return counted if known is None else known.add_counts(counted, "host", by_hour=False)


def first_seen(rows: DataFrame, entity: str, value: str) -> DataFrame:
    """The event that shows each (entity, value) for the first time; aggregated before the shuffle."""
    return (rows.where(F.col(value).isNotNull()).groupBy(entity, value)
            .agg(F.min(F.struct(F.col("ts").isNull(), "ts", "event_id")).alias("_f"))
            .select(F.col("_f.event_id").alias("event_id"), value))


def volume_z(events: DataFrame, known: Known | None = None) -> DataFrame:
    """z-score of ``bytes_out`` against the last 500 non-null samples of the host, those of ``known`` among them."""
    rows = events.where("bytes_out is not null and host is not null").select(
        "event_id", "ts", "host", "bytes_out", F.lit(True).alias("_fresh"))
    if known is not None:
        rows = rows.unionByName(known.samples.withColumn("_fresh", F.lit(False)))
    # What was learnt before comes before, whatever its time.
    sampled = row_index(rows, ["host"], [F.col("_fresh"), F.col("ts"), F.col("event_id")], F.when(
        F.col("_fresh"), timed_bucket("ts", ["event_id"], chunk_seconds(events.sparkSession))).otherwise(F.lit(BEFORE)))

    def past(w):
        return w.rowsBetween(-VOLUME_HISTORY, -1)

    out = over_rows(sampled, ["host"], VOLUME_HISTORY, {
        "_n": lambda w: F.count("bytes_out").over(past(w)),
        "_mean": lambda w: F.avg("bytes_out").over(past(w)),
        "_std": lambda w: F.stddev_pop("bytes_out").over(past(w)),
    })
    return out.where("_fresh").selectExpr("event_id", "host", f"case when _n >= {MIN_SAMPLES} and _std > 0 then (bytes_out - _mean) / _std end as z")


def _kinds(rows: DataFrame, entity: str, arms: list[tuple[str, str, str, str]]) -> DataFrame:
    """One row per deviation that applies; (condition, kind, score, technique) per arm."""
    built = ", ".join(f"case when {test} then named_struct('kind', '{kind}', 'score', {score}, 'technique', {technique}) end"
                      for test, kind, score, technique in arms)
    return rows.where(f"n_prior >= {MIN_EVENTS}").selectExpr(
        "event_id", f"{entity} as entity", f"{confidence('n_prior')} as confidence",
        f"explode(array_compact(array({built}))) as d").selectExpr(
        "event_id", "d.kind as kind", "entity", "d.score as score", "confidence", "d.technique as technique")


UNUSUAL_HOUR = ("not typical", "unusual_hour", "70D", "'T1078'")
UNKNOWN_IP = ("fresh", "unknown_ip", "65D", "'T1078'")
UNKNOWN_PROCESS = ("fresh", "unknown_process", "55D", "cast(null as string)")
UNUSUAL_VOLUME = ("z >= 3", "unusual_volume", "least(50D + 10D * (z - 3D), 100D)", "cast(null as string)")


def _marked(rows: DataFrame, events: DataFrame, entity: str, value: str, known: Known | None = None) -> DataFrame:
    first = first_seen(events.where(f"{entity} is not null"), entity, value)
    if known is not None:
        old = known.values.where(F.col("kind") == entity).select(F.col("entity").alias("_e"), F.col("value").alias(value))
        named = first.join(events.select("event_id", F.col(entity).alias("_e")), "event_id")
        first = named.join(old, ["_e", value], "left_anti")
    return rows.join(first.select("event_id", F.lit(True).alias("fresh")), "event_id", "left")


def unusual_hour(events: DataFrame) -> DataFrame:
    return _kinds(user_history(events), "user", [UNUSUAL_HOUR])


def unknown_ip(events: DataFrame) -> DataFrame:
    return _kinds(_marked(user_history(events), events, "user", "src_ip"), "user", [UNKNOWN_IP])


def unknown_process(events: DataFrame) -> DataFrame:
    return _kinds(_marked(host_history(events), events, "host", "process_name"), "host", [UNKNOWN_PROCESS])


def unusual_volume(events: DataFrame) -> DataFrame:
    return _kinds(host_history(events).join(volume_z(events).drop("host"), "event_id"), "host", [UNUSUAL_VOLUME])


def deviations(events: DataFrame, known: Known | None = None) -> DataFrame:
    """One row per (event, kind of deviation). Each history is built once for both of its kinds.

    With ``known`` the events go on from what earlier deliveries taught.
    """
    users = _marked(user_history(events, known), events, "user", "src_ip", known)
    hosts = _marked(host_history(events, known), events, "host", "process_name", known).join(
        volume_z(events, known).drop("host"), "event_id", "left")
    return _kinds(users, "user", [UNUSUAL_HOUR, UNKNOWN_IP]).unionByName(
        _kinds(hosts, "host", [UNKNOWN_PROCESS, UNUSUAL_VOLUME]))


def behaviour_scores(events: DataFrame, known: Known | None = None) -> DataFrame:
    return deviations(events, known).groupBy("event_id").agg(
        F.sum(F.expr("score * confidence")).alias("behaviour_score"),
        F.array_join(F.sort_array(F.collect_list("kind")), ",").alias("deviation_kinds"))


def profiles(events: DataFrame) -> DataFrame:
    """Baseline table: hours, addresses and processes per user and per host.

    A row lists every value, by the time it was first seen (without a time: last), then by value. Counted per (entity,
    hour), and made distinct per value, before anything is collected: an array holds distinct values, never one entry
    per event. ``profile_values`` has the same values as rows.
    """
    both = events.selectExpr(
        "ts", "hour(ts) as hour",
        "explode(array(named_struct('type', 'user', 'entity', user, 'ip', src_ip, 'process', process_name), "
        "named_struct('type', 'host', 'entity', host, 'ip', dst_ip, 'process', process_name))) as e",
    ).where("e.entity is not null").selectExpr("ts", "hour", "e.*")
    hours = (both.groupBy("type", "entity", "hour")
             .agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
             .groupBy("type", "entity").agg(
                 F.sum("n").alias("n_events"), F.min("a").alias("first_seen"), F.max("b").alias("last_seen"),
                 F.map_from_entries(F.sort_array(F.collect_list(
                     F.when(F.col("hour").isNotNull(), F.struct("hour", "n"))))).alias("hours")))

    def values(name: str, alias: str) -> list[Column]:
        mine = F.when(F.col("kind") == name, F.struct(F.col("first_seen").isNull(), "first_seen", "value"))
        return [F.count(mine).alias(f"n_{alias}"),
                F.transform(F.sort_array(F.collect_list(mine)), lambda x: x["value"]).alias(alias)]

    lists = profile_values(events).groupBy("type", "entity").agg(*values("ip", "ips"), *values("process", "processes"))
    return hours.join(lists, ["type", "entity"], "left").fillna(0, ["n_ips", "n_processes"])


def profile_values(events: DataFrame) -> DataFrame:
    """type, entity, kind (ip or process), value, first_seen and n: what a user or host is known by, one row a value."""
    pairs = ", ".join(f"named_struct('type', '{t}', 'entity', {t}, 'kind', '{kind}', 'value', {value})" for t, kind, value in (
        ("user", "ip", "src_ip"), ("user", "process", "process_name"), ("host", "ip", "dst_ip"),
        ("host", "process", "process_name")))
    return (events.selectExpr("ts", f"explode(array({pairs})) as e").where("e.entity is not null and e.value is not null")
            .groupBy("e.type", "e.entity", "e.kind", "e.value").agg(F.min("ts").alias("first_seen"), F.count("*").alias("n")))
