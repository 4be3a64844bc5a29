"""As-of and interval lookups without pairing every event with every candidate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from secflow.operators.timeline import prefix, time_bucket
from secflow.settings import MICROS, block_rows, checkpointed, chunk_seconds, small_side


def as_of(events: DataFrame, snapshots: DataFrame, key: str, at: str, kinds: Sequence[str], kind: str,
          payload: Sequence[str], tie: str = "event_id") -> DataFrame:
    """Latest snapshot of each kind at or before each event, as struct columns ``asof_<kind>``.

    Events and snapshots are merged into one timeline per key and the newest snapshot is carried
    forward, so the work is linear in both sides however many snapshots share a key.
    """
    sides = snapshots.select(F.col(key).alias("_k"), F.col(at).alias("_at"), F.lit(0).alias("_side"),
                             F.struct(F.col(at).alias("_from"), *payload).alias("_pay"), F.col(kind).alias("_kind"),
                             F.lit(None).alias("_row"))
    rows = events.select(F.col(key).alias("_k"), F.col("ts").alias("_at"), F.lit(1).alias("_side"),
                         F.lit(None).alias("_pay"), F.lit(None).alias("_kind"),
                         F.struct(*[F.col(c) for c in events.columns]).alias("_row"))
    merged = sides.unionByName(rows).withColumn("_tie", F.col(f"_row.{tie}"))
    bucket = time_bucket("_at", chunk_seconds(events.sparkSession))
    carried = prefix(merged, ["_k"], [F.col("_at"), F.col("_side"), F.col("_tie")], bucket, {
        f"asof_{k}": ("max", F.when(F.col("_kind") == k, F.col("_pay"))) for k in kinds})
    return carried.where("_side = 1").select("_row.*", *[f"asof_{k}" for k in kinds])


def first_in_window(events: DataFrame, marks: DataFrame, seconds: int, host: str = "host",
                    payload: str = "technique", mark_id: str = "exec_no") -> DataFrame:
    """Label each event with the earliest mark of the preceding ``seconds``.

    A mark applies when hosts are equal or when either side has none. Marks and events meet in lanes: one per
    host, one for marks without a host and all events with one, one for events without a host and all marks.
    An event stands where its window opens and takes the first mark from there on, if that is in reach. A lane is
    cut into time buckets as wide as the window, so that mark is in the event's bucket or is the earliest of the next,
    and a bucket with many events is cut further by a hash of the event; marks, the short side, go to each cut.
    Within a cut one running minimum from the end of the bucket serves all events, however many marks a window holds.
    """
    spark, width = events.sparkSession, seconds * MICROS
    no_mark_host = F.coalesce(F.col(host), F.lit("")) == ""
    bucket = F.expr(f"_at div {width}")
    mark_rows = marks.select(
        F.explode(F.array(F.when(no_mark_host, F.lit("*shared")).otherwise(F.col(host)), F.lit("*any"))).alias("_lane"),
        F.unix_micros("ts").alias("_at"), F.lit(None).cast("bigint").alias("event_id"),
        F.struct("ts", mark_id, payload).alias("_mark")).withColumn("_bucket", bucket)
    events_in = events.select(
        F.explode(F.when(no_mark_host, F.array(F.lit("*any"))).otherwise(F.array(F.col(host), F.lit("*shared"))))
        .alias("_lane"), (F.unix_micros("ts") - width).alias("_at"), F.col("event_id").cast("bigint").alias("event_id"),
        F.lit(None).alias("_mark")).withColumn("_bucket", bucket)
    cuts = small_side(checkpointed(events_in.where("_bucket is not null").groupBy("_lane", "_bucket").agg(
        F.count("*").alias("_n")).select("_lane", "_bucket", F.expr(f"_n div {block_rows(spark)} + 1").alias("_cuts"))))
    dealt = events_in.join(cuts, ["_lane", "_bucket"]).withColumn("_cut", F.expr("pmod(xxhash64(event_id), _cuts)"))
    earliest = mark_rows.groupBy("_lane", "_bucket").agg(F.min("_mark").alias("_mark")).select(
        "_lane", F.unix_micros("_mark.ts").alias("_at"), F.lit(None).cast("bigint").alias("event_id"), "_mark",
        (F.col("_bucket") - 1).alias("_bucket"))
    spread = mark_rows.unionByName(earliest).join(cuts, ["_lane", "_bucket"]).withColumn(
        "_cut", F.explode(F.expr("sequence(0L, _cuts - 1)")))
    onward = Window.partitionBy("_lane", "_bucket", "_cut").orderBy(F.col("_at").desc()).rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    seen = dealt.unionByName(spread).withColumn("_first", F.min("_mark").over(onward)).where("_mark is null")
    reached = F.when(F.unix_micros("_first.ts") <= F.col("_at") + width, F.col("_first"))
    return (seen.groupBy("event_id").agg(F.min(reached).alias("_first"))
            .select("event_id", F.col(f"_first.{payload}").alias(payload)))
