"""Structured Streaming jobs: file source here, any other source in production.

State per key is small and bounded. A micro-batch is bounded by the source options, which also bounds
what one key can bring into a task at a time.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secflow.plans import detection as det
from secflow.plans.cti import observables
from secflow.settings import checkpointed, small_side
from secflow.sources import flows, normalize, ocsf
from secflow.streaming.processors import KEEP, Baseline, Keyed, Risk, VolumeWindow

#: State with lists, maps, timers and a time to live needs the store outside the heap. A key with a timer asks for
#: one more batch after each batch, which would never let a drained stream end; timers then wait for the next rows.
DRAINED = {"spark.sql.streaming.stateStore.providerClass":
           "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
           "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def read_lines(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files).text(path)


def read_events(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    """Parquet files below ``path``, folders of deliveries included; ``files`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


@contextmanager
def drained(spark: SparkSession) -> Iterator[None]:
    """The settings DRAINED for the queries that are started inside."""
    before = {key: spark.conf.get(key, None) for key in DRAINED}
    for key, value in DRAINED.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Drain what is there. Progress is kept in ``checkpoint``, so a restart goes on where it stopped."""
    query = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    with drained(stream.sparkSession):
        query = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
                 .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()


def written(batch: DataFrame, path: str, number: int) -> None:
    """Write a micro-batch under its number: a repeated delivery replaces its own rows only."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def guarded(handle: Callable[[DataFrame, int], None], dead_letters: str, attempts: int = 3,
            pause: float = 1.0) -> Callable[[DataFrame, int], None]:
    """A batch that keeps failing goes to the dead letters with its reason; the stream goes on.

    A handler is tried ``attempts`` times with a growing pause, so a passing fault, a lost executor among
    them, does not cost the batch. Handlers write under the batch's number, so a repeat replaces its own rows.
    """
    def run(batch: DataFrame, number: int) -> None:
        for attempt in range(attempts):
            try:
                handle(batch, number)
                return
            except Exception as error:  # noqa: BLE001 - the reason is recorded, whatever it is
                reason = (str(error).splitlines() or [type(error).__name__])[0][:500]
            if attempt + 1 < attempts:
                time.sleep(pause * 2 ** attempt)
        written(batch.select(F.to_json(F.struct("*")).alias("record"), F.lit(reason).alias("reason")),
                dead_letters, number)
    return run


def normalise(documents: str, quarantine: str) -> Callable[[DataFrame, int], None]:
    """Raw lines to schema documents; unreadable lines are recorded and never stop the stream."""
    def handle(batch: DataFrame, number: int) -> None:
        good, bad = flows.read_json_lines(batch)
        written(ocsf.to_documents(normalize.dispatch(good)).select("event_id", "source", "class_uid", "document"),
                documents, number)
        written(bad, quarantine, number)
    return handle


def detect(events_store: str, incident_store: str) -> Callable[[DataFrame, int], None]:
    """Rules over each micro-batch into two tables."""
    def handle(batch: DataFrame, number: int) -> None:
        hits = det.rule_matches(batch)
        fired = hits.groupBy("event_id").agg(F.count("*").alias("n_rules"), F.max("confidence").alias("confidence"))
        rows = batch.join(fired, "event_id", "left").fillna(0, ["n_rules"])
        written(rows.select("event_id", "ts", "host", "n_rules"), events_store, number)
        written(rows.where("n_rules > 0").select("event_id", "host", "confidence"), incident_store, number)
    return handle


def with_intel(load: Callable[[], DataFrame], out: str) -> Callable[[DataFrame, int], None]:
    """Join each micro-batch with the indicator table, which is read again every time.

    Many indicators may name one value. An event is stored once for each value that any of them names, with the version
    of the table it met, and each version of the table is stored once; ``matches`` reads both as one row for each pair.
    """
    def handle(batch: DataFrame, number: int) -> None:
        live = checkpointed(load())
        sums = live.agg(F.count("*"), F.sum(F.xxhash64(*sorted(live.columns)).cast("decimal(38,0)"))).first()
        version = f"v{sums[0]}_{sums[1] or 0}".replace("-", "m")
        live.write.mode("overwrite").parquet(f"{out}/indicators/version={version}")
        named = live.select("observable").distinct()
        written(observables(batch).join(small_side(named), "observable").withColumn("version", F.lit(version)),
                f"{out}/events", number)
    return handle


def matches(spark: SparkSession, out: str) -> DataFrame:
    """What ``with_intel`` stored: one row per (event, observable, indicator of the version that the event met).

    The events are dealt out by their id first: a few of them may have most of the rows.
    """
    events = spark.read.parquet(f"{out}/events").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id")
    return events.join(small_side(spark.read.parquet(f"{out}/indicators")), ["version", "observable"]).drop("version")


# --- keyed state ------------------------------------------------------------------------------------------
def _keyed(events: DataFrame, keys: list[str], processor: Keyed) -> DataFrame:
    return events.groupBy(*keys).transformWithStateInPandas(processor, processor.OUT, "append", "ProcessingTime")


def risk(events: DataFrame, keep: str = KEEP) -> DataFrame:
    """Entity risk over micro-batches (columns event_id, ts, entity, increment)."""
    return _keyed(events, ["entity"], Risk(keep))


def volume_rule(matches: DataFrame, count: int, seconds: int, delay: str = "1 day", keep: str = KEEP) -> DataFrame:
    """Volume rule over micro-batches (columns event_id, ts, group): hits, and late and untimed rows for the quarantine."""
    return _keyed(matches, ["group"], VolumeWindow(count, seconds, delay, keep))


def baselines(events: DataFrame, keep: str = KEEP) -> DataFrame:
    """Behaviour per entity over micro-batches: judge an event by what came before, then learn it.

    Columns event_id, ts, kind (user or host), entity, hour, value (address or process), volume.
    """
    return _keyed(events, ["kind", "entity"], Baseline(keep))


def deduplicated(events: DataFrame, key: str = "event_id", delay: str = "2 days") -> DataFrame:
    """Re-delivered events pass once while the watermark remembers them."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])
