"""Ordered computations per key that stay parallel when one key is hot.

A plain ``Window.partitionBy(host)`` sends every row of a busy host to one task. Here the rows of
a key are cut into time chunks first. Each chunk is reduced to one small summary row, the
summaries are accumulated along the key, and the rows of a chunk only ever meet each other, their
chunk's carry-in and a bounded halo of neighbours.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secflow.settings import MICROS, block_rows, chunk_seconds

CHUNK = "_chunk"
INDEX = "_idx"
BLOCK = "_block"

Measures = dict[str, tuple[str, Column]]


#: Chunks of rows without a time: behind all others, spread over lanes so that no key has one long lane.
TIMELESS, LANES = 1 << 60, 4096


def time_bucket(ts: str, seconds: int) -> Column:
    return F.expr(f"unix_micros({ts}) div {seconds * MICROS}")


def timed_bucket(ts: str, tie: Sequence[str], seconds: int) -> Column:
    """The time chunk of a row; one of the lanes behind all chunks where it has no time."""
    lane = F.lit(TIMELESS) + F.pmod(F.xxhash64(*tie), F.lit(LANES))
    return F.coalesce(time_bucket(ts, seconds), lane)


def _fold(kind: str, value: Column) -> Column:
    return {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}[kind](value)


def _merge(kind: str, value: Column) -> Column:
    return F.sum(value) if kind == "count" else _fold(kind, value)


def _join_both(kind: str, left: Column, right: Column) -> Column:
    if kind == "min":
        return F.least(left, right)
    if kind == "max":
        return F.greatest(left, right)
    total = F.coalesce(left, F.lit(0)) + F.coalesce(right, F.lit(0))
    return total if kind == "count" else F.when(left.isNull() & right.isNull(), None).otherwise(total)


def prefix(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column,
           measures: Measures, descending: bool = False) -> DataFrame:
    """Add, per row, each measure over all earlier rows of its key (the row itself excluded).

    ``bucket`` must be monotone in ``order``. ``descending`` walks the key from its end. Null keys
    never match each other, so callers replace them before.
    """
    keys = list(keys)
    rows = df.withColumn(CHUNK, bucket)
    sums = rows.groupBy(*keys, CHUNK).agg(
        *[_fold(kind, value).alias(f"_part_{name}") for name, (kind, value) in measures.items()])
    walk = F.col(CHUNK).desc() if descending else F.col(CHUNK).asc()
    before = Window.partitionBy(*keys).orderBy(walk).rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(*keys, CHUNK, *[
        _merge(kind, F.col(f"_part_{name}")).over(before).alias(f"_carry_{name}")
        for name, (kind, _) in measures.items()])
    inside = (Window.partitionBy(*keys, CHUNK).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    local = rows.select("*", *[_fold(kind, value).over(inside).alias(f"_local_{name}")
                               for name, (kind, value) in measures.items()])
    joined = local.join(carry, [*keys, CHUNK], "left")
    out = joined.select("*", *[
        _join_both(kind, F.col(f"_carry_{name}"), F.col(f"_local_{name}")).alias(name)
        for name, (kind, _) in measures.items()])
    drop = [CHUNK] + [f"_{part}_{name}" for part in ("carry", "local") for name in measures]
    return out.drop(*drop)


def timed_prefix(df: DataFrame, keys: Sequence[str], measures: Measures, ts: str = "ts",
                 tie: str = "event_id") -> DataFrame:
    """``prefix`` along the time; rows without a time come after all others."""
    bucket = timed_bucket(ts, [tie], chunk_seconds(df.sparkSession))
    return prefix(df, keys, [F.col(ts), F.col(tie)], bucket, measures)


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column,
              name: str = INDEX) -> DataFrame:
    """Zero-based position of each row within its key."""
    return prefix(df, keys, order, bucket, {name: ("count", F.lit(1))})


def timed_index(df: DataFrame, keys: Sequence[str], ts: str = "ts", tie: Sequence[str] = ("event_id",),
                name: str = INDEX) -> DataFrame:
    """Position along the time; rows without a time come after all others."""
    bucket = timed_bucket(ts, tie, chunk_seconds(df.sparkSession))
    return row_index(df, keys, [F.col(ts), *[F.col(t) for t in tie]], bucket, name)


def over_rows(df: DataFrame, keys: Sequence[str], back: int, columns: dict[str, object],
              index: str = INDEX, block: int | None = None) -> DataFrame:
    """Evaluate ROWS-frame expressions that look at most ``back`` rows behind.

    Rows are dealt into blocks of equal length by their position; the last ``back`` rows of a block
    are also sent to the next one. ``columns`` maps a name to ``window -> Column``, where the window
    is ordered by position inside the block.
    """
    size = max(block or block_rows(df.sparkSession), back, 1)
    own = F.expr(f"{index} div {size}")
    spill = F.expr(f"({index} + {back}) div {size}")
    rows = df.withColumn("_own", own).withColumn(BLOCK, F.explode(F.sequence(own, spill)))
    frame = Window.partitionBy(*keys, BLOCK).orderBy(index)
    out = rows.select("*", *[build(frame).alias(name) for name, build in columns.items()])
    return out.where(F.col(BLOCK) == F.col("_own")).drop(BLOCK, "_own")


def over_time(df: DataFrame, keys: Sequence[str], back_seconds: int, columns: dict[str, object],
              ts: str = "ts", tie: Sequence[str] = ("event_id",)) -> DataFrame:
    """Evaluate RANGE-frame expressions that look at most ``back_seconds`` behind.

    ``columns`` maps a name to ``(row window, range window) -> Column``. A row goes to its own time
    chunk and to every chunk that its look-back window reaches into. A row without a time is alone in a
    chunk of its own, so that nothing is before it.
    """
    seconds = max(chunk_seconds(df.sparkSession), back_seconds)
    own = F.coalesce(time_bucket(ts, seconds), F.lit(TIMELESS) + F.monotonically_increasing_id())
    spill = F.expr(f"coalesce((unix_micros({ts}) + {back_seconds * MICROS}) div {seconds * MICROS}, _own)")
    rows = (df.withColumn("_own", own).withColumn(CHUNK, F.explode(F.sequence(F.col("_own"), spill)))
            .withColumn("_micros", F.unix_micros(F.col(ts))))
    ordered = Window.partitionBy(*keys, CHUNK).orderBy(ts, *tie)
    ranged = Window.partitionBy(*keys, CHUNK).orderBy("_micros")
    step = rows.withColumn("_row", F.row_number().over(ordered))
    out = step.select("*", *[build(ordered, ranged).alias(name) for name, build in columns.items()])
    return out.where(F.col(CHUNK) == F.col("_own")).drop(CHUNK, "_own", "_micros", "_row")


def sessions(df: DataFrame, keys: Sequence[str], gap_seconds: int, ts: str = "ts",
             tie: Sequence[str] = ("event_id",), name: str = "session") -> DataFrame:
    """Number the clusters of a key; a new one starts when the gap is longer than ``gap_seconds``."""
    marked = over_time(df, keys, gap_seconds, {
        "_new": lambda rows, _: F.when(
            F.lag(ts).over(rows).isNull()
            | (F.unix_micros(F.col(ts)) - F.unix_micros(F.lag(ts).over(rows)) > gap_seconds * MICROS), 1
        ).otherwise(0)}, ts, tie)
    bucket = timed_bucket(ts, tie, chunk_seconds(df.sparkSession))
    counted = prefix(marked, keys, [F.col(ts), *[F.col(t) for t in tie]], bucket,
                     {"_opened": ("sum", F.col("_new"))})
    return (counted.withColumn(name, (F.coalesce("_opened", F.lit(0)) + F.col("_new")).cast("bigint"))
            .drop("_opened", "_new"))
