"""Order-based splits and samples without a global single-task window."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secflow.operators.timeline import row_index
from secflow.plans.detection import with_scalar
from secflow.settings import block_rows, small_side


def even_bucket(rows: DataFrame, ts: str = "ts", limit: int | None = None) -> Column:
    """Number of the time range a row lies in; ranges hold about ``limit`` rows each, however the times gather.

    Their bounds are approximate quantiles, which only decide balance: any bounds are monotone in time.
    """
    micros = rows.select(F.unix_micros(F.col(ts)).alias("at")).where("at is not null")
    ranges = max(1, -(-rows.count() // (limit or block_rows(rows.sparkSession))))
    found = micros.approxQuantile("at", [i / ranges for i in range(1, ranges)], 0.25 / ranges) if ranges > 1 else []
    bounds = F.from_json(F.lit(json.dumps(sorted({int(x) for x in found}))), "array<bigint>")
    return F.size(F.filter(bounds, lambda b: b <= F.coalesce(F.unix_micros(F.col(ts)), F.lit(-(1 << 62)))))


def time_split(rows: DataFrame, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """Chronological split by position; cut points are truncated."""
    ranked = row_index(rows.withColumn("_all", F.lit(1)), ["_all"], [F.col("ts"), F.col("event_id")], even_bucket(rows))
    sized = with_scalar(ranked, rows.agg(F.count("*").alias("_n")))
    return sized.withColumn("split", F.expr(
        f"case when _idx < cast(_n * {train}D as bigint) then 'train' "
        f"when _idx < cast(_n * {train + validation}D as bigint) then 'validation' else 'test' end")
    ).drop("_all", "_n", "_idx")


def systematic_sample(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """Every k-th row of each file, k = max(1, rows / limit)."""
    ranked = row_index(rows, [key], [F.col("ts"), F.col("event_id")], even_bucket(rows))
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n"))
    return ranked.join(small_side(sizes), key).where(f"_idx % greatest(1, _n div {limit}) = 0").drop("_n")


def evaluable_window(rows: DataFrame) -> DataFrame:
    """Keep the rows up to the last attack and mark the rest as dropped."""
    last = rows.agg(F.max(F.expr("case when label = 1 then ts end")).alias("_last"))
    return with_scalar(rows, last).withColumn("kept", F.expr("ts <= _last")).drop("_last")


def hash_rank_split(rows: DataFrame, salt: str, share: float, key: str = "event_id") -> DataFrame:
    """Seeded membership by a portable hash; each row decides on its own, so no sort is needed."""
    return rows.withColumn("in_train", F.expr(
        f"cast(conv(substr(md5(cast(concat('{salt}', {key}) as binary)), 1, 7), 16, 10) as bigint) % 10000 < {int(share * 10000)}"))
