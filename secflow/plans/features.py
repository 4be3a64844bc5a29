"""The numeric event features and their train-side statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secflow.functions import scalars as s
from secflow.plans.behaviour import host_timeline
from secflow.plans.detection import with_scalar
from secflow.settings import checkpointed, small_side

FEATURES = [
    "bytes_out_log", "bytes_in_log", "bytes_ratio", "is_rare_port", "port_rarity", "cmd_len", "cmd_special_chars",
    "cmd_entropy", "user_rarity", "src_ip_rarity", "has_hash", "has_parent_cmd", "is_process", "is_network",
    "hour_sin", "hour_cos", "is_night", "events_in_window", "time_since_prev_log",
]
TEMPORAL = ["hour_sin", "hour_cos", "is_night", "events_in_window", "time_since_prev_log"]
RARITY = {"user_rarity": "coalesce(user, '')", "src_ip_rarity": "coalesce(src_ip, '')",
          "port_rarity": "coalesce(cast(dst_port as string), '')"}


def rarity_counts(train: DataFrame) -> DataFrame:
    """feature, value and n: how often each value occurs among the training events."""
    pairs = ", ".join(f"named_struct('feature', '{name}', 'value', {value})" for name, value in RARITY.items())
    return (train.select(F.explode(F.expr(f"array({pairs})")).alias("c")).groupBy("c.feature", "c.value")
            .agg(F.count("*").alias("n")))


def with_rarity(events: DataFrame, train: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """1 - share of the value among the training events; an unseen value has rarity 1.

    ``counts`` are stored ``rarity_counts``; otherwise ``train`` is counted once for all features.
    """
    counts = checkpointed(rarity_counts(train)) if counts is None else counts
    first = next(iter(RARITY))
    out = with_scalar(events, counts.where(F.col("feature") == first).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("_total")))
    for name, value in RARITY.items():
        side = counts.where(F.col("feature") == name).select(F.col("value").alias(f"_k_{name}"), F.col("n").alias(f"_n_{name}"))
        out = out.withColumn(f"_k_{name}", F.expr(value)).join(small_side(side), f"_k_{name}", "left")
        out = out.withColumn(name, F.expr(
            f"case when _total = 0 then 0D else 1D - coalesce(_n_{name}, 0) / _total end"))
    return out.drop("_total", *[f"_{p}_{n}" for n in RARITY for p in ("k", "n")])


def features(events: DataFrame, train: DataFrame, window_seconds: int = 300,
             counts: DataFrame | None = None) -> DataFrame:
    """One row per event. An event without a time has no burst, the default gap and no hour (both parts 0)."""
    timed = host_timeline(events, window_seconds)
    rare = with_rarity(timed.withColumnRenamed("events_in_window", "_burst"), train, counts)
    flag = "cast({} as int) * 1D"
    # Normalised events carry a map of hashes and the parent's command line; plain tables may have single columns.
    has_hash = "coalesce(size(hashes) > 0, false)" if "hashes" in events.columns else "md5 is not null"
    parent = "properties['parent_command_line']" if "properties" in events.columns else "parent_process"
    return rare.selectExpr(
        "event_id", "ts", *[c for c in ("label", "attack_cat") if c in events.columns],
        f"{s.log_volume('bytes_out')} as bytes_out_log", f"{s.log_volume('bytes_in')} as bytes_in_log",
        f"{s.bytes_ratio()} as bytes_ratio", f"{flag.format(s.rare_port())} as is_rare_port", "port_rarity",
        "cast(length(coalesce(command_line, '')) as double) as cmd_len",
        f"cast({s.special_chars('command_line')} as double) as cmd_special_chars",
        f"{s.entropy('command_line')} as cmd_entropy", "user_rarity", "src_ip_rarity",
        f"{flag.format('(' + has_hash + ')')} as has_hash", f"{flag.format('(' + parent + ' is not null)')} as has_parent_cmd",
        "if(category = 'process', 1D, 0D) as is_process", "if(category = 'network', 1D, 0D) as is_network",
        f"coalesce(sin({s.hour_angle()}), 0D) as hour_sin", f"coalesce(cos({s.hour_angle()}), 0D) as hour_cos",
        f"coalesce({flag.format(s.is_night())}, 0D) as is_night", "log1p(_burst) as events_in_window",
        "log1p(since_prev) as time_since_prev_log")


def standardized(rows: DataFrame, train: DataFrame, names: list[str] = FEATURES) -> DataFrame:
    """(x - mean) / population std of the training rows; a near-constant feature is divided by 1."""
    stats = train.selectExpr(*[f"avg({n}) as _m_{n}" for n in names],
                             *[f"stddev_pop({n}) as _s_{n}" for n in names])
    kept = [c for c in rows.columns if c not in names]
    return with_scalar(rows, stats).selectExpr(*kept, *[
        f"({n} - _m_{n}) / if(_s_{n} < 1e-5D, 1D, _s_{n}) as {n}" for n in names])


def top_features(names: list[str] = FEATURES, k: int = 3) -> str:
    """The k largest deviations of a standardised row, as SQL text."""
    pairs = ", ".join(f"named_struct('dev', abs({n}), 'name', '{n}')" for n in names)
    return f"slice(sort_array(array({pairs}), false), 1, {k})"
