"""The fitted anomaly model: a stored, versioned forest with all that is needed to score new events.

A version is a folder of small tables: the forest's nodes, the standardisation, the value counts for rarity, and one
row that says which features in which order. Versions are written once and never changed; the newest complete one
counts. Scoring is one pass: features, standardisation and all trees run over the events as they are read, and the
score is joined to other signals by ``event_id``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secflow.plans import features as ft
from secflow.plans import forest
from secflow.plans.detection import with_scalar
from secflow.settings import checkpointed

WINDOW = 300
TABLES = ("nodes", "scaler", "rarity", "about")


def statistics(rows: DataFrame, names: list[str]) -> DataFrame:
    """feature, mean and scale of the training rows; a near-constant feature is divided by 1."""
    sums = rows.agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names])
    each = ", ".join(f"named_struct('feature', '{n}', 'mean', m_{n}, 'scale', if(s_{n} < 1e-5D, 1D, s_{n}))" for n in names)
    return sums.select(F.explode(F.expr(f"array({each})")).alias("c")).select("c.*")


def _paths(spark: SparkSession, folder: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete versions, ascending; ``about`` is written last."""
    files, at = _paths(spark, folder)
    if not files.exists(at):
        return []
    found = []
    for entry in files.listStatus(at):
        name = entry.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "about/_SUCCESS")
        if name.startswith("version=") and files.exists(done):
            found.append(int(name.removeprefix("version=")))
    return sorted(found)


def fit(events: DataFrame, train: str, folder: str, window_seconds: int = WINDOW, names: list[str] = ft.FEATURES,
        **forest_options: int) -> int:
    """Fit on the events for which the condition ``train`` holds, write a new version and return its number.

    The histories of the features run over all events; what is learnt (counts, scale, trees) comes from the
    training events. With fewer than five of them the forest is empty and scores 0.
    """
    spark = events.sparkSession
    chosen = events.where(train)
    counts = checkpointed(ft.rarity_counts(chosen))
    number = (versions(spark, folder) or [0])[-1] + 1
    path = f"{folder}/version={number}"
    made = ft.features(events, chosen, window_seconds, counts)
    rows = checkpointed(made.join(chosen.select("event_id"), "event_id", "left_semi").select("event_id", *names))
    counts.write.mode("overwrite").parquet(f"{path}/rarity")
    statistics(rows, names).write.mode("overwrite").parquet(f"{path}/scaler")
    scaler = spark.read.parquet(f"{path}/scaler")
    nodes, expected = forest.fit(scaled(rows, scaler, names), list(names), **forest_options)
    schema = "tree int, node int, feature int, cut double, low int, high int, depth double"
    spark.createDataFrame(nodes.astype(object).values.tolist(), schema).write.mode("overwrite").parquet(f"{path}/nodes")
    about = [(number, list(names), float(expected), window_seconds)]
    spark.createDataFrame(about, "version int, features array<string>, expected double, window_seconds int").write.mode(
        "overwrite").parquet(f"{path}/about")
    return number


def scaled(rows: DataFrame, scaler: DataFrame, names: list[str]) -> DataFrame:
    """(x - mean) / scale with the stored numbers, one row for each feature."""
    one = scaler.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("feature", "mean"))).alias("_m"),
                               F.map_from_entries(F.collect_list(F.struct("feature", "scale"))).alias("_s"))
    kept = [c for c in rows.columns if c not in names]
    return with_scalar(rows, one).selectExpr(*kept, *[f"({n} - _m['{n}']) / _s['{n}'] as {n}" for n in names])


def load(spark: SparkSession, folder: str, version: int | None = None) -> dict:
    """Tables and settings of a version, the newest one by default."""
    known = versions(spark, folder)
    number = known[-1] if version is None else version
    if number not in known:
        raise ValueError(f"no version {number} in {folder}")
    path = f"{folder}/version={number}"
    return {t: spark.read.parquet(f"{path}/{t}") for t in TABLES} | {"version": number}


def scores(events: DataFrame, model: dict) -> DataFrame:
    """event_id, anomaly_score (0 to 1) and model_version of every event.

    The nodes are broadcast: at most trees * 2 * sample rows, whatever the forest was fitted on.
    """
    about = model["about"].first()
    names = list(about["features"])
    rows = ft.features(events, events, about["window_seconds"], model["rarity"])
    nodes: pd.DataFrame = model["nodes"].toPandas().sort_values(["tree", "node"]).reset_index(drop=True)
    ready = scaled(rows.select("event_id", *names), model["scaler"], names)
    return forest.score(ready, (nodes, about["expected"]), names).select(
        "event_id", F.col("forest_score").alias("anomaly_score"), F.lit(model["version"]).alias("model_version"))


def with_scores(events: DataFrame, model: dict) -> DataFrame:
    """The events with ``anomaly_score`` from the model in place of any they had."""
    return events.drop("anomaly_score", "model_version").join(scores(events, model), "event_id")
