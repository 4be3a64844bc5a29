from __future__ import annotations

import os
import time

from pyspark.sql import functions as F

from secflow.settings import DROP_SHUFFLES, checkpointed_lean


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f"{d}/{x}" for top in dirs for d, _, names in os.walk(top) for x in names if x.startswith("shuffle_")}


def left_over(spark, before, seconds=10):
    """Shuffle files since ``before`` that do not go by themselves; Spark removes them in the background."""
    until = time.time() + seconds
    while (more := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.1)
    return more


def test_a_stored_table_leaves_no_shuffle_files(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("k"))
    before, was = shuffle_files(spark), spark.conf.get(DROP_SHUFFLES)
    sums = rows.groupBy("k").agg(F.sum("id").alias("s"))
    stored = checkpointed_lean(sums.join(rows.groupBy("k").count().hint("merge"), "k"))
    assert not left_over(spark, before)
    assert spark.conf.get(DROP_SHUFFLES) == was
    want = {k: (sum(range(k, 1000, 7)), len(range(k, 1000, 7))) for k in range(7)}
    assert {r["k"]: (r["s"], r["count"]) for r in stored.collect()} == want
    assert {r["k"]: r["s"] for r in sums.collect()} == {k: s for k, (s, _) in want.items()}


def test_a_table_used_before_and_after_it_is_stored_stays_whole(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("k")).repartition(4, "k")
    assert rows.count() == 1000
    assert checkpointed_lean(rows).count() == 1000 and rows.count() == 1000
    assert len(checkpointed_lean(rows.groupBy("k").count()).collect()) == 7 and len(rows.collect()) == 1000
