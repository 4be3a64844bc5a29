"""Run-time settings read from the Spark session.

Every setting has a default that suits a laptop; a cluster sets its own.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MICROS = 1_000_000
#: Whether Spark removes the shuffle files of an action when it ends. A plan takes the value at the time it is made.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def _conf(spark: SparkSession, key: str, default: str) -> str:
    value = spark.conf.get(key, None)
    return default if value in (None, "") else value


def chunk_seconds(spark: SparkSession) -> int:
    """Width of the time chunks that split the rows of one hot key.

    Pick it so that the busiest key stays in the low millions of rows per chunk:
    one day suits the test tables, one minute suits tens of billions of rows a month.
    """
    return int(_conf(spark, "secflow.chunk.seconds", "86400"))


def block_rows(spark: SparkSession) -> int:
    """Most rows of one key that a single Python group may hold."""
    return int(_conf(spark, "secflow.block.rows", "50000"))


def broadcast_limit(spark: SparkSession) -> int:
    """Largest number of rows of a small side that may be broadcast."""
    return int(_conf(spark, "secflow.broadcast.rows", "200000"))


def small_side(df: DataFrame) -> DataFrame:
    """Broadcast ``df`` only when a bounded count proves that it is small.

    The count stops one row past the limit, so the check never scans a large table to the end.
    Past the limit the frame comes back as it is and Spark shuffles both sides.
    """
    limit = broadcast_limit(df.sparkSession)
    if df.limit(limit + 1).count() <= limit:
        return F.broadcast(df)
    return df


def _shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where driver and executors are one process."""
    folder = _conf(spark, "spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="secflow-")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder of the cluster."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_shared_folder(df.sparkSession))
    return df.checkpoint()


def lean(df: DataFrame) -> DataFrame:
    """The same rows by a plan that drops the files of its shuffles when an action over it ends.

    Otherwise they go when the driver happens to collect its garbage. Not for plans of which a side with shuffles of its
    own may turn out useless: Spark can end such a plan while that side runs, which then fails and is tried again.
    """
    spark = df.sparkSession
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        return df.select("*")
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


def checkpointed_lean(df: DataFrame) -> DataFrame:
    """``checkpointed``, with the files of the shuffles that led to the rows gone at once; see ``lean``."""
    return checkpointed(lean(df))


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh place for a written table in the shared folder."""
    return f"{_shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

