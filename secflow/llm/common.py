"""Helpers that several text operators share."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from secflow.settings import checkpointed, checkpointed_lean

#: Rows whose crc32(doc_id as text) mod 4 is this are never learned from.
HELD_OUT = 2
#: A key with more than 1/HOT_PARTS of all rows counts as hot, so there are fewer than HOT_PARTS hot keys.
HOT_PARTS = 256


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True where a row is kept for measuring and never learned from; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


ROW_KEY = "struct<id:bigint,text:bigint>"


def row_key() -> Column:
    """What tells documents apart: the id, null as the largest, and a hash of the text for ids that repeat."""
    return F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"),
                    F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text"))


def text_slices(texts: list[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of rows of about ``limit`` characters; a longer text is a run of its own."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def map_text(df: DataFrame, text: str, fn: Callable[[list[str]], dict[str, list]], schema: str,
             keep: dict[str, str], limit: int = 1 << 20) -> DataFrame:
    """Apply ``fn`` to runs of texts (null: empty) and put its columns beside the columns ``keep`` (name: type).

    ``schema`` names the columns of ``fn``. The Arrow types follow from the Spark types.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    full = ", ".join([*(f"`{n}` {t}" for n, t in keep.items()), schema])
    arrow = to_arrow_schema(StructType.fromDDL(full))
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            for a, b in text_slices(texts, limit):
                got = fn([t or "" for t in texts[a:b]])
                columns = [batch.column(n)[a:b] if n in names else got[n] for n in arrow.names]
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type)
                     for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.select(*[F.col(n) for n in names], F.col(text).alias("_text")).mapInArrow(run, full)


def bucket_of(key: Column, bounds: list, kind: str) -> Column:
    """How many of the sorted ``bounds`` are at or below ``key``; two short scans instead of one long one.

    ``kind`` is the Spark type of a bound; the bounds travel as one constant that Spark folds.
    """
    if not bounds:
        return F.lit(0)
    width = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[i:i + width] for i in range(0, len(bounds), width)]
    heads = F.from_json(F.lit(json.dumps([b[0] for b in blocks])), f"array<{kind}>")
    rows = F.from_json(F.lit(json.dumps(blocks)), f"array<array<{kind}>>")
    block = F.size(F.filter(heads, lambda b: b <= key))
    inside = F.size(F.filter(F.element_at(rows, F.greatest(block, F.lit(1))), lambda b: b <= key))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * width + inside)


def attach(left: DataFrame, right: DataFrame, key: str, values: list[str], spread: str) -> DataFrame:
    """Left outer join to a table with one row per key, whole also when one key holds a third of all rows.

    ``right`` is stored and has ``n_rows``, the number of left rows of each key. Keys above a share of
    1/HOT_PARTS of the rows are fewer than HOT_PARTS by counting, so their values are broadcast; rows of
    such keys are dealt out by ``spread`` in the shuffle that joins all other keys.
    """
    total = right.agg(F.sum("n_rows")).first()[0] or 0
    hot = F.col("n_rows") > max(1000, total // HOT_PARTS)
    packed = F.struct(*[F.col(v) for v in values])
    hot_side = right.where(hot).select(F.col(key).alias("_hk"), packed.alias("_hot"))
    cold_side = right.where(~hot).select(F.col(key).alias("_ck"), F.lit(0).alias("_cs"), packed.alias("_cold"))
    marked = left.join(F.broadcast(hot_side), F.col(key) == F.col("_hk"), "left")
    is_hot = F.col("_hot").isNotNull()
    marked = (marked.withColumn("_jk", F.when(~is_hot, F.col(key)))
              .withColumn("_js", F.when(is_hot | F.col(key).isNull(), F.abs(F.hash(F.col(spread)) % 100_000) + 1)
                          .otherwise(0)))
    joined = marked.join(cold_side, (F.col("_jk") == F.col("_ck")) & (F.col("_js") == F.col("_cs")), "left")
    got = F.coalesce(F.col("_hot"), F.col("_cold"))
    for v in values:
        joined = joined.withColumn(f"_v_{v}", got[v])
    return joined.select(*[F.col(c) for c in left.columns], *[F.col(f"_v_{v}").alias(v) for v in values])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that can be reached over the edges (a, b), for every node on an edge.

    Each round gives a node the smallest label among its neighbours and then the label of that label, so
    chains shorten by more than half. Labels are stored after each round; nothing is collected but a count.
    """
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = checkpointed(edges.where("a <> b").select(F.explode(ends).alias("e")).select("e.a", "e.b").distinct())
    labels = checkpointed_lean(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                               .select("node", F.least("node", "m").alias("root")))
    if both.isEmpty():
        return labels
    for _ in range(rounds):
        near = (both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near")))
        step = (labels.join(near, labels.node == near.a)
                .select("node", "root", F.least("root", "near").alias("to")))
        jump = labels.select(F.col("node").alias("to"), F.col("root").alias("far"))
        new = checkpointed_lean(step.join(jump, "to", "left")
                                .select("node", F.least("to", F.coalesce("far", "to")).alias("root"),
                                        (F.col("root") != F.least("to", F.coalesce("far", "to"))).alias("moved")))
        labels = new.drop("moved")
        if new.where("moved").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def first_of_each(df: DataFrame, by: list[str], order: list[Column], k: int, place: str) -> DataFrame:
    """The first ``k`` rows of each group with their ``place``; Spark cuts groups to ``k`` rows before the shuffle, too."""
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(place, F.row_number().over(window)).where(F.col(place) <= k)


def blocks(stored: DataFrame, key: str, weight: Column, most: int) -> list[DataFrame]:
    """A stored query set in blocks whose ``weight`` is at most twice ``most``, or that are one row."""
    n = max(1, -(-(stored.agg(F.sum(weight)).first()[0] or 0) // most))
    place = F.xxhash64(key)
    while n > 1:
        sizes = stored.groupBy(F.pmod(place, F.lit(n))).agg(F.sum(weight).alias("held"), F.count("*").alias("rows"))
        if not sizes.where((F.col("held") > 2 * most) & (F.col("rows") > 1)).limit(1).count():
            break
        n *= 2
    return [stored.where(F.pmod(place, F.lit(n)) == b) for b in range(n)] if n > 1 else [stored]


class Best:
    """The ``k`` best rows of each slot so far: highest score, then smallest id, then row number.

    ``held`` are their slots, scores, ids and rows; a score below ``least`` of its slot is of no use any more.
    """

    def __init__(self, k: int, least: np.ndarray) -> None:
        self.k, self.held, self.least = k, np.empty((4, 0), np.int64), least
        self.last = np.full(len(least), np.iinfo(np.int64).max)

    def add(self, scores: np.ndarray, slots: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Offer rows with scores by (row, slot)."""
        least = self.least[slots]
        r, s = np.nonzero((scores > least) | ((scores == least) & (ids[:, None] <= self.last[slots])))
        if not len(r):
            return
        slot, score, doc, row = held = np.concatenate(
            [self.held, np.stack([slots[s], scores[r, s], ids[r], rows[r]])], 1)
        held = held[:, np.lexsort((row, doc, -score, slot))]
        opens = np.flatnonzero(np.r_[True, held[0, 1:] != held[0, :-1]])
        place = np.arange(held.shape[1]) - np.repeat(opens, np.diff(np.r_[opens, held.shape[1]]))
        self.held, last = held[:, place < self.k], held[:, place == self.k - 1]
        self.least[last[0]], self.last[last[0]] = last[1], last[2]
