"""Shards of nearly equal bytes by a histogram sort.

Rows are ordered by (hash of the text, id). The bytes below candidate keys are counted exactly over all
partitions, round after round with finer candidates around each wanted splitter, until every splitter is
within tolerance or cannot be refined. Only then rows move, once, to ranges between splitters.

Equal texts have one hash and stand together. A splitter goes between two hashes if that meets the
tolerance, so groups of copies stay whole; a group too large for that is cut by id.

Scale: a round sends one row per candidate and task, whatever the data; candidates are a few hundred. Each
shard is cut further into ranges at counted candidates, so positions inside a shard come from a running
number inside a small range plus a count that the histogram already holds.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secflow.llm.common import bucket_of
from secflow.settings import checkpointed

Key = tuple[int, int]
LOW, HIGH = -(1 << 63), (1 << 63) - 1
#: Candidates of the first round, and around one splitter in a later round.
FIRST, FINER = 1023, 31


@dataclass
class Histogram:
    """Exact rows and bytes below each counted key."""

    below: dict[Key, tuple[int, int]]

    def count(self, rows: DataFrame, probes: list[Key]) -> None:
        probes = sorted({p for p in probes if p not in self.below})
        if not probes:
            return
        got = {r[0]: (r[1], r[2]) for r in rows.groupBy(_place(probes).alias("place")).agg(
            F.count("*"), F.sum("_size")).collect()}
        n = size = 0
        for i, probe in enumerate(probes):
            n, size = n + got.get(i, (0, 0))[0], size + got.get(i, (0, 0))[1]
            self.below[probe] = (n, size)


def _place(bounds: list[Key], key: str = "_key", tie: str = "_tie") -> Column:
    pair = F.struct(F.col(key).alias("k"), F.col(tie).alias("t"))
    return bucket_of(pair, [{"k": k, "t": t} for k, t in bounds], "struct<k:bigint,t:bigint>")


def _nth(values: list[int], kind: str, place: str) -> Column:
    return F.element_at(F.from_json(F.lit(json.dumps(values)), f"array<{kind}>"), F.col(place) + 1)


def _between(low: int, high: int, n: int) -> list[int]:
    """Up to ``n`` whole numbers strictly between ``low`` and ``high``, evenly spaced."""
    return sorted({low + (high - low) * i // (n + 1) for i in range(1, n + 1)} - {low, high})


def _finer(a: Key, b: Key, ties: tuple[int, int]) -> list[Key]:
    """Fresh candidates strictly between two counted keys; none if there is nothing between them."""
    if a[0] == b[0] or b == (a[0] + 1, LOW):  # between two ids of one text
        bottom, top = max(a[1], ties[0]), b[1] if a[0] == b[0] else ties[1] + 1
        fresh = [(a[0], t) for t in {bottom, top, *_between(bottom, top, FINER)}]
    else:
        fresh = [(k, LOW) for k in {*_between(a[0], b[0], FINER), a[0] + 1, b[0]}]
    return [p for p in fresh if a < p < b]


def splitters(rows: DataFrame, shards: int, ranges: int, tolerance: float) -> tuple[list[Key], Histogram]:
    """``shards - 1`` keys that cut the bytes evenly, and all that was counted on the way.

    Between two counted keys there are at most twice the rows of an even range, unless they are one row or
    rows that cannot be told apart.
    """
    total, count, low_tie, high_tie = rows.agg(
        F.coalesce(F.sum("_size"), F.lit(0)), F.count("*"), F.coalesce(F.min("_tie"), F.lit(0)),
        F.coalesce(F.max("_tie"), F.lit(0))).first()
    hist = Histogram({(LOW, LOW): (0, 0), (HIGH, HIGH): (count, total)})
    hist.count(rows, [(k, LOW) for k in _between(LOW, HIGH, max(FIRST, 4 * ranges))])
    slack = tolerance * total / shards
    goals = [total * i / shards for i in range(1, shards)]
    while True:
        known = sorted(hist.below)
        sizes = [hist.below[k][1] for k in known]
        probes: set[Key] = set()
        for goal in goals:
            at = min(max(1, bisect_left(sizes, goal)), len(known) - 1)
            if min(abs(sizes[at - 1] - goal), abs(sizes[at] - goal)) > slack:
                probes.update(_finer(known[at - 1], known[at], (low_tie, high_tie)))
        for a, b in zip(known, known[1:], strict=False):
            if hist.below[b][0] - hist.below[a][0] > max(1, 2 * count // ranges):
                probes.update(_finer(a, b, (low_tie, high_tie)))
        if not probes:
            break
        hist.count(rows, list(probes))
    chosen = [min(known, key=lambda k, g=g: (abs(hist.below[k][1] - g), k[1] != LOW)) for g in goals]
    return sorted(chosen), hist


def shard_by_bytes(docs: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id",
                   tolerance: float = 0.005) -> DataFrame:
    """All columns of ``docs`` plus size, shard and slot (gapless from 0 in its shard).

    size: UTF-8 bytes of the text (null: none) plus 1. Shard sizes differ from the mean by ``tolerance`` at
    each end, or by one row where a row is larger than that. Null texts count as empty, a null id as the
    smallest; rows equal in text and id stay in one shard in any order. An empty table gives an empty result.
    Columns of ``docs`` named size, shard or slot are replaced.
    """
    spark = docs.sparkSession
    own = "_"
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    k, t, z, r, n = (f"{own}{name}" for name in ("key", "tie", "size", "range", "row"))
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.withColumns({z: F.octet_length(body).cast("long") + 1, k: F.xxhash64(body),
                              t: F.coalesce(F.col(key).cast("long"), F.lit(LOW + 1))})
    narrow = checkpointed(keyed.select(F.col(k).alias("_key"), F.col(t).alias("_tie"), F.col(z).alias("_size")))
    ranges = max(1, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts, hist = splitters(narrow, shards, ranges, tolerance)
    known = sorted(hist.below)[1:-1]
    total = hist.below[(HIGH, HIGH)][0]
    finer, want = [], 1
    for probe in known:
        if hist.below[probe][0] >= want * total / ranges:
            finer.append(probe)
            want = hist.below[probe][0] * ranges // max(total, 1) + 1
    bounds = sorted({*cuts, *finer})
    start_rows = [0, *[hist.below[c][0] for c in cuts]]
    shard_of = [sum(c <= bound for c in cuts) for bound in [(LOW, LOW), *bounds]]
    offset_of = [hist.below[b][0] - start_rows[s] for b, s in zip([(LOW, LOW), *bounds], shard_of, strict=True)]
    window = Window.partitionBy(r).orderBy(k, t)
    out = keyed.withColumn(r, _place(bounds, k, t)).withColumn(n, F.row_number().over(window))
    return out.withColumns({"size": F.col(z), "shard": _nth(shard_of, "int", r),
                            "slot": F.col(n) - 1 + _nth(offset_of, "bigint", r)}).drop(k, t, z, r, n)
