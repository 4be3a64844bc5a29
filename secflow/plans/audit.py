"""Hash-chained audit rows: building and verifying, and order-independent table digests."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secflow.operators.blocks import fold_rows
from secflow.operators.timeline import over_rows

GENESIS = "0" * 64
PAYLOAD = ("concat('{\"action\":\"', action, '\",\"actor\":\"', actor, '\",\"detail\":\"', detail, '\",\"index\":', idx, "
           "',\"prev_hash\":\"', prev_hash, '\",\"timestamp\":\"', at, '\"}')")


def build_chain(rows: DataFrame, segment_rows: int = 100_000) -> DataFrame:
    """Chain the rows (run, idx, at, actor, action, detail) of each run.

    A hash chain is sequential by nature, so its length is bounded: a run is cut after
    ``segment_rows`` entries and the next segment starts from genesis again. Segments are the
    parallel unit; ``seal`` ties them together.
    """
    cut = rows.withColumn("segment", F.expr(f"idx div {segment_rows}"))

    def step(prev: str, action: str, actor: str, detail: str, idx: int, at: str):
        body = (f'{{"action":"{action}","actor":"{actor}","detail":"{detail}","index":{idx},'
                f'"prev_hash":"{prev}","timestamp":"{at}"}}')
        digest = hashlib.sha256(body.encode()).hexdigest()
        return digest, (prev, digest)

    return fold_rows(cut, ["run", "segment"], ["idx"], ["action", "actor", "detail", "idx", "at"], step, GENESIS,
                     cut.columns, {"prev_hash": "string", "entry_hash": "string"})


def anchors(chained: DataFrame) -> DataFrame:
    return chained.groupBy("run", "segment").agg(F.count("*").alias("rows"), F.max_by("entry_hash", "idx").alias("last_hash"))


def seal(anchor: DataFrame) -> DataFrame:
    """A second chain over the segments of each run: a link covers the link before it, the segment's last hash
    and its length, so no segment can be left out, moved or replaced. One row per segment is walked."""
    def step(prev: str, segment: int, rows: int, last_hash: str):
        link = hashlib.sha256(f"{prev}|{segment}|{rows}|{last_hash}".encode()).hexdigest()
        return link, (prev, link)

    return fold_rows(anchor, ["run"], ["segment"], ["segment", "rows", "last_hash"], step, GENESIS, anchor.columns,
                     {"prev_link": "string", "link": "string"})


def verify_seal(sealed: DataFrame, ends: DataFrame) -> DataFrame:
    """First bad segment per run, if any, against ``ends`` (run, segments, link): the number of segments and the
    last link that were noted when the run was sealed."""
    linked = over_rows(sealed, ["run"], 1, {"_before": lambda w: F.lag("link").over(w)}, index="segment")
    bad = linked.withColumn("_bad", F.expr(
        f"prev_link <> coalesce(_before, '{GENESIS}') or link <> sha2(concat_ws('|', prev_link, segment, rows, last_hash), 256)"))
    per_run = bad.groupBy("run").agg(F.min(F.expr("if(_bad, segment, null)")).alias("bad_segment"),
                                     F.count("*").alias("_n"), F.max_by("link", "segment").alias("_last"))
    return ends.join(per_run, "run", "left").selectExpr(
        "run", "bad_segment", "coalesce(bad_segment is null and _n = segments and _last = link, false) as valid")


def verify_chain(chained: DataFrame, anchor: DataFrame) -> DataFrame:
    """First bad row and its reason per run, checked row by row in parallel, then the anchor."""
    linked = over_rows(chained.withColumn("_key", F.struct("run", "segment")), ["_key"], 1, {
        "_before": lambda w: F.lag("entry_hash").over(w)}, index="idx")
    checked = linked.withColumn("_bad", F.expr(
        f"case when prev_hash <> coalesce(_before, '{GENESIS}') then 'broken link' "
        f"when entry_hash <> sha2({PAYLOAD}, 256) then 'changed entry' end"))
    per_run = checked.groupBy("run", "segment").agg(
        F.min(F.when(F.col("_bad").isNotNull(), F.struct("idx", "_bad"))).alias("_first"), F.count("*").alias("_n"),
        F.max_by("entry_hash", "idx").alias("_last"))
    both = anchor.join(per_run, ["run", "segment"], "left")
    return both.selectExpr(
        "run", "segment", "_first.idx as bad_index",
        "case when _first is not null then _first._bad when coalesce(_n, 0) <> rows then 'truncated' "
        "when _last <> last_hash then 'anchor mismatch' end as reason").withColumn("valid", F.expr("reason is null"))


def table_digest(rows: DataFrame, fields: list[str]) -> DataFrame:
    """One digest of a whole table that does not depend on row order or partitioning.

    Row hashes are cut into four numbers and added up, which combines before the shuffle; nothing is
    sorted or collected.
    """
    text = "concat_ws('|', " + ", ".join(f"coalesce(cast({f} as string), 'None')" for f in fields) + ")"
    hashed = rows.selectExpr(f"sha2({text}, 256) as h")
    sums = [F.sum(F.expr(f"cast(conv(substr(h, {1 + 15 * i}, 15), 16, 10) as decimal(20, 0))")).cast("string")
            for i in range(4)]
    return hashed.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws("-", *sums), 256).alias("digest"))
