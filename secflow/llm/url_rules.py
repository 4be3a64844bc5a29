"""Allow and block rules on page addresses: a sort-merge join of points and nested intervals.

A rule's host covers itself and all subdomains. With the labels of a host reversed and each closed by a
separator, ``example.org`` becomes ``org.example.`` and a rule's host becomes a prefix, hence an interval of
the sorted keys. Prefix intervals lie inside each other or apart, so one walk over the sorted keys with a
stack of open intervals finds every rule whose host fits; the path is then looked up among that host's rules.

Scale: pages are cut into ranges of the key by sampled bounds (they only decide balance). A key ends with a
hash of the page, so a host or even one address that holds a third of all pages spreads over many ranges. A
rule is copied to each range its interval meets; as intervals nest, a bound is crossed by at most as many
rules as are nested there. One shuffle, bounded memory: a stack and one batch per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secflow.llm.common import bucket_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Closes a label in a key, and the first key behind all keys that begin with a closed label.
CLOSE, BEHIND = "\x01", "\x02"
#: Sampled keys per range.
SAMPLES = 60

JUDGED = "page_id long, host string, path string, rule string, verdict string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of an address; both empty for null or without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _reversed(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), CLOSE), F.lit(CLOSE))


def _sweep(default: str):
    """Walk rows sorted by (bucket, key); rules come before pages of the same key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, stack = None, []  # of (host prefix of keys, host, {path: verdict}, lengths of its paths)
        for batch in batches:
            c = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            out: list[list] = [[], [], [], [], []]
            for b, key, is_page, page_id, host, path, verdict in zip(
                    c["bucket"], c["key"], c["is_page"], c["page_id"], c["host"], c["path"], c["verdict"],
                    strict=True):
                if b != bucket:
                    bucket, stack = b, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if not is_page:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, host, {}, []))
                    paths = stack[-1][2]
                    if paths.get(path) != "block":
                        paths[path] = verdict
                    stack[-1][3][:] = sorted({len(p) for p in paths}, reverse=True)
                    continue
                best, rule, said = -1, None, default
                for _, rule_host, paths, lengths in reversed(stack):
                    if host != rule_host and not host.endswith("." + rule_host):
                        continue
                    for n in lengths:
                        if n <= len(path) and path[:n] in paths:
                            if len(rule_host) + n > best:
                                best, rule, said = len(rule_host) + n, rule_host + path[:n], paths[path[:n]]
                            break
                for column, value in zip(out, (page_id, host, path, rule, said), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), *[pa.array(x, pa.string()) for x in out[1:]]],
                names=["page_id", "host", "path", "rule", "verdict"])

    return run


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Judge every row of ``pages`` (page_id, url) by ``rules`` (host, path, verdict).

    The longest fitting rule wins, counted in characters of host and path; of two equally long ones the one
    with the longer host, of two equal ones the block. Without a fitting rule: null and ``default``.
    Null urls and urls without ``://`` have an empty host and path and fit no rule. Null page ids and
    repeated rows stay, each with its own verdict. A null path of a rule is empty; rules without host or
    verdict are ignored. Empty tables give empty results; other columns are not looked at.
    """
    host, path = host_and_path(F.col("url"))
    points = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"),
                          F.col("url").alias("_url"))
    points = points.select("page_id", "host", "path", F.concat(
        _reversed(F.col("host")), F.col("path"), F.lit("\0"), F.hex(F.xxhash64("page_id", "_url"))).alias("key"))
    ranges = 2 * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = pages.count()
    sample = points.sample(min(1.0, ranges * SAMPLES / max(total, 1)), 7)
    keys = sorted(r[0] for r in sample.select("key").collect())
    bounds = sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []

    clean = (rules.where("host is not null and host <> '' and verdict is not null")
             .select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"),
                     "verdict").distinct())
    low = _reversed(F.col("host"))
    behind = F.concat(F.array_join(F.reverse(F.split("host", r"\.")), CLOSE), F.lit(BEHIND))
    spans = (clean.withColumn("key", low)
             .withColumn("bucket", F.explode(F.sequence(
                 bucket_of(F.col("key"), bounds, "string"), bucket_of(behind, bounds, "string")))))
    rows = spans.select("bucket", "key", F.lit(False).alias("is_page"), F.lit(None).cast("long").alias("page_id"),
                        "host", "path", "verdict")
    rows = rows.unionByName(points.select(
        bucket_of(F.col("key"), bounds, "string").alias("bucket"), "key", F.lit(True).alias("is_page"), "page_id",
        "host", "path", F.lit(None).cast("string").alias("verdict")))
    # The path orders rules of one host; every rule of a host stands before the host's pages.
    return (rows.repartition(ranges, "bucket").sortWithinPartitions("bucket", "key", "is_page", "path")
            .mapInArrow(_sweep(default), JUDGED))
