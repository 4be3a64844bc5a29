"""Secret scan with corpus-wide ownership frequency.

Candidates are found by fixed patterns in every text. A value that many owners and repositories carry was
copied from an example; a value that few carry looks like a live credential of its owner. The numbers of
distinct owners and repositories are counted over the whole corpus.

Scale: texts are read once; afterwards only (row, place, hash of the value) moves. Counting first reduces
each task's rows to distinct (value, owner, repository), so a value that a third of all rows carry sends at
most one row per task, owner and repository; the way back uses ``attach``, which deals such a value out.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secflow.llm.common import ROW_KEY, attach, map_text, row_key
from secflow.settings import checkpointed

# The three base kinds with the least length of what they capture, in the order of the result.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                          re.IGNORECASE | re.ASCII), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]{16,}"), 0, 16),  # the longest runs; shorter ones would be dropped anyway
}
#: Marks of private key blocks; a block reaches from a BEGIN to the next END, however far that is.
BEGIN, END = (re.compile(rf"-----{word} [A-Z ]*PRIVATE KEY(?: BLOCK)?-----") for word in ("BEGIN", "END"))
#: Further kinds: signed web tokens and tokens with a vendor's prefix; private key blocks come from ``key_blocks``.
MORE = {
    "key_block": None,
    "web_token": (re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0, 0),
    "vendor": (re.compile(r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{12,}|sk_live_[A-Za-z0-9]{16,})"),
               0, 0),
}
KINDS = BASE | MORE
#: A value with at least so many owners and repositories is an example.
OWNERS, REPOSITORIES = 8, 8


def key_blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of private key blocks, none inside another; both marks are looked for once.

    A BEGIN inside a block opens no second one, and a BEGIN that no END follows opens none.
    """
    ends = [m.span() for m in END.finditer(text)]
    out, at, nth = [], 0, 0
    for m in BEGIN.finditer(text) if ends else ():
        if m.start() < at:
            continue
        while nth < len(ends) and ends[nth][0] < m.end():
            nth += 1
        if nth == len(ends):
            break
        at = ends[nth][1]
        out.append((m.start(), at))
    return out


def find(text: str) -> list[tuple[int, int, str, int, int]]:
    """(start, end, kind, start of the value, end of the value), by start and then kind as listed."""
    out = []
    for place, (kind, rule) in enumerate(KINDS.items()):
        if rule is None:
            out += [(a, place, b, kind, a, b) for a, b in key_blocks(text)]
            continue
        pattern, group, least = rule
        out += [(m.start(), place, m.end(), kind, *m.span(group)) for m in pattern.finditer(text)
                if m.end(group) - m.start(group) >= least]
    return [(a, b, kind, va, vb) for a, _, b, kind, va, vb in sorted(out)]


def scan(docs: DataFrame, keep: dict[str, str]) -> DataFrame:
    """``keep`` (name: type), the counts and digests, and ``found``: array of (start, end, hash) of the values."""

    def run(texts: list[str]) -> dict[str, list]:
        got = [find(t) for t in texts]
        base = [[f"{k}:{a}:{b}" for a, b, k, _, _ in g if k in BASE] for g in got]
        counts = {f"n_{kind}": [sum(x[2] == kind for x in g) for g in got] for kind in BASE}
        return counts | {
            "base_sha256": [hashlib.sha256(",".join(b).encode()).hexdigest() for b in base],
            "spans": [",".join(f"{k}:{a}:{b}" for a, b, k, _, _ in g) for g in got],
            "found": [[{"start": va, "end": vb, "value": int(np.uint64(
                xxhash.xxh64_intdigest(t[va:vb].encode("utf-8", "replace"))).view(np.int64))}
                for _, _, _, va, vb in g] for t, g in zip(texts, got, strict=True)]}

    schema = ("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
              "found array<struct<start: int, end: int, value: bigint>>")
    return map_text(docs, "text", run, schema, keep)


def ownership(candidates: DataFrame) -> DataFrame:
    """value, owners, repositories, n_rows for rows of (value, owner, repository); nulls count as one more name."""
    seen = candidates.groupBy("value", "owner", "repository").agg(F.count("*").alias("n"))
    named = [F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(c) for c in ("owner", "repository")]
    return seen.select("value", *named, "n").groupBy("value").agg(
        F.countDistinct("owner").alias("owners"), F.countDistinct("owner", "repository").alias("repositories"),
        F.sum("n").alias("n_rows"))


def judged(docs: DataFrame, key: Column, kind: str, owner: str, repository: Column) -> tuple[DataFrame, DataFrame]:
    """(stored rows with key, row and scan result; candidates with row, start, end, value and example)."""
    rows = docs.select(key.alias("key"), F.col(owner).cast("string").alias("owner"),
                       repository.cast("string").alias("repository"), "text")
    rows = checkpointed(scan(rows, {"key": kind, "owner": "string", "repository": "string"})
                        .withColumn("row", F.monotonically_increasing_id()))
    each = rows.select("row", "key", "owner", "repository", F.explode("found").alias("f")).select(
        "row", "key", "owner", "repository", "f.start", "f.end", "f.value")
    table = checkpointed(ownership(each).select("value", "n_rows", (
        (F.col("owners") >= OWNERS) & (F.col("repositories") >= REPOSITORIES)).alias("example")))
    return rows, attach(each.select("row", "key", "start", "end", "value"), table, "value", ["example"], "row")


def where_from(docs: DataFrame) -> Column:
    """Stands for a repository, which the corpus does not name: a source's part in one language.

    There are never fewer of these than sources, so with equal limits the sources alone decide.
    """
    return F.concat_ws("/", F.coalesce("source", F.lit("?")), F.coalesce("lang", F.lit("?")))


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example per row of ``docs``.

    Owner is ``source``, repository ``source`` and ``lang``. n_live counts spans whose value few owners carry,
    n_example the others. Null texts count as empty, null sources and languages as one name of their own. Null
    ids and repeated rows stay. An empty table gives an empty result; other columns are not looked at.
    """
    rows, each = judged(docs, F.col("doc_id").cast("long"), "long", "source", where_from(docs))
    counts = each.groupBy("row").agg(F.sum((~F.col("example")).cast("long")).alias("live"),
                                     F.sum(F.col("example").cast("long")).alias("examples"))
    zero = F.lit(0).cast("long")
    return rows.join(counts, "row", "left").select(
        F.col("key").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans",
        F.coalesce("live", zero).alias("n_live"), F.coalesce("examples", zero).alias("n_example"))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The columns of ``docs`` with every live-looking value replaced by ``mark``; n_chars follows the text.

    Examples stay. Rows without such values stay as they are, null texts too. Overlapping values are replaced as one.
    """
    _, each = judged(docs, row_key(), ROW_KEY, "source", where_from(docs))
    cuts = (each.where(~F.col("example")).groupBy("key")
            .agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("cuts")))

    @F.pandas_udf("string")
    def cut_out(text, cuts):  # noqa: ANN001, ANN202
        def one(t: str | None, spans: object) -> str | None:
            if t is None or spans is None or not len(spans):
                return t
            out, at = [], 0
            for s in spans:
                if s["start"] >= at:
                    out += [t[at:s["start"]], mark]
                at = max(at, s["end"])
            return "".join([*out, t[at:]])

        return pd.Series([one(t, c) for t, c in zip(text, cuts, strict=True)], dtype=object)

    whole = docs.select(row_key().alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    joined = whole.join(cuts, "key", "left")
    clean = joined.withColumn(
        "new", F.when(F.col("cuts").isNull(), F.col("doc.text")).otherwise(cut_out("doc.text", "cuts")))
    fresh = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        n_chars = F.length("new").cast(docs.schema["n_chars"].dataType)
        fresh["n_chars"] = F.when(F.col("cuts").isNull(), F.col("doc.n_chars")).otherwise(n_chars)
    return clean.select(*[fresh.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
