"""Ranked lexical search: every document against every item, through classes of equal bags.

A score depends on a document only through how often it holds the items' terms and through ``m``, which its
length decides. So documents are reduced to the vocabulary of the items, rows with the same hash of counts and m
come together, equality of the counts themselves makes the class, and each class is scored once. The best classes
of an item are then expanded to their members by ascending doc_id. Boilerplate and copies cost one class, and a
class of a third of all documents leaves each task with its first ``k`` members only, as no item can return more.

Items are a query set: they are dealt into blocks with at most about ``ENTRIES`` distinct (item, term) pairs, and
the vocabulary and postings of one block are what every task is sent; one item's text is never cut. Documents are
read once for each block.

Scale: texts move nowhere, one pass turns them into stored bags; the shuffle carries bags after the cut to ``k``
rows of a class in each task; scores stay in the task but for the ``k`` best classes of each item.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from secflow.llm.common import Best, blocks, first_of_each, map_text
from secflow.settings import checkpointed

K = 20
#: Distinct (item, term) pairs of a block of items that are sent to all tasks.
ENTRIES = 1_000_000
#: Products and scores that a task holds at a time.
AT_ONCE = 1 << 21
#: What is no part of a term becomes a space, letters A to Z become small.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
#: Names of two sums beside the terms' document frequencies.
N_DOCS, N_TERMS = -1, -2


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(FOLD).split()


def items_with_terms(items: DataFrame) -> DataFrame:
    """item (a number of the row), item_id and terms (term, times) of every row of ``items``."""

    def run(texts: list[str]) -> dict[str, list]:
        return {"terms": [[{"term": t, "times": n} for t, n in Counter(terms_of(x)).items()] for x in texts]}

    rows = items.select("item_id", "text")
    return map_text(rows, "text", run, "terms array<struct<term: binary, times: bigint>>",
                    {"item_id": rows.schema["item_id"].dataType.simpleString()}).withColumn(
        "item", F.monotonically_increasing_id())


def bags(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms of the text) and bag: numbers and counts of the terms in ``number``, by number."""

    def run(texts: list[str]) -> dict[str, list]:
        sizes, packed = [], []
        for text in texts:
            words = terms_of(text)
            found = sorted((number[t], n) for t, n in Counter(words).items() if t in number)
            sizes.append(len(words))
            packed.append(np.array(found, "<u4").reshape(-1, 2).T.tobytes())
        return {"n": sizes, "bag": packed}

    return map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", run,
                    "n long, bag binary", {"doc_id": "long"})


def frequencies(stored: DataFrame, many: int) -> tuple[np.ndarray, int, int]:
    """(documents that hold each term, documents with a term, terms of all documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, terms = np.zeros(many, np.int64), 0, 0
        for batch in batches:
            sizes = batch.column("n").to_numpy(zero_copy_only=False)
            docs, terms = docs + int((sizes > 0).sum()), terms + int(sizes.sum())
            for bag in batch.column("bag"):
                both = np.frombuffer(bag.as_buffer(), "<u4")
                held[both[:len(both) // 2]] += 1
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, N_DOCS, N_TERMS], pa.int64()),
                                          pa.array(np.r_[held[some], docs, terms], pa.int64())], ["term", "held"])

    found = stored.select("n", "bag").mapInArrow(run, "term long, held long").groupBy("term").agg(
        F.sum("held").alias("held")).collect()
    df = np.zeros(many, np.int64)
    total = {r["term"]: r["held"] for r in found if r["term"] < 0}
    for r in found:
        if r["term"] >= 0:
            df[r["term"]] = r["held"]
    return df, total.get(N_DOCS, 0), total.get(N_TERMS, 0)


class Postings:
    """For each term the items that ask for it, with the term's weight times how often they do."""

    def __init__(self, term: np.ndarray, item: np.ndarray, weight: np.ndarray, items: int, terms: int) -> None:
        order = np.argsort(term, kind="stable")
        self.item, self.weight, self.items = item[order], weight[order], items
        self.many = np.bincount(term, minlength=terms)
        self.first = np.cumsum(self.many) - self.many
        # A part of a score is at most 1 000 000 times a weight; float sums are exact below 2^53.
        most = np.bincount(item, weight.astype(np.float64), items).max(initial=0.0) * 1e6
        self.exact = bool(most < float(1 << 53))

    def scores(self, owner: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Scores by (row, item) of rows with m and entries (owner, term, tf)."""
        part = (1_000_000_000 * tf) // (1000 * tf + 12 * m[owner])
        many = self.many[term]
        at = np.repeat(self.first[term] - np.cumsum(many) + many, many) + np.arange(many.sum())
        value = self.weight[at] * np.repeat(part, many)
        cell = np.repeat(owner, many) * self.items + self.item[at]
        size = len(m) * self.items
        if self.exact:
            sums = np.bincount(cell, value, size).astype(np.int64)
        else:
            low = np.bincount(cell, value & ((1 << 26) - 1), size).astype(np.int64)
            sums = (np.bincount(cell, value >> 26, size).astype(np.int64) << 26) + low
        return sums.reshape(len(m), self.items)


def _slices(bag_sizes: np.ndarray, fan: np.ndarray, items: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with a bounded number of products and scores; short ones first, so that few rows are sorted."""
    cost, a, most = np.maximum(fan, items) + bag_sizes, 0, 32
    while a < len(cost):
        b = a + max(1, min(most, int(np.searchsorted(np.cumsum(cost[a:a + most]), AT_ONCE, "right"))))
        yield a, min(b, len(cost))
        a, most = b, min(2 * most, 1 << 14)


def best_classes(classes: DataFrame, postings: Postings, numbers: np.ndarray, k: int) -> DataFrame:
    """item, score, class of the ``k`` best classes of each item in each task, for rows (row, doc_id, m, bag).

    ``numbers`` are the items' numbers by their place in ``postings``. A missing id counts as the largest.
    """
    none = (1 << 63) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k, np.ones(postings.items, np.int64))
        for batch in batches:
            raw = [np.frombuffer(b.as_buffer(), "<u4").astype(np.int64).reshape(2, -1) for b in batch.column("bag")]
            row, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "m"))
            ids = np.array([none if i is None else i for i in batch.column("doc_id").to_pylist()], np.int64)
            sizes = np.array([r.shape[1] for r in raw], np.int64)
            fan = np.array([postings.many[r[0]].sum() for r in raw], np.int64)
            for a, b in _slices(sizes, fan, postings.items):
                term, tf = np.concatenate(raw[a:b], 1)
                owner = np.repeat(np.arange(b - a), sizes[a:b])
                best.add(postings.scores(owner, term, tf, m[a:b]), np.arange(postings.items), ids[a:b], row[a:b])
        item, score, _, row = best.held
        yield pa.RecordBatch.from_arrays([pa.array(numbers[item]), pa.array(score), pa.array(row)],
                                         ["item", "score", "class"])

    return classes.select("row", "doc_id", "m", "bag").mapInArrow(run, "item long, score long, class long")


def _members(stored: DataFrame, docs: int, terms: int, k: int) -> DataFrame:
    """row, doc_id, class (the row of its first member) and place of the first ``k`` members; m and bag at place 1."""
    share = F.expr(f"(cast(25 * n as decimal(20, 0)) * cast({docs} as decimal(18, 0))) div {max(1, terms)}")
    keyed = (stored.where(F.length("bag") > 0).select("row", "doc_id", "bag", (F.lit(75) + share).cast("long").alias("m"))
             .withColumn("key", F.xxhash64("m", "bag")))
    order = [F.asc_nulls_last("doc_id"), F.col("row")]
    window = (Window.partitionBy("key", "m", "bag").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = keyed.withColumn("class", F.first("row").over(window)).withColumn("place", F.row_number().over(window))
    own = F.col("place") == 1
    return first.where(F.col("place") <= k).select(
        "row", "doc_id", "class", "place", F.when(own, F.col("m")).alias("m"), F.when(own, F.col("bag")).alias("bag"))


def _search_block(docs: DataFrame, block: DataFrame, k: int) -> DataFrame:
    asked = block.select("item", "terms").collect()
    number = {t: i for i, t in enumerate(sorted({bytes(e["term"]) for r in asked for e in r["terms"]}))}
    entries = np.array([(number[bytes(e["term"])], i, e["times"]) for i, r in enumerate(asked) for e in r["terms"]],
                       np.int64).reshape(-1, 3).T
    stored = checkpointed(bags(docs, number).withColumn("row", F.monotonically_increasing_id()))
    df, n_docs, n_terms = frequencies(stored, len(number))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    postings = Postings(entries[0], entries[1], weight[entries[0]] * entries[2], len(asked), len(number))
    members = checkpointed(_members(stored, n_docs, n_terms, k))
    scored = best_classes(members.where("place = 1"), postings, np.array([r["item"] for r in asked], np.int64), k)
    heads = members.where("place = 1").select(F.col("row").alias("class"), F.col("doc_id").alias("least"))
    winners = checkpointed(first_of_each(scored.join(heads, "class"), ["item"], [
        F.desc("score"), F.asc_nulls_last("least"), F.col("class")], k, "nth").select("item", "score", "class"))
    expanded = winners.join(members.select("class", "row", "doc_id"), "class")
    return first_of_each(expanded, ["item"], [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("row")], k, "rank").select(
        "item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, entries: int = ENTRIES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents with a score above 0 of each row of ``items``.

    Equal scores come by ascending doc_id, missing ids last. Null and empty texts have no terms: such documents
    are found by nothing and count in no statistic, such items return nothing. Repeated documents are ranked one
    by one, repeated items return their rows again. Empty tables give an empty result; other columns are not
    looked at. Texts of any length are counted whole.
    """
    numbered = checkpointed(items_with_terms(items))
    parts = [_search_block(docs, block, k) for block in blocks(numbered, "item", F.size("terms"), entries)]
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
