"""Hard negatives for anchors, mined from lists that the anchors of a cluster share.

A row's score for an anchor is the inner product of their vectors, in whole numbers. An anchor's positives are its
best rows of the same label; the hard negatives of a positive are the best rows of other labels whose scores are
at most the positive's and at least a share of it.

Anchors are clustered by direction. No member of a cluster is further than ``spread`` from its centre, so a candidate
at angle a from the centre scores at most |anchor| |candidate| cos(max(0, a - spread)) for every member. The list
of candidates is sorted by this bound once for a cluster; each member walks the list and stops where the bound
certifies that nothing behind it can enter the member's results. Positives come from a first walk and bound
the second.

Scale: anchors are the query set and go to the tasks in blocks of at most about ``VALUES`` components. Candidates
stay in their partitions and are listed ``ROWS`` at a time, so a list is the shared list of one cluster over
those rows, and no candidate is shuffled; a task returns at most ``k`` rows for each anchor or positive. The work
is anchors times rows in the worst case, as every search of a query set against all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secflow.llm.common import Best, blocks, first_of_each
from secflow.settings import checkpointed

#: Components of the anchors of a block; candidates that are listed together, and components of them.
VALUES, ROWS, ROW_VALUES = 1 << 22, 1 << 15, 1 << 22
#: Candidates that a walk looks at between two certificates.
STEP = 256
#: More than the rounding of a cosine of two angles.
SLACK = 1e-6
#: A missing id counts as the largest; the score of a pair that does not count.
NO_ID, NEVER = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def whole_numbers(rows: DataFrame, vector: str, scale: int) -> Column:
    """floor(scale * x) of each component; null where the row takes no part.

    That is a null vector, a null or non-finite component, or a squared length of 2^62 or more, as scores would
    not fit into 64 bits.
    """
    floors = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    length = F.aggregate(vector, F.lit(0.0), lambda s, x: s + F.pow(F.floor(x.cast("double") * scale).cast("double"), 2))
    return F.when(finite & (length < float(1 << 62)), F.transform(floors, lambda x: x.cast("int")))


@dataclass
class Rows:
    """Vectors of one length with what is known of their rows."""

    vectors: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    rows: np.ndarray

    def __post_init__(self) -> None:
        self.norms = np.sqrt((self.vectors.astype(np.float64) ** 2).sum(1))
        self.units = self.vectors / np.where(self.norms > 0, self.norms, 1)[:, None]


@dataclass
class Cluster:
    members: np.ndarray
    centre: np.ndarray
    spread: float


def angles(units: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centre, -1, 1))


def clusters(anchors: Rows, rounds: int = 8) -> list[Cluster]:
    """Anchors by direction, about as many clusters as members; any clusters give the same results."""
    many = max(1, int(np.sqrt(len(anchors.rows))))
    centres = anchors.units[np.random.default_rng(3).choice(len(anchors.rows), many, replace=False)]
    for _ in range(rounds):
        nearest = np.argmax(anchors.units @ centres.T, 1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, anchors.units)
        lengths = np.sqrt((sums ** 2).sum(1, keepdims=True))
        centres = np.where(lengths > 0, sums / np.where(lengths > 0, lengths, 1), centres)
    nearest = np.argmax(anchors.units @ centres.T, 1)
    out = []
    for c in np.unique(nearest):
        members = np.flatnonzero(nearest == c)
        # A vector of zeros scores 0 with every row, which the bound holds for at any angle.
        apart = np.where(anchors.norms[members] > 0, angles(anchors.units[members], centres[c]), 0)
        out.append(Cluster(members, centres[c], float(apart.max())))
    return out


def products(a: Rows, b: Rows) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of both in the fastest type in which all inner products are exact."""
    most = a.norms.max(initial=0) * b.norms.max(initial=0) * (1 + 1e-9)
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return a.vectors.astype(kind), b.vectors.astype(kind)


def walk(anchors: Rows, groups: list[Cluster], candidates: Rows, goal: Callable[[np.ndarray], np.ndarray],
         offer: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> int:
    """Walk each cluster's list; ``offer`` gets (scores by candidate and member, members, candidates) of a step.

    ``goal`` gives the least score that still matters for each member: a member stops when the bound of the next
    candidate is below it. Returns the number of products.
    """
    left, right = products(anchors, candidates)
    looked = 0
    for group in groups:
        turn = np.maximum(0, angles(candidates.units, group.centre) - group.spread)
        bound = candidates.norms * (np.cos(turn) + SLACK)
        order = np.argsort(-bound, kind="stable")
        active = group.members
        for start in range(0, len(order), STEP):
            step = order[start:start + STEP]
            reach = anchors.norms[active] * bound[step[0]]
            active = active[reach + 0.5 >= goal(active)]
            if not len(active):
                break
            offer((right[step] @ left[active].T).astype(np.int64), active, step)
            looked += len(step) * len(active)
    return looked


def by_length(table: pa.Table) -> dict[int, Rows]:
    """Rows of (row, vec_id, label, vec) by the length of their vectors."""
    if not table.num_rows:
        return {}
    vec = table.column("vec").combine_chunks()
    flat, starts = vec.values.to_numpy(zero_copy_only=False), vec.offsets.to_numpy()
    label, row = (table.column(c).to_numpy() for c in ("label", "row"))
    ids = table.column("vec_id").fill_null(int(NO_ID)).to_numpy()
    sizes, out = np.diff(starts), {}
    for n in np.unique(sizes).tolist():
        these = np.flatnonzero(sizes == n)
        out[n] = Rows(flat[starts[these][:, None] + np.arange(n)], label[these], ids[these], row[these])
    return out


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, Rows]]:
    """Rows by the length of their vectors, a bounded number at a time; one vector is never cut."""
    held, rows, values = [], 0, 0
    for batch in batches:
        width = max(1, len(batch.column("vec").flatten()) // max(1, batch.num_rows))
        step = max(1, min(ROWS, ROW_VALUES // width))
        for a in range(0, batch.num_rows, step):
            held.append(batch.slice(a, step))
            rows, values = rows + held[-1].num_rows, values + held[-1].num_rows * width
            if rows >= ROWS or values >= ROW_VALUES:
                yield by_length(pa.Table.from_batches(held))
                held, rows, values = [], 0, 0
    if held:
        yield by_length(pa.Table.from_batches(held))


def _pairs(anchors: dict[int, Rows], k: int) -> Callable:
    """Tasks' part of the first walk: the best rows of the same label for each anchor."""
    groups = {n: clusters(a) for n, a in anchors.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {n: Best(k, np.full(len(a.rows), NEVER + 1)) for n, a in anchors.items()}
        for chunk in gathered(batches):
            for n in chunk.keys() & anchors.keys():
                a, c, top = anchors[n], chunk[n], best[n]

                def offer(scores, active, step, a=a, c=c, top=top):  # noqa: ANN001, ANN202
                    counts = (c.labels[step][:, None] == a.labels[active]) & (c.rows[step][:, None] != a.rows[active])
                    top.add(np.where(counts, scores, NEVER), active, c.ids[step], c.rows[step])

                walk(a, groups[n], c, lambda active, top=top: top.least[active], offer)
        for n, top in best.items():
            slot, score, doc, row = top.held
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (anchors[n].rows[slot], doc, row, score)],
                ["anchor_row", "positive_id", "positive_row", "positive_score"])

    return run


@dataclass
class Wanted:
    """Positives of the anchors of one length: place of the anchor, id, row and score, and the scores that count."""

    anchor: np.ndarray
    ids: np.ndarray
    rows: np.ndarray
    scores: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _negatives(anchors: dict[int, Rows], wanted: dict[int, Wanted], k: int) -> Callable:
    """Tasks' part of the second walk: the best rows of other labels within each positive's range."""
    groups = {}
    for n, w in wanted.items():
        some = np.unique(w.anchor)
        groups[n] = [Cluster(m, g.centre, g.spread) for g in clusters(anchors[n])
                     if len(m := np.intersect1d(g.members, some))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {n: Best(k, w.low.copy()) for n, w in wanted.items()}
        for chunk in gathered(batches):
            for n in chunk.keys() & wanted.keys():
                a, c, w, top = anchors[n], chunk[n], wanted[n], best[n]

                def goal(active, a=a, w=w, top=top):  # noqa: ANN001, ANN202
                    least = np.full(len(a.rows), NO_ID)
                    np.minimum.at(least, w.anchor, top.least)
                    return least[active]

                def offer(scores, active, step, a=a, c=c, w=w, top=top):  # noqa: ANN001, ANN202
                    slots = np.flatnonzero(np.isin(w.anchor, active))
                    column = np.searchsorted(active, w.anchor[slots])
                    other = np.where(c.labels[step][:, None] != a.labels[active], scores, NEVER)[:, column]
                    top.add(np.where(other <= w.high[slots], other, NEVER), slots, c.ids[step], c.rows[step])

                walk(a, groups[n], c, goal, offer)
        for n, top in best.items():
            slot, score, doc, row = top.held
            w, a = wanted[n], anchors[n]
            columns = (a.rows[w.anchor[slot]], a.ids[w.anchor[slot]], w.rows[slot], w.ids[slot], w.scores[slot],
                       doc, row, score)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], [
                "anchor_row", "anchor_id", "positive_row", "positive_id", "positive_score",
                "negative_id", "negative_row", "negative_score"])

    return run


def _mine_block(stored: DataFrame, block: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    anchors = by_length(block.toArrow())
    near = stored.mapInArrow(
        _pairs(anchors, positives), "anchor_row long, positive_id long, positive_row long, positive_score long")
    order = [F.desc("positive_score"), F.asc("positive_id"), F.asc("positive_row")]
    place = {row: (n, i) for n, a in anchors.items() for i, row in enumerate(a.rows.tolist())}
    found: dict[int, list[tuple]] = {}
    for r in first_of_each(near, ["anchor_row"], order, positives, "nth").collect():
        n, i = place[r["anchor_row"]]
        score = r["positive_score"]
        least, most = -(-low * score // 100), high * score // 100
        if least <= most:
            found.setdefault(n, []).append((i, r["positive_id"], r["positive_row"], score, least, most))
    wanted = {n: Wanted(*np.array(sorted(rows), np.int64).T) for n, rows in found.items()}
    hard = stored.mapInArrow(
        _negatives(anchors, wanted, negatives), "anchor_row long, anchor_id long, positive_row long, positive_id long, "
        "positive_score long, negative_id long, negative_row long, negative_score long")
    return first_of_each(hard, ["anchor_row", "positive_row"], [
        F.desc("negative_score"), F.asc("negative_id"), F.asc("negative_row")], negatives, "rank")


def mine(rows: DataFrame, anchor: str, vector: str = "embedding", scale: int = 256, positives: int = 5,
         negatives: int = 5, low: int = 80, high: int = 100, values: int = VALUES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score per anchor, positive and negative.

    ``rows`` has vec_id, label and ``vector``; rows for which the condition ``anchor`` holds are anchors. Negatives
    of a positive of score p have scores s with low * p <= 100 * s <= high * p, best first, equal scores by smaller
    vec_id, so a negative p has none. Rows with a null label or vector or a null or non-finite component take no
    part, nor do those too long for 64-bit scores. Vectors of different lengths have no score. Rows without an id
    come last among equal scores. Repeated rows are rows of their own, also as anchors. Empty tables, labels of
    one kind and single rows give an empty result; other columns are not looked at.
    """
    stored = checkpointed(
        rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
                    F.col("label").cast("long").alias("label"), whole_numbers(rows, vector, scale).alias("vec"),
                    F.coalesce(F.expr(anchor), F.lit(False)).alias("is_anchor"))
        .where("label is not null and vec is not null"))
    data = stored.select("row", "vec_id", "label", "vec")
    queries = stored.where("is_anchor").select(*data.columns)
    parts = [_mine_block(data, block, positives, negatives, low, high)
             for block in blocks(queries, "row", F.size("vec") + 8, values)]
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)

    def named(name: str) -> Column:
        return F.when(F.col(name) != int(NO_ID), F.col(name)).alias(name)

    return found.select(named("anchor_id"), named("positive_id"), F.col("rank"), named("negative_id"),
                        "positive_score", "negative_score")
