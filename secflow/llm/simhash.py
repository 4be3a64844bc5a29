"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprint: every 4-word shingle of the lower-cased text is hashed by XXH64; a bit is 1 if it is set in over
half of the hashes. Two texts are linked if their fingerprints differ in at most ``MOST`` bits.

Search, exact: the 64 bits are cut into 4 + k blocks. Fingerprints that differ in at most four bits agree in
at least k whole blocks, so each choice of k blocks with its values is a shared masked pattern, the uppermost
node of an index; fingerprints meet only under a node they share. Below it they are sorted by the Gray rank
of the whole fingerprint, which puts similar ones side by side, and runs of them form a tree whose nodes hold
the bits all members share. A bit that was counted at a node is not counted again below it. A search walks pairs
of nodes downwards and adds up the differing bits of the shared patterns; a pair of groups is dropped as a
whole once the sum exceeds ``MOST``, and also once all members of both are linked to each other already.

Scale: only distinct fingerprints are indexed, so exact copies cost one row. Nodes are dealt out by hash of
(choice, pattern). Linked groups are returned as a star to their smallest member, never as all pairs; stars
are joined to components by stored label rounds. Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secflow.llm.common import ROW_KEY, attach, components, map_text, row_key
from secflow.settings import checkpointed

WORDS, SEED, BITS, MOST = 4, 42, 64, 4
#: Children per node of the index.
FAN = 8
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Pairs of nodes that are looked at together; fingerprints that are indexed together, whole nodes at least.
FRONT, ROWS = 1 << 14, 1 << 17
#: Members of an uppermost node that the tree below it searches quickly.
NODE = 2000


def fingerprint(text: str) -> int:
    """64 bits; 0 for a text without words; texts of fewer than four words are one shingle."""
    words = text.encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return 0
    last = max(1, len(words) - WORDS + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(words[i:i + WORDS]), SEED) for i in range(last)), np.uint64, last)
    ones = np.zeros(BITS, np.int64)
    for start in range(0, last, 4096):
        part = hashes[start:start + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > last, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: dict[str, str], text: str = "text") -> DataFrame:
    """The columns ``keep`` (name: type) and ``fp``, the fingerprint as a signed long, of every row."""

    def run(texts: list[str]) -> dict[str, np.ndarray]:
        return {"fp": np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)}

    return map_text(docs, text, run, "fp long", keep)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def block_masks(fingerprints_in_all: int, most: int = MOST) -> list[int]:
    """Masks of the uppermost nodes: every choice of ``keep`` blocks out of ``most + keep``.

    Any number of blocks is exact. More of them make smaller nodes and more copies of each fingerprint, so
    ``keep`` is the least for which evenly spread fingerprints give nodes of about NODE members.
    """
    for keep in range(1, BITS - most):
        n = most + keep
        edges = [BITS * i // n for i in range(n + 1)]
        blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
        if fingerprints_in_all <= NODE << (BITS * keep // n) or keep == 4:
            return [sum(choice) for choice in combinations(blocks, keep)]
    raise ValueError("too many bits may differ")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a code word in the reflected Gray sequence: the running exclusive or from the top bit."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


class GrayIndex:
    """Trees over fingerprints in Gray order, one tree for each uppermost node (``under``), built together.

    Level 0 are the fingerprints; a node of the next level holds up to FAN neighbours of one tree, and the
    last level has one node per tree. ``shared`` are the bits that all members of a node have in common,
    with the values in ``bits``.
    """

    def __init__(self, fps: np.ndarray, under: np.ndarray) -> None:
        order = np.lexsort((gray_rank(fps), under))
        self.fps, tree = fps[order], under[order]
        every, some = [self.fps], [self.fps]
        self.first: list[np.ndarray] = [np.arange(len(fps))]
        self.count: list[np.ndarray] = [np.ones(len(fps), np.int64)]
        while (tree[1:] == tree[:-1]).any():
            opens = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
            place = np.arange(len(tree)) - np.repeat(opens, np.diff(np.r_[opens, len(tree)]))
            starts = np.flatnonzero(place % FAN == 0)
            every.append(np.bitwise_and.reduceat(every[-1], starts))
            some.append(np.bitwise_or.reduceat(some[-1], starts))
            self.first.append(starts)
            self.count.append(np.diff(np.r_[starts, len(tree)]))
            tree = tree[starts]
        self.bits = every
        self.shared = [~(a ^ o) for a, o in zip(every, some, strict=True)]
        self.group = np.arange(len(fps))

    def _root(self, i: np.ndarray) -> np.ndarray:
        while True:
            up = self.group[i]
            if (up == i).all():
                return i
            i = up

    def _union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self._root(a), self._root(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.group, np.maximum(ra, rb), np.minimum(ra, rb))

    def _settled(self) -> list[np.ndarray]:
        """Per level and node: the group of its members, or -1 if they are not in one group yet."""
        self.group = self._root(np.arange(len(self.fps)))
        low = high = self.group
        out = [low]
        for starts in self.first[1:]:
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            out.append(np.where(low == high, low, -1))
        return out

    def _children(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pairs of a child of ``a`` and a child of ``b``, each pair once, and the place of their parents."""
        i, j = np.divmod(np.arange(FAN * FAN), FAN)
        ca, cb = self.first[level][a][:, None] + i, self.first[level][b][:, None] + j
        ok = (i < self.count[level][a][:, None]) & (j < self.count[level][b][:, None])
        ok &= (ca < cb) if level == 1 else (ca <= cb)
        return ca[ok], cb[ok], np.nonzero(ok)[0]

    def stars(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(member, smallest fingerprint of its group) for groups linked within ``most`` bits; no single ones.

        A fingerprint that stands under several uppermost nodes is a member of each of their trees.
        """
        top = len(self.bits) - 1
        if top > 0:
            trees = np.arange(len(self.bits[top]))
            waiting = [(top, trees[i:i + FRONT], trees[i:i + FRONT], np.zeros(len(trees[i:i + FRONT]), np.int64))
                       for i in range(0, len(trees), FRONT)]
            settled, looked = self._settled(), 0
            while waiting:
                level, a, b, apart = waiting.pop()
                if level == 0:
                    self._union(a, b)
                    looked += len(a)
                    if looked > len(self.fps):
                        settled, looked = self._settled(), 0
                    continue
                done = (settled[level][a] >= 0) & (settled[level][a] == settled[level][b])
                a, b, apart = a[~done], b[~done], apart[~done]
                ca, cb, parent = self._children(level, a, b)
                shared, above = self.shared[level - 1], self.shared[level]
                fresh = shared[ca] & shared[cb] & ~(above[a] & above[b])[parent]
                bits = self.bits[level - 1]
                sums = apart[parent] + np.bitwise_count((bits[ca] ^ bits[cb]) & fresh)
                near = sums <= most
                ca, cb, sums = ca[near], cb[near], sums[near]
                waiting += [(level - 1, ca[i:i + FRONT], cb[i:i + FRONT], sums[i:i + FRONT])
                            for i in range(0, len(ca), FRONT)]
        roots = self._root(np.arange(len(self.fps)))
        order = np.lexsort((self.fps, roots))
        heads = np.flatnonzero(np.r_[True, roots[order][1:] != roots[order][:-1]])
        smallest = np.empty(len(order), np.uint64)
        smallest[order] = np.repeat(self.fps[order][heads], np.diff(np.r_[heads, len(order)]))
        linked = smallest != self.fps
        return self.fps[linked], smallest[linked]


def _search(most: int):
    """Index whole uppermost nodes of a sorted partition, many at a time."""

    def find(fp: np.ndarray, choice: np.ndarray, bits: np.ndarray) -> pd.DataFrame:
        under = np.cumsum(np.r_[0, (choice[1:] != choice[:-1]) | (bits[1:] != bits[:-1])])
        a, b = GrayIndex(fp.view(np.uint64), under).stars(most)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)}).drop_duplicates()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        for frame in frames:
            held.append(frame[["fp", "choice", "bits"]].to_numpy(np.int64))
            if sum(map(len, held)) < ROWS:
                continue
            rows = np.concatenate(held)
            change = np.flatnonzero((rows[1:, 1:] != rows[:-1, 1:]).any(1))
            if len(change):
                cut = change[-1] + 1
                yield find(*np.ascontiguousarray(rows[:cut].T))
                rows = rows[cut:]
            held = [rows]
        if held and sum(map(len, held)):
            yield find(*np.ascontiguousarray(np.concatenate(held).T))

    return run


def links(classes: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b): stars whose components are those of all pairs of distinct ``fp`` within ``most`` bits."""
    choices = [F.struct(F.lit(k).cast("long").alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits"))
               for k, m in enumerate(block_masks(classes.count(), most))]
    under = classes.select("fp", F.explode(F.array(*choices)).alias("node")).select("fp", "node.choice", "node.bits")
    return (under.repartition("choice", "bits").sortWithinPartitions("choice", "bits")
            .mapInPandas(_search(most), "a long, b long"))


def heads(rows: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """The stored ``rows`` (row, fp, ...) plus ``head``: the smallest ``row`` among all whose fp has the same root.

    ``classes`` is stored and has every fp with its smallest row (``least``) and its number of rows (``n_rows``).
    """
    linked = checkpointed(classes.join(roots, F.col("fp") == F.col("node")).select("fp", "root", "least"))
    smallest = linked.groupBy("root").agg(F.min("least").alias("head"))
    members = linked.join(smallest, "root").select("fp", "head")
    table = checkpointed(classes.join(members, "fp", "left").select(
        "fp", F.coalesce("head", "least").alias("head"), "n_rows"))
    return attach(rows, table, "fp", ["head"], "row")


def grouped(rows: DataFrame, most: int = MOST) -> DataFrame:
    """The stored ``rows`` (row, fp, ...) plus ``head``: the smallest ``row`` among all linked ones."""
    classes = checkpointed(rows.groupBy("fp").agg(F.min("row").alias("least"), F.count("*").alias("n_rows")))
    return heads(rows, classes, components(links(classes, most)))


def near_duplicates(docs: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable over links) per row.

    Null texts count as empty; texts without words have fingerprint 0 and are linked like any other. Null ids
    never name a component unless it has no other id (then null). Repeated rows stay and are linked with each
    other. An empty table gives an empty result; other columns are not looked at.
    """
    kept = docs.select(F.col("doc_id").cast("long").alias("row"), F.col("text"))
    rows = checkpointed(fingerprints(kept, {"row": "long"}))
    return grouped(rows, most).select(F.col("row").alias("doc_id"), hex_digits(F.col("fp")).alias("fingerprint"),
                                      F.col("head").alias("component_id"))


def deduplicate(docs: DataFrame, most: int = MOST) -> DataFrame:
    """The columns of ``docs``, one row of each group of linked texts: the one with the smallest doc_id.

    Among equal ids the smaller text hash stays, of wholly repeated rows one; null ids come last.
    """
    row = row_key()
    rows = checkpointed(fingerprints(docs.select(row.alias("row"), "text"), {"row": ROW_KEY}))
    kept = grouped(rows, most).where("row = head").select("row").distinct()
    whole = docs.select(row.alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return whole.join(kept, "row").dropDuplicates(["row"]).select("doc.*")
