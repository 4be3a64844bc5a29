"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of at least ``LIKE``.

Candidates come from MinHash: ``BANDS`` keys of ``ROWS`` least values each. Two texts of similarity s share a
key with probability 1 - (1 - s^ROWS)^BANDS: 0.9995 at 0.8, 1 - 4e-9 at 0.9. Texts that share a key are the
members of a bucket. A pair of candidates is linked only if its whole shingle sets, made from both texts,
reach ``LIKE``; groups are the components of the links.

Search: a class weighs the sum of the sizes of its buckets; the heaviest of a bucket is its centre. The reference of a
bucket is the heaviest centre that its centre meets, so buckets of one family share a reference. Every member is compared
with the references of its buckets, and links are joined to components. What is left are pairs (a, b) of one reference
c and two components, which need |a & b| >= LIKE / (1 + LIKE) * (|a| + |b|). A pair like that

* shares a shingle outside c. With those outside c first, the first common shingle stands in both prefixes of
  |x| - LIKE * |x| + 1 shingles; or
* shares shingles of c only. Then both have LIKE of their shingles in c, the first common one stands in the rest of both
  prefixes, one of the two is not linked to c, and the other is smaller than c if it is linked to c.

So pairs are looked for among classes with a common shingle of their prefixes (a set). A text changed too much to be
linked to its reference meets only those with the same changes. Pairs whose heaviest reference is the same are looked for
there only. In sets whose members are not all of one component, members become centres in growing shares until all
of them were; pairs that cannot be linked by size, distance from c or what they share with c at most are not compared.

Scale: equal sequences of words are one class, so exact copies cost one row. Only keys and class numbers move in the
search; shingle sets are made once for each candidate and move once for each pair compared. A group of m copies of a
text costs m comparisons however much they were changed, and a prefix of a fifth of its shingles for each. A hot bucket
or centre is one key of a sort-merge join whose other side has one row for it, which Spark splits as it runs. A set of m
texts that share changes, but are all below ``LIKE``, costs up to m^2 / 2 comparisons; no pair is left out for that.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secflow.llm.common import ROW_KEY, components, map_text, row_key
from secflow.llm.simhash import LOWER, heads
from secflow.settings import checkpointed, checkpointed_lean

WORDS, SEED, LIKE, BANDS, ROWS = 5, 42, 0.8, 32, 7
#: Expected centres of a set in the first round; each further round has GROWTH times as many, at most MOST.
CENTRES, GROWTH, MOST = 16, 16, 2048
_draw = np.random.default_rng(7)
FLIP, TIMES = (_draw.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(one) for one in (0, 1))
MIX, SALT = (_draw.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1) for n in (ROWS, BANDS))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(LOWER).split()


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of all five-word shingles; of all words if there are fewer; none without words."""
    last = max(1, len(words) - WORDS + 1) if words else 0
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(words[i:i + WORDS]), SEED) for i in range(last)), np.uint64, last))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two shingle sets; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def bands(found: np.ndarray) -> np.ndarray:
    """BANDS keys of a shingle set; none for an empty set."""
    if not len(found):
        return np.empty(0, np.int64)
    low, least = (found >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
    for start in range(0, len(low), 256):
        np.minimum(least, ((low[start:start + 256, None] ^ FLIP) * TIMES).min(0), out=least)
    mixed = ((least.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * MIX).sum(1, dtype=np.uint64)
    return ((mixed ^ (mixed >> np.uint64(29))) * SALT + SALT).view(np.int64)


def classes_of(docs: DataFrame) -> DataFrame:
    """row (see ``row_key``), fp (hash of the sequence of words), n (distinct shingles) and bands of every row."""

    def run(texts: list[str]) -> dict[str, list]:
        words = [words_of(t) for t in texts]
        sets = [shingles(w) for w in words]
        fp = np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED) for w in words], np.uint64).view(np.int64)
        return {"fp": fp, "n": [len(s) for s in sets], "bands": [bands(s) for s in sets]}

    return map_text(docs.select(row_key().alias("row"), "text"), "text", run, "fp long, n long, bands array<long>",
                    {"row": ROW_KEY})


def relation(centre: np.ndarray, found: np.ndarray) -> tuple:
    """Size, shingles in ``centre``, similarity to it, and the prefix: its part outside and, where of use, inside."""
    n, inner = len(found), np.isin(found, centre, assume_unique=True)
    inside, like = int(inner.sum()), similarity(centre, found)
    prefix = n - math.ceil(LIKE * n - 1e-9) + 1
    useful = inside >= LIKE * n - 1e-9 and (like < LIKE or n < len(centre))
    rest = prefix - (n - inside) if useful else 0
    return n, inside, like, found[~inner][:prefix].view(np.int64), found[inner][:max(0, rest)].view(np.int64)


def in_pairs(pairs: DataFrame, sets: DataFrame, find: Callable[[np.ndarray, np.ndarray], tuple], columns: str) -> DataFrame:
    """a, b and what ``find`` gives for their sets, for distinct pairs; ``sets`` has fp and hashes of each class.

    A pair is dealt out as its two ends, so no set goes through the driver; a centre with very many pairs is one
    key of a sort-merge join, which Spark splits by the pairs' side while it runs.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    full = f"a long, b long, {columns}"
    arrow = to_arrow_schema(StructType.fromDDL(full))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: np.ndarray | None = None
        for batch in batches:
            out = []
            for a, b, hashes in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("hashes"),
                                    strict=True):
                found = np.frombuffer(hashes.as_buffer(), "<u8")
                if first is None:
                    first = found.copy()
                    continue
                out.append((a, b, *find(first, found)))
                first = None
            values = zip(*out, strict=True) if out else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(values, arrow, strict=True)], schema=arrow)

    ends = pairs.select("a", "b", F.posexplode(F.array("a", "b")).alias("side", "fp")).join(sets, "fp")
    return (ends.select("a", "b", "side", "hashes").repartition("a", "b").sortWithinPartitions("a", "b", "side")
            .mapInArrow(run, full))


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b and like, the similarity of their sets, for distinct pairs."""
    return in_pairs(pairs, sets, lambda a, b: (similarity(a, b),), "like double")


def sets_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """fp and hashes (the sorted shingle set) of each row of ``classes`` (fp, least)."""

    def run(texts: list[str]) -> dict[str, list]:
        return {"hashes": [shingles(words_of(t)).astype("<u8").tobytes() for t in texts]}

    rows = docs.select(row_key().alias("row"), "text").join(classes.select("fp", F.col("least").alias("row")), "row")
    return map_text(rows, "text", run, "hashes binary", {"fp": "long"}).dropDuplicates(["fp"])


def _ordered(one: str, other: str) -> list:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def _near_in_size(one: Column, other: Column) -> Column:
    """Sets of more different sizes cannot reach LIKE."""
    return F.least(one, other) >= F.lit(LIKE - 1e-9) * F.greatest(one, other)


def _enough(c: Column, n: Column, inside: Column) -> Column:
    """Whether two classes of a set may have enough in common: inside their reference, and outside where the set is."""
    outside = F.when(F.col("bucket.outside"), F.least(c["n"] - c["inside"], n - inside)).otherwise(F.lit(0))
    return (1 + LIKE) * (F.least(c["inside"], inside) + outside) >= LIKE * (c["n"] + n) - 1e-9


def references(classes: DataFrame) -> DataFrame:
    """fp, refs and home: the references of each class with a candidate, itself if it is one, and the heaviest of them.

    A class has at most BANDS buckets, so between the joins by bucket they are lists of their class.
    """
    each = classes.select("fp", F.explode("bands").alias("bucket"))
    members = each.join(each.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1"), "bucket")
    weighed = checkpointed_lean(members.groupBy("fp").agg(F.sum("m").alias("weight"),
                                                          F.collect_list("bucket").alias("buckets")))
    held = weighed.select("fp", F.struct("weight", F.xxhash64("fp", F.lit(SEED)).alias("by"), "fp").alias("heavy"),
                          F.explode("buckets").alias("bucket"))
    centres = held.groupBy("bucket").agg(F.max("heavy").alias("c"))
    # The centre of a bucket is a member of it, so what it meets is in its own row.
    met = checkpointed_lean(held.select("bucket", "fp").join(centres, "bucket").groupBy("fp").agg(
        F.max("c").alias("r"), F.collect_list("bucket").alias("buckets"),
        F.collect_list(F.when(F.col("c.fp") == F.col("fp"), F.col("bucket"))).alias("led")))
    led = met.select(F.explode("led").alias("bucket"), "r")
    placed = met.select("fp", F.explode("buckets").alias("bucket")).join(led, "bucket").select("fp", "r")
    whole = placed.union(met.where(F.size("led") > 0).select("r.fp", "r"))
    return whole.groupBy("fp").agg(F.collect_set("r.fp").alias("refs"), F.max("r").alias("best")).select(
        "fp", "refs", F.col("best.fp").alias("home"))


def shared_prefixes(stars: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of all sets (see the head) that hold more than one component: bucket (ref, shingle, outside), m
    members, fp, n, inside, far from the reference, home and root."""
    told = checkpointed_lean(stars.withColumnsRenamed({"a": "ref", "b": "fp"})
                             .join(roots.withColumnRenamed("node", "fp"), "fp"))
    mixed = F.min("root") < F.max("root")
    open_ = told.groupBy("ref").agg(mixed.alias("mixed")).where("mixed").select("ref")
    rows = told.join(open_, "ref").select(
        "fp", "n", "inside", (1 - F.col("like")).alias("far"), "home", "root", "ref", F.explode(F.concat(
            F.transform("outer", lambda x: F.struct(x.alias("shingle"), F.lit(True).alias("outside"))),
            F.transform("inner", lambda x: F.struct(x.alias("shingle"), F.lit(False).alias("outside"))))).alias("s"))
    rows = rows.select(F.struct("ref", "s.shingle", "s.outside").alias("bucket"), "fp", "n", "inside", "far", "home", "root")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("m"), mixed.alias("mixed")).where("mixed").drop("mixed")
    return rows.join(sizes, "bucket")


def linked(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, root): the components of all candidate pairs that reach LIKE, for every class with a candidate.

    ``classes`` is stored: fp, least (row of ``docs``, see ``row_key``), n and bands.
    """
    placed = checkpointed_lean(references(classes))
    sets = checkpointed_lean(sets_of(docs, classes.join(placed, "fp", "left_semi")))
    pairs = placed.select(F.explode("refs").alias("a"), F.col("fp").alias("b")).where("a <> b")
    stars = checkpointed_lean(in_pairs(pairs, sets, relation,
                                       "n long, inside long, like double, outer array<long>, inner array<long>"))
    found = components(stars.where(F.col("like") >= LIKE))
    roots = checkpointed_lean(placed.withColumnRenamed("fp", "node").join(found, "node", "left")
                              .select("node", F.coalesce("root", "node").alias("root"), "home"))
    tried = stars.select(*_ordered("a", "b")).distinct()
    named = checkpointed(shared_prefixes(stars, roots))
    # The place of a class is the same share of every bucket, so that buckets of one group name the same centres.
    place = F.pmod(F.xxhash64("fp", F.lit(SEED + 1)), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("m")
    done, share = 0, CENTRES
    while True:
        # Of smaller buckets every member was a centre.
        left = named.where(F.col("m") > done)
        drawn = F.when((place >= done) & (place < done + share), F.struct("fp", "n", "inside", "far", "home", "root"))
        centres = checkpointed_lean(left.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"),
                                                               F.collect_list(drawn).alias("centres"))
                                    .where("low <> high").select("bucket", "centres"))
        if centres.isEmpty():
            return roots.select("node", "root")
        near = (left.join(centres, "bucket").withColumn("c", F.explode(F.filter("centres", lambda c: (
            c["root"] != F.col("root")) & ((c["home"] != F.col("home")) | (c["home"] == F.col("bucket.ref")))
            & (F.abs(c["far"] - F.col("far")) <= 1 - LIKE + 1e-9) & _near_in_size(c["n"], F.col("n"))
            & _enough(c, F.col("n"), F.col("inside")))))
            .select(*_ordered("fp", "c.fp"), *[x.alias(n) for x, n in (
                (F.when(F.col("fp") < F.col("c.fp"), F.col("root")).otherwise(F.col("c.root")), "ra"),
                (F.when(F.col("fp") < F.col("c.fp"), F.col("c.root")).otherwise(F.col("root")), "rb"))])
            .dropDuplicates(["a", "b"]))
        fresh = checkpointed_lean(near.join(tried, ["a", "b"], "left_anti"))
        if not fresh.isEmpty():
            checked = checkpointed_lean(compared(fresh.select("a", "b"), sets))
            joined = components(checked.where(F.col("like") >= LIKE).join(fresh, ["a", "b"]).select(
                F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("to"))
            if not joined.isEmpty():
                roots, named = (checkpointed_lean(df.join(joined, "root", "left").withColumn(
                    "root", F.coalesce("to", "root")).drop("to")) for df in (roots, named))
            tried = tried.union(checked.select("a", "b"))
        done, share = done + share, min(MOST, share * GROWTH)


def deduplicate(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, one row of each group of near copies: the one with the smallest doc_id.

    Null texts count as empty; texts without words are copies of each other. Among equal ids the smaller text
    hash stays, of wholly repeated rows one; null ids come last. An empty table gives an empty result.
    """
    rows = checkpointed(classes_of(docs))
    classes = checkpointed_lean(rows.groupBy("fp").agg(F.min(F.struct("row", "n", "bands")).alias("one"),
                                                       F.count("*").alias("n_rows"))
                                .select("fp", F.col("one.row").alias("least"), "one.n", "one.bands", "n_rows"))
    roots = linked(classes, docs)
    kept = heads(rows.select("row", "fp"), classes.select("fp", "least", "n_rows"), roots).where("row = head")
    whole = docs.select(row_key().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return whole.join(kept.select("row").distinct(), "row").dropDuplicates(["row"]).select("doc.*")
