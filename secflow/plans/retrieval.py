"""Text retrieval: chunks, weighted terms, nearest vectors and grounded context."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from secflow.plans.detection import first_rows, with_scalar
from secflow.settings import checkpointed, checkpointed_lean, lean, small_side

# Fixed values.
CHUNK, OVERLAP = 500, 50
TERMS = 20_000
#: Pivots of the vector groups; members and queries that meet in one task.
PIVOTS, MEMBERS, QUERIES = 64, 20_000, 2_000
#: Entries (a term of a document) that are multiplied at a time, and terms per row of partial sums.
ENTRIES_AT_ONCE, TERMS_AT_ONCE = 8192, 1024
#: Rows of sums of a block that one task adds at the end.
LANES = 64
TOKEN = "[\\\\p{L}\\\\p{N}_.-]{2,}"


def unique_documents(docs: DataFrame) -> DataFrame:
    """Identical texts once; the smallest id stays. Only hashes travel, not the texts."""
    keep = docs.select(F.sha2("text", 256).alias("h"), "doc_id").groupBy("h").agg(F.min("doc_id").alias("doc_id"))
    return docs.join(keep.select("doc_id"), "doc_id", "left_semi")


def chunks(docs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Fixed windows over the whole text with provenance."""
    step = size - overlap
    return docs.selectExpr(
        "doc_id", "source", "text",
        f"explode(sequence(0, greatest(0, cast(ceil((length(text) - {overlap}) / {step}D) as int) - 1))) as chunk_no").selectExpr(
        "doc_id", "source", "chunk_no", f"substr(text, chunk_no * {step} + 1, {size}) as chunk")


def term_counts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.selectExpr(key, f"explode(regexp_extract_all(lower(text), '{TOKEN}', 0)) as term").groupBy(key, "term").agg(
        F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, limit: int = TERMS) -> DataFrame:
    """The most frequent terms with their document frequency; at most ``limit`` rows."""
    return counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df")).orderBy(
        F.col("total").desc(), "term").limit(limit)


def idf(vocab: DataFrame, docs: DataFrame) -> DataFrame:
    sized = with_scalar(vocab, docs.agg(F.count("*").alias("_n")))
    return sized.selectExpr("term", "ln((1 + _n) / (1 + df)) + 1 as idf")


def weigh(counts: DataFrame, terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sublinear term weights, each document scaled to unit length."""
    raw = counts.join(F.broadcast(terms), "term").selectExpr(key, "term", "(1 + ln(tf)) * idf as w")
    norms = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, key).selectExpr(key, "term", "w / norm as w")


def tfidf(docs: DataFrame, limit: int = TERMS, store: Callable[[DataFrame], DataFrame] = checkpointed) -> tuple[DataFrame, DataFrame]:
    # Used for the vocabulary and for the weights, so the texts are cut into terms once.
    counts = store(term_counts(docs))
    terms = idf(vocabulary(counts, limit), docs)
    return weigh(counts, terms), terms


def similar(doc_weights: DataFrame, query_weights: DataFrame, k: int, query: str = "query_id") -> DataFrame:
    """Best k documents per query through the terms they share. The query side is broadcast when small."""
    shared = doc_weights.join(small_side(query_weights.withColumnRenamed("w", "qw")), "term")
    scored = shared.groupBy(query, "doc_id").agg(F.round(F.sum(F.col("w") * F.col("qw")), 8).alias("score"))
    return first_rows(scored, [query], [F.col("score").desc(), F.col("doc_id")], k)


def anchors(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """One exact document per anchor (columns query_id, anchor)."""
    exact = docs.groupBy(F.col("source").alias("anchor")).agg(F.min("doc_id").alias("doc_id"))
    return queries.join(exact, "anchor").select("query_id", "doc_id")


def grounded(anchored: DataFrame, semantic: DataFrame, k: int) -> DataFrame:
    """Exact context first, then similar, without duplicates, k in total."""
    both = anchored.selectExpr("query_id", "doc_id", "0 as priority", "0L as place").unionByName(
        semantic.selectExpr("query_id", "doc_id", "1 as priority", "rank as place"))
    once = both.groupBy("query_id", "doc_id").agg(F.min(F.struct("priority", "place")).alias("p"))
    return first_rows(once, ["query_id"], [F.col("p"), F.col("doc_id")], k).selectExpr(
        "query_id", "doc_id", "p.priority as priority", "rank")


def label_centroids(vectors: DataFrame) -> DataFrame:
    """Mean vector per label: a handful of query vectors made from the whole table."""
    flat = vectors.select("label", F.posexplode("embedding").alias("i", "x"))
    means = flat.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(F.expr("transform(sort_array(collect_list(struct(i, x))), e -> e.x)").alias("query"))


def _angles(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(v @ pivots.T, -1, 1))


def _unit(vector: str) -> str:
    length = f"sqrt(aggregate({vector}, 0D, (s, x) -> s + x * x))"
    return f"transform({vector}, x -> x / {length})"


def _meet(k: int):
    """Best k members for each query of one block of a group: by score to six digits, then id."""
    def run(members: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if members.empty or asked.empty:
            return pd.DataFrame(columns=["query", "vec_id", "score"])
        ids = members["vec_id"].to_numpy()
        scores = np.floor(np.stack(asked["v"]) @ np.stack(members["v"]).T * 1e6 + 0.5) / 1e6
        out = []
        for query, row in zip(asked["query"], scores, strict=True):
            enough = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
            best = enough[np.lexsort((ids[enough], -row[enough]))][:k]
            out.append(pd.DataFrame({"query": query, "vec_id": ids[best], "score": row[best]}))
        return pd.concat(out, ignore_index=True)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int, pivots: int = PIVOTS, block: int = MEMBERS,
            asked_at_once: int = QUERIES) -> DataFrame:
    """Exact cosine top-k for any number of queries (columns label, query): query, vec_id, score, rank.

    Vectors are grouped by their nearest pivot and stored with their angle to it. A query first meets the groups
    that may hold its nearest vectors and have k members together; after that only groups that the triangle
    inequality on angles allows to hold something better than its k-th. Groups and their queries meet in blocks of
    bounded size, so neither side is broadcast; only the pivots and one row per group go to all tasks. Vectors and
    queries of length zero have no direction and take no part.
    """
    spark = vectors.sparkSession
    kind = dict(queries.dtypes)["label"]
    some = vectors.selectExpr("vec_id", "transform(embedding, x -> double(x)) as v").where(
        "aggregate(v, 0D, (s, x) -> s + x * x) > 0").selectExpr("vec_id", f"{_unit('v')} as v")
    asked = queries.where("aggregate(query, 0D, (s, x) -> s + x * x) > 0").selectExpr("label as query", f"{_unit('query')} as v")
    chosen = some.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()  # at most ``pivots`` rows
    empty = spark.createDataFrame([], f"query {kind}, vec_id bigint, score double, rank bigint")
    if not chosen:
        return empty
    at = np.array([r["v"] for r in chosen])

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                apart = _angles(np.stack(frame["v"]), at)
                yield frame.assign(grp=apart.argmin(1), angle=apart.min(1))

    members = checkpointed(some.mapInPandas(assign, "vec_id bigint, v array<double>, grp int, angle double"))
    groups = {r["grp"]: (r["n"], r["far"]) for r in members.groupBy("grp").agg(
        F.count("*").alias("n"), F.max("angle").alias("far")).collect()}  # at most ``pivots`` rows
    names = np.array(sorted(groups))
    size, far = (np.array([groups[g][i] for g in names]) for i in (0, 1))

    def visits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query with each group, the nearest it may come to it, and whether it is looked at first."""
        for frame in frames:
            if not len(frame):
                continue
            low = np.maximum(0, _angles(np.stack(frame["v"]), at[names]) - far)
            order = np.argsort(low, axis=1, kind="stable")
            before = np.cumsum(size[order], axis=1) - size[order]
            first = np.empty(low.shape, bool)
            np.put_along_axis(first, order, before < k, axis=1)
            many = len(names)
            yield pd.DataFrame({"query": frame["query"].repeat(many).to_numpy(), "v": frame["v"].repeat(many).to_numpy(),
                                "grp": np.tile(names, len(frame)), "most": np.cos(low).ravel(), "first": first.ravel()})

    pairs = checkpointed(asked.mapInPandas(visits, f"query {kind}, v array<double>, grp int, most double, first boolean"))
    blocks = spark.createDataFrame([(int(g), int(-(-n // block))) for g, (n, _) in groups.items()], "grp int, blocks int")

    def found(visited: DataFrame) -> DataFrame:
        lanes = visited.groupBy("grp").agg(F.ceil(F.count("*") / asked_at_once).cast("int").alias("lanes"))
        plan = F.broadcast(blocks.join(lanes, "grp"))  # one row for each group
        left = members.join(plan, "grp").select(
            "grp", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("b"),
            F.explode(F.expr("sequence(0, lanes - 1)")).alias("lane"), "vec_id", "v")
        right = visited.join(plan, "grp").select(
            "grp", F.explode(F.expr("sequence(0, blocks - 1)")).alias("b"),
            F.pmod(F.xxhash64("query"), "lanes").cast("int").alias("lane"), "query", "v")
        return left.groupBy("grp", "b", "lane").cogroup(right.groupBy("grp", "b", "lane")).applyInPandas(
            _meet(k), f"query {kind}, vec_id bigint, score double")

    best = [F.col("score").desc(), F.col("vec_id")]
    head = checkpointed(first_rows(found(pairs.where("first")), ["query"], best, k))
    least = head.where(F.col("rank") == k).select("query", F.col("score").alias("least"))
    # A bound a little below the k-th score may still round up to it.
    more = pairs.where("not first").join(least, "query", "left").where("least is null or most >= least - 2e-6D")
    both = head.drop("rank").unionByName(found(more.drop("least")))
    return first_rows(both.withColumn("score", F.round("score", 6)), ["query"], best, k)


def query_text(events: DataFrame, hits: DataFrame) -> DataFrame:
    """Query built from the event itself: its rules, command line, process, kind and port."""
    rules = hits.groupBy("event_id").agg(F.array_join(F.sort_array(F.collect_set(
        F.concat_ws(" ", "technique", "title"))), " ").alias("rules"))
    return events.join(rules, "event_id", "left").selectExpr(
        "event_id", "concat_ws(' ', rules, left(command_line, 200), process_name, concat(category, ' ', action), "
                    "if(coalesce(dst_port, 0) <> 0, concat('port ', dst_port), null)) as query")


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of whole documents, each with at least one entry: (first, one past the last, first entry of each document,
    term numbers, weights). A run has at most ENTRIES_AT_ONCE entries, or one document."""
    ends = batch.column("i").offsets.to_numpy()
    ends = ends - ends[0]
    at, w = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("i", "w"))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + ENTRIES_AT_ONCE, side="right")) - 1)
        yield a, b, ends[a:b] - ends[a], at[ends[a]:ends[b]], w[ends[a]:ends[b]]
        a = b


def _times(starts: np.ndarray, at: np.ndarray, w: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Documents of a block times basis."""
    return np.add.reduceat(basis[at] * w[:, None], starts, axis=0)


def _sums(numbers: list[int], sums: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(sums, pa.binary())], ["block", "sums"])


def _partial(shared: Broadcast):
    """Per partition and block of terms, the sum of A'(A basis)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis = shared.value
        total = np.zeros(basis.shape)
        for batch in batches:
            for _, _, starts, at, w in _blocks(batch):
                made = _times(starts, at, w, basis)
                order = np.argsort(at, kind="stable")
                of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(at)]))[order]
                first = np.flatnonzero(np.r_[True, at[order][1:] != at[order][:-1]])
                total[at[order][first]] += np.add.reduceat(made[of] * w[order][:, None], first, axis=0)
        for b in range(0, len(basis), TERMS_AT_ONCE):
            yield _sums([b], [total[b:b + TERMS_AT_ONCE].tobytes()])

    return run


def _add_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Add sums of equal block as they come in; memory holds one sum for each block."""
    sums: dict[int, np.ndarray] = {}
    for frame in frames:
        for block, raw in zip(frame["block"], frame["sums"], strict=True):
            part = np.frombuffer(raw)
            sums[block] = sums[block] + part if block in sums else part
    if sums:
        yield pd.DataFrame({"block": list(sums), "sums": [x.tobytes() for x in sums.values()]})


def summed(partials: DataFrame, lanes: int = LANES) -> DataFrame:
    """One row (block, sums) per block from the sums of all partitions, in two steps.

    The partitions' rows are dealt into ``lanes`` for each block first, so a task adds a lane's share as it
    streams in and the last step adds ``lanes`` rows a block, however many partitions there were.
    """
    kind = "block int, sums binary"
    dealt = partials.withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(lanes)))
    first = dealt.repartition("block", "lane").select("block", "sums").mapInPandas(_add_up, kind)
    return first.repartition("block").mapInPandas(_add_up, kind)


def latent_vectors(docs: DataFrame, dims: int = 128, limit: int = TERMS, extra: int = 12, rounds: int = 3) -> DataFrame:
    """Documents in the space of the ``dims`` strongest directions of the weighted term matrix A: U S of its SVD.

    Subspace iteration: every round multiplies A'A onto a basis of the terms in one pass over the documents;
    partitions send sums of fixed size (terms x (dims + extra)). At the end the small matrix (A Q)'(A Q) turns
    the projections into U S. Documents without terms of the vocabulary get a zero vector.
    """
    weights, terms = tfidf(docs, limit, checkpointed_lean)
    index = checkpointed(terms.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("i")))
    # Term numbers and weights as two flat arrays: Arrow hands them to numpy as they are, with no object per entry.
    rows = checkpointed_lean(weights.join(F.broadcast(index), "term").groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("i").cast("int").alias("i"), "w"))).alias("terms")).select(
        "doc_id", F.col("terms.i").alias("i"), F.col("terms.w").alias("w")))
    # A task sends sums of the same size for any share of the documents, so a round has one task for each core.
    context = docs.sparkSession.sparkContext
    few = rows.select("i", "w").coalesce(context.defaultParallelism)
    n, width = index.count(), min(dims + extra, index.count())
    basis = np.random.default_rng(3).normal(size=(n, width))
    for _ in range(rounds if n else 0):
        shared = context.broadcast(np.linalg.qr(basis)[0])
        got = lean(summed(few.mapInArrow(_partial(shared), "block int, sums binary"))).collect()  # terms x width numbers
        shared.destroy()  # each executor has a copy on disk
        basis = np.zeros((n, width))
        for block, raw in got:
            part = np.frombuffer(raw).reshape(-1, width)
            basis[block:block + len(part)] = part
    q = np.linalg.qr(basis)[0] if n else basis
    shared = context.broadcast(q)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for _, _, *entries in _blocks(batch):
                y = _times(*entries, shared.value)
                total += y.T @ y
        yield _sums([0], [total.tobytes()])

    small = (lean(summed(few.mapInArrow(gram, "block int, sums binary"))).collect() or [None])[0]
    turn = np.linalg.eigh(np.frombuffer(small[1]).reshape(width, width))[1][:, ::-1][:, :dims] if small and n else q[:0]
    shared.destroy()
    toward = q @ turn if n else q
    directions = context.broadcast(toward)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, *entries in _blocks(batch):
                y = _times(*entries, directions.value)
                ends = pa.array(np.arange(0, y.size + 1, y.shape[1]), pa.int32())
                vectors = pa.ListArray.from_arrays(ends, pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], vectors], ["doc_id", "vector"])

    zero = F.array_repeat(F.lit(0.0), toward.shape[1])
    vectors = rows.mapInArrow(project, f"doc_id {dict(docs.dtypes)['doc_id']}, vector array<double>")
    return docs.select("doc_id").join(vectors, "doc_id", "left").select("doc_id", F.coalesce("vector", zero).alias("vector"))
