"""Sequences of bounded length: first-fit decreasing with a tournament tree of bin capacities.

A document's ids and one closing id are cut into full sequences and a rest. Rests are put by falling length
into the first bin with room. The bins' free places are the leaves of a tournament tree whose inner nodes
hold the larger child, so the first bin with room is found by one walk from the root.

Scale: documents are dealt at random into groups of about GROUP documents, each packed on its own; a group is
small whatever the data, so equal lengths or copies cannot gather in one. Only piece lengths and checksums
move; texts are read once and ids stay where they were made.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from secflow.llm.common import map_text
from secflow.settings import checkpointed

LENGTH, CLOSING, GROUP, SEED = 2048, 1, 4096, 5


class FirstFit:
    """Bins of equal size; ``put`` finds the first one with room, opening one if there is none."""

    def __init__(self, size: int, bins: int) -> None:
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [size] * (2 * self.leaves)

    def put(self, length: int) -> tuple[int, int]:
        """(bin, free places of it before)."""
        node, free = 1, self.free
        while node < self.leaves:
            node *= 2
            if free[node] < length:
                node += 1
        before = free[node]
        free[node] = before - length
        leaf = node - self.leaves
        while node > 1:
            node //= 2
            top = max(free[2 * node], free[2 * node + 1])
            if free[node] == top:
                break
            free[node] = top
        return leaf, before


@lru_cache(maxsize=2)
def _encoders(json_path: str, ranks_path: str, pattern: str) -> tuple[Tokenizer, tiktoken.Encoding, list[str]]:
    slow = Tokenizer.from_file(json_path)
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return slow, fast, [t.content for t in slow.get_added_tokens_decoder().values()]


def token_ids(text: str, json_path: str, ranks_path: str, pattern: str) -> np.ndarray:
    """Ids of the vocabulary. Its rank file gives the same ids faster, except where a text spells an added token."""
    slow, fast, added = _encoders(json_path, ranks_path, pattern)
    if any(token in text for token in added):
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    return fast.encode_to_numpy(text, disallowed_special=())


def pieces(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, length: int = LENGTH,
           with_ids: bool = False) -> DataFrame:
    """doc_id, tokens (closing id included) and parts of every row: per piece its crc and, if asked for, its ids."""

    def run(texts: list[str]) -> dict[str, list]:
        ids = [np.append(token_ids(t, json_path, ranks_path, pattern), np.uint32(CLOSING)).astype("<u4")
               for t in texts]
        cut = [[x[a:a + length] for a in range(0, len(x), length)] for x in ids]
        return {"tokens": [len(x) for x in ids],
                "parts": [[{"crc": zlib.crc32(x.tobytes())} | ({"ids": x.astype(np.int32)} if with_ids else {})
                           for x in parts] for parts in cut]}

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = f"tokens long, parts array<struct<crc: bigint{', ids: array<int>' if with_ids else ''}>>"
    return map_text(kept, "text", run, schema, {"doc_id": "long"})


def pack_group(tokens: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per piece of one group: place of its document, start, sequence of the group, offset in it."""
    full, rest = np.divmod(tokens, length)
    owner = np.repeat(np.arange(len(tokens)), full)
    start = length * (np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full))
    late = np.flatnonzero(rest)
    late = late[np.argsort(-rest[late], kind="stable")]
    bins = FirstFit(length, len(late))
    placed = [bins.put(n) for n in rest[late].tolist()]
    leaf = np.array([p[0] for p in placed], np.int64)
    offset = np.array([length - p[1] for p in placed], np.int64)
    return (np.r_[owner, late], np.r_[start, length * full[late]], np.r_[np.arange(len(owner)), len(owner) + leaf],
            np.r_[np.zeros(len(owner), np.int64), offset])


def pack(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, length: int = LENGTH,
         with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids.

    Every document has at least its closing id, so null and empty texts become a piece of length 1. Null ids
    and repeated rows are packed like others; each row's pieces lie in one group. An empty table gives an
    empty result; other columns are not looked at. Ids, when asked for, travel with their piece.
    """
    rows = checkpointed(pieces(docs, json_path, ranks_path, pattern, length, with_ids)
                        .withColumn("row", F.monotonically_increasing_id()))
    groups = max(1, -(-rows.count() // GROUP))
    dealt = rows.select("row", "tokens", F.pmod(F.xxhash64("row", F.lit(SEED)), F.lit(groups)).alias("dealt"))

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row", ignore_index=True)
        owner, start, sequence, offset = pack_group(frame["tokens"].to_numpy(), length)
        return pd.DataFrame({"row": frame["row"].to_numpy()[owner], "start": start,
                             "sequence_id": sequence * groups + int(frame["dealt"].iloc[0]), "offset": offset})

    kind = "row long, start long, sequence_id long, offset long"
    placed = dealt.groupBy("dealt").applyInPandas(place, kind)
    # One row per piece before the join, so that a piece carries its own ids and no more.
    each = (rows.select("row", "doc_id", "tokens", F.posexplode("parts").alias("piece", "part"))
            .withColumn("start", F.col("piece").cast("long") * length))
    whole = each.join(placed, ["row", "start"])
    return whole.select(
        "doc_id", "start", F.least(F.lit(length), F.col("tokens") - F.col("start")).cast("long").alias("length"),
        F.col("part.crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"), "sequence_id", "offset",
        *([F.col("part.ids").alias("ids")] if with_ids else []))
