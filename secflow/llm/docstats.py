"""Statistics of whole texts: counts for rules, ratios for models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secflow.llm.common import held_out, map_text

#: ASCII white space splits words; the characters that count as symbols.
SPACES, SYMBOLS = b"\t\n\x0b\x0c\r ", b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["log_chars", "log_words", "word_length", "symbols", "upper", "digits", "punctuation", "beyond_ascii",
          "dup_lines", "repeats", "distinct", "line_words"]

_IS = {name: np.isin(np.arange(256), list(chars)).astype(np.float64) for name, chars in {
    "space": SPACES, "symbol": SYMBOLS, "upper": bytes(range(65, 91)), "digit": bytes(range(48, 58)),
    "punct": b"!\"'(),-./:;?@[\\]^_`{}~", "high": bytes(range(128, 256))}.items()}
_TABLE = np.stack([_IS[k] for k in ("space", "symbol", "upper", "digit", "punct", "high")], 1)


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """(words inside 3-word windows that occur twice or more, the first occurrence included; distinct words)."""
    place = {w: i for i, w in enumerate(dict.fromkeys(words))}
    n, kinds = len(words), len(place)
    if n < 4 or kinds == n:
        return 0, kinds
    ids = np.fromiter(map(place.__getitem__, words), np.int64, n)
    pairs = ids[:-1] * kinds + ids[1:]
    if kinds >= 2_000_000:  # so that the next product stays inside 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * kinds + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0, kinds
    starts = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[starts + shift] = True
    return int(covered.sum()), kinds


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    """The counts, and all ratios as one matrix ``ratios``; every ratio is 0 where it has no base."""
    n = len(texts)
    bytes_of = np.zeros((n, 256))
    counts = np.zeros((n, 5), np.int64)
    extra = np.zeros((n, 3))
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "replace")
        bytes_of[i] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        words = raw.split()
        repeats, kinds = repeated_words(words)
        lines = [x for x in text.split("\n") if x.strip("\t\x0b\x0c\r ")]
        counts[i] = len(words), 0, 0, len(lines) - len(set(lines)), repeats
        extra[i] = len(text), kinds, len(lines)
    kinds_of = bytes_of @ _TABLE
    counts[:, 1] = extra[:, 0] - kinds_of[:, 0]
    counts[:, 2] = kinds_of[:, 1]
    words, chars = np.maximum(counts[:, 0], 1), np.maximum(counts[:, 1], 1)
    lines, size = np.maximum(extra[:, 2], 1), np.maximum(bytes_of.sum(1), 1)
    ratios = np.stack([
        np.log1p(extra[:, 0]), np.log1p(counts[:, 0]), counts[:, 1] / words, kinds_of[:, 1] / chars,
        kinds_of[:, 2] / chars, kinds_of[:, 3] / chars, kinds_of[:, 4] / chars, kinds_of[:, 5] / size,
        counts[:, 3] / lines, counts[:, 4] / words, extra[:, 1] / words, np.log1p(counts[:, 0] / lines)], 1)
    return {name: counts[:, k] for k, name in enumerate(COUNTS)} | {"ratios": ratios}


def with_stats(docs: DataFrame, text: str = "text", key: str = "doc_id", counts: bool = True,
               extra: dict[str, str] | None = None) -> DataFrame:
    """(key, columns ``extra``, the counts, ratios) of every row; null texts count as empty."""
    names = COUNTS if counts else []

    def run(texts: list[str]) -> dict[str, list]:
        got = measure(texts)
        return {n: got[n] for n in names} | {"ratios": list(got["ratios"])}

    schema = ", ".join([*(f"{n} long" for n in names), "ratios array<double>"])
    kept = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias(text), *(extra or {}))
    return map_text(kept, text, run, schema, {key: "long"} | (extra or {}))


def learnable(labels: DataFrame, column: str, key: str = "doc_id") -> DataFrame:
    """(key, y): one row per id that may be learned from. Ids with several labels take the smallest; null
    ids and null labels are left out."""
    return (labels.where(F.col(column).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
            .groupBy(F.col(key).cast("long").alias(key)).agg(F.min(F.col(column).cast("int")).alias("y")))


def training_sample(docs: DataFrame, labels: DataFrame, column: str, most: int, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` with a label ``y``: at most ``most`` ids in the order of their hash.

    The bound is what proves that the labels may be broadcast to the texts.
    """
    few = learnable(labels, column, key).orderBy(F.xxhash64(key), key).limit(most)
    return docs.join(F.broadcast(few), key)
