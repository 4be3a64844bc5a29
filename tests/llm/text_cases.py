"""Small documents with the cases every operator has to stand: nulls, empty and long texts, ties, repeats, clashes."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that clash with names the operators use inside.
CLASHING = ["row", "fp", "key", "size", "shard", "slot", "_text", "bucket", "score", "found", "tokens", "dealt", "y", "_key", "_size", "_range", "_id", "doc", "cuts", "new"]
WORDS = [a + b for a in ("the", "an", "ver", "ein", "zu", "é", "漢") for b in ("", "tion", "ing", "heit", "ó", "x")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".\n"]) for _ in range(n))


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    out = [(i, prose(rng, rng.randrange(1, 160)), rng.choice(["en", "de"]), f"src{rng.randrange(12)}")
           for i in range(n)]
    copy = out[3][1]
    out += [(n + i, copy, "en", f"src{i % 12}") for i in range(n // 2)]  # a third of all rows is one text
    out += [(n + 100, None, "en", "src1"), (n + 101, "", None, None), (None, out[5][1], "en", None),
            (n + 102, " \n\t ", "en", "src2"), (n + 103, prose(rng, 20_000), "de", "src3"),
            (n + 104, "x" * 30_000, "de", "src3"), (n + 105, "word", "en", "src4"), out[7], out[7]]
    return [(i, t, lang, source, len(t or "")) for i, t, lang, source in out]


def documents(spark, data: list[tuple] | None = None, clashing: bool = True):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows() if data is None else data, SCHEMA)
    return docs.select("*", *[F.lit("clash").alias(c) for c in CLASHING]) if clashing else docs


def labels(spark, data: list[tuple]):
    return spark.createDataFrame(data, "doc_id long, quality int, toxic int")
