from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import text_cases
from pyspark.sql import functions as F

from secflow.llm import bag_search
from secflow.llm.registry import section

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(SMALL))


def brute(docs: list[tuple], items: list[tuple], k: int = 20) -> list[tuple]:
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, b.total()) for i, b in bags if b]
    n, length = len(bags), sum(size for _, _, size in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, b, size in bags:
            m = 75 + (25 * size * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m))
                    for t in terms(text) if t in b)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, at + 1, i, -s) for at, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return out


def as_key(row: tuple) -> tuple:
    return tuple((x is None, x or 0) for x in row)


def same(got, expected: list[tuple]) -> None:  # noqa: ANN001
    assert sorted((tuple(r) for r in got.collect()), key=as_key) == sorted(expected, key=as_key)


@pytest.fixture
def items(spark):
    rng = random.Random(8)
    rows = [(i, text_cases.prose(rng, rng.randrange(1, 30))) for i in range(12)]
    rows += [(20, None), (21, ""), (22, "nowhere-found"), (3, rows[3][1]), (None, rows[4][1]), (23, "word THE Word")]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("row", F.lit(1)), rows


@pytest.mark.parametrize("entries", [10**6, 40])
def test_ranks_equal_brute_force_in_one_block_and_in_many(spark, items, entries):
    docs = text_cases.documents(spark)
    data = [(r[0], r[1]) for r in text_cases.rows()]
    same(bag_search.search(docs, items[0], entries=entries), brute(data, items[1]))


def test_few_results_ties_and_classes_larger_than_k(spark, items):
    data = [(i, "the word, again", "en", "s", 15) for i in range(90, 30, -1)] + [(500, "THE WORD", "en", "s", 8)]
    data += [(None, "the word, again", "en", "s", 15)]
    docs = text_cases.documents(spark, data)
    for k in (1, 3, 20):
        same(bag_search.search(docs, items[0], k), brute([(r[0], r[1]) for r in data], items[1], k))
    assert bag_search._members(bag_search.bags(docs, {b"the": 0}).withColumn("row", F.monotonically_increasing_id()),
                               62, 185, 3).count() == 4


def test_empty_tables(spark, items):
    none = text_cases.documents(spark, [])
    assert bag_search.search(none, items[0]).count() == 0
    assert bag_search.search(text_cases.documents(spark), items[0].limit(0)).count() == 0


def test_large_scores_are_exact():
    rng = np.random.default_rng(1)
    for scale in (1, 1 << 36):
        term, item = rng.integers(0, 5, 40), rng.integers(0, 3, 40)
        weight = rng.integers(1, 9, 40) * scale
        found = bag_search.Postings(term, item, weight, 3, 5)
        assert found.exact == (scale == 1)
        tf, m = rng.integers(1, 9, 5), np.array([75, 140])
        got = found.scores(np.array([0, 0, 1, 1, 1]), np.array([0, 3, 1, 2, 4]), tf, m)
        expected = np.zeros((2, 3), object)
        for owner, t, n in zip([0, 0, 1, 1, 1], [0, 3, 1, 2, 4], tf.tolist(), strict=True):
            for tt, i, w in zip(term, item, weight.tolist(), strict=True):
                if tt == t:
                    expected[owner, i] += w * (10**9 * n // (1000 * n + 12 * int(m[owner])))
        assert got.tolist() == expected.tolist()


def test_query_equals_its_sql(spark, tmp_path, items):
    data = [r for r in text_cases.rows() if r[0] is not None]
    data = list({r[0]: r for r in data}.values())
    text_cases.documents(spark, data, clashing=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items[1][:12] + [(20, None), (21, "")], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    got = section.queries["op13_lexical_search"](spark, str(tmp_path))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    same(got, db.execute(section.checks["op13_lexical_search"]).fetchall())
