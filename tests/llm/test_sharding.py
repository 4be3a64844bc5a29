from __future__ import annotations

from collections import defaultdict

import text_cases

from secflow.llm.sharding import shard_by_bytes


def check(docs, shards, slack_rows=1):
    got = shard_by_bytes(docs, shards).collect()
    by = defaultdict(list)
    for r in got:
        assert r["size"] == len((r["text"] or "").encode()) + 1
        by[r["shard"]].append(r)
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    return got, by


def test_sizes_are_near_equal_and_nothing_is_lost(spark):
    data = [(i, "w" * (i * 37 % 900), "en", "s", 0) for i in range(3000)]
    got, by = check(text_cases.documents(spark, data), 8)
    assert sorted(r["doc_id"] for r in got) == list(range(3000))
    sums = [sum(r["size"] for r in by[s]) for s in range(8)]
    assert max(sums) - min(sums) <= 2 * 900 + 0.01 * sum(sums) / 8


def test_small_groups_of_equal_texts_stay_together_and_a_huge_one_is_cut(spark):
    data = [(i, f"text {i // 3} " + "v" * 50, "en", "s", 0) for i in range(3000)]
    got, _ = check(text_cases.documents(spark, data), 4)
    shards = defaultdict(set)
    for r in got:
        shards[r["text"]].add(r["shard"])
    assert all(len(s) == 1 for s in shards.values())
    hot = [(i, "the same text", "en", "s", 0) for i in range(1000)]
    _, by = check(text_cases.documents(spark, hot), 4)
    assert {s: len(rows) for s, rows in by.items()} == {0: 250, 1: 250, 2: 250, 3: 250}


def test_odd_rows_and_empty_table(spark):
    docs = text_cases.documents(spark)
    got, by = check(docs, 3)
    assert len(got) == docs.count() and set(docs.columns) <= set(got[0].asDict())
    assert shard_by_bytes(text_cases.documents(spark, []), 8).count() == 0
    assert len(check(text_cases.documents(spark, [(1, None, None, None, None)]), 8)[0]) == 1
