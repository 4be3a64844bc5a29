from __future__ import annotations

import random
import re

import numpy as np
import text_cases
import xxhash

from secflow.llm import simhash
from secflow.llm.common import components


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(values, most=4):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= most:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(values))]


def test_fingerprints_equal_the_definition():
    for _, text, *_ in text_cases.rows()[:75]:
        assert simhash.fingerprint(text or "") == plain_fingerprint(text)
    assert simhash.fingerprint("Ab cD") == simhash.fingerprint(" aB\tCd\n") and simhash.fingerprint("\x85") != 0


def test_gray_rank_orders_neighbours_by_one_bit():
    codes = np.arange(256, dtype=np.uint64)
    in_order = codes[np.argsort(simhash.gray_rank(codes))]
    assert (np.bitwise_count(in_order[1:] ^ in_order[:-1]) == 1).all()


def test_index_finds_every_link_in_clustered_and_random_fingerprints():
    rng = random.Random(6)
    for spread in (0, 3, 6, 64):
        centres = [rng.getrandbits(64) for _ in range(6)]
        values = set()
        while len(values) < 400:
            v = rng.choice(centres)
            for _ in range(spread):
                v ^= (1 << rng.randrange(64)) if rng.random() < 0.6 else 0
            values.add(v if spread else v ^ rng.getrandbits(12))
        values = sorted(values)
        under = np.array([v >> 63 for v in values])
        a, b = simhash.GrayIndex(np.array(values, np.uint64), under).stars(4)
        head = dict(zip(a.tolist(), b.tolist(), strict=True))
        for side in (0, 1):
            own = [v for v in values if v >> 63 == side]
            assert [head.get(v, v) for v in own] == [own[r] for r in brute_groups(own)]


def test_components_of_long_chains_stars_and_repeated_edges(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(10, 60)] + [(70, 71), (71, 70), (70, 71), (9, 9)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 100 for i in range(100, 161)} | {i: 5 for i in [5, *range(10, 60)]} | {70: 70, 71: 70}


def near(rng, text):
    words = text.split(" ")
    words[rng.randrange(len(words))] = "changed"
    return " ".join(words)


def with_near_copies():
    rng = random.Random(8)
    data = text_cases.rows()
    long = [text_cases.prose(rng, 400) for _ in range(5)]
    return data + [(1000 + i, near(rng, long[i % 5]), "en", "s", 0) for i in range(60)]


def test_components_of_documents_against_all_pairs(spark):
    data = with_near_copies()
    got = simhash.near_duplicates(text_cases.documents(spark, data)).collect()
    assert len(got) == len(data)
    order = sorted(data, key=lambda d: (d[0] is None, d[0] or 0))
    values = [plain_fingerprint(d[1]) for d in order]
    heads = [order[r][0] for r in brute_groups(values)]
    want = sorted(((d[0], f"{v:016x}", h) for d, v, h in zip(order, values, heads, strict=True)), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want


def test_deduplicate_keeps_one_row_of_each_group(spark):
    data = with_near_copies()
    docs = text_cases.documents(spark, data)
    got = simhash.deduplicate(docs).collect()
    values = [plain_fingerprint(d[1]) for d in data]
    groups = brute_groups(values)
    left = [groups[values.index(plain_fingerprint(r["text"]))] for r in got]
    assert sorted(left) == sorted(set(groups)) and got[0]["fp"] == "clash"
    assert simhash.deduplicate(text_cases.documents(spark, [])).count() == 0
    assert simhash.near_duplicates(text_cases.documents(spark, [])).count() == 0


def test_more_blocks_give_the_same_links(spark, monkeypatch):
    data = with_near_copies()
    docs = text_cases.documents(spark, data)
    before = {tuple(r) for r in simhash.near_duplicates(docs).collect()}
    monkeypatch.setattr(simhash, "NODE", 0)
    assert len(simhash.block_masks(1000)) == 70
    assert {tuple(r) for r in simhash.near_duplicates(docs).collect()} == before
