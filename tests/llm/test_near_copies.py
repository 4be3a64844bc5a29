from __future__ import annotations

import random
import re

import corpus_pipeline
import numpy as np
import text_cases
from pyspark.sql import functions as F
from test_settings import left_over, shuffle_files

from secflow.llm import near_copies
from secflow.settings import checkpointed


def plain_set(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_groups(texts):
    sets, parent = [plain_set(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if plain_similarity(sets[i], sets[j]) >= 0.8:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(sets))]


def copy_at(rng, text, low, high):
    """A copy with single words changed until its similarity is in [low, high), or None."""
    words, own = text.split(), plain_set(text)
    while True:
        words[rng.randrange(len(words))] = f"new{rng.randrange(10 ** 6)}"
        s = plain_similarity(own, plain_set(" ".join(words)))
        if s < high:
            return " ".join(words) if s >= low else None


def planted(seed=3, each=40):
    """(texts in pairs, their similarity): copies from 0.7 to 0.95."""
    rng, out = random.Random(seed), []
    for low in (0.7, 0.75, 0.8, 0.85, 0.9):
        n = 0
        while n < each:
            text = text_cases.prose(rng, rng.randrange(150, 600))
            if other := copy_at(rng, text, low, low + 0.05):
                out += [text, other]
                n += 1
    return out


def kept(spark, texts):
    docs = text_cases.documents(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    got = corpus_pipeline.one_of_each(spark, docs, "")
    assert got.columns == docs.columns
    return sorted(r["doc_id"] for r in got.collect())


def test_shingles_and_similarity_equal_the_definition():
    texts = [r[1] for r in text_cases.rows()[:70]]
    for a, b in zip(texts, texts[1:] + texts[:1], strict=True):
        x, y = (near_copies.shingles(near_copies.words_of(t or "")) for t in (a, b))
        assert len(x) == len(plain_set(a)) and near_copies.similarity(x, y) == plain_similarity(plain_set(a), plain_set(b))


def test_keys_meet_as_often_as_the_head_says():
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(400):  # sets of 180 with 160 in common: 0.8
        both = rng.integers(0, 1 << 63, 200, np.uint64)
        met += bool((near_copies.bands(np.sort(both[:180])) == near_copies.bands(np.sort(both[20:]))).any())
    assert met >= 396


def test_the_stage_finds_planted_copies_from_the_limit_on_and_no_others(spark):
    texts = planted()
    groups = brute_groups(texts)
    want = sorted({g for g in groups})
    assert len(want) == 2 * 80 + 120 and kept(spark, texts) == want


def test_a_group_without_one_common_centre_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "CENTRES", 2)  # so that buckets take several rounds
    rng = random.Random(5)
    chain = [text_cases.prose(rng, 300)]
    for _ in range(30):  # each like the one before, the ends unlike
        chain.append(copy_at(rng, chain[-1], 0.9, 0.95) or chain[-1])
    star = [c for c in (copy_at(rng, chain[0], 0.8, 0.95) for _ in range(40)) if c]
    texts = chain + star + [r[1] for r in text_cases.rows()[:80]] + [None, "", " \t", "one", "One", "two words"]
    groups = brute_groups(texts)
    assert kept(spark, texts) == sorted(set(groups))
    assert corpus_pipeline.one_of_each(spark, text_cases.documents(spark, []), "").count() == 0


def changed(rng, text, n):
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.randrange(10 ** 9)}"
    return " ".join(words)


def test_prefixes_of_pairs_above_the_limit_meet():
    rng, met = np.random.default_rng(2), 0
    for _ in range(3000):
        centre = np.sort(rng.choice(400, rng.integers(60, 140), replace=False)).astype(np.uint64)
        whole = np.concatenate([centre, rng.choice(np.arange(400, 900), rng.integers(0, 30), replace=False)]).astype(np.uint64)
        kept = rng.permutation(whole)[:rng.integers(40, len(whole) + 1)]
        a, b = (np.unique(np.concatenate([kept[rng.random(len(kept)) > 0.05], rng.integers(900, 2000, 3, np.uint64)]))
                for _ in range(2))
        (na, ia, la, oa, wa), (nb, ib, lb, ob, wb) = (near_copies.relation(centre, x) for x in (a, b))
        if near_copies.similarity(a, b) < 0.8 or (la >= 0.8 and lb >= 0.8):
            continue
        met += 1
        outside = len(np.intersect1d(np.setdiff1d(a, centre), np.setdiff1d(b, centre)))
        assert len(np.intersect1d(oa, ob) if outside else np.intersect1d(wa, wb))
        assert 1.8 * (min(ia, ib) + (min(na - ia, nb - ib) if outside else 0)) >= 0.8 * (na + nb) - 1e-9
    assert met > 300


def test_a_large_group_of_changed_copies_costs_few_comparisons(spark, monkeypatch):
    seen, plain = [], near_copies.in_pairs
    monkeypatch.setattr(near_copies, "in_pairs", lambda pairs, *a: seen.append(pairs.count()) or plain(pairs, *a))
    rng = random.Random(11)
    text = text_cases.prose(rng, 150)
    other = changed(rng, text, 8)  # a second family, its centre not linked to the first
    texts = [text, other] + [changed(rng, text, rng.randrange(1, 12)) for _ in range(250)]
    texts += [changed(rng, other, rng.randrange(1, 4)) for _ in range(40)]
    texts += [" ".join(text.split()[:n]) for n in range(60, 150, 6)]
    groups = brute_groups(texts)
    assert kept(spark, texts) == sorted(set(groups)) and 20 < len(set(groups)) < 280
    assert sum(seen) < 8 * len(texts)


def test_references_are_those_of_the_definition(spark):
    rng = random.Random(4)
    held = {fp: rng.sample(range(40), rng.randrange(0, 5)) for fp in range(60)} | {99: [500], 100: []}
    classes = spark.createDataFrame(list(held.items()), "fp long, bands array<long>")
    members = {b: [fp for fp in held if b in held[fp]] for own in held.values() for b in own}
    members = {b: fps for b, fps in members.items() if len(fps) > 1}
    weight = {fp: sum(len(members.get(b, ())) for b in own) for fp, own in held.items()}
    by = {r["fp"]: r["by"] for r in classes.select("fp", F.xxhash64("fp", F.lit(near_copies.SEED)).alias("by")).collect()}
    heavy = {fp: (weight[fp], by[fp], fp) for fp in held}
    centre = {b: max(fps, key=heavy.get) for b, fps in members.items()}
    home = {fp: max((centre[b] for b in own if b in members), key=heavy.get, default=None) for fp, own in held.items()}
    refs = {}
    for b, fps in members.items():
        for fp in (*fps, home[centre[b]]):
            refs.setdefault(fp, set()).add(home[centre[b]])
    got = {r["fp"]: (sorted(r["refs"]), r["home"]) for r in near_copies.references(classes).collect()}
    assert got == {fp: (sorted(rs), max(rs, key=heavy.get)) for fp, rs in refs.items()}
    assert 99 not in got and any(len(rs) > 1 for rs in refs.values())


def test_the_search_leaves_few_shuffle_files(spark):
    rng = random.Random(12)
    text = text_cases.prose(rng, 150)
    texts = [text] + [changed(rng, text, rng.randrange(1, 12)) for _ in range(40)]
    docs = text_cases.documents(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    rows = checkpointed(near_copies.classes_of(docs).withColumnRenamed("row", "least"))
    before = shuffle_files(spark)
    roots = near_copies.linked(rows, docs)
    left = {re.search(r"shuffle_\d+", f)[0] for f in left_over(spark, before, 3)}
    assert len(left) < 12, sorted(left)
    alone = len(texts) - roots.count()  # without a candidate
    assert roots.select("root").distinct().count() + alone == len(set(brute_groups(texts))) and alone < 10
