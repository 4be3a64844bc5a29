from __future__ import annotations

import random
import re
import zlib

import numpy as np
import text_cases

from secflow.llm import quality_model, quality_rules, toxicity
from secflow.llm.docstats import measure


def corpus(n=400):
    """Every tenth text is toxic, every fifth is full of symbols or repeats."""
    rng = random.Random(12)
    data, marks = [], []
    for i in range(n):
        text = text_cases.prose(rng, rng.randrange(60, 200))
        toxic, bad = rng.random() < 0.15, rng.random() < 0.25
        if toxic:
            words = text.split(" ")
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "trash", "scum", "grmblfix", "grmblzu"]))
            text = " ".join(words)
        if bad:
            text = " ".join(w + "***" for w in text.split(" ")) if i % 2 else (text[:60] + "\n") * 20
        data.append((i, text, "en", "s", len(text)))
        marks.append((i, int(not bad), int(toxic)))
    return data, marks


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def odd():
    """The odd rows under ids that no other document has."""
    return [(d[0] and d[0] + 10_000, *d[1:]) for d in text_cases.rows()[60:] if d[0] is None or d[0] >= 100]


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, repeats = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeats += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeats, len(covered)


def test_counts_against_the_definitions():
    texts = ["", " \n", "a b c a b c", "a a a a", "a b c d", "x\nx\n \n \nx", "#* $% &|<>\x1c b", "\x85  ",
             *(r[1][:3000] for r in text_cases.rows()[:40]), "é a b é a b é"]
    got = measure(texts)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for i, text in enumerate(texts):
        assert tuple(int(got[n][i]) for n in names) == counts(text), text


def test_quality_rules_learn_and_respect_the_limits(spark):
    data, marks = corpus()
    docs = text_cases.documents(spark, data + odd())
    forest = quality_rules.fit(docs, text_cases.labels(spark, [*marks, (None, 1, 0), (9, None, None)]))
    got = quality_rules.judge(docs, forest).collect()
    good = {i: q for i, q, _ in marks}
    assert len(got) == len(data) + len(odd())
    for r in got:
        n, repeats = r["n_words"], r["n_repeat_words"]
        assert r["base_failed"] == (n < 50 or 100 * repeats > 50 * n) and not (r["base_failed"] and r["kept"])
    right = [r["kept"] == good[r["doc_id"]] for r in got if r["doc_id"] in good and held(r["doc_id"]) and not r["base_failed"]]
    assert len(right) > 30 and np.mean(right) > 0.97
    free = quality_rules.judge(docs, None).collect()
    assert all(r["kept"] != r["base_failed"] and r["score"] is None for r in free)
    assert quality_rules.fit(docs, text_cases.labels(spark, [])) is None
    assert quality_rules.judge(text_cases.documents(spark, []), forest).count() == 0


def test_trees_are_monotone_and_flat_scoring_equals_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = (x[:, 0] - 0.5 * x[:, 1] + np.sin(3 * x[:, 2]) + rng.normal(size=2000) > 0).astype(float)
    forest = quality_rules.grow(x, y, np.array([1, -1, 0]))
    grid = np.repeat(rng.normal(size=(200, 3)), 20, axis=0)
    for k, sign in ((0, 1), (1, -1)):
        moved = grid.copy()
        moved[:, k] = np.tile(np.linspace(-4, 4, 20), 200)
        steps = np.diff(forest.margin(moved).reshape(200, 20), axis=1)
        assert (sign * steps >= -1e-9).all()
    assert ((forest.probability(x) > 0.5) == y).mean() > 0.8
    for row in x[:20]:
        total = forest.base
        for f, c, v in zip(forest.feature, forest.cut, forest.value, strict=True):
            i = 0
            while i < len(f):
                i = 2 * i + (2 if row[f[i]] > c[i] else 1)
            total += v[i - len(f)]
        assert np.isclose(total, forest.margin(row[None])[0])


def test_quality_classifier_on_held_out_rows(spark):
    data, marks = corpus()
    docs = text_cases.documents(spark, data + odd())
    labels = text_cases.labels(spark, [*marks, (None, 1, 0), (9, None, None), marks[8]])
    got = quality_model.classify(docs, labels).collect()
    good = {i: q for i, q, _ in marks}
    assert len(got) == len(data) + len(odd()) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got)
    right = [r["predicted"] == good[r["doc_id"]] for r in got if r["doc_id"] in good and held(r["doc_id"])]
    assert len(right) > 50 and np.mean(right) > 0.95
    kept = quality_model.good_ones(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got)
    plain = quality_model.classify(docs, text_cases.labels(spark, [(1, 1, 0)])).collect()
    assert {r["score"] for r in plain} == {0.5}
    assert quality_model.classify(text_cases.documents(spark, []), labels).count() == 0


def test_pooling_gives_the_isotonic_fit():
    at, level = quality_model.pooled(np.array([1.0, 2, 1, 1]), np.array([0.0, 2, 0, 1]), np.array([1.0, 2, 3, 4]))
    assert level.tolist() == [0, 2 / 3, 1] and at.tolist() == [1, 7 / 3, 4]


def test_fourier_features_approach_the_kernel():
    rng = np.random.default_rng(1)
    fourier = quality_model.Fourier.draw(np.zeros(12), np.ones(12))
    x = rng.normal(size=(60, 12)) * 0.7
    z = fourier(x)[:, 1:]
    gaps = z @ z.T - np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * 2.0 ** 2))
    assert np.abs(gaps).mean() < 0.06


def test_toxicity_chain_on_held_out_rows(spark):
    data, marks = corpus()
    docs = text_cases.documents(spark, data + odd())
    chain = toxicity.fit(docs, text_cases.labels(spark, [*marks, (None, 1, 1), (9, None, None)]))
    got = toxicity.rate(docs, chain).collect()
    bad = {i: t for i, _, t in marks}
    assert len(got) == len(data) + len(odd())
    right = [r["toxic_predicted"] == bool(bad[r["doc_id"]]) for r in got if r["doc_id"] in bad and r["held_out"]]
    assert len(right) > 50 and np.mean(right) > 0.95
    assert not any(r["toxic_predicted"] for r in got if r["doc_id"] not in bad)
    assert all(r["held_out"] == held(r["doc_id"]) for r in got if r["doc_id"] is not None)
    with_seed = [r for r in got if r["doc_id"] in bad and re.search("idiot", data[r["doc_id"]][1])]
    assert np.mean([r["p_insult"] for r in with_seed]) > 0.5
    kept = toxicity.without_toxic(docs, chain)
    assert kept.columns == docs.columns and kept.count() == sum(not r["toxic_predicted"] for r in got)


def test_toxicity_without_labels_or_rows(spark):
    data, _ = corpus(20)
    docs = text_cases.documents(spark, data)
    chain = toxicity.fit(docs, text_cases.labels(spark, []))
    assert not any(r["toxic_predicted"] for r in toxicity.rate(docs, chain).collect())
    assert toxicity.rate(text_cases.documents(spark, []), chain).count() == 0


def test_later_links_train_on_out_of_fold_predictions():
    rng = np.random.default_rng(2)
    x = (rng.random((500, 4)) < 0.3).astype(np.float32)
    y = x[:, 0] * (rng.random(500) < 0.9)
    w, b = toxicity.logistic(x, y.astype(np.float32))
    assert w[0] > 2 and abs(w[1:]).max() < 1 and ((x @ w + b > 0) == (x[:, 0] > 0)).all()
    w, b = toxicity.logistic(x, np.zeros(500, np.float32))
    assert not w.any() and b < -5
