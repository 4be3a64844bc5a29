from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import text_cases

from secflow.llm import minhash


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def twins(data):
    order = sorted(data, key=lambda d: (d[0] is not None, d[0] or 0))
    out = []
    for d, following in zip(order, order[1:] + order[:1], strict=True):
        text, other = d[1] or "", following[1] or ""
        q = len(text) // 4
        out.append((d[0], text, text[:len(text) - q] + other[:q], other))
    return out


def test_edited_texts_and_likeness(spark):
    rng = random.Random(9)
    data = [(i * 3 + 1, text_cases.prose(rng, rng.choice([3, 40, 300, 900])), "en", "s", 0) for i in range(80)]
    data += [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0), (1002, "one", "en", "s", 0), (1003, "two  ", "en", "s", 0)]
    got = {r["doc_id"]: r for r in minhash.edited_twins(text_cases.documents(spark, data)).collect()}
    assert len(got) == len(data)
    errors = []
    for doc_id, text, edited, other in twins(data):
        r = got[doc_id]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert len(r["fingerprint"]) == len(r["edited_fingerprint"]) == minhash.BINS
        for estimate, true in ((r["near_edited"], jaccard(text, edited)), (r["near_next"], jaccard(text, other))):
            assert 0 <= estimate <= 1
            errors.append(abs(estimate - true))
    assert sum(errors) / len(errors) < 0.03 and max(errors) < 0.2


def test_ids_beyond_the_precision_of_a_double_keep_their_order(spark):
    rng = random.Random(11)
    data = [((1 << 61) + 3 * i, text_cases.prose(rng, 12), "en", "s", 0) for i in range(300)] + [(-5, "a b", "en", "s", 0)]
    got = {r["doc_id"]: r for r in minhash.edited_twins(text_cases.documents(spark, data, clashing=False)).collect()}
    assert len(got) == len(data)
    for doc_id, _, edited, _ in twins(data):
        assert got[doc_id]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()


def test_equal_texts_repeats_nulls_and_empty_table(spark):
    docs = text_cases.documents(spark)
    got = minhash.edited_twins(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs.collect())
    of = {}
    for r in got:
        of.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in of.values())
    assert len({next(iter(of[i])) for i in (3, *range(60, 90))}) == 1
    assert of[161] == of[160] == {"0" * minhash.BINS}
    assert minhash.edited_twins(text_cases.documents(spark, [])).count() == 0
    alone = minhash.edited_twins(text_cases.documents(spark, [(5, "a b c d e f g h", "en", "s", 0)])).collect()
    assert [(r["doc_id"], r["near_next"]) for r in alone] == [(5, 1.0)]


def test_likeness_is_unbiased_over_the_whole_range(spark):
    rng = random.Random(10)
    rows = []
    for share in (0.0, 0.2, 0.5, 0.8, 1.0):
        for _ in range(30):
            words = [f"w{rng.random()}" for _ in range(400)]
            cut = int(len(words) * (1 - share))
            rows.append((share, " ".join(words), " ".join([f"v{rng.random()}" for _ in range(cut)] + words[cut:])))
    df = spark.createDataFrame(rows, "share double, a string, b string")
    df = minhash.with_fingerprint(minhash.with_fingerprint(df, df.a, "fa"), df.b, "fb")
    got = df.select("share", "a", "b", minhash.likeness(df.fa, df.fb).alias("near")).collect()
    for share in (0.0, 0.2, 0.5, 0.8, 1.0):
        gaps = [r["near"] - jaccard(r["a"], r["b"]) for r in got if r["share"] == share]
        assert abs(sum(gaps) / len(gaps)) < 0.02
