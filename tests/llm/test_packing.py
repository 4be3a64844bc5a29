from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import text_cases
from tokenizers import Tokenizer

from secflow.llm import packing

ARGS = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def test_first_fit_equals_a_walk_over_all_bins():
    rng = random.Random(1)
    lengths = sorted((rng.randrange(1, 100) for _ in range(300)), reverse=True)
    tree, bins = packing.FirstFit(100, 300), []
    for n in lengths:
        at = next((i for i, free in enumerate(bins) if free >= n), len(bins))
        if at == len(bins):
            bins.append(100)
        assert tree.put(n) == (at, bins[at])
        bins[at] -= n


def test_ids_equal_the_library():
    lib = Tokenizer.from_file(ARGS[0])
    texts = [r[1] or "" for r in text_cases.rows()] + ["a<|endoftext|>b", "<|endoftext|>", "it's  \n\n x\t", "😀漢"]
    for text in texts:
        assert packing.token_ids(text, *ARGS).tolist() == lib.encode(text, add_special_tokens=False).ids


def check(docs, **more):
    lib = Tokenizer.from_file(ARGS[0])
    got = packing.pack(docs, *ARGS, **more).collect()
    length = more.get("length", packing.LENGTH)
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    for row in docs.select("doc_id", "text").distinct().collect():
        ids = [*lib.encode(row["text"] or "", add_special_tokens=False).ids, 1]
        starts = defaultdict(int)
        for r in by_doc[row["doc_id"]]:
            part = np.array(ids[r["start"]:r["start"] + r["length"]], "<u4")
            assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids)
            if "ids" in r:
                assert r["ids"] == part.tolist()
            starts[r["start"]] += r["length"]
        copies = docs.where("doc_id <=> " + ("null" if row["doc_id"] is None else str(row["doc_id"]))).count()
        assert sum(starts.values()) == copies * len(ids)
    return got, sequences


def test_each_id_lies_in_one_piece_and_offsets_are_gapless(spark):
    check(text_cases.documents(spark))
    check(text_cases.documents(spark), length=64, with_ids=True)


def test_little_padding_and_empty_table(spark):
    rng = random.Random(4)
    data = [(i, text_cases.prose(rng, rng.randrange(5, 200)), "en", "s", 0) for i in range(400)]
    got, sequences = check(text_cases.documents(spark, data), length=512)
    assert sum(r["length"] for r in got) >= 0.97 * 512 * (len(sequences) - 1)
    assert packing.pack(text_cases.documents(spark, []), *ARGS).count() == 0
