from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import regex
import text_cases
import tiktoken

from secflow.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_boundaries_equal_the_pattern():
    rng = random.Random(5)
    letters = "ab sStTrReEvVlLdDm'''0  \n\r\t\x1c\x85\u00a0\u2003.,!-_é¼漢😀\u0301\u200b"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 60))) for _ in range(5000)]
    texts += ["", " ", "  ", "x  ", "'s", "''s 're've 'LL", "a'stm", " 's", "\n's", "x" * 5000, " " * 3000 + "y"]
    whole, starts, first = byte_bpe.boundaries(texts)
    ends = [*starts[1:].tolist(), len(whole)]
    pieces = [whole[a:b] for a, b in zip(starts.tolist(), ends, strict=True)]
    pattern = regex.compile(public_tokenizers.PATTERN)
    assert pieces == [p for t in texts for p in pattern.findall(t)]
    assert [pieces[a:b] for a, b in zip(first, first[1:], strict=False)] == [pattern.findall(t) for t in texts]


def test_every_code_point_has_the_class_of_the_library():
    bpe, lib = byte_bpe.vocabulary(PATH), library()
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{p}1{p}!{p} {p}" for p in points[i:i + 64]) for i in range(0, len(points), 64)]
    rng = random.Random(2)
    some = [texts[i] for i in sorted({*range(0, 400), *(rng.randrange(len(texts)) for _ in range(800))})]
    for text, raw in zip(some, bpe.encode(some), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == lib.encode_ordinary(text)


def test_encoding_equals_the_library_and_decodes_back(spark):
    docs = text_cases.documents(spark)
    lib = library()
    got = byte_bpe.encode(docs, PATH).collect()
    texts = sorted((r["text"] or "" for r in docs.collect()))
    back = {tuple(r["ids"]): bytes(r["bytes"]).decode() for r in
            byte_bpe.decode(byte_bpe.encode(docs, PATH), PATH).join(byte_bpe.encode(docs, PATH), "doc_id").collect()}
    assert sorted(lib.decode(r["ids"]) for r in got) == texts
    assert all(r["ids"] == lib.encode_ordinary(lib.decode(r["ids"])) and r["n_tokens"] == len(r["ids"]) for r in got)
    assert len(got) == len(texts) and back
    digests = {(r["ids_sha256"], r["decoded_sha256"]) for r in byte_bpe.encode(docs, PATH, digest=True).collect()}
    assert digests == {(hashlib.sha256(np.array(lib.encode_ordinary(t), "<u4").tobytes()).hexdigest(),
                        hashlib.sha256(t.encode()).hexdigest()) for t in texts}
    assert byte_bpe.encode(text_cases.documents(spark, []), PATH).count() == 0


def test_places_cut_a_range_of_ids_and_the_cache_may_be_emptied():
    bpe = byte_bpe.ByteBpe(PATH)
    text = "Straße über 漢字 and more " * 50
    ids = np.frombuffer(bpe.encode([text])[0], "<u4").astype(np.int64)
    whole, places = bpe.decode(ids)
    assert whole == text.encode() and bpe.decode(ids[7:20])[0] == whole[places[7]:places[20]]
    bpe.cache.clear()
    assert np.frombuffer(bpe.encode([text])[0], "<u4").tolist() == ids.tolist()
