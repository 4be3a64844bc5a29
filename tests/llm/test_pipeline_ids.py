from __future__ import annotations

import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import text_cases
from tokenizers import Tokenizer


def test_sequences_can_be_rebuilt_from_the_result_alone(spark):
    data = text_cases.rows()[:62]
    got = corpus_pipeline.sequences(spark, text_cases.documents(spark, data), "").collect()
    lib, parts, texts = Tokenizer.from_file(P.path("byte_bpe_50k.json")), defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        parts[r["sequence_id"]].append((r["offset"], r["ids"]))
        texts[r["doc_id"]].append((r["start"], r["ids"]))
    for placed in parts.values():
        placed.sort()
        assert [at for at, _ in placed] == [sum(len(x) for _, x in placed[:i]) for i in range(len(placed))]
    for doc_id, text, *_ in data:
        ids = [i for _, part in sorted(texts[doc_id]) for i in part]
        assert ids == [*lib.encode(text or "", add_special_tokens=False).ids, 1]
