from __future__ import annotations

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import test_models
import text_cases
from tokenizers import Tokenizer

from secflow.llm import packing, quality_model, secret_scan, simhash, toxicity
from secflow.llm.common import labels as read_labels


def test_stages_hand_on_what_they_keep_and_every_id_is_packed(spark, tmp_path):
    data, marks = test_models.corpus(300)
    data += [(500 + i, data[0][1], "en", f"s{i}", 0) for i in range(40)]
    data += [(600, data[1][1] + " password=531ccd051a92ebcb68 end", "en", "own", 0)] + test_models.odd()
    sf = str(tmp_path)
    text_cases.documents(spark, data, clashing=False).write.parquet(f"{sf}/documents.parquet")
    text_cases.labels(spark, marks).write.parquet(f"{sf}/labels.parquet")
    docs, at = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(f"{sf}/{name}")
        nxt = spark.read.parquet(f"{sf}/{name}")
        if name != "packing":
            assert nxt.columns == docs.columns
        at.append((docs, nxt))
        docs = nxt
    raw, calm = at[0]
    rated = toxicity.rate(raw, toxicity.fit(raw, read_labels(spark, sf)))
    assert sorted(map(str, (r[0] for r in calm.select("doc_id").collect()))) == sorted(
        str(r["doc_id"]) for r in rated.collect() if not r["toxic_predicted"])
    assert at[1][1].count() == sum(
        r["predicted"] for r in quality_model.classify(at[1][0], read_labels(spark, sf)).collect())
    heads = simhash.near_duplicates(at[2][0]).select("component_id").distinct().count()
    assert at[2][1].count() == heads
    clean = {r["doc_id"]: r["text"] for r in at[3][1].collect()}
    assert at[3][0].count() == len(clean) and "531ccd051a92ebcb68" not in " ".join(t or "" for t in clean.values())
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    total = {}
    for r in docs.collect():
        ids = [*lib.encode(clean[r["doc_id"]] or "", add_special_tokens=False).ids, 1]
        part = np.array(ids[r["start"]:r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(part.tobytes())
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
        assert r["doc_tokens"] == len(ids)
    assert total.keys() == clean.keys()
    whole = corpus_pipeline.run(spark, sf)
    assert whole.count() == docs.count() and packing.LENGTH == 2048 and secret_scan.OWNERS > 1
