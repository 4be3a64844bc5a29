from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
import text_cases

from secflow.llm import piece_bpe
from secflow.llm.registry import section

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return piece_bpe.PieceBpe(PATH)


def test_runs_of_spaces_and_marks_equal_the_library(model):
    """The pieces of spaces share one score, so here equal scores meet."""
    for n in range(70):
        for tail in ("", "t", "x y", "ﬁ", "①", "the", "<"):
            for text in (" " * n + tail, "a" + " " * n + tail, "▁" * n + tail):
                assert model.encode(text) == model.library.encode(text)


def test_random_letters_and_pieces_equal_the_library_and_plain_merging(model):
    rng = random.Random(4)
    letters, pieces = "aabbetthhe  ▁▁iınñ漢字😀\0\t\n.,'<>0x41ﬁ①éà한국", list(model.score)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(8))) for _ in range(3000)]
    for text in texts:
        assert model.encode(text) == model.library.encode(text)
    for text in texts[3000:3300]:
        run = text.replace("\n", "")
        assert [model.texts[p] for p in model.backtracked(run)] == model.merged(run)


def test_backtracking_takes_pieces_back():
    """In some texts no prefix of the longest match fits and the piece before is given up."""
    seen = []

    class Watched(piece_bpe.PieceBpe):
        def fitting(self, before: int, piece: int) -> int:
            seen.append(super().fitting(before, piece))
            return seen[-1]

    model, rng = Watched(PATH), random.Random(9)
    for _ in range(4000):
        run = "".join(rng.choice("aeinorst") for _ in range(12))
        assert [model.texts[p] for p in model.backtracked(run)] == model.merged(run)
    assert min(seen) < 0


def test_long_texts_are_one_sequence_and_caches_may_be_emptied(model, monkeypatch):
    for text in ("x" * 30_000, "e" * 9999 + "r", " " * 40_000, "ab" * 5000):
        assert model.encode(text) == model.library.encode(text)
    monkeypatch.setattr(piece_bpe, "MOST_CACHED", 3)
    text = "some words, and other words; then more of them " * 4
    assert model.encode(text) == model.library.encode(text)


def test_rows_equal_the_library_and_decode_back(spark):
    docs = text_cases.documents(spark)
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = sorted(r["text"] or "" for r in docs.collect())
    got = piece_bpe.encode(docs, PATH)
    rows = got.collect()
    assert sorted(tuple(r["ids"]) for r in rows) == sorted(tuple(lib.encode(t)) for t in texts)
    assert all(r["n_tokens"] == len(r["ids"]) for r in rows) and len(rows) == len(texts)
    assert sorted(r["text"] for r in piece_bpe.decode(got, PATH).collect()) == sorted(
        lib.decode(lib.encode(t)) for t in texts)
    digests = piece_bpe.encode(docs, PATH, digest=True).collect()
    assert sorted((r["ids_sha256"], r["decoded_sha256"]) for r in digests) == sorted(
        (hashlib.sha256(",".join(map(str, lib.encode(t))).encode()).hexdigest(),
         hashlib.sha256(lib.decode(lib.encode(t)).encode()).hexdigest()) for t in texts)
    assert piece_bpe.encode(text_cases.documents(spark, []), PATH).count() == 0


def test_query_returns_every_document(spark, tmp_path):
    text_cases.documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = section.queries["op12_sentencepiece"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert got.count() == len(text_cases.rows())


def test_other_models_are_refused(tmp_path):
    path = tmp_path / "other.model"
    path.write_bytes(b"")
    with pytest.raises(ValueError, match="merge models"):
        piece_bpe.PieceBpe(str(path))
