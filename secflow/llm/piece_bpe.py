"""Encoding and decoding by a merge-type piece model, by exact backtracking instead of merging.

A merging tokenizer joins the best-scored pair of neighbours again and again. The result is the one sequence of
pieces in which every two neighbours are compatible: merging their joint text from single characters gives just
these two. So a run of characters is read from left to right. An Aho-Corasick pass gives the longest piece that
starts at each position; a piece is taken if it is compatible with the one before it, otherwise its longest
shorter prefix is tried. Where no prefix fits, the piece before is taken back and the position it ended at is
marked in a bitfield, so that no position fails twice. Compatibility is checked by merging the two pieces again;
the answers are kept.

Characters that no piece contains stand alone as their bytes. Where the vocabulary has no piece that goes on
behind a letter with a word mark, texts fall into words that merging cannot join, and words are kept with their
ids.

Scale: one pass over the texts, no shuffle; a task holds one run of about a million characters, one whole text
at least, and caches of bounded size. Work is linear in a text's length.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secflow.llm.common import map_text

MARK = "▁"
# Kinds of pieces and the model type in the model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MERGES = 2
#: Most words and pairs kept, and characters of a word that is kept.
MOST_CACHED, LONG = 600_000, 64
#: Characters that are looked over one by one instead of by a heap; the score of a pair that is no piece.
FEW, NEVER = 24, -float("inf")


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of one message of the model file."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(raw):
        key = number()
        width = {1: 8, 5: 4}[key & 7] if key & 7 in (1, 5) else number()
        if key & 7 == 0:
            yield key >> 3, width
        else:
            yield key >> 3, raw[at:at + width]
            at += width


def read_model(path: str) -> tuple[list[tuple[str, float, int]], bool]:
    """([(piece, score, kind) by id], whether it is a merge model with bytes for unknown characters)."""
    with open(path, "rb") as file:
        raw = file.read()
    pieces, trainer = [], {}
    for number, value in _fields(raw):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
    return pieces, trainer.get(3) == MERGES and bool(trainer.get(35))


class PieceBpe:
    def __init__(self, path: str) -> None:
        pieces, fits = read_model(path)
        if not fits or any(kind not in (NORMAL, UNKNOWN, CONTROL, BYTE) for _, _, kind in pieces):
            raise ValueError("only merge models with byte fallback and without pieces of a user are supported")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score = {p: score for p, score, kind in pieces if kind == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        letters = {c for p in self.score for c in p}
        ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        # In the order of the vocabulary: the automaton looks at the children of a node in the order they came.
        self.texts = list(dict.fromkeys([p for p in self.score if self.merged(p) == [p]] + sorted(letters)))
        number = {p: t for t, p in enumerate(self.texts)}
        self.ids = [(ids[p],) if p in ids else self.as_bytes(p) for p in self.texts]
        self.sizes = [len(p) for p in self.texts]
        self.shorter = [next((number[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in number), -1)
                        for p in self.texts]
        self.letters = {c: number[c] for c in letters}
        self.found = ahocorasick.Automaton()
        for p, t in number.items():
            if len(p) > 1:  # single letters are looked up where nothing longer starts
                self.found.add_word(p, (len(p) - 1, t))
        self.found.make_automaton()
        self.crossing = any(b == MARK != a for p in self.score for a, b in zip(p, p[1:], strict=False))
        self.unknown = re.compile(f"([^{re.escape(''.join(sorted(letters)))}]+)")
        self.fits: dict[int, int] = {}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.names = [str(i) for i in range(len(pieces))]
        self.prefix = self.library.normalize("a").startswith(MARK)
        # An unknown id is spelled as what no text holds.
        spelled = {UNKNOWN: b"\xff", CONTROL: b""}
        self.spelled = [bytes([int(p[3:5], 16)]) if kind == BYTE else spelled.get(kind, p.replace(MARK, " ").encode())
                        for p, _, kind in pieces]

    def as_bytes(self, text: str) -> tuple[int, ...]:
        return tuple(self.bytes[b] for b in text.encode("utf-8", "replace"))

    def merged(self, text: str) -> list[str]:
        """Pieces of ``text`` by merging: best score first, the leftmost of equal ones."""
        parts, score = list(text), self.score
        left, right = list(range(-1, len(text) - 1)), list(range(1, len(text) + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(parts):
                both = parts[a] + parts[b]
                if both in score:
                    heapq.heappush(heap, (-score[both], a, b, both))

        for i in range(len(text) - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if not parts[a] or not parts[b] or right[a] != b or parts[a] + parts[b] != both:
                continue
            parts[a], parts[b] = both, ""
            right[a] = right[b]
            if right[a] < len(parts):
                left[right[a]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [p for p in parts if p]

    def compatible(self, before: int, piece: int) -> bool:
        """Whether merging the joint text of two pieces gives these two again: nothing joins over their border."""
        first, text = self.texts[before], self.texts[before] + self.texts[piece]
        if len(text) > FEW:
            return self.merged(text) == [first, self.texts[piece]]
        get, parts, border = self.score.get, list(text), len(first) - 1
        scores = [get(text[i:i + 2], NEVER) for i in range(len(text) - 1)]
        while True:
            best = max(scores)
            if best == NEVER:
                return True
            at = scores.index(best)
            if at == border:
                return False
            border -= at < border
            parts[at] += parts.pop(at + 1)
            del scores[at]
            if at:
                scores[at - 1] = get(parts[at - 1] + parts[at], NEVER)
            if at < len(scores):
                scores[at] = get(parts[at] + parts[at + 1], NEVER)

    def fitting(self, before: int, piece: int) -> int:
        """The longest prefix of ``piece``, itself included, that is compatible with ``before``; -1 if there is none."""
        if len(self.fits) >= MOST_CACHED:
            self.fits.clear()
        place, fit = before * len(self.texts) + piece, piece
        while fit >= 0 and not self.compatible(before, fit):
            fit = self.shorter[fit]
        self.fits[place] = fit
        return fit

    def backtracked(self, run: str) -> list[int]:
        """Numbers of the pieces of a run of known characters."""
        length, letters = len(run), self.letters
        longest = [-1] * length
        for last, (back, piece) in self.found.iter(run):
            longest[last - back] = piece
        failed = None
        out: list[int] = []
        at, piece, before = 0, -1, -1
        known, sizes, shorter, many = self.fits.get, self.sizes, self.shorter, len(self.texts)
        while at < length:
            if piece == -1:
                piece = longest[at]
                if piece < 0:
                    piece = letters[run[at]]
            while piece >= 0:
                if before >= 0:
                    fit = known(before * many + piece)
                    piece = self.fitting(before, piece) if fit is None else fit
                    if piece < 0:
                        break
                end = at + sizes[piece]
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                at, before, piece = end, piece, -1
                continue
            if failed is None:
                failed = bytearray(length // 8 + 1)
            failed[at >> 3] |= 1 << (at & 7)
            piece = out.pop()
            at -= sizes[piece]
            before = out[-1] if out else -1
        return out

    def _fresh(self, word: str, marked: bool = True) -> tuple[int, ...]:
        """Ids of a word that is not kept yet; ``marked`` words come without their first mark."""
        whole = MARK + word if marked else word
        of, ids = self.ids, []
        try:
            for p in self.backtracked(whole):
                ids += of[p]
        except KeyError:  # a character that no piece has
            for place, part in enumerate(self.unknown.split(whole)):
                ids += self.as_bytes(part) if place % 2 else [i for p in self.backtracked(part) for i in of[p]]
        kept = tuple(ids)
        if marked and len(word) <= LONG:
            if len(self.cache) >= MOST_CACHED:
                self.cache.clear()
            self.cache[word] = kept
        return kept

    def encode(self, text: str) -> list[int]:
        normal = self.library.normalize(text)
        start = len(normal) if self.crossing else normal.find(MARK)
        start = len(normal) if start < 0 else start
        head = self._fresh(normal[:start], marked=False) if start else ()
        return [*head, *self._words(normal[start:])] if start < len(normal) else list(head)

    def _words(self, normal: str) -> list[int]:
        """Ids of a text that starts with a mark; a word begins at each run of marks."""
        words = normal[1:].split(MARK) if MARK + MARK not in normal else [
            w[1:] for w in re.findall(f"{MARK}+[^{MARK}]*", normal)]
        ids: list[int] = []
        known, fresh = self.cache.get, self._fresh
        for word in words:
            ids += known(word) or fresh(word)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of the ids as the library gives it; it is asked where bytes are no text."""
        try:
            text = b"".join(map(self.spelled.__getitem__, ids)).decode()
        except UnicodeDecodeError:
            return self.library.decode(ids)
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def vocabulary(path: str) -> PieceBpe:
    return PieceBpe(path)


def encode(docs: DataFrame, path: str, digest: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids of every row; with ``digest`` hashes of the ids and of the text decoded from them.

    Null texts count as empty and have no ids. Null ids and repeated rows stay; an empty table gives an empty
    result; other columns are not looked at. Texts of any length are one sequence.
    """

    def run(texts: list[str]) -> dict[str, list]:
        model = vocabulary(path)
        ids = [model.encode(t) for t in texts]
        got: dict[str, list] = {"n_tokens": [len(x) for x in ids]}
        if not digest:
            return got | {"ids": ids}
        return got | {
            "ids_sha256": [hashlib.sha256(",".join(map(vocabulary(path).names.__getitem__, x)).encode()).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(model.decode(x).encode("utf-8", "replace")).hexdigest() for x in ids]}

    schema = "n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>")
    return map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", run, schema,
                    {"doc_id": "long"})


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; null ids count as none."""

    @F.pandas_udf("string")
    def text_of(ids):  # noqa: ANN001, ANN202
        model = vocabulary(path)
        return ids.map(lambda x: "" if x is None else model.decode([int(i) for i in x]))

    return encoded.select("doc_id", text_of("ids").alias("text"))
