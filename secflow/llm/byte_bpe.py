"""Byte-level BPE encoding and decoding without a regular expression in the loop.

Pre-tokenisation: each code point gets a class (letter, number, white space and so on, with a look at its
neighbours where the pattern looks ahead). A class is a function from the state of an open piece to the next
state, so the state before every character is a scan over the composition of functions. Composition is
associative and the functions that can arise are few, so they are numbered and composed by table: blocks of
the text are scanned side by side, then the blocks' totals, then each block is told its true start.

Merging: pieces seen before come from a cache; all new pieces of a run are merged together, one merge per
piece and round, with ranks of pairs from one open-addressing table. Every piece keeps its place in the
text, every token its place in the bytes, so a range of ids decodes alone.

Scale: one pass over the texts, no shuffle; memory per task is one run of about a million characters and a
cache of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secflow.llm.common import map_text

# States of an open piece: none, letters, numbers, others, white space, one space that may lead a piece, and a
# contraction that still takes one or two letters.
NONE, LETTERS, NUMBERS, OTHERS, SPACES, LEAD, TAKE1, TAKE2 = range(8)
# Classes: letter, number, other, apostrophe before a contraction of one or two letters, white space before more
# of it (or the end), a last space before something else, another last white space before something else.
LETTER, NUMBER, OTHER, QUOTE1, QUOTE2, SPACE, LAST_SPACE, LAST_BLANK = range(8)
CLASSES = 8
#: The contractions of the pattern.
SUFFIX1, SUFFIX2 = "stmd", ("re", "ve", "ll")
BLOCK = 512
MOST_CACHED = 400_000
#: Longer pieces are merged one by one with a heap.
LONG = 400
NO_RANK = np.int64(1 << 40)


def _step(state: int, kind: int) -> tuple[int, bool]:
    """(state after a character of class ``kind``, whether a piece begins at it)."""
    if kind == LETTER:
        if state in (LETTERS, LEAD):
            return LETTERS, False
        return (TAKE1, False) if state == TAKE2 else (NONE, False) if state == TAKE1 else (LETTERS, True)
    if kind == NUMBER:
        return NUMBERS, state not in (NUMBERS, LEAD)
    if kind in (OTHER, QUOTE1, QUOTE2):
        if state in (OTHERS, LEAD):
            return OTHERS, False
        return {OTHER: OTHERS, QUOTE1: TAKE1, QUOTE2: TAKE2}[kind], True
    if kind == SPACE:
        return SPACES, state != SPACES
    return (LEAD if kind == LAST_SPACE else NONE), True


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, ...]:
    """(class of each code point, numbers of the class functions, composition, application, piece begins)."""
    # The classes are asked of the library once, since Unicode tables differ between versions: an encoding whose
    # pattern is one class, over single bytes, returns just the code points of that class.
    points = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    one_byte = {bytes([b]): b for b in range(256)}
    raw = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        of_class = tiktoken.Encoding(f"class {kind}", pat_str=pattern, mergeable_ranks=one_byte, special_tokens={})
        found = bytes(of_class.encode_ordinary(points)).decode("utf-8")
        raw[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind

    after = np.array([[_step(s, k)[0] for s in range(8)] for k in range(CLASSES)])
    begins = np.array([[_step(s, k)[1] for k in range(CLASSES)] for s in range(8)])
    # Function k + CLASSES is class k at the start of a text: whatever was open, nothing is.
    known = {tuple(range(8)): 0}
    basic = [tuple(map(int, f)) for f in after] + [(int(f[NONE]),) * 8 for f in after]
    functions = [tuple(range(8))]
    for f in basic:
        if f not in known:
            known[f] = len(functions)
            functions.append(f)
    i = 0
    while i < len(functions):  # close under composition
        for g in basic:
            h = tuple(g[s] for s in functions[i])
            if h not in known:
                known[h] = len(functions)
                functions.append(h)
        i += 1
    compose = np.array([[known.get(tuple(g[s] for s in f), 0) for g in functions] for f in functions], np.uint8)
    return raw, np.array([known[f] for f in basic], np.uint8), compose, np.array(functions, np.uint8), begins


def _states(functions: np.ndarray) -> np.ndarray:
    """State before each character, from NONE, by a scan over composed functions."""
    _, _, compose, apply, _ = _tables()
    n, size = len(functions), len(compose)
    if n <= 64:
        out, state = np.empty(n, np.uint8), NONE
        for i, f in enumerate(functions):
            out[i] = state
            state = apply[f, state]
        return out
    flat, flat_apply = compose.ravel(), apply.ravel()
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint8)
    padded[:n] = functions
    steps = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    before = np.empty_like(steps)
    total = np.zeros(blocks, np.uint16)
    for j in range(BLOCK):
        before[j] = total
        total = flat[total * size + steps[j]].astype(np.uint16)
    start = _states(total.astype(np.uint8))
    states = flat_apply[before.astype(np.uint16) * 8 + start]
    return np.ascontiguousarray(states.T).ravel()[:n]


def boundaries(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """(all texts joined, starts of pieces in it, first piece of each text and the number of pieces)."""
    raw, function_of, _, _, begins = _tables()
    whole = "".join(texts)
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    n = len(points)
    opens = np.cumsum([0, *map(len, texts)])
    if not n:
        return whole, np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    first = np.zeros(n + 1, bool)
    first[opens] = True  # of a text; the end counts
    kind = raw[points]
    space = kind == SPACE
    last = space & ~first[1:] & ~np.r_[space[1:], False]
    kind[last] = np.where(points[last] == 32, LAST_SPACE, LAST_BLANK)
    for at in np.flatnonzero(points == 39).tolist():
        end = int(opens[np.searchsorted(opens, at, "right")])
        if whole[at + 1:min(at + 2, end)] in tuple(SUFFIX1):
            kind[at] = QUOTE1
        elif whole[at + 1:min(at + 3, end)] in SUFFIX2:
            kind[at] = QUOTE2
    states = _states(function_of[kind + first[:-1].astype(np.uint8) * CLASSES])
    states[first[:-1]] = NONE
    starts = np.flatnonzero(begins.ravel()[states * np.uint8(CLASSES) + kind] | first[:-1])
    return whole, starts, np.searchsorted(starts, opens)


class ByteBpe:
    """Vocabulary of a rank file: base64 of a token's bytes and its rank, which is its id, per line."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.rank = {base64.b64decode(token): int(rank) for token, rank in pairs}
        ids = max(self.rank.values()) + 1
        self.tokens = [b""] * ids
        for token, rank in self.rank.items():
            self.tokens[rank] = token
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.offsets = np.cumsum([0, *map(len, self.tokens)])
        self.byte_id = np.array([self.rank.get(bytes([b]), 0) for b in range(256)], np.int64)
        self.cache: dict[str, bytes] = {}
        keys, values = [], []
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 20 | right)
                    values.append(rank)
        self._fill(np.array(keys, np.int64), np.array(values, np.int64))

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing: what finds its slot taken tries the next one."""
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NO_RANK, np.int64)
        self.probes = 0
        while len(keys):
            slot = self._slot(keys, self.probes)
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[free]
            self.values[slot[free]] = values[free]
            mine = self.keys[slot] == keys
            self.values[slot[mine]] = values[mine]
            keys, values = keys[~mine], values[~mine]
            self.probes += 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)
        return (mixed.astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 20 | right
        slot = self._slot(keys, 0)
        out = np.where(self.keys[slot] == keys, self.values[slot], NO_RANK)
        open_ = np.flatnonzero((out == NO_RANK) & (self.keys[slot] != -1))
        for probe in range(1, self.probes):
            if not len(open_):
                break
            slot = self._slot(keys[open_], probe)
            found = self.keys[slot] == keys[open_]
            out[open_[found]] = self.values[slot[found]]
            open_ = open_[~found & (self.keys[slot] != -1)]
        return out

    def _merge_long(self, raw: bytes) -> list[int]:
        """One long piece: a heap of pairs over a linked list."""
        ids = self.byte_id[np.frombuffer(raw, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tokens, rank = self.tokens, self.rank
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1)
                if (r := rank.get(tokens[ids[i]] + tokens[ids[i + 1]])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (s := rank.get(tokens[ids[p]] + tokens[ids[q]])) is not None:
                    heapq.heappush(heap, (s, p, ids[p], ids[q]))
        return [i for i in ids if i >= 0]

    def learn(self, pieces: set[str]) -> None:
        """Merge new pieces together and put them into the cache."""
        todo: list[str] = []
        raws: list[bytes] = []
        for piece in pieces:
            raw = piece.encode("utf-8", "replace")
            if (whole := self.rank.get(raw)) is not None:
                self.cache[piece] = np.array([whole], "<u4").tobytes()
            elif len(raw) > LONG:
                self.cache[piece] = np.array(self._merge_long(raw), "<u4").tobytes()
            else:
                todo.append(piece)
                raws.append(raw)
        if not todo:
            return
        ids = self.byte_id[np.frombuffer(b"".join(raws), np.uint8)]
        word = np.repeat(np.arange(len(raws)), [len(r) for r in raws])
        done_ids, done_words = [], []
        while len(ids):
            rank = np.full(len(ids), NO_RANK)
            inside = np.flatnonzero(word[1:] == word[:-1])
            rank[inside] = self.pair_ranks(ids[inside], ids[inside + 1])
            opens = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[opens, len(ids)])
            least = np.repeat(np.minimum.reduceat(rank, opens), sizes)
            ready = least == NO_RANK
            done_ids.append(ids[ready])
            done_words.append(word[ready])
            at = np.flatnonzero((rank == least) & ~ready)
            at = at[np.r_[True, word[at][1:] != word[at][:-1]]] if len(at) else at  # the leftmost of a piece
            ids[at] = rank[at]
            stay = ~ready
            stay[at + 1] = False
            ids, word = ids[stay], word[stay]
        ids, word = np.concatenate(done_ids), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        flat = ids[order].astype("<u4").tobytes()
        ends = 4 * np.cumsum(np.bincount(word, minlength=len(todo)))
        for piece, a, b in zip(todo, np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
            self.cache[piece] = flat[a:b]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        whole, starts, first = boundaries(texts)
        pieces = list(map(whole.__getitem__, map(slice, starts.tolist(), [*starts[1:].tolist(), len(whole)])))
        fresh = set(pieces)
        if len(self.cache) > MOST_CACHED:
            self.cache.clear()
        self.learn(fresh - self.cache.keys())
        ids = list(map(self.cache.__getitem__, pieces))
        return [b"".join(ids[a:b]) for a, b in zip(first.tolist(), first[1:].tolist(), strict=False)]

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(the bytes, where each id's bytes begin and the end): ids i to j are bytes [places[i]:places[j]]."""
        at = self.offsets[ids]
        places = np.concatenate([[0], np.cumsum(self.offsets[ids + np.int64(1)] - at)])
        index = np.repeat(at - places[:-1], np.diff(places)) + np.arange(places[-1])
        return self.blob[index].tobytes(), places


@lru_cache(maxsize=2)
def vocabulary(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode(docs: DataFrame, path: str, digest: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids (array) of every row, or with ``digest`` ids_sha256 and decoded_sha256 instead of ids.

    ids_sha256 is over the ids as little-endian unsigned 32-bit integers, decoded_sha256 over the bytes that the
    ids decode to. Null texts count as empty: no ids. Null doc_ids and repeated rows stay; an empty table gives
    an empty result; other columns are not looked at.
    """

    def run(texts: list[str]) -> dict[str, list]:
        bpe = vocabulary(path)
        raw = bpe.encode(texts)
        sizes = {"n_tokens": [len(r) // 4 for r in raw]}
        if not digest:
            return sizes | {"ids": [np.frombuffer(r, "<u4").astype(np.int32) for r in raw]}
        return sizes | {
            "ids_sha256": [hashlib.sha256(r).hexdigest() for r in raw],
            "decoded_sha256": [hashlib.sha256(bpe.decode(np.frombuffer(r, "<u4").astype(np.int64))[0]).hexdigest()
                               for r in raw]}

    schema = "n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>")
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_text(kept, "text", run, schema, {"doc_id": "long"})


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and bytes (binary) of rows with ``ids``; null ids give null bytes."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("binary")
    def back(ids):  # noqa: ANN001, ANN202
        bpe = vocabulary(path)
        return ids.map(lambda x: None if x is None else bpe.decode(np.asarray(x, np.int64))[0])

    return encoded.select("doc_id", back("ids").alias("bytes"))
