"""Byte-level BPE: pre-tokenisation by scans over codepoint classes, then cached pair merging; and decoding.

The pre-tokeniser accepts the matches of public_tokenizers.PATTERN without a regular expression. Every code
point has a class (letter, number, other, kinds of white space by what follows, apostrophe that opens a
contraction); a class is a function from automaton states to states. Composition of such functions is
associative: blocks of characters are composed independently, block functions are scanned, and the states
inside all blocks follow at once. A match starts where (state before, class) says so.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from parley.llm.common import portions, small_batches, table
from parley.llm.memo import Memo, of_worker

# Classes of code points in context.
LETTER, NUMBER, OTHER, SPACE_RUN, SPACE_JOINS, SPACE_ALONE, APOS_1, APOS_2, BREAK = range(9)
# States: what the last code point left open.
OPEN_NOTHING, IN_LETTERS, IN_NUMBERS, IN_OTHERS, JOINS_NEXT, IN_SPACES, TAKES_1, TAKES_2 = range(8)
#: White space as Unicode has it: [start, end) of code points. Fixed values.
WHITE_SPACE = ((9, 14), (32, 33), (0x85, 0x86), (0xA0, 0xA1), (0x1680, 0x1681), (0x2000, 0x200B), (0x2028, 0x202A), (0x202F, 0x2030), (0x205F, 0x2060), (0x3000, 0x3001))
#: Contractions after an apostrophe. Fixed values.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
SENTINEL = 0x110000
BLOCK = 64
#: Code points scanned at once; the state goes on from part to part, so a text of any length needs little beside itself.
PART = 1 << 20
#: Matches encoded at once.
GROUP = 1 << 16


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next[class, state] and starts[class, state]."""
    nxt, starts = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for cls, state in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
        nxt[cls] = state
        starts[cls, [state, JOINS_NEXT]] = False
    nxt[LETTER, TAKES_1], nxt[LETTER, TAKES_2] = OPEN_NOTHING, TAKES_1
    starts[LETTER, [TAKES_1, TAKES_2]] = False
    for cls, state in ((APOS_1, TAKES_1), (APOS_2, TAKES_2)):
        nxt[cls] = state
        nxt[cls, [IN_OTHERS, JOINS_NEXT]] = IN_OTHERS
        starts[cls, [IN_OTHERS, JOINS_NEXT]] = False
    nxt[SPACE_RUN] = IN_SPACES
    starts[SPACE_RUN, IN_SPACES] = False
    nxt[SPACE_JOINS], nxt[SPACE_ALONE], nxt[BREAK] = JOINS_NEXT, OPEN_NOTHING, OPEN_NOTHING
    return nxt, starts


NEXT, STARTS = _automaton()
#: next[class, class, class, class, state]: four steps in one, the first class first.
_NEXT2 = np.stack([[NEXT[b][NEXT[a]] for b in range(9)] for a in range(9)])
NEXT4 = np.stack([[[[_NEXT2[c, d][_NEXT2[a, b]] for d in range(9)] for c in range(9)] for b in range(9)] for a in range(9)])


@lru_cache(maxsize=1)
def codepoint_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE_RUN of every code point, BREAK of the sentinel."""
    out = np.full(SENTINEL + 1, OTHER, np.uint8)
    points = [*range(0xD800), *range(0xE000, SENTINEL)]
    every = "".join(map(chr, points))
    at = np.array(points)
    for cls, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            out[at[m.start() : m.end()]] = cls
    for a, b in WHITE_SPACE:
        out[a:b] = SPACE_RUN
    out[SENTINEL] = BREAK
    return out


def classes_of(points: np.ndarray) -> np.ndarray:
    """Classes in context; ``points`` ends with a sentinel, and one stands between texts."""
    cls = codepoint_classes()[points]
    white = cls == SPACE_RUN
    after = np.empty_like(cls)
    after[:-1], after[-1] = cls[1:], BREAK
    last = white & (after != SPACE_RUN) & (after != BREAK)
    cls[last] = np.where(points[last] == 32, SPACE_JOINS, SPACE_ALONE)
    apos = np.flatnonzero(points == 39)
    if len(apos):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = padded[apos + 1], padded[apos + 2]
        for word in CONTRACTIONS:
            hit = one == ord(word[0])
            if len(word) == 2:
                hit &= two == ord(word[1])
            cls[apos[hit]] = APOS_1 if len(word) == 1 else APOS_2
    return cls


def state_before(cls: np.ndarray, initial: int = OPEN_NOTHING) -> np.ndarray:
    """The automaton's state before each code point, by an associative scan of transition functions."""
    n = len(cls)
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, BREAK, np.uint8)
    grid[:n] = cls
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
    whole = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))  # each block's function, state by state
    flat, fours, wide = NEXT.ravel(), NEXT4.ravel(), grid.astype(np.uint16)
    for i in range(0, BLOCK, 4):  # functions of four classes at a time
        key = ((wide[i] * 9 + wide[i + 1]) * 9 + wide[i + 2]) * 9 + wide[i + 3]
        whole = fours[(key * 8)[:, None] + whole]
    step = 1
    while step < blocks:  # inclusive scan: function of all blocks up to here
        joined = whole.copy()
        joined[step:] = np.take_along_axis(whole[step:], whole[:-step], axis=1)
        whole, step = joined, 2 * step
    state = np.full(blocks, initial, np.uint8)
    state[1:] = whole[:-1, initial]
    out = np.empty((BLOCK, blocks), np.uint8)
    for i in range(BLOCK):
        out[i] = state
        state = flat[wide[i] * 8 + state]
    return out.T.ravel()[:n]


def match_starts(points: np.ndarray) -> np.ndarray:
    """Which code points start a match; ``points`` ends with a sentinel, and one stands between texts."""
    out, state = np.empty(len(points), bool), OPEN_NOTHING
    for a in range(0, len(points), PART):
        cls = classes_of(points[a : a + PART + 2])[: min(PART, len(points) - a)]  # two more decide what follows
        key = cls.astype(np.uint16) * 8 + state_before(cls, state)
        out[a : a + len(cls)] = STARTS.ravel()[key]
        state = int(NEXT.ravel()[key[-1]])
    return out


def pretokenise(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """UTF-8 of all texts, byte offsets of the matches (with the end) and each text's first match (with the end)."""
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    starts = match_starts(np.insert(points, ends, SENTINEL))
    at = np.flatnonzero(np.delete(starts, ends + np.arange(len(texts))))
    first = np.concatenate([[0], np.searchsorted(at, ends)])
    raw = joined.encode()
    if len(raw) == len(points):
        return raw, np.append(at, len(raw)), first
    heads = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80  # bytes that begin a code point
    return raw, np.append(np.flatnonzero(heads)[at], len(raw)), first


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Bpe:
    """Pair merging by rank, piece by piece, with a bounded cache."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.vocab = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.vocab[rank] = token
        self.cache = Memo(self._packed)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)

    def merge(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        return self._merge_short(piece) if len(piece) <= 64 else self._merge_long(piece)

    def _merge_short(self, piece: bytes) -> list[int]:
        ranks, parts = self.ranks, [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(a + b, SENTINEL) for a, b in zip(parts, parts[1:])]
        while pairs:
            low = min(pairs)
            if low == SENTINEL:
                break
            i = pairs.index(low)
            parts[i] += parts[i + 1]
            del parts[i + 1], pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], SENTINEL)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], SENTINEL)
        return [ranks[x] for x in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges from a heap, for pieces of any length."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # end of the part that starts here, 0 once merged away
        prev, heap = list(range(-1, n - 1)), []

        def push(a: int) -> None:
            b = end[a]
            if b < n and (rank := ranks.get(piece[a : end[b]])) is not None:
                heapq.heappush(heap, (rank, a, b, end[b]))

        for i in range(n):
            push(i)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if end[a] != b or end[b] != c:
                continue
            end[a], end[b] = c, 0
            if c < n:
                prev[c] = a
            push(a)
            if prev[a] >= 0:
                push(prev[a])
        out, a = [], 0
        while a < n:
            out.append(ranks[piece[a : end[a]]])
            a = end[a]
        return out

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], SENTINEL)

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of many pieces: each round merges every piece's first pair of lowest rank, all pieces at once."""
        out: list[bytes] = [b""] * len(pieces)
        todo = []
        for i, piece in enumerate(pieces):
            if piece in self.ranks or len(piece) > 64:
                out[i] = self._packed(piece)
            else:
                todo.append(i)
        if not todo:
            return out
        sizes = np.array([len(pieces[i]) for i in todo])
        who = np.repeat(np.arange(len(todo)), sizes)
        tok = self.byte_ids[np.frombuffer(b"".join([pieces[i] for i in todo]), np.uint8)]
        rank = np.full(len(tok), SENTINEL, np.int64)
        rank[:-1] = np.where(who[:-1] == who[1:], self._pair_rank(tok[:-1], tok[1:]), SENTINEL)
        while len(tok):
            starts = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
            low = np.minimum.reduceat(rank, starts)
            spans = np.diff(np.concatenate([starts, [len(tok)]]))
            done = low == SENTINEL
            if done.any():
                packed, ends = tok.astype("<u4").tobytes(), starts + spans
                for w, a, b in zip(who[starts[done]].tolist(), (4 * starts[done]).tolist(), (4 * ends[done]).tolist()):
                    out[todo[w]] = packed[a:b]
                live = np.repeat(~done, spans)
                tok, who, rank = tok[live], who[live], rank[live]
                low, spans = low[~done], spans[~done]
                if not len(tok):
                    break
            hits = np.flatnonzero(rank == np.repeat(low, spans))
            at = hits[np.concatenate([[True], who[hits[1:]] != who[hits[:-1]]])]
            tok[at] = low
            keep = np.ones(len(tok), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # places after the merged halves are gone
            tok, who, rank = tok[keep], who[keep], rank[keep]
            for i in (at, at[at > 0] - 1):
                after = np.minimum(i + 1, len(tok) - 1)
                rank[i] = np.where((after > i) & (who[after] == who[i]), self._pair_rank(tok[i], tok[after]), SENTINEL)
        return out

    def _packed(self, piece: bytes) -> bytes:
        return np.array(self.merge(piece), "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        raw, at, first = pretokenise(texts)
        parts = []
        for i in range(0, len(at) - 1, GROUP):  # a long text in groups of matches
            cuts = at[i : i + GROUP + 1].tolist()
            pieces = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
            self.cache.fill(set(pieces), self.merge_all)
            parts.append(list(map(self.cache.__getitem__, pieces)))
        packed = parts[0] if len(parts) == 1 else [x for p in parts for x in p]
        return [np.frombuffer(b"".join(packed[a:b]), "<u4") for a, b in zip(first.tolist(), first[1:].tolist())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))


def bpe(path: str) -> Bpe:
    return of_worker(("bpe", path), lambda: Bpe(path))


def encode(docs: DataFrame, ranks: str, with_offsets: bool = False) -> DataFrame:
    """doc_id, ids array<int> and, if asked for, starts array<int> (byte offset of every token in the UTF-8 text).

    A null or empty text gives an empty array. Rows stay as they are, repeated ones too; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(ranks)
        sizes = np.fromiter(map(len, model.vocab), np.int64, len(model.vocab))
        for batch in portions(batches, 1):
            ids = model.encode([x or "" for x in batch.column(1).to_pylist()])
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32())
            flat = np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32)
            columns = [batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))]
            if with_offsets:
                starts = [np.cumsum(sizes[x]) - sizes[x] for x in ids]
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*starts, np.zeros(0, np.int64)]).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "starts"][: len(columns)])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", starts array<int>" * with_offsets)


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """Add decoded (binary): the bytes of ``ids``; null ids give null."""
    small_batches(encoded.sparkSession)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(ranks)
        for batch in batches:
            texts = [None if x is None else model.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")


def digests(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: its whole text is encoded, and the ids decoded.

    One pass, so ids stay inside the task. Null and empty texts have no ids; repeated rows stay; other columns are
    ignored.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(ranks)
        decimal = [b"%d" % i for i in range(len(model.vocab))]
        for batch in portions(batches, 1):
            counts, spelt, bytes_of = [], [], []
            for ids in model.encode([x or "" for x in batch.column(1).to_pylist()]):
                ids = ids.tolist()
                counts.append(len(ids))
                spelt.append(hashlib.sha256(b" ".join(map(decimal.__getitem__, ids))).hexdigest())
                bytes_of.append(hashlib.sha256(model.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(spelt, pa.string()), pa.array(bytes_of, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_scan_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
