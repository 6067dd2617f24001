"""Byte-level BPE by corpus-level merge replay.

A task takes the distinct words of its documents, lays them out as one sequence of symbols and
keeps an inverted index from token pair to the positions where the pair stands. Merges are applied
in rank order, each at all its positions at once, and only the neighbours that a merge touches are
looked up again. Each distinct word is merged once for a task's batch; a table of the words seen,
of bounded size, serves all documents. No shuffle is needed, and results depend on the text alone.

A piece that is itself a token takes that token, as in the common library. Where a merge would give
rise to a pair of lower rank than its own, the word is encoded again by itself, one merge at a time.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stareflow.llm.common import BATCH_BYTES, map_batches, utf8

#: Rank file and pattern that the queries take; both are parameters of the operators.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Words that a task remembers before it forgets all and starts again.
WORDS_KEPT = 300_000

_NONE = np.int64(1 << 40)
_SIMPLE_END = 0x250  # characters below it, and general punctuation, have a pattern of plain classes


def _char_class(of: str) -> str:
    found = [c for c in [*range(_SIMPLE_END), *range(0x2000, 0x2070)] if regex.match(of, chr(c))]
    return "".join(re.escape(chr(c)) for c in found)


@functools.cache
def splitter(pattern: str):
    """A function from a text to the pattern's matches in order.

    For the standard pattern, texts of common characters take an equal pattern of plain classes,
    which runs three times as fast.
    """
    full = regex.compile(pattern).findall
    if pattern != PATTERN:
        return full
    letter, digit, space = (_char_class(p) for p in (r"\p{L}", r"\p{N}", r"\s"))
    fast = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{letter}]+| ?[{digit}]+| ?[^{space}{letter}{digit}]+|[{space}]+(?![^{space}])|[{space}]+").findall
    rare = re.compile(f"[^\\x00-{chr(_SIMPLE_END - 1)} -⁯]").search
    return lambda text: full(text) if rare(text) else fast(text)


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[start[i] : start[i] + length[i]] for each i, joined."""
    end = np.cumsum(length)
    return flat[np.repeat(start - end + length, length) + np.arange(end[-1] if len(end) else 0)]


class Merges:
    """The vocabulary of a rank file, with every split of a token into two tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.size = ranks, max(ranks.values()) + 1
        pairs = [(a * self.size + b, r) for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.keys, self.values = np.append(table[:, 0], np.iinfo(np.int64).max), np.append(table[:, 1], _NONE)
        self.bytes_ = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        left = table[:, 0] // self.size
        self.falls = np.zeros(self.size, bool)  # tokens that start a pair of lower rank than theirs
        self.falls[left[table[:, 1] < left]] = True
        by_rank = sorted((r, t) for t, r in ranks.items())
        self.length = np.zeros(self.size, np.int64)
        self.length[[r for r, _ in by_rank]] = [len(t) for _, t in by_rank]
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(t for _, t in by_rank), np.uint8)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank at which left and right merge; _NONE if they don't."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], _NONE)

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.flat, self.start[ids], self.length[ids]).tobytes()

    def one(self, word: bytes) -> list[int]:
        """One word by itself: the leftmost pair of lowest rank merges until none is left."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            best = min((self.ranks.get(parts[i] + parts[i + 1], self.size), i) for i in range(len(parts) - 1))
            if best[0] == self.size:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All merges over all words: the token ids, joined, and each word's number of them."""
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size)
        first, last = end - size, end - 1
        token = np.append(self.bytes_[data], 0)
        after, before = np.arange(1, n + 2), np.arange(-1, n)  # position n stands for none
        after[last], before[first] = n, n
        rank = np.full(n + 1, _NONE)
        rank[:n] = self.of(token[:n], token[1:])
        rank[last] = _NONE
        alive = np.ones(n, bool)
        again: set[int] = set()

        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cut = np.flatnonzero(np.diff(ranks)) + 1
            for r, part in zip(ranks[np.r_[0, cut]].tolist(), np.split(at, cut), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        some = np.flatnonzero(rank[:n] < _NONE)
        if len(some):
            add(some, rank[some])
        while heap:
            r = heapq.heappop(heap)
            found = index.pop(r)
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            at = at[rank[at] == r]
            if not len(at):
                continue
            right = after[at]
            if (rank[right] == r).any():  # as in aaa: the leftmost pair goes first
                taken, blocked = [], set()
                for p, q in zip(at.tolist(), right.tolist(), strict=True):
                    if p not in blocked:
                        taken.append(p)
                        blocked.add(q)
                at = np.array(taken)
                right = after[at]
            then = after[right]
            if self.falls[r]:
                odd = at[(rank[then] == r) & (self.of(np.full(len(at), r), token[then]) < r)]
                again.update(np.searchsorted(end, odd, side="right").tolist())
            token[at], after[at], before[then] = r, then, at
            rank[right], alive[right] = _NONE, False
            touched = before[at]
            touched = np.unique(np.concatenate([at, touched[touched < n]])) if len(at) > 1 else np.append(at, touched[touched < n])
            then = after[touched]
            new = np.where(then == n, _NONE, self.of(token[touched], token[then]))
            rank[touched] = new
            if self.falls[r] and (new < r).any() or (new < r).any():
                again.update(np.searchsorted(end, touched[new < r], side="right").tolist())
            some = new < _NONE
            if some.any():
                add(touched[some], new[some])
        count = np.add.reduceat(alive, first, dtype=np.int64) if n else np.zeros(len(words), np.int64)
        ids = token[:n][alive]
        if again:
            parts = np.split(ids, np.cumsum(count)[:-1])
            for w in again:
                parts[w] = np.array(self.one(words[w]), np.int64)
            ids, count = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids, count


@functools.lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    """The merges of a rank file: a line for each token, base64 and rank."""
    with open(path, "rb") as lines:
        return Merges({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class WordTable:
    """The token ids of the words that a task has seen."""

    def __init__(self, path: str, pattern: str = PATTERN):
        self.merges, self.split = merges(path), splitter(pattern)
        self.clear()

    def clear(self) -> None:
        self.number = _Numbers()
        self.flat = np.empty(0, np.int32)
        self.start = self.length = np.empty(0, np.int64)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Each text's token ids."""
        if len(self.number) > WORDS_KEPT:
            self.clear()
        known, number, split = len(self.number), self.number.__getitem__, self.split
        rows = []
        for text in texts:
            words = split(text or "")
            rows.append(np.fromiter(map(number, words), np.int32, len(words)))
        self._learn([*self.number][known:] if known < len(self.number) else [])
        return [gather(self.flat, self.start[r], self.length[r]) for r in rows]

    def _learn(self, words: list[str]) -> None:
        if not words:
            return
        raw = [utf8(w) for w in words]
        whole = [self.merges.ranks.get(w, -1) for w in raw]
        ids, count = self.merges.replay([w for w, r in zip(raw, whole, strict=True) if r < 0])
        whole = np.array(whole)
        length = np.ones(len(raw), np.int64)
        length[whole < 0] = count
        start = np.cumsum(length) - length
        flat = np.empty(int(length.sum()), np.int32)
        flat[start[whole >= 0]] = whole[whole >= 0]
        mask = np.ones(len(flat), bool)
        mask[start[whole >= 0]] = False
        flat[mask] = ids
        self.start = np.concatenate([self.start, start + len(self.flat)])
        self.flat = np.concatenate([self.flat, flat])
        self.length = np.concatenate([self.length, length])


def bpe_encode(docs: DataFrame, path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) for each row of docs(doc_id, text).

    ids: the ranks of the pattern's matches, each encoded by itself, without special tokens.
    ids_sha256: of the ids as little-endian unsigned 32-bit integers; decoded_sha256: of the bytes
    that the ids decode to. A null or empty text has no tokens. Repeated rows and null ids stay as
    they are; other columns are ignored; an empty table gives an empty one; texts are taken whole,
    whatever their length.
    """

    def start():
        table = WordTable(path, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = table.encode(batch.column(1).to_pylist())
            ids = [hashlib.sha256(r.astype("<u4").tobytes()).hexdigest() for r in rows]
            text = [hashlib.sha256(table.merges.decode(r)).hexdigest() for r in rows]
            size = np.fromiter(map(len, rows), np.int64, len(rows))
            offsets = pa.array(np.append(0, np.cumsum(size)).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32), pa.int32()))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), lists, pa.array(ids, pa.string()), pa.array(text, pa.string())], names=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

        return step

    own = docs.select(F.col("doc_id").cast("long"), "text")
    return map_batches(own, start, "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string", BATCH_BYTES)


def bpe_decode(tokens: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, text) of tokens(doc_id, ids): the ids' bytes as UTF-8; null ids are an empty text."""

    def start():
        table = merges(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            text = [table.decode(np.array(ids or [], np.int64)).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

        return step

    return map_batches(tokens.select(F.col("doc_id").cast("long"), "ids"), start, "doc_id long, text string")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe_encode(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: each document's token ids, with the digests of ids and text.

    It gives the columns of bpe_encode() and drops all others of docs. A row for each row: null and empty
    texts have no tokens, repeated rows and null ids stay, an empty table gives an empty one.
    """
    return bpe_encode(docs)
