"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches in a piece of text; dynamic programming
carries, for each position, the best score and the number of pieces on the best path, and nothing
else: no lattice and no pieces are kept. Rules are those of the common unigram tokenizers: a space
becomes the mark of a word's start, a text starts with one, a higher score wins and at equal scores
the longest last piece; a character without a piece of its own scores PENALTY below the lowest piece
and counts as its UTF-8 bytes.

No piece holds the mark after another character, so a text's best path is the best paths of its
marked chunks, one after another; each distinct chunk of a task's documents is searched once.
"""

from __future__ import annotations

import functools
import re
from array import array

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stareflow.llm.common import map_batches

#: Vocabulary file that the query takes; its pieces and scores are used as a unigram vocabulary.
VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
PENALTY = 10.0
#: Scores at or below this mark pieces that the vocabulary never uses.
UNUSED = -1e8
#: Chunks that a task remembers before it forgets all and starts again.
CHUNKS_KEPT = 600_000


def unigram_vocabulary(path: str = VOCABULARY) -> dict[str, float]:
    """The ordinary pieces of a vocabulary file and their scores."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {}
    for i in range(model.get_piece_size()):
        if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)) and model.get_score(i) > UNUSED:
            found[model.id_to_piece(i)] = model.get_score(i)
    return found


class Viterbi:
    """Scores and piece counts of chunks of text."""

    def __init__(self, vocabulary: dict[str, float]):
        if any(MARK in piece.lstrip(MARK) for piece in vocabulary):
            raise ValueError("a piece holds the mark of a word's start after another character")
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.items():
            self.automaton.add_word(piece, (len(piece), score))
        if vocabulary:
            self.automaton.make_automaton()
        self.unknown = min(vocabulary.values(), default=0.0) - PENALTY
        lone = not any("\n" in piece and len(piece) > 1 for piece in vocabulary)
        #: Where no piece joins a line's end to its neighbours, it is a chunk by itself.
        self.chunks = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n" if lone else f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        self.known = bool(vocabulary)

    def search(self, chunk: str) -> tuple[float, int]:
        """The best path's score and its number of pieces."""
        n = len(chunk)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        if self.known:
            for end, match in self.automaton.iter(chunk):
                ends[end].append(match)
        for i in range(n):
            best, size, pieces = None, 0, 0
            for length, own in ends[i]:
                now = score[i + 1 - length] + own
                if best is None or now > best or now == best and length > size:
                    best, size, pieces = now, length, count[i + 1 - length] + 1
            if not any(length == 1 for length, _ in ends[i]):
                now = score[i] + self.unknown
                if best is None or now > best:
                    best, pieces = now, count[i] + len(chunk[i].encode("utf-8", "surrogatepass"))
            score[i + 1], count[i + 1] = best, pieces
        return score[n], count[n]


class _Found(dict):
    def __init__(self, viterbi: Viterbi):
        super().__init__()
        self.viterbi, self.scores, self.counts = viterbi, array("d"), array("q")

    def __missing__(self, chunk: str) -> int:
        score, count = self.viterbi.search(chunk)
        self[chunk] = n = len(self)
        self.scores.append(score)
        self.counts.append(count)
        return n


class ChunkTable:
    """What a task has found for chunks."""

    def __init__(self, vocabulary: dict[str, float]):
        self.viterbi = Viterbi(vocabulary)
        self.found = _Found(self.viterbi)

    def count(self, text: str | None) -> tuple[float, int]:
        """A text's best score and number of pieces; null and empty texts have none."""
        if not text:
            return 0.0, 0
        if len(self.found) > CHUNKS_KEPT:
            self.found = _Found(self.viterbi)
        chunks = self.viterbi.chunks(MARK + text.replace(" ", MARK))
        at = np.fromiter(map(self.found.__getitem__, chunks), np.int64, len(chunks))
        return float(np.frombuffer(self.found.scores, np.float64)[at].sum()), int(np.frombuffer(self.found.counts, np.int64)[at].sum())


@functools.lru_cache(maxsize=2)
def _table(path: str) -> ChunkTable:
    return ChunkTable(unigram_vocabulary(path))


def count_tokens(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, score) for each row of docs(doc_id, text).

    A null or empty text has no tokens and score 0. Repeated rows and null ids stay; other columns
    are ignored; an empty table gives an empty one. Texts are counted whole.
    """

    def start():
        table = _table(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [table.count(t) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in found], pa.int64()), pa.array([s for s, _ in found], pa.float64())], names=["doc_id", "n_tokens", "score"])

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), start, "doc_id long, n_tokens long, score double")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token counts of all documents."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
