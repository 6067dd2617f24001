"""Token-id output: best-fit-decreasing packing into rows of fixed length.

A task encodes its documents, ends each with a mark, splits what is longer than a row into parts
without loss, and packs groups of bounded size: parts by falling length, each into the row with the
least room that still holds it. A segment tree over capacities finds that row in a logarithmic
number of steps. No shuffle is needed, and a task holds one group at a time.

A row has the padded ids as a binary matrix row, the cumulative lengths of its segments, and the
places at which positions start again from 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stareflow.llm.bpe import PATTERN, RANKS, WordTable
from stareflow.llm.common import BATCH_BYTES, slices, small_batches, utf8

ROW_TOKENS = 8192
#: Tokens that are packed together: bounds a task's memory, and the share of room that is left.
GROUP_TOKENS = 4 << 20
#: Ids of the byte tokenizer: 0 to 255 the bytes, then the end of a document and the padding.
BYTE_END, BYTE_PAD = 256, 257


class Capacities:
    """Rows by the room that they have left; a segment tree tells which capacities are in use."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.used = bytearray(2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def add(self, room: int, row: int) -> None:
        rows = self.rows.setdefault(room, [])
        rows.append(row)
        if len(rows) == 1:
            at = room + self.size
            while at and not self.used[at]:
                self.used[at] = 1
                at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least room of need or more, and its room; it is taken out."""
        used, at = self.used, need + self.size
        if not used[at]:
            while at > 1 and not (at % 2 == 0 and used[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if used[2 * at] else 2 * at + 1
        room = at - self.size
        rows = self.rows[room]
        row = rows.pop()
        if not rows:
            while at and not (at < self.size and (used[2 * at] or used[2 * at + 1])):
                used[at] = 0
                at >>= 1
        return row, room


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Which items each row holds; no item is longer than capacity, and none is left out."""
    rooms, rows = Capacities(capacity), []
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        found = rooms.take(need)
        if found is None:
            row, room = len(rows), capacity
            rows.append([])
        else:
            row, room = found
        rows[row].append(item)
        if room > need:
            rooms.add(room - need, row)
    return rows


def pack(docs: DataFrame, row_tokens: int = ROW_TOKENS, group_tokens: int = GROUP_TOKENS, ranks: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """Packed rows of docs(doc_id, text): (task, row, n_used, ids, cu_seqlens, resets, doc_ids,
    doc_nos, parts).

    ids: row_tokens little-endian unsigned integers, of 16 bits for the byte tokenizer and of 32 for
    the merges of a rank file. Segment i is ids[cu_seqlens[i] : cu_seqlens[i + 1]]; resets are the
    segments' first places. A segment is part parts[i] of the document doc_ids[i]; doc_nos numbers
    the task's documents, so that rows that repeat an id stay apart. Every document ends with one
    end mark, a null or empty text too. Other columns are ignored; an empty table gives an empty
    one. Texts are packed whole, in as many parts as they need.
    """

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        table = WordTable(ranks, pattern) if ranks else None
        end, pad, kind = (table.merges.size, table.merges.size + 1, "<u4") if table else (BYTE_END, BYTE_PAD, "<u2")
        names = ["task", "row", "n_used", "ids", "cu_seqlens", "resets", "doc_ids", "doc_nos", "parts"]
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), ints, ints, longs, longs, ints]
        held: list[tuple[int | None, int, int, np.ndarray]] = []  # doc_id, its number, part, ids
        tokens = row_no = doc_no = 0

        def emit():
            nonlocal row_no
            lengths = np.fromiter((len(x[3]) for x in held), np.int64, len(held))
            rows = best_fit_decreasing(lengths, row_tokens)
            for at in range(0, len(rows), 256):
                cols: list[list] = [[] for _ in names]
                for items in rows[at : at + 256]:
                    own = [held[i] for i in items]
                    cu = np.append(0, np.cumsum(lengths[items])).astype(np.int32)
                    ids = np.full(row_tokens, pad, kind)
                    ids[: cu[-1]] = np.concatenate([x[3] for x in own])
                    for col, value in zip(cols, (task, row_no, int(cu[-1]), ids.tobytes(), cu, cu[:-1], [x[0] for x in own], [x[1] for x in own], [x[2] for x in own]), strict=True):
                        col.append(value)
                    row_no += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
            held.clear()

        for batch in batches:
            for some in slices(batch, BATCH_BYTES):
                texts = some.column(1).to_pylist()
                coded = table.encode(texts) if table else [np.frombuffer(utf8(t), np.uint8) for t in texts]
                for doc_id, ids in zip(some.column(0).to_pylist(), coded, strict=True):
                    ids = np.append(ids.astype(kind), np.array([end], kind))
                    for part, s in enumerate(range(0, len(ids), row_tokens)):
                        held.append((doc_id, doc_no, part, ids[s : s + row_tokens]))
                    doc_no += 1
                    tokens += len(ids)
                    if tokens >= group_tokens:
                        tokens = 0
                        yield from emit()
        if held:
            yield from emit()

    schema = "task int, row long, n_used int, ids binary, cu_seqlens array<int>, resets array<int>, doc_ids array<long>, doc_nos array<long>, parts array<int>"
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def unpack(packed: DataFrame, id_bytes: int = 2) -> DataFrame:
    """(task, doc_no, doc_id, ids) of the documents in packed rows: parts joined, end marks included."""
    seg = packed.select("task", "ids", "cu_seqlens", "doc_ids", "doc_nos", F.posexplode("parts").alias("i", "part"))
    start, stop = F.get("cu_seqlens", F.col("i")), F.get("cu_seqlens", F.col("i") + 1)
    ids = F.substr("ids", start * id_bytes + 1, (stop - start) * id_bytes)
    seg = seg.select("task", F.get("doc_nos", F.col("i")).alias("doc_no"), F.get("doc_ids", F.col("i")).alias("doc_id"), F.struct("part", F.hex(ids).alias("ids")).alias("p"))
    whole = seg.groupBy("task", "doc_no").agg(F.max("doc_id").alias("doc_id"), F.sort_array(F.collect_list("p")).alias("p"))
    return whole.select("task", "doc_no", "doc_id", F.unhex(F.array_join(F.transform("p", lambda p: p["ids"]), "")).alias("ids"))


def write_packed(packed: DataFrame, path: str) -> None:
    """Writes packed rows as a Parquet table."""
    packed.write.mode("overwrite").parquet(path)


def op7_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed rows of the rank file's token ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks=RANKS)
