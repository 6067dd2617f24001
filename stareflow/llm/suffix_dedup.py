"""Removal of long repeats by suffix arrays that are sorted in two stages.

A byte goes if a string of LENGTH bytes that covers it also starts elsewhere. Such a string, a window, is
dealt by the least hash of the short strings (anchors) inside it: equal windows have equal keys, wherever
they stand. Windows of one key that follow each other in a document make a segment, and only where the hash
occurs twice can there be a repeat. Segments that are equal as a whole are one, sorted once with the
number that it stands for, and what is found for it holds for all.

The segments of a key meet in one task, many keys together as one text, and its suffix array is built in
two stages: only suffixes smaller than their successor are sorted directly, and a scan of the buckets
from the left induces all others, each behind its own first symbol in the order of its successor. The
common prefixes of neighbours in the array tell which windows occur twice.

A key with more than HOT different segments (a short passage that very many documents share) is dealt
anew by longer anchors, at last by whole windows: a passage that is shorter than the anchor falls apart,
and equal windows are one. So no task gathers a group that grows with the corpus.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stareflow.llm.common import bounded, fits, forget, joined, map_batches, slices, small_batches, stored, utf8

#: Bytes of a repeat, and of the strings by whose hashes windows are dealt: first, and of hot keys' windows again.
LENGTH, ANCHORS = 400, (64, 160, 280, 400)
#: Windows of a segment at most, and segments of a key that one task sorts at most.
PIECE, HOT = 512, 1024
#: Rounds of the direct sort that take the next symbols as they come.
PLAIN_TURNS = 2
#: Bytes that are hashed together, and bytes that are sorted together (or one key, if it has more): as fit a core's cache.
BLOCK, CHUNK = 1 << 17, 1 << 19

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S1, _S2 = np.uint64(32), np.uint64(29)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    h = a >> _S1
    h ^= a
    h *= _M1
    t = b * _M2
    h += t
    np.right_shift(h, _S2, out=t)
    h ^= t
    return h


def _doubled(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of strings of 2 n from those of strings of n."""
    return _mixed(h[:-n], h[n:]) if len(h) > n else h[:0]


def string_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A hash of data[i : i + length] for each i; length at least 8."""
    n = len(data)
    if n < length:
        return np.zeros(0, np.uint64)
    h = np.ndarray((n - 7,), "<u8", buffer=data, strides=(1,)).astype(np.uint64)
    h = _mixed(h, h)
    at = 8
    while 2 * at <= length:
        h, at = _doubled(h, at), 2 * at
    return h if at == length else _mixed(h[: n - length + 1], h[length - at : n - at + 1])


def least_in_window(h: np.ndarray, n: int) -> np.ndarray:
    """min(h[i : i + n]) for each i."""
    at = 1
    while 2 * at <= n:
        h, at = np.minimum(h[:-at], h[at:]), 2 * at
    return h if at == n else np.minimum(h[: len(h) - (n - at)], h[n - at :])


def segments(data: np.ndarray, ends: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, key, several) of the segments of texts that stand one after another and end at
    ends: stretches of windows of one text and one least hash, PIECE windows at most. several: that hash
    occurs more than once in the segment, so that the segment may repeat itself."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(bool)
    hashes, reach = string_hashes(data, anchor), length - anchor
    least = least_in_window(hashes, reach + 1)
    first, last = np.concatenate([[0], ends[:-1]]), ends - length + 1  # a text's windows begin from first to before last
    edges = np.concatenate([first, np.maximum(first, last), np.flatnonzero(least[1:] != least[:-1]) + 1])
    start = np.unique(edges[edges < len(least)])
    n = np.diff(start, append=len(least))
    own = start < last[np.searchsorted(ends, start, "right")]
    start, n = start[own], n[own]
    parts = -(-n // PIECE)
    which = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(start, parts) + which * PIECE
    n = np.minimum(np.repeat(n, parts) - which * PIECE, PIECE)
    key = least[start]
    several = [np.count_nonzero(hashes[s:e] == k) > 1 for s, e, k in zip(start.tolist(), (start + n + reach).tolist(), key, strict=True)]
    return start, n, key.view(np.int64), np.array(several, bool)


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


_SEGMENTS = "row binary, start long, n int, key long, several boolean, seg binary"


def _batch(schema: str, cols: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def _cut(length: int, anchor: int):
    """Texts to segments. Short texts are hashed together; one of more than BLOCK bytes is hashed in parts that
    share length - 1 bytes, cut by its own places alone, so that equal texts have equal segments."""

    def block(pieces: list[tuple[bytes, int, bytes]], cols: list[list]) -> None:
        data = b"".join(p for *_, p in pieces)
        ends = np.cumsum([len(p) for *_, p in pieces])
        start, n, key, several = segments(np.frombuffer(data, np.uint8), ends, length, anchor)
        of = np.searchsorted(ends, start, "right")
        cols[0] += [pieces[i][0] for i in of.tolist()]
        shift = np.array([at - e + len(p) for (_, at, p), e in zip(pieces, ends.tolist(), strict=True)], np.int64)
        for c, x in zip(cols[1:5], (start + shift[of], n, key, several), strict=True):
            c.append(x)
        cols[5] += [_digest(data[s:e]) for s, e in zip(start.tolist(), (start + n + length - 1).tolist(), strict=True)]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(6)]
        pieces, size = [], 0
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = utf8(text.as_py())
            for at in range(0, len(raw) - length + 1, BLOCK):
                pieces.append((row, at, raw[at : at + BLOCK + length - 1]))
                size += len(pieces[-1][2])
                if size >= BLOCK:
                    block(pieces, cols)
                    pieces, size = [], 0
        if pieces:
            block(pieces, cols)
        return _batch(_SEGMENTS, [cols[0], *(np.concatenate(c) if c else [] for c in cols[1:5]), cols[5]])

    return step


# The suffix array of a task's text: symbols are bytes plus one, and 0 ends each segment.


class Strings:
    """Words and hashes of the strings at each place of a text of symbols."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        ends = np.append(np.flatnonzero(symbols == 0), n)
        self.left = (ends[np.cumsum(symbols == 0) - (symbols == 0)] - np.arange(n)).astype(np.int64)  # symbols up to the end mark
        x = np.zeros(n + 2 * LENGTH + 600, np.uint64)
        x[:n] = symbols
        two = (x[:-1] << np.uint64(9)) | x[1:]
        four = (two[:-2] << np.uint64(18)) | two[2:]
        self.seven = (four[:-3] << np.uint64(27)) | (four[3:] & np.uint64((1 << 27) - 1))
        self.four, self.levels = four, [(4, four)]
        h, at = _mixed(four[:-4], four[4:]), 8
        while at <= 256:
            self.levels.append((at, h))
            h, at = _doubled(h, at), 2 * at
        self.levels = self.levels[::-1] + [(2, two), (1, x)]

    def common(self, a: np.ndarray, b: np.ndarray, known: np.ndarray | int, exact: bool) -> np.ndarray:
        """How many symbols the strings at a and b share, LENGTH at most, where the first known are
        shared; in steps of 4 unless exact."""
        off = np.zeros(len(a), np.int64) + known
        for n, h in self.levels:
            if n < 4 and not exact:
                break
            same = h[a + off] == h[b + off]
            off += n * (same & (off < LENGTH))
        return np.minimum(off, LENGTH)


def sort_directly(p: np.ndarray, strings: Strings) -> np.ndarray:
    """The places p in the order of the strings there, down to LENGTH symbols.

    Places are sorted by seven symbols at once, and those that tie by the next four, a few times. What
    still ties are long repeats: each group is parted around the one of its strings that goes on longest.
    Strings below it come in the order of what they share with it, strings above it the other way
    round, and the three symbols behind part those that share as much. So repeats of one period,
    which differ in length alone, are put in order at once."""
    word = strings.seven[p]
    order = np.argsort(word)
    p, word = p[order], word[order]
    new = np.concatenate([[True], word[1:] != word[:-1]])
    known = np.full(len(p), 7)
    at = np.arange(len(p))  # the ties' places in p
    for turn in itertools.count():
        size = np.diff(np.flatnonzero(new), append=len(new))
        tied = np.repeat(size > 1, size) & (known < LENGTH)  # a group has one depth
        at, new, known = at[tied], new[tied], known[tied]
        if not len(at):
            return p
        own = p[at]
        group = np.cumsum(new) - 1
        if turn < PLAIN_TURNS:
            word = (group.astype(np.uint64) << np.uint64(36)) | strings.four[own + known]
            order = np.argsort(word)
            deeper = known + 4
        else:
            first = np.flatnonzero(new)
            longest = np.maximum.reduceat((strings.left[own] << 32) + np.arange(len(own)), first) & 0xFFFFFFFF
            pivot = own[longest][group]
            share = strings.common(own, pivot, known, True)
            below = strings.four[own + share] < strings.four[pivot + share]
            side = np.where(below, share, 2 * LENGTH - share)
            word = (group.astype(np.uint64) << np.uint64(37)) | (side.astype(np.uint64) << np.uint64(27)) | (strings.four[own + share] >> np.uint64(9))
            word[share >= LENGTH] = (group[share >= LENGTH].astype(np.uint64) << np.uint64(37)) | np.uint64(LENGTH << 27)
            order = np.argsort(word)
            deeper = np.minimum(share + 3, LENGTH)
        p[at] = own[order]
        word, known = word[order], deeper[order]
        new = np.concatenate([[True], word[1:] != word[:-1]])


def suffix_array(symbols: np.ndarray, strings: Strings) -> np.ndarray:
    """All places in the order of their suffixes, down to LENGTH symbols.

    First stage: the suffixes smaller than their successor are sorted directly. Second stage: buckets
    of one first symbol are scanned from the left. A bucket begins with its suffixes larger than
    their successor: those whose successor stands in an earlier bucket have come in that order, and
    runs of the bucket's own symbol follow step by step.
    """
    n = len(symbols)
    nxt = np.append(symbols[1:], 0)
    turn = np.where(symbols != nxt, np.arange(n), n - 1)  # a place whose symbol differs from the next decides for the run before
    smaller = (symbols < nxt)[np.minimum.accumulate(turn[::-1])[::-1]]
    smaller[n - 1] = True  # the last end mark has nothing behind it
    direct = sort_directly(np.flatnonzero(smaller), strings)
    ends = np.cumsum(np.bincount(symbols[direct], minlength=257)).tolist()
    larger = ~smaller[:-1]
    before = symbols[:-1]
    induces = np.concatenate([[False], larger & (before > symbols[1:])])  # places whose predecessor is sorted by them
    runs_on = np.concatenate([[False], larger & (before == symbols[1:])])
    waiting: dict[int, list[np.ndarray]] = {}
    out = []
    for symbol in np.flatnonzero(np.bincount(symbols)).tolist():
        wave = np.concatenate(waiting.pop(symbol, [np.zeros(0, np.int64)]))
        bucket = [wave]
        while len(wave):
            wave = wave[runs_on[wave]] - 1
            bucket.append(wave)
        own = np.concatenate([*bucket, direct[ends[symbol - 1] if symbol else 0 : ends[symbol]]])
        out.append(own)
        before = own[induces[own]] - 1
        if len(before):
            to = symbols[before]
            order = np.argsort(to, kind="stable")
            before, to = before[order], to[order]
            cuts = np.flatnonzero(np.diff(to)) + 1
            for s, part in zip([0, *cuts.tolist()], np.split(before, cuts), strict=True):
                waiting.setdefault(int(to[s]), []).append(part)
    return np.concatenate(out)


def repeated_windows(texts: list[bytes], times: list[int] | None = None) -> list[np.ndarray]:
    """For each text, which of its windows of LENGTH bytes start at another place too, in the texts given
    or, for one that stands for several equal texts (times), in those."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + 1)
    starts = ends - 1 - sizes
    symbols = np.zeros(int(ends[-1]), np.int16)
    inside = np.ones(len(symbols), bool)
    inside[ends - 1] = False
    symbols[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int16) + 1
    whole = np.zeros(len(symbols) + 1, np.int32)  # windows that begin here and end in their own text
    np.add.at(whole, starts, 1)
    np.add.at(whole, ends - 1 - np.minimum(sizes, LENGTH - 1), -1)
    window = np.cumsum(whole[:-1]) > 0
    strings = Strings(symbols)
    order = suffix_array(symbols, strings)
    order = order[window[order]]  # what stands between two equal windows is equal to them
    a, b = order[:-1], order[1:]
    begin = strings.levels[0][1]
    alike = np.flatnonzero(begin[a] == begin[b])
    a, b = a[alike], b[alike]
    hit = np.flatnonzero(strings.common(a, b, 0, True) >= LENGTH)
    twice = np.zeros(len(symbols), bool)
    view = np.lib.stride_tricks.sliding_window_view(symbols, LENGTH) if len(symbols) >= LENGTH else None
    for s in range(0, len(hit), 4096):  # prefixes were compared by hashes: here symbol by symbol
        x, y = a[hit[s : s + 4096]], b[hit[s : s + 4096]]
        same = (view[x] == view[y]).all(axis=1)
        twice[x[same]] = twice[y[same]] = True
    for s, e, n in zip(starts.tolist(), ends.tolist(), times or (), strict=False):
        if n > 1:
            twice[s:e] = True
    return [twice[s : s + max(0, n - LENGTH + 1)] for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


_FOUND = "seg binary, spans array<struct<start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _sorter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's segments, sorted by key, to the windows of each that occur twice."""

    def solved(held: list[tuple[bytes, int, bytes]]) -> pa.RecordBatch | None:
        segs, spans = [], []
        for (seg, *_), flags in zip(held, repeated_windows([t for *_, t in held], [n for _, n, _ in held]), strict=True):
            if flags.any():
                segs.append(seg)
                spans.append([{"start": s, "end": e} for s, e in zip(*(x.tolist() for x in runs(flags)), strict=True)])
        return pa.RecordBatch.from_arrays([pa.array(segs, pa.binary()), pa.array(spans, _SPANS)], names=["seg", "spans"]) if segs else None

    held, size, last = [], 0, None
    for batch in batches:
        for part in slices(batch):
            for key, seg, times, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if held and seg == held[-1][0]:  # of rows alike, both hold the segment that was wanted of one
                    continue
                if key != last and size >= CHUNK:
                    if (out := solved(held)) is not None:
                        yield out
                    held, size = [], 0
                last = key
                held.append((seg, times, text))
                size += len(text) + 1
    if held and (out := solved(held)) is not None:
        yield out
    pa.default_memory_pool().release_unused()


_CUT = "key long, seg binary, times long, text binary"


def _texts(length: int):
    """Documents with the segments wanted of them to the segments' bytes."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(4)]
        for text, wanted in zip(batch.column("text"), batch.column("wanted"), strict=True):
            raw = utf8(text.as_py())
            for w in wanted.as_py():
                for c, x in zip(cols, (w["key"], w["seg"], w["times"], raw[w["start"] : w["start"] + w["n"] + length - 1]), strict=True):
                    c.append(x)
        return _batch(_CUT, cols)

    return step


_AGAIN = _SEGMENTS + ", times long, of binary, place long"


def _cut_again(length: int, anchor: int):
    """Documents with the segments wanted of them to these segments cut by longer anchors."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(9)]
        for row, text, wanted in zip(batch.column("row").to_pylist(), batch.column("text"), batch.column("wanted"), strict=True):
            raw = utf8(text.as_py())
            for w in wanted.as_py():
                own = raw[w["start"] : w["start"] + w["n"] + length - 1]
                start, n, key, several = (x.tolist() for x in segments(np.frombuffer(own, np.uint8), np.array([len(own)]), length, anchor))
                digests = [_digest(own[s : s + k + length - 1]) for s, k in zip(start, n, strict=True)]
                m = len(start)
                each = ([row] * m, [w["start"] + s for s in start], n, key, several, digests, [w["times"]] * m, [w["seg"]] * m, start)
                for c, x in zip(cols, each, strict=True):
                    c += x
        return _batch(_AGAIN, cols)

    return step


def _wanted(kinds: DataFrame, docs: DataFrame, few: bool) -> DataFrame:
    """(row, text, wanted) of the documents that hold kinds(key, seg, times, at), both sides dealt by document; few: kinds of
    hot keys alone, which are broadcast to the documents if their count allows it."""
    own = kinds.select("at.row", F.struct("at.start", "at.n", "key", "seg", "times").alias("w"))
    own = own.groupBy("row").agg(F.collect_list("w").alias("wanted"))
    return docs.select("row", "text").join(F.broadcast(own) if few and fits(kinds.count(), 200) else own, "row")


def _twice(parts: DataFrame, docs: DataFrame, length: int, hot: int, longer: tuple[int, ...]) -> DataFrame:
    """parts with spans, of those that hold windows which occur twice; hot: from more different segments of a key on, it is
    dealt anew by the first of the longer anchors, if there is one."""
    keys = parts.groupBy("key").agg(F.sum("times").alias("n"), F.max("several").alias("several")).where("n > 1 or several")
    keys = stored(keys.select("key"))
    parts = stored(joined(parts, keys, "key", 24))
    kinds = stored(parts.groupBy("key", "seg").agg(F.sum("times").alias("times"), F.min(F.struct("row", "start", "n")).alias("at")))
    cold, many = kinds, None
    if longer:
        many = stored(kinds.groupBy("key").count().where(F.col("count") > hot).select("key"))
        few = many.count()  # one in hot of all kinds at most
        many = bounded(many, 24, few) if few else None
    if many is not None:
        cold = kinds.join(many, "key", "left_anti")
    texts = map_batches(_wanted(cold, docs, longer != ANCHORS[1:]), lambda: _texts(length), _CUT)
    small_batches(docs.sparkSession)
    found = texts.repartition("key").sortWithinPartitions("key", "seg").mapInArrow(_sorter, _FOUND)
    if many is not None:
        pieces = stored(map_batches(_wanted(kinds.join(many, "key", "left_semi"), docs, True), lambda: _cut_again(length, longer[0]), _AGAIN))
        own = F.transform("spans", lambda s: F.struct((s["start"] + F.col("place")).cast("int").alias("start"), (s["end"] + F.col("place")).cast("int").alias("end")))
        hit = _twice(pieces, docs, length, hot, longer[1:]).select(F.col("of").alias("seg"), own.alias("own"))
        found = found.unionByName(hit.groupBy("seg").agg(F.flatten(F.collect_set("own")).alias("spans")))  # a segment's windows at most
    found = stored(found)
    most = found.agg(F.max(F.size("spans"))).first()[0] or 0
    out = stored(joined(parts.drop("key", "several", "n"), found, "seg", 80 + 24 * most))
    forget(keys, kinds, parts, found)
    return out


_KEPT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def _kept(length: int):
    """Documents and their repeated windows to what is removed and what stays."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, sizes, spans, kept = batch.column("doc_id"), [], [], []
        for text, found in zip(batch.column("text"), batch.column("found"), strict=True):
            raw = utf8(text.as_py())
            cover = np.zeros(len(raw) + 1, np.int64)
            for f in found.as_py() or ():
                for s in f["spans"]:
                    cover[f["start"] + s["start"]] += 1
                    cover[f["start"] + s["end"] - 1 + length] -= 1
            gone = np.cumsum(cover[:-1]) > 0
            start, end = runs(gone)
            sizes.append(len(raw))
            spans.append([{"start": s, "end": e} for s, e in zip(start.tolist(), end.tolist(), strict=True)])
            kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes() if len(start) else raw)
        return pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return step


def without_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of docs(doc_id, text): the stretches of bytes that are removed, as
    (start, end), and the bytes that stay, one after another.

    A byte is removed if a string of LENGTH bytes that covers it also starts anywhere else, in the same
    document or another; strings never cross documents and are judged on the texts as given. A null
    text is empty; a null or repeated doc_id is a document of its own, and rows that repeat remove each
    other's long strings. A document is told by a digest of its id and text, not by its place, so a scan
    that is run again gives the same. What stays need not be UTF-8: a cut may fall inside a character. Segments
    and windows that are equal as a whole are told by 128-bit digests; repeats themselves are compared
    byte by byte. Other columns are ignored; an empty table gives an empty one.
    """
    name = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.md5(name)).alias("row"))
    parts = stored(map_batches(docs.select("row", "text"), lambda: _cut(LENGTH, ANCHORS[0]), _SEGMENTS))
    found = _twice(parts.withColumn("times", F.lit(1).cast("long")), docs, LENGTH, hot, ANCHORS[1:])
    hits = stored(found.groupBy("row").agg(F.collect_set(F.struct("start", "spans")).alias("found")))
    forget(parts, found)
    return map_batches(docs.join(hits, "row", "left").select("doc_id", "text", "found"), lambda: _kept(LENGTH), _KEPT)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the strings of 400 bytes that occur twice."""
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
