"""N-gram Jaccard join: a size-aware heavy-light similarity join on word shingles.

Two documents link when the Jaccard similarity of their shingle sets reaches a threshold. The
join is exact: every linked pair of different sets is found as a candidate and then checked on
the whole sets. Steps:

1. Equal sets are one class, named by a 64-bit digest of the set. (Two different sets share a
   digest with probability 2**-64 a pair; that is the only inexact part.)
2. Sets up to a boundary size are *light*: they enumerate all subsets of two shingles of their
   prefix, and two light sets are candidates when they share a subset. Larger sets are *heavy*:
   they enter the inverted lists of their prefix shingles, and the lists are scanned. Prefixes
   follow one global order, rare shingles first, so that a linked pair must meet. The boundary
   has the least cost, in rows made and scanned, over the corpus's own sizes.
3. Long lists, by their counted length, are never expanded into pairs. Links between a few representatives join most of a
   large group of near copies first; what long lists then leave open is compared in blocks, all
   but a cluster's largest component against the whole cluster.
4. A parity bitmap of each set bounds the symmetric difference from below and drops pairs that
   cannot link; the rest are checked shingle by shingle.

The rarity order comes from a count table over all shingles of all documents; it only orders shingles
and tells which lists are dealt to several tasks, so its collisions cost time and never a link. Its size
follows the number of documents up to a bound.

Joins whose key may hold a large part of all rows (one set's copies, a star's centre, a long list, a
cluster) go through joined(), which shuffles no such key.
"""

from __future__ import annotations

from math import comb, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stareflow.llm.common import SLICE_BYTES, bounded, fits, forget, joined, map_batches, slices, small_batches, stored, utf8
from stareflow.llm.graph import components

WORDS = 5
#: Threshold as a whole percentage.
PERCENT = 75
#: log2 of the counters in the table that orders shingles by rarity (4 bytes each): as many as there are
#: documents, within these bounds.
SKETCH_BITS, SKETCH_MOST = 20, 24
#: Sets from which a list is long.
LONG = 256
#: Counter chunks that one task adds up.
FAN_IN = 64
#: Counters in a chunk of the table.
CHUNK = 1 << 14
#: Pairs of one set that a task checks against it, about.
GROUP = 256
#: Digests that a task remembers, so as not to hand a set on again.
DIGESTS_KEPT = 500_000
#: Largest boundary that is considered between light and heavy sets.
MOST_LIGHT = 64
#: Shingles and sets that a block of a long list's cluster holds, about.
BLOCK_SHINGLES, BLOCK_SETS = 32_768, 512
#: Shingles of two blocks that are multiplied at once.
TILE = 4096
#: Min-hash keys that join most of a group of near copies: so many keys of two minima each.
BANDS = 4

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_STEP = np.uint64(0x9FB21C651E98DF25)


class _WordHashes(dict):
    """A word's 64-bit hash; forgets all when it holds too many words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD[1]
    h = (h ^ (h >> np.uint64(29))) * _ODD[3]
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None, hashes: dict[bytes, int], k: int = WORDS) -> np.ndarray:
    """The text's distinct k-word shingles as sorted 64-bit hashes.

    A-Z count as a-z. With fewer than k words the whole sequence is the one shingle; without
    words, or without text, the set is empty.
    """
    words = utf8(text).lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(k, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = h * _STEP + w[i : len(w) - n + 1 + i]
    return np.unique(_mixed(h))


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """The fewest shingles that a set of n shares with any set it links with."""
    return -(-n * percent // 100)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - least_overlap(n, percent) + 1


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets reach the threshold, in whole numbers."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum()) if len(b) else 0
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def parity_bitmap(h: np.ndarray) -> bytes:
    """Bit i: whether an odd number of shingles has i as its low bits; two bits or more a shingle."""
    width = max(64, 1 << int(2 * len(h) - 1).bit_length())
    odd = np.bincount((h & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def difference_at_least(a: bytes, b: bytes) -> int:
    """A lower bound of the size of the symmetric difference of the sets of two bitmaps."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    if len(y) > len(x):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _packed(counts: np.ndarray) -> bytes:
    """The counters in as few bytes each as the largest needs."""
    return counts.astype(np.min_scalar_type(int(counts.max()))).tobytes()


def _counters(packed: bytes, bits: int) -> np.ndarray:
    """The counters of a chunk of _packed()."""
    width = len(packed) // min(CHUNK, 1 << bits)
    return np.frombuffer(packed, f"u{width}")


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """docs as (doc_id, mark, text): mark, a digest of the text, tells rows apart that share an id."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")


def _profiles(docs: DataFrame, k: int, bits: int) -> DataFrame:
    """For each row of keyed() its set's size, digest, bitmap and min-hash keys (kind 0), and for each
    task the counts of its shingles by bucket, in chunks (kind 1; doc_id is the task's number)."""

    def run(batches):
        from pyspark import TaskContext

        hashes, counts = _WordHashes(), np.zeros(1 << bits, np.uint32)
        schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("bits", pa.binary()), ("bands", pa.list_(pa.int64()))])
        for batch in (part for whole in batches for part in slices(whole)):
            ids = batch.column(0).to_pylist()
            n, sid, bitmaps, bands, seen = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                h = shingle_set(text, hashes, k)
                n.append(len(h))
                if not len(h):
                    sid.append(None), bitmaps.append(None), bands.append(None)
                    continue
                seen.append(h >> np.uint64(64 - bits))
                sid.append(xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63))
                bitmaps.append(parity_bitmap(h))
                low = np.array([_mixed(h * m).min() for m in _ODD[: 2 * BANDS]])
                bands.append(_signed(_mixed(low[::2] * _STEP + low[1::2] + np.arange(BANDS, dtype=np.uint64))).tolist())
            if seen:
                np.add.at(counts, np.concatenate(seen).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(ids), pa.int32()), pa.array(ids, pa.int64()), batch.column(1), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(bitmaps, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=schema)
        parts = [c for c in range(0, len(counts), CHUNK) if counts[c : c + CHUNK].any()]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([1] * len(parts), pa.int32()), pa.array([TaskContext.get().partitionId()] * len(parts), pa.int64()), pa.nulls(len(parts), pa.int64()), pa.array(parts, pa.int64()), pa.nulls(len(parts), pa.int64()), pa.array([_packed(counts[c : c + CHUNK]) for c in parts], pa.binary()), pa.nulls(len(parts), pa.list_(pa.int64()))], schema=schema)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, "kind int, doc_id long, mark long, n long, sid long, bits binary, bands array<long>")


def _rarity(profiles: DataFrame, bits: int) -> np.ndarray:
    """Occurrences of shingles by bucket over the whole corpus; tasks' counts are added in a tree."""

    def total(pdf):
        out = pdf.iloc[:1].copy()
        parts = [_counters(x, bits) for x in pdf["bits"]]
        out["bits"] = [_packed(np.minimum(np.sum([p.astype(np.uint64) for p in parts], axis=0), 0xFFFFFFFF))]
        return out

    sums = profiles.where("kind = 1").select("n", F.col("doc_id").alias("part"), "bits")
    parts = (sums.agg(F.max("part").alias("most")).first().most or 0) + 1
    while parts > 1:
        parts = -(-parts // FAN_IN)
        sums = sums.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long"))
        sums = sums.groupBy("n", "part").applyInPandas(lambda p: total(p[["n", "part", "bits"]]), "n long, part long, bits binary")
    counts = np.zeros(1 << bits, np.uint32)
    for row in sums.toLocalIterator():  # 2 ** bits counters, whatever the corpus
        part = _counters(row.bits, bits)
        counts[row.n : row.n + len(part)] = part
    return counts


def choose_boundary(sizes: dict[int, int], counts: np.ndarray, percent: int = PERCENT) -> int:
    """The largest light size of least cost: subsets made against list rows made and scanned.

    sizes: how many sets have a size, up to MOST_LIGHT. A row of a list costs one to make and as
    much again for each other set that a list of ordinary length is expected to hold.
    """
    c = counts[counts > 0].astype(np.float64)
    if not len(c):
        return 0
    c = c[c <= _long_list(counts)]
    scan = 1 + max(0.0, float((c * c).sum() / max(c.sum(), 1) - c.mean() - 1))

    def cost(b: int) -> float:
        light = sum(m * comb(prefix_length(n, percent) + 1, 2) for n, m in sizes.items() if 1 < n <= b)
        return light + sum(m * prefix_length(n, percent) * scan for n, m in sizes.items() if 100 * n > percent * b)

    return min(range(MOST_LIGHT + 1), key=lambda b: (cost(b), b))


def _long_list(counts: np.ndarray) -> float:
    """The counter from which a list is dealt to several tasks: well above what chance puts in a bucket."""
    return 4 * float(counts.mean()) + 64


def _entries(docs: DataFrame, counts: np.ndarray, boundary: int, k: int, percent: int, bits: int) -> DataFrame:
    """(key, sid, n, pos, hot): list entries and subsets; salt deals long lists to many tasks."""
    table, hot_from = docs.sparkSession.sparkContext.broadcast(counts), _long_list(counts)

    def start():
        hashes, count, done = _WordHashes(), table.value, set()

        def step(batch: pa.RecordBatch):
            keys, sids, ns, poss, hots = [], [], [], [], []
            for text in batch.column(0).to_pylist():
                h = shingle_set(text, hashes, k)
                n = len(h)
                if n < 2:
                    continue  # such a set links only with its equals
                sid = xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63)
                if sid in done:
                    continue
                if len(done) >= DIGESTS_KEPT:
                    done.clear()  # a set that is handed on twice counts once later
                done.add(sid)
                c = count[(h >> np.uint64(64 - bits)).astype(np.int64)]
                p = prefix_length(n, percent)
                order = np.lexsort((h, c))[: p + 1]
                h, c = h[order], c[order].astype(np.float64)
                if 100 * n > percent * boundary:
                    keys.append(h[:p]), poss.append(np.arange(p)), hots.append(c[:p] > hot_from)
                if n <= boundary:
                    i, j = np.triu_indices(len(h), 1)
                    keys.append(_mixed(h[i] * _STEP + h[j])), poss.append(-1 - j), hots.append(np.minimum(c[i], c[j]) > hot_from)
                for x in keys[len(sids) :]:
                    sids.append(np.full(len(x), sid)), ns.append(np.full(len(x), n))
            if not keys:
                return None
            cols = [_signed(np.concatenate(keys)), np.concatenate(sids), np.concatenate(ns).astype(np.int32), np.concatenate(poss).astype(np.int32), np.concatenate(hots)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["key", "sid", "n", "pos", "hot"])

        return step

    return map_batches(docs.select("text"), start, "key long, sid long, n int, pos int, hot boolean")


def _may_link(n, m, i, j, percent: int):
    """Whether sizes n, m and positions i, j of the first shared shingle leave enough to share.

    A subset's position is that of its second shingle p, given as -p - 1: of the subsets that two
    sets share there is one that holds the first two shingles that they share.
    """
    need = -(-percent * (n + m) // (100 + percent))
    room = np.where(i < 0, 2 + np.minimum(n + i, m + j), 1 + np.minimum(n - i - 1, m - j - 1))
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (room >= need)


def _scan(entries: DataFrame, boundary: int, percent: int) -> DataFrame:
    """Scans the lists: pairs (a, b) of the ordinary ones; entries of long ones pass unchanged.

    A list is long if its entries were dealt to several tasks, or if the task counts more than LONG of
    them; a task holds no more of one list than that."""

    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])
        rest, passing = None, None  # the list that goes on in the next batch, and the long one that is passing

        def long_ones(x):
            m = len(x[0])
            return pa.RecordBatch.from_arrays([pa.array(x[1]), pa.nulls(m, pa.int64()), pa.array(x[0]), pa.array(x[2].astype(np.int32)), pa.array(x[3].astype(np.int32))], schema=schema)

        def pairs(key, sid, n, pos):
            left, right = [], []
            for d in range(1, LONG + 1):
                at = np.flatnonzero(key[d:] == key[:-d])
                if not len(at):
                    break
                left.append(at), right.append(at + d)
            if not left:
                return None
            x, y = np.concatenate(left), np.concatenate(right)
            ok = (sid[x] != sid[y]) & ((pos[x] < 0) == (pos[y] < 0)) & _may_link(n[x], n[y], pos[x], pos[y], percent)
            ok &= (pos[x] < 0) | (np.maximum(n[x], n[y]) > boundary)
            x, y = x[ok], y[ok]
            a, b = np.minimum(sid[x], sid[y]), np.maximum(sid[x], sid[y])
            both = np.unique(np.stack([a, b]), axis=1)
            m = both.shape[1]
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32())], schema=schema) if m else None

        for batch in batches:
            key, sid, n, pos, hot = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            n, pos = n.astype(np.int64), pos.astype(np.int64)
            now = [x[~hot] for x in (key, sid, n, pos)]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            cut = np.flatnonzero(np.diff(now[0])) + 1
            size = np.diff(np.r_[0, cut, len(now[0])])
            far = np.repeat(size > LONG, size) if len(now[0]) else np.zeros(0, bool)
            if passing is not None:
                far |= now[0] == passing
            passed = [np.concatenate([x[hot], y[far]]) for x, y in zip((key, sid, n, pos), now, strict=True)]
            if len(passed[0]):
                yield long_ones(passed)
            if len(far) and far[-1]:
                passing = now[0][-1]
            now = [x[~far] for x in now]
            if not len(now[0]):
                rest = None
                continue
            end = int(np.searchsorted(now[0], now[0][-1]))  # the last list may go on in the next batch
            rest = [x[end:] for x in now]
            if end and (out := pairs(*(x[:end] for x in now))):
                yield out
        if rest is not None and len(rest[0]) and (out := pairs(*rest)):
            yield out

    salt = F.when(F.col("hot"), F.pmod(F.col("sid"), F.lit(1 << 20))).otherwise(F.lit(0))
    dealt = entries.repartition("key", salt).sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a long, b long, key long, n int, pos int")


def _not_joined(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs whose two sets are in different components."""
    a, b = comps.toDF("a", "ca"), comps.toDF("b", "cb")
    pairs = stored(pairs)
    far = joined(joined(pairs, a, "a", 40, "left"), b, "b", 40, "left", ready=False)
    return far.where(~F.coalesce("ca", "a").eqNullSafe(F.coalesce("cb", "b"))).select("a", "b")


def _long_links(hot: DataFrame, comps: DataFrame, docs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Links of long lists between different components.

    Lists whose sets are all in one component are closed. The sets of open lists that share sets
    form a cluster; a cluster is dealt into blocks of bounded size by size class, the largest
    component apart, and two blocks are compared by one matrix product where sizes allow a link and
    not both are of that component. A pair of blocks gives at most one row for each of its sets.
    """
    labels = comps.toDF("sid", "comp")
    own = stored(joined(hot, labels, "sid", 40, "left").withColumn("comp", F.coalesce("comp", "sid")))
    kinds = own.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    open_ = stored(joined(own, kinds, "key", 24).select("key", "sid", "comp"))
    forget(own)
    if not open_.limit(1).count():
        return open_.select(F.col("sid").alias("a"), F.col("key").alias("b"))
    clusters = components(open_.select(F.col("sid").alias("a"), F.col("key").alias("b"))).toDF("sid", "cluster")
    members = stored(open_.select("sid", "comp").distinct().join(clusters, "sid").join(sets.select("sid", "n"), "sid"))
    main = members.groupBy("cluster", "comp").count().groupBy("cluster").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"))
    kind = [F.col("cluster"), (F.col("comp") == F.col("main")).alias("is_main"), F.floor(F.log("n") / float(np.log(100 / percent))).cast("int").alias("size")]
    members = joined(members, main, "cluster", 40).select("sid", "comp", "n", *kind)
    members = stored(members.withColumn("slot", F.xxhash64("cluster", "is_main", "size")))
    parts = members.groupBy("slot").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_SETS)).alias("parts"))
    dealt = joined(members, parts, "slot", 40).withColumn("part", F.pmod(F.xxhash64("sid"), "parts"))
    block = F.xxhash64("cluster", "is_main", "size", "part").alias("block")
    dealt = stored(dealt.select("sid", "comp", "cluster", "is_main", "size", block))
    blocks = dealt.select("cluster", "is_main", "size", "block").distinct()
    pairs = blocks.toDF("cluster", "m1", "s1", "left").join(blocks.toDF("cluster", "m2", "s2", "right"), "cluster")
    pairs = pairs.where("left <= right AND NOT (m1 AND m2) AND abs(s1 - s2) <= 1").select("left", "right")
    whole = dealt.join(_sets_of(dealt.select("sid"), docs, sets, k), "sid").groupBy("block").agg(F.collect_list(F.struct("sid", "comp", "h")).alias("x"))
    whole = stored(whole)

    def start():
        def step(batch: pa.RecordBatch):
            a, b = [], []
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                for p, q in _block_links(x.as_py(), y.as_py(), percent):
                    a.append(p), b.append(q)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        return step

    both = pairs.join(whole.toDF("left", "x"), "left").join(whole.toDF("right", "y"), "right").select("x", "y")
    return map_batches(both, start, "a long, b long")


def _block_links(x: list[dict], y: list[dict], percent: int) -> list[tuple[int, int]]:
    """Pairs of sids that connect all sets of the blocks x and y that links between them connect."""
    sets = [np.frombuffer(r["h"], np.uint64) for r in (*x, *y)]
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    shingles, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    hit = times[at] > 1
    rows = np.repeat(np.arange(len(sets)), size)[hit]
    cols = shared[at[hit]]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    both = np.zeros((len(x), len(y)), np.int64)
    for low in range(0, int(cols[-1]) + 1 if len(cols) else 0, TILE):  # the product, a tile of shingles at a time
        here = slice(*np.searchsorted(cols, [low, low + TILE]))
        mat = np.zeros((len(sets), TILE), np.float32)
        mat[rows[here], cols[here] - low] = 1
        both += np.rint(mat[: len(x)] @ mat[len(x) :].T).astype(np.int64)
    comp = np.array([r["comp"] for r in (*x, *y)])
    link = (both > 0) & (100 * both >= percent * (size[: len(x), None] + size[None, len(x) :] - both)) & (comp[: len(x), None] != comp[None, len(x) :])
    if not link.any():
        return []
    label, n = np.arange(len(sets)), len(x)
    while True:  # the smallest label among what is linked, until none changes
        low = np.where(link, label[None, n:], len(sets))
        new = np.minimum(label[:n], low.min(axis=1))
        right = np.minimum(label[n:], np.where(link, new[:, None], len(sets)).min(axis=0))
        new = np.concatenate([new, right])
        if (new == label).all():
            break
        label = new
    sid = [r["sid"] for r in (*x, *y)]
    return [(sid[i], sid[j]) for i, j in enumerate(label.tolist()) if i != j and sid[i] != sid[j]]


def _plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that sizes and bitmaps do not rule out."""
    pairs = stored(pairs)
    named = stored(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct())
    own = stored(sets.select("sid", "n", "bits").join(bounded(named, 24), "sid"))
    a, b = own.toDF("a", "na", "xa"), own.toDF("b", "nb", "xb")

    def start():
        def step(batch: pa.RecordBatch):
            na, nb = (batch.column(i).to_numpy() for i in (2, 4))
            xa, xb = batch.column(3).to_pylist(), batch.column(5).to_pylist()
            need = -(-percent * (na + nb) // (100 + percent))
            most = na + nb - 2 * need
            ok = np.fromiter((difference_at_least(x, y) <= m for x, y, m in zip(xa, xb, most, strict=True)), bool, len(na))
            ok &= 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
            keep = pa.array(ok)
            return pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

        return step

    width = 60 + int(own.agg(F.avg(F.length("bits"))).first()[0] or 0)
    both = joined(joined(pairs, a, "a", width), b, "b", width, ready=False)
    return map_batches(both.select("a", "b", "na", "xa", "nb", "xb"), start, "a long, b long")


def _sets_of(sids: DataFrame, docs: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """(sid, h): the whole sets of the sids, made again from the documents that name them."""
    wanted = sids.distinct().join(sets.select("sid", "at"), "sid").select(F.col("at.doc_id").alias("wanted"), F.col("at.mark").alias("said")).distinct()
    wanted = bounded(stored(wanted), 40)

    def start():
        hashes = _WordHashes()

        def step(batch: pa.RecordBatch):
            got = [shingle_set(t, hashes, k) for t in batch.column(0).to_pylist()]
            sid = [xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63) for h in got]
            return pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), pa.array([h.tobytes() for h in got], pa.binary())], names=["sid", "h"])

        return step

    texts = docs.join(wanted, (F.col("mark") == F.col("said")) & F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi").select("text")
    return stored(map_batches(texts, start, "sid long, h binary").groupBy("sid").agg(F.first("h").alias("h")))


def _checked(pairs: DataFrame, docs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs whose whole sets reach the threshold."""
    pairs = stored(pairs)
    named = stored(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct())
    size = sets.select("sid", "n").join(bounded(named, 24), "sid").agg(F.count("*").alias("rows"), F.avg("n").alias("n")).first()
    width = 60 + 8 * int(size.n or 0)
    if not fits(size.rows, width):
        return _checked_apart(pairs, docs, sets, k, percent)
    found = _sets_of(named, docs, sets, k)

    def compare():
        def step(batch: pa.RecordBatch):
            ha, hb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = pa.array([linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(ha, hb, strict=True)], pa.bool_())
            return pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

        return step

    both = joined(joined(pairs, found.toDF("a", "ha"), "a", width), found.toDF("b", "hb"), "b", width, ready=False).select("a", "b", "ha", "hb")
    return map_batches(both, compare, "a long, b long")


def _checked_apart(pairs: DataFrame, docs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """_checked() for sets too many to broadcast: a whole set travels once for each of its pairs and is
    written nowhere.

    The pairs of a set a are dealt into parts of about GROUP; a part receives a's set, then the others
    one by one.
    """
    many = stored(pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("parts")).where("parts > 1"))
    part = F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("part")
    dealt = stored(joined(pairs, many, "a", 40, "left").select("a", "b", part))
    to = dealt.select("a", "part", F.col("b").alias("sid")).union(dealt.select("a", "part", F.col("a").alias("sid")).distinct())
    at = sets.select("sid", F.col("at.doc_id").alias("wanted"), F.col("at.mark").alias("said"))
    wanted = stored(to.groupBy("sid").agg(F.collect_list(F.struct("a", "part")).alias("to")).join(at, "sid").drop("sid"))
    width = 60 + 24 * int(wanted.agg(F.avg(F.size("to"))).first()[0] or 0)
    texts = docs.join(bounded(wanted, width), (F.col("mark") == F.col("said")) & F.col("doc_id").eqNullSafe(F.col("wanted"))).select("text", "to")

    def made(batches):
        hashes, rows, held = _WordHashes(), [], 0
        schema = pa.schema([("a", pa.int64()), ("part", pa.int64()), ("sid", pa.int64()), ("h", pa.binary())])

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in (part for whole in batches for part in slices(whole)):
            for text, targets in zip(batch.column(0), batch.column(1), strict=True):
                h = shingle_set(text.as_py(), hashes, k).tobytes()
                sid = xxhash.xxh3_64_intdigest(h) - (1 << 63)
                for t in targets.as_py():
                    rows.append((t["a"], t["part"], sid, h))
                    held += len(h) + 24
                    if held >= SLICE_BYTES:
                        yield out()
                        rows, held = [], 0
        if rows:
            yield out()

    def compare(batches):
        here, first, last = None, None, None  # the part, its first set, and the set seen last in it
        for batch in (part for whole in batches for part in slices(whole)):
            left, right = [], []
            for a, part, sid, h in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                if (a, part) != here:
                    here, first = (a, part), np.frombuffer(h.as_py(), np.uint64)
                elif sid != last and linked(first, np.frombuffer(h.as_py(), np.uint64), percent):  # rows that repeat give a set again
                    left.append(a), right.append(sid)
                last = sid
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    small_batches(docs.sparkSession)
    whole = texts.mapInArrow(made, "a long, part long, sid long, h binary").repartition("a", "part")
    return whole.sortWithinPartitions("a", "part", F.col("a") != F.col("sid"), "sid").mapInArrow(compare, "a long, b long")


def _with(comps: DataFrame, more: DataFrame) -> DataFrame:
    """The components with further links, if there are any."""
    if not more.limit(1).count():
        return comps
    return components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(more))


def classes(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, bits: int | None = None) -> DataFrame:
    """(doc_id, mark, n_shingles, comp, component_id) for each row of docs(doc_id, text): comp names the
    class of linked sets that the row's set is in, null for an empty set; component_id is the smallest
    doc_id of the class, the row's own for an empty set."""
    docs = keyed(docs)
    bits = bits or min(SKETCH_MOST, max(SKETCH_BITS, round(log2(docs.count() + 1))))
    profiles = stored(_profiles(docs, k, bits))
    own = profiles.where("kind = 0")
    at = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("at")
    sets = stored(own.where("n > 0").groupBy("sid").agg(at, F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("bits").alias("bits")))
    rows = stored(own.select("doc_id", "mark", F.col("n").alias("n_shingles"), "sid"))
    counts = _rarity(profiles, bits)
    sizes = {r.n: r["count"] for r in sets.where(f"n <= {MOST_LIGHT}").groupBy("n").count().collect()}
    boundary = choose_boundary(sizes, counts, percent)

    keys = stored(own.where("n > 1").select("sid", F.explode("bands").alias("band")).distinct())
    forget(profiles)
    first = stored(keys.groupBy("band").agg(F.min("sid").alias("a"), F.max("sid").alias("z")).where("a <> z").select("band", "a"))
    stars = joined(keys, first, "band", 40).where("a <> sid").select("a", F.col("sid").alias("b")).distinct()
    near = stored(_checked(_plausible(stars, sets, percent), docs, sets, k, percent))
    comps = components(near)
    forget(keys, first, near)

    scanned = stored(_scan(_entries(docs, counts, boundary, k, percent, bits), boundary, percent))
    ordinary = scanned.where("key IS NULL").select("a", "b").distinct()
    hot = stored(scanned.where("key IS NOT NULL").select(F.col("a").alias("sid"), "key", "n", "pos").distinct())
    more = stored(_checked(_plausible(_not_joined(ordinary, comps), sets, percent), docs, sets, k, percent))
    forget(scanned)
    comps = _with(comps, more)
    more = stored(_long_links(hot, comps, docs, sets, k, percent))
    comps = _with(comps, more)
    ids = sets.select(F.col("sid").alias("node"), "doc_id").join(comps, "node", "left").select(F.col("node").alias("sid"), F.coalesce("comp", "node").alias("comp"), "doc_id")
    ids = stored(ids)
    forget(sets, hot)
    least = ids.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = stored(joined(ids.select("sid", "comp"), least, "comp", 40))
    forget(ids)
    out = joined(rows, named, "sid", 56, "left")
    return out.select("doc_id", "mark", "n_shingles", "comp", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def ngram_join(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, bits: int | None = None) -> DataFrame:
    """One row for each row of docs(doc_id, text): (doc_id, n_shingles, component_id).

    component_id is the smallest doc_id that links reach, the row's own included. A null text or
    one without words has an empty set and links with nothing. Equal texts, and rows that repeat a
    doc_id, are linked through their equal sets. A row with a null doc_id keeps it; its component
    is named by the others, or null if there is none. Other columns are ignored; an empty table
    gives an empty one. Very long texts are taken whole.
    """
    return classes(docs, k, percent, bits).select("doc_id", "n_shingles", "component_id")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join over all documents: doc_id, n_shingles, component_id."""
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without near duplicates: of each group of linked ones the one of the smallest doc_id,
    ids before none, ties by the text.

    Rows are told apart by doc_id and text together, so rows that share an id but not the text are
    documents of their own, and copies without an id count as copies. Of rows alike in both one stays.
    Null, empty and wordless texts link with nothing and all stay. An empty table gives an empty one;
    all columns are kept as they are.
    """
    rows = stored(classes(docs).where("comp IS NOT NULL").groupBy("comp", "doc_id", "mark").agg(F.count("*").alias("rows")))
    none = F.col("doc_id").isNull().alias("none")
    first = rows.groupBy("comp").agg(F.min(F.struct(none, "doc_id", "mark")).alias("first"))
    marked = joined(rows, first, "comp", 64)
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))
    marked = stored(marked.select(F.col("doc_id").alias("__sf_doc"), F.col("mark").alias("__sf_said"), stays.alias("__sf_stays"), "rows"))
    own = docs.withColumns({"__sf_id": F.col("doc_id").cast("long"), "__sf_mark": F.xxhash64("text")})
    same = F.col("__sf_id").eqNullSafe(F.col("__sf_doc")) & (F.col("__sf_mark") == F.col("__sf_said"))
    again = bounded(stored(marked.where("__sf_stays AND rows > 1").select("__sf_doc", "__sf_said")), 40)
    out = bounded(stored(marked.where("NOT __sf_stays OR rows > 1").select("__sf_doc", "__sf_said")), 40)
    kept = own.join(out, same, "left_anti").select(*docs.columns)
    whole = F.struct(*docs.columns)
    one = own.join(again, same, "left_semi").groupBy("__sf_id", "__sf_mark").agg(F.min_by(whole, F.to_json(whole)).alias("one"))
    return kept.unionByName(one.select("one.*"))
