"""Hard-negative mining by dual-tree search.

An anchor's positives are its best rows of the same label; its hard negatives are the best rows of other
labels whose score lies in a band below a positive's score. Rows are dealt into shards of bounded size,
each of one label unless the label is small. A shard's task builds a ball tree over its rows, and the
anchors that stream past it are grouped into ball trees of their own. The two trees are walked together:
from centres and radii follows an interval that holds every inner product of a pair of nodes, and the
pair is dropped as a whole when the interval lies below all that the group's anchors still look for, or
above their bands, or when the labels rule it out. Pairs of leaves that stay are scored exactly, in whole
numbers. A shard's lists of an anchor are merged with those of other shards in a tree of fixed fan-in.

How much is pruned depends on the vectors alone: tight groups leave few pairs of leaves, while for
directions spread evenly over many dimensions nearly every pair stays. Results are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stareflow.llm.common import joined, slices, small_batches, stored
from stareflow.llm.topk import products

#: Components that a shard holds at most, rows from which a shard is worth a task, and shards for each core.
SHARD_VALUES, SHARD_ROWS, SHARDS_A_CORE = 4 << 20, 4096, 2
#: Rows of a leaf: of the candidates' tree and of the anchors'.
LEAF, ANCHOR_LEAF = 256, 32
#: Lists merged into one at each level.
FAN_IN = 32

_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass(slots=True)
class Node:
    start: int
    end: int
    centre: np.ndarray
    norm: float
    radius: float
    label: int | None
    left: Node | None = None
    right: Node | None = None


def ball_tree(v: np.ndarray, labels: np.ndarray, leaf: int) -> tuple[np.ndarray, Node]:
    """(order, root): rows in an order in which each node is a stretch, down to leaves of leaf rows.

    A node of several labels is divided between labels; the others between two rows far from each other,
    each row to the nearer one, or in halves if that leaves one with few rows. Equal rows are divided
    too, so no leaf is larger.
    """
    x = v.astype(np.float64)
    order = np.argsort(labels, kind="stable")

    def node(start: int, end: int) -> Node:
        own = x[order[start:end]]
        centre = own.mean(axis=0)
        radius = float(np.sqrt(((own - centre) ** 2).sum(axis=1).max()))
        first, last = labels[order[start]], labels[order[end - 1]]
        return Node(start, end, centre, float(np.sqrt(centre @ centre)), radius * (1 + 1e-9), int(first) if first == last else None)

    root = node(0, len(v))
    todo = [root]
    while todo:
        n = todo.pop()
        if n.end - n.start <= leaf:
            continue
        part = order[n.start : n.end]
        if n.label is None:
            cuts = np.flatnonzero(np.diff(labels[part])) + 1
            middle = int(cuts[np.abs(cuts - len(part) // 2).argmin()])
        else:
            own = x[part]
            one = own[((own - n.centre) ** 2).sum(axis=1).argmax()]
            other = own[((own - one) ** 2).sum(axis=1).argmax()]
            along = own @ (other - one)
            middle = int((along < (one + other) @ (other - one) / 2).sum())
            if 10 * min(middle, len(part) - middle) < len(part):
                middle = len(part) // 2
            order[n.start : n.end] = part[np.argpartition(along, middle)]
        n.left, n.right = node(n.start, n.start + middle), node(n.start + middle, n.end)
        todo += [n.left, n.right]
    return order, root


def interval(a: Node, c: Node) -> tuple[float, float]:
    """The least and the most that an inner product of a row of a and a row of c can be."""
    middle = float(a.centre @ c.centre)
    reach = a.norm * c.radius + c.norm * a.radius + a.radius * c.radius
    reach += 1e-9 * (a.norm * c.norm + reach) + 1e-6
    return middle - reach, middle + reach


class Lists:
    """The k best (score, vec_id, row) of each slot, and the score below which nothing can enter."""

    def __init__(self, low: np.ndarray, k: int):
        self.k, self.cut = k, low.copy()
        self.score = np.full((len(low), k), _LEAST)
        self.vec = np.full((len(low), k), _MOST)
        self.row = np.full((len(low), k), -1)

    def add(self, slots: np.ndarray, score: np.ndarray, vec: np.ndarray, rows: np.ndarray) -> None:
        """score: (slots, rows); what may not enter has been set to the least number."""
        width = score.shape[1]
        if width > self.k:
            floor = np.maximum(self.cut[slots], np.partition(score, width - self.k, axis=1)[:, width - self.k])
        else:
            floor = self.cut[slots]
        at, col = np.nonzero((score >= floor[:, None]) & (score > _LEAST))
        if not len(at):
            return
        hit = np.unique(at)
        own = slots[hit]
        old = self.row[own] >= 0
        back = np.nonzero(old)
        group = np.concatenate([at, hit[back[0]]])
        s = np.concatenate([score[at, col], self.score[own][old]])
        i = np.concatenate([vec[col], self.vec[own][old]])
        r = np.concatenate([rows[col], self.row[own][old]])
        order = np.lexsort((r, i, ~s, group))
        group, s, i, r = group[order], s[order], i[order], r[order]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        keep = place < self.k
        to = slots[group[keep]], place[keep]
        self.score[to], self.vec[to], self.row[to] = s[keep], i[keep], r[keep]
        full = own[self.row[own, self.k - 1] >= 0]
        self.cut[full] = np.maximum(self.cut[full], self.score[full, self.k - 1])


@dataclass(slots=True)
class Rows:
    """Rows in the order of their tree; slots of anchor i: starts[i] to starts[i + 1], each with a band."""

    root: Node
    vec: np.ndarray
    row: np.ndarray
    label: np.ndarray
    v: np.ndarray
    starts: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def dual_search(anchors: Rows, rows: Rows, k: int, same: bool) -> tuple[Lists, int]:
    """The lists of the anchors' slots over rows of the same label, or of others, and how many pairs of
    leaves were scored."""
    lists, scored = Lists(anchors.low, k), 0
    owner = np.repeat(np.arange(len(anchors.row)), np.diff(anchors.starts))

    def useful(a: Node, c: Node) -> float | None:
        if a.label is not None and c.label is not None and (a.label == c.label) != same:
            return None
        least, most = interval(a, c)
        own = slice(anchors.starts[a.start], anchors.starts[a.end])
        if own.start == own.stop or most < lists.cut[own].min() or least > anchors.high[own].max():
            return None
        return most

    todo = [(anchors.root, rows.root)]
    while todo:
        a, c = todo.pop()
        if useful(a, c) is None:
            continue
        if a.left is None and c.left is None:
            scored += 1
            score = products(anchors.v[a.start : a.end], rows.v[c.start : c.end])
            fits = (anchors.label[a.start : a.end, None] == rows.label[None, c.start : c.end]) == same
            fits &= anchors.row[a.start : a.end, None] != rows.row[None, c.start : c.end]
            slots = np.arange(anchors.starts[a.start], anchors.starts[a.end])
            at = owner[slots] - a.start
            each = score[at]
            allowed = fits[at] & (each >= anchors.low[slots, None]) & (each <= anchors.high[slots, None])
            lists.add(slots, np.where(allowed, each, _LEAST), rows.vec[c.start : c.end], rows.row[c.start : c.end])
        elif a.left is None or c.left is not None and c.radius >= a.radius:
            nearer = sorted(((interval(a, child)[1], i, child) for i, child in enumerate((c.left, c.right))), key=lambda x: x[:2])
            todo += [(a, child) for *_, child in nearer]  # the more promising one is popped first
        else:
            todo += [(a.left, c), (a.right, c)]
    return lists, scored


def _columns(parts: list[pa.RecordBatch], leaf: int, bands: bool) -> Rows:
    table = pa.Table.from_batches(parts).combine_chunks()
    row, vec, label = (table[c].to_numpy() for c in ("row", "vec_id", "label"))
    flat = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    v = flat.reshape(len(row), -1)
    order, root = ball_tree(v, label, leaf)
    made = Rows(root, vec[order], row[order], label[order], v[order])
    if bands:
        low, high = table["low"].combine_chunks(), table["high"].combine_chunks()
        ends = low.offsets.to_numpy().astype(np.int64)
        n = np.diff(ends)[order]
        at = np.repeat(ends[:-1][order] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        made.starts = np.concatenate([[0], np.cumsum(n)])
        # ends count from the arrays' own start, which flatten() begins with
        made.low, made.high = (x.flatten().to_numpy()[at - ends[0]] for x in (low, high))
        made.low[made.low > made.high] = _MOST  # an empty band: nothing can enter
    return made


_LISTS = "q long, slot int, vec_id long, score long, row long, part long"


def _task(k: int, same: bool):
    """A function from a task's batches, each shard's rows before its anchors, to the shards' lists."""

    def found(shard: int, asks: Rows, rows: Rows) -> pa.RecordBatch:
        lists, _ = dual_search(asks, rows, k, same)
        owner = np.repeat(np.arange(len(asks.row)), np.diff(asks.starts))
        slot, place = np.nonzero(lists.row >= 0)
        number = slot - asks.starts[owner[slot]]
        cols = (asks.row[owner[slot]], number, lists.vec[slot, place], lists.score[slot, place], lists.row[slot, place], np.full(len(slot), shard))
        kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 4)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["q", "slot", "vec_id", "score", "row", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, rows = None, [], None
        for batch in batches:
            for part in slices(batch):
                head = np.stack([part.column(i).to_numpy() for i in range(2)])
                cuts = np.flatnonzero((head[:, 1:] != head[:, :-1]).any(axis=0)) + 1
                for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), part.num_rows], strict=True):
                    now, asks = head[:, s].tolist()
                    if now != shard:
                        shard, held, rows = now, [], None
                    if not asks:
                        held.append(part.slice(s, e - s))
                        continue
                    if held:
                        rows, held = _columns(held, LEAF, False), []
                    if rows is not None:
                        out = found(shard, _columns([part.slice(s, e - s)], ANCHOR_LEAF, True), rows)
                        if out.num_rows:
                            yield out
        pa.default_memory_pool().release_unused()

    return run


def _merged(lists: DataFrame, k: int, parts: int) -> DataFrame:
    """(q, slot, rank, vec_id, score, row): lists of FAN_IN parts merged at a time."""
    order = [F.desc("score"), F.col("vec_id"), F.col("row")]
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        lists = lists.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long"))
        w = Window.partitionBy("q", "slot", "part").orderBy(*order)
        lists = lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")
    w = Window.partitionBy("q", "slot").orderBy(*order)
    return lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("part")


def _layout(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows with shard, from_ and to (the shards of the row's label), pure (they hold no other label),
    first and last (the shards of the row's length), and how many shards there are.

    A label of more rows than a shard takes has shards of its own; all smaller ones share some. Shards
    are numbered from 0 without gaps: by a running sum over a row for each large label and length.
    """
    most = SHARDS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism
    sizes = stored(rows.groupBy("dim", "label").count())
    total = sizes.agg(F.sum("count")).first()[0] or 0
    room = F.greatest(F.lit(1), F.least(F.floor(F.lit(SHARD_VALUES) / F.greatest(F.col("dim"), F.lit(1))), F.lit(max(SHARD_ROWS, -(-total // most)))))
    sizes = sizes.withColumn("large", F.col("count") > room)
    own = sizes.where("large").select("dim", "label", F.ceil(F.col("count") / room).alias("n"))
    shared = sizes.where("not large").groupBy("dim").agg(F.sum("count").alias("count")).select("dim", F.lit(None).cast("long").alias("label"), F.ceil(F.col("count") / room).alias("n"))
    before = Window.orderBy("dim", F.asc_nulls_last("label")).rowsBetween(Window.unboundedPreceding, -1)
    units = stored(own.unionByName(shared).withColumn("from_", F.coalesce(F.sum("n").over(before), F.lit(0))))
    shards = units.agg(F.sum("n")).first()[0] or 0
    name = F.concat_ws(":", "dim", "label")
    large = units.where(F.col("label").isNotNull()).select(name.alias("key"), F.col("from_").alias("own_from"), F.col("n").alias("own_n"))
    small = units.where(F.col("label").isNull()).select(F.col("dim").cast("string").alias("length"), F.col("from_").alias("shared_from"), F.col("n").alias("shared_n"))
    lengths = units.groupBy("dim").agg(F.min("from_").alias("first"), F.max(F.col("from_") + F.col("n") - 1).alias("last")).select(F.col("dim").cast("string").alias("length"), "first", "last")
    found = joined(rows.withColumn("key", name).withColumn("length", F.col("dim").cast("string")), large, "key", 48, "left")
    found = joined(found, small, "length", 48, "left", ready=False)
    found = joined(found, lengths, "length", 48, "inner", ready=False)
    pure = F.col("own_n").isNotNull()
    inside = F.col("shared_from") + F.pmod(F.xxhash64("label"), F.col("shared_n"))
    shard = F.when(pure, F.col("own_from") + F.pmod(F.xxhash64("row"), F.col("own_n"))).otherwise(inside)
    found = found.withColumn("shard", shard.cast("int"))
    ends = {"from_": F.coalesce("own_from", "shard"), "to": F.when(pure, F.col("own_from") + F.col("own_n") - 1).otherwise(F.col("shard"))}
    out = found.withColumns({c: x.cast("int") for c, x in ends.items()} | {"pure": pure} | {c: F.col(c).cast("int") for c in ("first", "last")})
    return out.select("row", "vec_id", "label", "dim", "v", "asks", "shard", "from_", "to", "pure", "first", "last"), int(shards)


def _searched(placed: DataFrame, anchors: DataFrame, shards: int, k: int, same: bool) -> DataFrame:
    """The merged lists of anchors(shard: array of shards to search, row, vec_id, label, v, low, high)."""
    none = F.lit(None).cast("array<long>")
    cols = ["shard", "kind", "row", "vec_id", "label", "v", "low", "high"]
    rows = placed.withColumns({"kind": F.lit(0), "low": none, "high": none}).select(*cols)
    asks = anchors.withColumns({"shard": F.explode("shard"), "kind": F.lit(1)}).select(*cols)
    dealt = rows.unionByName(asks).repartitionById(max(1, shards), F.col("shard")).sortWithinPartitions("shard", "kind", "label")
    small_batches(placed.sparkSession)
    return _merged(dealt.mapInArrow(_task(k, same), _LISTS), k, shards)


def hard_negatives(vectors: DataFrame, asks: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of
    vectors(vec_id, label, v), v an array of whole numbers, for the rows where asks holds.

    An anchor's positives are its first positives other rows of its label, by score, ties to the
    smaller vec_id. For each, the first negatives rows of other labels follow whose score is at least
    low and at most high hundredths of the positive's. Only rows of the anchor's length are compared.
    Rows that repeat a vec_id are rows of their own, as anchors too. Null labels, vec_ids and vectors
    take no part. Scores that 64 bits can't hold are the nearest that they can. Other columns are
    ignored; an empty table, or anchors without positives, give no rows.
    """
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    ids = [F.col(c).cast("long").alias(c) for c in ("vec_id", "label")]
    rows = stored(vectors.where(fine).select(*ids, "v", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("row"), F.coalesce(asks, F.lit(False)).alias("asks")))
    top = rows.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()[0] or 0.0
    placed, shards = _layout(rows)
    narrow = "smallint" if top < 2**15 else "int" if top < 2**31 else "long"
    placed = stored(placed.withColumn("v", F.col("v").cast(f"array<{narrow}>")))
    anchors = placed.where("asks")
    every = {"shard": F.sequence("from_", "to"), "low": F.array(F.lit(int(_LEAST) + 1)), "high": F.array(F.lit(int(_MOST)))}
    best = _searched(placed, anchors.withColumns(every), shards, positives, True)
    each = F.struct("rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    best = best.groupBy(F.col("q").alias("row")).agg(F.sort_array(F.collect_list(each)).alias("positives"))

    def band(hundredths: int, up: bool) -> Column:
        def of(p: Column) -> Column:
            s = p["positive_score"]
            rest = F.pmod(s, F.lit(100))
            more = F.call_function("div", rest * hundredths + (99 if up else 0), F.lit(100))
            return F.call_function("div", s - rest, F.lit(100)) * hundredths + more

        return F.transform("positives", of)

    found = stored(anchors.join(best, "row"))
    before = F.when(F.col("from_") > F.col("first"), F.sequence("first", F.col("from_") - 1)).otherwise(F.array().cast("array<int>"))
    after = F.when(F.col("to") < F.col("last"), F.sequence(F.col("to") + 1, "last")).otherwise(F.array().cast("array<int>"))
    others = F.when(F.col("pure"), F.concat(before, after)).otherwise(F.sequence("first", "last"))
    worse = _searched(placed, found.withColumns({"shard": others, "low": band(low, True), "high": band(high, False)}), shards, negatives, False)
    worse = worse.select(F.col("q").alias("row"), "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    slots = found.select("row", F.col("vec_id").alias("anchor_id"), F.posexplode("positives").alias("slot", "p"))
    out = slots.join(worse, ["row", "slot"])
    return out.select("anchor_id", "p.positive_id", "rank", "negative_id", "p.positive_score", "negative_score")


def labelled(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v) with v: floor(scale * x) of each component as long; rows without label, vec_id
    or vector, or with a null component or one that is not finite, are left out."""
    x = F.col("embedding").cast("array<double>")
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(c * scale).cast("long"))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose vec_id is divisible by 100 against all others; every seventh label is moved on by one."""
    rows = labelled(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    moved = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.pmod("vec_id", F.lit(100)) == 0)


OP12_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row_no, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT a.row_no AS a, a.vec_id AS anchor_id, c.row_no AS c, c.vec_id, a.label = c.label AS same,
    CAST(coalesce(list_sum(list_transform(list_zip(a.e, c.e), lambda p: CAST(p[1] AS HUGEINT) * p[2])), 0) AS HUGEINT) AS score
  FROM v a JOIN v c ON a.row_no <> c.row_no AND len(a.e) = len(c.e) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.a, p.c, p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.a, p.c ORDER BY s.score DESC, s.vec_id) AS rk
  FROM p JOIN s ON s.a = p.a AND NOT s.same WHERE 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, CAST(rk AS INTEGER) AS rank, negative_id, CAST(positive_score AS BIGINT) AS positive_score, CAST(negative_score AS BIGINT) AS negative_score
FROM n WHERE rk <= 10
"""
