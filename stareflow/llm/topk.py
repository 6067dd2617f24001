"""Exact top-k search by tiled matrix products.

The vectors are dealt into shards of bounded size. Each shard's task holds its vectors as tiles, and the
queries stream past it in batches: a batch is multiplied with a tile at a time, a partial selection
keeps each query's best of the tile, and the tiles' lists are merged. The shards' lists of a query are
merged in a tree of fixed fan-in. Queries are rows of a table and go to the shards by a shuffle: nothing
but counts reaches the driver, and the plan does not grow with the queries. Scores are whole numbers and
exact, and ties go to the smaller vec_id, so results depend on nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stareflow.llm.common import bounded, small_batches, stored

#: Components that a shard holds at most: 32 MB.
SHARD_VALUES = 4 << 20
#: Rows from which a shard is worth a task of its own, and shards for each core as far as rows go.
SHARD_ROWS, SHARDS_A_CORE = 4096, 2
#: Rows of a tile of vectors.
TILE_ROWS = 4096
#: Queries that one matrix product takes at a time: bounds a task's memory with TILE_ROWS.
STRIP_ROWS = 256
#: Lists merged into one at each level of the tree.
FAN_IN = 32

_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v) with v: floor(scale * x) of each component as long; rows that are null, or hold a
    null or a component that is not finite, are left out, and so are rows without vec_id. A component
    beyond 64 bits is the nearest whole number of 64 bits."""
    x = F.col("embedding").cast("array<double>")
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(c * scale).cast("long"))
    return vectors.where(F.col("vec_id").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def best(score: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores of each row, ties to the earlier place."""
    n = score.shape[1]
    if n <= k:
        return np.broadcast_to(np.arange(n), score.shape)
    span = np.int64(1) << 13
    if n <= span and -(1 << 49) < score.min(initial=0) and score.max(initial=0) < 1 << 49:
        key = score * span + (span - 1 - np.arange(n))  # one number for score and place
        return np.argpartition(key, n - k, axis=1)[:, n - k :]
    return np.argsort(~score, axis=1, kind="stable")[:, :k]


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers: by floats where all sums are exact there, by int64 where they
    fit, else by Python's numbers; what 64 bits can't hold is the nearest that they can."""
    top = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(v.astype(np.float64)).max(initial=0)) * q.shape[1]
    for kind, most in ((np.float32, 2.0**24), (np.float64, 2.0**53)):
        if top < most:
            return (q.astype(kind) @ v.astype(kind).T).astype(np.int64)
    if top < 2.0**62:
        return q @ v.T
    exact = q.astype(object) @ v.astype(object).T
    return np.clip(exact, int(_LEAST), int(_MOST)).astype(np.int64) if exact.size else np.zeros(exact.shape, np.int64)


def best_of_shard(tiles: list[tuple[np.ndarray, np.ndarray, np.ndarray]], q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (score, vec_id, row) of the tiles (vec_ids, rows, vectors) for each row of q."""
    top = None
    for ids, rows, mat in tiles:
        score = products(q, mat)
        at = best(score, k)
        found = np.take_along_axis(score, at, axis=1), ids[at], rows[at]
        if top is None:
            top = found
            continue
        both = [np.concatenate([x, y], axis=1) for x, y in zip(top, found, strict=True)]
        order = np.lexsort((both[1], ~both[0]))[:, :k]  # ~ turns the order round and can't overflow
        top = tuple(np.take_along_axis(x, order, axis=1) for x in both)
    return top


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], bool, pa.RecordBatch]]:
    """The batch in runs of one shard and kind: ((dim, shard), is a query, rows)."""
    head = np.stack([batch.column(i).to_numpy() for i in range(3)])
    cut = np.flatnonzero((head[:, 1:] != head[:, :-1]).any(axis=0)) + 1
    for s, e in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
        if e > s:
            dim, shard, kind = head[:, s].tolist()
            yield (dim, shard), bool(kind), batch.slice(s, e - s)


def _matrix(part: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, rows, v = part.column(3).to_numpy(), part.column(4).to_numpy(), part.column(5)
    return ids, rows, v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)


def _search(k: int, tile_rows: int):
    """A function from a task's batches, each shard's vectors before its queries, to the shards' lists."""

    def run(batches):
        shard, held, tiles = None, [], []
        for batch in batches:
            for now, asks, part in _runs(batch):
                if now != shard:
                    shard, held, tiles = now, [], []
                if not asks:
                    held.append(_matrix(part, now[0]))
                    continue
                if held:
                    ids, rows, mat = (np.concatenate(x) for x in zip(*held, strict=True))
                    order = np.argsort(ids, kind="stable")
                    tiles, held = [(ids[o], rows[o], mat[o]) for s in range(0, len(ids), tile_rows) if len(o := order[s : s + tile_rows])], []
                if not tiles:
                    continue
                q_ids, q_rows, q = _matrix(part, now[0])
                for s in range(0, len(q_ids), STRIP_ROWS):
                    score, vec, row = best_of_shard(tiles, q[s : s + STRIP_ROWS], k + 1)  # one of them may be the query itself
                    other = row != q_rows[s : s + STRIP_ROWS, None]
                    n = other.sum(axis=1)
                    cols = (np.repeat(q_rows[s : s + STRIP_ROWS], n), np.repeat(q_ids[s : s + STRIP_ROWS], n), vec[other], score[other], np.full(int(n.sum()), now[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["q", "query_id", "vec_id", "score", "part"])

    return run


def _merge(lists: DataFrame, k: int, parts: int) -> DataFrame:
    """Merges lists of FAN_IN parts at a time until each query has one, and ranks it."""
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        lists = lists.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long"))
        w = Window.partitionBy("q", "part").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, asks: Column, k: int = 20, shard_values: int = SHARD_VALUES, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors(vec_id, v) where asks holds, the k other
    rows of highest inner product, all if there are fewer, ties to the smaller vec_id.

    vectors is as quantised() makes it. Candidates are all rows of the query's length but the query's own
    row. Rows that repeat a vec_id are rows of their own, as queries too: each has its own list. Scores
    that 64 bits can't hold are the nearest that they can. Other columns are ignored; an empty table gives
    an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "v", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("row"), F.coalesce(asks, F.lit(False)).alias("asks"))
    rows = stored(rows)
    most = SHARDS_A_CORE * spark.sparkContext.defaultParallelism
    n, d = F.col("count"), F.greatest(F.col("dim"), F.lit(1))
    shards = F.greatest(F.ceil(n * d / shard_values), F.least(F.lit(most), F.ceil(n / SHARD_ROWS))).cast("int")
    dims = stored(rows.groupBy("dim").count().select("dim", shards.alias("shards")))
    total = dims.agg(F.count("*").alias("dims"), F.sum("shards").alias("all"), F.max("shards").alias("most")).first()
    sized = rows.join(bounded(dims, 16, total.dims), "dim")
    own = sized.select("dim", F.pmod(F.xxhash64("row"), F.col("shards")).cast("int").alias("shard"), F.lit(0).alias("kind"), "vec_id", "row", "v")
    shard = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    queries = sized.where("asks").select("dim", shard.alias("shard"), F.lit(1).alias("kind"), "vec_id", "row", "v")
    dealt = own.unionByName(queries).repartition(max(1, total["all"] or 0), "dim", "shard").sortWithinPartitions("dim", "shard", "kind")
    small_batches(spark)
    lists = dealt.mapInArrow(_search(k, tile_rows), "q long, query_id long, vec_id long, score long, part long")
    return _merge(lists, k, total.most or 0)


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each row whose vec_id is divisible by 20, its 20 best among all other rows."""
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(rows, F.pmod("vec_id", F.lit(20)) == 0, 20)


OP9_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.row_no AS q, q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: CAST(p[1] AS HUGEINT) * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.row_no <> c.row_no AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rk FROM s
)
SELECT query_id, CAST(rk AS INTEGER) AS rank, vec_id, score FROM r WHERE rk <= 20
"""
