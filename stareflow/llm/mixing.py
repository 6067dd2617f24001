"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sizes are words. Each source's target is its weight's share of all words, but at most MOST times
its own; what is above is shared again by weight. Words are then allotted to the sources by the
highest quotients target / (2 k + 1), turned into blocks of the source's own size, and those allotted
to its shards by the highest quotients of shard sizes: whole quotas. Within a shard, documents lie
one after another in a seeded order and are cut into equal blocks; a quota of q over n blocks takes
each block q // n times and q % n of them, chosen by a seeded permutation, once more.

Where the mix is written as documents, none is cut: all of a source's documents lie one after another
in a seeded order, each is taken as many times as the source's words go whole into its allotment, and
those whose middle lies within the rest are taken once more. The order is that of a digest of id and
text, so each row tells by itself, from one digest for each source, how often it is taken: no text is
shuffled or sorted.

Rows that are alike in id, text and source are counted together before the first shuffle. The number of
shards follows the counted rows. What reaches the driver is one row for each source and for each shard
of SHARD_ROWS rows.
"""

from __future__ import annotations

from math import gcd

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stareflow.llm.common import WORD, bounded, stored

#: Highest number of times that a source, or a document, is taken.
MOST = 3
#: Rows that a shard holds, about, and shards at least; a source has its share of them, one at least.
SHARD_ROWS, SHARDS_LEAST = 200_000, 256
#: Rows alike of which one task writes so many; the others go to other tasks.
ALIKE = 4096
#: log2 of the ranges of the seeded order that are summed to find where a source's rest ends.
RANGE_BITS = 16
#: Blocks that an average source has at least, and words that a block has at most.
BLOCKS_A_SOURCE, BLOCK_WORDS = 8192, 4096
#: Blocks that any source has at least, as far as it has the words.
BLOCKS_LEAST = 100
SEED = 20

#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)


def targets(sizes: np.ndarray, weights: np.ndarray, most: float = MOST) -> np.ndarray:
    """What each source is to give: shares of all words by weight, none above most times its size."""
    limit, total = most * sizes.astype(np.float64), float(sizes.sum())
    out, free = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    while free.any():
        level = (total - limit[~free].sum()) / weights[free].sum()
        over = free & (weights * level > limit)
        if not over.any():
            out[free] = weights[free] * level
            break
        free &= ~over
    out[~free] = limit[~free]
    return out


def apportion(votes: np.ndarray, seats: int, limit: np.ndarray | None = None) -> np.ndarray:
    """Sainte-Laguë: seats go one by one to the highest quotient votes / (2 k + 1), k seats held.

    Found by a search for the divisor; the last few seats, of about equal quotients, go one by one,
    ties to the earlier. limit: the most that each may get.
    """
    votes = votes.astype(np.float64)
    limit = np.full(len(votes), np.iinfo(np.int64).max // 4) if limit is None else limit
    won = np.zeros(len(votes), np.int64)
    seats = min(int(seats), sum(limit[votes > 0].tolist()))
    if seats <= 0:
        return won

    def at(divisor: float) -> np.ndarray:
        return np.minimum(np.floor(votes / divisor + 0.5).astype(np.int64), limit)

    low, high = 0.0, 4 * votes.max() + 1.0  # too many seats at low, too few at high
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high) or at(high).sum() == seats:
            break
        low, high = (mid, high) if at(mid).sum() > seats else (low, mid)
    won = at(high)
    while (left := seats - int(won.sum())) > 0:
        quotient = np.where(won < limit, votes / (2 * won + 1), -1.0)
        top = np.argsort(-quotient, kind="stable")[:left]
        won[top[quotient[top] >= quotient[top[0]] * (1 - 1e-9)]] += 1
    return won


def _coprime(n: int, near: float) -> int:
    """A step through n blocks that meets each once, near a share of n."""
    step = max(1, round(n * near))
    while gcd(step, n) != 1:
        step += 1
    return step


def n_words(text: Column) -> Column:
    """Words of a text, which end at space and \\x09 to \\x0D only; null has none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def _plan(sources: list, shards: int) -> tuple[list[tuple], int]:
    """For each source, in order, (its place, size, target, number of shards)."""
    sizes = np.array([r.source_size for r in sources], np.int64)
    weights = np.array([WEIGHTS[i % len(WEIGHTS)] for i in range(len(sources))], np.float64)
    goal, total = targets(sizes, weights), max(1, int(sizes.sum()))
    return [(int(s), float(t), max(1, round(shards * int(s) / total))) for s, t in zip(sizes, goal, strict=True)], total


def _sources(items: DataFrame) -> list:
    """The sources' sizes, in order of code points, null last: one row for each source of the mix."""
    found = items.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")).collect()
    return sorted(found, key=lambda r: (r.source is None, (r.source or "").encode()))


def _goals(plan: list[tuple], total: int) -> np.ndarray:
    """Words allotted to the sources: whole numbers, by the highest quotients of the targets."""
    if not plan:
        return np.zeros(0, np.int64)
    return apportion(np.array([p[1] for p in plan]), total, MOST * np.array([p[0] for p in plan], np.int64))


def mixture(rows: DataFrame, shards: int | None = None, seed: int = SEED, blocks: int = BLOCKS_A_SOURCE) -> DataFrame:
    """rows(doc_id, mark, source, size) with the mix: source_size, target, and for each row the runs of
    its words that are taken: start (words of the shard before it), and the shard's m, n, base, extra,
    step and shift, from which RUNS counts. mark tells rows apart that share an id.

    Sources stand by code point, null last, as a source of its own. Rows of size 0 are taken 0
    times; with no words at all every target is 0. Rows that repeat an id are documents of their
    own. The result depends on the rows and the seed, not on their order or partitions.
    """
    spark = rows.sparkSession
    items = stored(rows.groupBy("source", "doc_id", "mark", "size").agg(F.count("*").alias("copies")))
    shards = shards or max(SHARDS_LEAST, -(-items.count() // SHARD_ROWS))
    found = _sources(items)
    plan, total = _plan(found, shards)
    named = [(i, r.source, *p) for i, (r, p) in enumerate(zip(found, plan, strict=True))]
    names = spark.createDataFrame(named, "source_no int, source string, source_size long, target double, shards long")
    names = bounded(names, 200, len(named))
    own = items.join(names, items["source"].eqNullSafe(names["source"])).drop(names["source"])
    own = own.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "mark"), F.col("shards"))).drop("shards")

    words_in = F.col("size") * F.col("copies")
    by_shard = own.groupBy("source_no", "shard").agg(F.sum(words_in).alias("m")).where("m > 0").collect()
    by_shard.sort(key=lambda r: (r.source_no, r.shard))
    m = np.array([r.m for r in by_shard], np.int64)
    no = np.array([r.source_no for r in by_shard], np.int64)
    sizes = np.array([p[0] for p in plan], np.int64)
    words = max(1, min(BLOCK_WORDS, total // (blocks * max(1, len(named)))))
    n = np.maximum(1, np.rint(m / np.clip(sizes // BLOCKS_LEAST, 1, words)[no]).astype(np.int64)) if len(m) else m
    quota = np.zeros(len(m), np.int64)
    cuts = np.searchsorted(no, np.arange(len(plan) + 1))
    for i, q in enumerate(_goals(plan, total)):
        at = slice(cuts[i], cuts[i + 1])
        quota[at] = apportion(m[at], round(int(q) * int(n[at].sum()) / max(1, plan[i][0])), MOST * n[at])
    quotas = []
    for r, k, q in zip(by_shard, n.tolist(), quota.tolist(), strict=True):
        step = _coprime(k, 0.6180339887)
        shift = (seed * 7919 + r.source_no * 104729 + r.shard * 1299709) % k
        quotas.append((r.source_no, r.shard, r.m, k, q // k, q % k, step, shift))
    table = spark.createDataFrame(quotas, "source_no int, shard long, m long, n long, base long, extra long, step long, shift long")

    order = Window.partitionBy("source_no", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "mark"), "doc_id", "mark", "size")
    placed = own.where("size > 0").withColumn("start", F.sum(words_in).over(order.rowsBetween(Window.unboundedPreceding, 0)) - words_in)
    placed = placed.unionByName(own.where("size = 0").withColumn("start", F.lit(0).cast("long")))
    placed = placed.join(bounded(table, 80, len(quotas)), ["source_no", "shard"], "left")
    # Rows alike lie one after another and are written as rows again, many of them by many tasks.
    many = placed.where(F.col("copies") > ALIKE).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(ALIKE).cast("long"))))
    many = many.repartition("doc_id", "mark", "first")
    every = placed.where(F.col("copies") <= ALIKE).withColumn("first", F.lit(0).cast("long")).unionByName(many)
    last = F.least(F.col("first") + ALIKE, F.col("copies")) - 1
    every = every.withColumn("copy", F.explode(F.sequence(F.col("first"), last)))
    return every.withColumn("start", F.col("start") + F.col("copy") * F.col("size")).drop("copies", "first", "copy")


#: Takes of the words of one document: (first word, words, times) for each block that it meets.
RUNS = """
CASE WHEN size > 0 AND n IS NOT NULL THEN transform(
  sequence(((start + 1) * n - 1) DIV m, ((start + size) * n - 1) DIV m),
  k -> named_struct(
    'from', greatest(k * m DIV n, start) - start,
    'words', least((k + 1) * m DIV n, start + size) - greatest(k * m DIV n, start),
    'times', base + IF((k * step + shift) % n < extra, 1L, 0L)))
ELSE array() END
"""


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, source, size) of docs(doc_id, text, source)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "source", n_words(F.col("text")).alias("size"))


def mix_sources(docs: DataFrame, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs(doc_id, text, source).

    taken: the words that the mix takes of the document, repeats counted. See mixture() for nulls,
    ties and repeated rows; very long texts are counted whole and span many blocks; other columns are
    ignored and an empty table gives an empty one.
    """
    out = mixture(sized(docs), shards, seed).withColumn("runs", F.expr(RUNS))
    taken = F.aggregate("runs", F.lit(0).cast("long"), lambda acc, r: acc + r["words"] * r["times"])
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to their sources' targets."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def rests(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """(source, base, range, last): how often a source's documents are taken: base times, and once more
    where the range of their place in the seeded order is below the given one, or is the same and the
    place no later than last. rows as sized() makes them."""
    spark = rows.sparkSession
    place = place_of(F.col("doc_id"), F.col("mark"), seed)
    items = rows.groupBy("source", place.alias("place"), "size").agg(F.count("*").alias("copies"))
    items = stored(items.withColumn("range", F.shiftright("place", 64 - RANGE_BITS)))
    found = _sources(items)
    plan, total = _plan(found, 1)
    goals = [divmod(int(q), max(1, p[0])) for q, p in zip(_goals(plan, total), plan, strict=True)]
    table = spark.createDataFrame([(i, r.source, *g) for i, (r, g) in enumerate(zip(found, goals, strict=True))], "source_no int, source string, base long, rest long")
    table = bounded(table, 100, len(goals))
    items = items.join(table, items["source"].eqNullSafe(table["source"])).drop(table["source"]).drop("source")
    words = F.col("size") * F.col("copies")
    upto = Window.partitionBy("source_no").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = items.groupBy("source_no", "range", "rest").agg(F.sum(words).alias("words")).withColumn("stop", F.sum("words").over(upto))
    ends = stored(ranges.where("stop - words <= rest AND rest < stop").select("source_no", "range", (F.col("stop") - F.col("words")).alias("before")))
    inside = items.join(bounded(ends, 60), ["source_no", "range"])
    upto = Window.partitionBy("source_no").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("stop", F.col("before") + F.sum(words).over(upto))
    last = inside.where(2 * F.col("stop") - words <= 2 * F.col("rest")).where("size > 0").groupBy("source_no").agg(F.max("place").alias("last"))
    out = ends.join(last, "source_no", "left")
    return table.join(out, "source_no", "left").select("source", "base", "range", "last")


def place_of(doc_id: Column, mark: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed + 1), doc_id, mark)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: a row, as it is, for each time that a document is taken. Copies share
    the doc_id.

    Null, empty and wordless texts are not taken. Rows alike in id and text are taken equally often, as
    one document. Null ids are documents like others; all columns are kept; an empty table gives an empty
    one. Texts, however long, are taken whole or not at all.
    """
    table = stored(rests(sized(docs)).select(F.col("source").alias("__sf_source"), F.col("base").alias("__sf_base"), F.col("range").alias("__sf_range"), F.col("last").alias("__sf_last")))
    place = place_of(F.col("doc_id").cast("long"), F.xxhash64("text"), SEED)
    both = docs.join(bounded(table, 100), docs["source"].eqNullSafe(table["__sf_source"]))
    range_ = F.shiftright(place, 64 - RANGE_BITS)
    more = (range_ < F.col("__sf_range")) | ((range_ == F.col("__sf_range")) & (place <= F.col("__sf_last")))
    times = F.when(F.col("text").rlike(WORD), F.col("__sf_base") + F.coalesce(more.cast("int"), F.lit(0))).otherwise(0).cast("int")
    return both.withColumn("__sf_time", F.explode(F.array_repeat(F.lit(0), times))).select(*docs.columns)
