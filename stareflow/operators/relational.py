"""Relational patterns that the engine's views and loaders are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row of each key that is last by order; an aggregate, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def ordered(df: DataFrame, keys: list[str], value: str, alias: str) -> DataFrame:
    """Each key's distinct values in order, as an array; for dates and other values with few repeats."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_set(value)).alias(alias))


def natural_number(number: Column) -> Column:
    """The digits of a section's number as a number; none count as 0."""
    digits = F.regexp_replace(F.coalesce(number, F.lit("0")), "[^0-9]", "")
    return F.coalesce(F.try_to_number(F.nullif(digits, F.lit("")), F.lit("999999999999")).cast("long"), F.lit(0).cast("long"))


def list_position(value: Column, order: list[str]) -> Column:
    """Place of a value in a list, from 1; values that are not in it come last."""
    at = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(at > 0, at).otherwise(len(order) + 1)


def duplicate_groups(df: DataFrame, keys: list[Column], member: str) -> DataFrame:
    """Groups of more than one member, by expressions: their size, and first and last member."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(member).alias("first"), F.max(member).alias("last")).where("n > 1")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's rows added, or put in place of those of the same keys. New keys are unique."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def upsert_keeping(old: DataFrame, new: DataFrame, keys: list[str], source: str, derived: str) -> DataFrame:
    """upsert() of rows without the derived column: it stays where the source column did not change."""
    before = old.select(*keys, F.col(source).alias("_source"), F.col(derived).alias("_derived"))
    kept = new.join(before, keys, "left").withColumn(derived, F.when(F.col("_source").eqNullSafe(F.col(source)), F.col("_derived")))
    return upsert(old, kept.select(*old.columns), keys)


def replace_keys(old: DataFrame, new: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """old without any row of the listed keys, and new."""
    return old.join(listed.select(key).distinct(), key, "left_anti").unionByName(new)


def fill_from(old: DataFrame, fixes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """old with columns taken from fixes where it has the key and a value."""
    new = fixes.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    out = old.join(new, keys, "left")
    return out.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in columns}).select(*old.columns)


def prune(df: DataFrame, keys: DataFrame, key: str, only: Column) -> DataFrame:
    """df without the rows of the given kind whose key is gone."""
    gone = df.where(only).join(keys.select(key), key, "left_anti").select(key).distinct()
    return df.join(gone, key, "left_anti")


def left_joined(df: DataFrame, other: DataFrame, key: str, by: str) -> DataFrame:
    """df left-joined with other by a key that is often null: rows without it are dealt by another column. Left to
    itself, Spark sends them all to one task."""
    without = F.when(F.col(key).isNull(), F.xxhash64(by)).otherwise(F.lit(0).cast("long"))
    zero = F.pmod(F.xxhash64(key), F.lit(1))  # always 0, but no literal, which Spark would take out of the join's keys
    return df.withColumn("_deal", without).join(other.withColumn("_deal", zero), [key, "_deal"], "left").drop("_deal")


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of a list."""
    return df.orderBy(*order).offset(offset).limit(limit)


def uncached(df: DataFrame, cache: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with a cached answer, distinct keys still to be asked): content-addressed by key."""
    keyed = df.withColumn("cache_key", key)
    return keyed.join(cache, "cache_key"), keyed.join(cache, "cache_key", "left_anti").dropDuplicates(["cache_key"])


def batches(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """df with a batch number, size rows to a batch in the given order.

    Rows are ranked inside range partitions, and partitions' sizes are added up from a table of one
    row each, so no task sees all rows.
    """
    parts = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    own = Window.partitionBy("_part").orderBy(*order)
    ranked = parts.withColumn("_rank", F.row_number().over(own))
    sizes = ranked.groupBy("_part").count()
    before = sizes.withColumn("_before", F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    return ranked.join(F.broadcast(before.select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))), "_part").withColumn("batch", F.floor((F.col("_before") + F.col("_rank") - 1) / size)).drop("_part", "_rank", "_before")


def stratified(df: DataFrame, bucket: str, stratum: str, key: str, per_bucket: int, seed: str) -> DataFrame:
    """A sample of each bucket, its strata taken in turn; the order inside a stratum is a seeded hash."""
    order = F.sha1(F.concat(F.lit(seed), F.col(key).cast("string")))
    turn = Window.partitionBy(bucket, stratum).orderBy(order, key)
    pick = Window.partitionBy(bucket).orderBy("_turn", stratum)
    # Only the first per_bucket turns of a stratum can be picked.
    ranked = df.withColumn("_turn", F.row_number().over(turn)).where(F.col("_turn") <= per_bucket)
    return ranked.withColumn("_pick", F.row_number().over(pick)).where(F.col("_pick") <= per_bucket).drop("_turn", "_pick")


def citing_list(mentions: DataFrame, judgments: DataFrame) -> DataFrame:
    """For each provision the judgments that cite it: how often, the first mention, and the rank by
    court, then the newest, then the id. Second copies are left out."""
    live = judgments.where("duplicate_of IS NULL").drop("duplicate_of")
    first = F.min_by(F.struct("raw_text", "paragraph"), F.struct("char_start", "raw_text", "paragraph"))
    out = mentions.groupBy("provision_id", "judgment_id").agg(F.count("*").alias("mentions"), first.alias("first")).join(live, "judgment_id")
    rank = Window.partitionBy("provision_id").orderBy(F.desc("court"), F.desc_nulls_last("decision_date"), "judgment_id")
    return out.select("provision_id", "judgment_id", "court", "decision_date", "mentions", F.col("first.raw_text").alias("first_text"), F.col("first.paragraph").alias("first_paragraph"), F.row_number().over(rank).alias("rank"))


def cited_counts(mentions: DataFrame, judgments: DataFrame, members: DataFrame) -> DataFrame:
    """(chain, cited_by): distinct judgments that cite any id of a section, copies counted as one."""
    copies = judgments.select("judgment_id", F.coalesce("duplicate_of", "judgment_id").alias("own"))
    pairs = mentions.select("provision_id", "judgment_id").distinct().join(members, "provision_id").join(copies, "judgment_id")
    return pairs.select("chain", "own").distinct().groupBy("chain").agg(F.count("*").alias("cited_by"))


def lead_counts(events: DataFrame, judgments: DataFrame, members: DataFrame) -> DataFrame:
    """(chain, lead_count): leads of a section, one for each judgment and type, without those that a
    verified event of any of its ids already records."""
    own = events.join(members, "provision_id")
    leads = own.where(~F.col("verified") & ~F.col("check_verdict").eqNullSafe(F.lit("fail"))).join(judgments.where("duplicate_of IS NULL").select("judgment_id"), "judgment_id", "left_semi")
    seen = own.where("verified").select("chain", "judgment_id", "event_type").distinct()
    open_ = leads.select("chain", "judgment_id", "event_type").distinct().alias("l").join(
        seen.alias("v"), (F.col("l.chain") == F.col("v.chain")) & F.col("l.judgment_id").eqNullSafe(F.col("v.judgment_id")) & (F.col("l.event_type") == F.col("v.event_type")), "left_anti"
    )
    return open_.groupBy("chain").agg(F.count("*").alias("lead_count"))


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, n_present, n): how many rows have a field that is neither null nor empty."""
    counts = [F.count_if(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "").alias(c) for c in columns]
    one = df.agg(F.count("*").alias("n"), *counts)
    return one.select("n", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("n_present")) for c in columns))).alias("x")).select("x.field", "x.n_present", "n")
