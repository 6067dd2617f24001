"""Writes that are repeated, or die half-way."""

import json

import pytest
from pyspark.sql import functions as F

from stareflow.sources import writers


def rows(df):
    return sorted(map(tuple, df.collect()))


def failing(df):
    """df with a row that can't be computed: a job that dies after others of its tasks are done."""
    return df.withColumn("v", F.when(F.col("k") == 7, F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("v")))


def test_a_version_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    one = spark.range(20).select(F.col("id").alias("k"), F.col("id").alias("v")).repartition(4)
    with pytest.raises(FileNotFoundError):
        writers.read_current(spark, path)
    writers.replace_table(one, path)
    held = writers.read_current(spark, path)
    with pytest.raises(Exception, match="killed"):
        writers.replace_table(failing(one.withColumn("v", F.col("v") + 100)), path)
    assert rows(writers.read_current(spark, path)) == rows(one)
    real = writers._files
    with monkeypatch.context() as m:  # dies between writing and moving the pointer
        def dies(spark, place):
            if "-v-" in place:
                raise OSError("killed")
            return real(spark, place)

        m.setattr(writers, "_files", dies)
        with pytest.raises(OSError, match="killed"):
            writers.replace_table(one.limit(3), path)
    assert rows(writers.read_current(spark, path)) == rows(one)
    new = spark.createDataFrame([(3, 33), (99, 1)], "k long, v long")
    writers.upsert_table(new, path, ["k"])
    assert rows(held) == rows(one)  # the version before stays for those that still read it
    first = rows(writers.read_current(spark, path))
    writers.upsert_table(new, path, ["k"])
    assert rows(writers.read_current(spark, path)) == first == sorted([(i, i) for i in range(20) if i != 3] + [(3, 33), (99, 1)])
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) == 2


def test_buckets_are_replaced_alone_and_twice_alike(spark, tmp_path):
    path = str(tmp_path / "b")
    old = spark.range(60).select((F.col("id") % 20).alias("k"), F.col("id").alias("v"))
    writers.write_buckets(old, path, "k", 8)
    read = lambda: rows(spark.read.parquet(path).select("k", "v"))
    assert read() == rows(old)
    listed = spark.createDataFrame([(1,), (7,), (7,), (50,)], "k long")
    new = spark.createDataFrame([(1, -1), (50, -2), (5, -3)], "k long, v long")  # 5 is not listed
    want = sorted([(k, v) for k, v in rows(old) if k not in (1, 7)] + [(1, -1), (50, -2)])
    with pytest.raises(Exception, match="killed"):
        writers.replace_in_buckets(failing(new.union(spark.createDataFrame([(7, 0)], "k long, v long"))), listed, path, "k", 8)
    assert read() == rows(old)
    for _ in range(2):
        writers.replace_in_buckets(new, listed, path, "k", 8)
        assert read() == want
    everything = old.select("k").union(listed)
    writers.replace_in_buckets(new.limit(0), everything, path, "k", 8)
    assert not [p for p in (tmp_path / "b").iterdir() if p.name.startswith("bucket=")]


def test_batches_are_files(spark, tmp_path):
    df = spark.range(25).select(F.col("id").alias("k"), F.concat(F.lit("q\n"), F.col("id")).alias("text")).repartition(5)
    for _ in range(2):
        writers.write_batches(df, str(tmp_path / "j"), [F.col("k")], 10)
        found = {}
        for p in (tmp_path / "j").glob("batch=*/*.json"):
            found.setdefault(int(p.parent.name.split("=")[1]), []).extend(json.loads(x)["k"] for x in p.read_text().splitlines())
        assert found == {0: list(range(10)), 1: list(range(10, 20)), 2: list(range(20, 25))}


def test_vectors_reach_every_row_of_a_text(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "")], "id long, text string")
    key = {r.t: r.k for r in spark.createDataFrame([("a",), ("",)], "t string").select("t", writers.text_key(F.col("t")).alias("k")).collect()}
    held = spark.createDataFrame([(key["a"], [1.0])], "key string, vector array<double>")
    todo = writers.to_embed(df, held)
    assert sorted((r.text or "") for r in todo.collect()) == ["", "b"]
    every = held.union(todo.select("key", F.array(F.length(F.coalesce("text", F.lit(""))).cast("double"))))
    assert rows(writers.with_vectors(df, every).select("id", F.get("vector", 0))) == [(1, 1.0), (2, 1.0), (3, 1.0), (4, 0.0), (5, 0.0)]
    assert rows(writers.with_vectors(df, held).where("vector IS NULL").select("id")) == [(2,), (4,), (5,)]
