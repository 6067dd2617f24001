"""Tables that are written again and again: a run that dies half-way leaves the old table, and a rerun gives the same.

A versioned table is a folder of finished versions and a pointer to one of them. A new version is
written beside the old one and the pointer is moved last, in one rename, so a reader sees one version
or the other. A table in buckets is replaced bucket by bucket: only those that hold a listed key are read
and written again, and doing so twice changes nothing.
"""

from __future__ import annotations

import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stareflow.operators import relational as rel
from stareflow.operators.staging import staged

POINTER, BUCKET = "CURRENT", "bucket"


def _files(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def current_version(spark: SparkSession, path: str) -> str | None:
    """The name of the version that readers of the table see, or null if there is none yet."""
    files, pointer = _files(spark, f"{path}/{POINTER}")
    if not files.exists(pointer):
        return None
    return spark.read.text(str(pointer.toString())).first()[0]


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The table's current version. What was read stays readable: the version before is kept by replace_table()."""
    name = current_version(spark, path)
    if name is None:
        raise FileNotFoundError(f"no finished version in {path}")
    return spark.read.parquet(f"{path}/{name}")


def replace_table(df: DataFrame, path: str) -> str:
    """Writes df as the table's new version and gives its name. Versions that no pointer ever named, of runs that
    died, and all but the current and the last one are removed."""
    spark = df.sparkSession
    before, name = current_version(spark, path), f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    files, pointer = _files(spark, f"{path}/{POINTER}")
    _, draft = _files(spark, f"{path}/{POINTER}-{name}")
    out = files.create(draft, True)
    out.write(bytearray(name.encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(draft, pointer, options)
    for status in files.listStatus(pointer.getParent()):
        other = status.getPath().getName()
        if other not in (POINTER, name, before):
            files.delete(status.getPath(), True)
    return name


def upsert_table(new: DataFrame, path: str, keys: list[str]) -> str:
    """replace_table() of the current version with new's rows added, or put in place of those of the same keys."""
    spark = new.sparkSession
    if current_version(spark, path) is None:
        return replace_table(new, path)
    return replace_table(rel.upsert(read_current(spark, path), new, keys), path)


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_buckets(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """df as a table in folders of buckets of its key."""
    dealt = df.withColumn(BUCKET, _bucket(F.col(key), buckets))
    dealt.repartition(F.col(BUCKET), F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.partitionBy(BUCKET).mode("overwrite").parquet(path)


def replace_in_buckets(new: DataFrame, listed: DataFrame, path: str, key: str, buckets: int) -> None:
    """Takes all rows of the listed keys out of a table of write_buckets() and puts new's rows in. Only buckets of listed
    keys are read, through a filter on the folder, and written: what they will hold is stored first, then moved in by
    folders. Buckets that lose their last row are removed."""
    spark = new.sparkSession
    ids = listed.select(key).distinct()
    touched = [r[0] for r in ids.select(_bucket(F.col(key), buckets).alias(BUCKET)).distinct().collect()]  # one for each bucket at most
    if not touched:
        return
    table = spark.read.parquet(path)
    old = table.where(F.col(BUCKET).isin(*touched)).drop(BUCKET)
    rows = rel.replace_keys(old, new.select(*old.columns).join(ids, key, "left_semi"), ids, key)
    ready = staged(rows.withColumn(BUCKET, _bucket(F.col(key), buckets)))
    ready.repartition(F.col(BUCKET), F.pmod(F.xxhash64(*old.columns), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    left = {r[0] for r in ready.select(BUCKET).distinct().collect()}
    for bucket in touched:
        if bucket not in left:
            files, place = _files(spark, f"{path}/{BUCKET}={bucket}")
            files.delete(place, True)


def write_batches(df: DataFrame, path: str, order: list[Column], size: int) -> None:
    """df as JSON files in folders of batches of size rows in the given order."""
    rel.batches(df, order, size).repartition("batch").sortWithinPartitions("batch", *order).write.partitionBy("batch").mode("overwrite").json(path)


def text_key(text: Column) -> Column:
    """What a text's vector is kept by."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def to_embed(rows: DataFrame, vectors: DataFrame, text: str = "text") -> DataFrame:
    """(key, text) of texts without a vector, each once. vectors: (key, vector)."""
    keyed = rows.select(text_key(F.col(text)).alias("key"), F.col(text).alias("text"))
    return keyed.join(vectors.select("key"), "key", "left_anti").groupBy("key").agg(F.first("text").alias("text"))


def with_vectors(rows: DataFrame, vectors: DataFrame, text: str = "text") -> DataFrame:
    """rows with the vector of their text: every row of a text gets it, or null if there is none."""
    own = vectors.select(F.col("key").alias("_key"), "vector")
    return rows.join(own, text_key(F.col(text)) == F.col("_key"), "left").drop("_key")
