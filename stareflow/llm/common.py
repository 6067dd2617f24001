"""What the corpus operators share: intermediate tables, size-checked broadcasts, word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes at which a word ends: space and \x09 to \x0D.
SPACE = b" \t\n\x0b\x0c\r"
#: The same rule for Spark's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a batch that a task works on at once, so that what it makes of them stays small.
SLICE_BYTES = 4 << 20
#: Bytes of an Arrow batch between Spark and a task's Python, where the session sets none of its own.
BATCH_BYTES = 8 << 20
#: A side of a join is broadcast only if its counted rows need no more bytes than this.
BROADCAST_BYTES = 32 << 20
#: A join key is hot from this share of the rows on (and from so many rows): fewer than HOT_SHARE keys
#: can be, whatever the table holds.
HOT_SHARE, HOT_ROWS = 2048, 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="stareflow-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """df written once as a Parquet table in the shared folder and read from there.

    This cuts the lineage: lost executors cost no recomputation of what stands before. forget()
    removes the files once nothing reads them; those that a result still reads stay with the job.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Removes the files of stored() tables that no later job reads."""
    for table in tables:
        spark = table.sparkSession
        files = table.inputFiles()
        folders = {f.rsplit("/", 1)[0] for f in files if "/tables/" in f}
        for folder in folders:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fits(rows: int, row_bytes: int) -> bool:
    """Whether so many rows of so many bytes may be broadcast."""
    return rows * row_bytes <= BROADCAST_BYTES


def bounded(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if its counted rows fit BROADCAST_BYTES; else df, to be shuffled."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if fits(n, row_bytes) else df


def joined(left: DataFrame, right: DataFrame, key: str, row_bytes: int, how: str = "inner", ready: bool = True) -> DataFrame:
    """left joined to right by key, however many rows of left share one; right has a key once at most.

    A right side whose counted rows fit is broadcast. Beyond that the keys that hold more than a
    HOT_SHARE-th of left's rows, fewer than HOT_SHARE of them, are joined by a broadcast of their few
    rows of right, and only the others are shuffled by key. Rows of left without a key meet nothing
    and are not shuffled. how: inner or left. ready: left is a stored table, which may be read again.
    """
    if fits(right.count(), row_bytes):
        return left.join(F.broadcast(right), key, how)
    left = left if ready else stored(left)
    counts = left.where(F.col(key).isNotNull()).groupBy(key).count()
    hot = F.broadcast(stored(counts.where(F.col("count") > max(HOT_ROWS, left.count() // HOT_SHARE)).select(key)))
    rest = left.where(F.col(key).isNotNull()).join(hot, key, "left_anti").join(right.join(hot, key, "left_anti"), key, how)
    out = rest.unionByName(left.join(hot, key, "left_semi").join(F.broadcast(right.join(hot, key, "left_semi")), key, how))
    if how == "left":
        nothing: list[Column] = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name != key]
        out = out.unionByName(left.where(F.col(key).isNull()).select(*left.columns, *nothing))
    return out


def small_batches(spark: SparkSession) -> None:
    """Batches of BATCH_BYTES for this session, unless it has a size of its own: texts are long, and
    Spark's default of 64 MB, held on both sides, is much of a small executor's memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH_BYTES))


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about most bytes each, of one row at least."""
    rows = max(1, batch.num_rows * most // max(batch.nbytes, 1))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def map_batches(
    df: DataFrame,
    start: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]],
    schema: str,
    most: int = SLICE_BYTES,
) -> DataFrame:
    """Applies start()'s function, made once for each task, to the Arrow batches of df, in parts of
    about most bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            for part in slices(batch, most):
                out = step(part)
                if out is not None and out.num_rows:
                    yield out
        pa.default_memory_pool().release_unused()  # the worker stays, idle or for the next task

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def utf8(text: str | None) -> bytes:
    """The text's UTF-8 bytes; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
